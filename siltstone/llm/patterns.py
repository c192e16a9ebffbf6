"""Whether a pattern occurs in a string, without backtracking: the places that each part of the pattern reaches are sets of bits.

The signs that a pattern is made of (characters, classes, anchors) are asked of ``regex`` one by one, so both ways agree.  The time is
at most the product of the pattern, its counts and the square of the string over the width of a word; most often far less.
"""

from __future__ import annotations

import math
import re

import regex

_LOOKS = {"(?=": ("look", True, True), "(?!": ("look", True, False), "(?<=": ("look", False, True), "(?<!": ("look", False, False)}
_GROUP = re.compile(r"\(\?(?:<?[=!]|:|P?<[^\W\d]\w*>)|\((?![?*])")
_SIGN = re.compile(
    r"""(?P<at>[\^$]|\\[bBAZ])
    |(?P<one>\.|\[\^?\]?(?:[^\]\[\\]|\\.|\[:\^?(?:al(?:num|pha)|blank|cntrl|digit|graph|lower|print|punct|space|upper|word|xdigit):\])*\]|\\(?:[dDwWsSnrtfva]|[pP](?:\{[^}]*\}|[A-Z])|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[^\w])|[^\\()|*+?{\[.^$])""",
    re.S | re.X,
)
_TIMES = re.compile(r"(?:([*+?])|\{(?:([0-9]+)(,?)([0-9]*)|,([0-9]+))\})(\??)")


class Unable(Exception):
    """The pattern has a part that sets of places cannot follow, as back references."""


def parsed(pattern: str):
    """("any", parts) of ("all", parts) of ("one", sign), ("at", sign), ("times", part, least, most) or ("look", ahead, wanted, part)."""
    opened: list = [[(), [[]]]]  # groups not yet closed: what looks, and alternatives
    i = 0
    while i < len(pattern):
        row = opened[-1][1][-1]
        if pattern[i] == "|":
            opened[-1][1].append([])
            i += 1
            continue
        if pattern[i] == "(":
            if not (m := _GROUP.match(pattern, i)):
                raise Unable(pattern[i:])
            opened.append([_LOOKS.get(m[0], ()), [[]]])
            i = m.end()
            continue
        if pattern[i] == ")":
            if len(opened) == 1:
                raise Unable(pattern[i:])
            looks, ways = opened.pop()
            row = opened[-1][1][-1]
            part = ("any", [("all", w) for w in ways])
            row.append((*looks, part) if looks else part)
            i += 1
        elif m := _SIGN.match(pattern, i):
            row.append((m.lastgroup, m[0]))
            i = m.end()
        else:
            raise Unable(pattern[i:])
        if m := _TIMES.match(pattern, i):
            low, high = {"*": (0, math.inf), "+": (1, math.inf), "?": (0, 1)}.get(m[1]) or (int(m[2] or 0), int(m[5]) if m[5] else int(m[4]) if m[4] else math.inf if m[3] else int(m[2]))
            row.append(("times", row.pop(), low, high))
            i = m.end()
            if pattern[i : i + 1] and pattern[i] in "*+?{":
                raise Unable(pattern[i:])
    if len(opened) > 1:
        raise Unable(pattern)
    return "any", [("all", w) for w in opened[0][1]]


class Places:
    """The places of one string, from 0 to its length, as bits of integers."""

    def __init__(self, text: str):
        self.text, self.every, self.masks = text, (1 << len(text) + 1) - 1, {}

    def mask(self, kind: str, sign: str) -> int:
        """Places before a character that the sign stands for, or at which the anchor holds."""
        if (kind, sign) not in self.masks:
            rule = regex.compile(sign)
            if kind == "one":
                bits = self.text.translate({ord(c): "1" if rule.fullmatch(c) else "0" for c in set(self.text)})
            else:
                at = {m.start() for m in rule.finditer(self.text)}
                bits = "".join("1" if k in at else "0" for k in range(len(self.text) + 1))
            self.masks[kind, sign] = int(bits[::-1] or "0", 2)
        return self.masks[kind, sign]

    def reached(self, part, start: int, back: bool, seen: dict) -> int:
        """Where matches of the part that begin in ``start`` end (``back``: the reverse).  ``seen``: places that open repetitions have been at; what follows from those has been given before."""
        kind = part[0]
        if not start:
            return 0
        if kind == "one":
            m = self.mask(*part)
            return start >> 1 & m if back else (start & m) << 1
        if kind == "at":
            return start & self.mask(*part)
        if kind == "all":
            for p in reversed(part[1]) if back else part[1]:
                start = self.reached(p, start, back, seen)
            return start
        if kind == "any":
            found = 0
            for p in part[1]:
                found |= self.reached(p, start, back, seen)
            return found
        if kind == "look":
            if id(part) not in self.masks:
                self.masks[id(part)] = self.reached(part[3], self.every, part[1], {})
            return start & (self.masks[id(part)] if part[2] else ~self.masks[id(part)])
        _, inner, low, high = part
        mine = seen.setdefault(id(part), {})
        size = len(self.text) + 1
        for k in range(min(low, size)):  # after so many rounds one more changes nothing
            start = self.reached(inner, start, back, mine.setdefault(k, {}))
            if not start:
                return 0
        if high == math.inf:
            old = mine.get("old", 0)
            new = start & ~old
            mine["old"] = old | new
            if inner[0] == "one":
                mine["old"] |= self.run(self.mask(*inner), new, back)
            else:
                again = mine.setdefault("again", {})
                while new:
                    new = self.reached(inner, new, back, again) & ~mine["old"]
                    mine["old"] |= new
            return mine["old"] & ~old
        found, k = start, low
        while start and k < high:
            start = self.reached(inner, start, back, mine.setdefault(k, {})) & ~found
            found |= start
            k += 1
        return found

    def run(self, mask: int, start: int, back: bool) -> int:
        """Places reached over characters of the mask only, by steps of 1, 2, 4, ..."""
        step = 1
        while mask:
            start |= start >> step & mask if back else (start & mask) << step
            mask &= mask >> step
            step *= 2
        return start


def occurs(pattern: str, text: str) -> bool:
    """Whether ``regex`` would find the pattern in the text, had it the time.  Unable where the pattern has more than characters, classes, anchors, groups, repetitions and looks ahead or back."""
    places = Places(text)
    return places.reached(parsed(pattern), places.every, False, {}) != 0
