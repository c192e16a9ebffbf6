"""The normaliser of a SentencePiece model as a transducer over characters, compiled from the model's own table.

The table is a double-array trie from byte strings to their replacements.  At each place the longest entry that matches is replaced, and a character
without one stands for itself.  Around that, by the model's flags: blanks at the ends go and runs of them become one, a blank is put in front, and blanks become U+2581.
"""

from __future__ import annotations

import numpy as np

MARK = "▁"


class Charsmap:
    """Arcs from byte strings to replacements; states are places in the double array."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.outputs: dict[int, str] = {}
        # without an arc for its first byte a character stands for itself
        root = self._offset(self.units[0])
        self.first = [self._label(self.units[root ^ b]) == b if root ^ b < len(self.units) else False for b in range(256)]

    # fixed by the format of the double array: bits of a unit
    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    @staticmethod
    def _label(unit: int) -> int:
        return unit & (1 << 31 | 255)

    def output(self, at: int) -> str:
        if at not in self.outputs:
            self.outputs[at] = self.texts[at : self.texts.index(b"\0", at)].decode("utf-8", "replace")
        return self.outputs[at]

    def longest(self, raw: bytes, start: int) -> tuple[int, str] | None:
        """(bytes, replacement) of the longest entry from ``start`` on."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(start, len(raw)):
            node ^= raw[i]
            if node >= len(units) or self._label(units[node]) != raw[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - start, units[node] & (1 << 31) - 1
        return found and (found[0], self.output(found[1]))


class Normaliser:
    def __init__(self, charsmap: bytes = b"", prefix: bool = True, squeeze: bool = True, escape: bool = True):
        """``prefix``: a blank in front; ``squeeze``: no blanks at the ends, one in between; ``escape``: blanks become U+2581."""
        self.map = Charsmap(charsmap) if charsmap else None
        self.prefix, self.squeeze, self.blank = prefix, squeeze, MARK if escape else " "

    def pieces(self, text: str):
        """What each character or entry of the text becomes."""
        if self.map is None:
            yield from text
            return
        raw, i = text.encode("utf-8", "replace"), 0
        while i < len(raw):
            hit = self.map.longest(raw, i) if self.map.first[raw[i]] else None
            if hit:
                i += hit[0]
                yield hit[1]
            else:
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                yield raw[i : i + n].decode("utf-8", "replace")
                i += n

    def apply(self, text: str) -> str:
        if self.map is None and not self.squeeze:
            return ((self.blank if self.prefix else "") + text.replace(" ", self.blank)) if text else ""
        out: list[str] = []
        after_blank = self.squeeze
        for p in self.pieces(text):
            if after_blank:
                p = p.lstrip(" ")
            if p:
                out.append(p)
                after_blank = self.squeeze and p[-1] == " "
        done = "".join(out)
        if self.squeeze:
            done = done.rstrip(" ")
            if not done:
                return ""
        elif not text:
            return ""
        return ((" " if self.prefix else "") + done).replace(" ", self.blank)
