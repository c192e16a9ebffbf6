"""Vectorised words: byte classes, word bounds and 64-bit word hashes of many texts at once, without a Python loop over words."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of the rolling polynomial, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that one table of powers spans.
_SPAN = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(_BASE, _SPAN + 1), _powers(_INVERSE, _SPAN + 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random value for each byte; upper and lower case ASCII letters share one.
_VALUE = mix(LOWER.astype(U) * U(0xD1342543DE82EF95) + U(0x2545F4914F6CDD1D))
#: The same without folding of case.
_VALUE_AS_IS = mix(np.arange(256, dtype=U) * U(0xD1342543DE82EF95) + U(0x2545F4914F6CDD1D))

#: Words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of folded text: digits, letters, all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def bounds(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = kind[buf]
    st, en = w.copy(), w.copy()
    st[1:] &= ~w[:-1]
    en[:-1] &= ~w[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    st[first] = w[first]
    en[last] = w[last]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words; equal words have equal hashes wherever they stand."""
    value = _VALUE if fold else _VALUE_AS_IS
    out = np.empty(len(starts), U)
    lo, n = 0, len(starts)
    while lo < n:
        s0 = starts[lo]
        hi = int(np.searchsorted(ends, s0 + _SPAN, "right"))
        if hi <= lo:  # one word longer than a span
            total, at, power = 0, int(s0), 1
            while at < ends[lo]:
                part = buf[at : min(at + _SPAN, int(ends[lo]))]
                total += int((value[part] * _POWER[: len(part)]).sum(dtype=U)) * power
                power = power * pow(_BASE, len(part), 1 << 64) % (1 << 64)
                at += len(part)
            out[lo] = total % (1 << 64)
            lo += 1
            continue
        seg = buf[s0 : ends[hi - 1]]
        run = np.zeros(len(seg) + 1, U)
        np.cumsum(value[seg] * _POWER[: len(seg)], out=run[1:])
        s, e = starts[lo:hi] - s0, ends[lo:hi] - s0
        out[lo:hi] = (run[e] - run[s]) * _BACK[s]
        lo = hi
    return mix(out)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(width):
        out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out + U(width))


def doc_sets(h: np.ndarray, word_ptr: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles, 63 bits each; a shorter text counts as one shingle."""
    whole = shingles(h, width)
    out = []
    for a, b in zip(word_ptr[:-1].tolist(), word_ptr[1:].tolist()):
        if b - a >= width:
            got = whole[a : b - width + 1]
        elif b > a:
            got = shingles(h[a:b], b - a)
        else:
            got = whole[:0]
        out.append(np.unique(got >> U(1)))
    return out
