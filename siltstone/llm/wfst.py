"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of the model's normaliser (``normaliser``), its
pieces as a trie of arcs from characters to ids, and arcs from characters that no piece spells to their bytes' ids.  Encoding
composes it with the input, state by state as the search gets there, and takes the shortest path in the tropical semiring (min, +).

A unigram model weighs its arcs by minus the pieces' scores, and the shortest path is its answer.  A BPE model merges greedily;
no weights on single pieces give the same result.  There the state also holds the last piece, and an arc has weight infinity
where its pair with that piece is not stable, which is to say where merging the two pieces' characters alone would give another
result.  A sequence of pieces is the model's result exactly if all its neighbours are stable: merges inside pieces run in the
same order with and without the rest of the text until one crosses a boundary, and the first to cross would cross in the pair too.
Each prefix then has one finite path, so the composed machine is deterministic and the search is linear.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, narrow, release
from .normaliser import MARK, Normaliser

#: Segments and pairs of pieces that a worker remembers; longer segments are not remembered.
REMEMBERED, PAIRS, LONG = 400_000, 400_000, 48
UNIGRAM, BPE = 1, 2


def _fields(b: bytes):
    """(field, value) of a serialised protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = s = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << s
            s += 7
            if c < 128:
                return x

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, b[i : i + n]
            i += n


class Transducer:
    """A compiled model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        pieces, self.kind, normaliser, fallback, spec = [], UNIGRAM, {}, 0, {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, 1)))
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, fallback = spec.get(3, UNIGRAM), spec.get(35, 0)
            elif field == 3:
                normaliser = dict(_fields(value))
        if not normaliser.get(5, 1) or spec.get(24, 0) or any(t == 4 for _, _, t in pieces):
            raise ValueError("models whose blanks stay, stand behind words, or that have user-defined pieces are not compiled")
        self.prefix = bool(normaliser.get(3, 1))
        self.normaliser = Normaliser(normaliser.get(2, b""), self.prefix, bool(normaliser.get(4, 1)))
        self.pieces = [p for p, _, _ in pieces]
        self.score = {p: s for p, s, t in pieces if t == 1}  # the pieces that spell text
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == 1}
        self.code = {p: struct.pack("<i", i) for p, i in self.id.items()}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == 2)
        self.lost, self.fallback = struct.pack("<i", self.unknown), {}
        bytes_ = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.bytes = bytes_ if fallback and len(bytes_) == 256 else None
        worst = min(self.score.values())
        self.penalty = worst - 10.0
        self.root: dict = {}
        for p in self.id:
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        alone = set("".join(self.id)) - {c for p in self.id if len(p) > 1 for c in p}
        inner = any(MARK in p.lstrip(MARK) for p in self.id)
        # cut where no piece can stand across: before a mark, and on both sides of a line end
        end = "\n" if "\n" in alone or not any("\n" in p for p in self.id) else ""
        self.cut = re.compile(r"[\s\S]+" if inner else rf"{end}|{MARK}+[^{MARK}{end}]*|[^{MARK}{end}]+" if end else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memo = _Memo(self)
        self.stable: dict[tuple, bool] = {}
        self.surface = [self._spelled(i, p, t) for i, (p, _, t) in enumerate(pieces)]

    def _spelled(self, i: int, piece: str, kind: int) -> bytes:
        if kind == 6:
            return bytes([int(piece[1:-1], 16)])
        if kind == 2:
            return " ⁇ ".encode()
        return b"" if kind == 3 else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        return self.normaliser.apply(text)

    # stability of a pair, by the model's own merges
    def merged(self, text: str) -> list[str]:
        """Greedy merges: the best score first, then the leftmost."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _fits(self, last: str | None, piece: str) -> bool:
        key = (last, piece)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > PAIRS:
                self.stable.clear()
            whole = [piece] if last is None else [last, piece]
            known = self.stable[key] = self.merged("".join(whole)) == whole
        return known

    def shortest(self, text: str) -> list[str]:
        """Pieces on the shortest path; a character that is no piece stands for itself."""
        return self._only_path(text) if self.kind == BPE else self._cheapest(text)

    def _only_path(self, text: str) -> list[str]:
        """Of a BPE model: each prefix has one path of finite weight, so the first stable arc to a place is the last."""
        n = len(text)
        last: list = [None] * (n + 1)
        back = [0] * (n + 1)
        root, stable, fits = self.root, self.stable, self._fits
        for s in range(n):
            prev = last[s]
            if prev is None and s:
                continue
            node, e = root, s
            while e < n:
                node = node.get(text[e])
                if node is None:
                    break
                e += 1
                if last[e] is None and "" in node:
                    p = node[""]
                    ok = stable.get((prev, p))
                    if ok if ok is not None else fits(prev, p):
                        last[e] = p
                        back[e] = s
            c = text[s]
            if last[s + 1] is None and c not in self.id and fits(prev, c):
                last[s + 1] = c
                back[s + 1] = s
        out, e = [], n
        while e:
            out.append(last[e])
            e = back[e]
        out.reverse()
        return out

    def _cheapest(self, text: str) -> list[str]:
        """Of a unigram model: the least sum of weights."""
        n = len(text)
        cost, last, back = [math.inf] * (n + 1), [None] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for s in range(n):
            node, e, one = self.root, s, False
            while e < n and (node := node.get(text[e])) is not None:
                e += 1
                if (p := node.get("")) is not None:
                    one |= e == s + 1
                    if cost[s] - self.score[p] < cost[e]:
                        cost[e], last[e], back[e] = cost[s] - self.score[p], p, s
            if not one and cost[s] - self.penalty < cost[s + 1]:
                cost[s + 1], last[s + 1], back[s + 1] = cost[s] - self.penalty, text[s], s
        out, e = [], n
        while e:
            out.append(last[e])
            e = back[e]
        return out[::-1]

    def arc(self, piece: str) -> bytes:
        """What an arc of the path puts out: a piece's id, or of a character that no piece spells its bytes' ids, or the unknown id."""
        if piece not in self.code:
            if not self.bytes:
                return self.lost
            if len(self.fallback) > PAIRS:
                self.fallback.clear()
            if piece not in self.fallback:
                self.fallback[piece] = b"".join(struct.pack("<i", self.bytes[b]) for b in piece.encode())
            return self.fallback[piece]
        return self.code[piece]

    def segment(self, text: str) -> bytes:
        """Ids of a segment, four bytes each."""
        path = self.shortest(text)
        try:
            return b"".join([self.code[p] for p in path])
        except KeyError:
            arcs = map(self.arc, path)
            # neighbours that are all unknown are one
            return b"".join(arcs if self.bytes else (a for k, g in groupby(arcs) for a in ([k] if k == self.lost else g)))

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        return b"".join(map(self.memo.__getitem__, self.cut.findall(self.normalise(text))))

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


class _Memo(dict):
    """Segments seen: when it is full it becomes the older half, and what is asked for again moves back to the new one."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner, self.old = owner, {}

    def __missing__(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            got = self.owner.segment(text)
        if len(text) <= LONG:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[text] = got
        return got


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The model of a file, compiled once in a worker."""
    return Transducer(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_pieces, n_fallback (byte pieces), ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip, and the ids if asked for.

    round_trip says whether decoding the ids gives the text back; a text that the normaliser changes or that holds U+2581 itself does not come back.
    ``path`` is a sentencepiece model, at the same place on every executor.  Null texts are empty: no pieces.
    Null ids and repeated rows are kept; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        t = load(path)
        low, high = (min(t.bytes.values()), max(t.bytes.values())) if t.bytes else (0, -1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got, size, n, fall, sha, same = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    raw = t.encode(text)
                    x = np.frombuffer(raw, "<i4")
                    size.append(len(text.encode()))
                    n.append(len(x))
                    fall.append(int(((x >= low) & (x <= high)).sum()))
                    sha.append(hashlib.sha256(raw).hexdigest())
                    same.append(t.decode(x.tolist()) == text)
                    got.append(x if ids else None)
                cols = [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(fall, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(got, pa.list_(pa.int32()))] if ids else [])], [*"doc_id n_bytes n_pieces n_fallback ids_sha256 round_trip".split(), *(["ids"] if ids else [])])
        release()

    schema = "doc_id long, n_bytes long, n_pieces long, n_fallback long, ids_sha256 string, round_trip boolean"
    return narrow(docs, id_col, text_col).mapInArrow(run, schema + (", ids array<int>" if ids else ""))


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and the text of the ids.

    Null ids give a null text, no ids an empty one; rows with a null doc_id and repeated rows are kept; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        t = load(path)
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
