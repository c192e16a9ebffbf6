"""Benchmark decontamination with suffix arrays of the training texts.

Each batch of training texts is a shard: a suffix array over its words, ordered as deep as a window needs
(``DEPTH`` words; a text's end sorts first).  Every test suffix is looked up in every shard by binary search; matches are
verified on 64-bit word hashes, and runs of matches along one diagonal are the longest verbatim matches, with their places in item and text.
The texts are never shuffled.  The benchmark goes to the executors in blocks of about
``BLOCK_BYTES``; with several blocks the texts pass through one search after the other, and are written between two.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat_text, narrow, stored, text_chunks
from .words import ALNUM, U, bounds, hashes

#: Words of a window, and words up to which suffixes are ordered (a multiple of four).
WINDOW, DEPTH = 10, 12
#: Bytes of benchmark text that are searched for together; pairs of a place in an item and one in a text that are followed together.
BLOCK_BYTES, PAIRS = 4 << 20, 1 << 20

_NONE = hashlib.sha256(b"").hexdigest()


def _packed(code: np.ndarray) -> np.ndarray:
    """Four 16-bit word codes from each position on."""
    c = np.concatenate([code, np.zeros(DEPTH, U)])
    n = len(code) + DEPTH - 3
    return (c[:n] << U(48)) | (c[1 : n + 1] << U(32)) | (c[2 : n + 2] << U(16)) | c[3 : n + 3]


def _codes(h: np.ndarray) -> np.ndarray:
    return np.maximum(h >> U(48), U(1))


@dataclass
class SuffixArray:
    """``at``: positions in ``keys``, in the order of the suffixes that start there; ``word``: the word of a position."""

    keys: np.ndarray
    at: np.ndarray
    word: np.ndarray

    @staticmethod
    def build(h: np.ndarray, ptr: np.ndarray) -> SuffixArray:
        n, docs = len(h), len(ptr) - 1
        doc = np.repeat(np.arange(docs), np.diff(ptr))
        place = np.arange(n) + doc * DEPTH  # DEPTH zeros after each text
        code = np.zeros(n + docs * DEPTH + 1, U)
        code[place] = _codes(h)
        keys = _packed(code)
        first = keys[place]
        order = np.argsort(first)
        first, at = first[order], place[order]
        tie = np.zeros(n, bool)
        if n:
            eq = first[1:] == first[:-1]
            tie[1:] = eq
            tie[:-1] |= eq
        idx = np.flatnonzero(tie)
        if len(idx):
            part = at[idx]
            deeper = [keys[part + j] for j in range(DEPTH - 4, 0, -4)]
            at[idx] = part[np.lexsort([*deeper, first[idx]])]
        word = np.zeros(len(code), np.int64)
        word[place] = np.arange(n)
        return SuffixArray(keys, at, word)

    def _bisect(self, target: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) >> 1
            less, equal = np.zeros(len(todo), bool), np.ones(len(todo), bool)
            for j, t in enumerate(target):
                k = self.keys[self.at[mid] + 4 * j]
                less |= equal & (k < t[todo])
                equal &= k == t[todo]
            if after:
                less |= equal
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
        return lo

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (rows of ``DEPTH`` / 4 keys), the range of suffixes between its lowest and its highest key."""
        first = self.keys[self.at]
        lo, hi = np.searchsorted(first, low[:, 0], "left"), np.searchsorted(first, high[:, 0], "right")
        some = np.flatnonzero(lo < hi)
        cols = range(low.shape[1])
        begin = self._bisect([low[some, j] for j in cols], lo[some], hi[some], False)
        end = self._bisect([high[some, j] for j in cols], begin, hi[some], True)
        lo[some], hi[some] = begin, end
        return lo, np.maximum(lo, hi)


class TestSuffixes:
    """The windows of a block of benchmark items: the distinct ones as search keys and word hashes, and where in the items each stands."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: list[str]):
        buf, offs = flat_text(pa.array(texts, pa.large_string()))
        starts, ends, ptr = bounds(buf, offs, ALNUM)
        h = hashes(buf, starts, ends)
        n = np.diff(ptr)
        size = np.minimum(n, WINDOW)
        count = np.where(n > 0, n - size + 1, 0)
        self.ids = ids
        self.item = np.repeat(np.arange(len(ids)), count)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count)
        at = ptr[:-1][self.item] + self.place
        padded = np.concatenate([h, np.zeros(DEPTH, U)])
        grid = padded[at[:, None] + np.arange(DEPTH)[None, :]]
        out = np.arange(DEPTH)[None, :] >= size[self.item][:, None]
        words = np.where(out, U(0), grid)[:, :WINDOW]
        rows = np.concatenate([words, size[self.item][:, None].astype(U)], 1)
        _, first, self.same = np.unique(np.ascontiguousarray(rows).view(f"V{8 * (WINDOW + 1)}").ravel(), return_index=True, return_inverse=True) if len(rows) else (0, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.size, self.hashes = size[self.item][first], words[first]
        # the windows of a kind, together
        self.of = np.argsort(self.same, kind="stable")
        self.begin = np.searchsorted(self.same[self.of], np.arange(len(first) + 1))
        code = _codes(grid[first])
        out = out[first]
        pack = lambda c: np.stack([(c[:, j] << U(48)) | (c[:, j + 1] << U(32)) | (c[:, j + 2] << U(16)) | c[:, j + 3] for j in range(0, DEPTH, 4)], 1)
        self.low, self.high = pack(np.where(out, U(0), code)), pack(np.where(out, U(0xFFFF), code))

    def matches(self, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind of window, word) of every occurrence in a shard, verified on whole hashes; at most one of each size at a word."""
        if not len(h) or not len(self.item):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sa = SuffixArray.build(h, ptr)
        lo, hi = sa.find(self.low, self.high)
        n = hi - lo
        q = np.repeat(np.arange(len(n)), n)
        pos = sa.word[sa.at[np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]]
        padded = np.concatenate([h, np.zeros(WINDOW, U)])
        good = np.ones(len(q), bool)
        for j in range(WINDOW):
            good &= (padded[pos + j] == self.hashes[q, j]) | (j >= self.size[q])
        ends = ptr[np.searchsorted(ptr, pos, "right")]
        good &= pos + self.size[q] <= ends
        return q[good], pos[good]

    def longest(self, q: np.ndarray, pos: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """(text, item, first word in the item, first word in the text, words) of the longest verbatim matches: those that no word more on either side extends.

        Matches of windows are followed along their diagonals: one begins where the window before, in item and text, does not match, and ends
        where the next does not.  Windows and places are paired a slice at a time, so a text that repeats itself takes time but no memory.
        """
        kind = np.full(int(ptr[-1]) + 2, -1, np.int64)  # the window of full size at a word, if any
        full = self.size[q] == WINDOW
        kind[pos[full] + 1] = q[full]
        n = (self.begin[1:] - self.begin[:-1])[q]
        edge = np.concatenate([[0], np.cumsum(n)])
        found: tuple[list, list] = ([], [])
        lo = 0
        while lo < len(q):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + PAIRS, "right")) - 1)
            m = n[lo:hi]
            p = np.repeat(pos[lo:hi], m)
            w = self.of[np.repeat(self.begin[q[lo:hi]], m) + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)]
            whole = self.size[self.same[w]] < WINDOW
            text = np.searchsorted(ptr, p, "right") - 1
            before = ~whole & (self.place[w] > 0) & (p > ptr[text]) & (self.same[w - 1] == kind[p])
            last = len(self.item) - 1
            after = ~whole & (w < last) & (self.item[np.minimum(w + 1, last)] == self.item[w]) & (self.same[np.minimum(w + 1, last)] == kind[p + 2]) & (p + 1 < ptr[text + 1])
            for side, keep in zip(found, (~before, ~after)):
                side.append(np.stack([text, self.item[w], p - self.place[w], p, self.place[w], self.size[self.same[w]]], 1)[keep])
            lo = hi
        if not found[0]:
            return np.zeros((0, 5), np.int64)
        begins, ends = (np.concatenate(x) for x in found)
        begins, ends = (x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))] for x in (begins, ends))
        return np.stack([begins[:, 0], begins[:, 1], begins[:, 4], begins[:, 3] - ptr[begins[:, 0]], ends[:, 3] + ends[:, 5] - begins[:, 3]], 1)


_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
_MATCHES = "array<struct<item_id:string,item_start:long,start:long,length:long>>"
_STATE = f"doc_id long, text string, hit binary, matches {_MATCHES}"
_OUT = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>, matches {_MATCHES}"


def _search(block, last: bool):
    def run(batches):
        tests = block.value
        for batch in batches:
            lo = 0
            for ids, buf, offs in text_chunks(iter([batch])):
                n = len(ids)
                part = batch.slice(lo, n)
                lo += n
                starts, ends, ptr = bounds(buf, offs, ALNUM)
                h = hashes(buf, starts, ends)
                q, pos = tests.matches(h, ptr)
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, pos, 1)
                np.add.at(edge, pos + tests.size[q], -1)
                hit = np.cumsum(edge)[:-1] > 0
                matches: list[list[dict]] = [[] for _ in range(n)]
                for d, i, a, b, k in tests.longest(q, pos, ptr).tolist():
                    matches[d].append({"item_id": tests.ids[i], "item_start": a, "start": b, "length": k})
                if "hit" in batch.schema.names:
                    for d, (bits, more) in enumerate(zip(part.column("hit").to_pylist(), part.column("matches").to_pylist())):
                        if more:
                            matches[d] = more + matches[d]
                            hit[ptr[d] : ptr[d + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(ptr[d + 1] - ptr[d])).astype(bool)
                if not last:
                    bits = [np.packbits(hit[ptr[d] : ptr[d + 1]]).tobytes() if matches[d] else None for d in range(n)]
                    yield pa.RecordBatch.from_arrays([ids, part.column(1), pa.array(bits, pa.binary()), pa.array(matches, _MATCH)], ["doc_id", "text", "hit", "matches"])
                    continue
                n_hit = np.concatenate([[0], np.cumsum(hit)])
                n_hit = n_hit[ptr[1:]] - n_hit[ptr[:-1]]
                items = [sorted({m["item_id"] for m in x if m["item_id"] is not None}) for x in matches]
                sha = [hashlib.sha256(",".join(i).encode()).hexdigest() if i else _NONE for i in items]
                spans = [[] for _ in range(n)]
                for d in np.flatnonzero(n_hit).tolist():
                    x = np.diff(np.concatenate([[0], hit[ptr[d] : ptr[d + 1]].astype(np.int8), [0]]))
                    spans[d] = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist())]
                cols = [ids, pa.array(np.diff(ptr).astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(i) for i in items], pa.int64()), pa.array(sha), pa.array(n_hit > 0)]
                cols += [pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(matches, _MATCH)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "matches"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (of words, end exclusive), matches.

    matches are the longest verbatim matches with an item, (item_id, item_start, start, length) in words: those of a window or more that no further word extends.
    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z folded; a window is 10 consecutive words of an item, or
    all words of a shorter one.  A word inside an occurrence of a window is hit.  Null texts and items have no words; an
    item without words occurs nowhere; equal items are all reported; an item with a null id only marks words.
    An empty benchmark leaves every text clean.  Repeated rows and null doc_ids are kept as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    state = narrow(docs, id_col, text_col)
    for last, tests in _blocks(spark, benchmark, item_col, item_text_col):
        state = state.mapInArrow(_search(tests, last), _OUT if last else _STATE)
        if not last:
            state = stored(state)  # one Python worker a task, and one block in it, however large the benchmark
    return state


def _blocks(spark, benchmark: DataFrame, item_col: str, item_text_col: str):
    """The benchmark as broadcast search blocks of about BLOCK_BYTES; a hash deals the items out."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_BYTES
    if blocks > 1:  # in files by block, so that each block reads its own
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        items = stored(dealt.repartitionByRange(blocks, "block").sortWithinPartitions("block"))
    for k in range(blocks):
        rows = (items.where(F.col("block") == k) if blocks > 1 else items).select("item_id", "text").collect()  # about BLOCK_BYTES
        yield k == blocks - 1, spark.sparkContext.broadcast(TestSuffixes([r.item_id for r in rows], [r.text for r in rows]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with all their columns, whatever those are called.

    A null text holds none. Repeated rows stay repeated; a row with a null id is judged like any other; with an empty
    benchmark all rows stay.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(block):
        def run(batches):
            for batch in batches:
                lo = 0
                view = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["x", "text"])
                for _, buf, offs in text_chunks(iter([view])):
                    starts, ends, ptr = bounds(buf, offs, ALNUM)
                    _, pos = block.value.matches(hashes(buf, starts, ends), ptr)
                    clean = np.ones(len(offs) - 1, bool)
                    clean[np.searchsorted(ptr, pos, "right") - 1] = False
                    yield batch.slice(lo, len(clean)).filter(pa.array(clean))
                    lo += len(clean)

        return run

    for last, tests in _blocks(docs.sparkSession, benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(keep(tests), docs.schema)
        docs = docs if last else stored(docs)
    return docs
