"""Removal of repeated passages: every byte under a ``LENGTH``-byte string that also starts in a document with a smaller id.

A distributed merge sort of suffixes that knows their common prefixes:

1. Texts go into blocks of about ``BLOCK`` bytes, written once, bucketed by block, and never shuffled afterwards. Whole copies of a
   text with a smaller id are found by 128-bit hashes and take no further part.
2. Of the LENGTH-byte strings that share the same leftmost smallest GRAM-byte part (their anchor), only the suffix from the anchor on is sorted, with
   the bytes before the anchor beside it: one suffix stands for up to 31.  Equal strings have equal anchors at equal places.  Each block first sends
   the hashes of its anchors; those that no other document has are left out.
3. Each block sorts its suffixes and sends them as front-coded runs (the bytes shared with the one before are left out), one a key range; ranges are
   cut from mixed hashes of the anchors, so they are even.  A loser tree merges the runs of a range: it knows how many bytes each run's head shares with the last
   suffix that left the tree, and compares only what lies beyond.
4. The common prefixes of neighbours in merged order, and likewise those of the bytes before the anchors, say exactly which strings are equal;
   nothing rests on fingerprints of strings.  Each suffix gets a bit for each string that a smaller document has too; its block paints them.

A suffix stands once in a run however often its block holds it, so a passage that a third of all documents share is as many
rows as there are blocks.  An anchor that stands in more than ``HOT`` different surroundings is dealt out by whole strings instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, flat_text, narrow, release, shared_dir, stored
from .words import _BACK, _POWER, _VALUE_AS_IS, U, mix

LENGTH, GRAM = 50, 20
#: Bytes before an anchor, at most.
BEFORE = LENGTH - GRAM
#: Bytes of text in a block, bytes that a pass looks at together, anchors and suffixes that one task merges.
BLOCK, PIECE, MERGED, SORTED = 4 << 20, 1 << 17, 3 << 19, 1 << 17
#: Surroundings of an anchor from which on its strings are dealt out one by one.
HOT = 1 << 15
#: Bytes of input for each bucket of the block table, by the size that the planner expects.
BUCKET = 64 << 20
_LAST = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def front_coded(keys: np.ndarray) -> bytes:
    """A sorted run of 64-bit keys: each without what it shares with its predecessor, bytes in planes."""
    d = np.diff(keys, prepend=U(0))
    planes = d.view(np.uint8).reshape(-1, 8).T
    top = next((j for j in range(7, 0, -1) if planes[j].any()), 0) if len(d) else 0
    # the low planes are random bits; only the high ones are worth compressing
    cut = max(0, top - 2)
    high = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[cut : top + 1]).tobytes())
    return len(d).to_bytes(4, "little") + bytes([cut, top]) + len(high).to_bytes(4, "little") + high + np.ascontiguousarray(planes[:cut]).tobytes()


def decoded(b: bytes) -> np.ndarray:
    n, cut, top, size = int.from_bytes(b[:4], "little"), b[4], b[5], int.from_bytes(b[6:10], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[cut : top + 1] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[10 : 10 + size]), np.uint8).reshape(top + 1 - cut, n)
    planes[:cut] = np.frombuffer(b[10 + size :], np.uint8).reshape(cut, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(U), dtype=U)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    have: list[tuple] = []
    size = 0

    def out(k: int):
        ids = np.concatenate([h[0] for h in have])
        null = np.concatenate([h[1] for h in have])
        sizes = np.concatenate([h[2] for h in have])
        data = np.concatenate([h[3] for h in have])
        offs = np.concatenate([[0], np.cumsum(sizes)])
        raw = data.tobytes()
        keys = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        two = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ids, two[:, 0], two[:, 1], sizes)]
        return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), *lists, pa.array([np.packbits(null).tobytes()], pa.binary()), pa.array([zstandard.ZstdCompressor(level=3).compress(raw)], pa.binary())], ["block", "ids", "k1", "k2", "sizes", "no_id", "data"])

    k = 0
    for batch in batches:
        buf, offs = flat_text(batch.column(1))
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(_LAST).to_numpy()
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK - size, "right")) - 1))
            have.append((ids[lo:hi], null[lo:hi], np.diff(offs[lo : hi + 1]), buf[offs[lo] : offs[hi]].copy()))
            size += int(offs[hi] - offs[lo])
            lo = hi
            if size >= BLOCK or (lo < n and size + offs[lo + 1] - offs[lo] > BLOCK):
                yield out(k)
                have, size, k = [], 0, k + 1
    if have:
        yield out(k)


class Block:
    """The texts of a row of the block table; ``skip`` marks whole copies."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.array(row["ids"], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(self.offs[-1]))
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(self.ids)).astype(bool)
        self.skip = np.zeros(len(self.ids), bool)
        self.skip[row.get("copies") or []] = True

    def _pieces(self):
        """(key, text, anchor, first start, last start, hash) of the runs of strings with one anchor; starts and anchors are places in ``buf``."""
        room = np.where(self.skip, 0, np.maximum(0, self.sizes - LENGTH + 1))  # strings of each text
        n = len(self.buf)
        low = U((1 << 20) - 1)
        for lo in range(0, n, PIECE):
            hi = min(n, lo + PIECE)
            seg = self.buf[lo : min(n, hi + LENGTH - 1)]
            first = int(np.searchsorted(self.offs, lo, "right")) - 1
            last = int(np.searchsorted(self.offs, hi, "left"))
            a = np.maximum(self.offs[first:last], lo)
            count = np.maximum(0, np.minimum(self.offs[first:last] + room[first:last], hi) - a)
            if not count.any():
                continue
            run = np.zeros(len(seg) + 1, U)
            np.cumsum(_VALUE_AS_IS[seg] * _POWER[: len(seg)], out=run[1:])
            m = mix((run[GRAM:] - run[:-GRAM]) * _BACK[: len(seg) - GRAM + 1])
            # the least hash, and of equal ones the leftmost
            m = (m & ~low) | np.arange(len(m), dtype=U)
            have, width = 1, BEFORE + 1
            while have < width:
                step = min(have, width - have)
                m = np.minimum(m[:-step], m[step:])
                have += step
            doc = np.repeat(np.arange(first, last, dtype=np.int32), count)
            at = np.repeat(a - lo - np.cumsum(count) + count, count) + np.arange(len(doc))
            best = m[at]
            new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
            end = np.concatenate([new[1:], [len(doc)]]) - 1
            key, start, stop = best[new] >> U(20), at[new], at[end]
            around = mix((run[stop + LENGTH] - run[start]) * _BACK[start]) ^ (stop - start).astype(U)
            yield key, doc[new], (best[new] & low).astype(np.int64) + lo, start + lo, stop + lo, around

    def anchored(self):
        """The runs of strings with one anchor, of the whole block; keys are mixed, so that they are spread evenly."""
        got = list(self._pieces())
        if not got:
            return [np.zeros(0, k) for k in (U, np.int32, np.int64, np.int64, np.int64, U)]
        key, *rest = (np.concatenate(x) for x in zip(*got))
        return [mix(key) >> U(20), *rest]

    def anchors(self):
        """Distinct keys in order, which of them two documents of the block share, and in how many surroundings each stands."""
        key, doc, _, _, _, around = self.anchored()
        if not len(key):
            return np.zeros(0, U), np.zeros(0, bool), np.zeros(0, np.int64)
        o = np.lexsort((around, key))
        key, ids, around = key[o], self.ids[doc[o]], around[o]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        other = np.concatenate([[True], (key[1:] != key[:-1]) | (around[1:] != around[:-1])])
        return key[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), np.add.reduceat(other.astype(np.int64), first)

    def suffixes(self, partner: np.ndarray, hot: np.ndarray, buckets: int) -> tuple:
        """Suffixes whose anchor has a partner: (rows in order, distinct rows, group of each, least id of each group, text, anchor).

        A row is the key range (4 bytes), LENGTH bytes from the anchor on, BEFORE bytes before it, nearest first, and the least and greatest distance of a start
        from the anchor.  Bytes that no string needs are zero.
        """
        keys, own, _ = self.anchors()
        key, doc, at, start, stop, _ = self.anchored()
        i = np.searchsorted(keys, key)
        some = np.flatnonzero((own | partner)[i]) if len(keys) else np.zeros(0, np.int64)
        key, doc, at, start, stop = key[some], doc[some], at[some], start[some], stop[some]
        split = hot[i[some]] if len(keys) else np.zeros(0, bool)
        if split.any():
            k = np.flatnonzero(split)
            n = (stop - start + 1)[k]
            each = np.repeat(start[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            strings = np.lib.stride_tricks.sliding_window_view(self.buf, LENGTH)[each]
            whole = mix((_VALUE_AS_IS[strings] * _POWER[:LENGTH]).sum(1, dtype=U)) >> U(20)
            rest = np.flatnonzero(~split)
            k = np.repeat(k, n)
            key, doc, at = (np.concatenate([x[rest], y]) for x, y in ((key, whole), (doc, doc[k]), (at, at[k])))
            start, stop = np.concatenate([start[rest], each]), np.concatenate([stop[rest], each])
        if not len(key):
            return np.zeros((0, _WIDTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), doc, at
        near, far = at - stop, at - start
        rows = np.zeros((len(key), _WIDTH), np.uint8)
        rows[:, :4] = (key * U(buckets) >> U(44)).astype(">u4").view(np.uint8).reshape(-1, 4)
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), self.buf, np.zeros(LENGTH, np.uint8)])
        right = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[at + BEFORE]
        rows[:, 4 : 4 + LENGTH] = np.where(np.arange(LENGTH)[None, :] < (LENGTH - near)[:, None], right, 0)
        left = np.lib.stride_tricks.sliding_window_view(padded, BEFORE)[at][:, ::-1]
        rows[:, 4 + LENGTH : -2] = np.where(np.arange(BEFORE)[None, :] < far[:, None], left, 0)
        rows[:, -2], rows[:, -1] = near, far
        text = rows.view(f"S{_WIDTH}").ravel()
        o = np.argsort(text, kind="stable")
        rows, text, doc, at = rows[o], text[o], doc[o], at[o]
        new = np.concatenate([[True], text[1:] != text[:-1]])
        first = np.flatnonzero(new)
        return rows, first, np.cumsum(new) - 1, np.minimum.reduceat(self.ids[doc], first), doc, at


_WIDTH = 4 + LENGTH + BEFORE + 2
_KEYS = "bucket int, block long, keys binary, counts binary"
_ANCHORS = "block long, bucket int, n long, partners long, rows long, partner binary, hot binary"
_RUN = "bucket int, block long, run binary"
_BITS = "block long, bucket int, bits binary"


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of 44-bit keys begins in a sorted run (one more at the end)."""
    return np.searchsorted((keys * U(buckets) >> U(44)).astype(np.int64), np.arange(buckets + 1))


def _flags(parts, name: str) -> np.ndarray:
    got = [np.unpackbits(np.frombuffer(p[name], np.uint8), count=p["n"]) for p in sorted(parts or [], key=lambda p: p["bucket"])]
    return np.concatenate([np.zeros(0, np.uint8), *got]).astype(bool)


def _merged_anchors(key, table):
    """For each run of a key range, which anchors another block has, and which stand in more than HOT surroundings."""
    blocks = table.column("block").to_pylist()
    runs = [decoded(x.as_py()) for x in table.column("keys")]
    counts = np.concatenate([_unpack(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64)
    sizes = [len(r) for r in runs]
    keys = np.concatenate(runs)
    runs.clear()
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.concatenate([first, [len(s)]]))
    partner, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    partner[order] = np.repeat(count > 1, count)
    hot[order] = np.repeat(np.add.reduceat(counts[order], first) > HOT, count)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    cut = lambda x: [x[a:b] for a, b in zip(edge[:-1], edge[1:])]
    bits = lambda x: pa.array([np.packbits(p).tobytes() for p in cut(x)], pa.binary())
    n = [pa.array(sizes, pa.int64()), pa.array([int(p.sum()) for p in cut(partner)], pa.int64()), pa.array([int(c[p].sum()) for c, p in zip(cut(counts), cut(partner))], pa.int64())]
    return pa.table([pa.array(blocks, pa.int64()), pa.array([key[0].as_py()] * len(blocks), pa.int32()), *n, bits(partner), bits(hot)], names=["block", "bucket", "n", "partners", "rows", "partner", "hot"])


def _shared_with_last(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before; of the first row none."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return out


def run_coded(right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> bytes:
    """A sorted run of suffixes, each without the bytes that it shares with the one before it."""
    shared = _shared_with_last(right)
    place = np.arange(LENGTH)[None, :]
    tails = right[(place >= shared[:, None]) & (place < (LENGTH - near)[:, None])]
    heads = left[np.arange(BEFORE)[None, :] < far[:, None]]
    parts = [shared.astype(np.uint8), near.astype(np.uint8), far.astype(np.uint8), ids, tails, heads]
    return len(shared).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def run_decoded(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(right, left, near, far, ids, shared) of a run."""
    n, raw = int.from_bytes(b[:4], "little"), zstandard.ZstdDecompressor().decompress(b[4:])
    shared, near, far = (np.frombuffer(raw, np.uint8, n, k * n).astype(np.int64) for k in range(3))
    ids = np.frombuffer(raw, np.int64, n, 3 * n)
    place = np.arange(LENGTH)[None, :]
    own = (place >= shared[:, None]) & (place < (LENGTH - near)[:, None])
    size = int(own.sum())
    right = np.zeros((n, LENGTH), np.uint8)
    right[own] = np.frombuffer(raw, np.uint8, size, 11 * n)
    # a byte that is left out is that of the last row which has it
    last = np.maximum.accumulate(np.where(place >= shared[:, None], np.arange(n)[:, None], 0), 0)
    right = np.take_along_axis(right, last, 0)
    left = np.zeros((n, BEFORE), np.uint8)
    left[np.arange(BEFORE)[None, :] < far[:, None]] = np.frombuffer(raw, np.uint8, -1, 11 * n + size)
    return right, left, near, far, ids, shared


def loser_tree(data: bytes, width: int, edges: list[int], shared: list[int]) -> tuple[list[int], list[int]]:
    """Merges sorted runs of ``width``-byte strings: (strings in order, bytes that each shares with the one before).

    Run k holds the strings edges[k] to edges[k + 1] - 1 of ``data``; shared[i] says what string i shares with its predecessor in its run.
    Every head of a run carries what it shares with the last string that left the tree.  Of two heads the one that
    shares more is the smaller; only those that share equally much are compared, from there on, and the loser then shares with the winner as much as they agree.
    """
    runs = len(edges) - 1
    size = 1 << max(0, runs - 1).bit_length()
    head, stop = [*edges[:-1], *[0] * (size - runs)], [*edges[1:], *[0] * (size - runs)]
    number = int.from_bytes

    def beats(a: int, b: int, known: int) -> tuple[bool, int]:
        """Whether the head of run a is not greater than that of run b, and what they share."""
        x, y = data[head[a] * width + known : (head[a] + 1) * width], data[head[b] * width + known : (head[b] + 1) * width]
        if x == y:
            return True, width
        return x < y, width - ((number(x, "big") ^ number(y, "big")).bit_length() + 7) // 8

    loser, knows = [0] * size, [-1] * size
    # the first round: the heads share nothing yet; an empty run (-1) loses to all
    level = [(k, 0 if head[k] < stop[k] else -1) for k in range(size)]
    node = size >> 1
    while len(level) > 1:
        above = []
        for j in range(0, len(level), 2):
            (a, ha), (b, hb) = level[j], level[j + 1]
            if ha == hb == 0:
                first, common = beats(a, b, 0)
                (a, ha), (b, hb) = ((a, 0), (b, common)) if first else ((b, 0), (a, common))
            elif hb > ha:
                (a, ha), (b, hb) = (b, hb), (a, ha)
            loser[node + j // 2], knows[node + j // 2] = b, hb
            above.append((a, ha))
        level, node = above, node >> 1
    w, h = level[0]
    order, common = [], []
    while h >= 0:
        i = head[w]
        order.append(i)
        common.append(h)
        head[w] = i = i + 1
        h = shared[i] if i < stop[w] else -1
        node = (w + size) >> 1
        while node:
            k = knows[node]
            if k > h:
                other = loser[node]
                loser[node], knows[node] = w, h
                w, h = other, k
            elif k == h and h >= 0:
                other = loser[node]
                first, same = beats(w, other, h)
                knows[node] = same
                if not first:
                    loser[node] = w
                    w = other
            node >>= 1
    return order, common


def _held_before(right_common: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of suffixes in merged order, a bit j for the string that starts j bytes before the anchor, if a smaller id has it too."""
    out = np.zeros(len(ids), np.uint32)
    text = np.ascontiguousarray(left).view(f"S{BEFORE}").ravel()
    by_left = np.argsort(text, kind="stable")
    left_common = _shared_with_last(left[by_left])
    # equal suffixes with equal surroundings are one: all but those of its smallest id are held before
    kind = np.empty(len(ids), np.int64)
    kind[by_left] = np.cumsum(left_common < BEFORE)
    whole = np.stack([np.cumsum(right_common < LENGTH), kind, near, far], 1)
    order = np.lexsort((ids, whole[:, 3], whole[:, 2], whole[:, 1], whole[:, 0]))
    new = np.concatenate([[True], (whole[order][1:] != whole[order][:-1]).any(1)])
    rep = order[new]
    least = np.repeat(ids[rep], np.diff(np.concatenate([np.flatnonzero(new), [len(order)]])))
    out[order[ids[order] > least]] = U(0xFFFFFFFF)
    # anchors with one kind of surroundings need no more
    gram = np.cumsum(right_common < GRAM)[rep]
    rep = rep[np.bincount(gram)[gram] > 1]
    bits, least = np.zeros(len(ids), np.uint32), ids[rep]
    for j in range(BEFORE + 1):
        k = np.flatnonzero((near[rep] <= j) & (j <= far[rep]))
        if len(k) < 2:
            continue
        side = np.empty(len(ids), np.int64)
        side[by_left] = np.cumsum(left_common < j) if j else 0
        at = rep[k]
        same = np.cumsum(right_common < LENGTH - j)[at] * (len(ids) + 1) + side[at]
        o = np.argsort(same, kind="stable")
        s = same[o]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(least[k][o], first), np.diff(np.concatenate([first, [len(s)]])))
        hit = o[least[k][o] > smallest]
        bits[at[hit]] |= np.uint32(1 << j)
    # what holds for the smallest id of a kind holds for the others as well, which have all bits
    return out | bits


def _merge(key, table):
    """Merges the front-coded runs of a key range, and tells each run's suffixes which of their strings a smaller id has."""
    release()
    blocks = table.column("block").to_pylist()
    parts = [run_decoded(x.as_py()) for x in table.column("run")]
    edges = np.concatenate([[0], np.cumsum([len(p[4]) for p in parts])]).tolist()
    right, left, near, far, ids, shared = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order, common = loser_tree(right.tobytes(), LENGTH, edges, shared.tolist())
    order, common = np.array(order, np.int64), np.array(common, np.int64)
    bits = np.zeros(len(ids), np.uint32)
    bits[order] = _held_before(common, left[order], near[order], far[order], ids[order])
    out = [_pack(bits[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table([pa.array(blocks, pa.int64()), pa.array([key[0].as_py()] * len(blocks), pa.int32()), pa.array(out, pa.binary())], names=["block", "bucket", "bits"])


def _bucketed(blocks: DataFrame, buckets: int) -> tuple[str, str]:
    """(table, path): the block table in the shared folder, bucketed by block, so that joins on block leave the texts where they are."""
    name = f"siltstone_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(blocks.sparkSession).rstrip('/')}/{name}"
    blocks.write.option("path", path).option("compression", "none").format("parquet").bucketBy(buckets, "block").saveAsTable(name)
    return name, path


def _drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of removed bytes), and kept (binary) if asked for.

    A byte is removed if a string of 50 bytes over it also starts in a document with a smaller id; matches never cross documents and are
    judged on the input.  Null texts are empty.  A null id counts as larger than all ids; rows that share an id do not remove one
    another's bytes. Texts under 50 bytes stay whole. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = narrow(docs, id_col, text_col)
    expected = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(1 << 16, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), expected // BUCKET if expected < 1 << 60 else 0))
    name, path = _bucketed(docs.mapInArrow(_blocks, "block long, ids array<long>, k1 array<long>, k2 array<long>, sizes array<long>, no_id binary, data binary"), parts)
    try:
        return _found(spark.table(name), kept_bytes)
    finally:
        _drop(spark, name, path)


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]
        release()


def _found(table: DataFrame, kept_bytes: bool) -> DataFrame:
    one = table.select("block", F.posexplode(F.arrays_zip("ids", "k1", "k2")).alias("i", "x")).select("block", "i", "x.ids", "x.k1", "x.k2")
    least = one.groupBy("k1", "k2").agg(F.min("ids").alias("least"), F.max("ids").alias("most")).where("least < most")
    copies = stored(one.join(least, ["k1", "k2"]).where("ids > least").groupBy("block").agg(F.collect_list("i").alias("copies")))  # indexes of one block
    total = table.select(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0

    def with_(*more: DataFrame) -> DataFrame:
        out = table
        for m in more:
            out = out.join(m, "block", "left")
        return out

    n1 = 1 + total // (16 * MERGED)

    def first(batches):
        for row in _rows(batches):
            x = Block(row)
            keys, _, counts = x.anchors()
            at = _cut(keys, n1)
            some = np.flatnonzero(np.diff(at))
            cols = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), x.block, np.int64)), pa.array([front_coded(keys[at[k] : at[k + 1]]) for k in some], pa.binary()), pa.array([_pack(counts[at[k] : at[k + 1]].astype(np.uint32)) for k in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "keys", "counts"])

    shared = with_(copies).select("block", "ids", "sizes", "no_id", "data", "copies").mapInArrow(first, _KEYS).groupBy("bucket").applyInArrow(_merged_anchors, _ANCHORS)
    # a block has as many rows here as there are key ranges, a few bytes each
    shared = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "partner", "hot")).alias("anchors"), F.sum("rows").alias("rows"))
    shared = stored(shared)
    n2 = 1 + (shared.agg(F.sum("rows")).first()[0] or 0) // SORTED
    known = shared.select("block", "anchors")

    def second(batches):
        for row in _rows(batches):
            x = Block(row)
            rows, new, _, least, _, _ = x.suffixes(_flags(row["anchors"], "partner"), _flags(row["anchors"], "hot"), n2)
            rows = rows[new]
            bucket = np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64)
            at = np.searchsorted(bucket, np.arange(n2 + 1))
            some = np.flatnonzero(np.diff(at))
            right, left, near, far = rows[:, 4 : 4 + LENGTH], rows[:, 4 + LENGTH : -2], rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
            runs = [run_coded(*(c[at[k] : at[k + 1]] for c in (right, left, near, far, least))) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), x.block, np.int64)), pa.array(runs, pa.binary())], ["bucket", "block", "run"])

    smaller = with_(copies, known).select("block", "ids", "sizes", "no_id", "data", "copies", "anchors").mapInArrow(second, _RUN).groupBy("bucket").applyInArrow(_merge, _BITS)
    smaller = stored(smaller.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("suffixes")))

    def paint(batches):
        for row in _rows(batches):
            x = Block(row)
            rows, _, group, least, doc, at = x.suffixes(_flags(row["anchors"], "partner"), _flags(row["anchors"], "hot"), n2)
            edge = np.zeros(len(x.buf) + 1, np.int32)
            if len(rows):
                bits = np.concatenate([_unpack(p["bits"], np.uint32) for p in sorted(row["suffixes"], key=lambda p: p["bucket"])])
                # of equal suffixes of a block those of larger ids are held before, too
                bits = np.where(x.ids[doc] > least[group], np.uint32(0xFFFFFFFF), bits[group])
                near, far = rows[:, -2], rows[:, -1]
                for j in range(BEFORE + 1):
                    start = at[(bits >> np.uint32(j) & np.uint32(1)).astype(bool) & (near <= j) & (j <= far)] - j
                    edge[start] += 1
                    edge[start + LENGTH] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            for d in np.flatnonzero(x.skip & (x.sizes >= LENGTH)).tolist():
                gone[x.offs[d] : x.offs[d + 1]] = True
            yield _painted(x, gone, kept_bytes)

    out = with_(copies, known, smaller).select("block", "ids", "sizes", "no_id", "data", "copies", "anchors", "suffixes")
    out = stored(out.mapInArrow(paint, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"))
    return out if kept_bytes else out.drop("kept")


def _painted(x: Block, gone: np.ndarray, kept_bytes: bool) -> pa.RecordBatch:
    run = np.concatenate([[0], np.cumsum(gone)])
    lost = run[x.offs[1:]] - run[x.offs[:-1]]
    sha, spans, kept = [], [], []
    for d in range(len(x.ids)):
        a, b = int(x.offs[d]), int(x.offs[d + 1])
        if not lost[d]:
            raw, span = x.raw[a:b], []
        else:
            g = gone[a:b]
            c = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
            span = list(zip(np.flatnonzero(c == 1).tolist(), np.flatnonzero(c == -1).tolist()))
            raw = x.buf[a:b][~g].tobytes()
        spans.append([{"start": s, "end": e} for s, e in span])
        sha.append(hashlib.sha256(raw).hexdigest() if raw else _EMPTY)
        kept.append(raw if kept_bytes else None)
    cols = [pa.array(x.ids, mask=x.no_id), pa.array(x.sizes), pa.array(lost.astype(np.int64)), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
