"""Approximate nearest neighbours with a hash-prefix forest.

The vectors are dealt to shards of about ``SHARD``.  In a shard each tree gives every vector a long hash string (64 signs of random
projections from the shard's mean) and keeps the strings as one sorted array.  A query descends in every tree to its
longest-prefix match; then all trees ascend synchronously, one prefix length at a time, and the entries
under the shorter prefixes become candidates.  The ascent ends, with ``ENOUGH`` candidates or more, when
``STALE`` levels have brought no nearer neighbour; true distances rank the candidates.  Where hashes tell little, as with vectors spread evenly over many dimensions,
the ascent goes on almost to the roots; where vectors cluster, it ends early.

Every vector is indexed; equal vectors are one entry.  Queries come in blocks of at most ``QUERIES``, which are broadcast; a shard answers
with a few rows a query, never with its candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import U

#: Trees, prefix lengths at most, vectors of a shard, queries of a block.
TREES, DEEPEST, SHARD, QUERIES = 24, 24, 1 << 14, 1 << 15
#: An ascent ends after so many levels without a nearer neighbour, once there are so many candidates.
STALE, ENOUGH = 2, 256
_SEED = 20240229
_BIT = U(1) << np.arange(63, -1, -1).astype(U)
#: Bits that a prefix of each length leaves open.
_OPEN = np.array([(1 << (64 - x)) - 1 for x in range(DEEPEST + 1)], dtype=object).astype(U)


class Forest:
    """The trees of a shard's vectors of one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.mean = ids, x, x.mean(0)
        self.keys, self.order = [], []
        for t in range(TREES):
            k = self.strings(x, t)
            o = np.argsort(k, kind="stable")
            self.keys.append(k[o])
            self.order.append(o)

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        planes = np.random.default_rng([_SEED, x.shape[1], tree]).standard_normal((x.shape[1], 64))
        return (((x - self.mean) @ planes > 0) * _BIT).sum(1, dtype=U)

    def search(self, q: np.ndarray, strings: list, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, distances) of the ``k`` nearest found, nearest first, ties to smaller ids."""
        lo = np.stack([np.searchsorted(self.keys[t], s & ~_OPEN, "left") for t, s in enumerate(strings)])
        hi = np.stack([np.searchsorted(self.keys[t], s | _OPEN, "right") for t, s in enumerate(strings)])
        deepest = int(np.max(np.where(hi > lo, np.arange(DEEPEST + 1)[None, :], 0)))
        seen = np.zeros(len(self.ids), bool)
        best, dist, count = np.zeros(0, np.int64), np.zeros(0), 0
        was_lo = was_hi = None
        stale = 0
        for level in range(deepest, -1, -1):
            parts = []
            for t in range(TREES):
                a, b = lo[t, level], hi[t, level]
                if was_lo is None or was_hi[t] <= was_lo[t]:
                    parts.append(self.order[t][a:b])
                else:
                    parts += [self.order[t][a : was_lo[t]], self.order[t][was_hi[t] : b]]
            was_lo, was_hi = lo[:, level], hi[:, level]
            new = np.concatenate(parts)
            new = np.unique(new[~seen[new]])
            seen[new] = True
            count += len(new)
            if len(new):
                d = np.sqrt(((self.x[new] - q) ** 2).sum(1))
                at, every = np.concatenate([best, new]), np.concatenate([dist, d])
                if len(at) > 4 * k:
                    few = np.flatnonzero(every <= np.partition(every, k)[k])
                    at, every = at[few], every[few]
                o = np.lexsort((self.ids[at], every))[:k]
                better = not np.array_equal(at[o], best)
                best, dist = at[o], every[o]
            else:
                better = False
            stale = 0 if better else stale + 1
            if stale >= STALE and count >= ENOUGH and len(best) >= k:
                break
        # the measure itself, its terms added from first to last
        dist = np.sqrt(np.cumsum((self.x[best] - q) ** 2, axis=1)[:, -1]) if len(best) else dist
        o = np.lexsort((self.ids[best], dist))
        return best[o], dist[o]


def _by_dimension(batch, ids: int, vectors: int):
    sizes = np.asarray(batch.column(vectors).combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
    for d in np.unique(sizes).tolist():
        part = batch.take(pa.array(np.flatnonzero(sizes == d)))
        yield int(d), part.column(ids).to_numpy(), part.column(vectors).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``, by Euclidean distance in double precision.

    All rows are candidates but the query's own id; ties go to the smaller vec_id.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows with a null id.  Only vectors of one length are compared.  A query with fewer candidates gets
    all that are found. Repeated rows count as one. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).where(good)
    rows = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")).dropDuplicates(["vec_id", "k1", "k2"])
    # of equal vectors a query can return no more than its k nearest ids and itself
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = stored(few)
    reps = stored(few.where("r = 1").select(F.col("vec_id").alias("rep"), "v", "k1", "k2"))
    members = few.select("k1", "k2", "vec_id").join(reps.select("rep", "k1", "k2"), ["k1", "k2"]).select("rep", "vec_id")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2")
    asked = stored(asked.join(reps.select("rep", "k1", "k2"), ["k1", "k2"]).select("query_id", "rep"))
    queries = stored(reps.select("rep", "v").join(asked.select("rep").distinct(), "rep", "left_semi"))
    shards = max(1, -(-reps.count() // SHARD))
    blocks = max(1, -(-queries.count() // QUERIES))

    def searching(block):
        def run(batches):
            have = [b for b in batches if b.num_rows]
            if not have:
                return
            for d, ids, x in _by_dimension(pa.Table.from_batches(have), 0, 1):
                if d not in block.value:
                    continue
                forest = Forest(ids, x)
                qid, q = block.value[d]
                strings = [forest.strings(q, t) for t in range(TREES)]
                for lo in range(0, len(q), 512):
                    out = [[], [], []]
                    for i in range(lo, min(lo + 512, len(q))):
                        at, dist = forest.search(q[i], [s[i] for s in strings], k + 1)
                        out[0].append(np.full(len(at), qid[i]))
                        out[1].append(ids[at])
                        out[2].append(dist)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["qrep", "rep", "score"])

        return run

    near = None
    for b in range(blocks):
        rows_ = queries.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == b).toArrow()  # about QUERIES rows
        sent = spark.sparkContext.broadcast({d: (i, x.copy()) for d, i, x in _by_dimension(rows_, 0, 1)})
        part = reps.select("rep", "v").repartition(shards).mapInArrow(searching(sent), "qrep long, rep long, score double")
        part = part.withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy("score", "rep"))).where(F.col("r") <= k + 1).drop("r")
        near = part if near is None else near.unionByName(part)
    near = near.join(members, "rep").withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).select("qrep", "vec_id", "score")
    out = asked.join(near, asked.rep == near.qrep).where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
