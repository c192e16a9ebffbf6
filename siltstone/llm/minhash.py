"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

1. One pass over the texts: the set of word shingles of each, its size, a 128-bit fingerprint of the
   whole set, and its sketch, the k smallest hashes.
2. Texts with one and the same set are one class; only class representatives go on.
3. Inverted lists of the smallest retained values generate overlaps.  Two sets that are linked share
   several of them but for a chance of ``MISS``, so as in prefix filtering each class enters only the lists of its
   rarest values: a value that a third of the corpus holds hardly makes a list.
4. Short lists give pairs; the union of two sketches estimates their similarity, the
   whole sets confirm it.
5. A long list (a large group of near copies) has its most central class as pivot.  Members are
   compared with the pivot; the rest is compared block against block, where the distances from the
   pivot (Jaccard distance is a metric) leave out blocks that cannot hold a link.  A block pair
   returns a spanning forest of its links, not all pairs.
6. Connected components of the links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, narrow, release, stored, text_chunks
from .components import components
from .membership import build, maybe
from .words import NOT_SPACE, U, bounds, doc_sets, hashes, mix

#: Values kept of each set, and of those the ones that inverted lists are made of.
SKETCH, LISTED = 64, 16
#: Chance with which two sets exactly at the threshold may share too few listed values, or be estimated too low.
MISS = 1e-6
#: Members of a list up to which it gives its pairs; longer lists go block by block. Members and shingles of a block.
SHORT_LIST, BLOCK, BLOCK_VALUES = 24, 512, 1 << 18


def _tail(n: int, p: float) -> int:
    """The largest s with P(Binomial(n, p) < s) <= MISS, at least 1."""
    total, s = 0.0, 0
    while True:
        total += math.comb(n, s) * p**s * (1 - p) ** (n - s)
        if total > MISS:
            return max(1, s)
        s += 1


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, fp_hi, fp_lo, sketch) of each text."""

    def run(batches):
        for ids, buf, offs in text_chunks(batches):
            starts, ends, ptr = bounds(buf, offs, NOT_SPACE)
            sets = doc_sets(hashes(buf, starts, ends), ptr, width)
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([*sets, np.zeros(0, U)]).astype(U)
            ptr = np.concatenate([[0], np.cumsum(sizes)])
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                acc = np.zeros(len(flat) + 1, U)
                np.cumsum(mix(flat ^ U(salt)), out=acc[1:])
                sums.append((acc[ptr[1:]] - acc[ptr[:-1]]).view(np.int64))
            sketch = pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), sketch], ["doc_id", "n_shingles", "fp_hi", "fp_lo", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp_hi long, fp_lo long, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the texts in ``ids``: read again, and filtered before any shuffle by a membership filter."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(build(ids))

    def run(batches):
        filt = known.value
        for b in batches:
            x = np.asarray(b.column(0).fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
            hit = maybe(filt, x)
            hit &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
            part = b.filter(pa.array(hit))
            del b
            for got, buf, offs in text_chunks(iter([part])):
                starts, ends, ptr = bounds(buf, offs, NOT_SPACE)
                sets = doc_sets(hashes(buf, starts, ends), ptr, width)
                yield pa.RecordBatch.from_arrays([got, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _enough(inter, union, percent: int):
    return inter * 100 >= union * percent


def _common(a: str, b: str):
    return F.size(F.array_intersect(a, b)).cast("long")


def _block_links(percent: int):
    """Links between two blocks of a group, as a spanning forest; all sets are compared, by one matrix product."""

    def run(key, table):
        release()
        seen: set = set()
        sides: tuple[list, list] = ([], [])
        for b in table.to_batches():
            for i, (side, member) in enumerate(zip(b.column("side").to_pylist(), b.column("member").to_pylist())):
                if (side, member) not in seen:
                    seen.add((side, member))
                    sides[side].append((member, b.column("shingles")[i].values.to_numpy(zero_copy_only=False)))
        left, right = sides[0], sides[0] if table.column("same")[0].as_py() else sides[1]
        if not left or not right:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        flat = [x for _, x in left], [x for _, x in right]
        sizes = [np.array([len(x) for x in f]) for f in flat]
        vals = [np.concatenate(f) for f in flat]
        rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
        both = np.intersect1d(vals[0], vals[1])
        inter = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
        at = []
        for v, r in zip(vals, rows):
            i = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
            keep = both[i] == v if len(both) else np.zeros(len(v), bool)
            at.append((r[keep], i[keep]))
        for lo in range(0, len(both), 4096):
            m = []
            for (r, i), s in zip(at, sizes):
                x = np.zeros((len(s), 4096), np.float32)
                k = (i >= lo) & (i < lo + 4096)
                x[r[k], i[k] - lo] = 1
                m.append(x)
            inter += m[0] @ m[1].T
        inter = np.rint(inter).astype(np.int64)
        union = sizes[0][:, None] + sizes[1][None, :] - inter
        i, j = np.nonzero(inter * 100 >= union * percent)
        ia, jb = np.array([m for m, _ in left])[i], np.array([m for m, _ in right])[j]
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for a, b in zip(ia.tolist(), jb.tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z folded.  Texts are linked if 100 * |A & B| >= percent * |A | B|
    of their sets of ``width``-word shingles; component_id is the smallest doc_id reachable over links.
    A text of fewer words is one shingle; a null or wordless text has none, is linked with nothing and is kept.
    Repeated rows with one id give one row each, under the component of that id. A row with a null id is linked with
    nothing: its component is null, and it is kept.  An empty table gives an empty result. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = narrow(docs, id_col, text_col)
    p = percent / 100
    sig = stored(signatures(docs, width))
    some = sig.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "fp_hi", "fp_lo"]
    classes = stored(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))

    # rarest listed values
    post = classes.select("rep", F.col("n_shingles").alias("n"), F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    often = post.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    post = post.join(often, "v")
    at_least = _tail(LISTED, p)
    small = int(LISTED * p)
    m = F.least(F.col("n"), F.lit(LISTED))
    share = F.when(F.col("n") <= small, F.ceil(F.col("n") * percent / 100)).otherwise(at_least)
    by_rep = Window.partitionBy("rep")
    post = (
        post.withColumn("shared", F.count("*").over(by_rep))
        .withColumn("central", F.sum(F.log("df")).over(by_rep))
        .withColumn("r", F.row_number().over(by_rep.orderBy("df", "v")))
        .where((F.col("shared") >= share) & (F.col("r") + (m - F.col("shared")) <= m - share + 1))
        .select("rep", "n", "v", "central")
    )
    post = stored(post)
    lists = stored(post.groupBy("v").agg(F.count("*").alias("size"), F.max(F.struct("central", (-F.col("rep")).alias("neg"))).alias("top")).where("size > 1"))

    # short lists: pairs, estimate
    short = post.join(lists.where(F.col("size") <= SHORT_LIST).select("v"), "v").select("v", "rep", "n")
    other = short.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = (
        short.withColumnsRenamed({"rep": "a", "n": "na"}).join(other, "v").where("a < b")
        .where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b").distinct()
    )
    sketches = classes.select("rep", "sketch")
    pairs = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    pairs = pairs.withColumn("u", union).withColumn("x", F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")))
    full = F.size("u") < SKETCH
    floor = _tail(SKETCH, p)
    pairs = stored(pairs.where(F.when(full, _enough(F.col("x"), F.size("u"), percent)).otherwise(F.col("x") >= floor)).select("a", "b"))

    # long lists: groups around pivots
    long = lists.where(F.col("size") > SHORT_LIST).select("v", (-F.col("top.neg")).alias("pivot"))
    groups = stored(post.select("v", F.col("rep").alias("member")).join(long, "v").select("pivot", "member").distinct())
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(groups.select("member")).union(groups.select("pivot")).distinct()
    sets = stored(full_sets(docs, stored(ids), width))
    sa, sb = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    near = pairs.join(sb, "b").join(sa, "a").withColumn("x", _common("sa", "sb"))
    links = near.where(_enough(F.col("x"), F.size("sa") + F.size("sb") - F.col("x"), percent)).select("a", "b")

    star = groups.join(sb, groups.member == F.col("b")).join(sa, F.col("pivot") == F.col("a")).withColumn("x", _common("sa", "sb"))
    star = star.withColumn("u", F.size("sa") + F.size("sb") - F.col("x")).withColumn("linked", _enough(F.col("x"), F.col("u"), percent))
    star = stored(star.select("pivot", "member", "linked", (1 - F.col("x") / F.col("u")).alias("d"), F.col("sb").alias("shingles")))
    links = links.union(star.where("linked and pivot <> member").select("pivot", "member"))
    links = links.union(_rest_of_groups(star, percent))

    label = components(links)
    by_class = classes.select(*key, "rep").join(label, classes.rep == label.node, "left").select(*key, F.coalesce("component", "rep").alias("c"))
    out = sig.select("doc_id", *key).join(by_class, key, "left")
    c = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(c == F.col("doc_id"), F.lit(True)).alias("kept"))


def _rest_of_groups(star: DataFrame, percent: int) -> DataFrame:
    """Links inside groups that the pivot has not already made: blocks by distance from the pivot, only pairs of blocks that may hold one."""
    reach = 1 - percent / 100
    step = 0.025
    star = star.withColumn("band", F.when(F.col("linked"), -1 - F.floor((reach - F.col("d")) / step)).otherwise(F.floor((F.col("d") - reach) / step)).cast("int"))
    open_ = star.where("not linked").select("pivot").distinct()  # a group that its pivot holds together needs no more
    bands = star.join(open_, "pivot", "left_semi").groupBy("pivot", "band").agg(F.count("*").alias("rows"), F.sum(F.size("shingles")).alias("values"))
    bands = bands.withColumn("blocks", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("values") / BLOCK_VALUES)).cast("int"))
    bands = stored(bands.select("pivot", "band", "blocks"))
    a = bands.withColumnsRenamed({"band": "band_a", "blocks": "blocks_a"})
    b = bands.withColumnsRenamed({"band": "band_b", "blocks": "blocks_b"})
    # at most some dozens of bands a pivot; not both linked; their distances from the pivot at most the reach apart
    at = (F.col("band_b") - F.col("band_a") - 1) * step
    met = a.join(b, "pivot").where((F.col("band_a") <= F.col("band_b")) & (F.col("band_b") >= 0) & (at <= reach + 1e-9))
    met = met.select("pivot", "band_a", "band_b", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("i"), "blocks_b")
    met = met.select("pivot", "band_a", "i", "band_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("j"))
    met = met.where("band_a < band_b or i <= j").withColumn("task", F.xxhash64("pivot", "band_a", "i", "band_b", "j"))
    met = met.withColumn("same", (F.col("band_a") == F.col("band_b")) & (F.col("i") == F.col("j")))
    side = lambda k, band, block: met.select("pivot", "task", "same", F.lit(k).alias("side"), F.col(band).alias("band"), F.col(block).alias("block"))
    wanted = side(0, "band_a", "i").union(side(1, "band_b", "j").where("not same"))
    rows = star.join(bands, ["pivot", "band"]).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    dealt = rows.select("pivot", "band", "block", "member", "shingles").join(wanted, ["pivot", "band", "block"]).select("task", "same", "side", "member", "shingles")
    return dealt.groupBy("task").applyInArrow(_block_links(percent), "a long, b long")
