"""Bounded search for shortest simple paths, all requests at once, one join a level.

For one path a request, a level keeps the first path to each node that the source had not reached before, so the work is that of a breadth-first
search from each source, whatever the fan-out.  For more, all simple prefixes stay from which the target can be reached in the hops that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import spark_type
from ..storage import stored
from ..syntax import ast as A


class Paths:
    """Searches of a run and the hops of every path that they found."""

    def __init__(self, spark: SparkSession, edges, limits, types: list[A.Ty], enums: dict, keys):
        """``edges``: gives the current graph relation; ``limits``: gives (path_limit, path_max_depth); ``types``: of graph_edge;
        ``keys``: (DataFrame, column, type) to the DataFrame and the order key of the column."""
        self.spark, self.edges, self.limits, self.types, self.enums, self.keys = spark, edges, limits, types, enums, keys
        self.found: list[DataFrame] = []
        node, evidence = spark_type(types[1], enums).simpleString(), spark_type(types[4], enums).simpleString()
        self.hop = f"struct<f:{node},t:{node},k:string,e:{evidence}>"
        self.node = node

    def search(self, requests: DataFrame) -> DataFrame:
        """(g, a, b) to (g, a, b, path): up to path_limit paths of up to path_max_depth hops each, by length and then by hops."""
        limit, depth = self.limits()
        requests = stored(requests.distinct())
        # the edges of requested graphs, each with the rank of its hop in the order of edges out of a node: (from, to, kind, evidence)
        e = self.edges().select("c0", "c1", "c2", "c3", "c4").join(requests.select(F.col("g").alias("c0")).distinct(), "c0", "left_semi").distinct()
        order = []
        for i in (1, 2, 3, 4):
            e, k = self.keys(e, F.col(f"c{i}"), self.types[i])
            e = e.withColumn(f"k{i}", k)
            order.append(F.col(f"k{i}"))
        edge = stored(e.select(F.col("c0").alias("eg"), F.col("c1").alias("ef"), F.col("c2").alias("et"), F.struct(F.col("c1").alias("f"), F.col("c2").alias("t"), F.col("c3").alias("k"), F.col("c4").alias("e")).alias("hop"), F.struct(*order).alias("key")))
        key_type = edge.schema["key"].dataType.simpleString()
        nothing = F.array().cast(f"array<{self.hop}>").alias("hops"), F.array().cast(f"array<{key_type}>").alias("keys")
        paths = self.first(requests, edge, depth, nothing) if limit == 1 else self.several(requests, edge, limit, depth, nothing)
        name = F.concat(F.lit("path:"), F.lower(F.lpad(F.hex(F.xxhash64("g", "a", "b", "hops")), 16, "0")))
        paths = stored(paths.select("g", "a", "b", name.alias("path"), "hops"))
        self.found.append(paths)
        return paths.select("g", "a", "b", "path")

    @staticmethod
    def first(requests: DataFrame, edge: DataFrame, depth: int, nothing) -> DataFrame:
        """(g, a, b, hops): the first path of each request; searches from one source share their paths.

        The first path to a node goes on from the first path to the node before, and passes no node twice.
        """
        front = stored(requests.select("g", "a").distinct().select("g", "a", F.col("a").alias("node"), *nothing))
        reached, open_, done = [front], requests, []
        for level in range(depth + 1):
            hit = open_.join(front, ["g", "a"]).where("node = b")
            done.append(hit.select("g", "a", "b", "hops"))
            if level == depth:
                break
            open_ = stored(open_.join(hit.select("g", "a", "b"), ["g", "a", "b"], "left_anti"))
            if open_.isEmpty():
                break
            step = front.join(open_.select("g", "a").distinct(), ["g", "a"], "left_semi").join(edge, (F.col("g") == F.col("eg")) & (F.col("node") == F.col("ef")))
            step = step.select("g", "a", F.col("et").alias("node"), F.struct(F.concat("keys", F.array("key")).alias("keys"), F.concat("hops", F.array("hop")).alias("hops")).alias("x"))
            known = _union([r.select("g", "a", "node") for r in reached])
            best = step.join(known, ["g", "a", "node"], "left_anti").groupBy("g", "a", "node").agg(F.min_by("x", "x.keys").alias("x"))
            front = stored(best.select("g", "a", "node", "x.hops", "x.keys"))
            if front.isEmpty():
                break
            reached.append(front)
        return _union(done)

    @staticmethod
    def several(requests: DataFrame, edge: DataFrame, limit: int, depth: int, nothing) -> DataFrame:
        """(g, a, b, hops): the first ``limit`` paths of each request, by length and then by hops."""
        # backwards from the targets: how many hops a node is away, at least
        away = stored(requests.select("g", "b").distinct().select("g", "b", F.col("b").alias("node"), F.lit(0).alias("left")))
        parts, back = [away], away
        for level in range(1, depth + 1):
            back = back.join(edge, (F.col("g") == F.col("eg")) & (F.col("node") == F.col("et"))).select("g", "b", F.col("ef").alias("node"), F.lit(level).alias("left")).distinct()
            back = stored(back.join(_union([p.select("g", "b", "node") for p in parts]), ["g", "b", "node"], "left_anti"))
            if back.isEmpty():
                break
            parts.append(back)
        away = _union(parts).select(F.col("g").alias("wg"), F.col("b").alias("wb"), F.col("node").alias("wn"), "left")
        front = requests.select("g", "a", "b", F.col("a").alias("node"), F.array("a").alias("seen"), *nothing)
        done: list[DataFrame] = []
        level = 0
        while True:
            done.append(front.where("node = b").select("g", "a", "b", "hops", "keys", F.lit(level).alias("n")))  # of stored rows
            if level >= depth:
                break
            alive = front.where("node <> b")
            if level:
                # a request with enough shorter paths asks for no longer ones
                have = _union(done).groupBy("g", "a", "b").agg(F.count("*").alias("have")).where(F.col("have") >= limit)
                alive = alive.join(have.drop("have"), ["g", "a", "b"], "left_anti")
            step = alive.join(edge, (F.col("g") == F.col("eg")) & (F.col("node") == F.col("ef"))).where(~F.array_contains("seen", F.col("et")))
            step = step.join(away, (F.col("g") == F.col("wg")) & (F.col("b") == F.col("wb")) & (F.col("et") == F.col("wn")) & (F.col("left") < depth - level), "left_semi")
            front = stored(step.select("g", "a", "b", F.col("et").alias("node"), F.concat("seen", F.array("et")).alias("seen"), F.concat("hops", F.array("hop")).alias("hops"), F.concat("keys", F.array("key")).alias("keys")))
            level += 1
            if front.isEmpty():
                break
        best = Window.partitionBy("g", "a", "b").orderBy("n", "keys")
        return _union(done).withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).select("g", "a", "b", "hops")

    def hops(self) -> DataFrame:
        """path_hop: (path, seq, from, to, kind, evidence) of the paths found so far."""
        empty = self.spark.createDataFrame([], f"c0 string, c1 long, c2 {self.node}, c3 {self.node}, c4 string, c5 {spark_type(self.types[4], self.enums).simpleString()}")
        if not self.found:
            return empty
        one = _union([p.select("path", "hops") for p in self.found]).dropDuplicates(["path"])
        x = one.select("path", F.posexplode("hops").alias("i", "h"))
        return x.select(F.col("path").alias("c0"), F.col("i").cast("long").alias("c1"), F.col("h.f").alias("c2"), F.col("h.t").alias("c3"), F.col("h.k").alias("c4"), F.col("h.e").alias("c5"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

