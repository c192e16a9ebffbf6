"""Topological places of messages that depend on one another.

A place is (turn, level): the latest turn among a message and all that it depends on, and how many steps after the first message at that turn.
A message on a cycle stays at its own turn.  Links that only lead to later turns change nothing, so only connected parts of the link
graph with a link against the turns are looked at.  A part of at most ``LOCAL`` links is solved exactly in one task; a larger one by passes over
distributed tables, as many as its longest chain has links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Links that one task holds.
LOCAL = 1 << 19
_PLACE = "m long, et long, level long, cyclic boolean"


def places(nodes: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(m, et, level, cyclic) of the ``nodes`` (m, t) that do not stand at (t, 0), by the links ``edges`` (a, b): b comes after a."""
    spark = edges.sparkSession
    links = edges.join(nodes.select(F.col("m").alias("a"), F.col("t").alias("ta")), "a").join(nodes.select(F.col("m").alias("b"), F.col("t").alias("tb")), "b")
    links = stored(links.select("a", "b", "ta", "tb"))
    none = spark.createDataFrame([], _PLACE)
    if links.where("ta >= tb").isEmpty():
        return none
    # a link from a message to itself makes no component
    label = components(links.select("a", "b")).select("node", "component")
    part = links.join(label, links.a == label.node, "left").select("a", "b", "ta", "tb", F.coalesce("component", "a").alias("part"))
    size = part.groupBy("part").agg(F.count("*").alias("links"), F.max(F.col("ta") >= F.col("tb")).alias("against")).where("against")
    part = stored(part.join(size.select("part", "links"), "part"))
    out = part.where(F.col("links") <= local).select("part", "a", "b", "ta", "tb").groupBy("part").applyInArrow(_ordered, _PLACE)
    large = part.where(F.col("links") > local)
    if not large.isEmpty():
        out = out.unionByName(_by_passes(large))
    return stored(out)


def _ordered(links: pa.Table) -> pa.Table:
    """The places in one part, by Tarjan's strong components, whose order is topological."""
    a, b, ta, tb = (links.column(c).to_numpy() for c in ("a", "b", "ta", "tb"))
    m, at, inv = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    t = np.concatenate([ta, tb])[at].tolist()
    before: list[list[int]] = [[] for _ in t]
    for x, y in zip(inv[: len(a)].tolist(), inv[len(a) :].tolist()):
        before[y].append(x)
    # along the links backwards, so that a component comes after all that it depends on
    index, low, open_, out = [-1] * len(t), [0] * len(t), [False] * len(t), [None] * len(t)
    n, stack = 0, []
    for root in range(len(t)):
        todo = [(root, iter(before[root]))] if index[root] < 0 else []
        while todo:
            x, rest = todo[-1]
            if index[x] < 0:
                index[x] = low[x] = n
                n += 1
                stack.append(x)
                open_[x] = True
            for y in rest:
                if index[y] < 0:
                    todo.append((y, iter(before[y])))
                    break
                if open_[y]:
                    low[x] = min(low[x], index[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] < index[x]:
                    continue
                part = []
                while not part or part[-1] != x:
                    part.append(stack.pop())
                    open_[part[-1]] = False
                if len(part) > 1 or x in before[x]:
                    for y in part:
                        out[y] = (t[y], 0, True)
                else:
                    out[x] = (*max([(t[x], 0), *((out[y][0], out[y][1] + 1) for y in before[x])]), False)
    et, level, cyclic = zip(*out)
    return pa.table([pa.array(m), pa.array(et, pa.int64()), pa.array(level, pa.int64()), pa.array(cyclic)], names=["m", "et", "level", "cyclic"])


def _on_cycles(edges: DataFrame) -> DataFrame:
    """(m) of the nodes on cycles: strong components by colours, after nodes without open predecessors or successors are peeled off."""
    loops = edges.where("a = b").select(F.col("a").alias("m"))
    found = stored(loops.distinct())
    core = stored(edges.where("a <> b"))
    while True:
        n = core.count()
        while n:
            core = stored(core.join(core.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(core.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
            was, n = n, core.count()
            if n == was:
                break
        if not n:
            return found
        # the greatest node from which each is reached; that node's strong component are the nodes of its colour that reach it
        colour = stored(core.select(F.col("a").alias("m")).union(core.select("b")).distinct().withColumn("c", F.col("m")))
        moved = True
        while moved:
            more = core.join(colour.select(F.col("m").alias("a"), "c"), "a").groupBy("b").agg(F.max("c").alias("c2"))
            step = stored(colour.join(more, colour.m == more.b, "left").select("m", F.greatest("c", F.coalesce("c2", "c")).alias("c"), (F.coalesce("c2", "c") > F.col("c")).alias("moved")))
            moved, colour = not step.where("moved").isEmpty(), step.select("m", "c")
        same = core.join(colour.select(F.col("m").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("m").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
        same = stored(same.select("a", "b", F.col("ca").alias("c")))
        reach = front = stored(colour.where("m = c"))
        while not front.isEmpty():
            back = same.join(front.select(F.col("m").alias("b")), "b").select(F.col("a").alias("m"), "c").distinct()
            front = stored(back.join(reach, ["m", "c"], "left_anti"))
            reach = stored(reach.union(front))
        sizes = reach.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        found = stored(found.union(reach.join(sizes, "c", "left_semi").select("m")).distinct())
        gone = reach.select("m")
        core = stored(core.join(gone.select(F.col("m").alias("a")), "a", "left_anti").join(gone.select(F.col("m").alias("b")), "b", "left_anti"))


def _by_passes(links: DataFrame) -> DataFrame:
    """The places by passes to the fixpoint: nodes on cycles stand still, the others form no cycle, so the passes end."""
    cyclic = _on_cycles(links.select("a", "b"))
    nodes = links.select(F.col("a").alias("m"), F.col("ta").alias("t")).union(links.select("b", "tb")).distinct()
    place = stored(nodes.select("m", F.col("t").alias("et"), F.lit(0).cast("long").alias("level")))
    open_ = stored(links.select("a", "b").join(cyclic.select(F.col("m").alias("b")), "b", "left_anti"))
    moved = True
    while moved:
        need = open_.join(place.select(F.col("m").alias("a"), F.struct("et", (F.col("level") + 1).alias("level")).alias("s")), "a").groupBy("b").agg(F.max("s").alias("s"))
        at = F.struct("et", "level")
        best = F.greatest(at, F.coalesce("s", at))
        step = stored(place.join(need, place.m == need.b, "left").select("m", best.alias("x"), (best != at).alias("moved")).select("m", "x.et", "x.level", "moved"))
        moved, place = not step.where("moved").isEmpty(), step.select("m", "et", "level")
    return place.join(cyclic.withColumn("cyclic", F.lit(True)), "m", "left").select("m", "et", "level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
