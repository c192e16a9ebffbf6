"""Bounds of what one task and the driver hold, whatever the input's size.

Spark judges tables by their compressed size and cuts shuffles by bytes on the wire.  Rows of these tables take five to twenty times that in memory, and one stage
of the engine can hold them in several hash tables and sorts at once.  The bounds stay in the session, as plans that were handed out run in it later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a file and of a shuffle that a task reads, and of a table that is broadcast (broadcasts go through the driver); what is less already stays.
MOST = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20, "spark.sql.autoBroadcastJoinThreshold": 256 << 10}
#: Bytes of input for which a shuffle begins with one more partition; Spark puts small ones together again.
PART = 2 << 20
_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def bound(spark: SparkSession) -> None:
    parse = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in MOST.items():
        now = spark.conf.get(name)
        if not now.startswith("-") and parse(now) > most:
            spark.conf.set(name, str(most))


def spread(spark: SparkSession, df: DataFrame) -> None:
    """Shuffles begin with partitions in proportion to the files below ``df``; never with fewer than before."""
    if df.isStreaming:
        return
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(leaf.stats().sizeInBytes()) for leaf in map(leaves.apply, range(leaves.size())) if leaf.nodeName().startswith("LogicalRelation"))
    parts = -(-size // PART)
    if parts > int(spark.conf.get(_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_PARTS, str(parts))
