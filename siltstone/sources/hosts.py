"""The contract of a host, and hosts over memory and over a folder of Parquet tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before the id in the key of an opaque value for which a host has none.
KEY_PREFIX = {"Def": "handle", "Span": "span", "TypeRef": "typeref", "Node": "node", "Call": "call", "Ref": "ref", "Impl": "impl"}


class Host:
    """A source of external relations. A relation is a DataFrame whose columns stand in declared order."""

    def world_stamp(self) -> str:
        return "static"

    def extern(self, name: str) -> DataFrame | None:
        """The rows of a relation; None if the host does not have it. An exception is noted, and the relation is empty."""
        return None

    def scalar(self, name: str):
        """A scalar option of the host, or None."""
        return None

    def order_keys(self, kind: str) -> DataFrame | None:
        """(id, key) that order the values of an opaque kind, or None."""
        return None

    def default_key(self, kind: str, col: Column) -> Column:
        """The key of a value without one."""
        return F.concat(F.lit(KEY_PREFIX.get(kind, kind) + ":"), F.lower(F.lpad(F.hex(col), 16, "0")))

    def notes(self) -> list[str]:
        """Messages since the last call; any makes a run partial."""
        return []

    def set_control_max_depth(self, depth: int) -> None:
        pass

    def refresh(self) -> None:
        """Reads the source again; options stay."""


class MockHost(Host):
    """Has no relations; ids of opaque values are FNV-1a hashes of their names."""

    def world_stamp(self) -> str:
        return "mock"

    @staticmethod
    def id_of(kind: str, name: str) -> int:
        h = 0xCBF29CE484222325
        for b in f"{kind}:{name}".encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h


class MemoryHost(Host):
    """Relations from DataFrames, or functions that give one; keys and scalars from dictionaries."""

    def __init__(self, relations: dict, keys: dict[str, DataFrame] | None = None, scalars: dict | None = None, stamp: str = "memory"):
        self.relations, self.keys, self.scalars, self.stamp, self.depth = relations, keys or {}, scalars or {}, stamp, None
        self.pending: list[str] = []

    def world_stamp(self) -> str:
        return self.stamp

    def extern(self, name: str) -> DataFrame | None:
        got = self.relations.get(name)
        return got() if callable(got) else got

    def scalar(self, name: str):
        return self.scalars.get(name)

    def order_keys(self, kind: str) -> DataFrame | None:
        return self.keys.get(kind)

    def notes(self) -> list[str]:
        out, self.pending = self.pending, []
        return out

    def set_control_max_depth(self, depth: int) -> None:
        self.depth = depth


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _long(c: str) -> Column:
    return F.col(c).cast("long")


def _days(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


#: Relations of the star schema: table, columns.  Money is cents, rates are hundredths, days count from 1970, times are microseconds.
STAR = {
    "region": ("region", lambda: [_long("r_regionkey"), F.col("r_name")]),
    "nation": ("nation", lambda: [_long("n_nationkey"), F.col("n_name"), _long("n_regionkey")]),
    "customer": ("customer", lambda: [_long("c_custkey"), F.col("c_name"), _long("c_nationkey"), _cents("c_acctbal"), F.col("c_mktsegment")]),
    "supplier": ("supplier", lambda: [_long("s_suppkey"), F.col("s_name"), _long("s_nationkey"), _cents("s_acctbal")]),
    "part": ("part", lambda: [_long("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), _long("p_size"), _cents("p_retailprice")]),
    "orders": ("orders", lambda: [_long("o_orderkey"), _long("o_custkey"), F.col("o_orderstatus"), _cents("o_totalprice"), _days("o_orderdate"), F.col("o_orderpriority")]),
    "lineitem": ("lineitem", lambda: [_long("l_orderkey"), _long("l_partkey"), _long("l_suppkey"), _long("l_linenumber"), _long("l_quantity"), _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax"), F.col("l_returnflag"), F.col("l_linestatus"), _days("l_shipdate")]),
    "event": ("events", lambda: [_long("event_id"), F.unix_micros(F.col("ts").cast("timestamp")), _long("user_id"), F.col("event_type"), F.round(F.col("value") * 1000000).cast("long"), F.col("props")]),
    "document": ("documents", lambda: [_long("doc_id"), F.col("text"), F.col("lang"), F.col("source"), _long("n_chars")]),
    "label": ("labels", lambda: [_long("doc_id"), _long("quality"), _long("toxic")]),
    "page": ("pages", lambda: [_long("page_id"), F.col("url"), F.col("html")]),
    "benchmark": ("benchmark", lambda: [_long("item_id"), F.col("text")]),
    "conversation": ("conversations", lambda: [_long("conv_id"), _long("turn"), F.col("role"), F.col("text")]),
    "embedding": ("embeddings", lambda: [_long("vec_id"), F.transform(F.col("embedding"), lambda x: F.round(x.cast("double") * 1000000).cast("long")), _long("label")]),
}


class FileHost(Host):
    """Relations from anything that Spark reads: {name: (format, path or None, options, columns or None)}, with an optional schema among the options.

    Formats are those of ``spark.read.format``: parquet, orc, csv, json, text, jdbc.  Columns are names or Columns, in declared order.
    """

    def __init__(self, spark: SparkSession, relations: dict[str, tuple], stamp: str = "files"):
        self.spark, self.relations, self.stamp = spark, relations, stamp

    def world_stamp(self) -> str:
        return self.stamp

    def extern(self, name: str) -> DataFrame | None:
        if name not in self.relations:
            return None
        kind, path, options, columns = self.relations[name]
        options = dict(options)
        reader = self.spark.read.format(kind)
        if schema := options.pop("schema", None):
            reader = reader.schema(schema)
        df = reader.options(**options).load(path) if path else reader.options(**options).load()
        return df.select(*columns) if columns else df


class ParquetHost(Host):
    """The star schema of a folder of Parquet tables. Frames stay lazy, so filters and columns reach the scans."""

    def __init__(self, spark: SparkSession, folder: str, more: dict | None = None):
        self.spark, self.folder, self.more = spark, folder, more or {}

    def world_stamp(self) -> str:
        return "parquet:" + hashlib.sha256(self.folder.encode()).hexdigest()[:16]

    def extern(self, name: str) -> DataFrame | None:
        if name in self.more:
            got = self.more[name]
            return got(self) if callable(got) else got
        if name not in STAR:
            return None
        table, columns = STAR[name]
        return self.read(table).select(*columns())

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")
