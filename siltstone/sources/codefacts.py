"""A host over tables of code facts: definitions, calls, types, error flow, syntax nodes.

Tables are DataFrames by name, any may be missing (it is then empty); ids are longs.  Relations are lazy plans over them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .hosts import Host

#: Schemas of the tables.
TABLES = {
    "defs": "def long, name string, kind string, span long, path string, method_owner long, return_type long, error_type long, handle string",
    "call_edges": "caller long, callee long, site long, dispatch string",
    "fields": "owner long, name string, type long",
    "variants": "owner long, name string, variant_def long",
    "methods": "owner long, method long",
    "trait_methods": "owner long, method long",
    "implements": "type long, trait long, impl long",
    "from_impl": "src long, dst long, impl long",
    "constructs": "err long, variant string, site long, fn long",
    "propagates": "err long, site long, fn long",
    "converts": "src long, dst long, site long, fn long",
    "handles": "err long, variant string, site long, fn long",
    "compares": "subject long, site long, op string, fn long",
    "writes": "subject long, site long, fn long",
    "spans": "span long, rel_path string, l0 long, c0 long, l1 long, c1 long",
    "nodes": "node long, kind string, span long, parent long, key string",
    "type_shapes": "typeref long, tag string, head long, args array<struct<kind:string,typeref:long>>, mutability string, inner long, prim_name string, key string",
    "call_keys": "id long, key string",
    "ref_keys": "id long, key string",
    "impl_keys": "id long, key string",
    "public_defs": "def long",
    "test_defs": "def long",
    "allowed_spans": "span long",
    "usages": "key string, def long, score long",
}
#: How dispatch kinds are shown, kinds of control nodes, node kinds of the language, and search scores.
DISPATCH = (("DIRECT", "direct"), ("THROUGH_TRAIT", "through_trait"), ("DYN", "dyn"), ("CLOSURE", "closure"), ("FN_POINTER", "fn_pointer"))
CONTROL = ("IF", "MATCH", "WHILE", "FOR", "LOOP")
NODE_KINDS = ("IF", "MATCH", "WHILE", "FOR", "LOOP", "BLOCK", "TRY", "ARM", "OTHER")
EXACT, CASELESS, WITHIN, OTHER = 100, 95, 85, 70


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


def _hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


class CodeFactsHost(Host):
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], stamp: str = "code-facts", control_max_depth: int = 32):
        self.spark, self.tables, self.stamp, self.depth = spark, dict(tables), stamp, control_max_depth

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, **options) -> CodeFactsHost:
        """Tables from Parquet files ``<table>.parquet``; those that are missing are empty."""
        fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        have = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet"))}
        host = cls(spark, have, **options)
        host.folder = folder
        return host

    def refresh(self) -> None:
        if folder := getattr(self, "folder", None):
            self.tables = CodeFactsHost.from_folder(self.spark, folder).tables
        self.__dict__.pop("known_defs", None)
        self.__dict__.pop("at_nodes", None)

    def world_stamp(self) -> str:
        return self.stamp

    def set_control_max_depth(self, depth: int) -> None:
        self.depth = depth

    def t(self, name: str) -> DataFrame:
        if name in self.tables:
            df = self.tables[name]
            return df.select(*_columns(name))
        # rows that the optimiser knows to be none, so that unions and joins with them go
        return self.spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {k}) AS {c}' for c, k in (x.split(' ', 1) for x in TABLES[name].split(', ')))} WHERE false")

    # all definitions, function definitions, spans that are mentioned anywhere
    @cached_property
    def known_defs(self) -> DataFrame:
        return self.mentioned(self.places() or [("defs", "def")])

    def places(self) -> list[tuple[str, str]]:
        """Tables that there are, and their columns that mention definitions."""
        places = [("defs", "def"), ("call_edges", "caller"), ("call_edges", "callee"), ("fields", "owner"), ("variants", "owner"), ("variants", "variant_def"), ("methods", "owner"), ("methods", "method"), ("trait_methods", "owner"), ("trait_methods", "method")]
        places += [("implements", c) for c in ("type", "trait", "impl")] + [("from_impl", c) for c in ("src", "dst", "impl")] + [("converts", c) for c in ("src", "dst", "fn")]
        places += [(t, c) for t in ("constructs", "propagates", "handles") for c in ("err", "fn")] + [(t, c) for t in ("compares", "writes") for c in ("subject", "fn")] + [("public_defs", "def"), ("test_defs", "def")]
        return [(t, c) for t, c in [*places, ("type_shapes", "head")] if t in self.tables]

    def mentioned(self, places: list[tuple[str, str]]) -> DataFrame:
        parts = [(self.t(t).where("tag in ('App', 'Param')") if t == "type_shapes" else self.t(t)).select(F.col(c).alias("def")) for t, c in places]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.where("def is not null").distinct()

    def full_defs(self) -> DataFrame:
        """Every known definition with the values that stand in for missing ones."""
        d = self.t("defs").where("def is not null")
        others = [x for x in self.places() if x[0] != "defs"]
        if others:  # those that defs lacks
            lacking = self.mentioned(others).join(d.select("def"), "def", "left_anti")
            d = d.unionByName(lacking, allowMissingColumns=True)
        name = F.coalesce("name", F.concat(F.lit("def_"), _hex(F.col("def"))))
        return d.select(
            "def", name.alias("name"), F.coalesce("kind", F.lit("OTHER")).alias("kind"), F.coalesce("span", F.xxhash64(F.lit("def_span"), "def")).alias("span"),
            F.coalesce("path", F.concat(F.lit("fallback::def_"), _hex(F.col("def")))).alias("path"), "method_owner", F.coalesce("return_type", F.xxhash64(F.lit("fn_return"), "def")).alias("return_type"), "error_type",
            F.coalesce("handle", F.concat(F.lit("fallback:handle:0x"), _hex(F.col("def")))).alias("handle"),
        )

    def functions(self) -> DataFrame:
        return self.full_defs().where("kind in ('FN', 'METHOD')")

    def known_spans(self) -> DataFrame:
        sites = ("call_edges", "constructs", "propagates", "converts", "handles", "compares", "writes")
        parts = [self.t("spans").select("span"), self.t("nodes").select("span"), self.full_defs().select("span"), *[self.t(s).select(F.col("site").alias("span")) for s in sites if s in self.tables]]
        if "allowed_spans" in self.tables:
            parts.append(self.t("allowed_spans").select("span"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.where("span is not null").distinct()

    def span_keys(self) -> DataFrame:
        """Every known span with its place; one without a place stands alone in a file of its own."""
        own = self.t("spans").where("span is not null")
        s = own.unionByName(self.known_spans().join(own.select("span"), "span", "left_anti"), allowMissingColumns=True)
        zero = F.lit(0).cast("long")
        return s.select("span", F.coalesce("rel_path", F.concat(F.lit("fallback/span_"), _hex(F.col("span")))).alias("rel_path"), *[F.coalesce(c, zero).alias(c) for c in ("l0", "c0", "l1", "c1")])

    def node_keys(self) -> DataFrame:
        return self.t("nodes").select("node", F.coalesce("key", F.concat(F.lit("fallback:node:0x"), _hex(F.col("node")))).alias("key"))

    def typerefs(self) -> DataFrame:
        s = self.t("type_shapes")
        parts = [s.select("typeref"), s.select(F.col("inner").alias("typeref")), s.select(F.explode(self._type_args()).alias("typeref")), self.t("fields").select(F.col("type").alias("typeref")), self.t("defs").select(F.col("return_type").alias("typeref"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        known = out.where("typeref is not null").distinct().join(s.select("typeref", "key"), "typeref", "left")
        return known.select("typeref", F.coalesce("key", F.concat(F.lit("fallback:typeref:0x"), _hex(F.col("typeref")))).alias("key"))

    @staticmethod
    def _type_args() -> Column:
        """Type arguments in order, without lifetimes and constants."""
        return F.transform(F.filter("args", lambda x: F.lower(x["kind"]) == "type"), lambda x: x["typeref"])

    # spans and nodes
    @cached_property
    def at_nodes(self) -> DataFrame:
        """(span, node): the smallest node around each span, or null.

        Equal places count once.  A node stands under a level, the power of two that its lines need, and in the one or two blocks of so many lines that it
        touches; nodes of one line likewise by columns.  A place looks at its blocks at its own level and above, so it meets only nodes near to it.
        """
        spans = self.span_keys()
        place = ["rel_path", "l0", "c0", "l1", "c1"]
        keyed = self.t("nodes").select("node", "span", F.coalesce("key", F.concat(F.lit("fallback:node:0x"), _hex(F.col("node")))).alias("key"))
        n = keyed.join(spans, "span").groupBy(*place).agg(F.min(F.struct("key", "node")).alias("least"))
        n = n.select(F.col("rel_path").alias("nf"), *[F.col(c).alias(f"n_{c}") for c in place[1:]], F.col("least.key").alias("key"), F.col("least.node").alias("node"))
        at = spans.select(*place).distinct()
        start = F.struct(F.col("n_l0").alias("l"), F.col("n_c0").alias("c")) <= F.struct(F.col("l0").alias("l"), F.col("c0").alias("c"))
        end = F.struct(F.col("l1").alias("l"), F.col("c1").alias("c")) <= F.struct(F.col("n_l1").alias("l"), F.col("n_c1").alias("c"))
        level = lambda wide: F.when(F.expr(wide) > 0, F.length(F.bin(F.expr(wide)))).otherwise(0)
        # levels of lines and, for nodes of one line, of columns, or -1
        n = stored(n.withColumn("nv", level("n_l1 - n_l0")).withColumn("nw", F.when(F.expr("n_l0 = n_l1"), level("n_c1 - n_c0")).otherwise(-1)))
        kinds = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(w).alias("w")) for v, w in sorted(tuple(r) for r in n.select("nv", "nw").distinct().collect())] or [F.struct(F.lit(0).alias("v"), F.lit(-1).alias("w"))])
        blocks = lambda a, b, by: F.sequence(F.expr(f"shiftright({a}, {by})"), F.expr(f"shiftright({b}, {by})"))
        # a place that ends before it starts is looked for in its whole file, and so by a level of its own
        whole = "struct(l1, c1) < struct(l0, c0)"
        met = n.select("*", F.explode(F.when(F.expr("n_l0 <= n_l1"), blocks("n_l0", "n_l1", "nv")).otherwise(F.array(F.lit(0).cast("long")))).alias("nb"))
        met = met.select("*", F.explode(F.when(F.expr("nw >= 0 and n_c0 <= n_c1"), blocks("n_c0", "n_c1", "nw")).otherwise(F.array(F.lit(0).cast("long")))).alias("nc"))
        q = at.where(~F.expr(whole)).withColumn("own", level("l1 - l0")).withColumn("wide", F.when(F.expr("l0 = l1"), level("c1 - c0")).otherwise(-1))
        q = q.select("*", F.explode(F.filter(kinds, lambda x: (x["v"] >= F.col("own")) & ((x["w"] < 0) | (F.col("wide") >= 0) & (x["w"] >= F.col("wide"))))).alias("k"))
        q = q.select(*place, F.col("k.v").alias("qv"), F.col("k.w").alias("qw"), F.expr("shiftright(l0, k.v)").alias("qb"), F.expr("if(k.w < 0, 0L, shiftright(c0, k.w))").alias("qc"))
        near = [F.col("rel_path") == F.col("nf"), F.col("qv") == F.col("nv"), F.col("qw") == F.col("nw"), F.col("qb") == F.col("nb"), F.col("qc") == F.col("nc")]
        cols = [*place, *n.columns]
        hit = q.join(met, [*near, start, end]).select(*cols).union(at.where(F.expr(whole)).join(n, [near[0], start, end]).select(*cols))
        wide = F.greatest(F.col("n_l1") - F.col("n_l0"), F.lit(0))
        size = F.struct(wide.alias("a"), F.when(wide == 0, F.greatest(F.col("n_c1") - F.col("n_c0"), F.lit(0))).otherwise(2**32 - 1).alias("b"), F.col("n_l0").alias("c"), F.col("n_c0").alias("d"), F.col("key").alias("e"), F.col("node").alias("f"))
        best = hit.groupBy(*place).agg(F.min(size).alias("least")).select(*place, F.col("least.f").alias("node"))
        return stored(spans.join(best, place, "left").select("span", "node"))

    def enclosing_control(self) -> DataFrame:
        """(span, kind, control span, distance): climbs from the node of a span to the first control node, at most ``depth`` parents up."""
        nodes = self.t("nodes").select(F.col("node").alias("n"), "kind", F.col("span").alias("at"), "parent")
        front = self.at_nodes.where("node is not null").select("span", "node")
        found = []
        for dist in range(self.depth + 1):
            here = front.join(nodes, front.node == nodes.n)
            here = stored(here.select("span", "kind", "at", "parent"))
            control = F.col("kind").isin(*CONTROL)
            found.append(here.where(control).select("span", "kind", "at", F.lit(dist).cast("long").alias("dist")))
            front = here.where(~control & F.col("parent").isNotNull()).select("span", F.col("parent").alias("node"))
            if front.isEmpty():
                break
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out

    def search_rows(self) -> DataFrame:
        """(key, def, score) of names, paths and their segments, in both cases, and of usages."""
        d = self.full_defs().select("def", "name", "path")
        keys = F.concat(F.array("name", "path"), F.filter(F.split("path", "::"), lambda s: s != ""))
        keys = F.array_distinct(F.concat(keys, F.transform(keys, F.lower)))
        x = d.select("def", "name", "path", F.explode(keys).alias("key"))
        # ASCII letters only count as one whatever their case
        fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        score = F.when(F.col("key") == F.col("name"), EXACT).when(fold("key") == fold("name"), CASELESS).when(F.contains("path", "key"), WITHIN).otherwise(OTHER)
        return x.select("key", "def", score.cast("long")).union(self.t("usages").where("key <> ''")).distinct()

    # relations
    def extern(self, name: str) -> DataFrame | None:
        plain = {
            "call_edge": "call_edges", "field": "fields", "variant": "variants", "method": "methods", "trait_method": "trait_methods", "implements": "implements", "from_impl": "from_impl",
            "constructs": "constructs", "propagates": "propagates", "converts": "converts", "handles": "handles", "is_public": "public_defs", "in_test": "test_defs",
            "call_id": "call_keys", "ref_id": "ref_keys", "impl_id": "impl_keys", "writes": "writes",
        }
        if name in plain:
            return self.t(plain[name])
        if name == "def":
            return self.known_defs
        if name == "search":
            return self.search_rows()
        columns = {"def_name": "name", "def_kind": "kind", "def_span": "span", "def_path": "path", "method_of": "method_owner", "handle": "handle"}
        if name in columns:
            return self.full_defs().select("def", columns[name])
        if name in ("fn_error_type", "fn_return_type"):
            return self.functions().select("def", "error_type" if name == "fn_error_type" else "return_type")
        if name == "compares":
            return self.t("compares").select("subject", "site", "op", "fn")
        if name == "span_allowed":
            return self.t("allowed_spans").distinct() if "allowed_spans" in self.tables else self.known_spans()
        if name == "dispatch_str":
            return self.spark.createDataFrame(list(DISPATCH), "d string, s string")
        if name.startswith("ty_"):
            return self.types(name)
        if name == "typeref_id":
            return self.typerefs()
        if name == "node_at":
            return self.at_nodes
        if name == "node_kind":
            kind = F.when(F.col("kind").isin(*NODE_KINDS), F.col("kind")).otherwise("OTHER")
            return self.t("nodes").select("node", kind)
        if name in ("node_span", "node_parent"):
            return self.t("nodes").select("node", name.removeprefix("node_"))
        if name == "node_id":
            return self.node_keys()
        if name == "span_key":
            return self.span_keys()
        if name == "enclosing_control":
            return self.enclosing_control()
        return None

    def types(self, name: str) -> DataFrame | None:
        s = self.t("type_shapes")
        args = lambda tag: s.where(F.col("tag") == tag).select("typeref", F.posexplode(self._type_args()).alias("i", "a")).select("typeref", F.col("i").cast("long"), "a")
        return {
            "ty_app": lambda: s.where("tag = 'App'").select("typeref", "head"),
            "ty_arg": lambda: args("App"),
            "ty_tuple": lambda: args("Tuple"),
            "ty_ref": lambda: s.where("tag = 'Ref'").select("typeref", "mutability", "inner"),
            "ty_ptr": lambda: s.where("tag = 'Ptr'").select("typeref", "mutability", "inner"),
            "ty_slice": lambda: s.where("tag = 'Slice'").select("typeref", "inner"),
            "ty_param": lambda: s.where("tag = 'Param'").select("typeref", "head"),
            "ty_prim": lambda: s.where("tag = 'Prim'").select("typeref", "prim_name"),
            "ty_unknown": lambda: s.where("tag = 'Unknown'").select("typeref"),
        }.get(name, lambda: None)()

    def order_keys(self, kind: str) -> DataFrame | None:
        if kind == "Def":
            return self.full_defs().select("def", "handle")
        if kind == "Span":  # the order of spans is that of this text
            return self.span_keys().select("span", F.concat_ws(":", "rel_path", "l0", "c0", "l1", "c1").alias("key"))
        if kind == "Node":
            return self.node_keys()
        if kind == "TypeRef":
            return self.typerefs()
        table = {"Call": "call_keys", "Ref": "ref_keys", "Impl": "impl_keys"}.get(kind)
        return self.t(table) if table else None
