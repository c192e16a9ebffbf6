"""The registered queries of the engine: a program over the star schema for each operator, and the SQL that says what it must give."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans import Compiled, compile_program
from .sources.codefacts import CodeFactsHost
from .sources.hosts import Host, ParquetHost
from .factqueries import FACT_QUERIES
from .syntax import load_text

#: Declarations of the star schema's relations; a program gets those that it uses.
DECLS = {
    "region": "RegionKey: int, Name: string",
    "nation": "NationKey: int, Name: string, RegionKey: int",
    "customer": "CustKey: int, Name: string, NationKey: int, Cents: int, Segment: string",
    "supplier": "SuppKey: int, Name: string, NationKey: int, Cents: int",
    "part": "PartKey: int, Name: string, Brand: string, Type: string, Size: int, Cents: int",
    "orders": "OrderKey: int, CustKey: int, Status: string, Cents: int, Day: int, Priority: string",
    "lineitem": "OrderKey: int, PartKey: int, SuppKey: int, Line: int, Quantity: int, Cents: int, Discount: int, Tax: int, ReturnFlag: string, LineStatus: string, ShipDay: int",
    "event": "EventId: int, Micros: int, UserId: int, Kind: string, Value: int, Props: string",
    "document": "DocId: int, Text: string, Lang: string, Source: string, Chars: int",
    "label": "DocId: int, Quality: int, Toxic: int",
    "page": "PageId: int, Url: string, Html: string",
    "benchmark": "ItemId: int, Text: string",
    "conversation": "ConvId: int, Turn: int, Role: string, Text: string",
    "embedding": "VecId: int, Micro: list<int>, Label: int",
}
_BUILTINS = {
    "contains": ".decl contains(H: string, N: string) extern. .mode contains(+string, +string).",
    "starts_with": ".decl starts_with(S: string, P: string) extern. .mode starts_with(+string, +string).",
    "fmt": ".func fmt(F: string, Args: list<string>, Out: string) extern. .mode fmt(+string, +list<string>, -string).",
    "witness_path": ".decl witness_path(G: string, From: Def, To: Def, P: Path) extern. .mode witness_path(+string, +Def, +Def, -Path).",
    "path_hop": ".decl path_hop(P: Path, Seq: int, From: Def, To: Def, Kind: string, Evidence: Span) extern. .mode path_hop(+Path, -int, -Def, -Def, -string, -Span).",
    "graph_edge": ".decl graph_edge(Graph: string, From: Def, To: Def, EdgeKind: string, Evidence: Span).",
}


@dataclass
class Query:
    out: str
    program: str
    sql: str | None
    host: Callable[[SparkSession, str], Host] | None = None
    status: str = "ok"

    def source(self) -> str:
        used = {a for a in re.findall(r"\b([a-z_]+)\(", self.program)}
        std = ".include " in self.program  # declares the built-ins, and has names of its own
        head = [f".decl {n}({d}) extern." for n, d in DECLS.items() if n in used and not std]
        return "\n".join([*head, *(t for n, t in _BUILTINS.items() if n in used and not std and f".decl {n}(" not in self.program), self.program])

    @lru_cache(maxsize=None)
    def compiled(self) -> Compiled:
        return compile_program(load_text(self.source()))

    __hash__ = object.__hash__

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        host = self.host(spark, sf_dir) if self.host else ParquetHost(spark, sf_dir)
        result = Engine(spark, self.compiled(), host, out=self.out).run()
        if result.known_status != self.status:
            raise RuntimeError(f"{self.out}: {result.notes}")
        return result.frame(self.out)  # arithmetic is guarded in the plan: one evaluation


def _nation_graph(spark: SparkSession, sf_dir: str) -> Host:
    """Each nation leads to (7k + 3) mod 25 and to k + 5 where there is one."""

    def edges(h: ParquetHost) -> DataFrame:
        n = h.read("nation").select(F.col("n_nationkey").cast("long").alias("a"))
        one = n.select("a", F.pmod(F.col("a") * 7 + 3, F.lit(25)).alias("b"), F.lit("jump").alias("k"))
        two = n.where("a < 20").select("a", (F.col("a") + 5).alias("b"), F.lit("step").alias("k"))
        return one.union(two).select("a", "b", "k", (F.col("a") * 100 + F.col("b")).alias("e"))

    return ParquetHost(spark, sf_dir, {"nation_edge": edges, "nation_def": lambda h: h.read("nation").select(F.col("n_nationkey").cast("long"))})


_EDGES = "(SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS b, 'jump' AS k FROM nation UNION SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 5 AS BIGINT), 'step' FROM nation WHERE n_nationkey < 20)"
_GRAPH = """
.decl nation_edge(A: Def, B: Def, Kind: string, E: Span) extern.
.decl nation_def(D: Def) extern.
graph_edge("n", A, B, K, E) :- nation_edge(A, B, K, E).
"""


def _code_facts(spark: SparkSession, sf_dir: str) -> Host:
    """Events as spans of a file for each user, each with a node around it, nested in chains; parts as definitions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("u"), F.col("event_type").alias("kind"))
    path = F.concat(F.lit("user/"), F.col("u").cast("string"))
    line = F.pmod(F.col("id"), F.lit(50)).cast("long")
    spans = e.select(F.col("id").alias("span"), path.alias("rel_path"), line.alias("l0"), F.pmod("id", F.lit(7)).alias("c0"), (line + F.pmod("id", F.lit(3))).alias("l1"), (F.pmod("id", F.lit(7)) + 9).alias("c1"))
    nodes = e.select((F.col("id") + 1_000_000_000).alias("node"), F.when(F.col("kind") == "click", "IF").otherwise("BLOCK").alias("kind"), F.col("id").alias("span"), F.when(F.pmod("id", F.lit(20)) > 0, F.col("id") - 1 + 1_000_000_000).alias("parent"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("key"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("def"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    defs = p.select("def", "name", F.lit("FN").alias("kind"), F.lit(None).cast("long").alias("span"), F.concat("brand", F.lit("::"), "name").alias("path"), F.lit(None).cast("long").alias("method_owner"), F.lit(None).cast("long").alias("return_type"), F.lit(None).cast("long").alias("error_type"), F.lit(None).cast("string").alias("handle"))
    return CodeFactsHost(spark, {"spans": spans, "nodes": nodes, "defs": defs})


_SPANS = "(SELECT event_id AS span, user_id AS f, event_id % 50 AS l0, event_id % 7 AS c0, event_id % 50 + event_id % 3 AS l1, event_id % 7 + 9 AS c1 FROM events)"
_AT = f"""
WITH s AS {_SPANS},
hit AS (SELECT s.span, n.span AS nid, row_number() OVER (PARTITION BY s.span ORDER BY n.l1 - n.l0, CASE WHEN n.l1 = n.l0 THEN n.c1 - n.c0 ELSE 4294967295 END, n.l0, n.c0, n.span) AS r
  FROM s JOIN s n ON s.f = n.f AND (n.l0, n.c0) <= (s.l0, s.c0) AND (s.l1, s.c1) <= (n.l1, n.c1)),
"""

_C = "CAST(round({0} * 100) AS BIGINT)"

QUERIES: dict[str, Query] = {
    "q01_project": Query("q", "q(F, S) :- lineitem(_, _, _, _, _, _, _, _, F, S, _).", "SELECT DISTINCT l_returnflag AS c0, l_linestatus AS c1 FROM lineitem"),
    "q02_constant": Query("q", 'q(K, N) :- customer(K, N, _, _, "BUILDING").', "SELECT c_custkey AS c0, c_name AS c1 FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "q03_repeated": Query("q", ".decl pair(A: int, B: int).\npair(K, N) :- supplier(K, _, N, _).\nq(X) :- pair(X, X).", "SELECT DISTINCT s_suppkey AS c0 FROM supplier WHERE s_suppkey = s_nationkey"),
    "q04_compare": Query("q", 'q(K, C) :- orders(K, _, _, C, _, _), C >= 10000000, C < 20000000, K != 7.', f"SELECT DISTINCT o_orderkey AS c0, {_C.format('o_totalprice')} AS c1 FROM orders WHERE {_C.format('o_totalprice')} >= 10000000 AND {_C.format('o_totalprice')} < 20000000 AND o_orderkey <> 7"),
    "q05_join": Query("q", "q(S, N, R) :- supplier(S, _, K, _), nation(K, N, G), region(G, R).", "SELECT DISTINCT s_suppkey AS c0, n_name AS c1, r_name AS c2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "q06_self_join": Query("q", "q(A, B) :- supplier(A, _, N, _), supplier(B, _, N, _), A < B.", "SELECT DISTINCT a.s_suppkey AS c0, b.s_suppkey AS c1 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    "q07_cross": Query("q", "q(A, B) :- region(_, A), region(_, B).", "SELECT DISTINCT a.r_name AS c0, b.r_name AS c1 FROM region a CROSS JOIN region b"),
    "q08_semi": Query("q", "q(C) :- customer(C, _, _, _, _), orders(_, C, _, _, _, _).", "SELECT DISTINCT c_custkey AS c0 FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "q09_anti": Query("q", "has(C) :- orders(_, C, _, _, _, _).\nq(C) :- customer(C, _, _, _, _), not has(C).", "SELECT DISTINCT c_custkey AS c0 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "q10_option": Query("q", '.decl toxic_of(D: int, T: option<int>).\nlabelled(D) :- label(D, _, _).\ntoxic_of(D, some(T)) :- document(D, _, _, _, _), label(D, _, T).\ntoxic_of(D, none) :- document(D, _, _, _, _), not labelled(D).\nq(D, "toxic") :- toxic_of(D, some(1)).\nq(D, "unknown") :- toxic_of(D, none).', "SELECT DISTINCT d.doc_id AS c0, CASE WHEN l.doc_id IS NULL THEN 'unknown' ELSE 'toxic' END AS c1 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1"),
    "q11_list": Query("q", ".decl both(L: list<int>).\nboth([A, B]) :- nation(A, _, B).\nq(B, A) :- both([A, B]).", "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS c0, CAST(n_nationkey AS BIGINT) AS c1 FROM nation"),
    "q12_arithmetic": Query("q", "q(O, L, V, W) :- lineitem(O, _, _, L, Q, C, D, _, _, _, _), V := C * (100 - D) / 100, W := -V / (Q + 1).", f"SELECT DISTINCT l_orderkey AS c0, CAST(l_linenumber AS BIGINT) AS c1, v AS c2, CAST(trunc(CAST(-v AS DECIMAL(38, 0)) / (q + 1)) AS BIGINT) AS c3 FROM (SELECT *, CAST(floor(CAST({_C.format('l_extendedprice')} * (100 - {_C.format('l_discount')}) AS DECIMAL(38, 0)) / 100) AS BIGINT) AS v, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"),
    "q13_test": Query("q", "q(O, Q) :- lineitem(O, _, _, L, Q, _, _, _, _, _, _), Q := L * 7.", "SELECT DISTINCT l_orderkey AS c0, CAST(l_quantity AS BIGINT) AS c1 FROM lineitem WHERE CAST(l_quantity AS BIGINT) = l_linenumber * 7"),
    "q14_or": Query("q", 'q(K) :- customer(K, _, _, _, S), (S = "BUILDING" ; S = "MACHINERY").', "SELECT DISTINCT c_custkey AS c0 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "q15_nested_or": Query("q", 'q(K, W) :- (customer(K, _, _, C, S), W = S, (C < 0 ; S = "BUILDING") ; supplier(K, W, _, _)).', f"SELECT c_custkey AS c0, c_mktsegment AS c1 FROM customer WHERE {_C.format('c_acctbal')} < 0 OR c_mktsegment = 'BUILDING' UNION SELECT s_suppkey, s_name FROM supplier"),
    "q16_union": Query("q", "q(N) :- customer(_, N, _, _, _).\nq(N) :- supplier(_, N, _, _).\nq(\"nobody\").", "SELECT c_name AS c0 FROM customer UNION SELECT s_name FROM supplier UNION SELECT 'nobody'"),
    "q17_strings": Query("q", 'q(K, "contains") :- part(K, N, _, _, _, _), contains(N, "1").\nq(K, "starts") :- part(K, _, B, _, _, _), starts_with(B, "Brand#1").\nq(K, "neither") :- part(K, N, B, _, _, _), not contains(N, "1"), not starts_with(B, "Brand#1").', "SELECT p_partkey AS c0, 'contains' AS c1 FROM part WHERE contains(p_name, '1') UNION SELECT p_partkey, 'starts' FROM part WHERE starts_with(p_brand, 'Brand#1') UNION SELECT p_partkey, 'neither' FROM part WHERE NOT contains(p_name, '1') AND NOT starts_with(p_brand, 'Brand#1')"),
    "q18_fmt_coalesce": Query("q", '.func coalesce(Opt: option<string>, Default: string, Out: string) extern.\n.mode coalesce(+option<string>, +string, -string).\n.decl lang(D: int, L: option<string>).\nlang(D, some(L)) :- document(D, _, L, _, _), L != "en".\nlang(D, none) :- document(D, _, "en", _, _).\nq(D, T) :- lang(D, O), coalesce(O, "default", L), document(D, _, _, S, _), fmt("{} from {} {}", [L, S], T).', "SELECT DISTINCT doc_id AS c0, CASE WHEN lang = 'en' THEN 'default' ELSE lang END || ' from ' || source || ' {}' AS c1 FROM documents"),
    "q19_count": Query("q", "q(C, N) :- customer(C, _, _, _, _), N = count(O : orders(O, C, _, _, _, _)).", "SELECT c_custkey AS c0, count(DISTINCT o_orderkey) AS c1 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "q20_count_rows": Query("q", "q(O, N) :- orders(O, _, _, _, _, _), N = count(lineitem(O, P, S, L, _, _, _, _, _, _, _)).", "SELECT o_orderkey AS c0, count(DISTINCT (l_partkey, l_suppkey, l_linenumber)) FILTER (WHERE l_orderkey IS NOT NULL) AS c1 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "q21_count_distinct": Query("q", "q(S, N) :- supplier(S, _, _, _), N = count_distinct(P : lineitem(_, P, S, _, _, _, _, _, _, _, _)).", "SELECT s_suppkey AS c0, count(DISTINCT l_partkey) AS c1 FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey"),
    "q22_sum": Query("q", "q(O, N) :- orders(O, _, _, _, _, _), N = sum(Q : lineitem(O, _, _, _, Q, _, _, _, _, _, _)).", "SELECT o_orderkey AS c0, CAST(coalesce(sum(DISTINCT CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS c1 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "q23_min_max": Query("q", "q(C, A, B) :- customer(C, _, _, _, _), A = min(P : orders(_, C, _, P, _, _)), B = max(P2 : orders(_, C, _, P2, _, _)).", f"SELECT c_custkey AS c0, min({_C.format('o_totalprice')}) AS c1, max({_C.format('o_totalprice')}) AS c2 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "q24_global": Query("q", "q(K, N) :- N = count(O : orders(O, C, K, _, _, _)), orders(_, _, K, _, _, _).", "SELECT DISTINCT o_orderstatus AS c0, (SELECT count(DISTINCT o_orderkey) FROM orders) AS c1 FROM orders"),
    "q25_join_count": Query("q", 'q(N, C) :- nation(K, N, _), C = count(O : customer(U, _, K, _, _), orders(O, U, "F", P, _, _), P > 5000000).', f"SELECT n_name AS c0, count(DISTINCT o_orderkey) AS c1 FROM nation LEFT JOIN (SELECT c_nationkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND {_C.format('o_totalprice')} > 5000000) ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"),
    "q26_nested": Query("q", "per(C, N) :- customer(C, _, _, _, _), N = count(O : orders(O, C, _, _, _, _)).\nq(K, M) :- nation(K, _, _), M = max(N : customer(C, _, K, _, _), per(C, N)).", "SELECT CAST(c_nationkey AS BIGINT) AS c0, max(n) AS c1 FROM (SELECT c_custkey, c_nationkey, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey) GROUP BY c_nationkey"),
    "q27_topk": Query("q", 'q(C, O, P) :- customer(C, _, _, _, _), choose_topk("orders", 3, C, P, O : orders(O, C, _, P, _, _)).', f"SELECT o_custkey AS c0, o_orderkey AS c1, p AS c2 FROM (SELECT o_custkey, o_orderkey, {_C.format('o_totalprice')} AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY {_C.format('o_totalprice')} DESC, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey) WHERE r <= 3"),
    "q28_topk_ties": Query("q", 'q(N, S, V) :- nation(K, N, _), choose_topk("names", 2, K, V, S : customer(_, S, K, _, _), V = 1).', "SELECT n_name AS c0, c_name AS c1, CAST(1 AS BIGINT) AS c2 FROM (SELECT n_name, c_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_name) AS r FROM (SELECT DISTINCT n_nationkey, n_name, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey)) WHERE r <= 2"),
    "q29_topk_variable": Query("q", 'q(R, N, K) :- region(R, _), K := R + 1, choose_topk("nations", K, R, V, N : nation(V, N, R)).', "SELECT CAST(n_regionkey AS BIGINT) AS c0, n_name AS c1, CAST(n_regionkey + 1 AS BIGINT) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC, n_name) AS r FROM nation) WHERE r <= n_regionkey + 1"),
    "q30_enum": Query("q", '.type Status = { P, O, F }.\n.decl status(K: string, S: Status).\nstatus("P", Status::P). status("O", Status::O). status("F", Status::F).\nof(C, S) :- orders(_, C, K, _, _, _), status(K, S).\nq(C, A, B) :- customer(C, _, _, _, _), A = min(S : of(C, S)), B = max(T : of(C, T)), A < B.', "SELECT c0, ['P', 'O', 'F'][a] AS c1, ['P', 'O', 'F'][b] AS c2 FROM (SELECT o_custkey AS c0, min(strpos('POF', o_orderstatus)) AS a, max(strpos('POF', o_orderstatus)) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey) WHERE a < b"),
    "q31_linear": Query("q", ".decl next(C: int, A: int, B: int).\nnext(C, A, B) :- conversation(C, A, _, _), B := A + 1, conversation(C, B, _, _).\nq(C, A, B) :- next(C, A, B).\nq(C, A, B) :- q(C, A, M), next(C, M, B).", "WITH RECURSIVE n AS (SELECT DISTINCT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r(c, a, b) AS (SELECT c, a, b FROM n UNION SELECT r.c, r.a, n.b FROM r JOIN n ON n.c = r.c AND n.a = r.b) SELECT CAST(c AS BIGINT) AS c0, CAST(a AS BIGINT) AS c1, CAST(b AS BIGINT) AS c2 FROM r"),
    "q32_nonlinear": Query("q", ".decl next(C: int, A: int, B: int).\nnext(C, A, B) :- conversation(C, A, _, _), B := A + 1, conversation(C, B, _, _).\nq(C, A, B) :- next(C, A, B).\nq(C, A, B) :- q(C, A, M), q(C, M, B).", "WITH RECURSIVE n AS (SELECT DISTINCT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r(c, a, b) AS (SELECT c, a, b FROM n UNION SELECT r.c, r.a, n.b FROM r JOIN n ON n.c = r.c AND n.a = r.b) SELECT CAST(c AS BIGINT) AS c0, CAST(a AS BIGINT) AS c1, CAST(b AS BIGINT) AS c2 FROM r"),
    "q33_mutual": Query("q", '.decl next(C: int, A: int, B: int).\nnext(C, A, B) :- conversation(C, A, _, _), B := A + 1, conversation(C, B, _, _).\neven(C, 0) :- conversation(C, 0, _, _).\neven(C, B) :- odd(C, A), next(C, A, B).\nodd(C, B) :- even(C, A), next(C, A, B).\nq(C, T, "even") :- even(C, T).\nq(C, T, "odd") :- odd(C, T).', "WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS c, turn AS t FROM conversations), r(c, t) AS (SELECT c, t FROM t WHERE t = 0 UNION SELECT t.c, t.t FROM r JOIN t ON t.c = r.c AND t.t = r.t + 1) SELECT CAST(c AS BIGINT) AS c0, CAST(t AS BIGINT) AS c1, CASE WHEN t % 2 = 0 THEN 'even' ELSE 'odd' END AS c2 FROM r"),
    "q34_cyclic": Query("q", ".decl leads(A: int, B: int).\nleads(A, B) :- nation(A, _, _), M := A * 7 + 3, D := M / 25, B := M - D * 25.\nq(A, B) :- leads(A, B).\nq(A, B) :- leads(A, M), q(M, B).", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS b FROM nation), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS c0, b AS c1 FROM r"),
    "q35_unreachable": Query("q", ".decl leads(A: int, B: int).\nleads(A, B) :- nation(A, _, _), M := A * 7 + 3, D := M / 25, B := M - D * 25.\nreach(A, B) :- leads(A, B).\nreach(A, B) :- reach(A, M), leads(M, B).\nq(A, B) :- nation(A, _, _), nation(B, _, _), not reach(A, B).", "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS b FROM nation), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT CAST(x.n_nationkey AS BIGINT) AS c0, CAST(y.n_nationkey AS BIGINT) AS c1 FROM nation x, nation y WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = x.n_nationkey AND r.b = y.n_nationkey)"),
    "q36_bounded": Query("q", "q(0).\nq(Y) :- q(X), X < 12, Y := X + 1.", "SELECT CAST(i AS BIGINT) AS c0 FROM range(13) t(i)"),
    "q37_path_length": Query("q", _GRAPH + '.decl path_limit(N: int). path_limit(1).\nfound(A, B, P) :- nation_def(A), nation_def(B), witness_path("n", A, B, P).\nq(A, B, N) :- found(A, B, P), N = count(S : path_hop(P, S, _, _, _, _)).', f"WITH RECURSIVE e AS {_EDGES}, r(a, b, n) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation UNION SELECT r.a, e.b, r.n + 1 FROM r JOIN e ON e.a = r.b WHERE r.n < 8) SELECT a AS c0, b AS c1, CAST(min(n) AS BIGINT) AS c2 FROM r GROUP BY a, b", _nation_graph),
    "q38_path_hops": Query("q", _GRAPH.replace("nation_edge(A, B, K, E).\n", 'nation_edge(A, B, K, E), K = "jump".\n') + 'q(A, B, S, F, T) :- nation_def(A), nation_def(B), witness_path("n", A, B, P), path_hop(P, S, F, T, _, _).', "WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS b FROM nation), r(a, b, n) AS (SELECT a, a, 0 FROM e UNION SELECT r.a, e.b, r.n + 1 FROM r JOIN e ON e.a = r.b WHERE r.n < 8), m AS (SELECT a, b, min(n) AS n FROM r GROUP BY a, b) SELECT m.a AS c0, m.b AS c1, CAST(s.n AS BIGINT) AS c2, s.b AS c3, e.b AS c4 FROM m JOIN (SELECT a, b, n FROM m) s ON s.a = m.a AND s.n < m.n JOIN e ON e.a = s.b", _nation_graph),
    "q39_path_depth": Query("q", _GRAPH + '.decl path_max_depth(N: int). path_max_depth(2).\nq(A, B) :- nation_def(A), nation_def(B), witness_path("n", A, B, _).', f"WITH RECURSIVE e AS {_EDGES}, r(a, b, n) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0 FROM nation UNION SELECT r.a, e.b, r.n + 1 FROM r JOIN e ON e.a = r.b WHERE r.n < 2) SELECT DISTINCT a AS c0, b AS c1 FROM r", _nation_graph),
    "q40_function": Query("q", ".func nation_name(K: int, N: string).\n.mode nation_name(+int, -string).\nnation_name(K, N) :- nation(K, N, _).\nq(C, N) :- customer(C, _, K, _, _), nation_name(K, N), supplier(_, _, K, _).", "SELECT DISTINCT c_custkey AS c0, n_name AS c1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)"),
    "q41_fragments": Query("out_frag", '.type Mode = { SIG, BLOCK }.\n.decl emit(Section: string, Group: string, Rank: int, D: int).\n.decl out_frag(Section: string, Group: string, Rank: int, Seq: int, Kind: string, Render: Mode, D: int, Anchor: option<int>) output.\nemit("Regions", N, 10, K) :- region(K, N).\nout_frag(S, G, R, 0, "DEF", Mode::SIG, D, none) :- emit(S, G, R, D).\nout_frag("Nations", N, 5, K, "SPAN", Mode::BLOCK, K, some(G)) :- nation(K, N, G).', "SELECT 'Regions' AS section, r_name AS \"group\", CAST(10 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS seq, 'DEF' AS kind, 'SIG' AS render, CAST(r_regionkey AS BIGINT) AS d, CAST(NULL AS BIGINT) AS anchor FROM region UNION SELECT 'Nations', n_name, 5, n_nationkey, 'SPAN', 'BLOCK', n_nationkey, n_regionkey FROM nation"),
    "q42_containment": Query("q", ".decl node_at(S: Span, N: option<Node>) extern.\n.decl span_allowed(S: Span) extern.\nq(S, N) :- span_allowed(S), node_at(S, some(N)).", _AT + "dummy AS (SELECT 1) SELECT span AS c0, nid + 1000000000 AS c1 FROM hit WHERE r = 1", _code_facts),
    "q43_climb": Query("q", ".type NodeKind = { IF, MATCH, WHILE, FOR, LOOP, BLOCK, TRY, ARM, OTHER }.\n.decl enclosing_control(S: Span, K: NodeKind, C: Span, D: int) extern.\nq(S, K, C, D) :- enclosing_control(S, K, C, D).", _AT.replace("WITH s", "WITH RECURSIVE s") + "up(span, nid, d) AS (SELECT span, nid, 0 FROM hit WHERE r = 1 UNION ALL SELECT up.span, up.nid - 1, up.d + 1 FROM up JOIN events e ON e.event_id = up.nid WHERE e.event_type <> 'click' AND up.nid % 20 > 0 AND up.d < 32) SELECT up.span AS c0, 'IF' AS c1, up.nid AS c2, CAST(up.d AS BIGINT) AS c3 FROM up JOIN events e ON e.event_id = up.nid WHERE e.event_type = 'click'", _code_facts),
    "q44_search": Query("q", ".decl search(Q: string, D: Def, Score: int) extern.\nq(K, D, S) :- search(K, D, S).", "WITH k AS (SELECT p_partkey AS d, p_name AS n, p_brand || '::' || p_name AS p, unnest(list_concat([p_name, p_brand || '::' || p_name], list_filter(string_split(p_brand || '::' || p_name, '::'), lambda x: x <> ''))) AS k FROM part), twice AS (SELECT d, n, p, k FROM k UNION SELECT d, n, p, lower(k) FROM k) SELECT DISTINCT k AS c0, d AS c1, CAST(CASE WHEN k = n THEN 100 WHEN lower(k) = lower(n) THEN 95 WHEN contains(p, k) THEN 85 ELSE 70 END AS BIGINT) AS c2 FROM twice", _code_facts),
    "q45_top_suppliers": Query("top", 'sells(S, R) :- supplier(S, _, N, _), nation(N, _, R).\nvolume(R, S, N) :- sells(S, R), N = count(O : lineitem(O, _, S, _, _, _, _, _, _, _, _)).\n.decl top(Region: string, Supplier: string, Orders: int) output.\ntop(G, M, N) :- region(R, G), choose_topk("region.suppliers", 8, R, N, S : volume(R, S, N)), supplier(S, M, _, _).', "WITH v AS (SELECT n_regionkey AS r, s_suppkey AS s, count(DISTINCT l_orderkey) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_regionkey, s_suppkey), t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, s) AS k FROM v) SELECT r_name AS region, s_name AS supplier, n AS orders FROM t JOIN region ON r_regionkey = r JOIN supplier ON s_suppkey = s WHERE k <= 8"),
}

QUERIES |= {name: Query(*q) for name, q in FACT_QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
