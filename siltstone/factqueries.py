"""Registered queries over code facts and the standard library, and over what is left of the language: (output, program, SQL, host, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.codefacts import CodeFactsHost
from .sources.hosts import Host

#: Code facts made from the star schema, as SQL that Spark and DuckDB both run: parts are definitions, line items calls, orders and events error flow.
FACTS = {
    "defs": """SELECT CAST(p_partkey AS BIGINT) AS def, p_name AS name,
      CASE p_partkey % 6 WHEN 0 THEN 'FN' WHEN 1 THEN 'METHOD' WHEN 2 THEN 'STRUCT' WHEN 3 THEN 'ENUM' WHEN 4 THEN 'TRAIT' ELSE 'MOD' END AS kind, CAST(p_partkey + 5000000 AS BIGINT) AS span, p_brand || '::' || p_name AS path,
      CASE WHEN p_partkey % 6 = 1 THEN CAST(p_partkey + 1 AS BIGINT) END AS method_owner, CASE WHEN p_partkey % 6 < 2 THEN CAST(p_size AS BIGINT) END AS return_type,
      CASE WHEN p_partkey % 12 = 0 THEN CAST(p_partkey + 3 AS BIGINT) END AS error_type, 'h:' || CAST(p_partkey AS VARCHAR(20)) AS handle FROM part""",
    "call_edges": """SELECT CAST(l_partkey AS BIGINT) AS caller, CAST(l_suppkey AS BIGINT) AS callee, CAST(l_orderkey * 8 + l_linenumber + 10000000 AS BIGINT) AS site,
      CASE l_returnflag WHEN 'A' THEN 'DIRECT' WHEN 'N' THEN 'DYN' ELSE 'THROUGH_TRAIT' END AS dispatch FROM lineitem""",
    "spans": "SELECT CAST(p_partkey + 5000000 AS BIGINT) AS span, 'src/' || p_brand AS rel_path, CAST(p_partkey % 100 AS BIGINT) AS l0, CAST(2 AS BIGINT) AS c0, CAST(p_partkey % 100 + 5 AS BIGINT) AS l1, CAST(p_size AS BIGINT) AS c1 FROM part",
    "fields": "SELECT CAST(p_partkey AS BIGINT) AS owner, p_type AS name, CAST(p_size AS BIGINT) AS type FROM part WHERE p_partkey % 6 = 2",
    "variants": "SELECT CAST(p_partkey AS BIGINT) AS owner, p_name AS name, CAST(p_partkey + 1 AS BIGINT) AS variant_def FROM part WHERE p_partkey % 6 = 3",
    "methods": "SELECT CAST(p_partkey + 1 AS BIGINT) AS owner, CAST(p_partkey AS BIGINT) AS method FROM part WHERE p_partkey % 6 = 1",
    "trait_methods": "SELECT CAST(p_partkey AS BIGINT) AS owner, CAST(p_partkey - 3 AS BIGINT) AS method FROM part WHERE p_partkey % 6 = 4",
    "implements": "SELECT CAST(s_suppkey AS BIGINT) AS type, CAST(s_nationkey AS BIGINT) AS trait, CAST(s_suppkey + 900000 AS BIGINT) AS impl FROM supplier",
    "from_impl": "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, CAST(n_nationkey + 800000 AS BIGINT) AS impl FROM nation",
    "constructs": "SELECT CAST(o_custkey AS BIGINT) AS err, o_orderstatus AS variant, CAST(o_orderkey + 20000000 AS BIGINT) AS site, CAST(o_custkey % 50 AS BIGINT) AS fn FROM orders",
    "propagates": "SELECT CAST(user_id AS BIGINT) AS err, CAST(event_id + 30000000 AS BIGINT) AS site, CAST(event_id % 97 AS BIGINT) AS fn FROM events",
    "converts": "SELECT CAST(s_suppkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(s_suppkey + 40000000 AS BIGINT) AS site, CAST(s_suppkey % 7 AS BIGINT) AS fn FROM supplier",
    "handles": "SELECT CAST(o_custkey AS BIGINT) AS err, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS variant, CAST(o_orderkey + 60000000 AS BIGINT) AS site, CAST(o_custkey % 50 AS BIGINT) AS fn FROM orders",
    "compares": "SELECT CAST(c_custkey AS BIGINT) AS subject, CAST(c_custkey + 50000000 AS BIGINT) AS site, c_mktsegment AS op, CAST(c_nationkey AS BIGINT) AS fn FROM customer",
    "writes": "SELECT CAST(c_custkey AS BIGINT) AS subject, CAST(c_custkey + 70000000 AS BIGINT) AS site, CAST(c_nationkey AS BIGINT) AS fn FROM customer",
    "public_defs": "SELECT CAST(p_partkey AS BIGINT) AS def FROM part WHERE p_size < 10",
    "test_defs": "SELECT CAST(p_partkey AS BIGINT) AS def FROM part WHERE p_size > 45",
    "allowed_spans": "SELECT CAST(p_partkey + 5000000 AS BIGINT) AS span FROM part WHERE p_partkey % 3 <> 0",
    "nodes": """SELECT CAST(p_partkey + 1000000000 AS BIGINT) AS node, CASE p_size % 4 WHEN 0 THEN 'IF' WHEN 1 THEN 'LOOP' WHEN 2 THEN 'CLOSURE' ELSE 'BLOCK' END AS kind, CAST(p_partkey + 5000000 AS BIGINT) AS span,
      CASE WHEN p_partkey % 10 > 0 THEN CAST(p_partkey - 1 + 1000000000 AS BIGINT) END AS parent, 'n:' || CAST(p_partkey AS VARCHAR(20)) AS key FROM part""",
    "call_keys": "SELECT CAST(n_nationkey AS BIGINT) AS id, 'call:' || n_name AS key FROM nation",
    "ref_keys": "SELECT CAST(n_nationkey AS BIGINT) AS id, 'ref:' || n_name AS key FROM nation",
    "impl_keys": "SELECT CAST(n_nationkey AS BIGINT) AS id, 'impl:' || n_name AS key FROM nation",
}
#: Type shapes, one for each nation, kind by kind; arguments are the next two nations, with a lifetime between them.
_TAG = "CASE n_nationkey % 8 WHEN 0 THEN 'App' WHEN 1 THEN 'Ref' WHEN 2 THEN 'Ptr' WHEN 3 THEN 'Tuple' WHEN 4 THEN 'Slice' WHEN 5 THEN 'Param' WHEN 6 THEN 'Prim' ELSE 'Unknown' END"
_SHAPES = f"""SELECT CAST(n_nationkey AS BIGINT) AS typeref, {_TAG} AS tag, CASE WHEN n_nationkey % 8 IN (0, 5) THEN CAST(n_nationkey * 3 + 1 AS BIGINT) END AS head,
  array(named_struct('kind', 'type', 'typeref', CAST(n_nationkey + 1 AS BIGINT)), named_struct('kind', 'lifetime', 'typeref', CAST(NULL AS BIGINT)), named_struct('kind', 'type', 'typeref', CAST(n_nationkey + 2 AS BIGINT))) AS args,
  CASE WHEN n_nationkey % 3 = 0 THEN 'MUT' ELSE 'IMM' END AS mutability, CASE WHEN n_nationkey % 8 IN (1, 2, 4) THEN CAST(n_nationkey + 5 AS BIGINT) END AS inner, CASE WHEN n_nationkey % 8 = 6 THEN lower(n_name) END AS prim_name, 't:' || n_name AS key FROM nation"""


def facts(*tables: str):
    """A host over some of the tables."""

    def make(spark: SparkSession, sf_dir: str) -> Host:
        def read(sql: str) -> DataFrame:
            source = sql.split(" FROM ")[1].split()[0]
            # the table itself stands in the query's text; no view is left in the session
            return spark.sql(sql.replace(f" FROM {source}", " FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))

        return CodeFactsHost(spark, {t: read(_SHAPES if t == "type_shapes" else FACTS[t]) for t in tables})

    return make


def t(name: str) -> str:
    return f"({FACTS[name]})"


_STD = '.include "std.dl".\n'
_SHAPE_ROWS = f"(SELECT CAST(n_nationkey AS BIGINT) AS t, {_TAG} AS tag, * FROM nation)"

FACT_QUERIES: dict[str, tuple] = {
    "q46_definitions": ("q", _STD + ".decl q(D: Def, Name: string, K: DefKind, Path: string, H: string).\nq(D, N, K, P, H) :- def(D), def_name(D, N), def_kind(D, K), def_path(D, P), handle(D, H).", f"SELECT def AS d, name, kind AS k, path, handle AS h FROM {t('defs')}", facts("defs")),
    "q47_owners_and_types": ("q", _STD + ".decl q(D: Def, Owner: option<Def>, Err: option<Def>, R: TypeRef).\nq(D, O, E, R) :- is_fn(D), method_of(D, O), fn_error_type(D, E), fn_return_type(D, R).", f"SELECT def AS d, method_owner AS owner, error_type AS err, return_type AS r FROM {t('defs')} WHERE kind IN ('FN', 'METHOD')", facts("defs")),
    "q48_calls": ("q", _STD + ".decl q(F: Def, T: Def, S: Span, How: string).\nq(F, T, S, W) :- call_edge(F, T, S, D), callee(F, T, S, D), caller(T, F, S, D), dispatch_str(D, W).", f"SELECT DISTINCT caller AS f, callee AS t, site AS s, lower(dispatch) AS how FROM {t('call_edges')}", facts("call_edges")),
    "q49_structure": ("q", _STD + '.decl q(Kind: string, A: Def, B: Def).\nq("method", A, B) :- def(A), method(A, B).\nq("trait", A, B) :- def(A), trait_method(A, B).\nq("variant", A, B) :- def(A), variant(A, _, B).\nq("implements", A, B) :- def(A), implements(A, B, _).\nq("impl", A, I) :- def(A), implements(A, _, I).\nq("from", A, B) :- def(A), from_impl(A, B, _).\nq("field", A, A) :- def(A), field(A, _, _).', f"SELECT 'method' AS kind, owner AS a, method AS b FROM {t('methods')} UNION SELECT 'trait', owner, method FROM {t('trait_methods')} UNION SELECT 'variant', owner, variant_def FROM {t('variants')} UNION SELECT 'implements', type, trait FROM {t('implements')} UNION SELECT 'impl', type, impl FROM {t('implements')} UNION SELECT 'from', src, dst FROM {t('from_impl')} UNION SELECT 'field', owner, owner FROM {t('fields')}", facts("methods", "trait_methods", "variants", "implements", "from_impl", "fields")),
    "q50_field_types": ("q", _STD + ".decl q(Struct: Def, Name: string, TR: TypeRef).\nq(S, N, T) :- is_struct(S), field(S, N, T).", f"SELECT f.owner AS struct, f.name, f.type AS tr FROM {t('fields')} f JOIN {t('defs')} d ON d.def = f.owner AND d.kind = 'STRUCT'", facts("fields", "defs")),
    "q51_error_edges": ("q", _STD + ".decl q(A: Def, B: Def, K: string, S: Span).\nq(A, B, K, S) :- error_edge(A, B, K, S).", f"SELECT err AS a, err AS b, 'construct' AS k, site AS s FROM {t('constructs')} UNION SELECT err, err, 'propagate', site FROM {t('propagates')} UNION SELECT src, dst, 'convert', site FROM {t('converts')} UNION SELECT err, err, 'handle', site FROM {t('handles')}", facts("constructs", "propagates", "converts", "handles")),
    "q52_error_sites": ("q", _STD + '.decl q(E: Def, V: option<string>, F: Def, K: string).\nq(E, some(V), F, "built") :- constructs(E, V, _, F).\nq(E, V, F, "handled") :- handles(E, V, _, F).\nq(E, none, F, "passed") :- propagates(E, _, F).\nq(E, none, F, "turned") :- converts(E, _, _, F).', f"SELECT err AS e, variant AS v, fn AS f, 'built' AS k FROM {t('constructs')} UNION SELECT err, variant, fn, 'handled' FROM {t('handles')} UNION SELECT err, NULL, fn, 'passed' FROM {t('propagates')} UNION SELECT src, NULL, fn, 'turned' FROM {t('converts')}", facts("constructs", "propagates", "converts", "handles")),
    "q53_references": ("q", _STD + ".decl q(D: Def, S: Span, What: string, F: Def).\nq(D, S, O, F) :- def(D), compares(D, S, O, F).\nq(D, S, \"write\", F) :- def(D), writes(D, S, F).", f"SELECT subject AS d, site AS s, op AS what, fn AS f FROM {t('compares')} UNION SELECT subject, site, 'write', fn FROM {t('writes')}", facts("compares", "writes")),
    "q54_flags": ("q", _STD + '.decl q(D: Def, Flag: string).\nq(D, "public") :- def(D), is_public(D).\nq(D, "test") :- def(D), in_test(D).\nq(D, "hidden") :- def(D), not is_public(D), not in_test(D).', f"SELECT def AS d, 'public' AS flag FROM {t('public_defs')} UNION SELECT def, 'test' FROM {t('test_defs')} UNION SELECT CAST(p_partkey AS BIGINT), 'hidden' FROM part WHERE p_size BETWEEN 10 AND 45", facts("defs", "public_defs", "test_defs")),
    "q55_scope": ("q", _STD + '.decl q(D: Def, Kind: string).\nq(D, "fn") :- is_fn(D).\nq(D, "struct") :- is_struct(D).\nq(D, "enum") :- is_enum(D).\nq(D, "trait") :- is_trait(D).\nq(D, "allowed") :- def_allowed(D).', f"SELECT def AS d, CASE kind WHEN 'METHOD' THEN 'fn' ELSE lower(kind) END AS kind FROM {t('defs')} WHERE kind <> 'MOD' UNION SELECT def, 'allowed' FROM {t('defs')} WHERE def % 3 <> 0", facts("defs", "allowed_spans")),
    "q56_type_shapes": ("q", _STD + '.decl tr(T: TypeRef).\ntr(T) :- def(D), field(D, _, T).\n.decl q(T: TypeRef, Kind: string, U: option<TypeRef>, D: option<Def>).\nq(T, "app", none, some(D)) :- tr(T), ty_app(T, D).\nq(T, "param", none, some(D)) :- tr(T), ty_param(T, D).\nq(T, "slice", some(U), none) :- tr(T), ty_slice(T, U).\nq(T, "unknown", none, none) :- tr(T), ty_unknown(T).\nq(T, N, none, none) :- tr(T), ty_prim(T, N).\nq(T, "ref mut", some(U), none) :- tr(T), ty_ref(T, Mutability::MUT, U).\nq(T, "ref", some(U), none) :- tr(T), ty_ref(T, Mutability::IMM, U).\nq(T, "ptr", some(U), none) :- tr(T), ty_ptr(T, _, U).', f"SELECT t, CASE tag WHEN 'Prim' THEN lower(n_name) WHEN 'Ref' THEN CASE WHEN t % 3 = 0 THEN 'ref mut' ELSE 'ref' END ELSE lower(tag) END AS kind, CASE WHEN t % 8 IN (1, 2, 4) THEN t + 5 END AS u, CASE WHEN t % 8 IN (0, 5) THEN t * 3 + 1 END AS d FROM {_SHAPE_ROWS} WHERE tag <> 'Tuple' AND t IN (SELECT type FROM {t('fields')})", facts("type_shapes", "fields")),
    "q57_type_arguments": ("q", _STD + '.decl tr(T: TypeRef).\ntr(T) :- def(D), field(D, _, T).\n.decl q(T: TypeRef, Kind: string, I: int, A: TypeRef).\nq(T, "arg", I, A) :- tr(T), ty_arg(T, I, A).\nq(T, "elem", I, A) :- tr(T), ty_tuple(T, I, A).', f"SELECT t, CASE tag WHEN 'App' THEN 'arg' ELSE 'elem' END AS kind, CAST(i AS BIGINT) AS i, t + 1 + i AS a FROM {_SHAPE_ROWS}, (SELECT unnest([0, 1]) AS i) WHERE tag IN ('App', 'Tuple') AND t IN (SELECT type FROM {t('fields')})", facts("type_shapes", "fields")),
    "q58_type_heads": ("q", _STD + ".decl q(T: TypeRef, D: Def, P: string).\nq(T, D, P) :- type_head_def(T, D), type_head_path(T, P), type_is(T, P).", f"SELECT s.t, s.t * 3 + 1 AS d, d.path AS p FROM {_SHAPE_ROWS} s JOIN {t('defs')} d ON d.def = s.t * 3 + 1 WHERE tag = 'App'", facts("type_shapes", "defs")),
    "q59_nodes": ("q", _STD + '.decl node(N: Node).\nnode(N) :- def(D), def_span(D, S), node_at(S, some(N)).\n.decl q(N: Node, K: NodeKind, S: Span, P: option<Node>).\nq(N, K, S, P) :- node(N), node_kind(N, K), node_span(N, S), node_parent(N, P).', f"WITH s AS (SELECT * FROM {t('spans')}), n AS (SELECT * FROM {t('nodes')}), best AS (SELECT arg_min(n.node, n.key) AS node FROM s JOIN s m ON m.rel_path = s.rel_path AND m.l0 = s.l0 AND m.c1 >= s.c1 JOIN n ON n.span = m.span GROUP BY s.span) SELECT DISTINCT node AS n, CASE kind WHEN 'CLOSURE' THEN 'OTHER' ELSE kind END AS k, span AS s, parent AS p FROM n SEMI JOIN best USING (node)", facts("nodes", "spans", "defs")),
    "q60_node_keys": ("node_id", _STD, f"SELECT node AS n, key AS h FROM {t('nodes')}", facts("nodes")),
    "q61_span_keys": ("q", _STD + ".decl q(S: Span, P: string, A: int, B: int, C: int, D: int).\nq(S, P, A, B, C, D) :- def(F), def_span(F, S), span_key(S, P, A, B, C, D).", f"SELECT DISTINCT span AS s, rel_path AS p, l0 AS a, c0 AS b, l1 AS c, c1 AS d FROM {t('spans')}", facts("defs", "spans")),
    "q62_emitted_fragments": ("out_def_frag", _STD + 'emit_sig("Functions", P, 3, D) :- is_fn(D), def_path(D, P).\nemit_item("Structs", P, 2, D) :- is_struct(D), def_path(D, P).\nemit_header("Traits", P, 1, D) :- is_trait(D), def_path(D, P).', f"SELECT DISTINCT CASE kind WHEN 'STRUCT' THEN 'Structs' WHEN 'TRAIT' THEN 'Traits' ELSE 'Functions' END AS section, path AS \"group\", CAST(CASE kind WHEN 'STRUCT' THEN 2 WHEN 'TRAIT' THEN 1 ELSE 3 END AS BIGINT) AS rank, CAST(0 AS BIGINT) AS seq, 'DEF' AS kind, CASE kind WHEN 'STRUCT' THEN 'ITEM' WHEN 'TRAIT' THEN 'HEADER' ELSE 'DOC_SIG' END AS render, def AS d, CAST(NULL AS BIGINT) AS anchor, CAST(NULL AS VARCHAR) AS title FROM {t('defs')} WHERE kind IN ('FN', 'METHOD', 'STRUCT', 'TRAIT')", facts("defs")),
    "q63_emitted_spans": ("out_span_frag", _STD + 'emit_block("B", "g", 1, S, some(S)) :- def(D), writes(D, S, _).\nemit_stmt("S", O, 2, S, none) :- def(D), compares(D, S, O, _).\nemit_expr("E", "g", 3, S, none) :- converts(_, _, S, _).', f"SELECT 'B' AS section, 'g' AS \"group\", CAST(1 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS seq, 'SPAN' AS kind, 'BLOCK' AS render, site AS s, site AS anchor, CAST(NULL AS VARCHAR) AS title FROM {t('writes')} UNION SELECT 'S', op, 2, 0, 'SPAN', 'STMT', site, NULL, NULL FROM {t('compares')} UNION SELECT 'E', 'g', 3, 0, 'SPAN', 'EXPR', site, NULL, NULL FROM {t('converts')}", facts("writes", "compares", "converts")),
    "q64_metrics": ("out_metric_int", _STD + '.decl kinds(K: DefKind, Name: string).\nkinds(DefKind::FN, "functions"). kinds(DefKind::ENUM, "enums"). kinds(DefKind::MACRO, "macros").\nemit_count("Kinds", N, C) :- kinds(K, N), C = count(D : def(D), def_kind(D, X), X = K).', f"SELECT 'Kinds' AS section, n AS name, count(def) AS value FROM (VALUES ('FN', 'functions'), ('ENUM', 'enums'), ('MACRO', 'macros')) v(k, n) LEFT JOIN {t('defs')} d ON d.kind = v.k GROUP BY n", facts("defs")),
    "q65_labels": ("out_metric_str", _STD + 'emit_label("Traits", P, N) :- is_trait(D), def_path(D, P), def_name(D, N).', f"SELECT DISTINCT 'Traits' AS section, path AS name, name AS value FROM {t('defs')} WHERE kind = 'TRAIT'", facts("defs")),
    "q66_callers_view": ("out_metric_int", '.include "callers.dl".\ntarget_def(D) :- def(D), handle(D, "h:7").', f"WITH c AS (SELECT DISTINCT caller, site, dispatch FROM {t('call_edges')} WHERE callee = 7) SELECT 'Summary' AS section, 'callers_total' AS name, count(DISTINCT site) AS value FROM c UNION SELECT 'Summary', 'caller_functions_total', count(DISTINCT caller) FROM c UNION SELECT 'Summary', 'caller_functions_shown', least(8, count(DISTINCT caller)) FROM c UNION SELECT 'Summary', 'callers_direct', count(DISTINCT site) FROM c WHERE dispatch = 'DIRECT' UNION SELECT 'Summary', 'callers_through_trait', count(DISTINCT site) FROM c WHERE dispatch = 'THROUGH_TRAIT' UNION SELECT 'Summary', 'callers_dyn', count(DISTINCT site) FROM c WHERE dispatch = 'DYN'", facts("defs", "call_edges")),
    "q67_iteration_guard": ("p", ".pragma max_iters = 7.\n.pragma max_iters = 5.\np(0).\np(Y) :- p(X), Y := X + 1.\nq(X) :- p(X).", "SELECT CAST(i AS BIGINT) AS c0 FROM range(6) t(i)", None, "partial"),
    "q68_partial_status": ("out_status", ".decl opt_max_iters(N: option<int>). opt_max_iters(some(2)).\np(0).\np(Y) :- p(X), Y := X + 1.", "SELECT 'partial' AS status", None, "partial"),
    "q69_propositions": ("q", 'big() :- orders(_, _, _, C, _, _), C > 1000000.\nnone() :- orders(_, _, _, C, _, _), C < 0.\nq(N) :- region(_, N), big(), not none().', "SELECT r_name AS c0 FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE round(o_totalprice * 100) > 1000000) AND NOT EXISTS (SELECT 1 FROM orders WHERE round(o_totalprice * 100) < 0)"),
    "q70_intersection": ("q", ".decl a(N: int, S: string).\n.decl b(N: int, S: string).\na(N, S) :- customer(_, _, N, C, S), C > 500000.\nb(N, S) :- customer(_, _, N, C, S), C < 0.\nq(N, S) :- a(N, S), b(N, S).", "SELECT CAST(c_nationkey AS BIGINT) AS c0, c_mktsegment AS c1 FROM customer WHERE round(c_acctbal * 100) > 500000 INTERSECT SELECT CAST(c_nationkey AS BIGINT), c_mktsegment FROM customer WHERE round(c_acctbal * 100) < 0"),
    "q71_nested_aggregate": ("q", "q(K, M) :- nation(K, _, _), M = max(N : customer(C, _, K, _, _), N = count(O : orders(O, C, _, _, _, _))).", "SELECT CAST(c_nationkey AS BIGINT) AS c0, max(n) AS c1 FROM (SELECT c_custkey, c_nationkey, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey) GROUP BY c_nationkey"),
    "q72_topk_in_aggregate": ("q", 'q(K, S) :- nation(K, _, _), S = sum(V : choose_topk("best", 3, K, V, C : customer(C, _, K, V, _))).', "SELECT CAST(n_nationkey AS BIGINT) AS c0, CAST(coalesce(sum(DISTINCT v), 0) AS BIGINT) AS c1 FROM nation LEFT JOIN (SELECT c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_custkey) AS r FROM customer) ON c_nationkey = n_nationkey AND r <= 3 GROUP BY n_nationkey"),
    "q73_or_in_aggregate": ("q", 'q(K, N) :- nation(K, _, _), N = count(X : (customer(X, _, K, _, _) ; supplier(X, _, K, _))).', "SELECT CAST(n_nationkey AS BIGINT) AS c0, count(DISTINCT x) AS c1 FROM nation LEFT JOIN (SELECT c_nationkey AS k, c_custkey AS x FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier) ON k = n_nationkey GROUP BY n_nationkey"),
    "q74_topk_of_all": ("q", 'q(C, P) :- choose_topk("all", 7, 0, P, C : orders(_, C, _, P, _, _)).', "SELECT o_custkey AS c0, p AS c1 FROM (SELECT DISTINCT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders) ORDER BY p DESC, o_custkey LIMIT 7"),
    "q75_world_stamp": ("q", _STD + ".decl q(S: string).\nq(S) :- world_stamp(S).", "SELECT 'code-facts' AS s", facts("defs")),
    "q76_input": ("q", ".decl wanted(R: int) input.\nwanted(1). wanted(3).\nq(N) :- wanted(R), nation(_, N, R).", "SELECT DISTINCT n_name AS c0 FROM nation WHERE n_regionkey IN (1, 3)"),
    "q77_negated_builtin": ("q", '.func brand(K: int, B: string).\n.mode brand(+int, -string).\nbrand(K, B) :- part(K, _, B, _, _, _).\nq(K) :- part(K, _, _, T, S, _), brand(K, B), not contains(B, "3"), not starts_with(T, "S"), S < 20.', "SELECT p_partkey AS c0 FROM part WHERE NOT contains(p_brand, '3') AND NOT starts_with(p_type, 'S') AND p_size < 20"),
    "q78_call_keys": ("call_id", _STD, f"SELECT id AS c, key AS h FROM {t('call_keys')}", facts("call_keys")),
    "q79_reference_keys": ("ref_id", _STD, f"SELECT id AS r, key AS h FROM {t('ref_keys')}", facts("ref_keys")),
    "q80_impl_keys": ("impl_id", _STD, f"SELECT id AS i, key AS h FROM {t('impl_keys')}", facts("impl_keys")),
    "q81_type_keys": ("typeref_id", _STD, f"SELECT t AS tr, 't:' || n_name AS h FROM {_SHAPE_ROWS} UNION SELECT x, 'fallback:typeref:0x' || lpad(lower(to_hex(x)), 16, '0') FROM (SELECT t + unnest([1, 2]) AS x FROM {_SHAPE_ROWS} UNION SELECT t + 5 FROM {_SHAPE_ROWS} WHERE t % 8 IN (1, 2, 4)) WHERE x NOT IN (SELECT n_nationkey FROM nation)", facts("type_shapes")),
}
