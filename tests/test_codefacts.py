"""The code-fact host: relations over seeded tables, and the callers view end to end."""

from pathlib import Path

import siltstone
from siltstone.engine import Engine
from siltstone.plans import compile_program
from siltstone.render import fragments, show, text
from siltstone.sources.codefacts import TABLES, CodeFactsHost
from siltstone.syntax import ast as A
from siltstone.syntax import load_program, parse_program

STD = Path(siltstone.__file__).parent / "std"


def host(spark, depth=32, **tables):
    return CodeFactsHost(spark, {t: spark.createDataFrame(rows, TABLES[t]) for t, rows in tables.items()}, control_max_depth=depth)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


#: A query at line 30, column 6, two nodes around it, a place after them, the whole file, and a place far below.
SPANS = [(61, "lib/tree.rs", 30, 6, 30, 9), (62, "lib/tree.rs", 28, 2, 33, 1), (63, "lib/tree.rs", 30, 4, 30, 60), (64, "lib/tree.rs", 34, 0, 34, 8), (65, "lib/tree.rs", 0, 0, 900, 0), (66, "lib/tree.rs", 700, 1, 702, 5)]


def test_smallest_node_around_a_span(spark):
    h = host(spark, spans=SPANS, nodes=[(420, "BLOCK", 62, None, "t:block"), (430, "EXPR", 63, 420, "t:expr"), (450, "ITEM", 65, None, "t:file")])
    at = dict(rows(h.extern("node_at")))
    assert (at[61], at[62], at[64], at[66]) == (430, 420, 450, 450)
    assert rows(h.extern("node_kind")) == [(420, "BLOCK"), (430, "OTHER"), (450, "OTHER")]
    assert rows(h.extern("node_parent")) == [(420, None), (430, 420), (450, None)]


def test_node_miss_and_tie(spark):
    h = host(spark, spans=SPANS[:4], nodes=[(8, "BLOCK", 63, None, "zeta"), (3, "TRY", 63, None, "nu"), (5, "BLOCK", 63, None, "omicron")])
    at = dict(rows(h.extern("node_at")))
    assert at[61] == 3 and at[64] is None  # the least key


def chain(spark, depth):
    spans = [(i, "f", i, 0, 100 - i, 0) for i in range(1, 6)] + [(9, "f", 50, 1, 50, 2)]
    nodes = [(11, "WHILE", 1, None, "a"), (12, "IF", 2, 11, "b"), (13, "BLOCK", 3, 12, "c"), (14, "EXPR", 4, 13, "d")]
    return host(spark, depth, spans=spans, nodes=nodes)


def test_enclosing_control(spark):
    got = {r[0]: r[1:] for r in rows(chain(spark, 32).extern("enclosing_control"))}
    assert got[9] == ("IF", 2, 2) and got[1] == ("WHILE", 1, 0) and got[2] == ("IF", 2, 0)
    assert 9 not in {r[0] for r in rows(chain(spark, 1).extern("enclosing_control"))}
    assert 9 in {r[0] for r in rows(chain(spark, 2).extern("enclosing_control"))}


def test_climb_limit_from_a_fact(spark):
    p = compile_program(parse_program(".type NodeKind = { IF, MATCH, WHILE, FOR, LOOP, BLOCK, TRY, ARM, OTHER }. .decl enclosing_control(S: Span, K: NodeKind, C: Span, D: int) extern. .decl control_max_depth(N: int). control_max_depth(1). q(S) :- enclosing_control(S, _, _, D), D > 0."))
    r = Engine(spark, p, chain(spark, 32)).run()
    assert r.status == "ok" and rows(r["q"]) == [(3,)]


SHAPES = [
    (1, "App", 100, [("lifetime", None), ("type", 2), ("const", None), ("type", 3)], None, None, None, "t1"),
    (2, "Prim", None, [], None, None, "i32", "t2"), (3, "Ref", None, [], "MUT", 2, None, "t3"), (4, "Ptr", None, [], "IMM", 2, None, "t4"),
    (5, "Tuple", None, [("type", 2), ("type", 3)], None, None, None, "t5"), (6, "Slice", None, [], None, 2, None, "t6"), (7, "Param", 101, [], None, None, None, "t7"), (8, "Unknown", None, [], None, None, None, "t8"),
]


def test_type_shapes(spark):
    h = host(spark, type_shapes=SHAPES)
    want = {"ty_app": [(1, 100)], "ty_arg": [(1, 0, 2), (1, 1, 3)], "ty_ref": [(3, "MUT", 2)], "ty_ptr": [(4, "IMM", 2)], "ty_tuple": [(5, 0, 2), (5, 1, 3)], "ty_slice": [(6, 2)], "ty_param": [(7, 101)], "ty_prim": [(2, "i32")], "ty_unknown": [(8,)]}
    assert {n: rows(h.extern(n)) for n in want} == want
    assert dict(rows(h.extern("typeref_id")))[5] == "t5" and rows(h.extern("def")) == [(100,), (101,)]


DEFS = [(1, "run", "FN", 51, "app::run", None, None, 9, "h:run"), (2, "Go", "METHOD", 52, "app::T::Go", 7, None, None, "h:go"), (3, "main", "FN", 53, "app::main", None, None, None, "h:main"), (7, "T", "STRUCT", 54, "app::T", None, None, None, "h:T")]


def test_definitions_and_fallbacks(spark):
    h = host(spark, defs=DEFS, call_edges=[(3, 99, 60, "DYN")])
    assert dict(rows(h.extern("def_name")))[99] == "def_0000000000000063" and dict(rows(h.extern("def_kind")))[99] == "OTHER"
    assert rows(h.extern("fn_error_type")) == [(1, 9), (2, None), (3, None)] and dict(rows(h.extern("method_of")))[2] == 7
    assert (60,) in rows(h.extern("span_allowed")) and rows(host(spark, defs=DEFS, allowed_spans=[(51,)]).extern("span_allowed")) == [(51,)]
    assert rows(h.extern("dispatch_str"))[0] == ("CLOSURE", "closure") and h.extern("nope") is None


def test_search_rows(spark):
    got = rows(host(spark, defs=DEFS[1:2], usages=[("go", 2, 115), ("", 2, 1)]).extern("search"))
    assert got == sorted([("Go", 2, 100), ("T", 2, 85), ("app", 2, 85), ("app::T::Go", 2, 85), ("app::t::go", 2, 70), ("go", 2, 115), ("go", 2, 95), ("t", 2, 70)], key=str)


def test_callers_view(spark):
    edges = [(1, 2, 60 + i, "DIRECT" if i % 2 else "DYN") for i in range(5)] + [(3, 2, 70, "THROUGH_TRAIT")]
    spans = [(s, "src/a.rs", s, 2, s, 9) for s in [51, 52, 53, 54, *range(60, 65), 70]]
    h = host(spark, defs=DEFS, call_edges=edges, spans=spans)
    p = compile_program(load_program(STD / "callers.dl"))
    out = Engine(spark, p, h, {"target_def": spark.createDataFrame([(2,)], "d long")}).run()
    assert {s for s, _ in out.notes} <= {"Notes"} and not any("runtime error" in m for _, m in out.notes)
    metrics = {r[1]: r[2] for r in rows(out["out_metric_int"])}
    assert metrics == {"callers_total": 6, "caller_functions_total": 2, "caller_functions_shown": 2, "callers_direct": 2, "callers_through_trait": 1, "callers_dyn": 3}
    kv = rows(out["out_frag_kv"])
    assert len(kv) == 6 and kv[0][1] == "h:main" and kv[0][-1] == "through_trait" and kv[0][3] == 70002
    order = [r[4] for r in fragments(out["out_def_frag"], p, "out_def_frag").collect()]
    assert order == ["CALLER_FN", "CALLER_FN", "TARGET"]
    assert "callers_total" in show(out, p, ["out_metric_int"], rows=6) and "omitted 5 row(s)" in show(out, p, ["out_metric_int"], rows=1)


def test_values_as_text():
    e = {"E": ("A",)}
    assert text(None, A.option(A.INT), e) == "none" and text(3, A.option(A.INT), e) == "some(3)" and text("A", A.named("E"), e) == "E::A"
    assert text(-1, A.named("Def"), e) == "Def#0xffffffffffffffff" and text(["a\n"], A.list_of(A.STRING), e) == '["a\\n"]' and text(True, A.BOOL, e) == "true"


def test_folder_and_refresh(spark, tmp_path):
    spark.createDataFrame([(1,)], TABLES["public_defs"]).write.parquet(str(tmp_path / "public_defs.parquet"))
    h = CodeFactsHost.from_folder(spark, str(tmp_path), control_max_depth=3)
    assert rows(h.extern("is_public")) == [(1,)] and rows(h.extern("in_test")) == [] and h.depth == 3
    spark.createDataFrame([(2,)], TABLES["test_defs"]).write.parquet(str(tmp_path / "test_defs.parquet"))
    h.refresh()
    assert rows(h.extern("in_test")) == [(2,)] and rows(h.extern("def")) == [(1,), (2,)] and h.depth == 3


def test_nodes_meet_only_places_near_them(spark):
    """Against plain comparison of all with all: places that repeat, stand on one line, or end (far) before they start."""
    spans = [(i, f"f{i % 2}", i % 37, i % 11, i % 37 + (i % 5) * (i % 3), i % 11 + i % 13) for i in range(1, 260)] + [(900, "f0", 9, 5, 9, 2), (901, "f0", 8, 0, 7, 9), (902, "f1", 0, 0, 90, 0), (903, "f0", 100, 0, 10, 0)]
    nodes = [(1000 + s[0], "BLOCK", s[0], None, f"k{s[0] % 50:02}") for s in spans if s[0] % 2 == 0]
    got = dict(rows(host(spark, spans=spans, nodes=nodes).extern("node_at")))
    place = {s[0]: s[1:] for s in spans}

    def best(s):
        _, l0, c0, l1, c1 = s
        around = [(n, k, place[at]) for n, _, at, _, k in nodes if place[at][0] == s[0] and place[at][1:3] <= (l0, c0) and (l1, c1) <= place[at][3:]]
        size = lambda x: (max(x[2][3] - x[2][1], 0), max(x[2][4] - x[2][2], 0) if x[2][3] <= x[2][1] else 2**32 - 1, *x[2][1:3], x[1], x[0])
        return min(around, key=size)[0] if around else None

    assert got == {i: best(s) for i, s in place.items()}
