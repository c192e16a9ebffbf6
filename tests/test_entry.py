"""The driver contract, the command line, and streams."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone import cli
from siltstone import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_against_sql(spark, sf, duck, name):
    df = engine.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    rel = duck.sql(engine.oracle_sql()[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=key)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "supplier", "orders"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(tmp_path, capsys):
    p = tmp_path / "a.dl"
    p.write_text("e(1, 2). e(2, 3). r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z).")
    assert cli.main(["check", str(p)]) == 0 and "sccs: 2" in capsys.readouterr().out
    assert cli.main(["run", str(p), "--relation", "r", "--max-rows", "2"]) == 0
    out = capsys.readouterr().out
    assert "status: ok" in out and "r: 3" in out and "omitted 1 row(s)" in out and "\ne:" not in out
    p.write_text("p(X) :- q(X).")
    assert cli.main(["check", str(p)]) == 1 and "DL0100" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    from siltstone.plans import compile_program
    from siltstone.streaming.batches import run_stream
    from siltstone.syntax import parse_program

    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(str(tmp_path / "in"))
    seen = []
    c = compile_program(parse_program(".decl e(A: int, B: int) input. r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z)."))
    q = run_stream(spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in")), c, "e", lambda r, epoch: seen.append(r["r"].count()), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [3]


def test_plans_push_filters_and_prune_columns(spark, sf):
    df = engine.queries()["q02_constant"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan and "c_acctbal" not in plan
    plan = engine.queries()["q27_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
