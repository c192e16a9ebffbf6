"""Benchmark windows against a scan of every position."""

import hashlib
import random
import re

import pytest

from siltstone.llm import decontaminate as D

DOCS, BENCH = "doc_id long, text string", "item_id long, text string"


def words(t):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    out = []
    for i, t in docs:
        w = words(t)
        hit, items = [False] * len(w), set()
        for k, b in bench:
            x = words(b)
            n = min(10, len(x))
            for p in range(len(x) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == x[p : p + n]:
                        hit[q : q + n] = [True] * n
                        items.add(str(k))
        out.append((i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.drop("items", "spans", "matches").collect()], key=str)


def longest(t, bench):
    """(item, place in item, place in text, words) of the runs of equal words that cannot be extended and hold a window."""
    w, out = words(t), []
    for k, b in bench:
        x = words(b)
        for i in range(len(x)):
            for p in range(len(w)):
                if x[i] == w[p] and not (i and p and x[i - 1] == w[p - 1]):
                    n = 0
                    while i + n < len(x) and p + n < len(w) and x[i + n] == w[p + n]:
                        n += 1
                    if n >= min(10, len(x)):
                        out.append((str(k), i, p, n))
    return sorted(out)


def fixture():
    random.seed(3)
    text = lambda n: " ".join(random.choice(["ab", "Cd", "é1", "x", "yz"]) + random.choice(["", ".", ",", "-"]) for _ in range(n))
    bench = [(i, text(random.choice([1, 4, 9, 10, 11, 30]))) for i in range(14)] + [(20, ""), (21, None), (22, "one two three four five six seven eight nine ten eleven")]
    docs = [(i, text(random.randint(0, 60))) for i in range(50)]
    docs += [(60, "a one two THREE four five six seven eight, nine ten b"), (61, "one two three four five six seven eight nine"), (62, None), (63, ""), (None, bench[2][1]), (61, "x")]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = fixture()
    b = spark.createDataFrame(bench, BENCH)
    assert got(D.contamination(spark.createDataFrame(docs, DOCS).repartition(3), b)) == brute(docs, bench)


@pytest.mark.parametrize("block, pairs", [(4 << 20, 1 << 20), (300, 7)])
def test_longest_matches(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    monkeypatch.setattr(D, "PAIRS", pairs)
    docs, bench = fixture()
    rnd = random.Random(1)
    for i in range(30):  # passages of items, also twice in a text, and texts and items that repeat themselves
        x = words(rnd.choice(bench)[1] or "") or ["z"]
        a = rnd.randrange(len(x))
        docs.append((100 + i, " ".join(["q", *x[a : a + rnd.randrange(30)], "r", *x[: rnd.randrange(40)], *["s"] * rnd.randrange(14)])))
    bench += [(30, " ".join(["s"] * 12)), (31, "p q " * 9)]
    docs += [(200, "s " * 25), (201, "p q " * 14)]
    out = D.contamination(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], DOCS).repartition(3), spark.createDataFrame(bench, BENCH)).collect()
    for r in out:
        assert sorted((m.item_id, m.item_start, m.start, m.length) for m in r.matches) == longest(docs[r.doc_id][1], bench), docs[r.doc_id]


def test_very_long_texts(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    text = "filler words " * 200_000 + passage + " more of it" * 100_000
    b = spark.createDataFrame([(1, passage), (2, "filler words " * 8)], BENCH)
    r = D.contamination(spark.createDataFrame([(1, text), (2, "x " * 900_000)], DOCS), b).where("doc_id = 1").first()
    assert r.n_hit == 400_011 and ("1", 0, 400_000, 11) in [tuple(m) for m in r.matches]
    assert D.remove_contaminated(spark.createDataFrame([(1, text), (2, "x " * 900_000)], DOCS), b).count() == 1


def test_removal_with_a_benchmark_in_blocks(spark, monkeypatch):
    docs, bench = fixture()
    df, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    want = sorted((d for d in docs if not brute([d], bench)[0][-1]), key=str)
    assert sorted((tuple(r) for r in D.remove_contaminated(df, b).collect()), key=str) == want


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, bench = fixture()
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    b = spark.createDataFrame(bench, BENCH)
    assert got(D.contamination(spark.createDataFrame(docs, DOCS), b)) == brute(docs, bench)


def test_removal_keeps_clean_rows_and_columns(spark):
    docs, bench = fixture()
    bench = bench[-1:]
    df = spark.createDataFrame([(*d, "s", k) for k, d in enumerate(docs)], DOCS + ", items string, hit long")
    out = D.remove_contaminated(df, spark.createDataFrame(bench, BENCH))
    want = sorted(k for k, d in enumerate(docs) if not brute([d], bench)[0][-1])
    assert out.columns == df.columns and sorted(r.hit for r in out.collect()) == want and len(want) == len(docs) - 1


def test_spans_and_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten eleven end")], DOCS), spark.createDataFrame(fixture()[1][-1:], BENCH)
    assert [(s.start, s.end) for s in D.contamination(d, b).first().spans] == [(1, 12)]
    assert got(D.contamination(d, spark.createDataFrame([], BENCH)))[0][2:4] == (0, 0)
    assert D.contamination(spark.createDataFrame([], DOCS), b).count() == 0
