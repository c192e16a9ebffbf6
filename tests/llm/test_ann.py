"""Nearest neighbours against all distances."""

import numpy as np

from siltstone.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(np.float32(x)) for x in v) or not any(v):
            continue
        seen.setdefault((i, tuple(np.float32(v).astype(float))), None)
    out = []
    for i, v in seen:
        if i % every:
            continue
        d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), j) for j, w in seen if j != i and len(w) == len(v))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(d[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def same(a, b):
    return [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], rtol=0, atol=1e-12)


def test_small_table_is_exact_with_bad_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(120)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200, 231)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6), (310, [1.0, 2.0]), (320, [3.0, 4.0]), rows[5]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert same(got(ann.nearest(df, every=10)), brute(rows, 10, 10))


def test_shards_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 60)
    monkeypatch.setattr(ann, "QUERIES", 10)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(300)]
    assert same(got(ann.nearest(spark.createDataFrame(rows, SCHEMA), every=10, k=3)), brute(rows, 10, 3))


def test_recall_on_even_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = got(ann.nearest(spark.createDataFrame(rows, SCHEMA)))
    y = x.astype(float)
    hit = 0
    for q in range(0, 4000, 100):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = 9
        hit += len(set(np.argsort(d)[:10].tolist()) & {r[2] for r in out if r[0] == q})
    assert hit / 400 >= 0.9


def test_clusters_end_early():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32)) * 10
    x = np.concatenate([c + rng.standard_normal((100, 32)) * 0.1 for c in centres])
    forest = ann.Forest(np.arange(len(x)), x)
    at, _ = forest.search(x[5], [forest.strings(x[5:6], t)[0] for t in range(ann.TREES)], 11)
    assert set(at.tolist()) == set(np.argsort(((x - x[5]) ** 2).sum(1))[:11].tolist())


def test_empty_and_clashing_columns(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "a"), (7, [1.0, 3.0], 2, "b")], SCHEMA + ", rep int, score string")
    assert got(ann.nearest(df)) == [(0, 1, 7, 1.0)]
