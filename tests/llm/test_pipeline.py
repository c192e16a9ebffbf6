"""The pipeline's stages against brute force, each on its own input."""

import pytest

import corpus_pipeline as P
from siltstone.llm.common import stored

from .test_decontaminate import brute as contaminated
from .test_minhash import brute as grouped
from .test_pii import brute as personal


@pytest.fixture(scope="module")
def made(spark, sf):
    """The input of each stage and the last result."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in P.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, sf))
    return [*out, docs]


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay(made):
    assert all(df.columns == made[0].columns for df in made[:-1]) and [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "sentencepiece"]


def test_toxicity(spark, sf, made):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    before, after = {i for i, _ in rows(made[0])}, {i for i, _ in rows(made[1])}
    clean = before - toxic
    assert after <= before and len(clean - after) <= 0.02 * len(clean)


def test_near_dedup(made):
    kept = {r[0] for r in grouped(rows(made[1]), 5, 80) if r[3]}
    assert rows(made[2]) == [r for r in rows(made[1]) if r[0] in kept]


def test_decontamination(spark, sf, made):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {}
    for i, t in rows(made[2]):
        windows[i] = t
    dirty = set()
    from .test_decontaminate import words

    grams = {tuple(w[k : k + min(10, len(w))]) for _, b in bench if (w := words(b)) for k in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}
    for i, t in windows.items():
        w = words(t)
        if any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1)):
            dirty.add(i)
    assert rows(made[3]) == [r for r in rows(made[2]) if r[0] not in dirty]
    assert contaminated([(1, "x")], [])[0][-1] is False


def test_personal_data(made):
    before, after = dict(rows(made[3])), dict(rows(made[4]))
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert bool(personal(t)) == (after[i] != t) and not any(k == "email" for k, *_ in personal(after[i]))


def test_sentencepiece(made):
    texts = dict(rows(made[4]))
    last = made[5].collect()
    assert len(last) == len(texts) and all(r.round_trip and r.n_bytes == len(texts[r.doc_id].encode()) for r in last)


def test_run_gives_the_last_stage(spark, sf, made):
    a = sorted((r.doc_id, r.ids_sha256) for r in P.run(spark, sf).collect())
    assert a == sorted((r.doc_id, r.ids_sha256) for r in made[5].collect())


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
