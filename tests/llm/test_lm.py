"""Language-model scores: exact counts and base scores, a proper distribution, and gain on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import lm

SCHEMA = "doc_id long, text string"


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + [None]


def base(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(x for i, t in rows if not out(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    res = []
    for i, t in rows:
        x = tokens(t)
        res.append((i, out(i), len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)))
    return sorted(res, key=str)


@pytest.mark.parametrize("head", [1 << 17, 40])
def test_counts_and_base_scores(spark, sf, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)  # with few head words most words are joined
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (None, "Some words"), (9001, "x y")]
    got = sorted([tuple(r) for r in lm.scores(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()], key=str)
    want = base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_model_gains_on_held_out_texts(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = [r for r in lm.scores(df).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.87 * sum(r.base_score for r in got)  # both are negative: a gain of 13 hundredths


def test_layout_says_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({r.doc_id: r.score for r in lm.scores(df.repartition(n)).collect()} for n in (1, 64))
    assert one.keys() == many.keys() and np.allclose([one[i] for i in one], [many[i] for i in one], rtol=1e-9)


def plain_scores(rows):
    """Scores by loops over tokens and outcomes; the hashing of features is the module's."""
    texts = []
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        h, k, _ = lm._tokens(raw, np.array([0, len(raw)]))
        texts.append((i, h, k, i is not None and zlib.crc32(str(i).encode()) % 10 == 0))
    train = [x for x in texts if not x[3]]
    c = Counter(w for _, h, _, _ in train for w in h.tolist())
    kind = {w: (int(k), int(lm._part(np.array([w], np.uint64))[0])) for _, h, ks, _ in train for w, k in zip(h.tolist(), ks.tolist())}
    n, v = sum(c.values()), len(c)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    frequent = [w for w in sorted(c, key=lambda w: (-c[w], signed(w))) if w != int(lm.END)][: lm.FREQUENT - 1]
    where = lambda w, k: 1 + frequent.index(w) if w in frequent else k
    mass = np.zeros((lm.CLASSES, lm.PARTS))
    for w, (k, s) in kind.items():
        mass[where(w, k), s] += c[w] + 0.1
    mass = np.maximum(mass, 0.1)
    share, part_share = mass.sum(1) / mass.sum(), mass / mass.sum(1, keepdims=True)
    hasher = lm.Model(np.array(frequent, np.uint64), mass, 1 << max(lm.FEWEST.bit_length() - 1, min(lm.ROWS.bit_length() - 1, v.bit_length())))

    def places(h, k):
        y = np.array([where(w, x) for w, x in zip(h.tolist(), k.tolist())])
        one, two = hasher.features(h, np.array([0, len(h)]), y)
        return y.tolist(), lm._part(h).tolist(), [r.tolist() for r in one], [r.tolist() for r in two]

    counts = [Counter(), Counter()]
    for _, h, k, _ in train:
        y, s, one, two = places(h, k)
        for t in range(len(h)):
            counts[0].update((r[t], y[t]) for r in one)
            if y[t] >= lm.FREQUENT:
                counts[1].update((r[t], s[t]) for r in two)
    total = [Counter(), Counter()]
    for t in (0, 1):
        for (r, _), x in counts[t].items():
            total[t][r] += x
    width, each = (lm.CLASSES, lm.PARTS), hasher.rows // lm.ENDINGS
    a = lm.PRIOR
    prior = lambda t, r: share if t == 0 else part_share[lm.FREQUENT + r // each]

    def weights(t, r):
        q = prior(t, r)
        return [float(np.float16(math.log((counts[t][r, o] + a * q[o]) / ((total[t][r] + a) * q[o])))) for o in range(width[t])]

    rates = np.full((2, lm.KINDS, lm.SIZES), 1 / lm.KINDS)
    size = lambda x: min(int(math.log2(max(x, 1))), lm.SIZES - 1)

    def p(t, q, ws):
        z = np.log(q) + sum(rate * np.array(w) for rate, w in ws)
        z = np.exp(z - z.max())
        return z / z.sum()

    ids = {i for i, *_ in train}
    deal = {}
    for i in ids:
        deal[i] = spark_hash(i) % lm.ROUNDS
    for rnd in range(lm.ROUNDS):
        g, hess = np.zeros_like(rates), np.zeros_like(rates)
        for i, h, k, _ in train:
            if deal[i] != rnd:
                continue
            y, s, one, two = places(h, k)
            for j in range(len(h)):
                for t, rows_, out in ((0, one, y[j]), (1, two, s[j])):
                    if t and y[j] < lm.FREQUENT:
                        continue
                    q = share if t == 0 else part_share[y[j]]
                    ws = []
                    for r in rows_:
                        w = weights(t, r[j])
                        smoothed = math.exp(w[out]) * (total[t][r[j]] + a) * q[out]
                        w[out] += math.log(max(smoothed - 1, a * q[out]) / max(smoothed, a * q[out]))
                        ws.append((size(total[t][r[j]] - 1), w))
                    prob = p(t, q, [(rates[t, f, b], w) for f, (b, w) in enumerate(ws)])
                    for f, (b, w) in enumerate(ws):
                        mean = float(prob @ np.array(w))
                        g[t, f, b] += w[out] - mean
                        hess[t, f, b] += float(prob @ np.array(w) ** 2) - mean * mean
        rates = np.clip(rates + lm.STEP * g / (hess + 1.0), 0, 1.5)
    out = []
    for i, h, k, _ in texts:
        y, s, one, two = places(h, k)
        score = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in h.tolist())
        for j, w in enumerate(h.tolist()):
            if not c[w]:
                continue
            for t, rows_, got in ((0, one, y[j]), (1, two, s[j])):
                if t and y[j] < lm.FREQUENT:
                    continue
                q = share if t == 0 else part_share[y[j]]
                prob = p(t, q, [(rates[t, f, size(total[t][r[j]])], weights(t, r[j])) for f, r in enumerate(rows_)])
                score += math.log10(prob[got] / q[got])
        out.append((i, score))
    return out


def spark_hash(i):
    """xxhash64 of a long, as Spark computes it; of a null its seed."""
    import xxhash

    return 42 if i is None else xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=42) - (1 << 64 if xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=42) >> 63 else 0)


def test_scores_against_loops(spark):
    import random

    rnd = random.Random(7)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("en", "st", "x", "ing", "é")]
    rows = [(i, " ".join(rnd.choice(words[: 8 + i % 30]) + rnd.choice(["", "", " the"]) for _ in range(rnd.randrange(25)))) for i in range(45)] + [(None, "aen the bst"), (50, None), (50, "new words the")]
    got = sorted(((r.doc_id, r.score) for r in lm.scores(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    want = sorted(plain_scores(rows), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4)


def test_factors_are_distributions():
    rng = np.random.default_rng(1)
    for wide in (lm.CLASSES, lm.PARTS):
        t = lm.Table(rng.standard_normal((64, wide)).astype(np.float16), rng.integers(0, 5000, 64).astype(np.float32), 64)
        t.open(True)
        prior = np.log(rng.random((50, wide)).astype(np.float32))
        rows = [rng.integers(0, 64, 50) for _ in range(3)]
        total = sum(np.exp(t.gains(prior, rows, np.full(50, y)) + prior[:, y]) for y in range(wide))
        assert np.allclose(total, 1, atol=1e-5)


def test_long_text(spark):
    text = "word other " * 300_000
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame([(1, text), (2, "other word")], SCHEMA)).collect()}
    assert got[1].n_tokens == 600_001 and got[1].score > got[1].base_score


def test_empty_and_clashing_columns(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", 1, "x"), (2, "b c", 2, "y")], SCHEMA + ", rid int, score string")
    assert lm.scores(df).count() == 2
    # a single row that is held out: nothing to learn from
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.scores(spark.createDataFrame([(held, "a b")], SCHEMA)).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 3 and abs(r.base_score) < 1e-9
