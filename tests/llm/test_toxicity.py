"""Toxicity: likelihoods against plain Kneser-Ney sums, recall and false alarms on rows held out of the fit, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import queries
from siltstone.llm import toxicity as T

SCHEMA = "doc_id long, text string"


def made(n):
    random.seed(9)
    words = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        t = [random.choice(words) for _ in range(random.randint(20, 200))]
        y = int(random.random() < 0.2)
        for _ in range(3 * y):
            t.insert(random.randrange(len(t)), random.choice(["Vile", "nasty", "awful."]))
        docs.append((i, " ".join(t)))
        labels.append((i, y))
    return docs, labels


def plain_model(docs, toxic):
    """The difference of the log-likelihoods of a word, letter by letter, from dictionaries."""
    before = [defaultdict(set), defaultdict(set)]
    for i, text in docs:
        last = None
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            before[toxic[i]][w.encode()].add(last)
            last = w
    c = [Counter(), Counter()]
    for k in (0, 1):
        for w, prev in before[k].items():
            spelled = w[: T.LETTERS] + b"\0"
            for n in range(1, len(spelled) + 1):
                c[k][spelled[:n]] += len(prev)
    both = c[0] + c[1]
    after = defaultdict(list)
    for h in both:
        after[h[:-1]].append(h)
    pairs = Counter((h[-2:-1] or b"\0", h[-1:]) for h in both)
    d = T.DISCOUNT

    def q(y, x):
        return (pairs[y, x] + T.FLOOR) / (sum(n for (a, _), n in pairs.items() if a == y) + 256 * T.FLOOR)

    def p(k, h, hx):
        kinds = after[h]
        g = d * len(kinds) / sum(both[x] for x in kinds)
        r = max(both[hx] - d, 0) / sum(max(both[x] - d, 0) for x in kinds)
        seen = sum(c[k][x] for x in kinds)
        own = (max(c[k][hx] - d, 0) + d * sum(c[k][x] > 0 for x in kinds) * r) / seen if seen else r
        return (1 - g) * own + g * q(h[-1:] or b"\0", hx[-1:])

    def difference(w):
        spelled, total = w[: T.LETTERS] + b"\0", 0.0
        for n in range(1, len(spelled) + 1):
            if spelled[:n] not in both:
                break
            total += math.log(p(1, spelled[: n - 1], spelled[:n]) / p(0, spelled[: n - 1], spelled[:n]))
        return total

    return difference


def test_likelihoods_against_plain_sums(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcé", k=rnd.randint(1, 5))) for _ in range(40)] + ["x" * 15, "x" * 16, "x" * 16 + "y", "x" * 17 + "z"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    toxic = {i: rnd.randrange(2) for i, _ in docs}
    sample = spark.createDataFrame([(t, toxic[i], i % T.FOLDS) for i, t in docs], "text string, toxic int, fold int").repartition(3)
    counts = T._counts(sample).toArrow()
    for fold in range(T.FOLDS):  # the model without a fold is that of the other texts
        part = T.Model.of(counts, f"_{fold}")
        other = plain_model([d for d in docs if d[0] % T.FOLDS != fold], toxic)
        raw = np.frombuffer(words[0].encode(), np.uint8)
        assert part.words(T._spelled(raw, np.array([0]), np.array([len(raw)])))[0] == pytest.approx(other(words[0].encode()), abs=1e-4)
    model, want = T.Model.of(counts), plain_model(docs, toxic)
    for w in [*words, "abz", "zz", "x" * 14, "cé"]:
        raw = np.frombuffer(w.encode(), np.uint8)
        got = model.words(T._spelled(raw, np.array([0]), np.array([len(raw)])))[0]
        assert got == pytest.approx(want(w.encode()), abs=1e-4), w
    a, b = words[0], words[1]
    buf = np.frombuffer(f"{a} {b}, {a}".encode(), np.uint8)
    mean, top, three = model.evidence(buf, np.array([0, len(buf)]))[0]
    each = sorted(want(w.encode()) for w in (a, b, a))
    assert (mean, top, three) == pytest.approx((sum(each) / 3, each[-1], sum(each) / 3), abs=1e-4)


def test_copies_add_nothing(spark):
    rows = [("a b c", 0, 0), ("d e", 1, 1)]
    more = rows + [("d e", 1, 1) for k in range(3, 30)]
    frames = [spark.createDataFrame(x, "text string, toxic int, fold int") for x in (rows, more)]
    one, two = (sorted((bytes(r.letters), r.c0, r.c1) for r in T._counts(f).collect()) for f in frames)
    assert one == two


def rates(rows, y):
    """(share of toxic texts found, share of others rejected) among held-out rows."""
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in y]
    toxic = [r.predicted for r in held if y[r.doc_id] == 1]
    clean = [r.predicted for r in held if y[r.doc_id] == 0]
    return sum(toxic) / len(toxic), sum(clean) / len(clean)


def test_held_out_recall(spark):
    docs, labels = made(3000)
    train = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    out = T.toxicity(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(train, "doc_id long, toxic int")).collect()
    found, wrong = rates(out, dict(labels))
    assert len(out) == 3000 and found > 0.97 and wrong < 0.01


def test_query_on_documents(spark, sf):
    at = sf.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    out = queries.queries()["op7_toxicity"](spark, at).collect()
    found, wrong = rates(out, labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert found > 0.84 and wrong < 0.005  # some 270 toxic texts in four languages to learn from


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "c", "x")], SCHEMA + ", score string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    out = T.toxicity(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.toxicity(docs, none).collect()} == {0.5}
    assert T.toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert T.remove_toxic(docs, none).columns == docs.columns and T.remove_toxic(docs, none).count() == 4
