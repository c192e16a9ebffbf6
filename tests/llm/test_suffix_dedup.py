"""Repeated passages against brute force over all 50-byte strings."""

import hashlib
import random

from siltstone.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        key = float("inf") if i is None else i
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, float("inf")), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        key = float("inf") if i is None else i
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key:
                gone[p : p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)


def fixture():
    random.seed(5)
    word = lambda: "".join(random.choice("abcdéf ") for _ in range(random.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = []
    for i in range(90):
        t = text(random.randint(0, 40))
        for s in random.sample(shared, random.randint(0, 2)):
            a = random.randint(0, len(s) // 2)
            t += s[a : a + random.randint(20, 160)] + text(random.randint(0, 6))
        rows.append((i, t))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "short"), (203, "short"), (204, ""), (205, None), (None, rows[5][1]), (None, None), (7, rows[8][1])]
    rows += [(300, "x" * 400), (301, "x" * 120), (302, rows[3][1][:49])]
    random.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(S.repeated_passages(df)) == brute(rows)


def test_many_small_blocks(spark):
    rows = fixture()
    # every row its own partition, and so its own block
    assert got(S.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(len(rows)))) == brute(rows)


def test_hot_anchors_are_dealt_by_strings(spark, monkeypatch):
    rows = fixture()
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "SORTED", 200)  # many key ranges
    assert got(S.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """With hashes of 2 bits nearly all anchors meet; only bytes decide."""
    import numpy as np

    rows = fixture()[:60]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    real = S.mix
    monkeypatch.setattr(S, "mix", lambda x: real(x) & np.uint64(3 << 62))
    blocks = [S.Block({k: v for k, v in b.to_pylist()[0].items()}) for b in local_blocks(rows)]
    n = 3
    runs = []
    for x in blocks:
        keys, _, _ = x.anchors()
        every, none = np.ones(len(keys), bool), np.zeros(len(keys), bool)
        rows_, new, group, least, doc, at = x.suffixes(every, none, n)
        runs.append((x, rows_, new, group, least, doc, at))
    monkeypatch.undo()
    assert len({bytes(r[1][i, :4]) for r in runs for i in r[2]}) <= 3
    want = {r[0]: r[2] for r in brute(rows) if r[0] is not None}
    # all key ranges at once
    parts = [(r[1][r[2]][:, 4:54], r[1][r[2]][:, 54:-2], r[1][r[2]][:, -2].astype(int), r[1][r[2]][:, -1].astype(int), r[4]) for r in runs]
    right, left, near, far, ids = (np.concatenate(c) for c in zip(*parts))
    o = np.argsort(np.ascontiguousarray(right).view("S50").ravel(), kind="stable")
    bits = np.zeros(len(ids), np.uint32)
    bits[o] = S._held_before(S._shared_with_last(right[o]), left[o], near[o], far[o], ids[o])
    edge = np.concatenate([[0], np.cumsum([len(p[4]) for p in parts])])
    for k, (x, rows_, new, group, least, doc, at) in enumerate(runs):
        mine = np.where(x.ids[doc] > least[group], 0xFFFFFFFF, bits[edge[k] : edge[k + 1]][group])
        gone = np.zeros(len(x.buf), bool)
        for b, p, lo, hi in zip(mine.tolist(), at.tolist(), rows_[:, -2].tolist(), rows_[:, -1].tolist()):
            for j in range(lo, hi + 1):
                if b >> j & 1:
                    gone[p - j : p - j + 50] = True
        for d, i in enumerate(x.ids.tolist()):
            if i in want and i != 7:
                assert gone[x.offs[d] : x.offs[d + 1]].sum() == want[i]


def local_blocks(rows):
    """The rows as two blocks, made without Spark."""
    import pyarrow as pa

    class Here:
        @staticmethod
        def get():
            return Here()

        def partitionId(self):
            Here.n = getattr(Here, "n", -1) + 1
            return Here.n

    was, S.TaskContext = S.TaskContext, Here
    try:
        out = []
        for part in (rows[:30], rows[30:]):
            out += list(S._blocks(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part])], ["doc_id", "text"])])))
        return out
    finally:
        S.TaskContext = was


def test_loser_tree_compares_nothing_twice():
    random.seed(3)
    for runs in (1, 2, 3, 5, 8, 13):
        data = [sorted("".join(random.choices("ab", k=8)).encode() for _ in range(random.randint(0, 40))) for _ in range(runs)]
        flat = [x for r in data for x in r]
        common = lambda a, b: next((i for i in range(8) if a[i] != b[i]), 8)
        shared = [common(r[i - 1], r[i]) if i else 0 for r in data for i in range(len(r))]
        edges = [sum(map(len, data[:k])) for k in range(runs + 1)]
        order, got_common = S.loser_tree(b"".join(flat), 8, edges, shared)
        merged = [flat[i] for i in order]
        assert merged == sorted(flat) and sorted(order) == list(range(len(flat)))
        assert got_common == [common(merged[i - 1], merged[i]) if i else 0 for i in range(len(merged))]


def test_runs_round_trip():
    import numpy as np

    rng = np.random.default_rng(2)
    right = rng.integers(0, 3, (500, S.LENGTH)).astype(np.uint8)
    near = rng.integers(0, 20, 500)
    right[np.arange(S.LENGTH)[None, :] >= (S.LENGTH - near)[:, None]] = 0
    o = np.argsort(np.ascontiguousarray(right).view(f"S{S.LENGTH}").ravel(), kind="stable")
    right, near = right[o], near[o]
    far = rng.integers(0, S.BEFORE + 1, 500)
    left = rng.integers(0, 255, (500, S.BEFORE)).astype(np.uint8)
    left[np.arange(S.BEFORE)[None, :] >= far[:, None]] = 0
    ids = rng.integers(-5, 5, 500)
    back = S.run_decoded(S.run_coded(right, left, near, far, ids))
    for a, b in zip((right, left, near, far, ids), back):
        assert np.array_equal(a, b)


def test_no_table_is_left(spark):
    S.repeated_passages(spark.createDataFrame([(1, "a" * 60)], SCHEMA)).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siltstone")]


def test_empty_and_clashing_columns(spark):
    assert S.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a" * 60, 3, "x"), (2, "b" + "a" * 60, 4, "y")], "doc_id long, text string, block int, ids string")
    assert got(S.repeated_passages(df)) == brute([(1, "a" * 60), (2, "b" + "a" * 60)])


def test_front_coding_round_trip():
    import numpy as np

    for x in ([], [0], [5, 5, 9], sorted(random.getrandbits(64) for _ in range(1000)), sorted(random.getrandbits(44) for _ in range(1000))):
        a = np.array(x, np.uint64)
        assert (S.decoded(S.front_coded(a)) == a).all()
