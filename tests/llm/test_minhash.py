"""Near duplicates against all pairs."""

import random
import re

import pytest

from siltstone.llm import minhash as M

SCHEMA = "doc_id long, text string"


def shingled(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, percent):
    sets = [(i, shingled(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def fixture(seed, groups, copies):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = [random.choice(words) for _ in range(random.randint(1, 120))]
        for _ in range(random.choice([1, 1, 2, copies])):
            t = list(base)
            for _ in range(random.randint(0, 6)):
                t[random.randrange(len(t))] = random.choice(words).upper()
            rows.append((i, random.choice([" ", "\n", " \t "]).join(t)))
            i += 1
    rows += [(i, ""), (i + 1, None), (i + 2, "  \n"), (i + 3, rows[3][1]), (None, rows[3][1]), (i + 4, "one"), (i + 5, "One"), (2, rows[2][1])]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    rows = fixture(1, 60, 20)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(M.near_duplicates(df, width=width, percent=percent)) == brute(rows, width, percent)


def test_large_group_goes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "SHORT_LIST", 4)
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = fixture(2, 12, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(M.near_duplicates(df, width=3, percent=85)) == brute(rows, 3, 85)


def test_empty_and_clashing_columns(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "A b c d e f", 6, "y")], "doc_id long, text string, rep int, kept string")
    assert got(M.near_duplicates(df)) == [(1, 2, 1, True), (2, 2, 1, False)]
    assert got(M.near_duplicates(spark.createDataFrame([(1, None), (2, None)], SCHEMA))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_long_text(spark):
    t = " ".join(f"x{i}" for i in range(60000)) + " " + "y" * (3 << 20)
    assert got(M.near_duplicates(spark.createDataFrame([(1, t), (2, t + " z")], SCHEMA), width=3, percent=85)) == [(1, 59999, 1, True), (2, 60000, 1, False)]
