"""Patterns against plain regular expressions, disclosing terms, and sanitised texts."""

import hashlib
import math
import random
import re
from collections import Counter

from siltstone.llm import pii as P

SCHEMA = "doc_id long, text string"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def digest(t):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t))


def test_patterns_on_random_texts():
    random.seed(6)
    parts = ["a@b.co", "@", ".", "x", "é", "1", "22", "255", "256", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 123456", "a.b%c@d-e.f.g", "0001", "@@", "😀", "\n", "٣"]
    for _ in range(6000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert P._text(P.base_spans(t)) == digest(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300000, "1." * 150000, "a" * 300000 + "@", "+" + "1-" * 150000, "a@" * 100000):
        P.base_spans(t)


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    for r in P.find(df).collect():
        want = brute(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(digest(text[r.doc_id]).encode()).hexdigest()
        assert r.spans.startswith(digest(text[r.doc_id]))


def corpus():
    random.seed(8)
    words = [f"word{i}" for i in range(300)]
    fill = lambda n: " ".join(random.choice(words) for _ in range(n))
    rows = [(10000 + i, fill(40)) for i in range(2500)]
    rows += [(1000 + i, f"{fill(10)} Zorblax {fill(2)} jane@corp.example.com {fill(10)}") for i in range(5)]
    return rows + [(2000, None), (2001, ""), (None, "x jane@corp.example.com"), (1000, "call +49 30 1234567 now")]


def test_terms_that_disclose_an_entity(spark):
    rows = corpus()
    got = {(r.doc_id, r.n_phone): r.spans for r in P.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, t in rows[2500:2505]:
        a = t.index("Zorblax")
        assert got[i, 0] == f"{digest(t)},term:{a}:{a + 7}"
    assert got[None, 0] == "email:2:23" and got[2000, 0] == "" and all(got[10000 + i, 0] == "" for i in range(2500))


def test_copies_of_a_context_disclose_nothing(spark):
    rows = [(i, "the same Zorblax text jane@corp.example.com all over") for i in range(50)] + [(100 + i, "plain") for i in range(2000)]
    assert all("term" not in r.spans for r in P.find(spark.createDataFrame(rows, SCHEMA)).collect())


def test_copies_of_a_text_hide_nothing(spark):
    rows = corpus()
    rows += [(3000 + i, rows[2500][1]) for i in range(40)]  # one of five disclosing texts has 40 copies
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all("term:" in got[i] for i in (*range(1001, 1005), 3000, 3039))


def test_terms_far_from_their_entity(spark):
    far = " ".join(f"filler{i % 7}" for i in range(60))
    rows = corpus()
    near = lambda i, side: " ".join(f"{side}{i}{k}" for k in range(6))  # noqa: E731  # each text has other words beside the entity
    rows += [(3000 + i, f"Quuxley {far} {near(i, 'a')} bob@corp.example.com {near(i, 'b')} {far} quuxley") for i in range(4)]
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, t in rows[-4:]:
        assert {"term:0:7", f"term:{len(t) - 7}:{len(t)}"} <= set(got[i].split(","))


def plain_terms(rows):
    """(entity, term) pairs that disclose, from tables of counts in dictionaries; and the places in each text."""
    texts = {t or "" for _, t in rows}
    words, named = {}, {}
    for t in texts:
        cut = [(a, b) for _, a, b in brute(t)]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        words[t] = [(m[0], *m.span()) for m in re.finditer("[0-9a-z\u0080-\U0010ffff]+", low) if not any(a < m.end() and m.start() < b for a, b in cut)]
        for k, a, b in brute(t):
            before, after = [w[0] for w in words[t] if w[2] <= a], [w[0] for w in words[t] if w[1] >= b]
            named.setdefault((k, low[a:b]), []).append((t, tuple(before[-6:] + after[:6])))
    for e, places in named.items():  # contexts that share a band, directly or through others, are one
        one = {c: c for _, c in places}
        for _ in one:
            for c in one:
                for d in one:
                    if set(enumerate(P._bands(list(c)))) & set(enumerate(P._bands(list(d)))):
                        one[c] = one[d] = min(one[c], one[d])
            if len(one) < 2:
                break
        named[e] = [(t, one[c]) for t, c in places]
    n_term = Counter(w for t in texts for w in {x[0] for x in words[t]})
    found = set()
    for e, places in named.items():
        mine = {t for t, _ in places}
        for w in {x[0] for t in mine for x in words[t]}:
            with_ = [(t, c) for t, c in places if any(x[0] == w for x in words[t])]
            both = len({t for t, _ in with_})
            own = len(w) >= 6 and any(c in "0123456789" for c in w)
            if (own or len({c for _, c in with_}) >= 3 and both >= 3) and both >= 0.5 * n_term[w] and math.log2(both * len(texts) / (n_term[w] * len(mine))) >= 8:
                found.add((e, w))
    out = {}
    for t in texts:
        here = {w for e, w in found if any(x == t for x, _ in named[e])}
        out[t] = [f"term:{a}:{b}" for w, a, b in words[t] if w in here]
    return out


def with_terms(spark, rows):
    want = plain_terms(rows)
    for r, t in ((r, t) for r in P.find(spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], SCHEMA + ", k int").selectExpr("k as doc_id", "text").repartition(3)).collect() for t in [rows[r.doc_id][1] or ""]):
        assert r.spans == ",".join([digest(t)] * bool(digest(t)) + want[t]), t
    return sum(map(len, want.values()))


def test_terms_against_plain_counts(spark):
    rnd = random.Random(12)
    rows = corpus()
    people = [(f"p{i}@x{i % 3}.example.org", f"name{'abcdefgh'[i]}") for i in range(8)]
    for i in range(90):
        mail, name = rnd.choice(people)
        parts = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(40))] + [mail] * rnd.randrange(1, 3) + [name] * rnd.randrange(3) + [rnd.choice(["order-AB12345", "Ref7788990011", "nothing"])] + [f"id{rnd.randrange(9)}{rnd.randrange(10**6)}"]
        rnd.shuffle(parts)
        rows.append((5000 + i, rnd.choice([" ", ", "]).join(parts)))
    rows += [(6000 + i, rows[-1][1]) for i in range(5)]
    assert with_terms(spark, rows) > 50


def test_terms_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()]
    assert with_terms(spark, rows) > 0


def test_near_copies_disclose_nothing(spark):
    rnd = random.Random(3)
    rows = corpus()
    text = "".join(f"{w} " for w in ["rarest", *(f"strange{'abcdefghij'[i]}" for i in range(10))]) + "bob@corp.example.com " + "".join(f"odd{'abcdefghij'[i]} " for i in range(10))
    for i in range(60):
        words = text.split()
        words[rnd.choice([3, 4, 5, 6, 7, 8, 9, 12, 13, 14])] = f"other{'abcdefghijklmnopqrst'[rnd.randrange(20)]}"
        rows.append((7000 + i, " ".join(words)))
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all("term:" not in got[7000 + i] for i in range(60)) and "term:" in got[1001]


def test_sanitised_texts(spark):
    rows = [(*r, k, "z") for k, r in enumerate(corpus())]
    df = spark.createDataFrame(rows, SCHEMA + ", k1 int, spans string").repartition(3)
    out = P.sanitise(df)
    got = {r.k1: r.text for r in out.collect()}
    assert out.columns == df.columns and len(got) == len(rows)
    for i, t, k, _ in rows:
        want = t if t is None else t.replace("jane@corp.example.com", "[EMAIL]").replace("Zorblax", "[TERM]").replace("+49 30 1234567", "[PHONE]")
        assert got[k] == want


def test_empty(spark):
    assert P.find(spark.createDataFrame([], SCHEMA)).count() == 0 and P.sanitise(spark.createDataFrame([], SCHEMA)).count() == 0
