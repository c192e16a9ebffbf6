"""Personal data, by patterns and by information-theoretic sanitisation.

Patterns find the protected entities: addresses, card and telephone numbers.  The corpus then says how strongly the
words of a text reveal an entity in it.  With n(t), n(e) and n(t, e) the numbers of different texts that hold a term, an entity and both, and N that of all
texts, a term discloses an entity if

    n(t, e) >= SHARE * n(t)    and    log2(n(t, e) * N / (n(t) * n(e))) >= BITS

and if chance is ruled out: a word must meet the entity in ``CONTEXTS`` texts and different contexts (the words near the entity; those that share a band of
minimal hashes are near copies, and count as one), as any rare word meets one text's entity once; an identifier, of ``IDENTIFIER`` characters or more with a digit among them, says by itself whose it is, and once is enough.
Such terms are marked wherever they stand in a text with that entity, and sanitising generalises entities and terms to their kinds.

Counts cover all texts.  Only words of texts whose entities have enough contexts and counts of candidate terms are shuffled; the texts are not.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, stored, text_chunks
from .components import components
from .membership import build, maybe
from .words import ALNUM, U, bounds, hashes, mix

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that make its context, different contexts, share of a term's texts, and bits of mutual information.
NEAR, CONTEXTS, SHARE, BITS = 6, 3, 0.5, 8.0
#: Bands of a context, and minimal hashes in each.
BANDS, HASHES = 4, 2
#: Characters of an identifier, at least.
IDENTIFIER = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ with the run of local characters before it, if a domain with a dot follows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans in code points by kind, leftmost and not overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _text(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _h(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _fold(text: str) -> str:
    return text.translate(_FOLD)


_FOLD = {i: i + 32 for i in range(65, 91)}


def _term_hashes(words: list[str]) -> np.ndarray:
    parts = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    return hashes(np.frombuffer(b"".join(parts), np.uint8), starts, ends).view(np.int64)


def _terms(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """All words of a text that no entity overlaps."""
    every = sorted(s for k in KINDS for s in spans[k])
    out, i, reach = [], 0, 0
    for m in _WORD.finditer(_fold(text)):
        while i < len(every) and every[i][0] < m.end():
            reach = max(reach, every[i][1])
            i += 1
        if reach <= m.start():
            out.append((m[0], m.start(), m.end()))
    return out


_SALTS = mix(np.arange(1, BANDS * HASHES + 1, dtype=U) * U(0xD6E8FEB86659FD93))[:, None]


def _bands(words: list[str]) -> list[int]:
    """Of a context's words: contexts with nearly the same words share one at least, others hardly."""
    if not words:
        return [0] * BANDS
    least = mix(_term_hashes(words).view(U)[None, :] ^ _SALTS).min(1).reshape(BANDS, HASHES)
    return mix(least[:, 0] * U(0x9E3779B97F4A7C15) + least[:, 1]).view(np.int64).tolist()


def _named(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """The entities of a text, each with the NEAR words before and after it as its context; words that an entity overlaps are no words."""
    words = _terms(text, spans)
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    out = []
    for k in KINDS:
        for a, b in spans[k]:
            before, after = bisect_right(ends, a), bisect_left(starts, b)
            near = words[max(0, before - NEAR) : before] + words[after : after + NEAR]
            near = [w[0] for w in near]
            out.append({"entity": _h(k + ":" + _fold(text[a:b])), "context": _h(" ".join(near)), "bands": _bands(near)})
    return out


_NAMED_TYPE = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("bands", pa.list_(pa.int64()))]))
_FOUND = "doc_id long, k1 long, k2 long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, named array<struct<entity:long,context:long,bands:array<long>>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *_keys(text))


def _keys(text) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _scan(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        found = [base_spans(t) for t in texts]
        base = [_text(f) for f in found]
        n = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
        sha = [hashlib.sha256(b.encode()).hexdigest() for b in base]
        named = [_named(t, f) if b else [] for t, f, b in zip(texts, found, base)]
        cols = [batch.column(0), batch.column(2), batch.column(3), *n, pa.array(base), pa.array(sha), pa.array(named, _NAMED_TYPE)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k1", "k2", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "named"])
    release()


def _term_counts(keyed: DataFrame, candidates: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, texts): in how many different texts each candidate term occurs.

    One row a term and batch is shuffled, and of texts with copies one a term and text.
    """
    context = keyed.sparkSession.sparkContext
    known, twice = context.broadcast(build(candidates.select("term").distinct())), context.broadcast(build(copied.select("k1")))

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            again, lo = maybe(twice.value, k1), 0
            for ids, buf, offs in text_chunks(iter([batch])):
                starts, ends, ptr = bounds(buf, offs, ALNUM)
                h = hashes(buf, starts, ends)
                hit = np.flatnonzero(maybe(known.value, h))
                doc = lo + np.searchsorted(ptr, hit, "right") - 1
                lo += len(ids)
                pair = np.unique(np.stack([h[hit].view(np.int64), doc], 1), axis=0)
                more = again[pair[:, 1]]
                term, n = np.unique(pair[~more, 0], return_counts=True)
                one, at = pair[more, 0], pair[more, 1]
                keys = [pa.array(np.concatenate([np.zeros(len(term), np.int64), k[at]])) for k in (k1, k2)]
                n = np.concatenate([n, np.zeros(len(one), np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([term, one])), pa.array(n), *keys], ["term", "texts", "k1", "k2"])

    got = keyed.select("doc_id", "text", "k1", "k2").mapInArrow(run, "term long, texts long, k1 long, k2 long")
    # rows of texts with copies have 0 texts: each text counts once
    each = got.groupBy("term", "k1", "k2").agg(F.sum("texts").alias("texts"), F.max((F.col("texts") == 0).cast("long")).alias("copied"))
    return each.groupBy("term").agg(F.sum(F.col("texts") + F.col("copied")).alias("texts"))


def _identifier(word: str) -> bool:
    return len(word) >= IDENTIFIER and _DIGIT.search(word) is not None


def _words_in(keyed: DataFrame, texts: DataFrame, *, whole: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(k1, k2, term, own, start, end) of words in ``texts``; wrong ones pass rarely, for joins to take away.

    With ``terms``: all places of those.  Otherwise one place of each word of the texts in ``whole``, and of each identifier (``own``) of the others.
    """
    context = keyed.sparkSession.sparkContext
    inside = context.broadcast(build(texts.select("k1").distinct()))
    known = context.broadcast(build((whole.select("k1") if terms is None else terms.select("term")).distinct()))
    some = terms is not None

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(maybe(inside.value, batch.column(1).to_numpy())))
            if not batch.num_rows:
                continue
            every = maybe(known.value, batch.column(1).to_numpy())
            for t, k1, k2, all_ in zip(*(c.to_pylist() for c in batch.columns), every.tolist()):
                words = _terms(t, base_spans(t))
                if not some and not all_:
                    words = [w for w in words if _identifier(w[0])]
                if not words:
                    continue
                h = _term_hashes([w[0] for w in words])
                at = np.flatnonzero(maybe(known.value, h.view(U))) if some else np.unique(h, return_index=True)[1]
                pick = [words[i] for i in at.tolist()]
                cols = [np.full(len(at), k1, np.int64), np.full(len(at), k2, np.int64), h[at], np.array([_identifier(w[0]) for w in pick], bool), np.array([w[1] for w in pick], np.int64), np.array([w[2] for w in pick], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k1", "k2", "term", "own", "start", "end"])
        release()

    return keyed.select("text", "k1", "k2").mapInArrow(run, "k1 long, k2 long, term long, own boolean, start long, end long")


def _different(named: DataFrame) -> DataFrame:
    """``named`` with near copies of a context of an entity under one context."""
    often = named.groupBy("entity").agg(F.countDistinct("context").alias("n")).where(F.col("n") >= CONTEXTS).select("entity")
    node = F.xxhash64("entity", "context")
    every = stored(named.join(often, "entity", "left_semi").select("entity", "context", "bands").distinct().withColumn("node", node))
    banded = every.select("entity", "node", F.posexplode("bands").alias("i", "band"))
    least = banded.groupBy("entity", "i", "band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    label = components(banded.join(least, ["entity", "i", "band"]).select(F.col("node").alias("a"), "b"))
    one = every.join(label, "node").select("entity", "context", "component")
    return named.join(one, ["entity", "context"], "left").select("k1", "k2", "entity", F.coalesce("component", node).alias("context")).distinct()


def _disclosing(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """(entity, term) of the terms that disclose an entity.  Copies of a text count once on every side."""
    named = stored(_different(named))
    entities = stored(named.groupBy("entity").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("k1", "k2").alias("named")))
    # a word has no more contexts than its entity
    often = stored(named.join(entities.where(F.col("contexts") >= CONTEXTS).select("entity"), "entity", "left_semi").select("k1").distinct())
    words = stored(_words_in(keyed, named, whole=often).select("k1", "k2", "term", "own").distinct())
    each = named.join(words, ["k1", "k2"])
    contexts = each.select("entity", "term", "own", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.max("own").alias("own"))
    contexts = contexts.where(F.col("own") | (F.col("contexts") >= CONTEXTS))
    both = each.select("entity", "term", "k1", "k2").distinct().groupBy("entity", "term").agg(F.count("*").alias("both"))
    pairs = stored(contexts.join(both, ["entity", "term"]).where(F.col("own") | (F.col("both") >= CONTEXTS)).select("entity", "term", "both"))
    texts = stored(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")))
    total = texts.count()
    seen = pairs.join(_term_counts(keyed, pairs, texts.where("n > 1")), "term").join(entities, "entity")
    bits = F.log2(F.col("both") * total / (F.col("texts") * F.col("named")))
    return seen.where((F.col("both") >= F.col("texts") * SHARE) & (bits >= BITS)).select("entity", "term")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and k1, k2 (a hash of the text).

    spans lists kind:start:end in code points, end exclusive: the patterns' spans by kind, then the disclosing terms (kind term).
    Null texts are empty and have no spans. Null ids and repeated rows are kept; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    found = stored(keyed.mapInArrow(_scan, _FOUND))
    named = stored(found.where(F.size("named") > 0).select("k1", "k2", F.explode("named").alias("x")).select("k1", "k2", "x.*").distinct())
    flagged = stored(_disclosing(keyed, named))
    marked = stored(named.select("k1", "k2", "entity").join(flagged, "entity").select("k1", "k2", "term").distinct())
    places = _words_in(keyed, marked, terms=flagged).select("k1", "k2", "term", "start", "end").distinct().join(marked, ["k1", "k2", "term"])
    more = places.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    more = more.select("k1", "k2", F.array_join(F.transform("more", lambda s: F.concat(F.lit("term:"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",").alias("added"))
    out = found.drop("named").join(more, ["k1", "k2"], "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("added"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), "k1", "k2")


def _redact(text: str, spans: str) -> str:
    """Entities and terms replaced by their kinds; of overlapping spans the first, then the longest, names the whole."""
    cut = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    out, at, open_ = [], 0, None
    for a, b, k in cut:
        if open_ and a < open_[1]:
            open_ = (open_[0], max(open_[1], -b), open_[2])
            continue
        if open_:
            out += [text[at : open_[0]], f"[{open_[2].upper()}]"]
            at = open_[1]
        open_ = (a, -b, k)
    if open_:
        out += [text[at : open_[0]], f"[{open_[2].upper()}]"]
        at = open_[1]
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in its text generalised to [EMAIL], [IP], [CARD], [PHONE] and [TERM]; rows and columns stay.

    A null text stays null.  Texts with nothing to take away pass without a shuffle; the others are joined with their spans by a
    hash of the text.
    """
    found = find(docs, id_col=id_col, text_col=text_col)
    marked = stored(found.where("spans <> ''").select("k1", "k2", "spans").dropDuplicates(["k1", "k2"]))
    known = docs.sparkSession.sparkContext.broadcast(build(marked.select("k1")))
    names, at = docs.columns, docs.columns.index(text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wide = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), *_keys(text))

    def part(inside: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(maybe(known.value, b.column(1).to_numpy()) == inside))

        return run

    def apply(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            spans = b.column(len(names)).to_pylist()
            new = pa.array([_redact(t, s) if t and s else t for t, s in zip(texts, spans)], b.column(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 : len(names)]], names)

    clean = wide.mapInArrow(part(False), wide.schema).select("row.*")
    # stored, so that no stage holds two Python nodes and with them two workers a task
    some = stored(wide.mapInArrow(part(True), wide.schema)).join(marked, ["k1", "k2"], "left").select("row.*", F.col("spans").alias("__spans"))
    return clean.unionByName(some.mapInArrow(apply, docs.schema))
