"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(part | class, history) * P(word | class, part).  The frequent words and the end of a text are classes of
their own, other words fall into classes by their last letters, and the words of such a class into parts by a hash.  Both conditional factors are softmaxes over hashed
features of the history: the word before, the word before that (a skip), and the pair of them.  P(word | class, part)
comes from smoothed counts, so a text's log-probability is its unigram base score plus what classes and parts
gain over their own frequencies: known words share 1 - e, an unknown one has e = 0.1 / (N + 0.1 (V + 1)).

Training is synchronous and depends on no layout of the rows.

1. The gradient at zero weights needs only how often each feature meets each class (or part): counts over all training texts, summed in blocks
   of rows.  The step from there is taken in closed form, a row at a time: w = log((c + A q) / ((n + A) q)), q the class's own share.
2. Features overlap, so each row's step gets a rate, one for each kind of feature and size of n.  ``ROUNDS`` rounds of distributed gradient
   (and second derivative) sums train them; round r takes the texts whose id hashes to r, so that each text serves once, and a token's own count is left out.

The tables have as many rows as there are distinct words, up to ``ROWS``, as they are broadcast.  Head counts are broadcast (``HEAD`` words at most), rarer words are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, stored, text_chunks
from .words import LOWER, NOT_SPACE, U, bounds, hashes, mix

#: Words whose counts are broadcast; classes of frequent words (the end is the first) and of word endings; parts of each of the latter.
HEAD, FREQUENT, ENDINGS, PARTS = 1 << 17, 16, 16, 32
CLASSES = FREQUENT + ENDINGS
#: Rows of each of the two tables of weights: at most, at least, and in a block that is summed together.
ROWS, FEWEST, TOGETHER = 1 << 18, 1 << 12, 256
#: Kinds of features, sizes of n (powers of two) with a rate of their own, weight of the prior A, rounds of the rates, and how much of a Newton step each takes.
KINDS, SIZES, PRIOR, ROUNDS, STEP = 3, 12, 10.0, 4, 0.7
#: Tokens that a pass looks at together: their rows fit in a cache.
TOKENS = 1 << 12
END = np.uint64(0x0E0D_0F7E_1700_0001)

_LAST = (mix(np.arange(65536, dtype=U)) % U(ENDINGS)).astype(np.int64)
_SALTS = (U(0x51ED270B), U(0xB5297A4D), U(0x68E31DA4))


def _part(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U(0x1B56C4E9)) % U(PARTS)).astype(np.int64)


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of each text with its end, ending classes (of the end: 0), and where each text begins (one more at the end)."""
    starts, ends, ptr = bounds(buf, offs, NOT_SPACE)
    docs = len(offs) - 1
    place = np.arange(len(starts)) + np.repeat(np.arange(docs), np.diff(ptr))
    h, k = np.full(len(starts) + docs, END, U), np.zeros(len(starts) + docs, np.int64)
    h[place] = hashes(buf, starts, ends)
    if len(starts):
        last = LOWER[buf[ends - 1]].astype(np.int64)
        before = np.where(ends - starts > 1, LOWER[buf[np.maximum(ends - 2, 0)]], 0).astype(np.int64)
        k[place] = FREQUENT + _LAST[last * 256 + before]
    return h, k, ptr + np.arange(docs + 1)


def _counts(train: DataFrame) -> DataFrame:
    """(w, k, s, c): each distinct training token, its ending class, its part of that class, its count."""

    def run(batches):
        have: list[tuple] = []
        size = 0

        def merged():
            h, k, c = (np.concatenate(x) for x in zip(*have))
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, k[at], np.bincount(inv, c, len(u)).astype(np.int64)

        def out():
            u, k, c = merged()
            for lo in range(0, len(u), 1 << 17):
                s = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(u[s].view(np.int64)), pa.array(k[s].astype(np.int32)), pa.array(_part(u[s]).astype(np.int32)), pa.array(c[s])], ["w", "k", "s", "c"])

        for _, buf, offs in text_chunks(batches):
            h, k, _ = _tokens(buf, offs)
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            have.append((u, k[at], n))
            size += len(u)
            if size > 2_000_000:
                have[:] = [merged()]
                size = len(have[0][0])
                if size > 1_500_000:  # memory of a worker is bounded; the shuffle sums the rest
                    yield from out()
                    have, size = [], 0
        if have:
            yield from out()

    got = train.mapInArrow(run, "w long, k int, s int, c long")
    return got.groupBy("w").agg(F.first("k").alias("k"), F.first("s").alias("s"), F.sum("c").alias("c"))


class Table:
    """One factor's weights: rows of features, a column for each of its outcomes.  Of every ``each`` rows the kinds of features have a quarter, a quarter and half."""

    def __init__(self, weights: np.ndarray, n: np.ndarray, each: int):
        self.weights, self.n = weights, n
        self.size = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), SIZES - 1)
        self.kind = np.minimum(np.arange(len(n)) % each * 4 // each, KINDS - 1)
        self.rates = np.full((KINDS, SIZES), 1 / KINDS, np.float32)
        self.scaled = False

    def open(self, scaled: bool) -> None:
        """In a worker, once: half precision travels, single precision is worked with; ``scaled`` by the rates for scoring."""
        if self.weights.dtype == np.float16:
            self.weights = self.weights.astype(np.float32)
        if scaled and not self.scaled:
            self.weights *= self.rates[self.kind, self.size][:, None]
            self.scaled = True

    def gains(self, prior: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """By how much the log-probabilities of the outcomes ``y`` exceed their log-shares: scaled weights only."""
        z = prior.copy()
        part = np.empty_like(z)
        for r in rows:
            np.take(self.weights, r, axis=0, out=part, mode="clip")
            z += part
        at = np.arange(len(y))
        own = z[at, y] - prior[at, y]
        np.exp(z, out=z)
        return own - np.log(z.sum(1))

    def gradient(self, prior: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and (negative) second derivatives by the rates of the log-likelihood of ``y``, each token's own count left out."""
        at = np.arange(len(y))
        q = PRIOR * np.exp(prior[at, y])
        z, each = prior.copy(), []
        for f, r in enumerate(rows):
            w, n = self.weights[r], self.n[r]
            smoothed = np.maximum(np.exp(w[at, y]) * (n + PRIOR) * (q / PRIOR), q)  # c + A q
            w[at, y] += np.log(np.maximum(smoothed - 1, q) / smoothed)
            size = np.minimum(np.log2(np.maximum(n - 1, 1)).astype(np.int64), SIZES - 1)
            z += w * self.rates[f, size][:, None]
            each.append((w, size))
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        first, second = np.zeros((KINDS, SIZES)), np.zeros((KINDS, SIZES))
        for f, (w, size) in enumerate(each):
            pw = z * w
            mean = pw.sum(1)
            first[f] = np.bincount(size, w[at, y] - mean, SIZES)
            second[f] = np.bincount(size, np.einsum("ij,ij->i", pw, w) - mean * mean, SIZES)
        return first, second


class Model:
    """Frequent words as classes, the shares of classes and parts, and the two tables."""

    def __init__(self, words: np.ndarray, mass: np.ndarray, rows: int):
        """``mass``: of each class and part."""
        self.words, self.order, self.rows = np.sort(words), np.argsort(words), rows
        share = mass.sum(1)
        self.log_class = np.log(share / share.sum()).astype(np.float32)
        self.log_part = np.log(mass / share[:, None]).astype(np.float32)
        self.tables: list[Table] = []

    def classes(self, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = k.copy()
        if len(self.words):
            i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[i] == h
            out[hit] = 1 + self.order[i[hit]]
        return out

    def features(self, h: np.ndarray, ptr: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows, in the table of classes and in that of parts, of the word before, of the one before that, and of both; ``y`` are the classes.

        The table of parts has rows of its own for each class.  What it says of a frequent word is of no use.
        """
        one = np.concatenate([np.zeros(1, U), h[:-1]])
        one[ptr[:-1]] = U(1)
        two = np.concatenate([np.zeros(1, U), one[:-1]])
        two[ptr[:-1]] = U(2)
        keys = [mix(x ^ salt) for x, salt in zip((one, two, one * U(0x9FB21C651E98DF25) + two), _SALTS)]

        def placed(keys: list[np.ndarray], each: int) -> list[np.ndarray]:
            return [lo + (x & U(n - 1)).astype(np.int64) for x, lo, n in zip(keys, (0, each // 4, each // 2), (each // 4, each // 4, each // 2))]

        each = self.rows // ENDINGS
        base = np.maximum(y - FREQUENT, 0) * each
        return placed(keys, self.rows), [base + x for x in placed([x >> U(32) for x in keys], each)]

    def open(self, scaled: bool) -> None:
        for t in self.tables:
            t.open(scaled)

    def shares(self, table: int) -> np.ndarray:
        """Log-shares of the outcomes, for each row of a table."""
        return np.broadcast_to(self.log_class, (self.rows, CLASSES)) if table == 0 else np.repeat(self.log_part[FREQUENT:], self.rows // ENDINGS, 0)


def _parts_of(chunks, model: Model):
    """(ids, h, ptr, classes, parts, rows of classes, rows of parts) of each chunk of texts."""
    for ids, buf, offs in chunks:
        h, k, ptr = _tokens(buf, offs)
        y = model.classes(h, k)
        yield ids, h, ptr, y, _part(h), *model.features(h, ptr, y)


def _count_features(train: DataFrame, model: Model) -> None:
    """The tables after the closed-form step."""
    known = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = known.value
        count = [np.zeros((m.rows, CLASSES), np.int32), np.zeros((m.rows, PARTS), np.int32)]
        for _, _, _, y, part, *rows in _parts_of(text_chunks(batches, 1 << 20), m):
            some = np.flatnonzero(y >= FREQUENT)
            ones = np.ones(len(y), np.int32)  # of the tables' own type, which numpy adds without a detour
            for r in rows[0]:
                np.add.at(count[0].reshape(-1), r * CLASSES + y, ones)
            for r in rows[1]:
                np.add.at(count[1].reshape(-1), r[some] * PARTS + part[some], ones[: len(some)])
        pack = zstandard.ZstdCompressor(level=1)
        for t, c in enumerate(count):
            for lo in range(0, m.rows, TOGETHER):
                x = c[lo : lo + TOGETHER]
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([lo], pa.int32()), pa.array([pack.compress(x.tobytes())], pa.binary())], ["t", "lo", "c"])
        del count
        release()

    def summed(key, table):
        t, lo = (k.as_py() for k in key)
        m, wide = known.value, CLASSES if t == 0 else PARTS
        c = np.zeros((TOGETHER, wide), np.int64)
        for x in table.column("c"):
            c += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int32).reshape(-1, wide)
        n = c.sum(1)
        q = np.exp(m.shares(t)[lo : lo + TOGETHER])
        w = np.log((c + PRIOR * q) / ((n[:, None] + PRIOR) * q)).astype(np.float16)
        return pa.table([pa.array([t], pa.int32()), pa.array([lo], pa.int32()), pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["t", "lo", "n", "w"])

    got = train.mapInArrow(run, "t int, lo int, c binary").groupBy("t", "lo").applyInArrow(summed, "t int, lo int, n binary, w binary")
    tables = [(np.zeros((model.rows, wide), np.float16), np.zeros(model.rows, np.float32)) for wide in (CLASSES, PARTS)]
    for r in got.toLocalIterator():  # at most 2 * ROWS / TOGETHER rows, 17 kB each
        w, n = tables[r.t]
        n[r.lo : r.lo + TOGETHER] = np.frombuffer(r.n, np.float32)
        w[r.lo : r.lo + TOGETHER] = np.frombuffer(r.w, np.float16).reshape(TOGETHER, -1)
    model.tables = [Table(w, n, each) for (w, n), each in zip(tables, (model.rows, model.rows // ENDINGS))]


def _train_rates(train: DataFrame, model: Model, rounds: int = ROUNDS) -> None:
    """Rounds of gradient steps on the rates; each sees the texts of one remainder of a hash of the ids."""
    for k in range(rounds):
        known = train.sparkSession.sparkContext.broadcast(model)

        def run(batches, known=known):
            m = known.value
            m.open(False)
            total = np.zeros((2, 2, KINDS, SIZES))
            for _, _, _, y, part, one, two in _parts_of(text_chunks(batches, 1 << 20), m):
                some = np.flatnonzero(y >= FREQUENT)
                for lo in range(0, len(y), TOKENS):
                    s = slice(lo, lo + TOKENS)
                    prior = np.broadcast_to(m.log_class, (len(y[s]), CLASSES))
                    total[0] += m.tables[0].gradient(prior, [r[s] for r in one], y[s])
                for lo in range(0, len(some), TOKENS):
                    j = some[lo : lo + TOKENS]
                    total[1] += m.tables[1].gradient(m.log_part[y[j]], [r[j] for r in two], part[j])
            flat = total.transpose(0, 2, 3, 1).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["i", "a", "b"])
            release()

        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("doc_id", "text")
        sums = part.mapInArrow(run, "i int, a double, b double").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()  # a row for each rate
        for r in sums:
            t, at = divmod(r.i, KINDS * SIZES)
            f, size = divmod(at, SIZES)
            rates = model.tables[t].rates
            rates[f, size] = np.clip(rates[f, size] + STEP * r.a / (r.b + 1.0), 0.0, 1.5)
        known.unpersist()


def _gains(m: Model, y: np.ndarray, part: np.ndarray, one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """log10 by which class and part are likelier after their history than by themselves."""
    gain = np.zeros(len(y))
    for lo in range(0, len(y), TOKENS):
        s = slice(lo, lo + TOKENS)
        gain[s] = m.tables[0].gains(np.broadcast_to(m.log_class, (len(y[s]), CLASSES)), [r[s] for r in one], y[s])
    some = np.flatnonzero(y >= FREQUENT)
    for lo in range(0, len(some), TOKENS):
        j = some[lo : lo + TOKENS]
        gain[j] += m.tables[1].gains(m.log_part[y[j]], [r[j] for r in two], part[j])
    return gain / np.log(10)


def fit(train: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, int, int, np.ndarray, np.ndarray]:
    """(model, N, V, head words in order of count, their counts) from the training texts (doc_id, text) and their ``counts``."""
    parts = counts.groupBy("k", "s").agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()  # at most CLASSES * PARTS rows
    n, v = sum(r.c for r in parts), sum(r.types for r in parts)
    top = counts.orderBy(F.desc("c"), "w").limit(HEAD).toArrow()
    head, head_k, head_s, head_c = top.column("w").to_numpy().view(U), *(top.column(c).to_numpy() for c in ("k", "s", "c"))
    words = np.flatnonzero(head != END)[: FREQUENT - 1]
    mass = np.zeros((CLASSES, PARTS))
    for r in parts:
        mass[r.k, r.s] += r.c + 0.1 * r.types
    for j, i in enumerate(words.tolist()):
        mass[head_k[i], head_s[i]] -= head_c[i] + 0.1
        mass[1 + j, head_s[i]] += head_c[i] + 0.1
    rows = 1 << max(FEWEST.bit_length() - 1, min(ROWS.bit_length() - 1, int(v).bit_length()))
    model = Model(head[words], np.maximum(mass, 0.1), rows)
    _count_features(train, model)
    _train_rates(train, model, rounds)
    return model, n, v, head, head_c


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A row is held out if crc32 of its id as text is divisible by ``held_out``; the rest is learnt from.  Words are [^\\x20\\x09-\\x0D]+ with
    A-Z folded, and each text has one end.  Null texts are empty: one token, the end. A row with a null id is learnt from.  Repeated rows count
    and are scored as often as they stand there. Without training rows N and V are 0. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    ids = F.col(id_col).cast("long")
    out = F.coalesce(F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(held_out)) == 0, F.lit(False))
    docs = docs.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"), out.alias("held_out"))
    train = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = stored(_counts(train))
    model, n, v, head, head_c = fit(train, counts, rounds)
    total = n + 0.1 * (v + 1)
    o = np.argsort(head)
    known = spark.sparkContext.broadcast((model, head[o], np.log10((head_c[o] + 0.1) / total)))

    def run(batches):
        m, hw, hl = known.value
        m.open(True)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            lo = 0
            for ids, h, ptr, y, part, one, two in _parts_of(text_chunks(iter([batch]), 1 << 20), m):
                docs_n = len(ids)
                gain = _gains(m, y, part, one, two)
                doc = np.repeat(np.arange(docs_n), np.diff(ptr))
                i = np.minimum(np.searchsorted(hw, h), max(0, len(hw) - 1))
                hit = hw[i] == h if len(hw) else np.zeros(len(h), bool)
                base = np.bincount(doc[hit], hl[i[hit]], docs_n) if len(hw) else np.zeros(docs_n)
                better = np.bincount(doc[hit], gain[hit], docs_n)
                rest = np.flatnonzero(~hit)
                order = rest[np.lexsort((h[rest], doc[rest]))]
                hh, dd = h[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (hh[1:] != hh[:-1]) | (dd[1:] != dd[:-1])])) if len(order) else np.zeros(0, np.int64)
                tf = np.diff(np.concatenate([first, [len(order)]]))
                g = np.add.reduceat(gain[order], first) if len(first) else np.zeros(0)
                at = np.searchsorted(dd[first], np.arange(docs_n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (hh[first].view(np.int64), tf.astype(np.int32), g.astype(np.float32))]
                cols = [pa.array(rid + np.arange(docs_n)), ids, batch.column(2).slice(lo, docs_n), pa.array(np.diff(ptr)), pa.array(np.bincount(doc[hit], minlength=docs_n)), pa.array(base.astype(np.float64)), pa.array(better.astype(np.float64)), *lists]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "held_out", "n_tokens", "n_head", "base", "gain", "w", "tf", "g"])
                lo += docs_n
                rid += docs_n

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, gain double, w array<long>, tf array<int>, g array<float>"
    each = stored(docs.mapInArrow(run, schema))
    rare = each.select("rid", F.explode(F.arrays_zip("w", "tf", "g")).alias("x")).select("rid", "x.w", "x.tf", "x.g")
    joined = rare.join(counts.select("w", "c"), "w", "left")
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(total)) * F.col("tf")
    is_known = F.col("c").isNotNull()
    rest = joined.groupBy("rid").agg(F.sum(term).alias("b"), F.sum(F.when(is_known, F.col("g").cast("double")).otherwise(0.0)).alias("gg"), F.sum(F.when(is_known, F.col("tf")).otherwise(0)).alias("nk"))
    done = each.drop("w", "tf", "g").join(rest, "rid", "left")
    base = F.col("base") + F.coalesce("b", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("nk", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain") + F.coalesce("gg", F.lit(0.0))).alias("score"),
    )
