"""Toxicity by class-conditional Kneser-Ney models.

A model of toxic and one of ordinary texts spell words letter by letter.  A word counts as often as different words precede it (Kneser and
Ney's continuation counts, so copies and repetitions add nothing).  With h the letters of a word so far and x the next one, c the counts of a class and C those of both:

    P_class(x | h) = (1 - g) * (max(c(hx) - D, 0) + D * n(h) * R(x | h)) / c(h) + g * Q(x | last letter of h)
    R(x | h) = max(C(hx) - D, 0) / sum over x of max(C(hx) - D, 0),   g = D * N(h) / C(h)

n(h) and N(h) are the numbers of different letters after h in the class and in both, Q says after how many different h a letter
follows the last one.  R, g and Q are shared by both classes: what is rare in both, or after letters that a class has not seen,
is spelled by the shared counts and speaks for neither.  No count is too small to enter.

A text's evidence is the length-normalised difference of its two log-likelihoods over all its words, over its strongest word and over its three strongest: a toxic
expression may be a word in thousands.  A logistic fit turns it into a score: the sample is dealt into ``FOLDS`` parts, and the evidence of each part comes from
the counts of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat_text, narrow, release, text_chunks
from .words import ALNUM, LOWER, U, bounds, hashes, mix

DISCOUNT = 0.75
#: Bytes of a word that are spelled; longer words that agree in them count as one.
LETTERS = 16
#: Added to each count of letter pairs, so that no letter is impossible.
FLOOR = 0.01
#: Labelled rows of each class that the models are fitted on, chosen by hash, and parts of them whose evidence comes from the others.
FIT_ROWS, FOLDS = 6000, 4
#: Inverse variance of the weights of the evidence, before any row is seen: few rows give scores near the share of toxic rows.
RIDGE = 1.0
#: Score from which a text is rejected.
REJECT = 0.7


def _spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first LETTERS bytes of words, folded, each row with a zero after its last."""
    padded = np.concatenate([LOWER[buf], np.zeros(LETTERS + 1, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, LETTERS + 1)[starts]
    return np.where(np.arange(LETTERS + 1)[None, :] < np.minimum(ends - starts, LETTERS)[:, None], rows, 0).astype(np.uint8)


_ROOT = U(0x2545F4914F6CDD1D)


def _prefixes(letters: np.ndarray) -> np.ndarray:
    """Keys of the prefixes of 0, 1, ... letters of each word; the zero at a word's end counts as a letter."""
    out = np.empty((len(letters), LETTERS + 2), U)
    out[:, 0] = _ROOT
    for i in range(LETTERS + 1):
        out[:, i + 1] = _longer(out[:, i], letters[:, i])
    return out


def _longer(keys: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mix(keys * U(0x9E3779B97F4A7C15) + letter + U(1))


def _counts(sample: DataFrame) -> DataFrame:
    """Each word (letters) of ``sample`` (text, toxic, fold) with the number of different words before it, in ordinary (c0, ...) and in toxic texts (c1, ...).

    c0 and c1 count the whole sample, c0_k and c1_k the folds other than k.
    """

    def run(batches):
        for batch in batches:
            # bits: of the folds in which ordinary texts have a pair of words, and above them those of toxic texts
            bit = 1 << (batch.column(2).to_numpy(zero_copy_only=False) + FOLDS * batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            lo = 0
            view = pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], ["toxic", "text"])
            for ids, buf, offs in text_chunks(iter([view])):
                starts, ends, ptr = bounds(buf, offs, ALNUM)
                bits = np.repeat(bit[lo : lo + len(ids)], np.diff(ptr))
                lo += len(ids)
                if not len(starts):
                    continue
                h = hashes(buf, starts, ends)
                prev = np.concatenate([np.zeros(1, U), h[:-1]])
                prev[ptr[:-1][ptr[:-1] < ptr[1:]]] = U(0)
                pair = mix(prev * U(0x9FB21C651E98DF25) + h)
                order = np.argsort(pair, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
                at = order[first]
                flat = _spelled(buf, starts[at], ends[at])[:, :LETTERS]
                size = np.minimum(ends[at] - starts[at], LETTERS)
                raw = flat[np.arange(LETTERS)[None, :] < size[:, None]].tobytes()
                text = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([text, pa.array(pair[at].view(np.int64)), pa.array(np.bitwise_or.reduceat(bits[order], first).astype(np.int32))], ["letters", "pair", "bits"])

    got = sample.select("text", "toxic", "fold").mapInArrow(run, "letters binary, pair long, bits int")
    each = got.groupBy("letters", "pair").agg(F.bit_or("bits").alias("bits"))
    whole = (1 << FOLDS) - 1
    masks = {"": whole} | {f"_{k}": whole & ~(1 << k) for k in range(FOLDS)}
    return each.groupBy("letters").agg(*[F.sum((F.col("bits").bitwiseAND(F.lit(m << FOLDS * c)) != 0).cast("int")).cast("int").alias(f"c{c}{name}") for name, m in masks.items() for c in (0, 1)])


def _sums(group: np.ndarray, n: int, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(group, c, n) for c in columns]


@dataclass
class Model:
    """Sorted keys of all known prefixes of words, the difference of their log-likelihoods, and the weights of the score."""

    keys: np.ndarray
    llr: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(words: pa.Table, but: str = "") -> Model:
        """From rows of counts, as many as the sample has different words; ``but``: without a fold."""
        words = words.combine_chunks()
        c0, c1 = (words.column(f"{c}{but}").to_numpy().astype(float) for c in ("c0", "c1"))
        if not c0.sum() or not c1.sum():
            return Model(np.zeros(0, U), np.zeros(0), np.zeros(4))
        data, offs = flat_text(words.column("letters"))
        size, some = np.diff(offs), c0 + c1 > 0
        letters = np.zeros((len(size), LETTERS + 1), np.uint8)
        letters[np.arange(LETTERS + 1)[None, :] < size[:, None]] = data
        letters, size, c0, c1 = letters[some], size[some], c0[some], c1[some]
        # the nodes of each depth: prefixes with their last letter x, the letter y before it, and the place of their parent h in the depth above
        key, h, levels = np.full(len(size), _ROOT), np.zeros(len(size), np.int64), []
        pairs = np.full((256, 256), FLOOR)
        for d in range(1, LETTERS + 2):
            going = size >= d - 1
            key, h, size, letters, c0, c1 = key[going], h[going], size[going], letters[going], c0[going], c1[going]
            if not len(key):
                break
            key = _longer(key, letters[:, d - 1])
            nodes, first, inv = np.unique(key, return_index=True, return_inverse=True)
            x, y = letters[first, d - 1], letters[first, d - 2] if d > 1 else np.zeros(len(first), np.uint8)
            levels.append((nodes, *_sums(inv, len(nodes), c0, c1), x, y, h[first]))
            np.add.at(pairs, (y, x), 1.0)
            h = inv
        low = pairs / pairs.sum(1, keepdims=True)
        above, keys, out = np.zeros(1), [], []
        for nodes, n0, n1, x, y, h in levels:
            n, both = len(above), n0 + n1
            more = np.maximum(both - DISCOUNT, 0)
            total, kinds, rest = _sums(h, n, both, np.ones(len(h)), more)
            shared, g = more / rest[h], DISCOUNT * (kinds[h] / total[h])

            def spelled(c: np.ndarray, h=h, n=n, shared=shared, g=g, x=x, y=y) -> np.ndarray:
                seen, kinds = _sums(h, n, c, c > 0)
                own = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds[h] * shared) / np.maximum(seen[h], 1)
                return (1 - g) * np.where(seen[h] > 0, own, shared) + g * low[y, x]

            above = np.log(spelled(n1) / spelled(n0)) + above[h]
            keys.append(nodes)
            out.append(above.astype(np.float32))
        keys, llr = np.concatenate(keys), np.concatenate(out)
        order = np.argsort(keys)
        return Model(keys[order], llr[order], np.zeros(4))

    def words(self, letters: np.ndarray) -> np.ndarray:
        """Difference of the log-likelihoods of words: that of the longest known prefix, as the rest is spelled alike."""
        out, every = np.zeros(len(letters)), _prefixes(letters)
        going = np.arange(len(letters) if len(self.keys) else 0)
        for d in range(1, LETTERS + 2):
            if d > 1:
                going = going[letters[going, d - 2] > 0]
            key = every[going, d]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            going = going[hit]
            out[going] = self.llr[i[hit]]
            if not len(going):
                break
        return out

    def evidence(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each text: difference of log-likelihoods a word over all words, over its strongest word, over its three strongest."""
        starts, ends, ptr = bounds(buf, offs, ALNUM)
        _, at, inv = np.unique(hashes(buf, starts, ends), return_index=True, return_inverse=True)
        llr = self.words(_spelled(buf, starts[at], ends[at]))[inv] if len(starts) else np.zeros(0)
        run = np.concatenate([[0.0], np.cumsum(llr)])
        n = np.diff(ptr)
        out = np.zeros((len(n), 3))
        out[:, 0] = (run[ptr[1:]] - run[ptr[:-1]]) / np.maximum(n, 1)
        for d in np.flatnonzero(n).tolist():
            x = llr[ptr[d] : ptr[d + 1]]
            top = np.sort(np.partition(x, len(x) - 3)[-3:]) if len(x) > 3 else np.sort(x)
            out[d, 1], out[d, 2] = top[-1], top.sum() / 3
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = np.clip(evidence @ self.weights[:3] + self.weights[3], -30, 30)
        return 1 / (1 + np.exp(-z))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Newton steps of a weighted logistic fit; the weights, but not the constant, are drawn to zero."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.array([RIDGE] * (x.shape[1] - 1) + [1e-6])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * b
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hess, g)
        b -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return b


def _raising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The fit in which no evidence lowers a score: what would is left out."""
    use = list(range(x.shape[1]))
    while True:
        b = _logistic(x[:, use], y, w)
        worst = int(np.argmin(b[:-1])) if use else 0
        if not use or b[worst] >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*use, -1]] = b
            return out
        del use[worst]


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> Model:
    """The models, from at most ``fit_rows`` labelled texts of each class: those of the smallest hashes, so the same in every run.

    ``labels`` (doc_id, toxic) says which rows may be learnt from; a doc_id given twice counts with its larger label, null ids and
    labels are left out.  Without both classes the score is 1/2 everywhere.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = None
    for k, n in share.items():
        # the smallest hashes of a class: first those under a bound that leaves about twice as many, so that no task ranks more on any table
        part = labels.where((F.col("toxic") == k) & (order < int((1 << 40) * min(1.0, 2 * fit_rows / n)))).orderBy(order, "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.union(part)
    if len(share) < 2:
        return Model(np.zeros(0, U), np.zeros(0), np.zeros(4))
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int"))
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "fold").persist()  # at most 2 * fit_rows keys
    words = _counts(texts).toArrow()
    model = Model.of(words)
    known = docs.sparkSession.sparkContext.broadcast([Model.of(words, f"_{k}") for k in range(FOLDS)])

    def run(batches):
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(fold).tolist():
                part = batch.filter(pa.array(fold == k))
                lo = 0
                for ids, buf, offs in text_chunks(iter([pa.RecordBatch.from_arrays([part.column(1), part.column(0)], ["toxic", "text"])])):
                    e = known.value[k].evidence(buf, offs)
                    yield pa.RecordBatch.from_arrays([part.column(1).slice(lo, len(ids)), *[pa.array(e[:, j]) for j in range(3)]], ["toxic", "a", "b", "c"])
                    lo += len(ids)

    got = texts.select("text", "toxic", "fold").mapInArrow(run, "toxic int, a double, b double, c double").orderBy("toxic", "a", "b", "c").toArrow()
    texts.unpersist()
    known.destroy()
    del words, known
    release()  # the driver's memory, too, is what a cluster gives it
    y = got.column("toxic").to_numpy().astype(float)
    if len(set(y.tolist())) == 2:
        x = np.stack([got.column(c).to_numpy() for c in "abc"], 1)
        w = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
        model.weights = _raising(x, y, w * len(y) / w.sum())
    return model


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from ``reject`` on).

    Only the text enters a score.  Null and wordless texts have no evidence and get the score of that. Null ids
    and repeated rows are kept; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = narrow(docs, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows=fit_rows))

    def run(batches):
        for ids, buf, offs in text_chunks(batches):
            s = known.value.score(known.value.evidence(buf, offs))
            yield pa.RecordBatch.from_arrays([ids, pa.array(s), pa.array((s >= reject).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def remove_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, whatever those are called."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(fit(narrow(docs, id_col, text_col), labels, fit_rows=fit_rows))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            lo = 0
            view = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["x", "text"])
            for _, buf, offs in text_chunks(iter([view])):
                s = known.value.score(known.value.evidence(buf, offs))
                yield batch.slice(lo, len(s)).filter(pa.array(s < reject))
                lo += len(s)

    return docs.mapInArrow(run, docs.schema)
