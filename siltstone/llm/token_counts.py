"""Token counts of huge documents by overlap resynchronisation.

A text of more than ``CHUNK`` characters is encoded in overlapping chunks with offsets.  Two neighbours are spliced at a word of the
pre-tokeniser that both begin at the same place, inside the overlap.  Such a place is a boundary of the whole text too: a
pre-tokeniser without look-behind goes from left to right, and where its next word begins depends on nothing before that place.  The left chunk begins
at a proven boundary and holds ``AGREE`` whole words after the place, so that its cut end has not moved it; the right chunk goes on from there as the whole text does,
and words are encoded one by one.  The next chunk's own beginning is then that place, never an earlier one.
Where no such place is found, the overlap is widened, at last to one chunk of twice the size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, flat_text, narrow

#: Characters of a chunk, of the first overlap, and whole words after a splice that both chunks must have alike.
CHUNK, OVERLAP, AGREE = 1 << 16, 1 << 10, 4
#: Kinds of pre-tokenisers that look at no more than what follows the last word.
MEMORYLESS = ("Split", "ByteLevel", "Whitespace", "WhitespaceSplit", "BertPreTokenizer", "Digits", "Punctuation")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokeniser of a file: tokenizers for .json, sentencepiece for .model."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _sizes(tok, texts: list[str]) -> list[int]:
    if hasattr(tok, "encode_batch_fast"):
        return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if hasattr(tok, "encode_batch"):
        return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    return [len(x) for x in tok.encode(texts, num_threads=1)]


class Part:
    """A chunk's token ids, their places, and which of them begin a word of the pre-tokeniser."""

    def __init__(self, tok, text: str, start: int, stop: int):
        e = tok.encode(text[start:stop], add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        self.ids, self.begin, self.end = np.array(e.ids, np.int64), at[:, 0] + start, at[:, 1] + start
        # a special string inside the text stands outside all words: each is its own
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
        # a word begins after the end of the one before, or its place says nothing
        new[1:] &= self.begin[1:] >= self.end[:-1]
        self.first = np.flatnonzero(new)

    def after(self, k: int) -> Part:
        """The part from token ``k`` on."""
        out = object.__new__(Part)
        out.ids, out.begin, out.end = self.ids[k:], self.begin[k:], self.end[k:]
        out.first = self.first[self.first >= k] - k
        return out


def _splice(left: Part, right: Part, lo: int) -> tuple[int, int] | None:
    """(tokens of left to keep, tokens of right to drop) at the first boundary from ``lo`` on that both chunks have."""
    ours = left.first[:-1]  # the last word may be cut
    common, i, j = np.intersect1d(left.begin[ours], right.begin[right.first], return_indices=True)
    for a, b in zip(i[common > lo].tolist(), j[common > lo].tolist()):
        if a + AGREE >= len(ours):
            return None
        k, n, m = ours[a], ours[a + AGREE] - ours[a], right.first[b]
        if not k or not m or left.end[k - 1] != right.end[m - 1]:
            continue
        same = len(right.ids) >= m + n and all(np.array_equal(x[k : k + n], y[m : m + n]) for x, y in ((left.ids, right.ids), (left.begin, right.begin), (left.end, right.end)))
        if same:
            return int(k), int(m)
    return None


def memoryless(tok) -> bool:
    """Whether words are found from left to right without look-behind, so that chunks can be spliced; otherwise texts are encoded whole."""
    import json

    def parts(x):
        return [x] + [z for y in x.get("pretokenizers", []) for z in parts(y)] if x else []

    model = json.loads(tok.to_str())
    kinds = [x for x in parts(model.get("pre_tokenizer")) if x["type"] != "Sequence"]
    patterns = [x["pattern"].get("Regex", "") for x in kinds if x["type"] == "Split"]
    known = all(x["type"] in MEMORYLESS and not x.get("add_prefix_space") for x in kinds)
    return bool(kinds) and known and not any("(?<" in p or "\\b" in p.lower() or "^" in p.replace("[^", "") for p in patterns)


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoded chunk by chunk; equal to len(encode(text))."""
    n = len(text)
    if n <= chunk or not hasattr(tok, "encode_batch") or not memoryless(tok):
        return _sizes(tok, [text])[0]
    total, base, end = 0, 0, chunk
    left = Part(tok, text, 0, end)
    while end < n:
        wide = overlap
        while True:
            start = end - wide
            if start <= base:  # the overlap has reached the chunk's own beginning: one chunk of twice the size takes its place
                end = min(n, base + 2 * (end - base))
                left = Part(tok, text, base, end)
                break
            stop = min(n, end + chunk)
            right = Part(tok, text, start, stop)
            if found := _splice(left, right, start):
                total += found[0]
                base = int(right.end[found[1] - 1])  # what stands between two words goes with the later one
                left, end = right.after(found[1]), stop
                break
            wide *= 4
    return total + len(left.ids)


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a tokeniser's file, read by the library it belongs to, without added special tokens, truncation or padding; it must be
    at the same place on every executor.  Null texts are empty: no bytes, no tokens. Null ids and repeated rows
    are kept; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        tok = load(path)
        for batch in batches:
            buf, offs = flat_text(batch.column(1))
            size = np.diff(offs)
            out = np.zeros(batch.num_rows, np.int64)
            texts = batch.column(1).to_pylist()
            short = [i for i in range(len(texts)) if texts[i] and len(texts[i]) <= CHUNK]
            for lo in range(0, len(short), 128):
                part = short[lo : lo + 128]
                out[part] = _sizes(tok, [texts[i] for i in part])
            for i, t in enumerate(texts):
                if t and len(t) > CHUNK:
                    out[i] = count_long(tok, t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(out), pa.array(out > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
