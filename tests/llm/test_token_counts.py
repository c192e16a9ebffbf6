"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest

from siltstone.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_splicing(seed):
    tok = T.load(PATH)
    random.seed(seed)
    parts = ["the ", "<|endoftext|>", "é", " ", "\n", "x1", "don't ", "😀", "a" * 50, "  \t ", "<|endo", "ft", "́", "　", " "]
    text = "".join(random.choice(parts) for _ in range(3000))
    assert T.count_long(tok, text, 700, 40) == len(tok.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000, "x " + " " * 9000 + "y", "<|endoftext|>" * 700, "ab " * 4000])
def test_places_without_a_splice(text):
    tok = T.load(PATH)
    assert T.count_long(tok, text, 1000, 50) == len(tok.encode(text, add_special_tokens=False).ids)


def mixture(rnd, size):
    """Words, blanks and unbroken runs of letters, digits, signs and letters of other scripts."""
    out, n = [], 0
    while n < size:
        kind = rnd.randrange(8)
        if kind < 3:
            part = " ".join("".join(rnd.choice("abcdefgh'") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 400)))
        elif kind == 3:
            part = rnd.choice([" ", "\n", "\t ", "\u3000"]) * rnd.choice([1, 3, 900])
        else:
            part = "".join(rnd.choices(["ab", "aZ09+/", "\u6f22\u5b57\u304b", "{};=()x1"][kind - 4], k=rnd.choice([30, 700, 5000])))
        out.append(part + rnd.choice(["", " "]))
        n += len(out[-1])
    return "".join(out)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_mixtures(name):
    tok = T.load(public_tokenizers.path(name))
    rnd = random.Random(name)
    assert T.memoryless(tok)
    for _ in range(60):
        text = mixture(rnd, rnd.randrange(2000, 20000))
        assert T.count_long(tok, text, rnd.choice([300, 1000, 4000]), rnd.choice([20, 100])) == len(tok.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("words, run, more", [(20000, 300000, 0), (15000, 200000, 20000)])
def test_unbroken_run_after_a_splice(words, run, more):
    """After a splice the next chunk begins at the splice: no token before it is counted again."""
    tok, rnd = T.load(PATH), random.Random(words)
    some = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(n))
    text = some(words) + " " + "".join(rnd.choices("abcdefghij", k=run)) + " " + some(more)
    assert T.count_long(tok, text) == len(tok.encode(text, add_special_tokens=False).ids)


def test_table(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    for r in T.token_counts(df, PATH).collect():
        n = len(tok.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)


def test_edges_and_sentencepiece(spark):
    df = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (None, "hello world", "n"), (2, "x", "n")], "doc_id long, text string, n_tokens string")
    assert sorted((r.n_bytes, r.n_tokens) for r in T.token_counts(df, PATH).collect()) == [(0, 0), (0, 0), (1, 1), (11, 2)]
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = T.token_counts(spark.createDataFrame([(1, "Hello there")], "doc_id long, text string"), path).first()
    assert got.n_tokens == len(sp.encode("Hello there"))
