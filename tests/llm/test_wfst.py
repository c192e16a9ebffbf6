"""Transducer encoding against the sentencepiece library, and the round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from siltstone.llm import wfst as W

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(t, text):
    return np.frombuffer(t.encode(text), "<i4").tolist()


def test_fuzz(library):
    t = W.load(PATH)
    random.seed(4)
    parts = ["  ", "a", "the", "▁", "\n", "é", "中", "😀", "<s>", "er", "in", "    ", ".", "\t", "1", "xxxxxxxxx", " th", "<0x41>", "́"]
    for _ in range(1500):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 40)))
        assert ids(t, s) == library.encode(s), s


def test_documents(spark, sf, library):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = W.encode(df, PATH).join(df.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.ids == library.encode(r.text) and r.round_trip and r.n_pieces == len(r.ids)
    back = {r.doc_id: r.text for r in W.decode(W.encode(df, PATH), PATH).collect()}
    assert back == {r.doc_id: r.text for r in rows}


def test_edges(spark, library):
    long = "ab" * 50000
    rows = [(1, ""), (2, None), (None, " "), (3, long), (3, "x"), (4, "a▁b")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, ids string")
    out = {(r.doc_id, r.n_bytes): r for r in W.encode(df, PATH).collect()}
    assert len(out) == 6 and out[1, 0].ids == [] and out[2, 0].n_pieces == 0 and out[None, 1].ids == library.encode(" ")
    assert out[3, 100000].ids == library.encode(long) and not out[4, 5].round_trip
    assert W.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_memo_keeps_what_is_asked_for(monkeypatch):
    monkeypatch.setattr(W, "REMEMBERED", 8)
    t = W.Transducer(PATH)
    text = " ".join(f"w{i} the" for i in range(60))
    first = t.encode(text)
    assert first == t.encode(text) and len(t.memo) <= 8


def changed(tmp_path, name, **flags):
    """(file, library) of the model with another normaliser: its fields are put behind the model's own, and the last ones count."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=name, **flags).serialized_model_proto()
    model = b"".join(part for field, part in fields(open(PATH, "rb").read()) if field != 3) + b"".join(part for field, part in fields(spec) if field == 3)
    at = tmp_path / "changed.model"
    at.write_bytes(model)
    return str(at), sentencepiece.SentencePieceProcessor(model_proto=model)


def fields(b):
    """(number, bytes) of the fields of a message, all of which are messages themselves."""
    i = 0

    def varint(i):
        x = s = 0
        while True:
            x |= (b[i] & 127) << s
            s += 7
            i += 1
            if b[i - 1] < 128:
                return x, i

    while i < len(b):
        key, j = varint(i)
        n, k = varint(j)
        yield key >> 3, b[i : k + n]
        i = k + n


TEXTS = ["", " ", "   ", "ＡＢＣ  ｱｲｳ   x ﬁ ", " ①②  ㌔ é e\u0301 \u3000 \u200b tail\t", "Straße İstanbul ΑΣ", "a\u00a0b  c", "한국 한국 ½ ™", "x", "𝔘𝔫𝔦 😀 ‼", "\u0000 \u0007z"]


@pytest.mark.parametrize("name", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_other_normalisers(tmp_path, name, squeeze):
    path, library = changed(tmp_path, name, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    t = W.Transducer(path)
    random.seed(9)
    texts = TEXTS + ["".join(random.choice(["ａ", " ", "  ", "é", "e\u0301", "Ⅷ", "the ", "ｶﾞ", "中", "ß", "A", "\t", "\u3000", "\u00ad"]) for _ in range(random.randrange(20))) for _ in range(400)]
    for text in texts:
        assert t.normalise(text) == library.normalize(text), text
        assert ids(t, text) == library.encode(text), text


def test_decoding_rows(spark):
    t = W.load(PATH)
    text = "Hello there"
    rows = [(1, ids(t, text), "z"), (1, ids(t, text), "z"), (None, [], "z"), (2, None, "z")]
    out = W.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, text string"), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in out if r.text is not None) == [("1", text), ("1", text), ("None", "")] and len(out) == 4
    assert W.decode(spark.createDataFrame([], "doc_id long, ids array<int>"), PATH).count() == 0
