import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t, bpe.Encoder(open(bpe.VOCABULARY, encoding="utf-8").read())


ODD = ["", " ", "\n", "  a  b ", "aaaaaaa aaaa aa", "it's we'll 'tis THEY'RE", "<|endoftext|>x", "x\t\ty \r\n\x0b z\x1c\x1d\x85\xa0q", "Ⅷ ½ ① ﬁx", "お客様 17個", "é" * 50, "_a_b__1_", "​﻿x", "a" * 5000, "😀👩‍👩‍👧 x"]


def test_odd_texts(both):
    t, e = both
    assert e.encode(ODD).to_pylist() == [x.ids for x in t.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n'aeglsthin.,1_é"), st.characters(exclude_categories=["Cs", "Cn"]))), max_size=4))
def test_any_texts(both, texts):
    t, e = both
    assert e.encode(texts).to_pylist() == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark, both):
    t, _ = both
    rows = [(1, None, 5), (2, "", 5), (3, "a book", 5), (3, "a book", 5), (4, "long word " * 30_000, 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.token_ids(df).collect()))
    assert got == sorted((a or 0, t.encode(b, add_special_tokens=False).ids if b else []) for a, b, _ in rows)
    assert bpe.token_ids(df.limit(0)).collect() == []


def test_forgetting(both, monkeypatch):
    t, e = both
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    for x in ("one two three four five", "five four six", "one"):
        assert e.encode([x]).to_pylist() == [t.encode(x, add_special_tokens=False).ids]
