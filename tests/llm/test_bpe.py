import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm.bpe import VOCABULARY, Merges, PairIndexEncoder, encoded

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return PairIndexEncoder(Merges())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def same(encoder, library, texts):
    ids, offsets = encoder.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == (library.encode(t, add_special_tokens=False).ids if t else [])


def test_plain_and_odd_texts(encoder, library):
    same(encoder, library, ["Hello  world", "<|endoftext|> is text", "", None, " ", "\n\n \t x", "aaaaaaaaaaaaaaaa", "I'll we've THEY'RE", "日本語 текст 🙂🙂🏽", "\x00\x01é", "abc" * 3000, "1234567890 " * 50])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(encoder, library, texts):
    same(encoder, library, texts)


def test_round_trip(encoder, library):
    text = "The bid refilled; Größe 12,5 % – 价格 ok\n"
    ids, _ = encoder.encode([text])
    assert library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("tideglass.llm.bpe.REMEMBERED", 3)
    e = PairIndexEncoder(Merges())
    for _ in range(3):
        same(e, library, ["one two three four five six"])


def test_frames(spark, library):
    long = "lorem ipsum " * 600_000
    df = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 0), (1, "a b", 0), (4, long, 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encoded(df, "doc_id", "text").where("doc_id < 4").collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert len(encoded(df, "doc_id", "text").where("doc_id = 4").first().ids) == len(library.encode(long, add_special_tokens=False).ids)
    assert encoded(df.limit(0), "doc_id", "text").count() == 0
