import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sedimenta.llm import encode

PATH = os.environ.get("BYTE_BPE_50K", encode.BYTE_BPE_50K)
ODD = [None, "", " ", "\n\n", "a" * 5000, "aaaa aaa", "<|endoftext|> x", "漢字かな交じり文" * 40, "👩‍👩‍👧🙂", "it's they'll I'D", "  a b \t\r\n c", " \x85\xa0x", "éé", "0x1F 3.14 ²", "=" * 300]


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return encode.ByteBpe(f.read())


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def lists(flat, sizes):
    out, at = [], 0
    for n in sizes:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_equals_the_library_and_round_trips(bpe, other):
    got = lists(*bpe.encode(ODD))
    assert got == [other(t) for t in ODD]
    assert [bpe.decode(x) for x in got] == [t or "" for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab '", max_size=60)), max_size=5))
def test_equals_the_library_on_any_text(bpe, other, texts):
    assert lists(*bpe.encode(texts)) == [other(t) for t in texts]


def test_cache_may_be_dropped_at_any_time(bpe, other, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_PIECES", 3)
    for text in ("one two three four five", "six seven eight", "one two three"):
        assert lists(*bpe.encode([text])) == [other(text)]


def test_slices_cover_everything():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 5] * 3
    cuts = list(encode.slices(texts, 20))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert list(encode.slices([])) == []


def test_spark(spark, other):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(ODD)] + [(None, "again", "x", None), (0, "x", "x", None)], "doc_id bigint, text string, key string, ids array<int>")
    got = encode.encode_corpus(df, "doc_id", "text", PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted([*((str(i), other(t)) for i, t in enumerate(ODD)), ("None", other("again")), ("0", other("x"))])
    counts = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df.where("doc_id > 0"), "doc_id", "text", PATH).collect()}
    assert counts == {i: len(other(t)) for i, t in enumerate(ODD) if i}
    assert encode.encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
