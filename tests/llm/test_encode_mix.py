"""Encoding with a public vocabulary and mixing sources by tokens."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import clashing

from loomlog.llm import encode, mix

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def pieces():
    model = encode.sentencepiece_model(encode.read_ranks(encode.default_vocabulary()))
    return encode.PieceEncoder(model, public.PATTERN)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_same_ids_and_round_trip(pieces, reference, text):
    ids = pieces.encode(text)
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert pieces.decode(ids) == text


@pytest.mark.parametrize("text", ["", "<|endoftext|>", " \n\t x", "a" * 100_000, "1234567890" * 9000, "▁x ▁", "日本語" * 20_000, "\x00\x1c\x85\xa0", "don't I'LL we've"])
def test_special_texts(pieces, reference, text):
    assert pieces.encode(text) == reference.encode(text, add_special_tokens=False).ids
    assert pieces.decode(pieces.encode(text)) == text


def test_cache_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_ENTRIES", 50)
    pieces.cache.clear()
    for i in range(40):
        assert pieces.decode(pieces.encode(f"word{i} and {i * 977} more{'x' * i}")) == f"word{i} and {i * 977} more{'x' * i}"
        assert len(pieces.cache) < 80


def test_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "hello world", None), (3, "hello world", None), (None, "x", "b")]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    out = [tuple(r) for r in encode.encode_corpus(df).collect()]
    assert sorted(out, key=str) == sorted([(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995]), (None, [87])], key=str)
    assert sorted(r[0] for r in encode.decode_corpus(spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None)], "doc_id long, ids array<int>")).select("text").collect() if r[0] is not None) == ["", "hello world"]
    assert sorted(r["n_tokens"] for r in encode.count_tokens(df).collect()) == [0, 0, 1, 2, 2]
    assert encode.encode_corpus(df.limit(0)).collect() == []


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs = [(i, "word " * (5 + i % 40), (" Big", "mid ", "SMALL")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(3000)] + [(9000, None, "big"), (9001, "lost", None), (9002, "other", "none")]
    df = clashing(spark.createDataFrame(docs, SCHEMA))
    wanted = targets(spark, ("big", 0.4, 1), ("Mid", 0.3, 3), ("small", 0.3, 5), ("absent", 0.5, 2), ("bad", -1.0, 2), (None, 0.1, 1))
    chosen, report = mix.mix_sources(df, clashing(wanted))
    shares = {r["source"]: r for r in report.collect()}
    for s, share in (("big", 0.4), ("mid", 0.3), ("small", 0.3)):
        assert shares[s]["actual_share"] == pytest.approx(share, abs=0.005)
        assert shares[s]["most_copies"] <= shares[s]["max_repeats"]
    assert shares["absent"]["actual_share"] == 0 and "bad" not in shares
    copies = chosen.collect()
    assert {r["source"] for r in copies} == {"big", "mid", "small"}
    assert all(r["copies"] >= 1 for r in copies)
    total = sum(r["n_tokens"] * r["copies"] for r in copies)
    assert total == sum(r["mixed_tokens"] for r in shares.values())
    again = {(r["doc_id"], r["copies"]) for r in mix.mix_sources(df, wanted)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in copies}


def test_budget_beyond_caps(spark):
    docs = [(i, "a b c", "one" if i % 2 else "two") for i in range(200)]
    _, report = mix.mix_sources(spark.createDataFrame(docs, SCHEMA), targets(spark, ("one", 0.5, 1), ("two", 0.5, 9)), total_tokens=1800)
    got = {r["source"]: r["mixed_tokens"] for r in report.collect()}
    assert got["one"] == 300  # all it has, once
    assert got["two"] == pytest.approx(900, rel=0.02)


def test_empty(spark):
    docs, none = spark.createDataFrame([(1, "a", "x")], SCHEMA), spark.createDataFrame([], SCHEMA)
    for d, t in ((none, targets(spark, ("x", 1.0, 1))), (docs, targets(spark, ("y", 1.0, 1)))):
        chosen, report = mix.mix_sources(d, t)
        assert chosen.collect() == []
        assert [r["actual_share"] for r in report.collect()] == [0.0]
    chosen, report = mix.mix_sources(docs, targets(spark, ("x", 1.0, 1)).limit(0))
    assert chosen.collect() == [] and report.collect() == []
