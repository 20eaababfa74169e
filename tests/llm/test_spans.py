"""Shared spans against brute force."""

import itertools
import random

import pytest
from messy import clashing

from loomlog.llm import spans


def brute(docs, n):
    grams = {}
    for d, t in docs:
        if d is not None:
            for i in range(len(t or "") - n + 1):
                grams.setdefault(t[i : i + n], set()).add(d)
    return {p for s in grams.values() for p in itertools.combinations(sorted(s), 2)}


def covered(docs, n):
    grams = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            grams.setdefault(t[i : i + n], set()).add(d)
    out = {}
    for d, t in docs:
        marks = set()
        for i in range(len(t or "") - n + 1):
            if len(grams[t[i : i + n]]) > 1:
                marks.update(range(i, i + n))
        if marks:
            out[d] = len(marks)
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdefgh 😀é\n") for _ in range(k))
    passages = [text(k) for k in (59, 60, 61, 90, 150, 300)]
    docs = []
    for i in range(n):
        parts = [text(r.randrange(0, 90))]
        for _ in range(r.randrange(0, 3)):
            parts += [r.choice(passages), text(r.randrange(0, 60))]
        docs.append((i, "".join(parts)))
    docs += [(100 + i, "ab" * (20 + 7 * i)) for i in range(5)] + [(200 + i, "x" * (40 + 10 * i)) for i in range(5)]
    docs += [(300, docs[3][1]), (301, docs[3][1]), (302, docs[4][1]), (400, None), (401, ""), (402, " "), (403, "short")]
    return docs


def test_results_at_every_hot(spark):
    docs = corpus(1)
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    passages = []
    for hot in (2, 100, 1 << 40):
        found = spans.SharedSpans(df, 60, 24, hot)
        got = [(r["doc_id_a"], r["doc_id_b"]) for r in found.pairs().collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(docs, 60)
        assert {r["doc_id"]: r["shared_chars"] for r in found.shares().collect()} == covered(docs, 60)
        passages.append(sorted(map(tuple, found.passages.collect())))
    assert passages[0] and passages[0] == passages[1] == passages[2]


@pytest.mark.parametrize("hot", [2, 100])
def test_seeds_that_repeat_in_both_texts(spark, hot):
    """A phrase that is too short for a case stands twelve times in each text; one span of each pair lies around one of them."""
    r = random.Random(8)
    text = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    phrase = text(190)
    own = [(text(5), text(5)) for _ in range(6)]
    docs = []
    for i in range(12):
        places = [text(1500) + phrase + text(3) for _ in range(12)]
        before, after = own[i // 2]
        k = r.randrange(12)
        places[k] = text(1500) + before + phrase + after + text(3)
        docs.append((i, "".join(places)))
    found = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot)
    want = brute(docs, 200)
    assert want == {(2 * i, 2 * i + 1) for i in range(6)}
    assert {(x["doc_id_a"], x["doc_id_b"]) for x in found.pairs().collect()} == want
    assert {x["doc_id"]: x["shared_chars"] for x in found.shares().collect()} == covered(docs, 200)
    assert {(x["a"], x["b"]) for x in found.passages.collect()} == want


def test_fuzzy_passage(spark):
    """Words that differ between verbatim spans belong to the passage, and so do matches of k code points beside it."""
    r = random.Random(12)
    text = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    a, b, c, d = text(260), text(230), text(150), text(120)
    docs = [(1, text(300) + a + "XXXX same YYYYY" + b + "Q" + c + "Q" + d + text(50)), (2, text(10) + a + "ZZ same" + b + "R" + c + "R" + d + text(400))]
    got = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string")).passages.collect()
    assert len(got) == 1
    assert got[0]["start_a"] == 300 and got[0]["start_b"] == 10
    assert got[0]["verbatim"] == 490 and got[0]["n_matches"] == 4
    assert got[0]["matched"] == 260 + len(" same ") - 1 + 230 + 150 + 120
    assert got[0]["share"] > 0.97


def test_lcs():
    r = random.Random(2)
    for _ in range(50):
        x, y = ("".join(r.choice("abc") for _ in range(r.randrange(0, 30))) for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert spans.lcs(spans.code_points(x), spans.code_points(y)) == table[-1][-1]


def test_repeated_ids_nulls_and_empty(spark):
    docs = [(1, "y" * 70), (1, "z" * 70), (2, "z" * 80), (None, "z" * 90), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [tuple(r) for r in spans.SharedSpans(df, 60, 24).pairs().collect()] == [(1, 2)]
    nothing = spans.SharedSpans(df.limit(0), 60, 24)
    assert nothing.pairs().collect() == [] and nothing.shares().collect() == []


def test_winnowing_guarantee():
    r = random.Random(5)
    for _ in range(30):
        common = "".join(r.choice("abc") for _ in range(60))
        a = "".join(r.choice("abc") for _ in range(200)) + common + "q" * 20
        b = "w" * 30 + common + "".join(r.choice("abc") for _ in range(100))
        assert set(spans.seeds_of(a, 24, 60)[0].tolist()) & set(spans.seeds_of(b, 24, 60)[0].tolist())


def test_chaining():
    line = [(i * 10, i * 10 + 7, 8) for i in range(20)]
    noise = [(35, 900, 8), (500, 3, 8)]
    found = spans.chains(line + noise)
    assert found[0] == line
    assert sorted(len(c) for c in found) == [1, 1, 20]
    assert spans.chains([]) == []


def test_very_long_text(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdefghij ") for _ in range(300_000))
    df = spark.createDataFrame([(1, base), (2, "k" * 1000 + base[150_000:150_300] + "m" * 200_000)], "doc_id long, text string")
    found = spans.SharedSpans(df)
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert {r["doc_id"]: r["shared_chars"] for r in found.shares().collect()} == {1: 300, 2: 300}


def test_long_periodic_text(spark):
    df = spark.createDataFrame([(1, "d" * 100_000), (2, "k" * 1000 + "d" * 300 + "m" * 50_000)], "doc_id long, text string")
    found = spans.SharedSpans(df)
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert {r["doc_id"]: r["shared_chars"] for r in found.shares().collect()}[2] == 300


def test_passage_that_a_third_holds(spark):
    r = random.Random(9)
    text = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    passage, other = text(260), text(230)
    docs = [(i, text(40) + (passage if i % 3 == 0 else text(50)) + text(40) + (other if i % 50 == 0 else "")) for i in range(330)]
    found = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"))
    got = [(x["doc_id_a"], x["doc_id_b"]) for x in found.pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, 200)


def test_passages_do_not_depend_on_group_size(spark):
    r = random.Random(11)
    text = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    passage, other = text(260), text(230)
    docs = [(i, text(r.randrange(0, 300)) + passage + text(i % 5) + (other if i % 20 == 0 else text(40))) for i in range(44)]
    passages = lambda rows: sorted((x["a"], x["b"], x["start_a"], x["end_a"], x["start_b"], x["end_b"], x["verbatim"]) for x in spans.SharedSpans(spark.createDataFrame(rows, "doc_id long, text string"), hot=30).passages.collect())
    found = passages(docs)
    assert {x[:2] for x in found} == brute(docs, 200)
    assert all(x[6] >= 260 for x in found)
    for few in (docs[:3], [docs[0], docs[20], docs[40], docs[43]]):
        ids = {d for d, _ in few}
        assert passages(few) == [x for x in found if x[0] in ids and x[1] in ids]
