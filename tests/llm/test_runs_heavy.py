"""Runs of repeated events and frequent items against brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from messy import clashing
from pyspark.sql import functions as F

from loomlog.llm import heavy, runs

LINES = "line_id long, timestamp timestamp, logsource string, program string, seq long, message string"
START = datetime(2024, 1, 1)


def lines(spark, rows):
    return clashing(spark.createDataFrame(rows, LINES))


def collapse(df, **more):
    return runs.collapse_runs(df, ("logsource", "program"), "timestamp", "message", "line_id", "seq", ("logsource", "seq"), **more)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("took 53.75 s", "took 1269 ms", True), ("took 45m54s", "took 3 s", True), ("wrote 455 KiB", "wrote 486.1 MB", True), ("id 8eab415b", "id 12345678", True), ("id deadbeef", "id 00000000", True),
        ("from 10.1.2.3", "from 10.200.0.77", True), ("x 910f6dec-fb47-4f8d-8a66-e86886f63966", "x 76a1fe7a-54af-4cc6-8b8b-dbc6bb154609", True), ("PUMP  A flow 5 L/MIN ", "pump a\tFLOW 77 l/min", True),
        ("GRÖSSE 5", "größe 6", True), ("30898.31 C", "4.5 C", True), ("a -5 b", "a 7 b", True), ("user added", "user removed", False), ("job faded", "job decade", False), ("x 5 cats", "x 5 dogs", False), ("at 0x1F", "at 0xab", True),
    ],
)
def test_canonical(spark, a, b, same):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(runs.canonical(F.col("a")), runs.canonical(F.col("b"))).first()
    assert (x == y) == same, (x, y)


def brute(rows, min_count):
    good = {}
    for r in sorted((r for r in rows if None not in (r[1], r[2], r[3], r[5])), key=lambda r: r[0]):
        good.setdefault((r[2], r[4]) if r[4] is not None else r[0], r)
    out, last = [], None
    for r in sorted(good.values(), key=lambda r: (r[2], r[3], r[1], -1 if r[4] is None else r[4], r[0])):
        key = r[2], r[3], r[5].lower().rstrip("0123456789")
        if key == last:
            out[-1][1] = r[0]
            out[-1][2] += 1
        else:
            out.append([r[0], r[0], 1])
        last = key
    return sorted(tuple(x) for x in out if x[2] >= min_count)


@pytest.mark.parametrize("seed", range(3))
def test_runs(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        source = r.choice(["hot"] * 8 + ["b", "c", None])
        rows.append((i, START + timedelta(seconds=r.randrange(90)) if r.random() > 0.03 else None, source, r.choice(["p"] * 6 + ["q", None]), r.choice([i, i, i, i - 1, None]), r.choice(["Alpha ", "beta ", "beta "]) + str(i) if r.random() > 0.02 else None))
    for least in (1, 3):
        got = sorted((x["first_id"], x["last_id"], x["n_events"]) for x in collapse(lines(spark, rows).repartition(5), min_count=least).collect())
        assert got == brute(rows, least)


def test_gap_similarity_and_empty(spark):
    rows = [(i, START + timedelta(seconds=t), "s", "p", i, m) for i, (t, m) in enumerate([(0, "a b c d"), (1, "a b c x"), (100, "a b c d"), (101, "z z z z")])]
    gap = collapse(lines(spark, rows), max_gap=10.0, similarity=0.7)
    assert sorted((r["first_id"], r["last_id"], r["duration_s"]) for r in gap.collect()) == [(0, 1, 1.0), (2, 2, 0.0), (3, 3, 0.0)]
    exact = collapse(lines(spark, [rows[0], rows[2]]), max_gap=10.0)
    assert exact.count() == 2
    assert collapse(lines(spark, rows).limit(0)).collect() == []
    long = collapse(lines(spark, [(1, START, "s", "p", 1, "w " * 200_000), (2, START, "s", "p", 2, "w " * 200_000), (3, START, "s", "p", 3, "")]))
    assert sorted(r["n_events"] for r in long.collect()) == [1, 2]


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_similar_runs_of_a_hot_entity(spark, partitions):
    """Anchors are carried over range borders: the result is that of one state machine over each whole entity."""
    r = random.Random(6)
    rows, at, words = [], 0, list("abcde")
    for i in range(900):
        at += r.choice([1, 1, 1, 1, 400])
        if r.random() < 0.3:
            words[r.randrange(5)] = r.choice("abcdefgh")
        rows.append((i, START + timedelta(seconds=at), "hot" if i % 10 else "cold", "p", i, " ".join(words)))
    want = []
    for source in ("hot", "cold"):
        anchor = last = None
        for i, t, s, _, _, m in rows:
            if s != source:
                continue
            if anchor is not None and (t - last).total_seconds() <= 60 and runs.token_similarity(anchor, m) >= 0.6:
                want[-1][1:] = [i, want[-1][2] + 1]
            else:
                anchor = m
                want.append([i, i, 1])
            last = t
    got = collapse(lines(spark, rows).repartition(7), max_gap=60.0, similarity=0.6, partitions=partitions)
    assert sorted((x["first_id"], x["last_id"], x["n_events"]) for x in got.collect()) == sorted(map(tuple, want))
    # one run over many ranges
    same = collapse(lines(spark, [(i, START + timedelta(seconds=i), "hot", "p", i, f"w x y {'pqr'[i % 3]}") for i in range(300)]), similarity=0.7, partitions=partitions)
    assert [(x["first_id"], x["last_id"], x["n_events"]) for x in same.collect()] == [(0, 299, 300)]


def test_counters_are_summed_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(heavy, "FAN", 3)
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.lit("often")).otherwise(F.col("id").cast("string")).alias("message")).repartition(20)
    assert [(x["item"], x["n"]) for x in heavy.frequent_items(df, ["message"], 0.1).collect()] == [("often", 1000)]


def test_code_has_distance_five():
    words = np.random.default_rng(1).integers(0, 16, (400, heavy.DATA)).astype(np.uint8)
    code = heavy.encode(words)
    base = heavy.encode(np.zeros((1, heavy.DATA), np.uint8))[0]
    weights = (code[1:] != code[:-1]).sum(axis=1)
    different = (words[1:] != words[:-1]).any(axis=1)
    assert weights[different].min() >= heavy.PARITY + 1
    one = np.zeros((heavy.DATA, heavy.DATA), np.uint8)
    np.fill_diagonal(one, 7)
    assert ((heavy.encode(one) != base).sum(axis=1) == heavy.PARITY + 1).all()


@pytest.mark.parametrize("groups", [16, 1024])
def test_frequent_items(spark, groups):
    r = random.Random(4)
    values = [r.choice(["x", "y", "z ", "Z"]) if r.random() < 0.5 else f"rare{i}" for i in range(4000)] + [f"many{i % 60}" for i in range(3000)] + [None] * 500 + [""] * 80
    r.shuffle(values)
    df = clashing(spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "message string, pid int"))
    got = heavy.frequent_items(df.repartition(6), ["message", "pid"], 0.005, groups).collect()
    least = 0.005 * len(values)
    want = {("message", k): n for k, n in Counter(v for v in values if v is not None).items() if n >= least}
    want |= {("pid", str(k)): n for k, n in Counter(i % 3 for i in range(len(values))).items()}
    assert {(g["field"], g["item"]): g["n"] for g in got} == want
    assert all(g["approx_count"] >= g["n"] for g in got)


def test_frequent_edge_cases(spark):
    df = spark.createDataFrame([(None,), (None,)], "message string")
    assert heavy.frequent_items(df, ["message"]).collect() == []
    assert heavy.frequent_items(df.limit(0), ["message"]).collect() == []
    one = heavy.frequent_items(spark.createDataFrame([("v" * 100_000,)] * 3, "message string"), ["message"]).collect()
    assert [r["n"] for r in one] == [3]
    with pytest.raises(ValueError):
        heavy.frequent_items(df, ["message"], 0)
