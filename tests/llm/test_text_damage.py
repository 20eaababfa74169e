"""Wrong encodings and cut texts."""

import random

import pytest
from messy import clashing

from loomlog.llm import cutoff, mojibake

CLEAN = [
    "Gerät überhitzt, Lüfter läuft für", "fichier “rapport” déplacé après échecs", "ошибка чтения с диска, сектор повреждён", "Сбой: код, Ряд Ш·Ч", "połączenie zostało przerwane, próba śladu źródła",
    "η σύνδεση με απέτυχε μετά από δοκιμές", "装置の温度が高すぎます", "设备 连接失败，重试 次", "café naïve résumé № façade", "┌─ box ─┐ ║ └─ box ─┘", "latency ±5 µs ≥ 7 µs", "😀 canary alive ✅", "Âge du cache, ÎLOT stable", "Ångström › Ø √27 ≈ 12 ½ Ðð", "não foi possível: permissão", "tarif 5 € / £3, sous‑total “reçu”",
]
UTF8 = ("latin-1", "cp1252", "cp437", "mac_roman", "cp1251", "cp850")
LEGACY = [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1252", "cp850"), ("cp1250", "cp1252"), ("cp1253", "latin-1"), ("gbk", "latin-1"), ("shift_jis", "cp1252")]


def garble(text, written, read):
    return mojibake.misread(text.encode(written), read)


@pytest.fixture(scope="module")
def patterns():
    return mojibake.Patterns()


@pytest.mark.parametrize("text", CLEAN + ["ТА УК СТАН", "联通 公司 重试", "설비 연결", "ราคา ยก", "کتاب رگ اپ", "שלום", "Größe ist ½"])
def test_clean_texts_are_left(patterns, text):
    for x in (text, "plain " + text):
        assert patterns.look(x) == (x, [])


@pytest.mark.parametrize("read", UTF8)
def test_utf8_read_as_something_else(patterns, read):
    for text in CLEAN:
        bad = garble(text, "utf-8", read)
        restored, pairs = patterns.look("ok: " + bad)
        assert pairs and restored == "ok: " + text, (read, text, bad, restored)
    twice = garble(garble("Gerät überhitzt", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert patterns.look(twice)[0] == "Gerät überhitzt"


@pytest.mark.parametrize("read", ["iso8859-5", "cp1255", "cp1256", "cp874", "gbk", "shift_jis", "iso8859-7", "cp852", "mac_cyrillic"])
def test_utf8_read_as_rarer_encodings(patterns, read):
    bad = garble("ошибка чтения", "utf-8", read)
    restored, pairs = patterns.look("node 7: " + bad)
    assert pairs and restored in ("node 7: ошибка чтения", None), (bad, restored)


@pytest.mark.parametrize("read", ["big5", "cp949", "iso8859-2"])
def test_utf8_read_as_encodings_that_lose_bytes_or_are_alike(patterns, read):
    bad = garble("ошибка чтения", "utf-8", read)
    assert patterns.look("node 7: " + bad)[1]


def test_legacy_pairs(spark):
    rows, want = [("s", i, t) for i, t in enumerate(CLEAN * 60)], {}
    for written, read in LEGACY:
        for text in CLEAN:
            try:
                bad = garble(text, written, read)
            except UnicodeEncodeError:
                continue
            if bad != text:
                want[10_000 + len(want)] = text, bad, written, read
    rows += [("s", i, bad) for i, (_, bad, _, _) in want.items()]
    mixed = {}
    for written, read in LEGACY:
        word = {"cp1251": "ошибка", "koi8-r": "ошибка", "cp1252": "Gerät", "cp1250": "połączenie", "cp1253": "σύνδεση", "gbk": "设备", "shift_jis": "装置の温度が高すぎます"}[written]
        mixed[20_000 + len(mixed)] = f"überhitzt {word} £3", f"überhitzt {garble(word, written, read)} £3"
    rows += [("s", i, bad) for i, (_, bad) in mixed.items()]
    got = {r["row_id"]: r["restored"] for r in mojibake.find_garbled(spark.createDataFrame(rows, "tbl string, row_id long, text string")).collect()}
    assert got.keys() == want.keys() | mixed.keys(), [want[i] for i in want if i not in got]
    for i, (text, bad) in mixed.items():  # what is right stays
        assert got[i] == text, (bad, got[i])


@pytest.mark.parametrize("others", [1000, 400_000])
def test_garbled_words_do_not_depend_on_other_rows(spark, others):
    from pyspark.sql import functions as F

    rows = [("s", i, "чтение сектора прервано") for i in range(100)] + [("s", 900, garble("чтение сектора прервано", "cp1251", "latin-1"))]
    more = spark.range(others).select(F.lit("s").alias("tbl"), (F.col("id") + 10_000).alias("row_id"), F.concat(F.lit("größe "), F.col("id").cast("string"), F.lit(" überhitzt für Straße")).alias("text"))
    df = spark.createDataFrame(rows, "tbl string, row_id long, text string").union(more)
    assert [(r["row_id"], r["restored"]) for r in mojibake.find_garbled(df).collect()] == [(900, "чтение сектора прервано")]


def test_lost_text(patterns):
    assert patterns.look("sesi�n") == (None, ["lost"])


def test_rare_words_of_legacy_pairs(spark):
    rows = [("s", i, t) for i, t in enumerate(CLEAN * 12)] + [("s", 500 + i, "Überprüfung beendet") for i in range(5)]
    rows += [("s", 900, garble("Überprüfung beendet", "cp1252", "cp850")), ("s", 901, garble("não foi possível: Köhlergasse", "cp1252", "cp850"))]
    got = {r["row_id"]: r["restored"] for r in mojibake.find_garbled(spark.createDataFrame(rows, "tbl string, row_id long, text string")).collect()}
    assert got == {900: "Überprüfung beendet", 901: "não foi possível: Köhlergasse"}


def test_garbled_table(spark):
    rows = [("s", i, t) for i, t in enumerate(CLEAN * 12)] + [("s", 900, garble(CLEAN[0], "utf-8", "cp1252")), ("s", 901, garble(CLEAN[2], "cp1251", "latin-1")), ("r", 901, "x�"), ("r", 902, None), ("r", 903, ""), ("r", 904, "é" * 50_000), (None, None, garble("Straße", "utf-8", "cp437"))]
    df = clashing(spark.createDataFrame(rows, "tbl string, row_id long, text string"))
    got = {(r["tbl"], r["row_id"]): r["restored"] for r in mojibake.find_garbled(df).collect()}
    assert got == {("s", 900): CLEAN[0], ("s", 901): CLEAN[2], ("r", 901): None, (None, None): "Straße"}
    assert mojibake.find_garbled(df.limit(0)).collect() == []


def messages(n=3000, seed=1):
    r = random.Random(seed)
    name = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randrange(2, 5)))
    names = [name() for _ in range(60)]
    make = [
        lambda: f"session {r.randrange(999)} opened for {r.choice(names)} from 10.0.0.{r.randrange(255)} port {r.randrange(9999)}",
        lambda: f"cache evicted {r.randrange(999)} entries ({r.randrange(999)} KiB) from {r.choice(names)}",
        lambda: f"job {r.choice(names)} finished with status {r.randrange(9)} in {r.randrange(999)} ms",
        lambda: "tick", lambda: "waiting for quorum...", lambda: f"token {r.getrandbits(32):08x} issued to {r.choice(names)}",
        lambda: f"Request from {r.choice(names)} waited {r.randrange(99)} ms for the lock held by {r.choice(names)}. upstream {r.choice(names)} returned {r.randrange(99)} rows but the header promised {r.randrange(99)}.",
    ]
    return [r.choice(make)() for _ in range(n)], r


def test_cut_texts(spark):
    texts, r = messages()
    limit = 100
    rows, want = [], set()
    for i, t in enumerate(texts):
        source = "st"[i % 2]  # only the first has a limit
        if len(t) > limit and source == "s":
            t, cut = t[:limit], True
        else:
            cut = r.random() < 0.03 and t not in ("tick", "waiting for quorum...") and not t.startswith(("cache", "token", "session"))
            if cut:
                t = t[: t.index("with sta") + r.randrange(3, 8)] if t.startswith("job") else t
                cut = t.startswith("job")
        rows.append((i, source, t))
        if cut:
            want.add(i)
    rows += [(9000, "s", None), (9001, "s", ""), (9002, None, "tick"), (9003, "u", "tick")]
    df = clashing(spark.createDataFrame(rows, "line_id long, logsource string, message string"))
    limits = spark.createDataFrame([("s", limit)], "logsource string, max_bytes int")
    judged = cutoff.judge_texts(df, limits)
    got = {x["line_id"] for x in judged.where("is_cut").collect()}
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.01 * len(rows)
    rates = {x["logsource"]: (x["n_rows"], x["n_cut"]) for x in cutoff.cut_rates(judged).collect()}
    assert rates["u"] == (1, 0) and rates[None] == (1, 0) and rates["s"][0] + rates["t"][0] == len(texts) and rates["s"][1] + rates["t"][1] == len(got)


def test_cut_edge_cases(spark):
    df = spark.createDataFrame([], "line_id long, logsource string, message string")
    limits = spark.createDataFrame([("s", 5)], "logsource string, max_bytes int")
    assert cutoff.judge_texts(df, limits).collect() == []
    long = spark.createDataFrame([(1, "s", "word " * 100_000), (2, "s", "~"), (3, "s", "...")], "line_id long, logsource string, message string")
    assert cutoff.judge_texts(long, limits).count() == 3


def test_limits(spark):
    sources = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", None)], "logsource string, schema_name string")
    columns = spark.createDataFrame([("x", "message", "str"), ("y", "message", ":77"), ("z", "message", "int"), ("y", "other", "str:3")], "schema_name string, name string, pv_type string")
    assert {r[0]: r[1] for r in cutoff.byte_limits(sources, columns).collect()} == {"a": 256, "b": 77, "c": None}


@pytest.mark.parametrize("others", [500, 300_000])
def test_verdicts_do_not_depend_on_other_rows(spark, others):
    """Three cut texts among two hundred complete ones are found beside any number of other rows."""
    from pyspark.sql import functions as F

    names = ["bado", "felimo", "gurane", "kolavi", "ludi", "mesato", "niru", "pavole"]
    rows = [(i, None, f"turbine {names[i % 8]} spun up after {i % 37} attempts on rail {i % 5}") for i in range(200)]
    rows += [(1000, None, "turbine felimo spun up aft"), (1001, None, "turbine niru spun"), (1002, None, "turbine ludi spun up after 3 attempts")]
    few = spark.createDataFrame(rows, "line_id long, logsource string, message string")
    many = spark.range(5000, 5000 + others).select(F.col("id").alias("line_id"), F.lit("s").alias("logsource"), F.concat(F.lit("conveyor moved crate "), F.col("id").cast("string"), F.lit(" to shelf "), (F.col("id") % 90).cast("string")).alias("message"))
    judged = cutoff.judge_texts(few.union(many), spark.createDataFrame([("s", 256)], "logsource string, max_bytes int"))
    assert sorted(r["line_id"] for r in judged.where("is_cut").collect()) == [1000, 1001, 1002]


def test_values_cut_at_one_place_do_not_vouch_for_themselves(spark):
    """A limit that cuts every text of a source at the same token; other sources show that they go on."""
    whole = [f"probe {1000 + i} measured the northern basin and reported nominal pressure" for i in range(40)]
    limit = len("probe 1000 measured the northern")
    rows = [(i, "s", t[:limit]) for i, t in enumerate(whole)] + [(100 + i, "u", t) for i, t in enumerate(whole[:12])]
    df = spark.createDataFrame(rows, "line_id long, logsource string, message string")
    judged = cutoff.judge_texts(df, spark.createDataFrame([("s", limit), ("u", 256)], "logsource string, max_bytes int"))
    assert sorted(r["line_id"] for r in judged.where("is_cut").collect()) == list(range(40))


def test_strict_prefixes_of_words():
    assert len(cutoff.word_starts("abc")) == 2
    assert cutoff.word_starts("abc")[1] == cutoff.word_starts("ab ")[-1]
    assert cutoff.word_starts("x") == []
