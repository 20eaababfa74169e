"""Log entries, bad rows and timestamps against brute force, with odd inputs."""

import csv
import io
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import clashing
from pyspark.sql import functions as F

from loomlog import queries
from loomlog.functions import timeshapes
from loomlog.functions.earley import Earley, Grammar
from loomlog.functions.loglines import LineParser
from loomlog.functions.typespec import parse_spec
from loomlog.operators import badrows, entries, timestamps

PARSER = LineParser()


@pytest.mark.parametrize(
    ("line", "level", "component", "text"),
    [
        ("Jan  4 00:16:58 edge-a kelonctl[22746]: WARN: disk full", "warn", "kelonctl", "disk full"),
        ("Jan  4 00:16:58 edge-a nunoni-agent: error in line", "none", "nunoni-agent", "error in line"),
        ("<34>Oct 11 22:14:15 host su[1]: 'su root' failed", "fatal", "su", "'su root' failed"),
        ("<191>1 2021-01-04T00:26:51.877Z h kestreld 23194 ID64 [meta seq=\"59 78\"] tarif", "debug", "kestreld", "tarif"),
        ("<13>1 2021-01-04T00:26:51+02:00 h app - - - msg", "info", "app", "msg"),
        ("I0104 00:23:01.684611 20554 a_svc.cc:48] lease granted", "info", "a_svc.cc", " lease granted"),
        ("F0104 00:23:01.684611     4 b.cc:4] x", "fatal", "b.cc", " x"),
        ("2021-01-04 00:34:41,163 INFO  [worker-15] zo.authgate.Tuso - consumer 1", "info", "zo.authgate.Tuso", "consumer 1"),
        ("[2021-01-04T01:32:10Z] [\x1b[31merror\x1b[0m] [falel] worker 585", "error", "falel", "worker 585"),
        ("[2021-01-04T01:32:10Z] [Critical] [falel] worker 585", "fatal", "falel", "worker 585"),
        ("2021-01-04 00:02:25|NOTICE|dilasd|22663|memory|x", "info", "dilasd", "memory|x"),
        ('{"time":"2021-01-04T00:27:59.907Z","severity":"NOTICE","logger":"svc","message":"a \\"b\\""}', "info", "svc", 'a \\"b\\"'),
        ('{"msg": "m", "name": "n", "lvl": "D", "pid": 10792, "@t": "2021-01-04T00:49:33+0000"}', "debug", "n", "m"),
        ('ts=2021-01-04T00:29:00Z component=kamimd level=E msg="heap of" n=7131', "error", "kamimd", "heap of"),
        ("1609723628.640 netprobe/15725 W text", "warn", "netprobe", "text"),
        ('10.1.2.3 - - [04/Jan/2021:00:26:45 +0000] "GET /b HTTP/1.1" 200 9487', "none", "none", "GET /b HTTP/1.1"),
    ],
)
def test_headers(line, level, component, text):
    found = PARSER.parse(line)
    assert (found.level, found.component, found.text) == (level, component, text)
    assert found.time


@pytest.mark.parametrize("line", ["", None, "   ", "\tat zo.a(B.java:1)", "  next try: 2021-01-04 23:17:44", "Caused by: x", "{", '  "a": 1,', '{"a": 1}', "0000  96 b3 63", "| a | 1 |", "SELECT a", "2021-01-04 is a date", "GROUP BY 1", "Traceback (most recent call last):", "x" * 100_000, '"' * 5000])
def test_other_lines(line):
    assert PARSER.parse(line) is None


def test_unparsed_spans():
    assert PARSER.read("\tat zo.a(B.java:1)") == (None, (0, 0))
    assert PARSER.read("Caused by: zo.a: gone") == (None, (0, 0))
    assert PARSER.read("not of any layout") == (None, (0, 17))
    header, rest = PARSER.read('{"time":"2021-01-04T23:17:44Z","level":"info","msg":"up"} trailing')
    assert header.text == "up" and rest == (57, 66)


def test_long_line_needs_little_memory():
    import tracemalloc

    line = '{"time":"2021-01-04T23:17:44Z","level":"warn",' + ",".join(f'"k{i}":{i}' for i in range(12_000)) + "}"
    tracemalloc.start()
    header = LineParser().parse(line)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert header is not None and header.level == "warn"
    assert peak < 60e6, peak  # 130 KB; a megabyte takes eight times as much


def test_earley_keeps_the_best_parse():
    g = Grammar("S: A @1 | B @5 | S S @-1\nA=first: x y\nB=second: x y z\n", "S")
    e = Earley(g)
    assert e.parse(["x", "y"]) == (1.0, 2, (("first", 0, 2),))
    assert e.parse("xyz") == (5.0, 3, (("second", 0, 3),))
    assert e.parse("xyzxyz")[:2] == (9.0, 6)
    assert e.parse("zzz") is None
    assert e.parse("xyq") == (1.0, 2, (("first", 0, 2),))
    left = Earley(Grammar("E: E + n @1 | n", "E"))
    assert left.parse(["n", "+", "n", "+", "n"])[:2] == (2.0, 5)
    assert Earley(g, max_nodes=1).parse("xyz")[0] == 5.0


RAW = "raw_id long, file_id long, line_no int, received_at timestamp, raw string"


def brute_entries(rows):
    out, current, last = [], None, None
    for f, n, _, raw in sorted((r[1], r[2], r[0], r[4]) for r in [(*x[:4], x[4] or "") for x in rows] if r[1] is not None and r[2] is not None):
        if (f, n) == last:
            continue
        last = f, n
        if current and current[0] != f:
            out.append(tuple(current))
            current = None
        if not raw.strip():
            continue
        h = PARSER.parse(raw)
        if h:
            if current:
                out.append(tuple(current))
            current = [f, n, n, h.level, h.component]
        elif current:
            current[2] = n
    return sorted([*out, tuple(current)] if current else out)


@pytest.mark.parametrize("seed", range(3))
def test_entries(spark, seed):
    r = random.Random(seed)
    choices = ["I0104 00:23:01.684611 1 a.cc:4] x", "\tmore", "plain", "", " ", None, "Jan  4 00:16:58 h p[1]: y"]
    at = datetime(2021, 1, 5)
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([r.randrange(1, 300), None] if i % 50 == 0 else [r.randrange(1, 300)]), at, r.choice(choices)) for i in range(700)]
    df = clashing(spark.createDataFrame(rows, RAW)).repartition(6)
    found = entries.read_entries(df)
    got = sorted((x["file_id"], x["first_line_no"], x["last_line_no"], x["level"], x["component"]) for x in found.collect())
    assert got == brute_entries(rows)


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_entry_over_ranges_keeps_its_text(spark, partitions):
    """One header and so many lines that they fill several ranges, with blank lines wherever borders may fall."""
    blank = lambda i: i % 9 == 0 or 300 < i < 420 or i % 4 == 1
    text = lambda i: "" if blank(i) else f"\tline {i}" if i % 2 else f"odd line {i}"
    rows = [(1, 1, 1, datetime(2021, 1, 5), "Jan  4 00:16:58 h p[1]: head")] + [(i, 1, i, datetime(2021, 1, 5), text(i)) for i in range(2, 2001)]
    rows += [(3000, 2, 1, datetime(2021, 1, 5), ""), (3001, 2, 2, datetime(2021, 1, 5), "Jan  4 00:16:59 h q: next")]
    found = sorted(entries.read_entries(spark.createDataFrame(rows, RAW).repartition(8), partitions).collect(), key=lambda x: x["file_id"])
    assert len(found) == 2 and found[1]["message"] == "next"
    assert (found[0]["first_line_no"], found[0]["last_line_no"]) == (1, 2000 if not blank(2000) else 1999)
    assert found[0]["message"] == "\n".join(["head", *map(text, range(2, 2001))]).rstrip("\n")
    spans = [(x["line_no"], x["start"], x["end"]) for x in found[0]["unparsed"]]
    assert spans == [(i, 0, len(text(i))) for i in range(2, 2001) if text(i).startswith("odd")]
    nothing = spark.createDataFrame([], RAW)
    assert entries.read_entries(nothing).collect() == []
    orphans = spark.createDataFrame([(1, 1, 1, None, "no header"), (2, 1, 2, None, "\tat x")], RAW)
    assert entries.read_entries(orphans).collect() == []


FIELDS = [badrows.Field("t", parse_spec("ts:%b %e %H:%M:%S"), True), badrows.Field("s", parse_spec("str:5"), True), badrows.Field("n", parse_spec("int"), False), badrows.Field("f", parse_spec("float"), False), badrows.Field("b", parse_spec("bool"), False)]
GOOD = "Apr  2 02:34:54,abc,4,1.5,TRUE"


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        (GOOD, None), ('"Apr 22 02:34:54","a,""b",+04,.5,false', None), ("Apr 22 02:34:54,é\né,,,", None), ('Apr 22 02:34:54,"a\nb",,,', None), ('Apr 22 02:34:54,a"b,,,', "quoting"), ('Apr 22 02:34:54,"ab"c,,,', "quoting"),
        ('Apr 22 02:34:54,"ab,,,', "quoting"), ('Apr 22 02:34:54, "ab",,,', "quoting"), ("Apr 22 02:34:54,ab,,", "column_count"), ("Apr 22 02:34:54,ab,,,,", "column_count"), (",ab,,,", "missing_value"), ('Apr 22 02:34:54,"",,,', "missing_value"),
        ("Apr 31 02:34:54,ab,,,", "invalid_value"), ("Feb 29 02:34:54,ab,,,", None), ("Apr 22 25:34:54,ab,,,", "invalid_value"), (" Apr 22 02:34:54,ab,,,", "invalid_value"), ("Apr 22 02:34:54,abcdef,,,", "invalid_value"), ("Apr 22 02:34:54,ééé,,,", "invalid_value"),
        ("Apr 22 02:34:54,a,1e3,,", "invalid_value"), ("Apr 22 02:34:54,a, 1,,", "invalid_value"), ("Apr 22 02:34:54,a,9223372036854775807,,", None), ("Apr 22 02:34:54,a,9223372036854775808,,", "invalid_value"), ("Apr 22 02:34:54,a,,1d,", "invalid_value"), ("Apr 22 02:34:54,a,,NaN,", None), ("Apr 22 02:34:54,a,,.,", "invalid_value"), ("Apr 22 02:34:54,a,,,yes", "invalid_value"), ("bad,,x,,", "invalid_value"),
    ],
)
def test_reasons(record, reason):
    assert badrows.diagnose(record, FIELDS)[0] == reason
    block = [GOOD] * 50 + [record] + [GOOD] * 50
    assert [x[0] for x in badrows.BlockParser(FIELDS).parse(block)] == [None] * 50 + [reason] + [None] * 50


@given(st.lists(st.lists(st.text(alphabet='ab",\n\ré ', max_size=4), min_size=1, max_size=4), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_blocks_agree_with_strict_parsing(rows):
    fields = [badrows.Field("x", parse_spec("str:6"), False), badrows.Field("y", parse_spec("str:6"), True)]
    records = []
    for i, row in enumerate(rows):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        records.append(out.getvalue() if i % 3 else ",".join(row))
    got = badrows.BlockParser(fields).parse(records)
    assert got == [badrows.diagnose(r, fields) for r in records]
    for r, row in ((r, row) for i, (r, row) in enumerate(zip(records, rows)) if i % 3):
        if row != [""]:
            assert badrows.split_record(r) == row


def test_bad_rows_table(spark):
    rows = [(1, "s", GOOD, "x"), (2, "s", None, "x"), (3, "s", " \t", "x"), (4, "s", "a,b", None), (5, None, "a", None), (6, "zz", "a", None), (7, "s", 'Apr 22 02:34:54,"' + "x" * 100_000 + '",,,', None), (1, "s", GOOD, "x")]
    df = clashing(spark.createDataFrame(rows, "rec_id long, schema_name string, raw_msg string, desc string"))
    judged = badrows.judge_records(df, {"s": FIELDS})
    assert sorted((r["row_id"], r["reason"] or "") for r in judged.collect()) == [(1, ""), (1, ""), (4, "column_count"), (5, "no_schema"), (6, "no_schema"), (7, "invalid_value")]
    typed = badrows.typed_rows(judged, FIELDS, "s", 2022).distinct().collect()
    assert [(r["t"].isoformat(), r["s"], r["n"], r["f"], r["b"]) for r in typed] == [("2022-04-02T02:34:54", "abc", 4, 1.5, True)]
    assert {r["desc"] for r in badrows.rejects(judged).collect()} == {"column_count", "no_schema", "invalid_value: s"}
    assert badrows.judge_records(df.limit(0), {}).collect() == []


def test_valid_records_of_every_schema(spark, tmp_path):
    columns = [("one", 0, "n", "int", True), ("one", 1, "s", "str:3", False), ("two", 0, "b", "bool", True), ("row_id", 0, "x", "float", False)]
    spark.createDataFrame(columns, "schema_name string, col_pos int, name string, pv_type string, required boolean").write.parquet(f"{tmp_path}/parsercoldef.parquet")
    records = [(1, "one", "5,ab"), (2, "one", "x,ab"), (3, "two", "TRUE"), (4, "row_id", "1.5"), (5, "three", "a"), (6, "one", "7,"), (7, "two", None)]
    spark.createDataFrame(records, "rec_id long, schema_name string, raw_msg string").write.parquet(f"{tmp_path}/logparseerror.parquet")
    found = {r["row_id"]: (r["schema_name"], r["record"].asDict(True)) for r in queries.p5_valid(spark, str(tmp_path)).collect()}
    none = dict.fromkeys(("one", "two", "row_id"))
    assert found == {
        1: ("one", none | {"one": {"n": 5, "s": "ab"}}),
        3: ("two", none | {"two": {"b": True}}),
        4: ("row_id", none | {"row_id": {"x": 1.5}}),
        6: ("one", none | {"one": {"n": 7, "s": None}}),
    }


FORMATS = {1: "%b %e %H:%M:%S", 2: "%Y-%m-%dT%H:%M:%S.%3f%z", 3: "%Y-%m-%dT%H:%M:%S", 6: "%m/%d/%Y %I:%M:%S %p", 8: "%s", 10: "%a %b %e %H:%M:%S %Y", 11: "%a, %d %b %Y %H:%M:%S %Z", 12: "%d/%m/%y %H:%M", 13: "%m-%d %H:%M:%S%.3f", 14: "%Y-%m-%dT%H:%M:%SZ", 15: "%s%3f"}
CAPTURE = "capture_id long, logsource string, program string, timestamp string, format_id int, received_at timestamp"


@pytest.mark.parametrize(
    ("text", "form", "source", "received", "want"),
    [
        ("2024-03-31T00:31:57", 3, "berlin", "2024-03-31 00:00:00", "2024-03-30T23:31:57.000000Z"),
        ("2022-03-27T02:42:39", 3, "berlin", "2022-03-27 02:42:35", None),
        ("2022-10-30T02:30:00", 3, "berlin", "2022-10-30 00:45:00", "2022-10-30T00:30:00.000000Z"),
        ("2022-10-30T02:30:00", 3, "berlin", "2022-10-30 01:45:00", "2022-10-30T01:30:00.000000Z"),
        ("Nov  6 01:30:00", 1, "york", "2022-11-06 05:45:00", "2022-11-06T05:30:00.000000Z"),
        ("Dec 31 23:59:59", None, "utc", "2023-01-01 00:00:05", "2022-12-31T23:59:59.000000Z"),
        ("Feb 29 12:00:00", 1, "utc", "2023-03-01 00:00:00", "2020-02-29T12:00:00.000000Z"),
        ("2020-06-25T16:45:57.727594+05:30", 1, "utc", "2020-06-25 12:00:00", "2020-06-25T11:15:57.727594Z"),
        (" 2024-12-14t04:08:09Z ", 14, "york", "2024-12-15 00:00:00", "2024-12-14T04:08:09.000000Z"),
        ("03/06/2021 12:21:14 am", 6, "utc", "2021-03-07 00:00:00", "2021-03-06T00:21:14.000000Z"),
        ("02/12/20 02:20", 12, "utc", "2021-01-01 00:00:00", "2020-12-02T02:20:00.000000Z"),
        ("Sun, 12 Sep 2021 03:09:19 IST", 3, "york", "2021-09-12 00:00:00", "2021-09-11T21:39:19.000000Z"),
        ("Mon, 12 Sep 2021 03:09:19 IST", 11, "york", "2021-09-12 00:00:00", None),
        ("1644355619", 10, "york", "2023-01-01 00:00:00", "2022-02-08T21:26:59.000000Z"),
        ("1645231235437", 15, "york", "2023-01-01 00:00:00", "2022-02-19T00:40:35.437000Z"),
        ("03-03 15:43:17.057", 13, "utc", "2021-03-04 00:00:00", "2021-03-03T15:43:17.057000Z"),
        ("2021-02-30T01:00:00", 3, "utc", "2021-03-04 00:00:00", None), ("2021-13-01T01:00:00", 3, "utc", "2021-03-04 00:00:00", None), ("2021-01-01T24:00:00", 3, "utc", "2021-03-04 00:00:00", None), ("2021-01-01X01:00:00", 3, "utc", "2021-03-04 00:00:00", None),
        ("0000-00-00 00:00:00", 3, "utc", "2021-03-04 00:00:00", None), ("Jun ", 1, "utc", "2021-03-04 00:00:00", None), ("-", 1, "utc", "2021-03-04 00:00:00", None), ("", 1, "utc", "2021-03-04 00:00:00", None), (None, 1, "utc", "2021-03-04 00:00:00", None),
        ("9" * 100_000, 8, "utc", "2021-03-04 00:00:00", None), ("٢٠٢١-01-01T00:00:00", 3, "utc", "2021-03-04 00:00:00", None), ("2021-01-01T01:00:00", 3, None, "2021-03-04 00:00:00", None), ("2021-01-01T01:00:00", 3, "nowhere", "2021-03-04 00:00:00", None), ("Jan  1 01:00:00", 1, "utc", None, None),
        ("2021-01-01T01:00:00+9900", 3, "utc", "2021-03-04 00:00:00", None),
    ],
)
def test_instants(spark, text, form, source, received, want):
    when = datetime.fromisoformat(received) if received else None
    df = clashing(spark.createDataFrame([(1, source, None, text, form, when)], CAPTURE))
    sources = spark.createDataFrame([("berlin", "Europe/Berlin"), ("york", "America/New_York"), ("utc", "UTC"), ("nowhere", "Mars/Base")], "logsource string, zone string")
    formats = spark.createDataFrame(list(FORMATS.items()), "format_id int, format_specifier string")
    out = timestamps.capture_times(df, clashing(sources), formats).select(timestamps.utc_text(F.col("ts_us"))).collect()
    assert [r[0] for r in out] == [want]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC", "Australia/Lord_Howe"])
def test_zone_tables(zone):
    table, tz = timeshapes.zone_table(zone), ZoneInfo(zone)
    r = random.Random(1)
    utc = [r.randrange(0, 2_500_000_000) for _ in range(3000)]
    utc += [int(s) + d for s in table.starts[1:].tolist() for d in (-1, 0, 1)]
    want = [int(datetime.fromtimestamp(t, tz).utcoffset().total_seconds()) for t in utc]
    assert table.at(np.array(utc)).tolist() == want
    local = np.array([t + o for t, o in zip(utc, want)])
    first, last, count = table.instants(local)
    assert ((first <= utc) & (last >= utc) & (count >= 1) & (count <= 2)).all()


@given(st.datetimes(min_value=datetime(1971, 1, 1), max_value=datetime(2090, 1, 1)))
@settings(max_examples=200, deadline=None)
def test_civil_days(t):
    t = t.replace(tzinfo=timezone.utc)
    y, m, d = (np.array([x]) for x in (t.year, t.month, t.day))
    assert timeshapes.days_from_civil(y, m, d)[0] == (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(days=1)
    text = t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond:06d}"
    shapes = timeshapes.Shapes({1: "%Y-%m-%dT%H:%M:%S%.6f"})
    parser = shapes.parser(timeshapes.mask_of(text), None)
    got = timeshapes.convert([text], parser, np.array(["UTC"], object), np.array([0]), {"UTC": timeshapes.zone_table("UTC")})
    assert got[0] == (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def test_empty_captures(spark):
    df = spark.createDataFrame([], CAPTURE)
    sources = spark.createDataFrame([], "logsource string, zone string")
    formats = spark.createDataFrame([(1, None), (2, "%Q")], "format_id int, format_specifier string")
    assert timestamps.capture_times(df, sources, formats).collect() == []


def test_padded_times_and_many_zone_names(spark):
    at = datetime(2024, 6, 1)
    rows = [(1, "s", "2024-01-04" + " " * 300 + "10:00:00", 1, at), (2, "s", " " * 900 + "2024-01-04 10:00:00\n", 1, at), (3, "s", "9" * 100_000, 1, at), (4, "bad", "2024-01-04 10:00:00", 1, at)]
    captures = clashing(spark.createDataFrame(rows, "capture_id long, logsource string, timestamp string, format_id int, received_at timestamp"))
    sources = spark.createDataFrame([("s", "Europe/Berlin"), ("bad", "No/Where"), *[(f"x{i}", f"No/Zone{i}") for i in range(3000)]], "logsource string, zone string")
    formats = spark.createDataFrame([(1, "%Y-%m-%d %H:%M:%S")], "format_id int, format_specifier string")
    got = {r["capture_id"]: r["ts_us"] for r in timestamps.capture_times(captures, sources, formats).collect()}
    assert got[1] == got[2] == 1704358800_000_000 and got[3] is None and got[4] is None
    assert {r["zone"] for r in timestamps.zone_transitions(sources).collect()} == {"Europe/Berlin"}
