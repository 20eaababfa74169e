"""The log pipeline: configuration, framing, grok, parse, SQL, batches and sinks."""

import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.config import ConfigError, EngineConfig, ServerAddress, load, parse_column, parse_input
from loomlog.engine import prepare, run_batch
from loomlog.functions import grok
from loomlog.functions.timefmt import matches, needs_year, needs_zone
from loomlog.functions.typespec import parse_spec
from loomlog.operators import batching, framing, parsing
from loomlog.plans.compiler import run_query
from loomlog.plans.parser import SqlError, parse
from loomlog.sinks import formats

SYSLOG = """Apr 22 02:34:54 hosta login[49532]: session opened
Apr 22 04:42:04 hosta syslogd[103]: heartbeat ok
Apr 22 04:43:04 hosta syslogd[104]: heartbeat ok
Apr 22 04:43:34 hosta syslogd[104]: heartbeat ok
Apr 22 04:48:50 hosta login[49531]: session opened
""".splitlines()
COLUMNS = tuple(map(parse_column, ("+timestamp:ts:%b %e %H:%M:%S", "+message:str:65535", "+logsource:str:256", "+program:str:256", "+pid:int")))
WHERE = """ where message = "heartbeat ok" and timestamp > DATE("%b %e %H:%M:%S","Apr 22 03:00:00") and timestamp < DATE("%b %e %H:%M:%S","Apr 22 05:00:00")"""


@pytest.fixture(scope="module")
def rows(spark):
    pattern = grok.expand("%{SYSLOGLINE}", grok.library())
    messages = batching.with_batches(framing.messages_from_lines(spark, SYSLOG), 1000)
    return parsing.parsed(parsing.parse_messages(messages, pattern, COLUMNS, 2022)).cache()


def ask(rows, query, **more):
    return [tuple(r) for r in run_query(rows, query, default_year=2022, **more).collect()]


@pytest.mark.parametrize("semantics", ["sql", "log"])
def test_twelve_queries(rows, semantics):
    q = lambda text: ask(rows, text, semantics=semantics)
    assert [r[4] for r in q(f"select * from SYSLOGLINE{WHERE} limit 3 offset 1")] == [104, 104]
    two = run_query(rows, f"select timestamp as ts, program as prog, 2+2 as four, 3/2.0 from SYSLOGLINE{WHERE} limit 3 offset 1", semantics, default_year=2022)
    assert two.columns == ["ts", "prog", "four", "4"]
    assert [(str(r[0]), *r[1:]) for r in two.collect()] == [("2022-04-22 04:43:04", "syslogd", 4, 1.5), ("2022-04-22 04:43:34", "syslogd", 4, 1.5)]
    assert [r[1] for r in q(f"select timestamp as ts, ((program || ':') || pid) as prog from S{WHERE} limit 3 offset 1")] == ["syslogd:104"] * 2
    with pytest.raises(Exception, match="(?i)zero"):
        q(f"select timestamp, 2/0 from S{WHERE}")
    assert len(q("select timestamp as ts, ((program || ':') || pid) as prog from S limit 5")) == 5
    assert q("select count(*) as cnt from S") == [(5,)]
    assert q("select program, count(*) as cnt from S group by 1 order by 1") == [("login", 2), ("syslogd", 3)]
    for name, login, syslogd in (("min", 49531, 103), ("max", 49532, 104), ("sum", 99063, 311), ("avg", 49531.5, 311 / 3)):
        assert q(f"select program, {name}(pid) from S group by 1 order by 1") == [("login", login), ("syslogd", pytest.approx(syslogd))]
    assert q("select program, avg(pid), max(pid), min(pid), count(), count(distinct(pid)) from S group by 1 order by 1") == [("login", 49531.5, 49532, 49531, 2, 2), ("syslogd", pytest.approx(311 / 3), 104, 103, 3, 2)]


def test_rejects_have_reasons(spark):
    pattern = grok.expand("%{SYSLOGLINE}", grok.library())
    lines = [*SYSLOG, "Apr 22 02:34:54 hosta", "Apr 22 02:34:54 hosta prog: no pid", ""]
    parsed = parsing.parse_messages(framing.messages_from_lines(spark, lines), pattern, COLUMNS, 2022)
    assert parsing.parsed(parsed).count() == 5
    assert sorted(r["desc"] for r in parsing.rejected(parsed).collect()) == ["no value for required column pid", "pattern did not match"]


def test_second_lookup_is_used(spark):
    columns = tuple(map(parse_column, ("number,word:int", "rest,word")))
    g = grok.expand("(?<number>[a-z]*)%{SPACE}%{NUMBER:word}", grok.library())
    out = parsing.parse_messages(framing.messages_from_lines(spark, ["abc 12"]), g, columns)
    assert out.select("number", "rest").first() == (12, "12")


@pytest.mark.parametrize(
    ("spec", "text", "value"),
    [("int", "4", 4), ("int", "+4", 4), ("int", " 12 ", None), ("int", "9223372036854775808", None), ("float", "4", 4.0), ("float", "1d", None), ("float", ".5", 0.5), ("float", "5.", 5.0), ("float", "1e3", 1000.0), ("float", ".", None), ("float", "inf", float("inf")), ("bool", "TRUE", True), ("bool", "yes", None), ("str", "x" * 256, "x" * 256), ("str", "x" * 257, None), ("str:2", "é", "é"), ("str:2", "éa", None), (":3", "abc", "abc"), ("null", "x", None)],
)
def test_conversions(spark, spec, text, value):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(parse_spec(spec).convert(F.col("x"))).first()[0] == value


def test_times(spark):
    def instant(fmt, text):
        df = spark.createDataFrame([(text,)], "x string")
        return df.select(parse_spec(f"ts:{fmt}").convert(F.col("x"), 2022).cast("string")).first()[0]

    assert instant("%Y-%m-%d %H:%M:%S.%3f%z", "2022-04-20 21:12:55.999+0200") == "2022-04-20 19:12:55.999"
    assert instant("%Y-%m-%dT%H:%M:%S.%3f%z", "2022-04-20T21:12:55.999+0300") == "2022-04-20 18:12:55.999"
    assert instant("%b %e %H:%M:%S", "Apr  2 02:34:54") == "2022-04-02 02:34:54"
    assert instant("%b %e %H:%M:%S", "Apr 31 02:34:54") is None
    assert instant("%d/%m/%Y", "31/12/2021") == "2021-12-31 00:00:00"
    assert needs_year("%b %e %H:%M:%S") and needs_year("%H.%3f") and not needs_year("%s") and not needs_year("%d %Y")
    assert needs_zone("%Y") and not needs_zone("%z") and not needs_zone("%:z")
    assert matches("%b %e", "Feb 29") and not matches("%b %e", "Feb 30") and not matches("%b %e", " Feb 2")
    with pytest.raises(ValueError):
        parse_spec("ts")
    with pytest.raises(ValueError):
        parse_spec("decimal")


MULTI = ("<191>May 25 10:00:00 box Configuration Notice:\n\tProfile one\r\n\tOwner: two\n" * 9) + "<13>one\n\n<>two\nthree\n<14>four\nfive"


def test_merge_counts(spark, tmp_path):
    for copies in (1, 64):
        path = tmp_path / f"log{copies}.txt"
        path.write_text((MULTI + "\n") * copies)
        merged = framing.read_messages(spark, str(path), True)
        assert merged.count() == 14 * copies
        assert framing.read_messages(spark, str(path), False).count() == 32 * copies
        assert [r[0] for r in merged.orderBy("_seq").limit(1).select("_raw").collect()] == ["May 25 10:00:00 box Configuration Notice: \tProfile one \tOwner: two"]
        assert sorted(r[0] for r in merged.select("_seq").collect()) == list(range(14 * copies))


def test_merge_over_splits(spark, tmp_path):
    """Splits of a few bytes give the same messages as the whole file."""
    path = tmp_path / "split.txt"
    path.write_text("\tfirst\n" + "".join(f"line {i}\n" + "\tmore\n" * (i % 5) for i in range(300)))
    whole = list(framing.merge_lines(path.read_text().split("\n")))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        got = framing.read_messages(spark, str(path), True).orderBy("_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["_raw"] for r in got] == whole
    assert [r["_seq"] for r in got] == list(range(len(whole)))


@given(st.lists(st.sampled_from(["a", " b", "\tc", "", "<12>d", "<>e"])), st.booleans(), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_line_buffer_is_incremental(lines, merge, step):
    from loomlog.streaming.lines import LineBuffer

    data = "\n".join(lines).encode()
    one = LineBuffer(merge)
    whole = one.feed(data) + one.flush()
    two, out = LineBuffer(merge), []
    for i in range(0, len(data), step):
        out += two.feed(data[i : i + step])
    assert out + two.flush() == whole
    stripped = [re.sub("^<[0-9]*>", "", x) for x in lines]
    assert whole == (list(framing.merge_lines(stripped)) if merge else [x for x in stripped if x])


def test_batches(spark, tmp_path):
    path = tmp_path / "dummy.txt"
    path.write_text("".join(f"{i} line number {i}\n" for i in range(99)))
    out = tmp_path / "out"
    config = EngineConfig(input=str(path), output=str(out), grok_pattern="DUMMY", grok_patterns={"DUMMY": "%{NUMBER:num} +%{GREEDYDATA:message}"}, columns=tuple(map(parse_column, ("+num:int", "+message:str:65535"))), output_batch_size=10, query="select count(*) as n, min(num) as first from x")
    engine = prepare(config)
    result, rejected = engine.run(framing.read_messages(spark, str(path)))
    assert sorted((r["n"], r["first"]) for r in result.collect()) == sorted([(10, i * 10) for i in range(9)] + [(9, 90)])
    assert rejected.count() == 0
    run_batch(spark, config)
    assert sorted("".join(p.read_text() for p in out.glob("part-*")).split()) == sorted([f"10,{i * 10}" for i in range(9)] + ["9,90"])
    assert batching.flush_sizes([99, None, None], 10) == [10] * 9 + [9]
    assert batching.flush_sizes([9, None, 1, None], 10) == [9, 1]
    assert batching.flush_sizes([99], 0) == [99]


@given(st.integers(1, 9), st.integers(0, 4), st.integers(0, 5))
@settings(max_examples=6, deadline=None)
def test_batch_limit_offset(spark, size, offset, limit):
    data = [(i, (i * 7) % 5) for i in range(23)]
    df = spark.createDataFrame([(i, x, i // size) for i, x in data], "_seq long, x long, _batch long")
    got = run_query(df, f"select x from t order by 1 desc limit {limit} offset {offset}", scope="batch").collect()
    want = []
    for b in range(0, len(data), size):
        part = sorted(data[b : b + size], key=lambda r: (-r[1], r[0]))
        want += [(x, b // size) for _, x in part[offset : offset + limit]]
    assert sorted((r["x"], r["_batch"]) for r in got) == sorted(want)


def test_log_semantics(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, 2, "b"), (2, 4, None)], "_seq long, x long, s string")
    q = lambda text, how="log": ask(df, text, semantics=how)
    assert q("select sum(x), avg(x), min(x), max(x), count(x), count(distinct x) from t") == [(6, 2.0, None, 4, 3, 3)]
    assert q("select sum(x), avg(x), min(x), max(x), count(x), count(distinct x) from t", "sql") == [(6, 3.0, 2, 4, 2, 2)]
    assert q("select s || ':' || x as y from t order by 1") == [("NULL:4",), ("a:NULL",), ("b:2",)]
    assert q("select s from t where x < 3 order by 1") == [("a",), ("b",)]
    assert q("select s from t where x < 3", "sql") == [("b",)]
    assert q("select s from t where x <> 2 order by 1") == [(None,), ("a",)]
    assert q("select count(*) from t where x > 99") == []
    assert q("select count(*) from t where x > 99", "sql") == [(0,)]
    assert q("select s from t where not (x = 2) order by 1") == [(None,), ("a",)]
    assert q("select x from t where x is null") == [(None,)]
    assert q("select s from t where x xor x = 2 order by 1") == [(None,)]
    assert q("select x from t where x <= 2 order by 1", "sql") == [(2,)]
    assert q("select -7/2, -7%2, 7/2.0 from t limit 1") == [(-3, -1, 3.5)]
    assert q("select x+1 as x from t where x = 3", "sql") == [(3,)]
    assert q("select x from t order by 1 limit 0") == []


@pytest.mark.parametrize(
    "text",
    [
        "with a as (select 1) select 1", "select 1 union select 2", "select 1; select 2", "insert into t values (1)", "select a.b from t", "select 1 is distinct from 2", "select x <=> 1 from t", "select x in (select 1) from t",
        "select a | b from t", "select a ~ 'x' from t", "select extract(year from x) from t", "select substring(x from 1) from t", "select interval '1 day'", "select date '2020-01-01'", "select exists (select 1)", "select f(a => 1) from t",
        "select t.* from t", "select * from a join b on 1=1", "select * from a, b", "select sum(x) over () from t", "select top 3 x from t", "select x from (select 1) t", "select (1,2)", "select ?", "select x[1] from t", "select sum(x) filter (where x > 1) from t", "select N'x'", "select ~1", "values (1)", "select x from t fetch first 1 rows only", "select x from t lateral view explode(y) z",
    ],
)
def test_refused_syntax(text):
    with pytest.raises(SqlError):
        parse(text)


@pytest.mark.parametrize(
    "text",
    ["select nope from t", "select upper(program) from t", "select program, count(*) from t", "select program from t group by 1", "select program, count(*) from t group by 3", "select *, count(*) from t", "select pid as a, program as a from t", "select sum(program) from t", "select program + 1 from t", "select pid from t where count(*) > 1", "select pid from t limit -1", "select pid from t limit pid", "select sum(pid, pid) from t", "select sum(*) from t", "select date('%Y', message) from t", "select sum(max(pid)) from t", "select pid from t order by 2"],
)
def test_refused_queries(rows, text):
    with pytest.raises(SqlError):
        run_query(rows, text)


def test_grok_library():
    lib = grok.library({"TWO": "%{INT:a}-%{INT:a}", "OPT": "x(?:%{INT:a})?", "LOOP": "%{LOOP}"})
    assert [g.index for g in grok.expand("%{TWO}", lib, True).groups["a"]] == [1, 2]
    assert grok.expand("%{OPT}", lib).groups["a"][0].optional
    assert not grok.expand("%{TWO}", lib).groups["a"][0].optional
    assert set(grok.expand("%{TWO}", lib, True).groups) == {"a"}
    for bad in ("%{LOOP}", "%{NOPE}", "(("):
        with pytest.raises(grok.GrokError):
            grok.expand(bad, lib)
    with pytest.raises(grok.GrokError):
        grok.expand("%{INT}", grok.library(ignore_defaults=True))
    for name in grok.PATTERNS:
        grok.expand(f"%{{{name}}}", grok.PATTERNS)
    assert grok.read_patterns("# c\n\nA x+\nB %{A} y\n") == {"A": "x+", "B": "%{A} y"}
    samples = {"TIMESTAMP_ISO8601": "2022-04-20T21:12:55.999+03:00", "IP": "10.1.2.3", "UUID": "8eab415b-03d7-42ad-51be-647cd1981695", "NUMBER": "-1.5", "HTTPDATE": "04/Jan/2021:00:26:45 +0000", "QUOTEDSTRING": '"a b"', "URI": "http://a.b/c?d=1"}
    for name, text in samples.items():
        assert re.fullmatch(grok.expand(f"%{{{name}}}", grok.PATTERNS).regex, text), name


def test_config(tmp_path):
    assert parse_input("syslog-tcp:127.0.0.1:514") == ServerAddress("tcp", "127.0.0.1", 514)
    assert parse_input("syslog-udp:[::1]:514") == ServerAddress("udp", "::1", 514)
    assert parse_input("syslog-udp:::1:514") == ServerAddress("udp", "::1", 514)
    for bad in ("syslog-sctp:a:1", "syslog-tcp:a", "syslog-tcp:a:x"):
        with pytest.raises(ConfigError):
            parse_input(bad)
    c = parse_column("program::100")
    assert (c.name, c.spec.max_len, c.required) == ("program", 100, False)
    c = parse_column("+a,b:ts:%H:%M")
    assert (c.lookups, c.spec.fmt, c.required) == (("a", "b"), "%H:%M", True)
    path = tmp_path / "c.yml"
    path.write_text("input: blah\noutput-batch-size: 7\ncolumns: ['+message::65536', 'pid:int']\ngrok-patterns: ['X a b']\n")
    config = load(["-c", str(path), "-b", "9", "-e", "Y c"])
    assert (config.input, config.output_batch_size, config.grok_patterns, config.schema[0].spec.max_len) == ("blah", 9, {"X": "a b", "Y": "c"}, 65536)
    defaults = load([])
    assert (defaults.input, defaults.output, defaults.output_format, defaults.output_batch_size, defaults.tick_interval, [c.name for c in defaults.schema]) == ("-", "-", "csv", 1000, 30.0, ["timestamp", "message", "logsource", "program", "pid"])
    for bad in ({"output_format": "odbc"}, {"output_batch_size": -1}):
        with pytest.raises(ConfigError):
            EngineConfig(**bad)


def test_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, None, 'a"b,c', True, 1.5e10), (2, "it's", "x", None, 1e-7)], "a long, s string, t string, b boolean, d double")
    assert [r[0] for r in formats.csv_lines(df.coalesce(1)).collect()] == ['1,NULL,"a""b,c",true,15000000000', "2,it's,x,NULL,0.0000001"]
    statements = [r[0] for r in formats.insert_statements(df.coalesce(1), "t", 2).collect()]
    assert statements == ["INSERT INTO t (a, s, t, b, d)\n VALUES \n(1, NULL, 'a\"b,c', TRUE, 15000000000),\n(2, 'it''s', 'x', NULL, 0.0000001);"]
    five = [r[0] for r in formats.insert_statements(rows.orderBy("_seq").coalesce(1), "SYSLOGLINE", 2).collect()]
    assert [s.count("\n(") for s in five] == [2, 2, 1]
    assert "'2022-04-22 02:34:54'" in five[0]
    ddl = formats.create_table(rows.schema, "SYSLOGLINE", "IF NOT EXISTS", "WITHOUT ROWID")
    assert ddl == "CREATE TABLE IF NOT EXISTS SYSLOGLINE (\n    timestamp TIMESTAMP,\n    message TEXT,\n    logsource VARCHAR(256),\n    program VARCHAR(256),\n    pid BIGINT\n) WITHOUT ROWID;"
    assert formats.sql_name("4") == '"4"'
    target = tmp_path / "csv"
    formats.write_csv(df, str(target), add_header=True, single=True)
    assert next(target.glob("part-*")).read_text().splitlines()[0] == "a,s,t,b,d"
    base = str(tmp_path / "x.db")
    sqlite3.connect(base).execute("create table t (a, s, t, b, d)").connection.close()
    formats.write_dbapi(df.coalesce(1), lambda: sqlite3.connect(base), "t", 1)
    assert sqlite3.connect(base).execute("select count(*), sum(a) from t").fetchone() == (2, 3)
    csv_time = formats.csv_lines(rows.orderBy("_seq").limit(1).select("timestamp")).first()[0]
    assert csv_time in ("2022-04-22 02:34:54 +00:00",)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    from loomlog.__main__ import main

    path = tmp_path / "in.log"
    path.write_bytes(b"\n".join(line.encode() for line in SYSLOG) + b"\nApr 22 05:00:00 hosta x[7]: bad \xff byte\n\nnot a log line\n")
    assert main(["-i", str(path), "-f", "sql", "--output-add-ddl", "--output-table-name", "t", "--default-year", "2022", "-q", "select timestamp, program, message from SYSLOGLINE where pid < 105 order by 1"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("CREATE TABLE t (\n    timestamp TIMESTAMP,\n    program VARCHAR(256),\n    message TEXT\n);\nINSERT INTO t (timestamp, program, message)\n VALUES \n")
    assert "'bad � byte'" in out and out.count("\n(") == 4
    monkeypatch.setattr(sys, "stdin", io.StringIO("\n".join(SYSLOG)))
    assert main(["--default-year", "2022", "--scope", "global", "-q", "select program, count(*) as n from x group by 1 order by 1"]) == 0
    assert capsys.readouterr().out == "login,2\nsyslogd,3\n"
    assert main(["--grok-list-default-patterns"]) == 0
    assert "SYSLOGLINE %{SYSLOGBASE} %{GREEDYDATA:message}" in capsys.readouterr().out
    with pytest.raises(SqlError):
        main(["-i", str(path), "-q", "select nope from x"])
    with pytest.raises(grok.GrokError):
        main(["-i", str(path), "-g", "NOPE"])


def test_patterns_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("KV %{WORD:key}=%{NUMBER:value}\n")
    config = EngineConfig(grok_pattern="KV", grok_patterns_file=str(tmp_path / "p.txt"), columns=(parse_column("+key"), parse_column("value:float")))
    result, rejected = prepare(config).run(framing.messages_from_lines(spark, ["a=1", "b=x", "c=2.5 "]))
    assert sorted((r["key"], r["value"]) for r in result.collect()) == [("a", 1.0), ("c", 2.5)]
    assert [r["raw_msg"] for r in rejected.collect()] == ["b=x"]


def test_separator_in_messages(spark):
    g = grok.expand("%{WORD:a} %{DATA:b}$", grok.library())
    sep = parsing.SEPARATOR
    rows = parsing.parse_messages(framing.messages_from_lines(spark, [f"x 1{sep}2", "y 3", sep]), g, (parse_column("+a"), parse_column("b")))
    assert sorted((r["a"] or "", r["b"] or "", r["_error"] or "") for r in rows.collect()) == [("", "", "pattern did not match"), ("x", f"1{sep}2", ""), ("y", "3", "")]


SAMPLES = {
    "numbered.yml": """
input: "-"
merge_multi_line: false
grok_pattern: NUMBERED
grok_schema_columns:
  - "+timestamp:ts:%Y-%m-%dT%H:%M:%S"
  - "+num:int"
  - "+message"
grok_with_alias_only: false
grok_ignore_default_patterns: false
grok_extra_patterns:
  - "NUMBERED %{TIMESTAMP_ISO8601:timestamp} %{NUMBER:num} +%{GREEDYDATA:message}"
output: "-"
output_format: csv
output_batch_size: 1000
output_add_ddl: false
rayon_threads: 2
tick_interval: 30
idle_timeout: 30
async_channel_size: 2000
""",
    "syslog.yml": """
input: /var/log/syslog
merge_multi_line: true
grok_pattern: SYSLOGLINE
grok_schema_columns:
  - "+timestamp:ts:%b %e %H:%M:%S"
  - "logsource:str:50"
  - "program::100"
  - "pid:int"
  - "+message::65536"
output: "-"
output_format: sql
output_batch_size: 1000
rayon_threads: 2
grok_load_default: true
""",
}


@pytest.mark.parametrize("name", SAMPLES)
def test_sample_configurations(tmp_path, name):
    from loomlog.config import load
    from loomlog.engine import prepare

    (tmp_path / name).write_text(SAMPLES[name])
    config = load(["-c", str(tmp_path / name)])
    assert prepare(config).pattern.groups.keys() >= {"timestamp", "message"}
    assert not config.grok_ignore_default_patterns and config.columns[0].required


def test_long_texts_do_not_overflow_the_stack(spark):
    from pyspark.sql import functions as F

    from loomlog.functions import grok

    long = [("QUOTEDSTRING", '"' + "a" * 60_000 + '"'), ("QUOTEDSTRING", '"' + '\\"' * 30_000 + '"'), ("PATH", "/a" * 30_000), ("URIPATH", "/a" * 30_000), ("WINPATH", "C:" + "\\a" * 30_000), ("HOSTNAME", "a." * 30_000), ("NOTSPACE", "x" * 60_000), ("DATA", "x" * 60_000)]
    for name, text in long:
        g = grok.expand(f"^%{{{name}:x}}", grok.library())
        found = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract("t", g.regex, g.groups["x"][0].index)).first()[0]
        assert found == text or name in ("HOSTNAME", "DATA"), name
    line = '10.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /x HTTP/1.0" 200 2326 "' + "r" * 60_000 + '" "' + "u\\\\" * 30_000 + '"'
    g = grok.expand("%{COMBINEDAPACHELOG}", grok.library())
    assert spark.createDataFrame([(line,)], "t string").where(F.col("t").rlike(g.regex)).count() == 1
    assert all(grok.deep_repeats(grok.expand(f"%{{{n}}}", grok.library()).regex) == 0 for n in grok.PATTERNS)
    assert grok.deep_repeats(r'"(?:[^"\\]|\\.)*"') == 1


def test_rejects_and_single_file(spark, tmp_path, capfd):
    from loomlog.config import load
    from loomlog.engine import run_batch

    (tmp_path / "in.log").write_text("1 one\nbad\n2 two\n")
    out = tmp_path / "out.csv"
    argv = ["-i", str(tmp_path / "in.log"), "-o", str(out), "-g", "N", "-e", "N %{INT:num} %{WORD:word}", "-s", "+num:int", "-s", "word", "--single-file", "--output-add-ddl"]
    run_batch(spark, load(argv))
    run_batch(spark, load(argv))
    assert out.read_text() == "num,word\n1,one\n2,two\n1,one\n2,two\n"
    assert capfd.readouterr().err.count("rejected: pattern did not match: bad") == 2
    run_batch(spark, load([*argv, "--rejects", str(tmp_path / "bad")]))
    assert spark.read.text(str(tmp_path / "bad")).collect()[0][0] == "pattern did not match,bad"


def test_checkpoint_folder_is_needed_off_local_mode(spark):
    from types import SimpleNamespace

    from loomlog.session import checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))
