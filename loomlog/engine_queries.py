"""Queries over the log pipeline's operators and the SQL each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ConfigError, parse_column, parse_input
from .engine import default_patterns
from .functions import grok
from .functions.typespec import parse_spec
from .operators import batching, framing, parsing
from .plans.compiler import run_query
from .session import checkpoint_dir, table
from .sinks import formats
from .streaming.lines import LineBuffer

#: Queries of the SQL front end: name to (table, query, the same for DuckDB).  Doubles are rounded on both sides.
SELECTS: dict[str, tuple[str, str, str]] = {
    "scan_project": ("events", "select event_id, event_type from events", "SELECT event_id, event_type FROM events"),
    "scan_star": ("supplier", "select * from supplier", "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 4) AS s_acctbal FROM supplier"),
    "project_arith": (
        "events", "select event_id, 2+2 as four, 7/2 as quotient, -7/2 as negative, 7%2 as rest, -7%2 as negative_rest, value*2 as twice, user_id-event_id as difference, event_id/3.0 as third from events",
        "SELECT event_id, 4::BIGINT AS four, 3::BIGINT AS quotient, (-3)::BIGINT AS negative, 1::BIGINT AS rest, (-1)::BIGINT AS negative_rest, round(value*2, 4) AS twice, user_id-event_id AS difference, round(event_id/3.0::DOUBLE, 4) AS third FROM events",
    ),
    "unnamed_columns": ("events", "select event_id, user_id+1, 'x' from events", "SELECT event_id, user_id+1 AS \"2\", 'x' AS \"3\" FROM events"),
    "literals": ("region", "select r_regionkey, true as yes, false as no, 'it''s' as one, \"two\" as two, 2.5 as half from region", "SELECT r_regionkey, true AS yes, false AS no, 'it''s' AS one, 'two' AS two, 2.5::DOUBLE AS half FROM region"),
    "concat": ("events", "select event_id, event_type || ':' || user_id as tag from events", "SELECT event_id, event_type || ':' || user_id AS tag FROM events"),
    "filter_eq": ("events", "select event_id from events where user_id = 7", "SELECT event_id FROM events WHERE user_id = 7"),
    "filter_ne": ("events", "select event_id from events where event_type <> 'view'", "SELECT event_id FROM events WHERE event_type <> 'view'"),
    "filter_lt": ("events", "select event_id from events where value < 10", "SELECT event_id FROM events WHERE value < 10"),
    "filter_le": ("events", "select event_id from events where user_id <= 10", "SELECT event_id FROM events WHERE user_id <= 10"),
    "filter_gt": ("events", "select event_id from events where value > 50", "SELECT event_id FROM events WHERE value > 50"),
    "filter_ge": ("events", "select event_id from events where user_id >= 100", "SELECT event_id FROM events WHERE user_id >= 100"),
    "filter_text_number": ("events", "select event_id from events where event_id || '' = event_id and user_id = '7'", "SELECT event_id FROM events WHERE user_id = 7"),
    "filter_and_or_xor_not": (
        "events", "select event_id from events where (event_type = 'view' or event_type = 'click') and not user_id > 50 xor value > 60",
        "SELECT event_id FROM events WHERE (((event_type = 'view' OR event_type = 'click') AND NOT user_id > 50) <> (value > 60))",
    ),
    "filter_truthy": ("events", "select event_id from events where user_id % 3", "SELECT event_id FROM events WHERE user_id % 3 <> 0"),
    "is_null": ("syslogline", "select line_id from syslogline where pid is null", "SELECT line_id FROM syslogline WHERE pid IS NULL"),
    "is_not_null": ("syslogline", "select line_id, pid from syslogline where pid is not null", "SELECT line_id, pid FROM syslogline WHERE pid IS NOT NULL"),
    "date_fn": ("events", "select event_id from events where ts > DATE('%Y-%m-%d', '2024-01-15')", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15'"),
    "date_time_fn": ("events", "select event_id from events where ts >= DATE('%d/%b/%Y:%H:%M:%S %z', '20/Jan/2024:12:30:00 +0200')", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 10:30:00'"),
    "alias_in_where": ("events", "select event_id, value*2 as v2 from events where v2 > 100", "SELECT event_id, round(value*2, 4) AS v2 FROM events WHERE value*2 > 100"),
    "self_alias": ("events", "select event_id, user_id+1 as user_id from events where user_id = 8", "SELECT event_id, user_id+1 AS user_id FROM events WHERE user_id+1 = 8"),
    "count_star": ("events", "select event_type, count(*) as n from events group by 1", "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "count_column": ("syslogline", "select program, count(pid) as n from syslogline group by 1", "SELECT program, count(pid) AS n FROM syslogline GROUP BY 1"),
    "count_distinct": ("events", "select event_type, count(distinct user_id) as users from events group by 1", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "sum": ("events", "select event_type, sum(value) as total, sum(user_id) as ids from events group by 1", "SELECT event_type, round(sum(value), 4) AS total, sum(user_id)::BIGINT AS ids FROM events GROUP BY 1"),
    "avg": ("events", "select event_type, avg(value) as mean from events group by 1", "SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY 1"),
    "min": ("events", "select event_type, min(value) as least, min(props) as first from events group by 1", "SELECT event_type, round(min(value), 4) AS least, min(props) AS first FROM events GROUP BY 1"),
    "max": ("events", "select event_type, max(value) as most, max(event_id) as last from events group by 1", "SELECT event_type, round(max(value), 4) AS most, max(event_id) AS last FROM events GROUP BY 1"),
    "group_multi": ("lineitem", "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1, 2", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1, 2"),
    "group_expression": ("lineitem", "select l_orderkey % 10 as slot, max(l_linenumber) as most from lineitem group by 1", "SELECT l_orderkey % 10 AS slot, max(l_linenumber) AS most FROM lineitem GROUP BY 1"),
    "group_null_key": ("syslogline", "select logsource, count(*) as n from syslogline group by 1", "SELECT logsource, count(*) AS n FROM syslogline GROUP BY 1"),
    "global_agg": (
        "lineitem", "select count(*) as n, sum(l_quantity) as quantity, min(l_discount) as least, max(l_tax) as most from lineitem",
        "SELECT count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(min(l_discount), 4) AS least, round(max(l_tax), 4) AS most FROM lineitem",
    ),
    "global_agg_empty": ("events", "select count(*) as n, sum(user_id) as total from events where user_id < 0", "SELECT count(*) AS n, sum(user_id)::BIGINT AS total FROM events WHERE user_id < 0"),
    "agg_filter": (
        "lineitem", "select l_returnflag, sum(l_extendedprice * (1 - l_discount)) as revenue, avg(l_discount) as discount from lineitem where l_shipdate <= DATE('%Y-%m-%d', '1998-09-02') group by 1",
        "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 4) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1",
    ),
    "agg_expression": ("events", "select event_type, sum(value) / count(*) + 1 as x from events group by 1", "SELECT event_type, round(sum(value) / count(*) + 1, 4) AS x FROM events GROUP BY 1"),
    "order_limit_offset": ("events", "select event_id, event_type from events order by 1 desc limit 2*5 offset 10/2", "SELECT event_id, event_type FROM events ORDER BY 1 DESC LIMIT 10 OFFSET 5"),
    "order_nulls": ("syslogline", "select pid, line_id from syslogline order by 1, 2 desc limit 40", "SELECT pid, line_id FROM syslogline ORDER BY 1 NULLS FIRST, 2 DESC LIMIT 40"),
    "top_k": ("orders", "select o_totalprice, o_orderkey from orders order by 1 desc, 2 limit 20", "SELECT round(o_totalprice, 4) AS o_totalprice, o_orderkey FROM orders ORDER BY orders.o_totalprice DESC, 2 LIMIT 20"),
    "agg_order_limit": ("events", "select user_id, count(*) as n from events group by 1 order by 2 desc, 1 limit 10 offset 3", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 3"),
    "more_having": ("events", "select user_id, count(*) as n from events group by 1 having count(*) > 5", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 5"),
    "more_distinct": ("lineitem", "select distinct l_returnflag, l_linestatus from lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "more_in_between": (
        "events", "select event_id from events where event_type in ('view', 'click') and user_id between 10 and 20 and value not between 1 and 2",
        "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id BETWEEN 10 AND 20 AND value NOT BETWEEN 1 AND 2",
    ),
    "more_like": ("part", "select p_partkey from part where p_name like '%a%' and p_type not ilike 'S%'", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT ILIKE 'S%'"),
    "more_case_cast": (
        "events", "select event_id, case when value > 50 then 'high' when value > 10 then 'mid' else 'low' end as band, cast(user_id as varchar) as u, try_cast(event_type as bigint) as nothing from events",
        "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band, user_id::VARCHAR AS u, TRY_CAST(event_type AS BIGINT) AS nothing FROM events",
    ),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{f.name}`", 4).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, query, _ = SELECTS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(run_query(table(spark, d, source), query, table=source))

    return run


# Log semantics


def log_aggregates(spark: SparkSession, d: str) -> DataFrame:
    query = "select program, sum(pid) as total, avg(pid) as mean, min(pid) as least, max(pid) as most, count(pid) as n, count(distinct pid) as kinds from syslogline group by 1"
    return _rounded(run_query(table(spark, d, "syslogline"), query, "log"))


def log_null_compare(spark: SparkSession, d: str) -> DataFrame:
    return run_query(table(spark, d, "syslogline"), "select line_id, program || '/' || pid as tag from syslogline where pid < 1000 or not (program = 'relayd')", "log")


# Batch scope


def _event_batches(spark: SparkSession, d: str) -> DataFrame:
    numbered = batching.global_sequence(table(spark, d, "events"), "event_id")
    return numbered.withColumn("_batch", F.floor(F.col("_seq") / 1000).cast("long"))


def _batch_query(spark: SparkSession, d: str, query: str) -> DataFrame:
    return _rounded(run_query(_event_batches(spark, d), query, scope="batch").withColumnRenamed("_batch", "batch"))


def batch_count(spark: SparkSession, d: str) -> DataFrame:
    return _batch_query(spark, d, "select event_type, count(*) as n, sum(value) as total from events group by 1")


def batch_limit(spark: SparkSession, d: str) -> DataFrame:
    return _batch_query(spark, d, "select event_id, event_type from events where user_id > 20 limit 5 offset 2")


def batch_topn(spark: SparkSession, d: str) -> DataFrame:
    return _batch_query(spark, d, "select value, event_id from events order by 1 desc, 2 limit 3 offset 1")


def batch_group_topn(spark: SparkSession, d: str) -> DataFrame:
    return _batch_query(spark, d, "select user_id, count(*) as n from events group by 1 order by 2 desc, 1 limit 4 offset 1")


def sequence(spark: SparkSession, d: str) -> DataFrame:
    return batching.global_sequence(table(spark, d, "orders"), "o_orderkey", "seq").select("o_orderkey", "seq")


# Text to rows


def _event_lines(spark: SparkSession, d: str, broken: bool = False) -> DataFrame:
    """Events as log lines; every line of an id divisible by 7 is damaged if ``broken``."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.concat(F.lit("<13>"), time, F.lit(" "), F.col("event_type"), F.lit("["), F.col("user_id"), F.lit("]: value="), F.format_string("%.6f", "value"), F.lit(" "), F.col("props"))
    if broken:
        line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("?? "), F.col("event_type"))).otherwise(line)
    return table(spark, d, "events").select(F.col("event_id").alias("_seq"), framing.strip_priority(line).alias("_raw"))


EVENT_PATTERNS = {"EVENT": r"^%{TIMESTAMP_ISO8601:at} %{WORD:kind}\[%{NONNEGINT:user}\]: value=%{NUMBER:value} %{GREEDYDATA:props}$"}
EVENT_COLUMNS = ("+at:ts:%Y-%m-%dT%H:%M:%S.%3fZ", "+kind:str:20", "+user:int", "+value:float", "props:str:1000")


def _parsed_events(spark: SparkSession, d: str, broken: bool = False) -> DataFrame:
    pattern = grok.expand("%{EVENT}", grok.library(EVENT_PATTERNS))
    return parsing.parse_messages(_event_lines(spark, d, broken), pattern, tuple(map(parse_column, EVENT_COLUMNS)))


def grok_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    good = parsing.parsed(_parsed_events(spark, d))
    return _rounded(run_query(good, "select kind, count(*) as n, sum(user) as users, sum(value) as total, count(distinct props) as kinds from EVENT group by 1"))


def grok_times(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed(_parsed_events(spark, d)).select(F.col("_seq").alias("event_id"), F.unix_seconds("at").alias("second"))


def grok_reject(spark: SparkSession, d: str) -> DataFrame:
    bad = _parsed_events(spark, d, True).where("_error is not null")
    return bad.select(F.col("_seq").alias("event_id"), F.col("_error").alias("reason"), F.col("_raw").alias("raw_msg"))


def line_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(framing.split_text(F.col("text"))).cast("long").alias("n_lines"))


def merge_multiline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(framing.split_text(F.col("text"), True)).cast("long").alias("n_messages"))


def priority_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rawmessage").where("raw is not null").select("raw_id", framing.strip_priority(F.col("raw")).alias("line"))


def type_conversions(spark: SparkSession, d: str) -> DataFrame:
    """The last words of messages as every scalar type; most don't convert."""
    word = F.element_at(F.split("message", " "), -1)
    found = table(spark, d, "syslogline").where("message is not null").select("line_id", word.alias("x"))
    kinds = {"as_text": "str:8", "as_int": "int", "as_float": "float", "as_bool": "bool"}
    return _rounded(found.select("line_id", *[parse_spec(k).convert(F.col("x")).alias(n) for n, k in kinds.items()]))


def _parsed(spark: SparkSession, d: str, patterns: dict[str, str], expression: str, columns: tuple[str, ...], **options) -> DataFrame:
    g = grok.expand(expression, grok.library(patterns, options.pop("ignore_defaults", False)), **options)
    return parsing.parse_messages(_event_lines(spark, d), g, tuple(map(parse_column, columns)))


def grok_required(spark: SparkSession, d: str) -> DataFrame:
    """The user is required and only converts up to two digits, as a text of two bytes."""
    rows = _parsed(spark, d, EVENT_PATTERNS, "%{EVENT}", ("+user:str:2", "kind"))
    return rows.select(F.col("_seq").alias("event_id"), "user", "kind", F.col("_error").alias("reason"))


def grok_alias_only(spark: SparkSession, d: str) -> DataFrame:
    """Only aliases capture, so the column of a pattern's own name stays empty; a second lookup takes its place."""
    rows = _parsed(spark, d, {"PAIR": r"%{WORD}\[%{NONNEGINT:user}\]"}, "%{PAIR:pair}", ("WORD", "+who,user:int"), alias_only=True)
    return rows.select(F.col("_seq").alias("event_id"), "WORD", "who")


def grok_own_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of a file, without the default library."""
    own = grok.read_patterns("# letters and digits\nNAME [a-z]+\n\nUSER [0-9]+\nEVENT %{NAME:kind}\\[%{USER:user}\\]")
    rows = _parsed(spark, d, own, "%{EVENT}", ("+kind", "+user:int"), ignore_defaults=True)
    return parsing.parsed(rows).select(F.col("_seq").alias("event_id"), "kind", "user")


# Files


def _written_lines(spark: SparkSession, d: str) -> str:
    """A folder of text files with two lines of each event: a header with a priority, and an indented one."""
    path = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4()}"
    both = F.array(F.concat(F.lit("<13>"), "event_type", F.lit(" "), F.col("event_id").cast("string")), F.concat(F.lit("\t"), "props"), F.lit(""))
    table(spark, d, "events").select(F.explode(both).alias("value")).write.text(path)
    return path


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    return framing.read_messages(spark, _written_lines(spark, d), sequence=False).select(F.col("_raw").alias("line"))


def file_merged(spark: SparkSession, d: str) -> DataFrame:
    return framing.read_messages(spark, _written_lines(spark, d), True, sequence=False).select(F.col("_raw").alias("message"))


def file_batches(spark: SparkSession, d: str) -> DataFrame:
    """How many batches of seven messages hold how many: whole ones but for the last one of each file."""
    messages = batching.with_batches(framing.read_messages(spark, _written_lines(spark, d), True), 7)
    sizes = messages.groupBy("_batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("messages"), F.max("n").alias("largest"))


def stream_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages from the bytes of a connection as they arrive, with and without merging."""
    parts = [b"<13>fir", b"st\r\n\tmore\n\n", b"<>second \xff\xe9\n", b" even more\n<7>last"]
    rows = []
    for merge in (False, True):
        buffer = LineBuffer(merge)
        found = [m for p in parts for m in buffer.feed(p)] + buffer.flush()
        rows += [(merge, i, m) for i, m in enumerate(found)]
    return spark.createDataFrame(rows, "merge boolean, place long, message string")


def stream_flushes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of batches by counts that arrive and ticks."""
    cases = {"end": ([99], 10), "no size": ([99], 0), "tick": ([3, None, 4], 10), "tick after a full batch": ([12, None, None, 1], 10)}
    return spark.createDataFrame([(k, i, n) for k, (counts, size) in cases.items() for i, n in enumerate(batching.flush_sizes(counts, size))], "name string, place long, n long")


def input_addresses(spark: SparkSession, d: str) -> DataFrame:
    def read(text: str) -> tuple:
        try:
            found = parse_input(text)
        except ConfigError:
            return text, "refused", None, None
        return (text, "path", None, None) if isinstance(found, str) else (text, found.proto, found.host, found.port)

    texts = ("-", "app.log", "syslog-tcp:127.0.0.1:514", "syslog-udp:[::1]:514", "syslog-udp:::1:514", "syslog-tls:h:1", "syslog-tcp:h", "syslog-tcp:h:99999")
    return spark.createDataFrame([read(x) for x in texts], "text string, kind string, host string, port long")


REFUSED = {
    "qualified star": "select e.* from events e", "duplicate names": "select event_id as a, user_id as a from events", "column outside groups": "select event_type, value, count(*) from events group by 1",
    "star beside aggregate": "select *, count(*) from events", "sum of nothing": "select sum() from events", "sum of two": "select sum(value, user_id) from events", "unknown function": "select sqrt(value) from events",
    "unknown column": "select nothing from events", "unknown in where": "select event_id from events where nothing > 1", "join": "select event_id from events, orders", "union": "select 1 from events union select 2 from events",
    "two statements": "select event_id from events; select 1 from events", "insert": "insert into events values (1)", "ordinal": "select event_id from events order by 4", "limit of a column": "select event_id from events limit user_id",
    "none": "select event_id from events",
}


def refusals(spark: SparkSession, d: str) -> DataFrame:
    """Which queries the front end refuses before any data is read."""
    events = table(spark, d, "events")

    def refused(query: str) -> bool:
        try:
            run_query(events, query, table="events")
        except (ValueError, NotImplementedError):
            return True
        return False

    return spark.createDataFrame([(name, refused(query)) for name, query in REFUSED.items()], "name string, refused boolean")


# Sinks


def csv_text(spark: SparkSession, d: str) -> DataFrame:
    return formats.csv_lines(table(spark, d, "syslogline").select("line_id", "program", "pid", "message"))


def sql_insert_text(spark: SparkSession, d: str) -> DataFrame:
    return formats.insert_statements(table(spark, d, "nation"), "nation", 1)


def sql_insert_many(spark: SparkSession, d: str) -> DataFrame:
    return formats.insert_statements(table(spark, d, "nation").orderBy("n_nationkey").coalesce(1), "nation", 10)


def sql_create_text(spark: SparkSession, d: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "events")
    return spark.createDataFrame([(n, formats.create_table(table(spark, d, n).schema, n)) for n in names], "name string, ddl string")


def list_patterns(spark: SparkSession, d: str) -> DataFrame:
    return default_patterns(spark)


_LINES = r"list_filter(string_split_regex(regexp_replace(text, '(^|\n|\r)<[0-9]*>', '\1', 'g'), '[\r\n]+'), lambda x: x <> '')"
_NUMBERED = "(SELECT *, ((row_number() OVER (ORDER BY event_id) - 1) // 1000)::BIGINT AS batch FROM events)"
_QUOTED = r"""coalesce(CASE WHEN regexp_matches({0}, '[",\r\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END, 'NULL')"""

ORACLES = {
    "grok_required": "SELECT event_id, CASE WHEN len(user_id::VARCHAR) <= 2 THEN user_id::VARCHAR END AS user, event_type AS kind, CASE WHEN len(user_id::VARCHAR) > 2 THEN 'no value for required column user' END AS reason FROM events",
    "grok_alias_only": "SELECT event_id, NULL::VARCHAR AS \"WORD\", user_id AS who FROM events",
    "grok_own_patterns": "SELECT event_id, event_type AS kind, user_id AS user FROM events",
    "file_lines": "SELECT event_type || ' ' || event_id AS line FROM events UNION ALL SELECT chr(9) || props FROM events",
    "file_merged": "SELECT event_type || ' ' || event_id || ' ' || chr(9) || props AS message FROM events",
    "file_batches": "SELECT count(*) AS messages, 7::BIGINT AS largest FROM events",
    "stream_lines": """SELECT * FROM (VALUES (false, 0::BIGINT, 'first'), (false, 1, chr(9) || 'more'), (false, 2, 'second ' || chr(65533) || chr(65533)), (false, 3, ' even more'), (false, 4, 'last'),
        (true, 0, 'first ' || chr(9) || 'more'), (true, 1, 'second ' || chr(65533) || chr(65533) || '  even more'), (true, 2, 'last')) t(merge, place, message)""",
    "stream_flushes": """SELECT 'end' AS name, i AS place, CASE WHEN i < 9 THEN 10 ELSE 9 END::BIGINT AS n FROM range(10) t(i)
        UNION ALL SELECT * FROM (VALUES ('no size', 0, 99), ('tick', 0, 3), ('tick', 1, 4), ('tick after a full batch', 0, 10), ('tick after a full batch', 1, 2), ('tick after a full batch', 2, 1))""",
    "input_addresses": """SELECT text, kind, host, port::BIGINT AS port FROM (VALUES ('-', 'path', NULL, NULL), ('app.log', 'path', NULL, NULL), ('syslog-tcp:127.0.0.1:514', 'tcp', '127.0.0.1', 514),
        ('syslog-udp:[::1]:514', 'udp', '::1', 514), ('syslog-udp:::1:514', 'udp', '::1', 514), ('syslog-tls:h:1', 'refused', NULL, NULL), ('syslog-tcp:h', 'refused', NULL, NULL), ('syslog-tcp:h:99999', 'refused', NULL, NULL)) t(text, kind, host, port)""",
    "refusals": "SELECT name, name <> 'none' AS refused FROM (VALUES " + ", ".join(f"('{n}')" for n in REFUSED) + ") t(name)",
    "sql_insert_many": """
        SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey)' || chr(10) || ' VALUES ' || chr(10) || string_agg('(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')', ',' || chr(10) ORDER BY n_nationkey) || ';' AS value
        FROM (SELECT *, (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS part FROM nation) GROUP BY part""",
    "sql_create_text": """
        SELECT table_name AS name, 'CREATE TABLE ' || table_name || ' (' || chr(10) || string_agg('    ' || column_name || ' ' || CASE
            WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'BIGINT' WHEN data_type = 'DOUBLE' THEN 'DOUBLE' WHEN data_type = 'VARCHAR' THEN 'TEXT' WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' WHEN data_type = 'DATE' THEN 'DATE' WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN' END,
            ',' || chr(10) ORDER BY column_index) || chr(10) || ');' AS ddl
        FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'events') GROUP BY table_name""",
    "log_aggregates": """
        SELECT program, coalesce(sum(pid), 0)::BIGINT AS total, round(coalesce(sum(pid::DOUBLE), 0) / count(*), 4) AS mean, CASE WHEN count(*) = count(pid) THEN min(pid) END AS least,
               max(pid) AS most, count(*) AS n, count(DISTINCT pid) + (count(*) > count(pid))::BIGINT AS kinds FROM syslogline GROUP BY 1""",
    "log_null_compare": """
        SELECT line_id, coalesce(program, 'NULL') || '/' || coalesce(pid::VARCHAR, 'NULL') AS tag FROM syslogline
        WHERE pid IS NULL OR pid < 1000 OR program IS NULL OR program <> 'relayd'""",
    "batch_count": f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, batch FROM {_NUMBERED} GROUP BY event_type, batch",
    "batch_limit": f"SELECT event_id, event_type, batch FROM {_NUMBERED} WHERE user_id > 20 QUALIFY row_number() OVER (PARTITION BY batch ORDER BY event_id) BETWEEN 3 AND 7",
    "batch_topn": f"SELECT round(e.value, 4) AS value, event_id, batch FROM {_NUMBERED} e QUALIFY row_number() OVER (PARTITION BY batch ORDER BY e.value DESC, event_id) BETWEEN 2 AND 4",
    "batch_group_topn": f"SELECT user_id, n, batch FROM (SELECT user_id, batch, count(*) AS n FROM {_NUMBERED} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY n DESC, user_id) BETWEEN 2 AND 5",
    "sequence": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders",
    "grok_roundtrip": "SELECT event_type AS kind, count(*) AS n, sum(user_id)::BIGINT AS users, round(sum(round(value, 6)), 4) AS total, count(DISTINCT props) AS kinds FROM events GROUP BY 1",
    "grok_times": "SELECT event_id, floor(epoch(ts))::BIGINT AS second FROM events",
    "grok_reject": "SELECT event_id, 'pattern did not match' AS reason, '?? ' || event_type AS raw_msg FROM events WHERE event_id % 7 = 0",
    "line_split": f"SELECT doc_id, len({_LINES})::BIGINT AS n_lines FROM documents WHERE text IS NOT NULL",
    "merge_multiline": rf"""
        SELECT doc_id, (len(list_filter(l, lambda x: NOT regexp_matches(x, '^[ \t]'))) + (len(l) > 0 AND regexp_matches(l[1], '^[ \t]'))::INT)::BIGINT AS n_messages
        FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE text IS NOT NULL)""",
    "priority_strip": "SELECT raw_id, regexp_replace(raw, '^<[0-9]*>', '') AS line FROM rawmessage WHERE raw IS NOT NULL",
    "type_conversions": r"""
        SELECT line_id, CASE WHEN strlen(x) <= 8 THEN x END AS as_text, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN try_cast(x AS BIGINT) END AS as_int,
               round(CASE WHEN regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(x AS DOUBLE) END, 4) AS as_float,
               CASE lower(x) WHEN 'true' THEN true WHEN 'false' THEN false END AS as_bool
        FROM (SELECT line_id, string_split(message, ' ')[-1] AS x FROM syslogline WHERE message IS NOT NULL)""",
    "csv_text": f"SELECT line_id::VARCHAR || ',' || {_QUOTED.format('program')} || ',' || coalesce(pid::VARCHAR, 'NULL') || ',' || {_QUOTED.format('message')} AS value FROM syslogline",
    "sql_insert_text": """
        SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey)' || chr(10) || ' VALUES ' || chr(10) || '(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' AS value FROM nation""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        log_aggregates, log_null_compare, batch_count, batch_limit, batch_topn, batch_group_topn, sequence, grok_roundtrip, grok_times, grok_reject, line_split, merge_multiline, priority_strip, type_conversions,
        csv_text, sql_insert_text, sql_insert_many, sql_create_text, list_patterns, grok_required, grok_alias_only, grok_own_patterns, file_lines, file_merged, file_batches, stream_lines, stream_flushes, input_addresses, refusals,
    )
    return {name: _select(name) for name in SELECTS} | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in SELECTS.items()} | ORACLES
