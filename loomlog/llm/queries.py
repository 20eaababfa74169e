"""Queries and SQL of the operators for text corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import cutoff, encode, heavy, mix, mojibake, runs, spans


def _syslog_runs(spark: SparkSession, d: str, min_count: int) -> DataFrame:
    lines = table(spark, d, "syslogline")
    return runs.collapse_runs(lines, ("logsource", "program"), "timestamp", "message", "line_id", "seq", ("logsource", "seq"), min_count)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _syslog_runs(spark, d, 3).select(F.col("first_id").alias("first_line_id"), F.col("last_id").alias("last_line_id"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    found = _syslog_runs(spark, d, 1)
    return found.select("logsource", "program", "first_id", "last_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n_events", "duration_s")


def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    """Runs under tolerances: four of five words as in the run's anchor, and no pause of more than ten minutes."""
    lines = table(spark, d, "syslogline")
    return runs.collapse_runs(lines, ("logsource", "program"), "timestamp", "message", "line_id", "seq", ("logsource", "seq"), max_gap=600.0, similarity=0.8)


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    return heavy.frequent_items(table(spark, d, "syslogline"), ["message", "program"], 0.005)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts and shares of the frequent items."""
    return p3_items(spark, d).drop("approx_count")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_items(spark, d).select("field", "item")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.judge_texts(table(spark, d, "syslogline"), cutoff.byte_limits(table(spark, d, "logsource"), table(spark, d, "parsercoldef")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("is_cut").select("line_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rates(_judged(spark, d))


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "syslogline").select(F.lit("syslogline").alias("tbl"), F.col("line_id").alias("row_id"), F.col("message").alias("text"))
    raw = table(spark, d, "rawmessage").select(F.lit("rawmessage").alias("tbl"), F.col("raw_id").alias("row_id"), F.col("raw").alias("text"))
    return mojibake.find_garbled(lines.union(raw))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_restored(spark, d).select("tbl", "row_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mixtarget"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mixtarget"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).pairs()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).shares()


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).passages


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """The form for scale, beside ``p10_passages``: the class (its lowest id) of each document whose text others repeat."""
    return spans.SharedSpans(table(spark, d, "documents")).classes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_runs, p1_similar, p3_found, p3_items, p3_counts, p4_found, p4_rates, p7_found, p7_restored, p8_ids, p9_mix, p9_shares, p10_found, p10_shares, p10_passages, p10_classes)}


P3 = """
WITH v AS (SELECT 'message' AS field, message AS item FROM syslogline UNION ALL SELECT 'program', program FROM syslogline)
SELECT field, item FROM v WHERE item IS NOT NULL GROUP BY field, item
HAVING count(*) >= 0.005 * (SELECT count(*) FROM syslogline)"""
P3_COUNTS = P3.replace("SELECT field, item FROM v", "SELECT field, item, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM syslogline) AS share FROM v")


_CANON = "replace(replace(replace(lower(upper(message)), 'ß', 'ss'), 'µ', 'μ'), 'ς', 'σ')"
for _pattern, _text in (
    (r"[\s\x{a0}]+", " "),
    (r"^ | $", ""),
    (r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "#"),
    (r"\b0x[0-9a-f]+\b", "#"),
    (r"\b\d+m\d+s\b", "#"),
    (r"\b\d+(?:[.,:]\d+)+", "#"),
    (r"\b(?:[a-f]*\d[0-9a-f]*){1}\b", "#"),
    (r"\b[a-f]{8,}\b", "#"),
    (r"\d+", "#"),
    (r"(^|[^\p{L}#])[+-]#", r"\1#"),
    (r"# ?(?:ms|s|μs|kib|mib|gib|kb|mb|gb)\b", "#"),
):
    _CANON = f"regexp_replace({_CANON}, '{_pattern}', '{_text}', 'g')"

P1 = f"""
WITH kept AS (SELECT * FROM syslogline WHERE timestamp IS NOT NULL AND logsource IS NOT NULL AND program IS NOT NULL AND message IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY logsource, seq ORDER BY line_id) = 1),
alike AS (SELECT line_id, logsource, program, timestamp AS t, seq, {_CANON} AS m FROM kept),
marked AS (SELECT *, (m IS DISTINCT FROM lag(m) OVER w)::INT AS fresh FROM alike WINDOW w AS (PARTITION BY logsource, program ORDER BY t, seq, line_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY logsource, program ORDER BY t, seq, line_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT first(line_id ORDER BY t, seq, line_id) AS first_line_id, last(line_id ORDER BY t, seq, line_id) AS last_line_id
FROM numbered GROUP BY logsource, program, run HAVING count(*) >= 3"""
P1_RUNS = P1.split("SELECT first(line_id")[0] + """
SELECT logsource, program, first(line_id ORDER BY t, seq, line_id) AS first_id, last(line_id ORDER BY t, seq, line_id) AS last_id, epoch_us(min(t)) AS first_us, epoch_us(max(t)) AS last_us,
       count(*) AS n_events, (epoch_us(max(t)) - epoch_us(min(t))) / 1e6::DOUBLE AS duration_s
FROM numbered GROUP BY logsource, program, run"""

P10 = """
WITH spans AS (SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM spans a JOIN spans b ON a.h = b.h AND a.doc_id < b.doc_id"""


P10_SHARES = """
WITH spans AS (SELECT doc_id, n, i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, length(text) AS n, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
shared AS (SELECT h FROM spans GROUP BY h HAVING min(doc_id) < max(doc_id)),
placed AS (SELECT doc_id, n, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM spans WHERE h IN (FROM shared))
SELECT doc_id, n::BIGINT AS n_chars, sum(least(200, coalesce(later - i, 200)))::BIGINT AS shared_chars, sum(least(200, coalesce(later - i, 200)))::DOUBLE / n AS share FROM placed GROUP BY doc_id, n"""

P10_CLASSES = """
WITH known AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200)
SELECT doc_id, rep FROM known WHERE n > 1"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_runs": P1_RUNS, "p3_found": P3, "p3_counts": P3_COUNTS, "p10_found": P10, "p10_shares": P10_SHARES, "p10_classes": P10_CLASSES}
