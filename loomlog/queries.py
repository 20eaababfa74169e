"""Queries of the core operators and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine_queries, problem_sql
from .operators import badrows, entries, timestamps
from .session import table


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Event lines parsed by a grok pattern, then aggregated through the SQL front end."""
    return engine_queries.grok_roundtrip(spark, d)


#: Forms of header times.
HEADER_TIMES = {
    0: "%b %e %H:%M:%S", 1: "%Y-%m-%dT%H:%M:%S", 2: "%Y-%m-%dT%H:%M:%S.%f", 3: "%Y-%m-%dT%H:%M:%S.%f%z", 4: "%Y-%m-%dT%H:%M:%S%z",
    5: "%d/%b/%Y:%H:%M:%S %z", 6: "%s.%f", 7: "%s", 8: "%m%d %H:%M:%S.%f",
}


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return entries.read_entries(table(spark, d, "rawmessage"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("file_id", "first_line_no", "last_line_no", "level", "component")


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their times as UTC instants (wall clocks without a zone are taken as UTC)."""
    found = _entries(spark, d).withColumn("zone", F.lit("UTC")).withColumn("form", F.lit(None).cast("int")).withColumn("arrived", F.timestamp_micros("received_us"))
    timed = timestamps.normalise_times(found, HEADER_TIMES, "time", "form", "zone", "arrived", ["UTC"])
    return timed.select("file_id", "first_line_no", "last_line_no", timestamps.utc_text(F.col("ts_us")).alias("ts_utc"), "level", "component", "message", "unparsed", "score")


def _judged_records(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[badrows.Field]]]:
    schemas = badrows.read_schemas(table(spark, d, "parsercoldef"))
    return badrows.judge_records(table(spark, d, "logparseerror"), schemas), schemas


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    judged, _ = _judged_records(spark, d)
    return judged.where("reason is not null and reason <> 'no_schema'").select(F.col("row_id").alias("rec_id"), "reason")


def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejects(_judged_records(spark, d)[0])


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows of all schemas."""
    return badrows.typed_records(*_judged_records(spark, d))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the valid records of all schemas, as texts by column name."""
    judged, schemas = _judged_records(spark, d)
    return badrows.named_values(judged, schemas)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = timestamps.capture_times(table(spark, d, "syslogcapture"), table(spark, d, "logsource"), table(spark, d, "timetypeformat"))
    return found.where("ts_us is not null").select("capture_id", timestamps.utc_text(F.col("ts_us")).alias("ts_utc"))


def p6_zones(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.zone_transitions(table(spark, d, "logsource"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return engine_queries.queries() | {f.__name__: f for f in (p2_found, p2_entries, p5_found, p5_rejects, p5_valid, p5_values, p6_found, p6_zones)}


def oracle_sql() -> dict[str, str]:
    return engine_queries.oracle_sql() | problem_sql.ORACLES
