"""The pipeline: input, messages, batches, parse, query, sink; over files at once or over a syslog stream."""

from __future__ import annotations

import logging
import os
import sys
import tempfile
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .config import EngineConfig, ServerAddress, parse_input
from .functions import grok
from .operators import batching, framing, parsing
from .plans.compiler import Compiled, compile_query
from .session import ship_package
from .sinks import formats

log = logging.getLogger(__name__)


@dataclass
class Engine:
    """A checked configuration: everything that can fail before data is read has been tried."""

    config: EngineConfig
    pattern: grok.Grok
    query: Compiled | None

    def parse(self, messages: DataFrame) -> DataFrame:
        """Messages with batches, typed columns and ``_error``."""
        # without numbers of messages there are no batches, and nothing that would ask for them
        batched = batching.with_batches(messages, self.config.output_batch_size) if "_seq" in messages.columns else messages
        return parsing.parse_messages(batched, self.pattern, self.config.schema, self.config.default_year)

    def run(self, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(result of the query, rejected messages)."""
        rows = self.parse(messages)
        good = parsing.parsed(rows)
        if self.query is None:
            # splits are in order by themselves; only a single printed stream needs sorting
            place = ["_file", "_seq"] if "_seq" in good.columns else ["_file", "_block", "_pos"]
            return good.orderBy(*place) if self.config.output == "-" else good, parsing.rejected(rows)
        return self.query(good, self.config.scope), parsing.rejected(rows)

    def write(self, df: DataFrame, ddl: bool) -> None:
        c = self.config
        if c.output_format == "csv":
            formats.write_csv(df, c.output, add_header=ddl, append_to_file=c.single_file)
        elif c.output_format == "sql":
            formats.write_sql(df, c.output, c.table_name, c.output_batch_size, ddl, c.ddl_pre_name_opts, c.ddl_table_opts, append_to_file=c.single_file)
        else:
            formats.write_jdbc(df, c.output, c.table_name, c.output_batch_size)

    def write_rejects(self, rejected: DataFrame) -> None:
        """Rejected messages with their reasons, to standard error or a folder of CSV files."""
        if self.config.rejects == "none":
            return
        if self.config.rejects != "-":
            formats.write_csv(rejected, self.config.rejects)
            return
        for r in rejected.toLocalIterator():
            print(f"rejected: {r['desc']}: {r['raw_msg']}", file=sys.stderr)


def prepare(config: EngineConfig) -> Engine:
    """Checks patterns, columns and the query of a configuration."""
    extra = dict(config.grok_patterns)
    if config.grok_patterns_file:
        with open(config.grok_patterns_file, encoding="utf-8") as f:
            extra = grok.read_patterns(f.read()) | extra
    library = grok.library(extra, config.grok_ignore_default_patterns)
    if config.grok_pattern not in library:
        raise grok.GrokError(f"unknown pattern {config.grok_pattern}")
    pattern = grok.expand("%{" + config.grok_pattern + "}", library, config.grok_with_alias_only)
    query = compile_query(config.query, None, config.semantics, config.default_year) if config.query else None
    return Engine(config, pattern, query)


def run_batch(spark: SparkSession, config: EngineConfig) -> None:
    """One-shot run over a file, a folder or standard input."""
    ship_package(spark)
    engine = prepare(config)
    if config.input == "-":
        messages = framing.messages_from_lines(spark, sys.stdin, config.merge_multi_line)
    else:
        messages = framing.read_messages(spark, config.input, config.merge_multi_line, sequence=engine.query is not None)
    result, rejected = engine.run(messages)
    engine.write(result, config.output_add_ddl)
    engine.write_rejects(rejected)


def run_stream(spark: SparkSession, config: EngineConfig, sink=None, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a syslog server; every micro-batch runs the query on each of its batches and goes to the sink.

    ``sink``: called with each result in place of the configured one.
    """
    from .streaming import syslog

    address = parse_input(config.input)
    if not isinstance(address, ServerAddress):
        raise ValueError("the input is not a syslog server")
    ship_package(spark)
    engine = prepare(config)
    syslog.register(spark)
    options = {"proto": address.proto, "host": address.host, "port": address.port, "merge": str(config.merge_multi_line).lower(), "batchSize": config.output_batch_size, "idleTimeout": config.idle_timeout, "channelSize": max(config.channel_size, config.output_batch_size)}
    # the listener runs in a process of its own on the driver's machine; this file's existence tells it to close
    closing = os.path.join(tempfile.mkdtemp(prefix="loomlog-stream-"), "close")
    options["closeFile"] = closing
    stream = spark.readStream.format(syslog.NAME).options(**{k: str(v) for k, v in options.items()}).load()
    wrote = False

    def process(df: DataFrame, batch_id: int) -> None:
        nonlocal wrote
        df = df.persist()
        try:
            if df.isEmpty():
                return
            # messages of all senders share one queue, and batches are cut from it in order of arrival
            first = df.agg(F.min("_seq")).first()[0]
            messages = df.select(F.lit("-").alias("_file"), (F.col("_seq") - F.lit(first)).alias("_seq"), F.col("_file").alias("_sender"), "_raw")
            result, rejected = engine.run(messages.drop("_sender"))
            if sink is not None:
                sink(result, batch_id)
            else:
                engine.write(result, config.output_add_ddl and not wrote)
                wrote = True
            engine.write_rejects(rejected)
        except Exception:
            if config.on_error == "fail":
                raise
            log.exception("batch %d was skipped", batch_id)
        finally:
            df.unpersist()

    writer = stream.writeStream.foreachBatch(process).trigger(processingTime=f"{config.tick_interval} seconds")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.loomlog_close_file = closing
    return query


def stop_stream(query: StreamingQuery, patience: float = 60.0) -> None:
    """Stops a syslog server without loss: no more is received, unfinished lines and held messages come out, everything that waits
    is processed, and then the query ends.  ``patience``: most seconds to wait for the listener to close."""
    if query.isActive:
        with open(query.loomlog_close_file, "w"):
            pass
        end = time.monotonic() + patience
        while query.isActive and os.path.exists(query.loomlog_close_file) and time.monotonic() < end:
            time.sleep(0.05)
        query.processAllAvailable()
    query.stop()


def default_patterns(spark: SparkSession) -> DataFrame:
    """``name``, ``regex`` of the default pattern library."""
    return spark.createDataFrame(sorted(grok.PATTERNS.items()), "name string, regex string")
