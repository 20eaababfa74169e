"""Count-based batches: every N raw messages of a file make one, before parsing, so that rejected lines count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def with_batches(messages: DataFrame, size: int) -> DataFrame:
    """Adds ``_batch``, distinct for every batch of every file.  ``size`` 0: one batch for each file."""
    number = F.floor(F.col("_seq") / F.lit(size)).cast("long") if size else F.lit(0).cast("long")
    file = F.col("_file") if "_file" in messages.columns else F.lit("-")
    return messages.withColumn("_batch", F.struct(file.alias("file"), number.alias("number")))


def flush_sizes(counts: list[int | None], size: int) -> list[int]:
    """Batch sizes that a stream of message counts gives, where None is a tick: a tick flushes what is held unless a full
    batch has gone out since the tick before; the end flushes the rest."""
    out, held, sent = [], 0, False
    for c in counts:
        if c is None:
            if held and not sent:
                out.append(held)
                held = 0
            sent = False
            continue
        held += c
        while size and held >= size:
            out.append(size)
            held -= size
            sent = True
    return out + [held] * bool(held)


def global_sequence(df: DataFrame, order: str, out: str = "_seq") -> DataFrame:
    """Numbers rows from 0 in the order of a column, over a range partitioning: each range counts its rows, and the
    counts (one row a range) give every range its start.  No task holds more than its range."""
    ranged = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    placed = ranged.withColumn("__part", part).withColumn("__place", place).drop("__id")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
