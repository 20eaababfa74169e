"""Bytes to messages: line split, syslog priorities and multi-line merge.

Files are read in splits; the lines of a split stay in order, so messages are assembled without a shuffle.  A message that
goes on in the next split is stitched from the few lines at split borders.  Every message has its file, the start of its
split and its place in it, which order messages of a file; ``_seq`` numbers them from 0 within a file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, cut

#: Rows about splits are broadcast up to this many, beyond it joined through a shuffle.
MAX_SPLITS = 500_000


def strip_priority(line: Column) -> Column:
    """Drops ``<digits>`` at the start of a line, with zero or more digits."""
    return F.regexp_replace(line, "^<[0-9]*>", "")


def merge_lines(lines: Iterable[str]) -> Iterator[str]:
    """Messages of an iterable of lines: one that begins with a blank or tab goes on the one before, after a space."""
    held: list[str] = []
    for line in lines:
        if not line:
            continue
        if line[0] in " \t" and held:
            held.append(line)
            continue
        if held:
            yield " ".join(held)
        held = [line]
    if held:
        yield " ".join(held)


def split_text(text: Column, merge: bool = False) -> Column:
    """Messages of a whole text as an array: priorities stripped, terminators collapsed, continuations joined."""
    clean = F.regexp_replace(text, r"(^|(?<=[\r\n]))<[0-9]*>", "")
    if not merge:
        return F.filter(F.split(clean, r"[\r\n]+"), lambda x: x != "")
    # possessive, so that a run of blank lines before a continuation isn't split inside
    parts = F.split(F.regexp_replace(clean, r"^[\r\n]+", ""), r"[\r\n]++(?![ \t])")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"[\r\n]+(?=[ \t])", " ")), lambda x: x != "")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged messages of the splits in one task, a batch at a time.  ``_head``: lines at a split's start that may go on a message
    before; ``_last``: the split's last message, which lines of the next split may go on."""
    held: list[str] = []  # lines of the message that may still go on
    at: tuple[str, int] | None = None
    pos, head = 0, False

    def rows(file: list, block: list, places: list, raw: pa.Array, heads: list, lasts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(places, pa.int64()), raw, pa.array(heads, pa.bool_()), pa.array(lasts, pa.bool_())], schema=_MERGED)

    def finish(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, pos
        if held:
            yield rows([at[0]], [at[1]], [-1 if head else pos], pa.array([" ".join(held)]), [head], [last and not head])
            pos += not head
        held = []

    for batch in batches:
        batch = batch.filter(pc.greater(pc.binary_length(batch.column(2)), 0))
        n = batch.num_rows
        if not n:
            continue
        file, block, line = batch.columns
        moved = np.zeros(n, bool)
        if n > 1:
            moved[1:] = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        more = pc.or_(pc.starts_with(line, " "), pc.starts_with(line, "\t")).to_numpy(zero_copy_only=False)
        borders = [0, *np.nonzero(moved)[0].tolist(), n]
        for start, end in zip(borders[:-1], borders[1:]):
            here = file[start].as_py(), block[start].as_py()
            if here != at:
                yield from finish(True)
                at, pos, head = here, 0, False
            begins = (np.nonzero(~more[start:end])[0] + start).tolist()
            first = begins[0] if begins else end
            if first > start:  # lines that go on what is held, or begin the split
                if not held:
                    head = at[1] > 0 and pos == 0
                held += line.slice(start, first - start).to_pylist()
            if begins:
                yield from finish(False)
                head = False
                whole = begins[:-1]
                if whole:  # all but the last one end inside the batch
                    lists = pa.ListArray.from_arrays(pa.array([x - first for x in begins], pa.int32()), line.slice(first, begins[-1] - first))
                    yield rows([at[0]] * len(whole), [at[1]] * len(whole), list(range(pos, pos + len(whole))), pc.binary_join(lists, " "), [False] * len(whole), [False] * len(whole))
                    pos += len(whole)
                held = line.slice(begins[-1], end - begins[-1]).to_pylist()
    yield from finish(True)


_MERGED = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("_pos", pa.int64()), ("_raw", pa.string()), ("_head", pa.bool_()), ("_last", pa.bool_())])


def _stitched(made: DataFrame) -> DataFrame:
    """Adds the heads of splits to the last message before them.  Only these, two a split at most, are kept and joined; the rest is
    read once more and passes through."""
    borders = cut(made.where("_head or _last"))
    heads = borders.where("_head").select("_file", F.col("_block").alias("head"), F.col("_raw").alias("more"))
    last = borders.where("_last").select("_file", "_block", "_pos", "_raw")
    owner = heads.join(last.select("_file", F.col("_block").alias("b")), "_file").where("b < head").groupBy("_file", "head", "more").agg(F.max("b").alias("_block"))
    tails = owner.groupBy("_file", "_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("head", "more"))), lambda x: x["more"]).alias("more"))
    orphans = heads.join(owner.select("_file", "head"), ["_file", "head"], "left_anti").select("_file", F.col("head").alias("_block"), F.lit(-1).cast("long").alias("_pos"), F.col("more").alias("_raw"))
    whole = last.join(tails, ["_file", "_block"], "left").select("_file", "_block", "_pos", F.when(F.col("more").isNull(), F.col("_raw")).otherwise(F.concat_ws(" ", F.col("_raw"), F.array_join("more", " "))).alias("_raw"))
    return made.where("not _head and not _last").select("_file", "_block", "_pos", "_raw").unionByName(whole).unionByName(orphans)


def with_sequence(messages: DataFrame) -> DataFrame:
    """``_seq``: number of a message in its file, from the counts of its splits (one row a split)."""
    counts = cut(messages.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_pos").alias("least")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_file", "_block", (before - F.col("least")).alias("before"))
    return messages.join(broadcast_if_bounded(starts, MAX_SPLITS), ["_file", "_block"]).withColumn("_seq", F.col("before") + F.col("_pos")).drop("before")


def read_messages(spark: SparkSession, path: str | list[str], merge: bool = False, sequence: bool = True) -> DataFrame:
    """``_file``, ``_block``, ``_pos``, ``_raw`` of the messages in text files, and ``_seq`` unless ``sequence`` is off, as numbers
    in a file cost a count of the messages of each split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), strip_priority(F.regexp_replace("value", "\r", "")).alias("_line"))
    if merge:
        placed = _stitched(lines.mapInArrow(_assemble, "_file string, _block long, _pos long, _raw string, _head boolean, _last boolean"))
    else:
        # each line is a message: places follow from the ids that a split's rows get, all in the JVM
        placed = lines.where("_line <> ''").select("_file", "_block", F.monotonically_increasing_id().alias("_pos"), F.col("_line").alias("_raw"))
    return with_sequence(placed) if sequence else placed


def messages_from_lines(spark: SparkSession, lines: Iterable[str], merge: bool = False) -> DataFrame:
    """Messages of lines at hand (standard input, tests), in their order."""
    import re

    stripped = (re.sub("^<[0-9]*>", "", x) for line in lines for x in re.split(r"[\r\n]+", line))
    messages = list(merge_lines(stripped)) if merge else [x for x in stripped if x]
    return spark.createDataFrame([("-", i, m) for i, m in enumerate(messages)], "_file string, _seq long, _raw string")
