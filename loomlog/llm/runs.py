"""Problem 1: collapse runs of consecutive repeated events.

Events of one entity (say, a program of a source) are read in their order by a state machine that compares each event
with the anchor of the open run, under a similarity and a time-gap tolerance, and emits finished runs.  Two
events are alike by their canonical text: letter case, spacing, numbers, hexadecimal ids, UUIDs, IP addresses,
durations and sizes don't count, every other word does.

Scale: rows are range-partitioned by (entity, time, sequence), so an entity with a third of all rows is spread over
many tasks.  Each task streams its range; only the first and the last run of a range may go on in a neighbour, and
these (two rows a task, whatever the data) are stitched afterwards.  With a similarity below 1 what a range makes of its events
depends on the anchor of the run that is open where it begins: the ranges are read again with the anchors that their
neighbours ended with, until no range ends otherwise than before.  A range forgets what it began with at its first
break that both readings share, so that takes two or three readings, and never more than there are ranges.

Defined cases: rows with a null time, entity or text are left out; of rows with equal duplicate key the lowest id
stays (a null in the key equals nothing); ties in time and sequence go by id; an empty text is a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

_UNIT = r"(?:ns|us|µs|μs|ms|s|secs?|seconds?|mins?|minutes?|hours?|h|m|d|days?|b|bytes?|[kmgtp]i?b)"
_NUMBER = r"\d+(?:[.,:]\d+)*"
#: One pattern for all values; alternatives run from the most specific to plain digits.
VALUES = (
    r"(?<![\p{L}\d])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![\p{L}\d])"
    r"|(?<![\p{L}\d])0x[0-9a-f]+(?![\p{L}\d])"
    rf"|(?<![\p{{L}}\d])[+-]?(?:\d+(?:\.\d+)?(?:ns|us|µs|μs|ms|s|m|h|d))+(?![\p{{L}}\d])"
    rf"|(?<![\p{{L}}\d])[+-]?{_NUMBER} ?{_UNIT}(?![\p{{L}}\d])"
    r"|(?<![\p{L}\d])(?:(?=[a-f]*\d)[0-9a-f]{4,}|[0-9a-f]{8,})(?![\p{L}\d]|[.,:]\d)"
    rf"|(?:(?<![\p{{L}}\d])[+-])?{_NUMBER}"
)


def canonical(text) -> F.Column:
    """The text with case folded, spacing collapsed and values replaced by ``#``."""
    folded = F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.trim(F.regexp_replace(folded, r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " ")), VALUES, "#")


def token_similarity(a: str, b: str) -> float:
    """Share of equal tokens at equal places in two canonical texts."""
    x, y = a.split(" "), b.split(" ")
    return sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))


def _run_table(batches: Iterator[pa.RecordBatch], n_keys: int, max_gap: float | None, similarity: float, part: int, carried: list | None = None) -> Iterator[pa.RecordBatch]:
    """The state machine over one sorted range.  Columns: keys, time (micros), id, likeness.  Emits keys, likeness,
    first and last id, first and last time, count, range number, place (bit 0: first of the range, bit 1: last, bit 2: goes on
    the carried run).  ``carried``: keys, anchor and last time of the run that is open where the range begins."""
    names = [*[f"k{i}" for i in range(n_keys)], "like", "first_id", "last_id", "first_us", "last_us", "n", "part", "place"]
    gap = None if max_gap is None else int(max_gap * 1e6)
    open_run: list | None = None if carried is None else [*carried[: n_keys + 1], None, None, None, carried[n_keys + 1], 0]
    first, going_on = True, carried is not None

    def table(runs: list[list]) -> pa.RecordBatch:
        columns = list(zip(*runs))
        kinds = [*[pa.string()] * n_keys, pa.string() if similarity < 1 else pa.int64(), *[pa.int64()] * 5, pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, times, ids, like = batch.columns[:n_keys], batch.column(n_keys), batch.column(n_keys + 1), batch.column(n_keys + 2)
        new = [True] * n
        if n > 1:
            pairs = [(c.slice(1), c.slice(0, n - 1)) for c in ([*keys, like] if similarity >= 1 else keys)]
            differs = pc.not_equal(*pairs[0])
            for x, y in pairs[1:]:
                differs = pc.or_(differs, pc.not_equal(x, y))
            if gap is not None:
                differs = pc.or_(differs, pc.greater(pc.subtract(times.slice(1), times.slice(0, n - 1)), gap))
            new[1:] = differs.to_pylist()
        starts = [i for i, x in enumerate(new) if x] if similarity >= 1 else list(range(n))
        ends = [*starts[1:], n]
        t, d = times.to_numpy(), ids.to_numpy()
        k, v = [c.take(pa.array(starts)).to_pylist() for c in keys], like.take(pa.array(starts)).to_pylist()
        done = []
        for j, (s, e) in enumerate(zip(starts, ends)):
            key = [c[j] for c in k]
            if open_run is not None and open_run[:n_keys] == key and (gap is None or t[s] - open_run[n_keys + 4] <= gap) and (v[j] == open_run[n_keys] if similarity >= 1 else token_similarity(open_run[n_keys], v[j]) >= similarity):
                if not open_run[n_keys + 5]:
                    open_run[n_keys + 1], open_run[n_keys + 3] = int(d[s]), int(t[s])
                open_run[n_keys + 2], open_run[n_keys + 4] = int(d[e - 1]), int(t[e - 1])
                open_run[n_keys + 5] += e - s
                continue
            if open_run is not None:
                if open_run[n_keys + 5]:
                    done.append([*open_run, part, int(first) + 4 * going_on])
                    first = False
                going_on = False
            open_run = [*key, v[j], int(d[s]), int(d[e - 1]), int(t[s]), int(t[e - 1]), e - s]
        if done:
            yield table(done)
    if open_run is not None and open_run[n_keys + 5]:
        yield table([[*open_run, part, int(first) + 2 + 4 * going_on]])


def collapse_runs(
    df: DataFrame, entity: tuple[str, ...], time: str, text: str, row_id: str, order: str | None = None, duplicate_key: tuple[str, ...] | None = None, min_count: int = 1, max_gap: float | None = None, similarity: float = 1.0, partitions: int | None = None
) -> DataFrame:
    """One row for each maximal run of at least ``min_count`` like events: the entity's columns, ``first_id``,
    ``last_id``, ``first_at``, ``last_at``, ``n_events``, ``duration_s``.

    ``order``: breaks ties in ``time``.  ``max_gap``: most seconds between neighbours of a run.  ``similarity``: least
    share of equal tokens with the run's anchor.
    """
    spark, n_keys = df.sparkSession, len(entity)
    order = order or row_id
    like = canonical(F.col(text)) if similarity < 1 else F.xxhash64(canonical(F.col(text)))
    needed = dict.fromkeys([*entity, time, row_id, order, *(duplicate_key or ())])
    whole = df.where(" and ".join(f"`{c}` is not null" for c in (*entity, time, text)))
    rows = whole.select(*needed, like.alias("__like"))
    if duplicate_key:
        known = " and ".join(f"`{c}` is not null" for c in duplicate_key)
        rest = [c for c in [*needed, "__like"] if c not in duplicate_key]
        kept = rows.where(known).groupBy(*duplicate_key).agg(F.min_by(F.struct(*rest), row_id).alias("__r")).select(*duplicate_key, "__r.*")
        rows = kept.unionByName(rows.where(f"not ({known})"))
    rows = rows.select(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(entity)], F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col(row_id).cast("long").alias("id"), "__like", F.col(order).alias("ord"))
    keys = [f"k{i}" for i in range(n_keys)]
    order_by = [*keys, "us", "ord", "id"]
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order_by).sortWithinPartitions(*order_by).select(*keys, "us", "id", "__like")
    kind = T.StringType() if similarity < 1 else T.LongType()
    fields = [*[T.StructField(k, T.StringType()) for k in keys], T.StructField("like", kind), *[T.StructField(c, T.LongType()) for c in ("first_id", "last_id", "first_us", "last_us", "n")], T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType())]

    def read(carried: dict[int, list]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            return _run_table(batches, n_keys, max_gap, similarity, part, carried.get(part))

        return cut(ranged.mapInArrow(run, T.StructType(fields)).where(f"place <> 0 or n >= {int(min_count)}"))

    runs = None
    if similarity < 1:
        ranged = cut(ranged)
        carried: dict[int, list] = {}
        while runs is None or again != carried:
            carried = {} if runs is None else again
            runs = read(carried)
            ends = {r["part"]: [*[r[k] for k in keys], r["like"], r["last_us"]] for r in runs.where("place & 2 <> 0").collect()}
            again = {part + 1: ends[part] for part in ends}
            for part in range(1, max(ends, default=0) + 1):  # a range without events hands on what it was given
                if part not in ends and part in again:
                    again[part + 1] = again[part]
            again = {p: x for p, x in again.items() if p <= max(ends, default=0)}
    else:
        runs = read({})
    runs = runs.where("place = 0").union(_stitch(runs.where("place <> 0"), keys, max_gap, similarity < 1))
    named = [F.col(k).cast(df.schema[c].dataType).alias(c) for k, c in zip(keys, entity)]
    return runs.where(f"n >= {int(min_count)}").select(*named, "first_id", "last_id", F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"), F.col("n").alias("n_events"), ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration_s"))


def _stitch(edges: DataFrame, keys: list[str], max_gap: float | None, told: bool) -> DataFrame:
    """Joins runs that go on over range borders.  At most two rows a range, so one sorted task holds them.  ``told``: whether
    the rows themselves say that they go on the run before."""
    gap = None if max_gap is None else int(max_gap * 1e6)
    columns = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["part"], r["place"] & 2))
        out: list[dict] = []
        for r in rows:
            if told:
                goes_on = bool(r["place"] & 4)
            else:
                goes_on = bool(out) and all(out[-1][c] == r[c] for c in [*keys, "like"]) and (out[-1]["part"] != r["part"]) and out[-1]["place"] & 2 and r["place"] & 1 and (gap is None or r["first_us"] - out[-1]["last_us"] <= gap)
            if goes_on:
                out[-1] |= {"last_id": r["last_id"], "last_us": r["last_us"], "n": out[-1]["n"] + r["n"], "part": r["part"], "place": r["place"]}
            else:
                out.append(r)
        if out:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in out], schema=edges_schema)

    edges_schema = pa.schema([*[(k, pa.string()) for k in keys], ("like", pa.string() if told else pa.int64()), *[(c, pa.int64()) for c in ("first_id", "last_id", "first_us", "last_us", "n")], ("part", pa.int32()), ("place", pa.int32())])
    return edges.coalesce(1).mapInArrow(run, edges.schema)
