"""Problem 6: mixed timestamp formats and time zones, normalised to UTC instants.

Texts are reduced to shape masks, each distinct mask is mapped to a parser once in each worker, and all texts of a mask
are converted together through zone transition tables.  The tables are built once, on the driver, from the zone data whose
version :func:`loomlog.functions.timeshapes.tzdata_version` tells, and broadcast: their size is set by the number of IANA
zones.  No shuffle but for the join with the sources, which is broadcast while that table is small.

Defined cases: null, blank, incomplete and impossible texts give null, as do wall-clock times that the zone
skips and those of sources without a known zone; wall clocks before 1970 or after 2099 are read with the zone's first or
last offset there; repeated rows are converted each; times that the wall clock shows twice and
times without a year are the latest ones not after ``received_at`` (null where that is null).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeshapes import Shapes, convert, mask_of, tzdata_version, zone_table
from ..session import broadcast_if_bounded

_SHAPES: dict[int, Shapes] = {}


def normalise_times(df: DataFrame, formats: dict[int, str], text: str, format_id: str, zone: str, received: str, zones: list[str], out: str = "ts_us") -> DataFrame:
    """``df`` with ``out``: micros since 1970 in UTC, or null.  ``formats``: strftime specifiers by id; ``zones``: the
    zone names that the ``zone`` column may hold."""
    tables = {n: t for n in zones if (t := zone_table(n))}
    shared = df.sparkSession.sparkContext.broadcast((formats, tables))
    key = hash(tuple(sorted(formats.items())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        specs, zones_known = shared.value
        shapes = _SHAPES.setdefault(key, Shapes(specs))
        none = np.iinfo(np.int64).min
        longest = max((10 * len(s) for s in specs.values() if s), default=0)  # no code stands for more than ten characters
        for pdf in batches:
            # blanks inside count as one, as in the forms, so a padded time is as short as others
            texts = [re.sub(" +", " ", t.strip()) if isinstance(t, str) else "" for t in pdf["__text"]]
            ids = [None if pd.isna(f) else int(f) for f in pdf["__format"]]
            groups: dict[tuple[str, int | None], list[int]] = {}
            for i, (t, f) in enumerate(zip(texts, ids)):
                if t and len(t) <= longest:
                    groups.setdefault((mask_of(t), f), []).append(i)
            at_zone = pdf["__zone"].fillna("").to_numpy(dtype=object)
            received_us = pdf["__received"].fillna(none).to_numpy(np.int64)
            found = np.full(len(pdf), none)
            for (mask, f), rows in groups.items():
                parser = shapes.parser(mask, f)
                if parser:
                    found[rows] = convert([texts[i] for i in rows], parser, at_zone[rows], received_us[rows], zones_known)
            pdf = pdf.drop(columns=["__text", "__format", "__zone", "__received"])
            pdf[out] = pd.array(found, dtype="Int64")
            pdf.loc[found == none, out] = pd.NA
            yield pdf

    kept = [c for c in df.columns if c != out]
    prepared = df.select(*kept, F.col(text).alias("__text"), F.col(format_id).cast("int").alias("__format"), F.col(zone).alias("__zone"), F.unix_micros(F.col(received).cast("timestamp")).alias("__received"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType())])
    return prepared.mapInPandas(run, schema)


def _zone_names(sources: DataFrame) -> list[str]:
    """The sources' zones that exist.  Names are checked where they stand, so wrong ones don't count towards the bound, which
    the number of IANA zones sets."""
    known = sorted(available_timezones())
    names = sources.where(F.col("zone").isin(known)).select("zone").distinct()
    return [r[0] for r in names.collect()]


def capture_times(captures: DataFrame, sources: DataFrame, formats: DataFrame) -> DataFrame:
    """``capture_id`` and ``ts_us`` of every capture.  Formats are few by nature; more than 10,000 are refused."""
    known = formats.where("format_id is not null").select("format_id", "format_specifier").limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("more than 10,000 time formats")
    zones = sources.groupBy("logsource").agg(F.min("zone").alias("zone"))
    names = _zone_names(sources)
    rows = captures.select("capture_id", "logsource", "timestamp", "format_id", "received_at").join(broadcast_if_bounded(zones), "logsource", "left")
    found = normalise_times(rows.drop("logsource"), {r[0]: r[1] for r in known}, "timestamp", "format_id", "zone", "received_at", names)
    return found.select("capture_id", "ts_us")


def zone_transitions(sources: DataFrame) -> DataFrame:
    """``zone``, ``from_second`` (UTC, null before the first change), ``offset_s`` and ``tzdata`` of the sources' zones: the
    tables that wall-clock times are converted by, with the version of the data they come from."""
    names = _zone_names(sources)
    least = np.iinfo(np.int64).min
    rows = [(n, None if s == least else s, o, tzdata_version()) for n in sorted(names) if (t := zone_table(n)) for s, o in zip(t.starts.tolist(), t.offsets.tolist())]
    return sources.sparkSession.createDataFrame(rows, "zone string, from_second long, offset_s long, tzdata string")


def utc_text(micros) -> F.Column:
    """``yyyy-MM-ddTHH:mm:ss.ffffffZ`` of micros since 1970; the session zone plays no part."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    rest = F.pmod(micros, F.lit(86_400_000_000))
    part = lambda unit, most: F.lpad((F.floor(rest / F.lit(unit)) % F.lit(most)).cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), F.lit("."), F.lpad((rest % F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"))
