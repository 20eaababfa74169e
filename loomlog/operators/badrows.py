"""Problem 5: rows that fail to parse.

CSV records are parsed in blocks of one schema by a fast columnar path: a pattern for the block's quoting and column
count, the columnar CSV reader, and vectorised checks of each column.  A block that passes is valid as a whole.  A block that
fails is bisected until single bad records are left, and those are diagnosed strictly, character by character.

Defined cases: null and blank records are left out; a record of an unknown schema has the reason ``no_schema``; a line
break outside quotes is an ordinary character; an empty optional value is null; repeated records are each judged.
No shuffle: schemas are a small table (its size is checked) and travel with the tasks.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefmt
from ..functions.typespec import FLOAT_PATTERN, INT_PATTERN, TypeSpec, parse_spec
from ..session import broadcast_if_bounded

BLOCK = 512
#: Blocks of so few records are diagnosed one by one, as the columnar path costs more than that.
LEAF = 8
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'


@dataclass(frozen=True)
class Field:
    name: str
    spec: TypeSpec
    required: bool


def split_record(record: str) -> list[str] | None:
    """Fields of one record; None if its quoting is broken."""
    fields, i, n = [], 0, len(record)
    while True:
        if record[i : i + 1] == '"':
            end = i + 1
            while True:
                end = record.find('"', end)
                if end < 0:
                    return None
                if record[end + 1 : end + 2] != '"':
                    break
                end += 2
            fields.append(record[i + 1 : end].replace('""', '"'))
            i = end + 1
            if i < n and record[i] != ",":
                return None
        else:
            end = record.find(",", i)
            end = n if end < 0 else end
            if record.find('"', i, end) >= 0:
                return None
            fields.append(record[i:end])
            i = end
        if i >= n:
            return fields
        i += 1


def convertible(value: str, spec: TypeSpec) -> bool:
    if spec.kind == "str":
        return len(value.encode()) <= spec.max_len
    if spec.kind == "long":
        return bool(re.match(INT_PATTERN, value)) and value[-1] != "\n" and -(1 << 63) <= int(value) < 1 << 63
    if spec.kind == "double":
        return bool(re.match(FLOAT_PATTERN, value)) and value[-1] != "\n"
    if spec.kind == "bool":
        return value.lower() in ("true", "false")
    return timefmt.matches(spec.fmt, value) if spec.kind == "ts" else True


def diagnose(record: str, fields: list[Field]) -> tuple[str | None, str | None, list[str | None] | None]:
    """(reason, column, values) of one record, strictly; the reason is None for a valid one."""
    values = split_record(record)
    if values is None:
        return "quoting", None, None
    if len(values) != len(fields):
        return "column_count", None, None
    for value, f in zip(values, fields):
        if value == "":
            if f.required:
                return "missing_value", f.name, None
        elif not convertible(value, f.spec):
            return "invalid_value", f.name, None
    return None, None, [v or None for v in values]


def _column_valid(values: pa.Array, f: Field) -> bool:
    empty = pc.equal(values, "")
    if f.required and pc.any(empty).as_py():
        return False
    if f.spec.kind == "str":
        return (pc.max(pc.binary_length(values)).as_py() or 0) <= f.spec.max_len
    filled = values.filter(pc.invert(empty))
    if not len(filled):
        return True
    if f.spec.kind == "long":
        # 18 digits always fit; longer ones are left to the strict path
        return pc.all(pc.match_substring_regex(filled, r"^[+-]?[0-9]{1,18}$")).as_py()
    if f.spec.kind == "double":
        return pc.all(pc.match_substring_regex(filled, FLOAT_PATTERN)).as_py() and not pc.any(pc.match_substring(filled, "\n")).as_py()
    if f.spec.kind == "bool":
        return pc.all(pc.is_in(pc.utf8_lower(filled), pa.array(["true", "false"]))).as_py()
    if f.spec.kind == "ts":
        return all(timefmt.matches(f.spec.fmt, v) for v in filled.to_pylist())
    return True


class BlockParser:
    """The fast path over blocks of one schema's records, with bisection."""

    def __init__(self, fields: list[Field]):
        self.fields = fields
        self.names = [str(i) for i in range(len(fields))]
        self.pattern = "(?s)^" + _FIELD + f"(?:,{_FIELD}){{{len(fields) - 1}}}$"
        self.reader = {
            "parse_options": csv.ParseOptions(newlines_in_values=True, double_quote=True, ignore_empty_lines=False),
            "convert_options": csv.ConvertOptions(column_types={n: pa.string() for n in self.names}, strings_can_be_null=False),
        }

    def well_formed(self, records: list[str]) -> np.ndarray:
        """Whether each record has unbroken quoting and the right number of fields."""
        return pc.match_substring_regex(pa.array(records, pa.string()), self.pattern).to_numpy(zero_copy_only=False)

    def fast(self, records: list[str]) -> list[list[str | None]] | None:
        """Values of all records of a well-formed block, or None if any may be bad."""
        data = "\n".join(records).encode() + b"\n"
        options = csv.ReadOptions(column_names=self.names, block_size=max(1 << 16, len(data) + 1), use_threads=False)
        try:
            table = csv.read_csv(io.BytesIO(data), read_options=options, **self.reader)
        except pa.ArrowInvalid:
            return None
        if table.num_rows != len(records):
            return None
        columns = [c.combine_chunks() for c in table.columns]
        if not all(_column_valid(c, f) for c, f in zip(columns, self.fields)):
            return None
        return [[v or None for v in row] for row in zip(*(c.to_pylist() for c in columns))]

    def parse(self, records: list[str]) -> list[tuple[str | None, str | None, list[str | None] | None]]:
        bad = np.concatenate([[0], np.cumsum(~self.well_formed(records))])  # before each record
        out: list = [None] * len(records)

        def bisect(start: int, end: int) -> None:
            if end - start <= LEAF:
                for i in range(start, end):
                    out[i] = diagnose(records[i], self.fields)
                return
            values = self.fast(records[start:end]) if bad[end] == bad[start] else None
            if values is not None:
                out[start:end] = [(None, None, v) for v in values]
                return
            middle = (start + end) // 2
            bisect(start, middle)
            bisect(middle, end)

        bisect(0, len(records))
        return out


def read_schemas(columns: DataFrame, max_columns: int = 100_000) -> dict[str, list[Field]]:
    """Schemas by name from a table of column definitions, which must have ``max_columns`` rows at most."""
    rows = columns.select("schema_name", "col_pos", "name", "pv_type", "required").limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} column definitions")
    out: dict[str, list[Field]] = {}
    for r in sorted((r for r in rows if r["schema_name"] is not None), key=lambda r: (r["schema_name"], r["col_pos"])):
        out.setdefault(r["schema_name"], []).append(Field(r["name"], parse_spec(r["pv_type"] or ""), bool(r["required"])))
    return out


def judge_records(df: DataFrame, schemas: dict[str, list[Field]], row_id: str = "rec_id", schema_name: str = "schema_name", record: str = "raw_msg") -> DataFrame:
    """``row_id``, ``schema_name``, ``raw_msg``, ``reason`` (null if valid), ``bad_column``, ``values`` (texts of a
    valid record)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers = {k: BlockParser(v) for k, v in schemas.items()}
        for pdf in batches:
            names, records = pdf["schema_name"].tolist(), pdf["raw_msg"].tolist()
            found: list = [("no_schema", None, None)] * len(pdf)
            by: dict[str, list[int]] = {}
            for i, s in enumerate(names):
                if s in parsers:
                    by.setdefault(s, []).append(i)
            for s, at in by.items():
                for k in range(0, len(at), BLOCK):
                    part = at[k : k + BLOCK]
                    for i, x in zip(part, parsers[s].parse([records[i] for i in part])):
                        found[i] = x
            pdf["reason"], pdf["bad_column"], pdf["values"] = zip(*found) if found else ([], [], [])
            yield pdf

    rows = df.where(f"`{record}` is not null and trim(both '\t\r\n ' from `{record}`) <> ''").select(F.col(row_id).alias("row_id"), F.col(schema_name).alias("schema_name"), F.col(record).alias("raw_msg"))
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"row_id {kind}, schema_name string, raw_msg string, reason string, bad_column string, values array<string>")


def typed_rows(judged: DataFrame, fields: list[Field], name: str, default_year: int | None = None) -> DataFrame:
    """Valid rows of one schema as typed columns beside ``row_id``."""
    valid = judged.where((F.col("schema_name") == name) & F.col("reason").isNull())
    return valid.select("row_id", *[f.spec.convert(F.col("values")[i], default_year).alias(f.name) for i, f in enumerate(fields)])


def typed_records(judged: DataFrame, schemas: dict[str, list[Field]], default_year: int | None = None) -> DataFrame:
    """Valid rows of all schemas: ``row_id``, ``schema_name`` and ``record``, which has a struct of typed columns for each
    schema by its name; those of other schemas are null."""
    typed = lambda fields: F.struct(*[f.spec.convert(F.col("values")[i], default_year).alias(f.name) for i, f in enumerate(fields)])
    one_of = [F.when(F.col("schema_name") == name, typed(fields)).alias(name) for name, fields in schemas.items()]
    valid = judged.where("reason is null")
    return valid.select("row_id", "schema_name", (F.struct(*one_of) if one_of else F.lit(None)).alias("record"))


def named_values(judged: DataFrame, schemas: dict[str, list[Field]]) -> DataFrame:
    """``row_id``, ``name``, ``value`` (text, null where empty) of each column of the valid rows."""
    rows = [(s, i, f.name) for s, fields in schemas.items() for i, f in enumerate(fields)]
    names = judged.sparkSession.createDataFrame(rows, "schema_name string, place int, name string")
    pairs = judged.where("reason is null").select("row_id", "schema_name", F.posexplode("values").alias("place", "value"))
    return pairs.join(broadcast_if_bounded(names), ["schema_name", "place"]).select("row_id", "name", "value")


def rejects(judged: DataFrame) -> DataFrame:
    """(``row_id``, ``desc``, ``raw_msg``) of bad rows: the reason, with the column where there is one."""
    desc = F.when(F.col("bad_column").isNull(), F.col("reason")).otherwise(F.concat_ws(": ", "reason", "bad_column"))
    return judged.where("reason is not null").select("row_id", desc.alias("desc"), "raw_msg")
