"""Sinks: CSV text, SQL statements and JDBC or DB-API rows."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import HIDDEN, plain_double

#: Texts of this length on are TEXT rather than VARCHAR (fixed value).
VARCHAR_LIMIT = 16384


def visible(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in HIDDEN])


def _is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType))


def text_of(f: T.StructField) -> Column:
    """A column's text in CSV: times with their offset, doubles without exponent."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.TimestampType):
        return F.concat(F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.0+$", ""), F.date_format(c, " xxx"))
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return plain_double(c)
    return c.cast("string")


def csv_lines(df: DataFrame, header: bool = False) -> DataFrame:
    """``value``: CSV records, quoted where needed (RFC 4180); a null is the word NULL."""
    df = visible(df)

    def quoted(c: Column) -> Column:
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    fields = [F.coalesce(quoted(text_of(f)), F.lit("NULL")) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *fields).alias("value"))


def sql_type(f: T.StructField) -> str:
    t = f.dataType
    if isinstance(t, T.StringType):
        n = (f.metadata or {}).get("max_len")
        return f"VARCHAR({n})" if n and n < VARCHAR_LIMIT else "TEXT"
    for kinds, name in (((T.BooleanType,), "BOOLEAN"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "BIGINT"), ((T.FloatType, T.DoubleType), "DOUBLE"), ((T.TimestampType, T.TimestampNTZType), "TIMESTAMP"), ((T.DateType,), "DATE"), ((T.NullType,), "NULL")):
        if isinstance(t, kinds):
            return name
    raise ValueError(f"no SQL type for {t.simpleString()}")


def sql_name(name: str) -> str:
    """A name as it stands in SQL, quoted unless it is a plain identifier."""
    plain = name.isascii() and name.replace("_", "a").isalnum() and not name[0].isdigit()
    return name if plain else '"' + name.replace('"', '""') + '"'


def create_table(schema: T.StructType, table: str, pre_name_opts: str = "", table_opts: str = "") -> str:
    columns = ",\n".join(f"    {sql_name(f.name)} {sql_type(f)}" for f in schema.fields if f.name not in HIDDEN)
    head = " ".join(x for x in ("CREATE TABLE", pre_name_opts, sql_name(table)) if x)
    return f"{head} (\n{columns}\n){' ' + table_opts if table_opts else ''};"


def sql_literal(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.BooleanType):
        text = F.when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        text = plain_double(c)
    elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = c.cast("string")
    else:
        plain = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if _is_time(f.dataType) else c.cast("string")
        text = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(text)


def insert_statements(df: DataFrame, table: str, batch_size: int = 1000) -> DataFrame:
    """``value``: INSERT statements of up to ``batch_size`` rows (0: one for each partition); no shuffle."""
    df = visible(df)
    names = ", ".join(sql_name(c) for c in df.columns)
    rows = df.select(F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(f) for f in df.schema.fields]), F.lit(")")).alias("value"))
    head = f"INSERT INTO {sql_name(table)} ({names})\n VALUES \n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while batch_size and len(held) >= batch_size:
                yield pa.RecordBatch.from_pydict({"value": [head + ",\n".join(held[:batch_size]) + ";"]})
                held = held[batch_size:]
        if held:
            yield pa.RecordBatch.from_pydict({"value": [head + ",\n".join(held) + ";"]})

    return rows.mapInArrow(run, "value string")


def _print(lines: DataFrame, out: TextIO, head: str | None) -> None:
    if head:
        out.write(head + "\n")
    for r in lines.toLocalIterator():
        out.write(r[0] + "\n")


def write_text(lines: DataFrame, target: str, head: str | None = None, mode: str = "append", single: bool = False, append_to_file: bool = False) -> None:
    """Writes a text per row: ``-`` prints them, anything else is a folder of text files.  ``head`` comes first.

    ``append_to_file``: the target is one file on the driver's machine that rows are appended to, partition after partition, for
    results that one reader takes; ``head`` is then written where the file is new or empty."""
    if target == "-":
        _print(lines, sys.stdout, head)
        sys.stdout.flush()
        return
    if append_to_file:
        with open(target, "a", encoding="utf-8") as f:
            _print(lines, f, head if f.tell() == 0 else None)
        return
    if head:
        first = lines.sparkSession.createDataFrame([(head,)], "value string")
        lines = first.union(lines).coalesce(1) if single else first.union(lines)
    elif single:
        lines = lines.coalesce(1)
    lines.write.mode(mode).text(target)


def write_csv(df: DataFrame, target: str, add_header: bool = False, single: bool = False, mode: str = "append", append_to_file: bool = False) -> None:
    head = ",".join(c if not any(x in c for x in ',"\n') else '"' + c.replace('"', '""') + '"' for c in visible(df).columns) if add_header else None
    write_text(csv_lines(df), target, head, mode, single, append_to_file)


def write_sql(df: DataFrame, target: str, table: str, batch_size: int = 1000, add_ddl: bool = False, pre_name_opts: str = "", table_opts: str = "", single: bool = False, mode: str = "append", append_to_file: bool = False) -> None:
    head = create_table(df.schema, table, pre_name_opts, table_opts) if add_ddl else None
    write_text(insert_statements(df, table, batch_size), target, head, mode, single, append_to_file)


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, properties: dict[str, str] | None = None) -> None:
    visible(df).write.option("batchsize", batch_size or 1000).jdbc(url, sql_name(table), mode="append", properties=properties or {})


def write_dbapi(df: DataFrame, connect: Callable, table: str, batch_size: int = 1000, placeholder: str = "?") -> None:
    """Rows through any DB-API driver, with a connection for each partition and prepared inserts of ``batch_size``."""
    df = visible(df)
    statement = f"INSERT INTO {sql_name(table)} ({', '.join(map(sql_name, df.columns))}) VALUES ({', '.join([placeholder] * len(df.columns))})"

    def run(rows) -> None:
        connection = connect()
        try:
            held: list[tuple] = []
            for r in rows:
                held.append(tuple(r))
                if len(held) >= (batch_size or 1000):
                    connection.cursor().executemany(statement, held)
                    held = []
            if held:
                connection.cursor().executemany(statement, held)
            connection.commit()
        finally:
            connection.close()

    df.foreachPartition(run)
