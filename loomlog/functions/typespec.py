"""Column types as written in configurations: ``str[:N]``, ``:N``, ``int``, ``long``, ``float``, ``double``, ``bool``,
``null`` and ``ts:<strftime>``.

Texts are converted without trimming.  A value that can't be converted is missing (null): strings longer than their limit in
UTF-8 bytes, integers outside 64 bits, floats in anything but plain decimal or exponent notation (``inf`` and ``nan`` are
numbers), booleans other than true and false in any case, times that don't fit their format or whose day doesn't exist.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import timefmt

DEFAULT_LENGTH = 256
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"


@dataclass(frozen=True)
class TypeSpec:
    kind: str  # str, long, double, bool, null or ts
    max_len: int | None = None
    fmt: str | None = None

    @property
    def data_type(self) -> T.DataType:
        return {"str": T.StringType, "long": T.LongType, "double": T.DoubleType, "bool": T.BooleanType, "null": T.NullType, "ts": T.TimestampType}[self.kind]()

    def convert(self, text: Column, default_year: int | None = None) -> Column:
        """The typed value of a string column, null where it can't be converted.  Stays in the JVM."""
        if self.kind == "str":
            return F.when(F.octet_length(text) <= self.max_len, text)
        if self.kind == "long":
            return F.when(text.rlike(INT_PATTERN), text.try_cast("long"))
        if self.kind == "double":
            special = F.lower(F.regexp_replace(text, r"^\+", ""))
            named = F.when(special.isin("inf", "infinity"), F.lit(float("inf"))).when(special.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(special.isin("nan", "-nan"), F.lit(float("nan")))
            return F.when(text.rlike(FLOAT_PATTERN), F.coalesce(named, text.try_cast("double")))
        if self.kind == "bool":
            return F.when(F.lower(text) == "true", F.lit(True)).when(F.lower(text) == "false", F.lit(False))
        if self.kind == "ts":
            return timefmt.parse_time(text, self.fmt, default_year)
        return F.lit(None)


def parse_spec(spec: str) -> TypeSpec:
    """A type from its text; raises ValueError for anything unknown."""
    name, _, rest = spec.partition(":")
    if name in ("", "str"):
        if rest and not re.fullmatch("[0-9]+", rest):
            raise ValueError(f"invalid column type: {spec!r}")
        return TypeSpec("str", int(rest) if rest else DEFAULT_LENGTH)
    if name == "ts" and rest:
        return TypeSpec("ts", fmt=rest)
    kinds = {"int": "long", "long": "long", "float": "double", "double": "double", "bool": "bool", "null": "null"}
    if spec in kinds:
        return TypeSpec(kinds[spec])
    raise ValueError(f"invalid column type: {spec!r}")
