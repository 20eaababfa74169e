"""Messages to typed rows, by a grok pattern and column specs.

All captures of a message come from one evaluation of its regular expression: the match is replaced by the wanted groups with
separators between them, and the result is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnSpec, ConfigError
from ..functions.grok import Grok

#: Between captures; messages that hold it (private-use characters) are matched group by group instead.
SEPARATOR = "\ue000\ue001"


def captures(raw: Column, grok: Grok, indices: list[int]) -> Column:
    """Texts of the groups as an array after one empty element; null where the pattern doesn't match.  A group that took
    no part is an empty text."""
    whole = rf"^[\s\S]*?(?:{grok.regex})[\s\S]*$"
    marked = F.regexp_replace(raw, whole, SEPARATOR + SEPARATOR.join(f"${i}" for i in indices))
    fast = F.when(F.startswith(marked, F.lit(SEPARATOR)), F.split(marked, SEPARATOR))
    slow = F.when(raw.rlike(grok.regex), F.array(F.lit(""), *[F.regexp_extract(raw, grok.regex, i) for i in indices]))
    return F.when(F.contains(raw, F.lit(SEPARATOR)), slow).otherwise(fast)


def parse_messages(messages: DataFrame, grok: Grok, columns: tuple[ColumnSpec, ...], default_year: int | None = None) -> DataFrame:
    """``messages`` with one typed column for each spec and ``_error``, which is null for rows that parse.

    A column takes the first of its lookups whose text converts to its type.  A row fails where the pattern doesn't match
    or a required column has no value.
    """
    wanted = [(n, g) for c in columns for n in c.lookups for g in grok.groups.get(n, ())]
    indices = list(dict.fromkeys(g.index for _, g in wanted))
    for c in columns:
        if c.required and not any(n in grok.groups for n in c.lookups):
            raise ConfigError(f"the pattern captures none of {', '.join(c.lookups)}")
    # exploding a one-element array keeps the optimiser from copying the match into every use of a capture
    matched = messages.select(*messages.columns, F.explode(F.array(captures(F.col("_raw"), grok, indices or [0]))).alias("__m"))
    # texts are columns of their own, so that conversions which look at one several times don't split again
    texts = {i: f"__t{i}" for i in indices}
    split = matched.select(*messages.columns, F.col("__m").isNotNull().alias("__ok"), *[F.col("__m")[k + 1].alias(texts[i]) for k, i in enumerate(indices)])
    values = []
    for c in columns:
        attempts = []
        for n in c.lookups:
            for g in grok.groups.get(n, ()):
                text = F.col(texts[g.index])
                attempts.append(c.spec.convert(F.nullif(text, F.lit("")) if g.optional else text, default_year))
        value = F.coalesce(*attempts) if attempts else F.lit(None).cast(c.spec.data_type)
        values.append(value.alias(c.name, metadata={"max_len": c.spec.max_len} if c.spec.max_len else {}))
    typed = split.select(*messages.columns, "__ok", *values)
    error = F.when(~F.col("__ok"), F.lit("pattern did not match"))
    for c in columns:
        if c.required:
            error = error.when(F.col(f"`{c.name}`").isNull(), F.lit(f"no value for required column {c.name}"))
    return typed.withColumn("_error", error).drop("__ok")


def parsed(rows: DataFrame) -> DataFrame:
    return rows.where("_error is null").drop("_error")


def rejected(rows: DataFrame) -> DataFrame:
    """(``desc``, ``raw_msg``) of the rows that failed."""
    return rows.where("_error is not null").select(F.col("_error").alias("desc"), F.col("_raw").alias("raw_msg"))
