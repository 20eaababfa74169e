"""Tables with extra columns whose names clash with those that operators use inside."""

from pyspark.sql import functions as F

NAMES = ("h", "at", "n", "a", "b", "key", "rep", "form", "like", "us", "ord", "id", "k0", "part", "place", "word", "item", "field", "run", "tbl", "ids", "cap", "z", "u", "rate", "copies", "bytes", "spans", "level", "time", "score", "zone", "values", "reason", "__text", "__like", "__format", "n_tokens", "log_length", "ctx", "kind", "more", "x", "y")


def clashing(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES if n.lower() not in have])
