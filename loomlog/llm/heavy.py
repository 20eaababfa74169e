"""Problem 3: the most frequent values of columns, in bounded memory.

Each value is hashed to one of ``groups`` groups and, by another hash, to an 11-symbol word over GF(16) that is extended
by four parity symbols (a Reed-Solomon code, so words that agree with the heavy symbols of a group by chance
fail the parity check).  One pass counts, for each group, place and symbol, the rows: ``groups * 15 * 16``
counters, however many distinct values there are.  A value with at least the threshold's rows makes every one of its
symbols heavy, so the words formed of heavy symbols that pass the check hold all such values.  A second pass counts
exactly the values whose word is among these few candidates.

No value is lost: counters never undercount, every combination of heavy symbols is tried, and a group in which there are
too many to try is split (the pass is run again with four times the groups).

Defined cases: nulls and repeated rows count in the total, nulls are no item; values compare exactly; ties are all
kept; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, PARITY = 11, 4
PLACES = DATA + PARITY
GROUPS = 1024
#: Most tasks that count, and counters that one task sums.
MAX_SKETCHES, FAN = 4096, 64
#: Combinations tried for one group before it is split instead.
MAX_WORDS = 1 << 21


def _field() -> tuple[list[int], list[int]]:
    """Powers and logarithms of GF(16) with x**4 + x + 1."""
    power, x = [], 1
    for _ in range(15):
        power.append(x)
        x = x << 1 ^ (0x13 if x & 8 else 0)
    return power, [0, *(power.index(v) for v in range(1, 16))]


def _product() -> np.ndarray:
    power, log = _field()
    out = np.zeros((16, 16), np.uint8)
    for a, b in itertools.product(range(1, 16), repeat=2):
        out[a, b] = power[(log[a] + log[b]) % 15]
    return out


PRODUCT = _product()


def _generator() -> list[int]:
    """Coefficients below the leading one of the product of (x - a**i), i = 1..PARITY, highest first."""
    power, _ = _field()
    g = [1]
    for i in range(1, PARITY + 1):
        g = [a ^ int(PRODUCT[power[i], b]) for a, b in zip([*g, 0], [0, *g])]
    return g[1:]


def encode(words: np.ndarray) -> np.ndarray:
    """Rows of DATA symbols to rows of PLACES symbols (systematic)."""
    g = _generator()
    rest = np.zeros((len(words), PARITY), np.uint8)
    for i in range(DATA):
        lead = words[:, i] ^ rest[:, 0]
        rest = np.concatenate([rest[:, 1:], np.zeros((len(words), 1), np.uint8)], axis=1)
        for j, c in enumerate(g):
            rest[:, j] ^= PRODUCT[c, lead]
    return np.concatenate([words, rest], axis=1)


def symbols(word: np.ndarray) -> np.ndarray:
    """Code words of 44-bit integers."""
    return encode(np.stack([(word >> (4 * i)) & 15 for i in range(DATA)], axis=1).astype(np.uint8))


def word_of(value) -> F.Column:
    """44 bits of a value's identity."""
    return F.shiftrightunsigned(F.xxhash64(value), 20)


def sketch(df: DataFrame, columns: list[str], groups: int) -> tuple[int, dict[str, np.ndarray]]:
    """(rows, counters of each column).  Each task keeps its counters in one array.  At most ``MAX_SKETCHES`` tasks read the
    input, and their counters are summed as a tree, ``FAN`` at a time in slices of groups, so that neither the shuffle, a task nor the
    driver sees anything that grows with the data."""
    slices = 16
    width = groups // slices * PLACES * 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(groups * PLACES * 16, np.int64) for _ in columns]
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for i, table in enumerate(tables):
                known = batch.column(2 * i).is_valid()
                group, word = (batch.column(2 * i + k).filter(known).to_numpy(zero_copy_only=False) for k in (0, 1))
                if not len(group):
                    continue
                unique, times = np.unique(np.stack([group.astype(np.int64), word]), axis=1, return_counts=True)
                base = unique[0] * (PLACES * 16)
                code = symbols(unique[1])
                for p in range(PLACES):
                    table += np.bincount(base + p * 16 + code[:, p], weights=times, minlength=len(table)).astype(np.int64)
        if rows:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            for i, table in enumerate(tables):
                for s in range(slices):
                    yield pa.RecordBatch.from_pydict({"part": [part], "column": [i], "slice": [s], "rows": [rows if i == s == 0 else 0], "counts": [table[s * width : (s + 1) * width].tobytes()]}, schema=kinds)

    kinds = pa.schema([("part", pa.int32()), ("column", pa.int32()), ("slice", pa.int32()), ("rows", pa.int64()), ("counts", pa.binary())])

    def add(key, pdf):
        import pandas as pd

        total = reduce(np.add, (np.frombuffer(b, np.int64) for b in pdf["counts"]))
        return pd.DataFrame({"part": [key[0]], "column": [key[1]], "slice": [key[2]], "rows": [pdf["rows"].sum()], "counts": [total.tobytes()]})

    hashed = []
    for c in columns:
        known = F.col(c).isNotNull()
        hashed += [F.when(known, F.pmod(F.xxhash64(F.lit("group"), F.col(c)), F.lit(groups))).cast("int"), F.when(known, word_of(F.col(c)))]
    shape = "part int, column int, slice int, rows long, counts binary"
    level = df.coalesce(MAX_SKETCHES).select(*[h.alias(f"h{i}") for i, h in enumerate(hashed)]).mapInArrow(count, shape)
    parts = min(MAX_SKETCHES, df.rdd.getNumPartitions())
    while parts > 1:
        level = level.groupBy(F.floor(F.col("part") / F.lit(FAN)).cast("int").alias("part"), "column", "slice").applyInPandas(add, shape)
        parts = -(-parts // FAN)
    found = level.collect()
    tables = {c: np.zeros(groups * PLACES * 16, np.int64) for c in columns}
    for r in found:
        tables[columns[r["column"]]][r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return sum(r["rows"] for r in found), {c: t.reshape(groups, PLACES, 16) for c, t in tables.items()}


def decode(counters: np.ndarray, least: int) -> list[tuple[int, int]] | None:
    """(word, approximate count) of all candidates with at least ``least`` rows; None where a group has too many."""
    heavy = counters >= max(1, least)
    out = []
    for g in np.nonzero(heavy.any(axis=2).all(axis=1))[0].tolist():
        choices = [np.nonzero(heavy[g, p])[0] for p in range(PLACES)]
        if math.prod(len(c) for c in choices[:DATA]) > MAX_WORDS:
            return None
        words = np.stack([m.ravel() for m in np.meshgrid(*choices[:DATA], indexing="ij")], axis=1).astype(np.uint8)
        code = encode(words)
        fits = np.ones(len(code), bool)
        for p in range(DATA, PLACES):
            fits &= heavy[g, p][code[:, p]]
        for row in code[fits]:
            count = min(int(counters[g, p, s]) for p, s in enumerate(row))
            out.append((sum(int(s) << (4 * i) for i, s in enumerate(row[:DATA])), count))
    return out


def frequent_items(df: DataFrame, columns: list[str], share: float = 0.005, groups: int = GROUPS) -> DataFrame:
    """``field``, ``item``, ``approx_count`` (an upper bound from the counters), ``n`` (exact), ``share`` of all rows, of
    the values that make up at least ``share`` of all rows."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    spark = df.sparkSession
    fields = [f for f in df.select(*columns).schema.fields]
    texts = df.select(*[F.col(f.name).cast("string").alias(f.name) for f in fields])
    candidates: dict[str, list[tuple[int, int]]] = {}
    pending, rows = list(columns), 0
    while pending:
        rows, tables = sketch(texts, pending, groups)
        least = math.ceil(share * rows - 1e-9)
        found = {c: decode(t, least) for c, t in tables.items()}
        candidates |= {c: x for c, x in found.items() if x is not None}
        pending = [c for c, x in found.items() if x is None]
        groups *= 4
    least = math.ceil(share * rows - 1e-9)
    words = [(c, w, n) for c, x in candidates.items() for w, n in x]
    few = F.broadcast(spark.createDataFrame(words, "field string, word long, approx_count long"))  # at most a few times 1 / share
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("item")) for c in columns])).alias("x")
    values = texts.select(pairs).select("x.field", "x.item").where("item is not null").withColumn("word", word_of(F.col("item")))
    exact = values.join(few, ["field", "word"]).groupBy("field", "item").agg(F.count("*").alias("n"), F.max("approx_count").alias("approx_count"))
    return exact.where(F.col("n") >= least).select("field", "item", "approx_count", "n", (F.col("n") / F.lit(float(max(rows, 1)))).alias("share"))
