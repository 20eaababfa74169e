"""Problem 9: mix sources to target token shares by entropy balancing.

Every document d of source s gets a rate ``w_d = min(cap_s, exp(lambda_s + mu * z_d))``, where z_d is its
standardised log length.  The rates are those of least token-weighted relative entropy to "every document once"
under these constraints: each source contributes its share of the token budget, and the mixture keeps the
token-weighted mean log length of the pool.  The convex dual is minimised by damped Newton steps; each step is one
aggregation over the sized documents that returns one row per source.  The rates become whole copies by a
hash-uniform offset per document, shifted per source so that the copied tokens meet the budget.

Defined cases: source names compare trimmed and in lower case; targets of equal names add up (their largest cap
holds); null or non-positive shares or caps, targets without documents and documents without a target take no
part; documents without tokens (null and empty texts) are never copied; an empty pool or an empty target table gives
an empty result.  Rows with the same document id are separate documents that share their random offset.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .encode import count_tokens

#: More sources than this in the target table are refused: the dual has one variable for each, held by the driver.
MAX_SOURCES = 2_000
#: Part of the largest feasible budget that is used by default; the rest leaves room for the length constraint.
SLACK = 0.95


def source_key(column) -> F.Column:
    return F.lower(F.trim(column))


def usable_targets(targets: DataFrame) -> DataFrame:
    """``source``, ``target_share``, ``max_repeats`` with one row for each usable source name."""
    return (
        targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
        .where("source is not null and target_share > 0 and max_repeats > 0 and not isnan(target_share)")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )


def sized_documents(docs: DataFrame, targets: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Materialised ``doc_id``, ``source``, ``n_tokens``, ``cap``, ``z`` of the documents that can take part."""
    wanted = F.broadcast(targets.select("source", F.col("max_repeats").alias("cap")))
    if tokens is None:
        named = docs.select("doc_id", "text", source_key(F.col("source")).alias("source"))
        tokens = count_tokens(named.join(wanted.select("source"), "source", "left_semi"), keep=("doc_id", "source"))
    sized = tokens.where("n_tokens > 0").join(wanted, "source")
    return cut(sized.select("doc_id", "source", "n_tokens", "cap", F.log(F.col("n_tokens").cast("double")).alias("log_length")))


def _with_value(df: DataFrame, values: dict[str, float], name: str) -> DataFrame:
    """``df`` with a value for its source, by a join with at most ``MAX_SOURCES`` rows."""
    few = df.sparkSession.createDataFrame([(s, float(v)) for s, v in values.items()], f"source string, {name} double")
    return df.join(F.broadcast(few), "source")


def _rate(mu: float) -> F.Column:
    return F.least(F.col("cap").cast("double"), F.exp(F.least(F.col("lam") + F.lit(mu) * F.col("z"), F.lit(50.0))))


def _moments(sized: DataFrame, lam: dict[str, float], mu: float) -> dict[str, np.ndarray]:
    """Of each source: tokens, tokens times z, and of the uncapped part the second moments 1, z, z*z; then the dual's
    own value."""
    sized = _with_value(sized, lam, "lam")
    w, t, z = _rate(mu), F.col("n_tokens").cast("double"), F.col("z")
    cap = F.col("cap").cast("double")
    eta = F.col("lam") + F.lit(mu) * z
    free = F.when(w < cap, w).otherwise(0.0)
    phi = F.when(w < cap, w).otherwise(cap * (1 + eta - F.log(cap)))
    rows = sized.groupBy("source").agg(*[F.sum(x).alias(f"m{i}") for i, x in enumerate((t * w, t * w * z, t * free, t * free * z, t * free * z * z, t * phi))]).collect()
    return {r["source"]: np.array(r[1:], float) for r in rows}


def balance(sized: DataFrame, goal: dict[str, float], length: bool = True, steps: int = 40, tolerance: float = 1e-7) -> tuple[dict[str, float], float, int]:
    """Newton's method on the dual: ``lambda`` of each source, ``mu`` and the steps taken."""
    names, total = sorted(goal), sum(goal.values())
    c = np.array([goal[s] for s in names] + [0.0])

    def look(x: np.ndarray):
        m = _moments(sized, dict(zip(names, x[:-1])), float(x[-1]))
        value = sum(m[s][5] for s in names) - c @ x
        gradient = np.array([m[s][0] for s in names] + [sum(m[s][1] for s in names)]) - c
        hessian = np.diag([m[s][2] for s in names] + [sum(m[s][4] for s in names)])
        hessian[-1, :-1] = hessian[:-1, -1] = [m[s][3] for s in names]
        return value, gradient, hessian

    x = np.zeros(len(names) + 1)
    value, gradient, hessian = look(x)
    for step in range(steps):
        if np.abs(gradient[: None if length else -1]).max() <= tolerance * total:
            return dict(zip(names, x[:-1])), float(x[-1]), step
        free = len(x) if length else len(x) - 1
        ridge = 1e-9 * total * np.eye(free)
        move = np.zeros(len(x))
        move[:free] = np.clip(np.linalg.solve(hessian[:free, :free] + ridge, -gradient[:free]), -2, 2)
        size = 1.0
        while True:
            tried = look(x + size * move)
            if tried[0] <= value + 1e-4 * size * (gradient @ move) or size < 1e-3:
                break
            size /= 2
        x, (value, gradient, hessian) = x + size * move, tried
    return dict(zip(names, x[:-1])), float(x[-1]), steps


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, length: bool = True, tokens: DataFrame | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with ``rate`` and ``copies``, report of shares by source).

    ``total_tokens``: the budget; by default ``SLACK`` times the largest one at which no source passes its cap.
    ``tokens``: ``doc_id``, ``source``, ``n_tokens`` where they're known already.
    """
    spark = docs.sparkSession
    wanted = usable_targets(targets)
    known = {r["source"]: r for r in wanted.limit(MAX_SOURCES + 1).collect()}
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    wanted = spark.createDataFrame([tuple(r) for r in known.values()], wanted.schema)
    sized = sized_documents(docs, wanted, tokens)
    pool = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("log_length")).alias("l1"), F.sum(F.col("n_tokens") * F.col("log_length") ** 2).alias("l2")).collect()}
    share_sum = sum(known[s]["target_share"] for s in pool)
    goal: dict[str, float] = {}
    lam: dict[str, float] = {}
    mean, spread, mu = 0.0, 1.0, 0.0
    if pool:
        best = min(known[s]["max_repeats"] * pool[s]["tokens"] * share_sum / known[s]["target_share"] for s in pool)
        budget = SLACK * best if total_tokens is None else float(total_tokens)
        goal = {s: budget * known[s]["target_share"] / share_sum for s in pool}
        n = sum(r["tokens"] for r in pool.values())
        mean = sum(r["l1"] for r in pool.values()) / n
        spread = max(1e-9, sum(r["l2"] for r in pool.values()) / n - mean * mean) ** 0.5
    sized = sized.withColumn("z", (F.col("log_length") - F.lit(mean)) / F.lit(spread))
    if pool:
        lam, mu, _ = balance(sized, goal, length and spread > 1e-4)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    rated = _with_value(sized, lam, "lam").withColumn("rate", _rate(mu)).withColumn("u", u)
    shift = _rounding_shift(rated, goal)
    copies = F.greatest(F.lit(0), F.least(F.col("cap"), F.floor(F.col("rate") + F.col("u") + F.col("offset")))).cast("int")
    chosen = _with_value(rated, shift, "offset").withColumn("copies", copies)
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").cast("long").alias("mixed_docs"), F.max("copies").alias("most_copies"), F.sum("n_tokens").alias("pool_tokens"), F.count("*").alias("pool_docs"))
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # over one row a source
    report = (
        wanted.join(used, "source", "left")
        .withColumn("all_tokens", all_tokens)
        .select(
            "source", "target_share", "max_repeats",
            F.when(F.col("pool_tokens").isNotNull(), F.col("target_share") / F.lit(share_sum or 1.0)).alias("share_of_present"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pool_docs", "pool_tokens", "mixed_docs", "mixed_tokens", "most_copies")],
            F.coalesce(F.col("mixed_tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)).alias("actual_share"),
        )
    )
    return chosen.where("copies > 0").select("doc_id", "source", "n_tokens", "rate", "copies"), report


def _rounding_shift(rated: DataFrame, goal: dict[str, float], grid: int = 16, rounds: int = 3) -> dict[str, float]:
    """Shift in [-1, 1] of each source's rounding offset at which its copied tokens come nearest its goal."""
    low = {s: -1.0 for s in goal}
    step = 2.0 / grid
    best = {s: 0.0 for s in goal}
    for _ in range(rounds if goal else 0):
        made = [F.sum(F.col("n_tokens") * F.greatest(F.lit(0), F.least(F.col("cap"), F.floor(F.col("rate") + F.col("u") + F.col("low") + F.lit(i * step))))).alias(f"c{i}") for i in range(grid + 1)]
        for r in _with_value(rated, low, "low").groupBy("source").agg(*made).collect():
            s, counts = r["source"], np.array(r[1:], float)
            k = int(np.abs(counts - goal[s]).argmin())
            best[s] = low[s] + k * step
            low[s] = low[s] + max(0, int(np.searchsorted(counts, goal[s])) - 1) * step
        step /= grid
    return best
