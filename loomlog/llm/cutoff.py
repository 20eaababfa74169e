"""Problem 4: text cut off by field limits or in mid-transfer.

Values are reduced to forms (case folded, numbers and ids as ``#``, names and other free words as one placeholder), so that
copies need not be of the same object.  A form is read in clauses (up to a full stop, comma or semicolon before a blank), and a
prefix self-join finds forms that are strict prefixes of longer copies: every prefix of every clause is hashed with what
follows it, and the whole of each last clause is joined with these hashes.  A last piece of a word is joined in the same way with
the strict prefixes of the words that follow the same tokens elsewhere.  A form is cut where longer copies go on and next to none
end: endings count only from rows that no limit can have cut.

A text that fills its byte limit to the last byte is cut unless texts are known to end like that; those that
a limit could have cut before a character of several bytes likewise, with a stricter test.

All thresholds are counts of copies or ratios of counts at one place, so other rows of the table don't change a verdict.

Defined cases: null and empty texts are no case; repeated rows are each a case; texts of sources without a known limit
are judged by their copies alone; an empty table gives no rows; rates cover all rows with a text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, cut

#: Words seen less often are free; others are fixed if one side has few neighbours (a low perplexity), in itself or by comparison.
LEAST_WORD, PERPLEXITY, UNEVEN = 20, 5.0, 2.0
#: Prefixes with fewer longer copies say nothing.
LEAST = 5
#: Most that may end at a place, as a share of all that come to it, if endings there are cuts.
ENDS, ENDS_AT_LIMIT = 0.08, 0.5
#: One of so many last tokens must be a fixed word for others' going on to tell anything.
EVIDENCE = 6
FREE = "¤"
#: Marks that close a sentence: where the clause before is too rare to tell, three tokens that end so decide.
CLOSING = frozenset(".!?。！？")
#: Fixed words are broadcast up to this many, beyond it joined through a shuffle.
MAX_BROADCAST_WORDS = 200_000

_UUID = r"(?<![\p{L}\d])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![\p{L}\d])"
_PART = r"(?<![\p{L}\d])[0-9a-f]{8}-(?:[0-9a-f]{0,4}|(?:[0-9a-f]{4}-){1,3}[0-9a-f]{0,11})$"
_VALUE = r"(?<![\p{L}\d])(?:(?=[a-f]*\d)[0-9a-f]{4,}|[0-9a-f]{8,})(?![\p{L}\d])|\d+(?:[.,]\d+)*"
# characters beyond ASCII belong to words, as symbols stand inside words that were wrongly decoded
# characters beyond ASCII belong to words, as symbols stand inside words that were wrongly decoded
_TOKEN = re.compile(r"#|\.{3,}|…|(?:[^\W\d_]|[^\x00-\x7f\s…])+|[.,;](?=\s)|[^\w\s]|_|\d")


def form(text) -> F.Column:
    folded = F.lower(F.upper(F.regexp_replace(text, r"\s+$", "")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, _UUID, "#"), _PART, "# ~"), _VALUE, "#")


def tokens_of(text: str) -> tuple[list[str], list[bool]]:
    """Tokens of a form, and after which of them a clause begins."""
    tokens, breaks = [], []
    for m in _TOKEN.finditer(text):
        t = m[0]
        tokens.append("…" if t[:3] == "..." else t)
        breaks.append(t in ".,;" and text[m.end() : m.end() + 1].isspace())
    return tokens, breaks


def _is_word(t: str) -> bool:
    return any(c.isalpha() for c in t)


_STEPS: dict[tuple[int, str], int] = {}


def step(before: int, token: str) -> int:
    """Hash of a prefix from the hash of the prefix before its last token; 0 is the start of a clause."""
    key = before, token
    if key not in _STEPS:
        if len(_STEPS) > 200_000:
            _STEPS.clear()
        _STEPS[key] = int.from_bytes(blake2b(before.to_bytes(8, "little", signed=True) + token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return _STEPS[key]


def word_starts(word: str) -> list[int]:
    """Hashes of the strict prefixes of a word, character by character."""
    out, h = [], 0
    for c in word[:-1]:
        h = step(h, c)
        out.append(h)
    return out


def neighbours(forms: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: how often token b follows token a (``^`` and ``$`` stand for the ends)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for text, n in zip(pdf["form"], pdf["n"]):
                t, _ = tokens_of(text)
                for pair in zip(["^", *t], [*t, "$"]):
                    found[pair] += n
            yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["a", "b", "n"])

    return forms.mapInPandas(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fixed_words(pairs: DataFrame) -> DataFrame:
    """``word``, ``n``, ``fixed`` of words seen ``LEAST_WORD`` times: whether they belong to fixed parts of texts."""
    nlogn = F.sum(F.col("n") * F.log("n")).alias("s")
    perplexity = F.exp(F.log("n") - F.col("s") / F.col("n"))

    def side(word: str) -> DataFrame:
        return pairs.groupBy(F.col(word).alias("word")).agg(nlogn, F.sum("n").alias("n")).where(F.col("n") >= LEAST_WORD).select("word", F.col("n").alias(f"n_{word}"), perplexity.alias(f"p_{word}"))

    low, high = F.least("p_a", "p_b"), F.greatest("p_a", "p_b")
    return side("b").join(side("a"), "word").where("word rlike '\\\\p{L}'").select("word", F.col("n_b").alias("n"), ((low <= PERPLEXITY) | (high >= UNEVEN * low)).alias("fixed"))


def _masked(forms: DataFrame, words: DataFrame) -> DataFrame:
    """Forms with the list of fixed words they hold, gathered by a join, so that no list of all words goes to one place."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(text, t) for text in pdf["form"] for t in {x for x in tokens_of(text)[0] if _is_word(x)}]
            yield pd.DataFrame(rows, columns=["form", "word"])

    held = forms.select("form").mapInPandas(tokens, "form string, word string")
    fixed = held.join(broadcast_if_bounded(words.where("fixed").select("word"), MAX_BROADCAST_WORDS), "word").groupBy("form").agg(F.collect_list("word").alias("fixed"))
    return forms.join(fixed, "form", "left")


def _contexts(masked: DataFrame) -> DataFrame:
    """``kind`` f: token ``word`` follows prefix ``key`` in ``n`` texts; e: ``n`` texts end there; t: the tail of each form, with
    the prefix up to its end and up to its last token (``key``, ``before``), ``free``, the former with a free last word,
    ``start``, the hash of the last word's characters, and ``short``, the last three tokens if the last one closes a sentence."""
    names = ["kind", "form", "key", "before", "free", "short", "start", "word", "evidence", "dots", "partial", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            follows: Counter = Counter()
            ends: Counter = Counter()
            tails = []
            for text, n, n_free, fixed in zip(pdf["form"], pdf["n"], pdf["n_free"], pdf["fixed"]):
                raw, breaks = tokens_of(text)
                if not raw:
                    continue
                known = set(() if fixed is None else fixed)
                partial = len(raw) > 1 and raw[-2:] == ["#", "~"]
                if partial:
                    raw.pop()
                dots = raw[-1] == "…" and len(raw) > 1
                masked = [t if not _is_word(t) or t in known else FREE for t in raw]
                key, shown = 0, len(raw) - dots
                for i, (t, m, b) in enumerate(zip(raw, masked, breaks)):
                    before = key
                    follows[key, t] += n
                    key = step(key, m)
                    if i == shown - 1:
                        last, tail, free = before, key, step(before, FREE) if _is_word(t) else key
                    if b:
                        follows[key, ""] += n
                        key = 0
                if n_free and not partial:
                    ends[key] += n_free
                word = raw[shown - 1]
                short = 0
                for i in [i for i, t in enumerate(raw[:shown]) if t in CLOSING and i > 1]:
                    short = step(step(step(-1, masked[i - 2]), masked[i - 1]), raw[i])
                    if i < shown - 1:
                        follows[short, ""] += n
                        short = 0
                    else:
                        ends[short] += n
                tails.append(("t", text, tail, last, free, short, word_starts(word + " ")[-1], word, any(t in known for t in raw[max(0, shown - EVIDENCE) : shown]), dots, partial, n))
            rows = [("f", None, k, 0, 0, 0, 0, w, False, False, False, n) for (k, w), n in follows.items()] + [("e", None, k, 0, 0, 0, 0, None, False, False, False, n) for k, n in ends.items()]
            yield pd.DataFrame(rows + tails, columns=names)

    return masked.select("form", "n", "n_free", "fixed").mapInPandas(run, "kind string, form string, key long, before long, free long, short long, start long, word string, evidence boolean, dots boolean, partial boolean, n long")


def _longer_words(follow: DataFrame, words: DataFrame, tails: DataFrame) -> DataFrame:
    """``before``, ``word``, ``half``, ``half_at_limit``: last pieces that are strict prefixes of words which follow the same tokens
    in longer copies (fixed words), or that stand there and are frequent (free ones)."""
    letters = "word rlike '\\\\p{L}'"
    known = follow.where(letters).join(words, "word").where((F.col("k") >= LEAST) | ~F.col("fixed"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, h, k, n, fixed) for key, word, k, n, fixed in zip(pdf["key"], pdf["word"], pdf["k"], pdf["n"], pdf["fixed"]) for h in word_starts(word)]
            yield pd.DataFrame(rows, columns=["before", "start", "k", "n", "fixed"])

    starts = known.select("key", "word", "k", "n", "fixed").mapInPandas(expand, "before long, start long, k long, n long, fixed boolean")
    best = starts.groupBy("before", "start").agg(F.max(F.when(F.col("fixed"), F.col("k"))).alias("k_fixed"), F.max(F.when(~F.col("fixed"), F.col("n"))).alias("n_free"))
    pieces = tails.where(letters).select("before", "start", "word").distinct()
    found = pieces.join(best, ["before", "start"]).join(follow.select(F.col("key").alias("before"), "word", F.col("k").alias("m")), ["before", "word"]).join(words.select("word", F.col("n").alias("n_piece")), "word", "left")
    part = F.coalesce("n_piece", "m") <= ENDS * F.col("n_free")
    some = lambda c: F.coalesce(c, F.lit(False))
    return found.select("before", "word", (some(F.col("m") <= ENDS * F.col("k_fixed")) | some(part)).alias("half"), (some(F.col("m") <= ENDS_AT_LIMIT * F.col("k_fixed")) | some(part)).alias("half_at_limit")).where("half_at_limit")


def judge_forms(forms: DataFrame) -> DataFrame:
    """``form`` (with ``n`` rows, ``n_free`` of them clear of any limit) and its verdicts: ``cut_inside`` (away from any limit),
    ``cut_near`` and ``cut_at`` a limit."""
    pairs = cut(neighbours(forms))
    words = cut(fixed_words(pairs))
    found = cut(_contexts(_masked(forms, words)))
    follow = cut(found.where("kind = 'f'").groupBy("key", "word").agg(F.sum("n").alias("k")))
    ended = found.where("kind = 'e'").select("key", F.lit(0).cast("long").alias("k"), F.col("n").alias("e"))
    context = follow.select("key", "k", F.lit(0).cast("long").alias("e")).union(ended).groupBy("key").agg(F.sum("k").alias("on"), F.sum("e").alias("ends")).where(F.col("on") + F.col("ends") >= LEAST)
    tails = found.where("kind = 't'").select("form", "key", "before", "free", "short", "start", "word", "evidence", "dots", "partial", "n")
    as_free = context.select(F.col("key").alias("free"), F.col("on").alias("on_f"), F.col("ends").alias("ends_f"))
    closed = context.select(F.col("key").alias("short"), F.col("on").alias("on_s"), F.col("ends").alias("ends_s"))
    halves = _longer_words(follow, words, tails)
    dotted = tails.where("dots").groupBy("key").agg(F.sum("n").alias("dotted"))
    joined = tails.join(context, "key", "left").join(halves, ["before", "word"], "left").join(as_free, "free", "left").join(closed, "short", "left").join(dotted, "key", "left")
    joined = joined.na.fill(False, ["half", "half_at_limit"]).na.fill(0, ["on", "ends", "on_f", "ends_f", "on_s", "ends_s", "dotted"])
    known = F.when(F.col("dots"), F.col("dotted")).otherwise(F.col("ends"))
    all_ = F.col("on") + F.col("ends")
    closes = lambda share: (all_ < LEAST) & (F.col("ends_s") >= LEAST) & (F.col("ends_s") > share * (F.col("on_s") + F.col("ends_s")))
    complete = lambda share: ~F.col("partial") & ((known >= LEAST) & (known > share * all_) | ~F.col("dots") & closes(share))
    on = F.col("on") - F.when(F.col("dots"), F.col("dotted")).otherwise(0)
    goes_on = (on >= LEAST) & F.col("evidence") & (F.col("partial") | F.col("dots") | (F.col("ends") <= ENDS * all_))
    free_goes_on = (all_ < LEAST) & (F.col("on_f") >= LEAST) & F.col("evidence") & ~F.col("dots") & (F.col("ends_f") <= ENDS * (F.col("on_f") + F.col("ends_f")))
    half = F.col("half") & ~F.col("partial")
    inside = (goes_on | half | (F.col("partial") & (all_ >= LEAST)) | free_goes_on) & ~(complete(ENDS) & (F.col("dots") | ~half))
    return joined.select("form", inside.alias("cut_inside"), (inside | ~complete(ENDS)).alias("cut_near"), (inside | F.col("half_at_limit") | ~complete(ENDS_AT_LIMIT)).alias("cut_at"))


def byte_limits(sources: DataFrame, columns: DataFrame, name: str = "message") -> DataFrame:
    """``logsource``, ``max_bytes`` of the named column, from type specs (``str:N``, ``:N``, N 256 by default)."""
    spec = columns.where(F.col("name") == name).select("schema_name", F.col("pv_type").alias("spec"))
    size = F.when(F.col("spec").isin("str", ""), F.lit(256)).otherwise(F.regexp_extract("spec", r"^(?:str)?:(\d+)$", 1).try_cast("int"))
    return sources.join(spec.groupBy("schema_name").agg(F.min(size).alias("max_bytes")), "schema_name").groupBy("logsource").agg(F.min("max_bytes").alias("max_bytes"))


def judge_texts(df: DataFrame, limits: DataFrame, row_id: str = "line_id", source: str = "logsource", text: str = "message") -> DataFrame:
    """``row_id``, ``source``, ``is_cut`` of every row with a text.  ``limits``: ``logsource``, ``max_bytes``."""
    rows = df.where(f"`{text}` is not null and `{text}` <> ''").select(F.col(row_id), F.col(source), F.col(text).alias("__text"))
    known = limits.select(F.col("logsource").alias(source), "max_bytes")
    formed = rows.withColumn("form", form(F.col("__text"))).withColumn("bytes", F.octet_length("__text")).drop("__text").join(broadcast_if_bounded(known), source, "left")
    clear = F.coalesce(F.col("bytes") < F.col("max_bytes") - 3, F.lit(True))
    forms = cut(formed.groupBy("form").agg(F.count("*").alias("n"), F.count_if(clear).alias("n_free")))
    verdicts = judge_forms(forms).where("cut_inside or cut_near or cut_at")
    # forms are met by 128 bits of their text
    keys = [F.xxhash64("form").alias("key"), F.xxhash64(F.lit(1), "form").alias("key2")]
    judged = formed.select(row_id, source, "bytes", "max_bytes", *keys).join(verdicts.select("cut_inside", "cut_near", "cut_at", *keys), ["key", "key2"], "left")
    at = F.col("bytes") == F.col("max_bytes")
    near = F.col("bytes").between(F.col("max_bytes") - 3, F.col("max_bytes") - 1)
    is_cut = F.when(at, F.col("cut_at")).when(near, F.col("cut_near")).otherwise(F.col("cut_inside"))
    return judged.select(row_id, source, F.coalesce(is_cut, F.lit(False)).alias("is_cut"))


def cut_rates(judged: DataFrame, source: str = "logsource") -> DataFrame:
    """Of each source: rows with a text, cut rows and their rate."""
    return judged.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_if("is_cut").alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_rows"))
