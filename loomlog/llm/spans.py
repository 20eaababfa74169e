"""Problem 10: long spans that stand verbatim in more than one record.

Seeds are k-mers chosen by winnowing: of every ``window`` consecutive k-mers those of the least hash.  With
``k + window - 1 = min_length`` any common substring of ``min_length`` code points contains a k-mer that is chosen in
both texts, so no case is lost.  Seeds that occur in one text only are dropped by an aggregation; the others are joined
into pairs of texts.  Of each pair the neighbourhoods of its seeds are compared: every window of ``min_length`` that both
hold is extended to a maximal match, and the matches are chained: the best collinear chains with gap costs are
found through a Fenwick tree over the second text's positions.  A seed that repeats in both texts makes no square of
anchors, as matches come from whole windows: each place of one text gets one partner, the next in order.

For passages the chains also take matches of k code points, and the gaps inside a chain are aligned (longest common
subsequence), which gives fuzzy passages with their share of equal code points around verbatim spans.

Exact copies of a text stand for one class: seeds, pairs and passages are those of the class's lowest id, and
members are added at the end.  Seeds in more than ``hot`` texts are not compared text by text: of the windows around them that two
texts share, one stands for all that the same texts hold; two of its holders are chained and aligned, and stand for every two,
as all hold the same text.  Both ways are exact, so results don't depend on ``hot``.

Defined cases: null, empty and short texts have no span; a text shared with itself is no case; rows that
repeat a document id are pieces of one document; positions are code points from 0; columns other than id and text play no part.
Pairs rest on compared texts or, around hot seeds, on 128-bit digests of them; shared code points around hot seeds on 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, cut

#: Shorter seeds are chosen more sparsely (of every ``min_length - K + 1``), but boilerplate makes more chance matches.
K = 100
MIN_LENGTH = 200
#: Texts that hold one seed beyond which pairs come from its windows; it changes the cost and not the result.
HOT = 100
#: Most code points that a chain may skip between two matches.
MOST_GAP = 1000
#: Ids of texts that take part are broadcast up to this many (16 MB), beyond it joined through a shuffle.
MAX_BROADCAST_IDS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    z = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB) + np.uint64(salt * int(_ODD) % (1 << 64))
    z ^= z >> np.uint64(31)
    return z * _ODD


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-mer, by doubling; empty where the text is shorter than k."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    h, size = points.astype(np.uint64) * _ODD, 1
    while size * 2 <= k:
        h = _mix(h[:-size], h[size:], size)
        size *= 2
    if size < k:
        h = _mix(h[: n - k + 1], h[k - size : k - size + n - k + 1], k)
    return h ^ (h >> np.uint64(32))


def _running(h: np.ndarray, window: int, least: bool) -> np.ndarray:
    pick, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= window:
        h = pick(h[:-size], h[size:])
        size *= 2
    return pick(h[: len(h) - window + size], h[window - size :]) if size < window else h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of some window of ``window`` hashes."""
    n = len(h)
    if n < window:
        return np.empty(0, np.int64)
    least = _running(h, window, True)
    pad = np.zeros(window - 1, np.uint64)
    return np.nonzero(_running(np.concatenate([pad, least, pad]), window, False) == h)[0]


def thin(positions: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Of a run of equal hashes closer than a window, as periodic text makes them, one in ``window // 2`` places; what is dropped
    stands less than that after one that is kept."""
    kept: dict[int, int] = {}
    out = []
    for p, x in zip(positions.tolist(), h[positions].tolist()):
        if p - kept.get(x, -window - 1) >= window // 2:
            kept[x] = p
            out.append(p)
    return np.array(out, np.int64)


def seeds_of(text: str | None, k: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the seeds of one text."""
    if not text or len(text) < min_length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    window = min_length - k + 1
    h = kmer_hashes(code_points(text), k)
    at = winnow(h, window)
    if len(at) > 2 * len(h) / window + 32:
        at = thin(at, h, window)
    return h[at].view(np.int64), at


def seed_table(docs: DataFrame, k: int, min_length: int) -> DataFrame:
    """``h``, ``doc_id``, ``at``: the positions of each seed hash in each text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids, sizes, ats = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, at = seeds_of(text, k, min_length)
                order = np.argsort(h, kind="stable")
                unique, counts = np.unique(h[order], return_counts=True)
                hs.append(unique)
                sizes.append(counts)
                ats.append(at[order].astype(np.int32))
                ids.append(np.full(len(unique), doc, np.int64))
            if hs:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ats), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs), pa.int64()), pa.array(np.concatenate(ids), pa.int64()), lists], names=["h", "doc_id", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long, at array<int>")


class Fenwick:
    """Prefix maxima over 1..n."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def raise_to(self, i: int, value: tuple[float, int]) -> None:
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


Match = tuple[int, int, int]  #: start in a, start in b, length


def chains(anchors: list[Match], gap: float = 0.05, most_gap: int = MOST_GAP) -> list[list[Match]]:
    """Disjoint collinear chains of matches, best first.

    A chain's score is the code points its matches add, less ``gap`` for each code point skipped in either text.  With
    the gap cost split between the two texts, a match's best predecessor is a prefix maximum of ``score + gap * ends`` over the
    second text's ranks.  A chain breaks where it skips more than ``most_gap``.  Chains are read off by falling score, each
    back to where one that was read before passes.
    """
    left = sorted(set(anchors))
    ranks = {b: i + 1 for i, b in enumerate(sorted({b for _, b, _ in left}))}
    tree = Fenwick(len(ranks))
    score, back = [0.0] * len(left), [-1] * len(left)
    start = 0
    for i, (a, b, n) in enumerate(left):
        while left[start][0] < a:  # only matches strictly before in the first text are in the tree
            x, y, m = left[start]
            tree.raise_to(ranks[y], (score[start] + gap * (x + y + 2 * m), start))
            start += 1
        score[i] = float(n)
        for j in {tree.upto(ranks[b] - 1)[1], i - 1}:
            if j < 0 or left[j][0] >= a or left[j][1] >= b:
                continue
            x, y, m = left[j]
            gained = min(n, a + n - x - m, b + n - y - m)
            skipped = max(0, a - x - m) + max(0, b - y - m)
            if gained > 0 and skipped <= most_gap and score[j] + gained - gap * skipped > score[i]:
                score[i], back[i] = score[j] + gained - gap * skipped, j
    out, used = [], set()
    for i in sorted(range(len(left)), key=lambda i: (-score[i], i)):
        links = []
        while i >= 0 and i not in used:
            used.add(i)
            links.append(left[i])
            i = back[i]
        if links:
            out.append(links[::-1])
    return out


class Pieces:
    """Parts of one text, in order and apart from each other: ``(place, part)``."""

    def __init__(self, parts: list[tuple[int, str]]):
        self.at = [at for at, _ in parts]
        self.points = [code_points(text) for _, text in parts]
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of every window of n."""
        if n not in self.known:
            found = [kmer_hashes(p, n) for p in self.points]
            places = [np.arange(at, at + len(h)) for at, h in zip(self.at, found)]
            self.known[n] = (np.concatenate(found), np.concatenate(places)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return self.known[n]

    def rest(self, place: int) -> np.ndarray:
        """Code points from a place to the end of its part."""
        i = bisect_left(self.at, place + 1) - 1
        return self.points[i][place - self.at[i] :] if i >= 0 else self.points[0][:0]

    def between(self, start: int, end: int) -> np.ndarray:
        return self.rest(start)[: max(0, end - start)]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common start."""
    most, at, step = min(len(x), len(y)), 0, 256
    while at < most:
        end = min(most, at + step)
        differs = np.nonzero(x[at:end] != y[at:end])[0]
        if len(differs):
            return at + int(differs[0])
        at, step = end, step * 4
    return most


def matches(a: Pieces, b: Pieces, n: int) -> list[Match]:
    """Maximal matches of at least n so that every window of n in ``a`` which ``b`` has too lies in one.  Where ``b`` has
    it more than once, the partner is the next in order after the match before, or else the first."""
    (ha, pa), (hb, pb) = a.hashes(n), b.hashes(n)
    if not len(ha) or not len(hb):
        return []
    order = np.argsort(hb, kind="stable")
    known = hb[order]
    at = np.searchsorted(known, ha)
    hit = np.nonzero(known[np.minimum(at, len(known) - 1)] == ha)[0]
    places, out = pa[hit], []
    t, after = 0, 0
    while t < len(hit):
        i, first = int(places[t]), at[hit[t]]
        js = pb[order[first : np.searchsorted(known, ha[hit[t]], side="right")]]
        k = int(np.searchsorted(js, after))
        for j in chain(js[k : k + 1].tolist(), (int(x) for x in js)):
            size = _common(a.rest(i), b.rest(j))
            if size >= n:  # what equal hashes of different windows would fail
                out.append((i, j, size))
                t, after = int(np.searchsorted(places, i + size - n + 1)), j + size
                break
        else:
            t += 1
    return out


def both_ways(a: Pieces, b: Pieces, n: int) -> tuple[list[Match], list[Match]]:
    """Matches that cover all that ``a`` shares, and those that cover all that ``b`` shares."""
    there = matches(a, b, n)
    if not there:
        return [], []
    (ha, _), (hb, pb) = a.hashes(n), b.hashes(n)
    places = pb[np.isin(hb, ha)]
    ends = sorted((j, j + m) for _, j, m in there)
    at = np.searchsorted(np.array([j for j, _ in ends]), places, side="right") - 1
    if (at >= 0).all() and (np.maximum.accumulate([e for _, e in ends])[at] >= places + n).all():
        return there, there
    return there, [(i, j, m) for j, i, m in matches(b, a, n)]


def lcs(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of integers."""
    if not len(x) or not len(y):
        return 0
    places: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y.tolist():
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def passages(a: Pieces, b: Pieces, k: int, min_length: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """``(start_a, end_a, start_b, end_b, matches, verbatim, matched)`` of the chains that hold a verbatim span: code points in
    spans of ``min_length``, and all that are equal along the aligned chain."""
    there, back = both_ways(a, b, min_length)
    spans = {*there, *back}
    if not spans:
        return []
    inside = np.array(sorted(there))
    small = []
    for i, j, n in matches(a, b, k):
        at = int(np.searchsorted(inside[:, 0], i, side="right")) - 1
        if at < 0 or i + n > inside[at, 0] + inside[at, 2]:
            small.append((i, j, n))
    out = []
    for links in chains([*spans, *small]):
        verbatim, to = 0, -1
        for i, _, n in links:
            if n >= min_length:
                verbatim += i + n - max(i, to)
                to = i + n
        if not verbatim:
            continue
        matched = links[0][2]
        for (x, y, m), (i, j, n) in pairwise(links):
            matched += min(n, i + n - x - m, j + n - y - m)
            matched += lcs(a.between(x + m, i), b.between(y + m, j))
        first, last = links[0], links[-1]
        out.append((first[0], last[0] + last[2], first[1], last[1] + last[2], len(links), verbatim, matched))
    return out


def _regions(at: Column, before: int, after: int, apart: int) -> Column:
    """Neighbourhoods of sorted places, from ``before`` to ``after`` around each, as one where no more than ``apart`` lies between."""
    n = F.size(at)
    starts = F.filter(at, lambda p, i: (i == 0) | (p - F.get(at, i - 1) > apart))
    ends = F.filter(at, lambda p, i: (i == n - 1) | (F.get(at, i + 1) - p > apart))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.greatest(s - before, F.lit(0)).alias("at"), (e + after).alias("to")))


def _parts(text: Column, regions: Column) -> Column:
    return F.transform(regions, lambda r: F.struct(r["at"].alias("at"), F.substring(text, r["at"] + 1, r["to"] - r["at"]).alias("text")))


def _places(at: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(at))))


_MATCHES = "array<struct<a:int,b:int,n:int>>"


def _align(found: DataFrame, docs: DataFrame, min_length: int) -> DataFrame:
    """``found`` has pairs ``a``, ``b``, their regions and two keys; gives those with a chain of verbatim spans, with the spans
    that cover what ``a`` and what ``b`` shares."""
    texts = docs.select("doc_id", "text")
    with_a = found.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "b", "s", "t", _parts(F.col("text"), F.col("regions_a")).alias("parts_a"), "regions_b")
    with_b = with_a.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "s", "t", "parts_a", _parts(F.col("text"), F.col("regions_b")).alias("parts_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, of_a, of_b, counts = [], [], [], []
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                a, b = (Pieces([(r["at"], r["text"]) for r in z]) for z in (x, y))
                there, back = both_ways(a, b, min_length)
                linked = chains([*there, *back])
                if linked:
                    kept.append(i)
                    of_a.append([{"a": p, "b": q, "n": n} for p, q, n in there])
                    of_b.append([{"a": p, "b": q, "n": n} for p, q, n in back])
                    counts.append(len(linked))
            head = batch.select(["a", "b", "s", "t"]).take(pa.array(kept, pa.int32()))
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(counts, pa.int32()), pa.array(of_a, kind), pa.array(of_b, kind)], names=["a", "b", "s", "t", "n_chains", "of_a", "of_b"])

    return with_b.mapInArrow(run, f"a long, b long, s string, t string, n_chains int, of_a {_MATCHES}, of_b {_MATCHES}")


def _hot_windows(docs: DataFrame, hot: DataFrame, min_length: int, k: int) -> DataFrame:
    """Of the seeds in hot groups: ``h`` of every window of ``min_length`` around them and its position."""
    slack = (min_length - k + 1) // 2  # seeds of periodic text are thinned by as much

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, ats in zip(pdf["doc_id"], pdf["text"], pdf["ats"]):
                h = kmer_hashes(code_points(text), min_length).view(np.int64)
                starts = sorted({s for at in ats for s in range(max(0, at - min_length + k), min(at + 1 + slack, len(h)))})
                out.append(pd.DataFrame({"h": h[starts], "doc_id": doc, "at": np.array(starts, np.int32)}))
            yield pd.concat(out) if out else pd.DataFrame({"h": [], "doc_id": [], "at": []})

    spots = hot.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("ats"))
    return spots.join(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, "h long, doc_id long, at int")


def _stretches(windows: DataFrame) -> DataFrame:
    """``doc_id``, ``at``, ``n``: runs of consecutive windows."""
    once = windows.select("doc_id", "at").distinct()
    run = F.col("at") - F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return once.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n")).drop("run")


def _holders(windows: DataFrame, docs: DataFrame, min_length: int) -> DataFrame:
    """``key``, ``doc_id``, ``at``: which texts hold a window, by its own text, for one window of each set of holders.

    Neighbouring windows mostly have the same holders, so the sets are told apart by two digests that don't depend on
    order, and one window stands for all that the same texts hold."""
    once = windows.groupBy("h", "doc_id").agg(F.min("at").alias("at"))
    digest = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "doc_id"))
    sets = once.groupBy("h").agg(F.count("*").alias("n"), digest(1).alias("x"), digest(2).alias("y")).groupBy("n", "x", "y").agg(F.min("h").alias("h"))
    held = once.join(sets.select("h"), "h").join(docs.select("doc_id", "text"), "doc_id")
    return held.select(F.md5(F.substring("text", F.col("at") + 1, F.lit(min_length)).cast("binary")).alias("key"), "doc_id", "at").distinct()


def _by_class(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``rep``: the lowest id of those with the same text, for texts that others repeat."""
    keyed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    many = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(many.select("key", "rep"), "key").select("doc_id", "rep")


class SharedSpans:
    """The stages of the operator, each a DataFrame; the tables that several of them read are materialised."""

    def __init__(self, docs: DataFrame, min_length: int = MIN_LENGTH, k: int = K, hot: int = HOT):
        if not 8 <= k < min_length:
            raise ValueError("k must be from 8 to below min_length")
        docs = docs.select("doc_id", "text").where(f"doc_id is not null and length(text) >= {int(min_length)}")
        self.min_length, self.k, self.hot, self.docs = min_length, k, hot, docs
        self.reach = min_length - k, min_length + (min_length - k + 1) // 2
        self.classes = cut(_by_class(docs))
        copies = self.classes.where("doc_id <> rep").select("doc_id")
        # copies leave before anything is joined; a text is read again rather than shuffled
        seeds = cut(seed_table(docs, k, min_length)).join(copies, "doc_id", "left_anti")
        shared = seeds.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        self.matched = cut(seeds.join(shared.select("h", "n"), "h"))

    def _texts(self, needed: DataFrame) -> DataFrame:
        """The documents in ``needed``, whose ids are broadcast while they are few."""
        return self.docs.join(broadcast_if_bounded(needed, MAX_BROADCAST_IDS), "doc_id", "left_semi")

    @cached_property
    def windows(self) -> DataFrame:
        """``h``, ``doc_id``, ``at`` of the windows around hot seeds that another text has too."""
        busy = self.matched.where(F.col("n") > self.hot)
        found = cut(_hot_windows(self._texts(busy.select("doc_id").distinct()), busy, self.min_length, self.k))
        shared = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        return cut(found.join(shared.select("h"), "h"))

    @cached_property
    def holders(self) -> DataFrame:
        """``key``, ``doc_id``, ``at``: the texts that hold each of the windows that stand for all hot ones."""
        return cut(_holders(self.windows, self._texts(self.windows.select("doc_id").distinct()), self.min_length))

    def _seed_pairs(self) -> DataFrame:
        """Pairs of texts that share a seed which is not hot, with the regions around their seeds."""
        calm = self.matched.where(F.col("n") <= self.hot)
        left = calm.select("h", F.col("doc_id").alias("a"), F.col("at").alias("at_a"))
        right = calm.select("h", F.col("doc_id").alias("b"), F.col("at").alias("at_b"))
        met = left.join(right, "h").where("a < b").groupBy("a", "b").agg(_places("at_a").alias("at_a"), _places("at_b").alias("at_b"))
        region = lambda who: _regions(F.col(f"at_{who}"), *self.reach, sum(self.reach)).alias(f"regions_{who}")
        return met.select("a", "b", F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("t"), region("a"), region("b"))

    def _window_pairs(self) -> DataFrame:
        """For each hot window two texts that hold it."""
        spot = F.struct("doc_id", "at")
        kinds = self.holders.groupBy("key").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x.doc_id < y.doc_id")
        region = lambda who: F.array(F.struct(F.col(f"{who}.at").alias("at"), (F.col(f"{who}.at") + self.min_length).alias("to")))
        return kinds.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("key").alias("s"), F.col("key").alias("t"), region("x").alias("regions_a"), region("y").alias("regions_b"))

    @cached_property
    def aligned(self) -> DataFrame:
        """Chained and aligned pairs: of texts (``s`` null), and two of the texts that hold a hot window for all of them."""
        pairs = cut(self._seed_pairs().union(self._window_pairs()))
        # only texts in a pair are read again
        needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        return cut(_align(pairs, self._texts(needed), self.min_length))

    @cached_property
    def representative_pairs(self) -> DataFrame:
        """``a`` < ``b``: pairs between lowest ids of copies; together with ``classes`` the form for scale."""
        side = lambda who: self.holders.select(F.col("key").alias("s"), F.col("doc_id").alias(who)).distinct()
        wide = self.aligned.where("s is not null").select("s").join(side("x"), "s").join(side("y"), "s").where("x < y")
        both = wide.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return cut(self.aligned.where("s is null").select("a", "b").union(both).distinct())

    @cached_property
    def passages(self) -> DataFrame:
        """One row for each chain with a verbatim span of every pair in ``representative_pairs``: its ends in both texts, the number
        of matches, code points in verbatim spans, equal code points and their share."""
        placed = self.matched.groupBy("doc_id").agg(_places("at").alias("at"))
        spots = placed.select("doc_id", _regions(F.col("at"), *self.reach, sum(self.reach) + MOST_GAP).alias("regions"))
        pairs = self.representative_pairs
        texts = self._texts(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        parts = cut(spots.join(texts, "doc_id").select("doc_id", _parts(F.col("text"), F.col("regions")).alias("parts")))
        side = lambda who: parts.select(F.col("doc_id").alias(who), F.col("parts").alias(f"parts_{who}"))
        k, min_length = self.k, self.min_length
        names = ("start_a", "end_a", "start_b", "end_b", "n_matches", "verbatim", "matched")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "parts_a", "parts_b"))):
                    rows += [(a, b, *p) for p in passages(*(Pieces([(r["at"], r["text"]) for r in z]) for z in (x, y)), k, min_length)]
                columns = list(zip(*rows)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 7)], names=["a", "b", *names])

        found = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, " + ", ".join(f"{n} int" for n in names))
        return found.withColumn("share", F.col("matched") / F.greatest(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b")))

    def pairs(self) -> DataFrame:
        """Every pair of documents with a common span, copies included: ``doc_id_a`` < ``doc_id_b``."""
        members = self.classes
        a = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("m_a"))
        b = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("m_b"))
        crossed = self.representative_pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("m_a", "a").alias("x"), F.coalesce("m_b", "b").alias("y"))
        within = members.select("rep", F.col("doc_id").alias("x")).join(members.select("rep", F.col("doc_id").alias("y")), "rep").where("x < y").select("x", "y")
        both = crossed.union(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        return both.where("doc_id_a < doc_id_b")

    def shares(self) -> DataFrame:
        """Of each document with shared text: ``n_chars``, ``shared_chars``, ``share``.  One row for each, copies too."""
        texts = self.aligned.where("s is null")
        side = lambda who: texts.select(F.col(who).alias("doc_id"), F.explode(f"of_{who}").alias("x")).select("doc_id", F.col(f"x.{who}").alias("start"), (F.col(f"x.{who}") + F.col("x.n")).alias("end"))
        hot = _stretches(self.windows).select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("n") + self.min_length - 1).cast("int").alias("end"))
        found = side("a").union(side("b")).union(hot)
        merged = found.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("all"))
        covered = F.aggregate("all", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(x["to"], s["start"]))).alias("n"), F.greatest(x["to"], s["end"]).alias("to")))
        some = merged.select("doc_id", covered["n"].alias("shared_chars"))
        sized = self.docs.select("doc_id", F.length("text").alias("n_chars"))
        repeated = self.classes.select("doc_id", F.lit(True).alias("whole"))
        joined = sized.join(some, "doc_id", "left").join(repeated, "doc_id", "left").where("whole or shared_chars is not null")
        n = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.col("shared_chars"))
        return joined.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), n.cast("long").alias("shared_chars"), (n / F.col("n_chars")).alias("share"))
