"""Problem 7: text decoded with a wrong character encoding.

Garbled sequences are computed beforehand for all encoding pairs and matched by one Aho-Corasick automaton:

* UTF-8 bytes read as a single-byte or a double-byte encoding: every pair of a lead and a continuation byte, as each encoding
  shows it.  The run of characters around a match is garbled if it decodes as UTF-8 in full to plausible characters (once
  or several times over); where the run looks like a word as it stands, only to a regular word of enough letters.
* U+FFFD, which stands where the original is lost.

Text of a legacy encoding read as another one, and short runs of the former kind, are found by words: what each run may have been
before any pair garbled it is joined with all runs of the corpus, and a run is garbled if its plain form is at least ``RATIO``
times as frequent.  In a row with a proven pair the other runs are undone too if all of them decode plausibly by it.

Only matched runs are replaced.  Counts are of all runs in all rows, and evidence is a ratio of two counts, so other rows don't
change a verdict.  Nothing that grows with the corpus is broadcast but for tables whose size was checked.

Defined cases: null, empty and ASCII texts are no case and come out as they are; a row counts once however much of
it is garbled; a text with U+FFFD is a case without a restored form.  A word seen less than ``RATIO`` times as often as
its garbled form is no evidence by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, cut

# Encodings by their Python names: those text was wrongly read as, and those it was written in.
READ_AS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1253", "koi8-r", "cp866", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "cp1255", "cp1256", "cp852", "cp874", "mac_cyrillic")
#: Readings whose letters are valid pairs of UTF-8 bytes among themselves, so that regular words need more evidence.
GUARDED = frozenset(("iso8859-2", "iso8859-5", "iso8859-7", "cp1255", "cp1256", "cp852", "cp874", "mac_cyrillic"))
READ_DOUBLE = ("gbk", "big5", "shift_jis", "cp949")
WRITTEN_IN = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp874", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "iso8859-7", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "gbk", "gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")

#: A run seen so often stays as it is, unless what a pair makes of it stands in the corpus.
LEAST_COUNT = 8
RATIO = 4
#: Runs of letters and other characters beyond ASCII with at least one of the latter.
RUN = r"[A-Za-z]*[^\x00-\x7F][A-Za-z[^\x00-\x7F]]*"


def _tables() -> dict[str, tuple[dict[str, int], list[str]]]:
    """Of each encoding in READ_AS: character to byte and byte to character; undefined bytes show as C1 controls."""
    out = {}
    for name in READ_AS:
        chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
        out[name] = {c: b for b, c in enumerate(chars)}, chars
    return out


TABLES = _tables()


def to_bytes(text: str, read_as: str) -> bytes | None:
    if read_as in READ_DOUBLE:
        try:
            return text.encode(read_as)
        except UnicodeEncodeError:
            return None
    table = TABLES[read_as][0]
    try:
        return bytes([ord(c) if c < "\x80" else table[c] for c in text])
    except KeyError:
        return None


def misread(data: bytes, read_as: str) -> str:
    if read_as in READ_DOUBLE:
        return data.decode(read_as, "replace")
    chars = TABLES[read_as][1]
    return "".join(chars[b] for b in data)


def _plausible(c: str) -> bool:
    """Whether a decoded character is one that texts in use hold: letters of the scripts with legacy encodings, CJK, and
    symbols; not controls, rare letters or unassigned places."""
    n = ord(c)
    if n < 0x80:
        return True
    if n < 0xA0 or n == 0xAD:
        return False
    if n < 0x100:
        return True
    if n < 0x180:
        return any(_encodes(c, e) for e in ("cp1250", "cp1252", "cp1254", "cp1257"))
    if n < 0x370:
        return n in (0x192, 0x2C6, 0x2DC) or 0x2C7 <= n <= 0x2DD or 0x218 <= n <= 0x21B
    if n < 0x400:
        return _encodes(c, "cp1253")
    if n < 0x530:
        return n <= 0x491
    if 0x2070 <= n < 0x20A0 or 0x20C0 <= n < 0x2600 or 0x27C0 <= n < 0x2E00:
        return any(_encodes(c, e) for e in ("cp1252", "cp1251", "cp437", "mac_roman", "koi8-r", "gbk", "shift_jis", "euc_kr"))
    if 0x2000 <= n < 0x2070 or 0x20A0 <= n < 0x20C0 or 0x2600 <= n < 0x27C0 or 0x3000 <= n < 0xA000 or 0xAC00 <= n < 0xD7A4 or 0xFE00 <= n < 0xFE10 or 0xFF00 <= n < 0xFFF0 or 0x1F000 <= n < 0x1FB00:
        return True
    return 0x5D0 <= n < 0x5EB or 0x600 <= n < 0x700 or 0xE01 <= n < 0xE4E or n == 0xFEFF


def _encodes(c: str, encoding: str) -> bool:
    try:
        c.encode(encoding)
    except UnicodeEncodeError:
        return False
    return True


def undo_utf8(run: str, cut_short: bool = False) -> tuple[str, str] | None:
    """(restored, encoding) of a run that is UTF-8 read as something else, undone as often as that goes.

    ``cut_short``: the run ends the text, so its last character may be incomplete and is then dropped."""
    best = None
    word = None
    for name in READ_AS + READ_DOUBLE:
        data = to_bytes(run, name)
        if data is None:
            continue
        try:
            plain = data.decode("utf-8")
        except UnicodeDecodeError as e:
            if not (cut_short and e.reason == "unexpected end of data" and e.start > 0):
                continue
            plain = data[: e.start].decode("utf-8")
        if plain == run or plain.isascii():
            continue
        found = undo_utf8(plain, cut_short) or (plain, name)
        if not all(map(_plausible, found[0])):
            continue
        if name in GUARDED:
            word = _regular(run) if word is None else word
        if (name in READ_DOUBLE or name in GUARDED and word or any("\u0590" <= c < "\u0e50" for c in found[0])) and not _telling(found[0]):
            continue
        if best is None or len(found[0]) < len(best[0]):
            best = found
    return best


def _regular(run: str) -> bool:
    """Whether a run is all letters (and marks), of one script, with the case of a word."""
    return all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in run) and _wordlike(run) and (run.islower() or run.isupper() or run[1:] == run[1:].lower())


def _telling(plain: str) -> bool:
    """Whether a decoded text is a regular word of enough letters beyond ASCII for that to be no chance."""
    letters = [c for c in plain if c > "\x7f" and c.isalpha()]
    core = plain.strip("".join(c for c in plain if not c.isalpha()))
    return len(letters) >= (2 if any(c >= "\u3040" for c in letters) else 3) and bool(core) and _regular(core)


def origins(run: str) -> dict[str, str]:
    """What a run may have been before a pair garbled it, to ``written>read``."""
    out: dict[str, str] = {}
    for name in READ_DOUBLE:
        data = to_bytes(run, name)
        if data is not None:
            try:
                out.setdefault(data.decode("utf-8"), f"utf-8>{name}")
            except UnicodeDecodeError:
                pass
    for name in READ_AS:
        data = to_bytes(run, name)
        if data is None:
            continue
        for written in WRITTEN_IN:
            try:
                out.setdefault(data.decode(written), f"{written}>{name}")
            except UnicodeDecodeError:
                pass
    out.pop(run, None)
    return {x: p for x, p in out.items() if not x.isascii()}


def _wordlike(run: str) -> bool:
    """Whether a run holds plausible characters only, its letters are of one script and no symbol stands between letters."""
    if not all(map(_plausible, run)):
        return False
    letters = [c.isalpha() or unicodedata.category(c)[0] == "M" for c in run]
    if any(not x and any(letters[:i]) and any(letters[i:]) for i, x in enumerate(letters)):
        return False
    scripts = {unicodedata.name(c, "").split(" ")[0] for c, x in zip(run, letters) if x and c.isalpha()} - {"FEMININE", "MASCULINE", "MICRO"}
    return len(scripts) <= 1 or scripts <= {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "FULLWIDTH", "HANGUL"}


def all_run_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``run``, ``n`` of all runs beyond ASCII in the corpus."""
    some = texts.where(F.octet_length(text) != F.length(text))
    runs = some.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    return cut(runs.groupBy("run").agg(F.count("*").alias("n")))


def proven_runs(counts: DataFrame) -> DataFrame:
    """``run``, ``plain``, ``pair``: garbled runs by a join of what each run may have been with all runs.  The most frequent such word
    counts, and none that is garbled itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(g, n, w, p, _wordlike(w)) for g, n in zip(pdf["run"], pdf["n"]) if len(g) > 1 and not undo_utf8(g) for w, p in origins(g).items() if all(map(_plausible, w))]
            yield pd.DataFrame(rows, columns=["run", "n", "plain", "pair", "word"])

    asked = counts.where(~F.col("run").contains("\ufffd"))
    known = counts.select(F.col("run").alias("plain"), F.col("n").alias("n_plain"))
    found = cut(asked.mapInPandas(run, "run string, n long, plain string, pair string, word boolean").join(known, "plain").where((F.col("n_plain") >= F.col("n") * RATIO) & (F.col("word") | (F.col("n_plain") >= LEAST_COUNT))))
    garbled = found.select(F.col("run").alias("plain")).distinct()
    best = found.join(garbled, "plain", "left_anti").groupBy("run").agg(F.max(F.struct("n_plain", "plain", "pair")).alias("x"))
    clean = F.udf(lambda w: undo_utf8(w) is None, "boolean")
    return cut(best.select("run", "x.plain", "x.pair").where(clean("plain")))


def undone(run: str, pair: str) -> str | None:
    """What a run was before ``written>read`` garbled it; None where it can't have been anything."""
    written, read = pair.split(">")
    data = to_bytes(run, read)
    try:
        return data.decode(written) if data is not None else None
    except UnicodeDecodeError:
        return None


def row_evidence(some: DataFrame, counts: DataFrame, proven: DataFrame) -> DataFrame:
    """``text``, ``proven`` (its proven runs) and ``others`` (what each pair of the text makes of its other runs, with the counts of
    both) of the texts with a proven run."""
    runs = some.select("text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))).alias("run"))
    held = cut(runs.join(broadcast_if_bounded(proven), "run").distinct())
    texts = held.groupBy("text").agg(F.collect_list(F.struct("run", "plain", "pair")).alias("proven"), F.collect_set("pair").alias("pairs"))
    texts = cut(texts.withColumn("pairs", F.sort_array(F.filter("pairs", lambda p: ~F.startswith(p, F.lit("utf-8"))))))
    asked = texts.select("text", "pairs", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))).alias("run")).join(held.select("text", "run"), ["text", "run"], "left_anti")
    asked = cut(asked.select("text", "run", F.explode("pairs").alias("pair")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(plain=[undone(r, p) for r, p in zip(pdf["run"], pdf["pair"])])

    made = asked.select("run", "pair").distinct().mapInPandas(run, "run string, pair string, plain string")
    counted = made.join(counts.select("run", "n"), "run", "left").join(counts.select(F.col("run").alias("plain"), F.col("n").alias("n_plain")), "plain", "left").na.fill(0, ["n", "n_plain"])
    others = asked.join(counted, ["run", "pair"]).groupBy("text").agg(F.collect_list(F.struct("run", "pair", "plain", "n", "n_plain")).alias("others"))
    return texts.select("text", "proven").join(others, "text", "left")


class Patterns:
    """The automaton over garbled sequences, and decisions on runs; one for each Python worker."""

    def __init__(self):
        import re

        import ahocorasick

        self.runs = re.compile(r"[A-Za-z]*[^\x00-\x7f](?:[A-Za-z]|[^\x00-\x7f])*")
        self.automaton = ahocorasick.Automaton()
        for name in READ_AS + READ_DOUBLE:
            for lead in range(0xC2, 0xF5):
                for follow in range(0x80, 0xC0):
                    seen = misread(bytes([lead, follow]), name)
                    if "\ufffd" not in seen:
                        self.automaton.add_word(_quads(seen), len(seen))
        self.automaton.make_automaton()
        self.known: dict[tuple[str, bool], tuple[str, str] | None] = {}

    def _judge(self, run: str, at_end: bool) -> tuple[str, str] | None:
        key = run, at_end
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            found = undo_utf8(run)
            if found is None and at_end:
                found = undo_utf8(run, True)
            self.known[key] = found and (found[0], f"utf-8>{found[1]}")
        return self.known[key]

    def _same_pair(self, text: str, spans: list[tuple[int, int, str]], found: list[str], others: dict[tuple[str, str], tuple[str | None, int, int]]) -> list[tuple[int, int, str]]:
        """Runs outside the spans, too short or too rare to judge alone, that a legacy pair found in the text turns into
        words, or, where that gives plausible text throughout, into others."""
        pairs = [p for p in dict.fromkeys(found) if not p.startswith("utf-8")]
        left = [m for m in self.runs.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in spans)] if pairs else []
        out, rest = [], []
        for m in left:
            plains = [others.get((m[0], p), (None, 0, 0)) for p in pairs]
            known = next((x for x, n, more in plains if x is not None and x != m[0] and more and more >= RATIO * n and (more >= LEAST_COUNT or _wordlike(x))), None)
            if known is None:
                rest.append((m, plains))
            else:
                out.append((m.start(), m.end(), known))
        for i in range(len(pairs)):
            if all(x[i][0] is not None and (x[i][0] == m[0] or _wordlike(x[i][0]) and (x[i][1] < LEAST_COUNT or x[i][2])) for m, x in rest):
                return out + [(m.start(), m.end(), x[i][0]) for m, x in rest if x[i][0] != m[0]]
        return out

    def look(self, text: str, proven: dict[str, tuple[str, str]] | None = None, others: dict[tuple[str, str], tuple[str | None, int, int]] | None = None) -> tuple[str | None, list[str]]:
        """(text with garbled runs restored, or None where something is lost; what was found).  ``proven``: garbled runs of the
        text to (word, pair); ``others``: other runs and pairs to (what the pair makes of it, counts of both)."""
        if text.isascii():
            return text, []
        found, spans = [], []
        done = 0
        n = len(text)
        for m in self.runs.finditer(text) if proven else ():
            if m[0] in proven:
                plain, pair = proven[m[0]]
                spans.append((m.start(), m.end(), plain))
                found.append(pair)
        held = list(spans)
        for end, size in self.automaton.iter(_quads(text)):
            end, off = divmod(end + 1, 4)
            if off or end <= done or any(s < end and end - size < e for s, e, _ in held):
                continue
            start, stop = end - size, end
            while start > done and _joins(text[start - 1]):
                start -= 1
            while stop < n and _joins(text[stop]):
                stop += 1
            undone = self._judge(text[start:stop], stop == n)
            if undone:
                spans.append((start, stop, undone[0]))
                found.append(undone[1])
            done = stop  # a run is judged once, however many sequences it holds
        spans += self._same_pair(text, spans, found, others or {})
        lost = "\ufffd" in text
        if lost:
            found.append("lost")
        if not found:
            return text, []
        out, at = [], 0
        spans.sort()
        for start, end, plain in spans:
            out += [text[at:start], plain]
            at = end
        return None if lost else "".join(out) + text[at:], sorted(set(found))


def _quads(text: str) -> str:
    """Four symbols below 256 for each character, as an automaton looks through the branches of a node one by one."""
    return text.encode("utf-32-be", "surrogatepass").decode("latin-1")


def _joins(c: str) -> bool:
    return c > "\x7f" or "a" <= c <= "z" or "A" <= c <= "Z"


_PATTERNS: list[Patterns] = []


def find_garbled(df: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``df`` has ``tbl``, ``row_id`` and ``text``; gives ``tbl``, ``row_id``, ``text``, ``restored``, ``pairs`` of the
    garbled rows.  ``corpus``: the texts words are counted in, by default the same."""
    every = all_run_counts(df if corpus is None else corpus)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _PATTERNS:
            _PATTERNS.append(Patterns())
        look = _PATTERNS[0].look
        for pdf in batches:
            rows = []
            for tbl, row_id, text, proven, others in zip(pdf["tbl"], pdf["row_id"], pdf["text"], pdf["proven"], pdf["others"]):
                restored, pairs = look(
                    text,
                    None if proven is None else {x["run"]: (x["plain"], x["pair"]) for x in proven},
                    None if others is None else {(x["run"], x["pair"]): (x["plain"], x["n"], x["n_plain"]) for x in others},
                )
                if pairs:
                    rows.append((tbl, row_id, text, restored, ", ".join(pairs)))
            yield pd.DataFrame(rows, columns=["tbl", "row_id", "text", "restored", "pairs"])

    some = df.where(F.octet_length("text") != F.length("text")).select("tbl", F.col("row_id").cast("long").alias("row_id"), "text")
    evidence = row_evidence(some, every, proven_runs(every))
    rows = some.join(broadcast_if_bounded(cut(evidence)), "text", "left")
    return rows.select("tbl", "row_id", "text", "proven", "others").mapInPandas(run, "tbl string, row_id long, text string, restored string, pairs string")
