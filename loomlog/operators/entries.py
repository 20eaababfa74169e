"""Problem 2: log lines of differing layouts, with entries over several lines, into fields.

Lines are range-partitioned by file and number, so that a large file may span many tasks; only raw lines are sampled and
shuffled.  Each task parses its lines in order by a weighted context-free grammar (:mod:`loomlog.functions.loglines`), whose
highest-scoring parse tells whether a line is a header, what the header states, or whether it goes on an entry.  A state machine
assembles entries: a header and the lines up to the next one.  An entry may go on in the next range, and a range may begin
inside one; these borders (at most two rows a range) are stitched afterwards.

Defined cases: null and blank lines neither begin nor end an entry, those between its lines stay in its message; a repeated
(file, line) counts once, with its lowest id; lines before a file's first header belong to no entry; lines without file or number
are left out; a header that states no level or component has ``none``.  A line that no rule describes goes on the entry
before it and is among its ``unparsed`` spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.loglines import LineParser
from ..session import cut

_PARSER: list[LineParser] = []

_SPANS = "array<struct<line_no:int,start:int,end:int>>"
ENTRY = f"file_id long, first_line_no int, last_line_no int, level string, component string, time string, received_us long, message string, unparsed {_SPANS}, score double, part int, place int, blank_before int, blank_after int"
_ENTRY_ARROW = pa.schema(
    [("file_id", pa.int64()), ("first_line_no", pa.int32()), ("last_line_no", pa.int32()), ("level", pa.string()), ("component", pa.string()), ("time", pa.string()), ("received_us", pa.int64()), ("message", pa.string()),
     ("unparsed", pa.list_(pa.struct([("line_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))), ("score", pa.float64()), ("part", pa.int32()), ("place", pa.int32()), ("blank_before", pa.int32()), ("blank_after", pa.int32())]
)


def parser() -> LineParser:
    """The worker's parser, whose sets are kept from batch to batch."""
    if not _PARSER:
        _PARSER.append(LineParser())
    return _PARSER[0]


def _assemble(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Entries of one sorted range.  ``place``: bit 0 for lines at the range's start that may belong to an entry before,
    bit 1 for what is open at its end.  Blank lines at its ends are counted in ``blank_before`` and ``blank_after``."""
    read = parser().read
    entry: dict | None = None
    first, file, last_no, blank = True, None, None, 0
    done: list[dict] = []

    def opened(r: dict, **more) -> dict:
        return {"file_id": r["file_id"], "first_line_no": r["line_no"], "last_line_no": r["line_no"], "level": None, "component": None, "time": None, "received_us": None, "score": None, "blank_before": 0, "lines": [], "unparsed": []} | more

    def finish(last: bool) -> None:
        nonlocal entry
        if entry is not None:
            lines = entry.pop("lines")
            known = entry["level"] is not None
            done.append(entry | {"message": "\n".join(lines) if lines else None, "part": part, "place": (0 if known else 1) + (2 if last else 0), "blank_after": blank})
        entry = None

    for batch in batches:
        for r in batch.to_pylist():
            if r["file_id"] == file and r["line_no"] == last_no:
                continue
            if r["file_id"] != file and file is not None:
                finish(False)
                first, blank = False, 0
            file, last_no, raw = r["file_id"], r["line_no"], r["raw"]
            if entry is None and first:
                entry = opened(r)  # lines that may go on an entry of the range before
            if raw is None or not raw.strip():
                blank += 1
                continue
            header, (start, end) = read(raw)
            if header is not None:
                finish(False)
                first = False
                entry = opened(r, level=header.level, component=header.component, time=header.time, received_us=r["received_us"], score=header.score, lines=[header.text])
            elif entry is not None:
                if entry["lines"] or entry["level"] is not None:
                    entry["lines"] += [""] * blank
                else:
                    entry |= {"first_line_no": r["line_no"], "blank_before": blank}
                entry["lines"].append(raw)
                entry["last_line_no"] = r["line_no"]
            if end > start and entry is not None:
                entry["unparsed"].append({"line_no": r["line_no"], "start": start, "end": end})
            blank = 0
        if len(done) > 1000:
            yield pa.RecordBatch.from_pylist(done, schema=_ENTRY_ARROW)
            done = []
    finish(True)
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_ENTRY_ARROW)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins what lies at range borders: rows with a place, in order of ranges."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], r["place"] != 3, r["place"]))
    out: list[dict] = []
    held: list[list[str]] = []  # messages in pieces
    for r in rows:
        if not r["place"] & 1:
            out.append(r | {"open": True})
            held.append([r["message"]])
        elif out and out[-1]["file_id"] == r["file_id"] and out[-1]["open"]:
            whole = out[-1]
            if r["message"] is not None:
                held[-1] += [""] * (whole["blank_after"] + r["blank_before"]) + [r["message"]]
                whole |= {"last_line_no": r["last_line_no"], "unparsed": whole["unparsed"] + r["unparsed"], "blank_after": r["blank_after"]}
            else:
                whole["blank_after"] += r["blank_after"]
            whole["open"] = bool(r["place"] & 2)
    if out:
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in _ENTRY_ARROW.names} | {"message": "\n".join(m)} for r, m in zip(out, held)], schema=_ENTRY_ARROW)


def read_entries(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` has ``raw_id``, ``file_id``, ``line_no``, ``received_at`` and ``raw``.  One row for each entry: file, first and last
    line, level, component, time as written, arrival of its header in micros, message with its further lines, spans that no rule
    covers (``line_no``, ``start``, ``end`` in code points) and the score of the header's parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _assemble(batches, TaskContext.get().partitionId())

    lines = df.where("file_id is not null and line_no is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), F.col("raw_id").cast("long").alias("raw_id"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"), F.col("raw").cast("string").alias("raw"))
    ranged = lines.repartitionByRange(*([partitions] if partitions else []), "file_id", "line_no").sortWithinPartitions("file_id", "line_no", "raw_id")
    made = cut(ranged.mapInArrow(run, ENTRY))
    joined = made.where("place <> 0").coalesce(1).mapInArrow(_stitch, ENTRY)
    return made.where("place = 0").union(joined).drop("part", "place", "blank_before", "blank_after")
