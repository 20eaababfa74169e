"""strftime formats: which fields they have, as patterns over texts, and as Spark expressions."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that name a year or a zone (fixed values); a format without one gets the default year or the session's zone.
YEAR_CODES = ("%y", "%Y", "%G", "%g", "%D", "%x", "%f", "%v", "%c", "%+", "%s")
ZONE_CODES = ("%Z", "%z", "%:z", "%#z", "%+", "%s")

#: strftime code to (pattern over texts, Java pattern); None where Spark has to be helped.
_CODES = {
    "%Y": (r"(?P<Y>\d{1,4})", "yyyy"), "%y": (r"(?P<y>\d{1,2})", "yy"), "%m": (r"(?P<m>\d{1,2})", "M"), "%d": (r"(?P<d>\d{1,2})", "d"), "%e": (r"(?P<d>\d{1,2})", "d"),
    "%H": (r"(?P<H>\d{1,2})", "H"), "%k": (r"(?P<H>\d{1,2})", "H"), "%I": (r"(?P<I>\d{1,2})", "h"), "%l": (r"(?P<I>\d{1,2})", "h"), "%M": (r"(?P<M>\d{1,2})", "m"), "%S": (r"(?P<S>\d{1,2})", "s"),
    "%b": (r"(?P<b>[A-Za-z]{3})", "MMM"), "%h": (r"(?P<b>[A-Za-z]{3})", "MMM"), "%B": (r"(?P<B>[A-Za-z]{3,9})", "MMMM"), "%a": (r"(?P<a>[A-Za-z]{3})", "E"), "%p": (r"(?P<p>[AaPp][Mm])", "a"),
    "%z": (r"(?P<z>[+-]\d\d:?\d\d)", "xx"), "%:z": (r"(?P<z>[+-]\d\d:?\d\d)", "xxx"), "%Z": (r"(?P<Z>[A-Za-z]+)", "z"), "%s": (r"(?P<s>\d+)", None), "%%": ("%", "%"),
}
_EXPANDED = {"%T": "%H:%M:%S", "%F": "%Y-%m-%d", "%D": "%m/%d/%y", "%R": "%H:%M"}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def needs_year(fmt: str) -> bool:
    return not any(c in fmt for c in YEAR_CODES)


def needs_zone(fmt: str) -> bool:
    return not any(c in fmt for c in ZONE_CODES)


def pieces(fmt: str) -> list[tuple[str, str]]:
    """(kind, text) of a format: kind is a code such as ``%H``, ``frac`` with its digits, ``space`` or ``text``."""
    for short, long in _EXPANDED.items():
        fmt = fmt.replace(short, long)
    out = []
    for m in re.finditer(r"%(\.?)([369]?)f|%:z|%[A-Za-z%+]|\s+|[^%\s]+|%", fmt):
        if m[0].startswith("%") and m[0].endswith("f"):
            out.append(("frac", m[1] + (m[2] or "*")))
        elif m[0] in _CODES:
            out.append((m[0], m[0]))
        elif m[0].startswith("%"):
            raise ValueError(f"unsupported time format code {m[0]!r} in {fmt!r}")
        else:
            out.append(("space" if m[0].isspace() else "text", m[0]))
    return out


def text_pattern(fmt: str) -> str:
    """Pattern, with named groups, of the texts that fit a format; numbers may be padded by spaces, as %e is."""
    out = []
    for kind, text in pieces(fmt):
        if kind == "frac":
            out.append((r"\." if text[0] == "." else "") + (r"(?P<f>\d+)" if text[-1] == "*" else rf"(?P<f>\d{{{text[-1]}}})"))
        elif kind == "space":
            out.append(r"\s*")
        elif kind == "text":
            out.append(re.escape(text))
        else:
            pattern = _CODES[kind][0]
            out.append(rf"\s*{pattern}" if r"\d{1," in pattern else pattern)
    return "^" + "".join(out) + "$"


def matches(fmt: str, text: str) -> bool:
    """Whether a text fits a format and its day exists (29 February does where there is no year)."""
    m = re.match(text_pattern(fmt), text)
    return bool(m) and text[-1:] != "\n" and fields_valid(m.groupdict())


def fields_valid(g: dict[str, str | None]) -> bool:
    number = {k: int(g[k]) for k in "YymdHIMS" if g.get(k)}
    month = number.get("m")
    if name := (g.get("b") or g.get("B")):
        month = _MONTHS.index(name[:3].lower()) + 1 if name[:3].lower() in _MONTHS else 0
    if month is not None and not 1 <= month <= 12:
        return False
    if (day := number.get("d")) is not None:
        year = number.get("Y", 2000 + number["y"] if "y" in number else 2000)
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        if not 1 <= day <= ((29 if leap else 28) if month == 2 else 30 if month in (4, 6, 9, 11) else 31):
            return False
    zone = g.get("z")
    return number.get("H", 0) <= 23 and 1 <= number.get("I", 1) <= 12 and number.get("M", 0) <= 59 and number.get("S", 0) <= 60 and (not zone or int(zone[-2:]) <= 59)


def java_pattern(fmt: str) -> str:
    out = []
    for kind, text in pieces(fmt):
        if kind == "frac":
            out.append(("." if text[0] == "." else "") + "S" * (9 if text[-1] == "*" else int(text[-1])))
        elif kind in ("space", "text"):
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", " " if kind == "space" else text).replace("[", "'['").replace("]", "']'"))
        else:
            out.append(_CODES[kind][1] or "")
    return "".join(out)


def parse_time(text: Column, fmt: str, default_year: int | None = None) -> Column:
    """Instant of a text in a format, null where it doesn't fit.

    Runs of spaces count as one, as padded days need; a missing year is ``default_year`` (the current UTC year by
    default); a missing zone is the session's.
    """
    if fmt == "%s":
        return F.when(text.rlike(r"^\d+$"), F.timestamp_seconds(text.try_cast("long")))
    pattern, value = java_pattern(fmt), F.regexp_replace(text, r"\s+", " ")
    if needs_year(fmt):
        year = default_year or datetime.now(timezone.utc).year
        pattern, value = pattern + " yyyy", F.concat(value, F.lit(f" {year}"))
    if "%p" in fmt:
        value = F.upper(value)
    return F.when(text.rlike(re.sub(r"\(\?P<\w+>", "(", text_pattern(fmt))), F.try_to_timestamp(value, F.lit(pattern)))
