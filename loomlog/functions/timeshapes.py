"""Timestamps in mixed forms: shape masks, parsers by mask, and zone transition tables.

A text's mask has ``9`` for each digit and ``a`` for each letter; everything else stands for itself, so all texts of one
mask have their fields at the same places.  Each mask is mapped to a parser once; the texts are then converted together
by arithmetic on their characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np

MICROS = 1_000_000
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: Zone abbreviations and their minutes from UTC (fixed values).
ABBREVIATIONS = {"utc": 0, "gmt": 0, "z": 0, "cet": 60, "cest": 120, "est": -300, "edt": -240, "ist": 330, "aest": 600, "aedt": 660}

#: strftime code to the mask of its field.
_CODES = {
    "Y": r"(?P<Y>9999)", "y": r"(?P<y>99)", "m": r"(?P<m>99?)", "d": r"(?P<d>99?)", "e": r"(?P<d>99?)", "H": r"(?P<H>99?)", "I": r"(?P<I>99?)",
    "M": r"(?P<M>99)", "S": r"(?P<S>99)", "p": r"(?P<p>aa)", "b": r"(?P<b>aaa)", "h": r"(?P<b>aaa)", "a": r"(?P<a>aaa)",
    "z": r" ?(?P<z>[+-]99:?99|[+-]99|a)", "Z": r"(?P<Z>a{1,4})", "s": r"(?P<s>9{10})", "f": r"(?P<f>9{1,9})",
}


def mask_of(text: str) -> str:
    return re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", text))


def mask_pattern(spec: str) -> re.Pattern[str] | None:
    """Pattern over masks of the texts that a strftime specifier stands for; None if it has a code that isn't known."""
    out, i = [], 0
    while i < len(spec):
        c = spec[i]
        if c == "%":
            m = re.match(r"%(\.?)([0-9]?)f|%:?#?([A-Za-z%+])", spec[i:])
            if not m:
                return None
            i += m.end()
            if m[3] is None:
                # fractions keep their digits; the point is part of the code where it is written so
                out.append((r"[.,]" if m[1] else "") + _CODES["f"])
            elif m[3] in _CODES:
                out.append(_CODES[m[3]])
            elif m[3] == "T":
                out.append(":".join(_CODES[x] for x in "HMS"))
            elif m[3] == "F":
                out.append("-".join(_CODES[x] for x in "Ymd"))
            else:
                return None
            continue
        i += 1
        if c == " ":
            out.append(" +")
        elif c in ".,":
            out.append("[.,]")
        elif c in "Tt":
            out.append("(?:(?P<T>a)| +)")
        elif c in "Zz":
            out.append("(?P<z>a)")
        elif c.isalpha():
            out.append("a")
        else:
            out.append(re.escape(c))
    try:
        return re.compile("".join(out))
    except re.error:
        return None


@dataclass(frozen=True)
class Parser:
    """Field to (start, end) in the texts of one mask."""

    fields: tuple[tuple[str, int, int], ...]


class Shapes:
    """Masks to parsers, given format ids and specifiers.  A row's own format is tried first; where it doesn't fit, the
    text shows its form and the first other format that fits is taken."""

    def __init__(self, formats: dict[int, str]):
        self.patterns = {k: p for k, v in sorted(formats.items()) if v is not None and (p := mask_pattern(v))}
        self.known: dict[tuple[str, int | None], Parser | None] = {}

    def parser(self, mask: str, format_id: int | None) -> Parser | None:
        key = mask, format_id
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            order = [self.patterns[format_id]] if format_id in self.patterns else []
            match = next((m for p in [*order, *self.patterns.values()] if (m := p.fullmatch(mask))), None)
            self.known[key] = match and Parser(tuple((k, *match.span(k)) for k in match.groupdict() if match[k] is not None))
        return self.known[key]


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def days_in_month(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))


def tzdata_version() -> str:
    """Version of the zone data that tables are built from."""
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:  # noqa: BLE001 - the system's own data then has no version to ask for
        return "system"


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of a zone: ``offsets[i]`` seconds hold from ``starts[i]`` (UTC seconds) on."""

    starts: np.ndarray
    offsets: np.ndarray

    def at(self, utc: np.ndarray) -> np.ndarray:
        return self.offsets[np.clip(np.searchsorted(self.starts, utc, side="right") - 1, 0, None)]

    def instants(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, count) of the UTC seconds at which the wall clock shows ``local`` (count 0: skipped)."""
        first = np.full(len(local), np.iinfo(np.int64).max)
        last = np.full(len(local), np.iinfo(np.int64).min)
        count = np.zeros(len(local), np.int64)
        for offset in np.unique(self.offsets).tolist():
            utc = local - offset
            fits = self.at(utc) == offset
            first = np.where(fits, np.minimum(first, utc), first)
            last = np.where(fits, np.maximum(last, utc), last)
            count += fits
        return first, last, count


@lru_cache(maxsize=1024)
def zone_table(name: str, first_year: int = 1970, last_year: int = 2099) -> ZoneTable | None:
    """Transitions of an IANA zone, found from day to day and then to the second; None for an unknown zone."""
    try:
        zone = ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(t: int) -> int:
        return int((epoch + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())

    begin, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first_year, last_year + 1))
    starts, offsets = [np.iinfo(np.int64).min], [offset(begin)]
    for day in range(begin, end, 86400):
        low, high = day, min(day + 86400, end)
        while offset(high) != offsets[-1]:
            a, b = low, high
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if offset(middle) == offsets[-1] else (a, middle)
            starts.append(b)
            offsets.append(offset(b))
            low = b
    return ZoneTable(np.array(starts, np.int64), np.array(offsets, np.int64))


def _number(chars: np.ndarray, start: int, end: int) -> np.ndarray:
    return (chars[:, start:end].astype(np.int64) - 48) @ (10 ** np.arange(end - start - 1, -1, -1, dtype=np.int64))


def _names(chars: np.ndarray, start: int, end: int) -> np.ndarray:
    return np.ascontiguousarray(chars[:, start:end]).view(f"<U{end - start}").ravel()


def _index(names: np.ndarray, known: tuple[str, ...]) -> np.ndarray:
    """1-based place of each name, 0 where unknown."""
    out = np.zeros(len(names), np.int64)
    for i, k in enumerate(known):
        out[names == k] = i + 1
    return out


def convert(texts: list[str], parser: Parser, zones: np.ndarray, received: np.ndarray, tables: dict[str, ZoneTable]) -> np.ndarray:
    """Micros since 1970 (UTC) of trimmed texts of one mask, or the least int64 where a text denotes no instant.

    ``zones``: zone name of each text for wall-clock times; ``received``: micros, for missing years and repeated hours."""
    n, none = len(texts), np.iinfo(np.int64).min
    width = len(texts[0])
    chars = np.array([t.lower() for t in texts], dtype=f"<U{width}").view("<u4").reshape(n, width)
    at = {k: (s, e) for k, s, e in parser.fields}
    get = {k: _number(chars, *at[k]) for k in "YymdHIMSsf" if k in at}
    micro = np.zeros(n, np.int64)
    if "f" in at:
        digits = at["f"][1] - at["f"][0]
        micro = get["f"] * 10 ** (6 - digits) if digits <= 6 else get["f"] // 10 ** (digits - 6)
    if "s" in at:
        return get["s"] * MICROS + micro
    good = np.ones(n, bool)
    if "T" in at:
        good &= _names(chars, *at["T"]) == "t"
    month = get["m"] if "m" in get else _index(_names(chars, *at["b"]), MONTHS) if "b" in at else np.zeros(n, np.int64)
    day = get.get("d", np.zeros(n, np.int64))
    hour = get.get("H", np.zeros(n, np.int64))
    if "I" in get:
        half = _names(chars, *at["p"]) if "p" in at else np.full(n, "am")
        good &= (get["I"] >= 1) & (get["I"] <= 12) & ((half == "am") | (half == "pm"))
        hour = get["I"] % 12 + 12 * (half == "pm")
    minute, second = get.get("M", np.zeros(n, np.int64)), get.get("S", np.zeros(n, np.int64))
    good &= (month >= 1) & (month <= 12) & (day >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59)
    clock = hour * 3600 + minute * 60 + second
    offset, zoned = np.zeros(n, np.int64), np.zeros(n, bool)
    if "z" in at or "Z" in at:
        zoned[:] = True
        names = _names(chars, *at.get("z", at.get("Z")))
        for name in np.unique(names):
            rows = names == name
            if name[0] in "+-":
                digits = name[1:].replace(":", "").ljust(4, "0")
                h, m = int(digits[:2]), int(digits[2:])
                good[rows] &= h <= 23 and m <= 59
                offset[rows] = (-1 if name[0] == "-" else 1) * (h * 3600 + m * 60)
            elif name in ABBREVIATIONS:
                offset[rows] = ABBREVIATIONS[name] * 60
            else:
                good[rows] = False
    weekday = _index(_names(chars, *at["a"]), WEEKDAYS) if "a" in at else None

    def in_year(year: np.ndarray, bounded: bool) -> np.ndarray:
        """Micros of the instant in that year (the latest up to ``received`` if ``bounded`` or shown twice)."""
        out = np.full(n, none)
        fits = good & (year >= 1) & (day <= days_in_month(year, np.clip(month, 1, 12)))
        days = days_from_civil(year, np.clip(month, 1, 12), day)
        if weekday is not None:
            fits &= (weekday > 0) & (((days + 3) % 7) + 1 == weekday)
        local = days * 86400 + clock
        rows = fits & zoned
        out[rows] = (local[rows] - offset[rows]) * MICROS + micro[rows]
        if bounded:
            out[rows & (out > received)] = none
        for name in np.unique(zones[fits & ~zoned].astype(str)) if (fits & ~zoned).any() else ():
            table = tables.get(name)
            rows = np.nonzero(fits & ~zoned & (zones == name))[0]
            if table is None:
                continue
            first, last, count = table.instants(local[rows])
            early, late = (np.where(count > 0, x, 0) * MICROS + micro[rows] for x in (first, last))
            before = received[rows]
            chosen = np.where((count > 1) & (late > before), early, late)
            known = (count > 0) & ~(((count > 1) | bounded) & (chosen > before))
            out[rows[known]] = chosen[known]
        return out

    if "Y" in get or "y" in get:
        return in_year(get["Y"] if "Y" in get else 2000 + get["y"], False)
    this = (received // MICROS // 86400).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970
    found = np.full(n, none)
    for back in range(-1, 9):  # a leap day may be eight years back
        missing = found == none
        if not missing.any():
            break
        tried = in_year(this - back, True)
        found[missing] = tried[missing]
    return found
