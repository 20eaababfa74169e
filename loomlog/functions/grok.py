r"""Grok patterns: named regular expressions that refer to each other as ``%{NAME}`` or ``%{NAME:alias}``.

An expression is expanded on the driver into one regular expression that Java and Python read alike, with plain groups:
captures are found by position.  Matching is unanchored.

Java matches an unbounded repeat of a group by recursion, one level a pass, so that a long text overflows the stack of its
executor.  The default patterns repeat single characters, possessive groups or a bounded number of times; ``expand`` warns of
others (:func:`deep_repeats`).
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

#: The default library.  Names are those in general use; the definitions are this project's own.
PATTERNS = {
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"%{USERNAME}",
    "INT": r"[+-]?[0-9]+",
    "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)",
    "NUMBER": r"%{BASE10NUM}",
    "BASE16NUM": r"(?:0[xX])?[0-9a-fA-F]+",
    "POSINT": r"[1-9][0-9]*",
    "NONNEGINT": r"[0-9]+",
    "WORD": r"\w+",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'",
    "UUID": r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    "MAC": r"(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}",
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])",
    "IPV6": r"(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}",
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"[0-9A-Za-z](?:[0-9A-Za-z_-]*[0-9A-Za-z])?(?:\.[0-9A-Za-z](?:[0-9A-Za-z_-]*[0-9A-Za-z])?){0,126}\.?",
    "HOST": r"%{HOSTNAME}",
    "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "UNIXPATH": r"/[\w.,~+=@%:/-]*",
    "WINPATH": r"(?:[A-Za-z]:|\\)\\[^?*]*",
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})",
    "URIPROTO": r"[A-Za-z][A-Za-z0-9+.-]*",
    "URIPATH": r"/[A-Za-z0-9$.+!*'(){},~:;=@#%&_/-]*",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\[\]<>-]*",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{IPORHOST}(?::%{POSINT})?)?(?:%{URIPATH}(?:%{URIPARAM})?)?",
    "MONTH": r"(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]une?|[Jj]uly?|[Aa]ug(?:ust)?|[Ss]ep(?:tember)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?)",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])",
    "DAY": r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*",
    "YEAR": r"[0-9]{4}|[0-9]{2}",
    "HOUR": r"(?:2[0-3]|[01]?[0-9])",
    "MINUTE": r"[0-5][0-9]",
    "SECOND": r"(?:[0-5]?[0-9]|60)(?:[.,:][0-9]+)?",
    "TIME": r"%{HOUR}:%{MINUTE}:%{SECOND}",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-](?:%{YEAR})",
    "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-](?:%{YEAR})",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}:?%{MINUTE})",
    "TIMESTAMP_ISO8601": r"[0-9]{4}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?(?:%{ISO8601_TIMEZONE})?",
    "TZ": r"[A-Z]{3,4}",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/[0-9]{4}:%{TIME} [+-][0-9]{4}",
    "PROG": r"[^\s\[\]:]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:facility}.%{NONNEGINT:priority}>",
    "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    "SYSLOGLINE": r"%{SYSLOGBASE} %{GREEDYDATA:message}",
    "LOGLEVEL": r"(?i:trace|debug|notice|info(?:rmation)?|warn(?:ing)?|err(?:or)?|crit(?:ical)?|fatal|severe|emerg(?:ency)?|alert)",
    "COMMONAPACHELOG": r"%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] \"(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})\" %{NUMBER:response} (?:%{NUMBER:bytes}|-)",
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QUOTEDSTRING:referrer} %{QUOTEDSTRING:agent}",
}

log = logging.getLogger(__name__)

_REFERENCE = re.compile(r"%\{(\w+)(?::([\w.\[\]@-]+))?(?::\w+)?\}")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


class GrokError(ValueError):
    """A pattern that can't be expanded."""


@dataclass(frozen=True)
class Group:
    index: int
    optional: bool  # whether a match may leave the group out


@dataclass(frozen=True)
class Grok:
    """An expanded pattern: its regular expression and the groups of each captured name, in order."""

    regex: str
    groups: dict[str, tuple[Group, ...]]


def library(extra: dict[str, str] | None = None, ignore_defaults: bool = False) -> dict[str, str]:
    return ({} if ignore_defaults else dict(PATTERNS)) | (extra or {})


def read_patterns(text: str) -> dict[str, str]:
    """Patterns of a file: ``NAME regex`` lines; blank lines and those that begin with # don't count."""
    out = {}
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            name, _, regex = line.strip().partition(" ")
            if not regex.strip():
                raise GrokError(f"pattern without a regex: {line!r}")
            out[name] = regex.strip()
    return out


def expand(expression: str, patterns: dict[str, str], alias_only: bool = False) -> Grok:
    """Expands references.  ``%{NAME}`` captures under its own name unless ``alias_only``; ``%{NAME:alias}``
    always captures under the alias."""
    names: dict[str, str] = {}

    def opened(name: str) -> str:
        group = f"g{len(names)}"
        names[group] = name
        return f"(?P<{group}>"

    def inner(text: str, path: tuple[str, ...]) -> str:
        text = _NAMED.sub(lambda m: f"\x00{m[1]}\x01", text)
        out, at = [], 0
        for m in re.finditer(rf"\x00(?P<named>\w+)\x01|{_REFERENCE.pattern}", text):
            out.append(text[at : m.start()])
            at = m.end()
            if m["named"]:
                out.append(opened(m["named"]))
                continue
            name, alias = m[2], m[3]
            if name in path:
                raise GrokError(f"pattern {name} refers to itself")
            if name not in patterns:
                raise GrokError(f"unknown pattern {name}")
            start = opened(alias or name) if alias or not alias_only else "(?:"
            out.append(start + inner(patterns[name], (*path, name)) + ")")
        return "".join(out) + text[at:]

    regex = inner(expression, ())
    try:
        compiled = re.compile(regex)
    except re.error as error:
        raise GrokError(f"invalid pattern {expression!r}: {error}") from None
    if deep := deep_repeats(regex):
        log.warning("pattern %s repeats %d group(s) without bound, which recurses on long texts; use single characters, a possessive group (...)*+ or a bound", expression, deep)
    optional = _optional_groups(regex)
    groups: dict[str, tuple[Group, ...]] = {}
    for group, index in compiled.groupindex.items():
        groups[names[group]] = (*groups.get(names[group], ()), Group(index, index in optional))
    return Grok(re.sub(r"\(\?P<g\d+>", "(", regex), groups)


def deep_repeats(regex: str) -> int:
    """How many unbounded repeats, other than possessive ones, have a body that is more than a single character."""
    from re import _constants as k
    from re import _parser

    single = {k.LITERAL, k.NOT_LITERAL, k.IN, k.ANY, k.CATEGORY, k.RANGE}

    def walk(items) -> int:
        found = 0
        for op, arg in items:
            if op in (k.MAX_REPEAT, k.MIN_REPEAT):
                found += arg[1] is k.MAXREPEAT and not (len(arg[2]) == 1 and arg[2][0][0] in single)
                found += walk(arg[2])
            elif op is k.POSSESSIVE_REPEAT:
                found += walk(arg[2])
            elif op is k.SUBPATTERN:
                found += walk(arg[3])
            elif op is k.BRANCH:
                found += sum(map(walk, arg[1]))
            elif op is k.ATOMIC_GROUP:
                found += walk(arg)
            elif op in (k.ASSERT, k.ASSERT_NOT):
                found += walk(arg[1])
        return found

    return walk(_parser.parse(regex))


def _optional_groups(regex: str) -> set[int]:
    """Groups inside an alternative or a repeat that may be empty."""
    from re import _constants as k
    from re import _parser

    out: set[int] = set()

    def walk(items, inside: bool) -> None:
        for op, arg in items:
            if op is k.SUBPATTERN:
                if inside and arg[0] is not None:
                    out.add(arg[0])
                walk(arg[3], inside)
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
                walk(arg[2], inside or arg[0] == 0)
            elif op is k.BRANCH:
                for branch in arg[1]:
                    walk(branch, True)
            elif op is k.ATOMIC_GROUP:
                walk(arg, inside)
            elif op in (k.ASSERT, k.ASSERT_NOT):
                walk(arg[1], True)

    walk(_parser.parse(regex), False)
    return out
