"""Engine configuration: column specs, YAML files and command-line options, in that order of precedence from the last."""

from __future__ import annotations

import argparse
import logging
import re
from dataclasses import dataclass, field, fields
from typing import Any

from .functions.typespec import TypeSpec, parse_spec


log = logging.getLogger(__name__)


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class ColumnSpec:
    """An output column: the names it may be captured under, its type and whether rows need it."""

    name: str
    lookups: tuple[str, ...]
    spec: TypeSpec
    required: bool = False


def parse_column(text: str) -> ColumnSpec:
    """``[+]lookup[,lookup...][:type]``; the first lookup names the column, ``+`` makes it required."""
    required = text.startswith("+")
    names, _, kind = text[required:].partition(":")
    lookups = tuple(n.strip() for n in names.split(","))
    if not all(lookups):
        raise ConfigError(f"column without a name: {text!r}")
    try:
        return ColumnSpec(lookups[0], lookups, parse_spec(kind), required)
    except ValueError as error:
        raise ConfigError(str(error)) from None


#: Columns used where none are configured: those of syslog lines (fixed values).
DEFAULT_COLUMNS = ("+timestamp:ts:%b %e %H:%M:%S", "message:str:65535", "logsource:str:256", "program:str:256", "pid:int")


@dataclass(frozen=True)
class ServerAddress:
    proto: str
    host: str
    port: int


def parse_input(text: str) -> str | ServerAddress:
    """A path, ``-`` for standard input, or ``syslog-tcp:host:port`` / ``syslog-udp:host:port``.  The host is what
    stands between the first and the last colon, so IPv6 addresses need no brackets (and may have them)."""
    m = re.match(r"syslog-(\w+):(.*)$", text)
    if not m:
        return text
    proto, rest = m.groups()
    host, colon, port = rest.rpartition(":")
    if proto not in ("tcp", "udp"):
        raise ConfigError(f"unknown protocol {proto!r}")
    if not colon or not port.isdigit() or not 0 <= int(port) < 65536:
        raise ConfigError(f"expected host:port, found {rest!r}")
    return ServerAddress(proto, host.strip("[]"), int(port))


@dataclass(frozen=True)
class EngineConfig:
    input: str = "-"
    output: str = "-"
    output_format: str = "csv"  # csv, sql or jdbc
    output_batch_size: int = 1000  # raw messages in a batch; 0 for no limit
    output_add_ddl: bool = False
    output_table_name: str | None = None
    grok_pattern: str = "SYSLOGLINE"
    grok_patterns: dict[str, str] = field(default_factory=dict)
    grok_patterns_file: str | None = None
    grok_ignore_default_patterns: bool = False
    grok_with_alias_only: bool = False
    columns: tuple[ColumnSpec, ...] = ()
    query: str | None = None
    merge_multi_line: bool = False
    tick_interval: float = 30.0
    idle_timeout: float = 30.0
    channel_size: int = 1000
    ddl_pre_name_opts: str = ""
    ddl_table_opts: str = ""
    semantics: str = "log"
    scope: str = "batch"
    on_error: str = "fail"  # or skip_batch
    default_year: int | None = None
    rejects: str = "-"  # rejected messages: - for standard error, none, or a folder of CSV files
    single_file: bool = False  # output is one local file that is appended to, in place of a folder

    def __post_init__(self) -> None:
        if self.output_format not in ("csv", "sql", "jdbc"):
            raise ConfigError(f"unknown output format {self.output_format!r}")
        if self.on_error not in ("fail", "skip_batch"):
            raise ConfigError(f"unknown error policy {self.on_error!r}")
        if self.output_batch_size < 0:
            raise ConfigError("the batch size can't be negative")
        parse_input(self.input)
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise ConfigError("duplicate column names")

    @property
    def schema(self) -> tuple[ColumnSpec, ...]:
        return self.columns or tuple(map(parse_column, DEFAULT_COLUMNS))

    @property
    def table_name(self) -> str:
        return self.output_table_name or self.grok_pattern


#: Options of other set-ups that are accepted without effect, and why.
IGNORED = {"rayon_threads": "the session's cores set the parallelism"}

_PATTERN = re.compile(r"(\S+)\s+(.+)$", re.S)


def parse_pattern(text: str) -> tuple[str, str]:
    """``NAME regex`` of an extra pattern."""
    m = _PATTERN.match(text.strip())
    if not m:
        raise ConfigError(f"expected 'NAME regex', found {text!r}")
    return m[1], m[2]


def _normal(raw: dict[str, Any]) -> dict[str, Any]:
    """Checks keys and turns texts into their objects."""
    known = {f.name for f in fields(EngineConfig)}
    out = {}
    for key, value in raw.items():
        name = key.replace("-", "_").lower()
        name = {"output_batch": "output_batch_size", "async_channel_size": "channel_size", "grok_schema_columns": "columns", "grok_extra_patterns": "grok_patterns"}.get(name, name)
        if name in IGNORED:
            log.info("option %s has no effect: %s", key, IGNORED[name])
            continue
        if name == "grok_load_default":
            name, value = "grok_ignore_default_patterns", None if value is None else not value
        if name not in known:
            raise ConfigError(f"unknown option {key!r}")
        if value is None:
            continue
        if name == "columns":
            value = tuple(parse_column(v) if isinstance(v, str) else v for v in value)
        if name == "grok_patterns" and not isinstance(value, dict):
            value = dict(map(parse_pattern, value))
        out[name] = value
    return out


def load_yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    return _normal(raw)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomlog", description="Parse text logs, query them and write the result.")
    p.add_argument("-c", "--conf", help="YAML file with the options below")
    p.add_argument("-i", "--input", help="path, - for standard input, or syslog-tcp:host:port, syslog-udp:host:port")
    p.add_argument("-o", "--output", help="path, - for standard output, or a JDBC URL")
    p.add_argument("-f", "--output-format", choices=["csv", "sql", "jdbc"])
    p.add_argument("-b", "--output-batch-size", type=int, help="raw messages in a batch, 0 for no limit")
    p.add_argument("--output-add-ddl", action="store_true", default=None)
    p.add_argument("--output-table-name")
    p.add_argument("-g", "--grok-pattern")
    p.add_argument("-e", "--extra-pattern", action="append", metavar="'NAME REGEX'")
    p.add_argument("--grok-patterns-file")
    p.add_argument("--grok-ignore-default-patterns", action="store_true", default=None)
    p.add_argument("--grok-with-alias-only", action="store_true", default=None)
    p.add_argument("--grok-list-default-patterns", action="store_true")
    p.add_argument("-s", "--column", action="append", metavar="[+]NAME[,NAME...][:TYPE]")
    p.add_argument("-q", "--query")
    p.add_argument("-m", "--merge-multi-line", action="store_true", default=None)
    p.add_argument("--tick-interval", type=float)
    p.add_argument("--idle-timeout", type=float)
    p.add_argument("--channel-size", type=int)
    p.add_argument("--ddl-pre-name-opts")
    p.add_argument("--ddl-table-opts")
    p.add_argument("--semantics", choices=["sql", "log"])
    p.add_argument("--scope", choices=["global", "batch"])
    p.add_argument("--on-error", choices=["fail", "skip_batch"])
    p.add_argument("--default-year", type=int)
    p.add_argument("--rejects", help="rejected messages with their reasons: - for standard error (the default), none, or a folder")
    p.add_argument("--single-file", action="store_true", default=None, help="append the output to one local file")
    return p


def load(argv: list[str]) -> EngineConfig:
    """Options of a command line over those of its YAML file over the defaults."""
    args = vars(arguments().parse_args(argv))
    conf, extra, columns = args.pop("conf"), args.pop("extra_pattern"), args.pop("column")
    args.pop("grok_list_default_patterns")
    options = load_yaml(conf) if conf else {}
    given = {k: v for k, v in args.items() if v is not None}
    if columns:
        given["columns"] = columns
    merged = options | _normal(given)
    if extra:
        merged["grok_patterns"] = merged.get("grok_patterns", {}) | dict(map(parse_pattern, extra))
    return EngineConfig(**merged)
