"""Grammar of log lines: token classes, header rules of common layouts, and the meaning of their fields."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from .earley import Earley, Grammar

#: Level words and what they stand for (fixed values).
LEVELS = {
    "trace": "debug", "trc": "debug", "verbose": "debug", "fine": "debug", "finer": "debug", "finest": "debug", "debug": "debug", "dbg": "debug", "dbug": "debug", "deb": "debug", "d": "debug",
    "info": "info", "inf": "info", "information": "info", "informational": "info", "notice": "info", "note": "info", "i": "info", "n": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn", "w": "warn",
    "error": "error", "err": "error", "eror": "error", "severe": "error", "e": "error",
    "fatal": "fatal", "ftl": "fatal", "fat": "fatal", "crit": "fatal", "critical": "fatal", "emerg": "fatal", "emergency": "fatal", "panic": "fatal", "alert": "fatal", "f": "fatal", "c": "fatal",
}
#: Syslog severities 0 to 7 (fixed values).
SEVERITIES = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")

_KEYS = {
    "time": "KTIME", "@t": "KTIME", "ts": "KTIME", "t": "KTIME", "timestamp": "KTIME", "@timestamp": "KTIME", "datetime": "KTIME", "date": "KTIME",
    "level": "KLEVEL", "lvl": "KLEVEL", "severity": "KLEVEL", "@l": "KLEVEL", "loglevel": "KLEVEL",
    "logger": "KNAME", "name": "KNAME", "component": "KNAME", "module": "KNAME", "program": "KNAME", "app": "KNAME", "service": "KNAME", "source": "KNAME",
    "message": "KTEXT", "msg": "KTEXT", "@m": "KTEXT", "text": "KTEXT",
}

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:Z|[+-]\d\d:?\d\d)?(?!\w)"
_TOKEN = re.compile(
    rf"(?P<COLOUR>\x1b\[[0-9;]*m)|(?P<ISO>{_ISO})|(?P<BSD>{_MONTH} [ \d]\d \d\d:\d\d:\d\d(?!\d))|(?P<CLF>\d\d/{_MONTH}/\d{{4}}:\d\d:\d\d:\d\d [+-]\d{{4}})"
    r"|(?P<SD>\[[^\s\[\]\"=]+(?: [^\s=\]]+=\"(?:[^\"\\\]]|\\.)*\")+\])|(?P<STR>\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<IP>\d{1,3}(?:\.\d{1,3}){3}(?![\w.]))|(?P<CLOCK>\d\d:\d\d:\d\d(?:\.\d+)?(?!\w))|(?P<EPOCH>\d{10}(?:\.\d+)(?!\w))|(?P<NUM>\d+(?:\.\d+)?(?!\w))"
    r"|(?P<WORD>[^\W_](?:[\w.\-]*\w)?|_[\w.\-]*)|(?P<WS>[ \t]+)|(?P<PUNCT>[^\w\s])|(?P<OTHER>[\s\S])"
)
_PRI = re.compile(r"<(\d{1,3})>")
_GLOG = re.compile(r"[DIWEFC]\d{4}(?= )")
_JSON_KEY = re.compile(r"\s*:")

#: ``_`` stands for white space.  Header rules weigh more than anything a message could add; fields add to them.
GRAMMAR = """
Line: Header | More

# what goes on an entry: indented lines, stack traces, causes, dumps, tables, statements and objects over several lines
More=more: _ | Trace | CAUSED | ERRORNAME | Dump | Table | STATEMENT | { | } | CLOSING
Trace: TRACEBACK | FRAME
Dump: OFFSET
Table: VBAR _ | RULE
Header: Bsd | Ietf | Glog | Logger | Bracket | Pipe | Epoch | Access | Json | Logfmt
Pri=pri: PRI
Word: WORD | LEVEL | NUMWORD
Name=component: Word @1
Level=level: LEVEL @2 | COLOUR LEVEL COLOUR @2
OtherLevel: WORD @0.1 | COLOUR WORD COLOUR @0.1
Pid: NUM | -
Iso=time: ISO
IsoUtc: Iso
Host: Word | IP | -

# Mon dd HH:MM:SS host program[pid]: [LEVEL:] message
Time3164=time: BSD
Tag: Name | Name [ NUM ]
BsdHead: Time3164 _ Host _ Tag : @10 | Pri Time3164 _ Host _ Tag : @11
Bsd: BsdHead _ @1 | BsdHead _ Level : _ @3 | BsdHead _ [ Level ] _ @3 | BsdHead @0.5

# <pri>1 time host program pid id data message
Data: SD | -
Id: Word | NUM | -
NoName: - @0.5
Ietf: Pri NUM _ Iso _ Host _ Name _ Pid _ Id _ Data _ @20 | Pri NUM _ Iso _ Host _ NoName _ Pid _ Id _ Data _ @20 | Pri NUM _ Iso _ Host _ Name _ Pid _ Id _ Data @19

# Lmmdd HH:MM:SS.ffffff thread file:line] message
GlogLevel=glog: GLOGDAY
GlogTime=clock: CLOCK
Glog: GlogLevel _ GlogTime _ NUM _ Name : NUM ] @20

# time LEVEL [thread] logger - message
Thread: [ ThreadWords ]
ThreadWords: Word | NUM | ThreadWords _ Word | ThreadWords - NUM | ThreadWords - Word | ThreadWords _ NUM | ThreadWords # NUM
Logger: Iso _ Level _ Thread _ Name _ - _ @20 | Iso _ OtherLevel _ Thread _ Name _ - _ @19 | Iso _ Thread _ Level _ Name _ - _ @20 | Iso _ Level _ Name _ - _ @15 | Iso _ Level _ Name : _ @15 | Iso _ Level _ Thread _ Name : _ @18

# [time] [level] [component] message
Bracket: [ Iso ] _ [ Level ] _ [ Name ] _ @20 | [ Iso ] _ [ OtherLevel ] _ [ Name ] _ @19 | [ Iso ] _ [ Level ] _ @12 | [ Iso ] _ COLOUR [ Level ] COLOUR _ [ Name ] _ @19

# time|LEVEL|component|pid|message
Bar: VBAR
Pipe: Iso Bar Level Bar Name Bar Pid Bar @20 | Iso Bar OtherLevel Bar Name Bar Pid Bar @19 | Iso Bar Level Bar Name Bar @12

# seconds component/pid L message
EpochTime=time: EPOCH
Epoch: EpochTime _ Name / NUM _ Level _ @20 | EpochTime _ Name / NUM _ OtherLevel _ @15

# address - - [time] "request" status size
ClfTime=time: CLF
User: - | Word
Request=text: STR
Access: IP _ User _ User _ [ ClfTime ] _ Request _ NUM _ Pid @20 | Host _ User _ User _ [ ClfTime ] _ Request _ NUM _ Pid @19

# one JSON object with a time
Colon: : | : _ | _ : | _ : _
Comma: , | , _ | _ , | _ , _
KeyTime: KTIME
JsonTime=time: TSTR | NUM | EPOCH
JsonLevel=level: LSTR
JsonName=component: STR | TSTR | LSTR
JsonText=text: STR | TSTR | LSTR
Value: STR | TSTR | LSTR | NUM | EPOCH | WORD | LEVEL | - NUM
TimePair: KTIME Colon JsonTime @5
OtherPair: KLEVEL Colon JsonLevel @2 | KLEVEL Colon Value | KNAME Colon JsonName @2 | KTEXT Colon JsonText @1 | KEY Colon Value | KNAME Colon NUM | KTEXT Colon NUM
Pairs: OtherPair | Pairs Comma OtherPair
TimedPairs: TimePair | Pairs Comma TimePair | TimedPairs Comma OtherPair
Json: OpenBrace TimedPairs CloseBrace @20
OpenBrace: { | { _
CloseBrace: } | _ }

# key=value pairs with a time
FmtTime=time: ISO | STR | EPOCH | NUM | TSTR
FmtLevel=level: LEVEL | LSTR
FmtName=component: Word | STR | LSTR
FmtText=text: STR | TSTR | LSTR | Word | NUM
FmtValue: FmtAtom | FmtValue FmtAtom
FmtAtom: WORD | LEVEL | NUMWORD | NUM | STR | TSTR | LSTR | ISO | IP | EPOCH | CLOCK | - | / | : | .
FmtTimePair: FTIME = FmtTime @5
FmtPair: FLEVEL = FmtLevel @2 | FLEVEL = FmtValue | FNAME = FmtName @2 | FTEXT = FmtText @1 | FKEY = FmtValue
FmtPairs: FmtPair | FmtPairs _ FmtPair
FmtTimed: FmtTimePair | FmtPairs _ FmtTimePair | FmtTimed _ FmtPair
Logfmt: FmtTimed _ FTEXT = FmtText @20 | FmtTimed @14
"""


#: Classes that only the first token of a line has.
_FIRST = re.compile(
    r"(?P<TRACEBACK>Traceback(?= \(most recent call last\):))|(?P<FRAME>at (?=[\w.$<>/]+\()|File (?=\"[^\"]*\", line \d)|\.\.\. (?=\d+ (?:more|common)))|(?P<CAUSED>(?:Caused by|Suppressed|Root cause): ?)"
    r"|(?P<ERRORNAME>[A-Za-z_][\w.$]*(?:Error|Exception|Warning|Interrupt|Exit)(?=:|$))|(?P<OFFSET>[0-9A-Fa-f]{4,16}:? {1,2}(?=[0-9A-Fa-f]{2}[ 0-9A-Fa-f]))"
    r"|(?P<RULE>[+|=-][-+=|]{2,}\s*$)|(?P<STATEMENT>(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|HAVING|LIMIT|(?:LEFT |RIGHT |INNER |CROSS |OUTER )*JOIN|UNION|INSERT INTO|UPDATE|DELETE FROM|SET|VALUES|WITH|AND|OR|ON)(?= ))|(?P<CLOSING>[)\]][)\]},;]*\s*$)"
)


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int


def tokens(line: str) -> Iterator[Token]:
    """Token classes of a line, found one by one, so that no more of it is read than the parser wants."""
    at, n = 0, len(line)
    if m := _PRI.match(line):
        yield Token("PRI", 0, m.end())
        at = m.end()
    elif m := _GLOG.match(line):
        yield Token("GLOGDAY", 0, m.end())
        at = m.end()
    elif m := _FIRST.match(line):
        yield Token(m.lastgroup, 0, m.end())
        at = m.end()
    while at < n:
        m = _TOKEN.match(line, at)
        kind, text, end = m.lastgroup, m[0], m.end()
        if kind == "WS":
            kind = "_"
        elif kind == "PUNCT":
            kind = "VBAR" if text == "|" else text
        elif kind == "STR":
            inner = text[1:-1]
            if _JSON_KEY.match(line, end):
                kind = _KEYS.get(inner.lower(), "KEY")
            elif inner.lower() in LEVELS:
                kind = "LSTR"
            elif re.fullmatch(_ISO, inner):
                kind = "TSTR"
        elif kind == "WORD":
            low = text.lower()
            if line[end : end + 1] == "=":
                kind = "F" + _KEYS.get(low, "KEY")[1:] if low in _KEYS else "FKEY"
            elif low in LEVELS:
                kind = "LEVEL"
            elif text[0].isdigit():
                kind = "NUMWORD"
        yield Token(kind, at, end)
        at = end


@dataclass
class Header:
    """What a header line states; ``text`` is the message proper, ``unparsed`` the span that no rule covers."""

    level: str
    component: str
    time: str | None
    text: str
    score: float
    unparsed: tuple[int, int]


class LineParser:
    """Lines by their highest-scoring parse: a header, something that goes on an entry, or neither."""

    def __init__(self, grammar: str = GRAMMAR, start: str = "Line"):
        self.earley = Earley(Grammar(grammar, start))

    def parse(self, line: str | None) -> Header | None:
        """Header of a line, or None for a line that has none."""
        return self.read(line)[0]

    def read(self, line: str | None) -> tuple[Header | None, tuple[int, int]]:
        """(header if the line is one, span of it that no rule covers)."""
        if not line:
            return None, (0, 0)
        seen: list[Token] = []

        def kinds() -> Iterator[str]:
            for t in tokens(line):
                seen.append(t)
                yield t.kind

        found = self.earley.parse(kinds())
        if found is None:
            return None, (0, len(line))
        score, used, fields = found
        spans: dict[str, str] = {}
        for role, first, last in fields:
            parts = [line[t.start : t.end] for t in seen[first:last] if t.kind != "COLOUR"]
            spans[role] = "".join(parts)
        if "more" in spans:
            return None, (0, 0)
        end = seen[used - 1].end
        strip = lambda x: x[1:-1] if x[:1] == '"' == x[-1:] and len(x) > 1 else x
        level = "none"
        if "level" in spans:
            level = LEVELS[strip(spans["level"]).lower()]
        elif "glog" in spans:
            level = LEVELS[spans["glog"][0].lower()]
        elif "pri" in spans and int(spans["pri"][1:-1]) <= 191:
            level = SEVERITIES[int(spans["pri"][1:-1]) % 8]
        time = strip(spans["time"]) if "time" in spans else f"{spans['glog'][1:]} {spans['clock']}" if "glog" in spans else None
        text = strip(spans["text"]) if "text" in spans else line[end:]
        # the message proper takes the rest of the line, unless a field of the header is the message
        rest = (end, len(line)) if "text" in spans and line[end:].strip() else (0, 0)
        return Header(level, strip(spans.get("component", "")) or "none", time, text, score, rest), rest
