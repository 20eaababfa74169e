"""A parsed SELECT as DataFrame operations.

Two semantics: ``sql`` has SQL's null logic; ``log`` has that of log records, in which comparisons are two-valued, null is
the least value and the text ``NULL`` in concatenations, sums start at 0, averages count every row, and a minimum over
any null is null.  Two scopes: ``global`` runs the query over the whole table, ``batch`` over every batch of rows (those of
equal ``_batch``) by itself, ordering, limits and offsets included.

Names are resolved while compiling: an alias of the SELECT list first (within its own definition, and then for an
input column), then an input column; anything else is an error, as is all that can't be typed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timefmt
from .ast import Between, Binary, Call, Case, Cast, Expr, InList, IsNull, Item, Like, Literal, Name, Order, Select, Star, Unary
from .parser import SqlError, parse

AGGREGATES = {"count", "sum", "avg", "min", "max"}
#: Columns that carry position; ``*`` leaves them out.
HIDDEN = ("_seq", "_batch", "_raw", "_file", "_block", "_pos")
_TYPES = {
    "int": T.LongType(), "integer": T.LongType(), "bigint": T.LongType(), "long": T.LongType(), "smallint": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "real": T.DoubleType(),
    "varchar": T.StringType(), "string": T.StringType(), "text": T.StringType(), "char": T.StringType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


@dataclass(frozen=True)
class Typed:
    column: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        """null, bool, long, double, time, str or other"""
        if isinstance(self.type, T.NullType):
            return "null"
        if isinstance(self.type, T.BooleanType):
            return "bool"
        if isinstance(self.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "long"
        if isinstance(self.type, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "double"
        if isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "time"
        return "str" if isinstance(self.type, T.StringType) else "other"


#: Order between kinds that can't be compared by value.
_RANK = {"null": 0, "bool": 1, "long": 2, "double": 2, "time": 2, "str": 3, "other": 4}


class _Scope:
    def __init__(self, df: DataFrame, aliases: dict[str, Expr], semantics: str, default_year: int | None):
        self.columns = {f.name: f.dataType for f in df.schema.fields}
        self.folded = {}
        for c in self.columns:
            self.folded.setdefault(c.lower(), c)
        self.aliases = aliases
        self.log = semantics == "log"
        self.default_year = default_year


def is_aggregate(e: Expr) -> bool:
    return isinstance(e, Call) and e.name.lower() in AGGREGATES


def children(e: Expr) -> list[Expr]:
    if isinstance(e, (Unary, IsNull, Cast)):
        return [e.arg]
    if isinstance(e, Binary):
        return [e.left, e.right]
    if isinstance(e, InList):
        return [e.arg, *e.items]
    if isinstance(e, Between):
        return [e.arg, e.low, e.high]
    if isinstance(e, Like):
        return [e.arg, e.pattern]
    if isinstance(e, Case):
        return [x for x in (e.operand, *(y for w in e.whens for y in w), e.otherwise) if x is not None]
    return list(e.args) if isinstance(e, Call) else []


def has_aggregate(e: Expr, aliases: dict[str, Expr] | None = None, seen: frozenset[str] = frozenset()) -> bool:
    if isinstance(e, Name) and aliases and e.name in aliases and e.name not in seen:
        return has_aggregate(aliases[e.name], aliases, seen | {e.name})
    return is_aggregate(e) or any(has_aggregate(c, aliases, seen) for c in children(e))


def fold_int(e: Expr, what: str) -> int:
    """Value of a constant integer expression."""
    if isinstance(e, Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
        return e.value
    if isinstance(e, Unary) and e.op in "+-":
        return fold_int(e.arg, what) * (-1 if e.op == "-" else 1)
    if isinstance(e, Binary) and e.op in ("+", "-", "*", "/", "%"):
        a, b = fold_int(e.left, what), fold_int(e.right, what)
        if e.op in "/%":
            if b == 0:
                raise SqlError(f"division by zero in {what}")
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return q if e.op == "/" else a - q * b
        return {"+": a + b, "-": a - b, "*": a * b}[e.op]
    raise SqlError(f"{what} must be a constant integer")


class _Compiler:
    def __init__(self, scope: _Scope):
        self.s = scope

    def truthy(self, x: Typed) -> Column:
        """Two-valued truth: null, texts and times are false, numbers true unless 0."""
        if x.kind == "bool":
            return F.coalesce(x.column, F.lit(False))
        return F.coalesce(x.column != 0, F.lit(False)) if x.kind in ("long", "double") else F.lit(False)

    def condition(self, e: Expr, seen: frozenset[str] = frozenset()) -> Column:
        x = self.expr(e, seen)
        if self.s.log or x.kind != "bool":
            return self.truthy(x)
        return x.column

    def expr(self, e: Expr, seen: frozenset[str] = frozenset()) -> Typed:
        if isinstance(e, Literal):
            return self.literal(e)
        if isinstance(e, Name):
            return self.name(e, seen)
        if isinstance(e, Unary):
            return self.unary(e, seen)
        if isinstance(e, Binary):
            return self.binary(e.op, self.expr(e.left, seen), self.expr(e.right, seen))
        if isinstance(e, IsNull):
            c = self.expr(e.arg, seen).column
            return Typed(c.isNotNull() if e.negated else c.isNull(), T.BooleanType())
        if isinstance(e, InList):
            arg = self.expr(e.arg, seen)
            found = None
            for item in e.items:
                same = self.binary("=", arg, self.expr(item, seen)).column
                found = same if found is None else found | same
            return Typed(~found if e.negated else found, T.BooleanType())
        if isinstance(e, Between):
            arg = self.expr(e.arg, seen)
            inside = self.binary(">=", arg, self.expr(e.low, seen)).column & self.binary("<=", arg, self.expr(e.high, seen)).column
            return Typed(~inside if e.negated else inside, T.BooleanType())
        if isinstance(e, Like):
            arg, pattern = self.expr(e.arg, seen), e.pattern
            if arg.kind != "str" or not isinstance(pattern, Literal) or not isinstance(pattern.value, str):
                raise SqlError("LIKE needs a text and a literal pattern")
            found = arg.column.ilike(pattern.value) if e.ignore_case else arg.column.like(pattern.value)
            return Typed(~found if e.negated else found, T.BooleanType())
        if isinstance(e, Case):
            return self.case(e, seen)
        if isinstance(e, Cast):
            target = _TYPES.get(e.type_name.lower())
            if target is None:
                raise SqlError(f"unknown type {e.type_name}")
            c = self.expr(e.arg, seen).column
            return Typed(c.try_cast(target) if e.safe else c.cast(target), target)
        if isinstance(e, Call):
            return self.aggregate(e, seen) if is_aggregate(e) else self.call(e, seen)
        raise SqlError("* is only allowed as a SELECT item or in COUNT(*)")

    def literal(self, e: Literal) -> Typed:
        v = e.value
        if v is None:
            return Typed(F.lit(None), T.NullType())
        if isinstance(v, bool):
            return Typed(F.lit(v), T.BooleanType())
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise SqlError(f"integer out of range: {v}")
            return Typed(F.lit(v).cast("long"), T.LongType())
        return Typed(F.lit(v), T.DoubleType() if isinstance(v, float) else T.StringType())

    def name(self, e: Name, seen: frozenset[str]) -> Typed:
        if e.name in self.s.aliases and e.name not in seen:
            return self.expr(self.s.aliases[e.name], seen | {e.name})
        column = e.name if e.name in self.s.columns else self.s.folded.get(e.name.lower())
        if column is None:
            raise SqlError(f"unknown column {e.name}")
        return Typed(F.col(f"`{column}`"), self.s.columns[column])

    def unary(self, e: Unary, seen: frozenset[str]) -> Typed:
        x = self.expr(e.arg, seen)
        if e.op == "NOT":
            return Typed(~self.truthy(x) if self.s.log or x.kind != "bool" else ~x.column, T.BooleanType())
        if x.kind not in ("long", "double", "null"):
            raise SqlError(f"unary {e.op} needs a number")
        return Typed(-x.column if e.op == "-" else x.column, x.type)

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("AND", "OR", "XOR"):
            x, y = ((self.truthy(v) if self.s.log or v.kind != "bool" else v.column) for v in (a, b))
            return Typed(x & y if op == "AND" else x | y if op == "OR" else x != y, T.BooleanType())
        if op == "||":
            return Typed(F.concat(*(self.text(v) for v in (a, b))), T.StringType())
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return Typed(self.compare(op, a, b), T.BooleanType())
        for v in (a, b):
            if v.kind not in ("long", "double", "null"):
                raise SqlError(f"{op} needs numbers")
        if "double" in (a.kind, b.kind) or (a.kind == b.kind == "null"):
            x, y = a.column.cast("double"), b.column.cast("double")
            if op in "/%":
                y = _nonzero(y, "double")
            return Typed({"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[op], T.DoubleType())
        x, y = a.column.cast("long"), b.column.cast("long")
        if op == "/":
            return Typed(F.call_function("div", x, _nonzero(y, "long")), T.LongType())
        if op == "%":
            return Typed(x % _nonzero(y, "long"), T.LongType())
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op], T.LongType())

    def text(self, x: Typed) -> Column:
        c = F.lit("NULL").cast("string") if x.kind == "null" and self.s.log else x.column.cast("string")
        if x.kind == "double":
            c = plain_double(x.column)
        return F.coalesce(c, F.lit("NULL")) if self.s.log else c

    def compare(self, op: str, a: Typed, b: Typed) -> Column:
        x, y = a.column, b.column
        kinds = {a.kind, b.kind}
        if "null" not in kinds and a.kind != b.kind and kinds != {"long", "double"}:
            if kinds <= {"long", "double", "time"}:
                x, y = (F.unix_millis(c.cast("timestamp")) if k == "time" else c for c, k in ((x, a.kind), (y, b.kind)))
            elif "str" in kinds and op in ("=", "<>"):
                x, y = self.text(a), self.text(b)
            elif kinds == {"str", "time"} and not self.s.log:
                x, y = (c.cast("timestamp") if k == "str" else c for c, k in ((x, a.kind), (y, b.kind)))
            else:  # kinds are static, so their order decides
                less = F.lit(_RANK[a.kind] < _RANK[b.kind])
                known = {"<": less, "<=": less, ">": ~less, ">=": ~less, "=": F.lit(False), "<>": F.lit(True)}[op]
                return known if self.s.log else F.when(x.isNotNull() & y.isNotNull(), known)
        plain = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if not self.s.log:
            return plain
        null_x, null_y = x.isNull(), y.isNull()
        nulls = {"=": null_x & null_y, "<>": null_x != null_y, "<": null_x & ~null_y, ">": ~null_x & null_y, "<=": null_x, ">=": null_y}[op]
        return F.when(null_x | null_y, nulls).otherwise(plain)

    def case(self, e: Case, seen: frozenset[str]) -> Typed:
        operand = self.expr(e.operand, seen) if e.operand is not None else None
        whens = [(self.binary("=", operand, self.expr(c, seen)).column if operand else self.condition(c, seen), self.expr(v, seen)) for c, v in e.whens]
        last = self.expr(e.otherwise, seen) if e.otherwise is not None else None
        types = [v.type for _, v in whens] + ([last.type] if last else [])
        kinds = {Typed(F.lit(None), t).kind for t in types} - {"null"}
        target = types[0] if len(kinds) == 1 and not isinstance(types[0], T.NullType) else T.DoubleType() if kinds == {"long", "double"} else T.StringType() if kinds else T.NullType()
        if len(kinds) == 1:
            target = next(t for t in types if not isinstance(t, T.NullType))
        out = None
        for c, v in whens:
            value = v.column.cast(target)
            out = F.when(c, value) if out is None else out.when(c, value)
        return Typed(out.otherwise(last.column.cast(target)) if last else out, target)

    def call(self, e: Call, seen: frozenset[str]) -> Typed:
        if e.name != "DATE":
            raise SqlError(f"unknown function {e.name}")
        if len(e.args) != 2 or e.distinct:
            raise SqlError("DATE takes a format and a value")
        fmt = e.args[0]
        if isinstance(fmt, Name):
            fmt = Literal(fmt.name)
        if not isinstance(fmt, Literal) or not isinstance(fmt.value, str):
            raise SqlError("the format of DATE must be a literal")
        x = self.expr(e.args[1], seen)
        if x.kind == "time":
            return Typed(x.column.cast("timestamp"), T.TimestampType())
        if x.kind not in ("str", "null"):
            raise SqlError("DATE needs a text or a time")
        try:
            return Typed(timefmt.parse_time(x.column.cast("string"), fmt.value, self.s.default_year), T.TimestampType())
        except ValueError as error:
            raise SqlError(str(error)) from None

    def aggregate(self, e: Call, seen: frozenset[str]) -> Typed:
        name, log = e.name.lower(), self.s.log
        if name == "count" and not e.distinct and (not e.args or isinstance(e.args[0], Star)):
            return Typed(F.count(F.lit(1)), T.LongType())
        if len(e.args) != 1 or isinstance(e.args[0], Star):
            raise SqlError(f"{e.name} takes one argument")
        if has_aggregate(e.args[0], self.s.aliases, seen):
            raise SqlError("aggregates can't be nested")
        if e.distinct and name != "count":
            raise SqlError(f"DISTINCT is not supported in {e.name}")
        arg = e.args[0]
        # DISTINCT may also be written as a call: count(distinct(x))
        if name == "count" and isinstance(arg, Call) and arg.name.lower() == "distinct" and len(arg.args) == 1:
            return self.aggregate(Call(e.name, arg.args, True), seen)
        x = self.expr(arg, seen)
        c = x.column
        if name == "count":
            if e.distinct:
                return Typed(F.count_distinct(F.struct(c)) if log else F.count_distinct(c), T.LongType())
            return Typed(F.count(F.lit(1)) if log else F.count(c), T.LongType())
        if name in ("sum", "avg") and x.kind not in ("long", "double", "null"):
            raise SqlError(f"{e.name} needs numbers")
        if name == "sum":
            kind = T.LongType() if x.kind == "long" else T.DoubleType()
            total = F.sum(c.cast(kind))
            return Typed(F.coalesce(total, F.lit(0).cast(kind)) if log else total, kind)
        if name == "avg":
            if log:
                return Typed(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)) / F.count(F.lit(1)), T.DoubleType())
            return Typed(F.avg(c), T.DoubleType())
        if name == "min" and log:
            return Typed(F.when(F.count_if(c.isNull()) == 0, F.min(c)), x.type)
        return Typed(F.min(c) if name == "min" else F.max(c), x.type)


def _nonzero(y: Column, kind: str) -> Column:
    """A divisor that is an error where it is 0, whatever the session's ANSI setting; doubles too."""
    return F.when(y == 0, F.raise_error(F.lit("division by zero")).cast(kind)).otherwise(y)


def plain_double(c: Column) -> Column:
    """A double's text without exponent and without a trailing ``.0``."""
    finite = F.abs(c) < F.lit(float("inf"))
    return F.when(finite, F.regexp_replace(F.call_function("format_number", c, F.lit("0.#################")), "^-0$", "0")).otherwise(c.cast("string"))


@dataclass
class Compiled:
    select: Select
    semantics: str
    default_year: int | None

    def __call__(self, df: DataFrame, scope: str = "global", order_column: str | None = None) -> DataFrame:
        if scope == "batch" and "_batch" not in df.columns:
            raise SqlError("batch scope needs a _batch column")
        return _run(self, df, scope, order_column or ("_seq" if "_seq" in df.columns else None))


def compile_query(query: str | Select, table: str | None = None, semantics: str = "sql", default_year: int | None = None) -> Compiled:
    """A query that can be run on any DataFrame with the columns it names.  ``table``: the name FROM must have."""
    if semantics not in ("sql", "log"):
        raise ValueError("semantics must be 'sql' or 'log'")
    select = parse(query) if isinstance(query, str) else query
    if table is not None and select.table is not None and select.table.lower() != table.lower():
        raise SqlError(f"unknown table {select.table}")
    return Compiled(select, semantics, default_year)


def _item_names(items: tuple[Item, ...]) -> list[str]:
    return [i.alias or (i.expr.name if isinstance(i.expr, Name) else str(n + 1)) for n, i in enumerate(items)]


def _expand(q: Select, df: DataFrame) -> Select:
    items: list[Item] = []
    for i in q.items:
        if isinstance(i.expr, Star):
            items += [Item(Name(c), c) for c in df.columns if c not in HIDDEN]
        else:
            items.append(i)
    return replace(q, items=tuple(items))


def _ordinal(e: Expr, n: int, what: str) -> int | None:
    """0-based item that an ordinal means, None for other expressions."""
    if isinstance(e, (Literal, Unary, Binary)):
        try:
            k = fold_int(e, what)
        except SqlError:
            return None
        if not 1 <= k <= n:
            raise SqlError(f"{what} {k} is not in the SELECT list")
        return k - 1
    return None


def _run(compiled: Compiled, df: DataFrame, scope: str, order_column: str | None) -> DataFrame:
    q = compiled.select
    limit = fold_int(q.limit, "LIMIT") if q.limit is not None else None
    offset = fold_int(q.offset, "OFFSET") if q.offset is not None else 0
    if (limit is not None and limit < 0) or offset < 0:
        raise SqlError("LIMIT and OFFSET can't be negative")
    starred = any(isinstance(i.expr, Star) for i in q.items)
    q = _expand(q, df)
    names = _item_names(q.items)
    if len(set(names)) < len(names):
        raise SqlError(f"duplicate output names: {sorted({n for n in names if names.count(n) > 1})}")
    aliases = {i.alias: i.expr for i in q.items if i.alias is not None}
    s = _Scope(df, aliases, compiled.semantics, compiled.default_year)
    c = _Compiler(s)
    batch = scope == "batch"
    aggregated = any(has_aggregate(i.expr) for i in q.items) or (q.having is not None and has_aggregate(q.having, aliases))
    if q.where is not None:
        if has_aggregate(q.where, aliases):
            raise SqlError("aggregates are not allowed in WHERE")
        df = df.where(c.condition(q.where))
    if q.group_by and not aggregated and not q.distinct:
        raise SqlError("GROUP BY without an aggregate")
    if starred and aggregated:
        raise SqlError("* can't be selected beside an aggregate")
    seen = [frozenset([i.alias]) if i.alias else frozenset() for i in q.items]
    values = [c.expr(i.expr, v) for i, v in zip(q.items, seen)]
    out = [F.col(f"`{n}`") for n in names]
    if aggregated:
        keys = [n for n, i in enumerate(q.items) if not has_aggregate(i.expr, aliases, seen[n])]
        grouped = set()
        for g in q.group_by:
            k = _ordinal(g, len(names), "GROUP BY")
            if k is None:
                k = next((n for n, i in enumerate(q.items) if i.expr == g or (isinstance(g, Name) and names[n] == g.name)), None)
                if k is None:
                    raise SqlError("GROUP BY must name items of the SELECT list")
            if has_aggregate(q.items[k].expr):
                raise SqlError("GROUP BY names an aggregate")
            grouped.add(k)
        if missing := [names[k] for k in keys if k not in grouped]:
            raise SqlError(f"not in GROUP BY: {', '.join(missing)}")
        rest = [n for n in range(len(names)) if n not in keys]
        key_columns = [values[k].column.alias(f"__k{k}") for k in keys] + ([F.col("_batch")] if batch else [])
        aggs = [values[n].column.alias(f"__a{n}") for n in rest]
        if q.having is not None:
            aggs.append(c.condition(q.having).alias("__having"))
        if order_column is not None:
            aggs.append(F.min(order_column).alias("__first"))
        if compiled.semantics == "log" and not keys:
            aggs.append(F.count(F.lit(1)).alias("__rows"))
        df = df.groupBy(*key_columns).agg(*aggs)
        if q.having is not None:
            df = df.where("__having")
        if "__rows" in df.columns:
            df = df.where("__rows > 0")
        values = [Typed(F.col(f"__k{n}" if n in keys else f"__a{n}"), v.type) for n, v in enumerate(values)]
        order_column = "__first" if order_column is not None else None
    elif q.having is not None:
        raise SqlError("HAVING without an aggregate")
    if q.distinct and not aggregated:
        keyed = df.select(*[v.column.alias(n) for v, n in zip(values, names)], *(["_batch"] if batch else []))
        df = keyed.distinct()
        values = [Typed(x, v.type) for x, v in zip(out, values)]
        order_column = None
    orders = []
    for o in q.order_by:
        k = _ordinal(o.expr, len(names), "ORDER BY")
        if k is None and isinstance(o.expr, Name) and o.expr.name in names:
            k = names.index(o.expr.name)
        if k is None:
            k = next((n for n, i in enumerate(q.items) if i.expr == o.expr), None)
        if k is None and (aggregated or q.distinct):
            raise SqlError("ORDER BY must name items of the SELECT list")
        column = values[k].column if k is not None else c.expr(o.expr).column
        first = o.nulls_first if o.nulls_first is not None else not o.descending
        orders.append({(False, True): column.asc_nulls_first, (False, False): column.asc_nulls_last, (True, True): column.desc_nulls_first, (True, False): column.desc_nulls_last}[o.descending, first]())
    bounded = limit is not None or offset
    ties = [F.col(order_column)] if order_column is not None and order_column in df.columns else []
    if batch:
        if bounded:
            by = [*orders, *ties] or [F.lit(0)]
            df = df.withColumn("__n", F.row_number().over(Window.partitionBy("_batch").orderBy(*by)))
            df = df.where(F.col("__n") > offset)
            if limit is not None:
                df = df.where(F.col("__n") <= offset + limit)
        if orders:
            df = df.orderBy("_batch", *orders, *ties)
        return df.select(*[v.column.alias(n) for v, n in zip(values, names)], *(["_batch"] if "_batch" not in names else []))
    if orders or (bounded and ties):
        df = df.orderBy(*orders, *ties)
    df = df.select(*[v.column.alias(n) for v, n in zip(values, names)])
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def run_query(df: DataFrame, query: str, semantics: str = "sql", scope: str = "global", default_year: int | None = None, table: str | None = None) -> DataFrame:
    return compile_query(query, table, semantics, default_year)(df, scope)
