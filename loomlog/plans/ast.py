"""Syntax tree of the restricted SELECT."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: bool | int | float | str | None


@dataclass(frozen=True)
class Name(Expr):
    name: str


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # - + NOT
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool
    ignore_case: bool


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    type_name: str
    safe: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str | None
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None
    distinct: bool = False
    options: dict = field(default_factory=dict, compare=False)
