"""Query algebra and expressions as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quadloom.terms import IRI, Var


# property paths
@dataclass(frozen=True)
class Link:
    iri: IRI


@dataclass(frozen=True)
class Inverse:
    path: Any


@dataclass(frozen=True)
class Sequence:
    left: Any
    right: Any


@dataclass(frozen=True)
class Alternative:
    left: Any
    right: Any


@dataclass(frozen=True)
class Negated:
    forward: tuple[IRI, ...]
    backward: tuple[IRI, ...]


@dataclass(frozen=True)
class Repeat:
    path: Any
    sign: str  # ? + *


@dataclass(frozen=True)
class Pattern:
    s: Any
    p: Any  # IRI, Var or a path
    o: Any


# graph patterns
@dataclass
class BGP:
    patterns: list[Pattern]


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Filter:
    condition: Any
    pattern: Any


@dataclass
class Extend:
    pattern: Any
    var: Var
    expr: Any


@dataclass
class Graph:
    graph: IRI | Var
    pattern: Any


@dataclass
class Values:
    names: list[str]
    rows: list[list[Any]]


@dataclass
class Sub:
    query: Query


# expressions
@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Any  # None for *
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True, eq=False)
class Exists:
    pattern: Any
    negated: bool


@dataclass
class Query:
    form: str  # SELECT ASK CONSTRUCT DESCRIBE
    where: Any = None
    select: list[tuple[str, Any]] | None = None  # (name, expression or None); None for *
    distinct: bool = False
    group: list[tuple[str | None, Any]] | None = None
    having: list[Any] = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    template: list[Pattern] = field(default_factory=list)
    describe: list[Any] = field(default_factory=list)
    base_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)


def variables(node: Any) -> set[str]:
    """Names of the variables a pattern can bind."""
    match node:
        case BGP(patterns):
            return {t.name for p in patterns for t in (p.s, p.p, p.o) if isinstance(t, Var)}
        case Join(a, b) | Union(a, b) | LeftJoin(a, b):
            return variables(a) | variables(b)
        case Minus(a, _):
            return variables(a)
        case Filter(_, p):
            return variables(p)
        case Extend(p, v, _):
            return variables(p) | {v.name}
        case Graph(g, p):
            return variables(p) | ({g.name} if isinstance(g, Var) else set())
        case Values(names, _):
            return set(names)
        case Sub(q):
            return {n for n, _ in q.select} if q.select is not None else variables(q.where)
    return set()


def mentioned(node: Any) -> set[str]:
    """Names of all variables in a pattern, those of its filters, expressions and inner EXISTS included."""

    def of(e: Any) -> set[str]:
        if isinstance(e, Var):
            return {e.name}
        if isinstance(e, Exists):
            return mentioned(e.pattern)
        if isinstance(e, Aggregate):
            return of(e.arg)
        return {n for a in e.args for n in of(a)} if isinstance(e, Call) else set()

    match node:
        case Join(a, b) | Union(a, b) | Minus(a, b):
            return mentioned(a) | mentioned(b)
        case LeftJoin(a, b, c):
            return mentioned(a) | mentioned(b) | of(c)
        case Filter(c, p):
            return mentioned(p) | of(c)
        case Extend(p, v, e):
            return mentioned(p) | {v.name} | of(e)
        case Graph(g, p):
            return mentioned(p) | of(g)
    return variables(node)
