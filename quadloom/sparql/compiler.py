"""Algebra to DataFrames."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.functions.expressions import Scope, sort_keys
from quadloom.runtime import cut, release
from quadloom.sparql import algebra as A
from quadloom.sparql.frame import Frame, common_kind, join, union
from quadloom.spatial.index import near
from quadloom.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, INTEGERS, IRI, NT, NUMERICS, STRING, Kind, Lit, Var

_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def conjuncts(e: Any) -> list[Any]:
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, A.Call) and e.name == "&&" else [e]


def parts(e: Any, kind: type) -> list[Any]:
    """Nodes of a kind inside an expression."""
    if isinstance(e, kind):
        return [e]
    if isinstance(e, A.Aggregate):
        return parts(e.arg, kind)
    return [x for a in e.args for x in parts(a, kind)] if isinstance(e, A.Call) else []


def variables_of(e: Any) -> set[str]:
    """Variables of an expression, those of its EXISTS patterns included."""
    inside = {n for x in parts(e, A.Exists) for n in A.mentioned(x.pattern)}
    return inside | {v.name for v in parts(e, Var)}


class Compiler:
    def __init__(self, source, functions: dict | None = None):
        self.source, self.spark = source, source.spark
        self.functions = functions or {}
        self.base, self.named = None, None  # dataset clauses
        self.count = itertools.count()
        self.outer: list[Frame] = []  # rows outside of the EXISTS being compiled

    def scope(self, kinds: dict[str, Kind], computed: dict | None = None) -> Scope:
        return Scope(kinds, computed, self.functions)

    def fresh(self, stem: str) -> str:
        return f"__{stem}{next(self.count)}"

    # patterns
    def pattern(self, node: Any, graph: Any = None) -> Frame:
        match node:
            case A.BGP(patterns):
                return self.bgp(patterns, graph, {})
            case A.Join(a, b):
                return join(self.pattern(a, graph), self.pattern(b, graph))
            case A.LeftJoin() if (f := self.optional_star(node, graph)) is not None:
                return f
            case A.LeftJoin(a, b, None):
                return join(self.pattern(a, graph), self.pattern(b, graph), "left")
            case A.LeftJoin(a, b, condition):
                return self.optional(a, b, condition, graph)
            case A.Union(a, b):
                return union(self.pattern(a, graph), self.pattern(b, graph))
            case A.Minus(a, b):
                return self.minus(self.pattern(a, graph), self.pattern(b, graph))
            case A.Filter(condition, inner):
                return self.filtered(condition, inner, graph)
            case A.Extend(inner, var, expr):
                f = self.pattern(inner, graph)
                return self.extend(f, var.name, expr, graph=graph)
            case A.Graph(g, inner):
                return self.in_graph(g, inner)
            case A.Values(names, rows):
                return self.values(names, rows)
            case A.Sub(query):
                outer, self.outer = self.outer, []  # a sub-query doesn't see variables from outside
                f = self.select(query, graph)
                self.outer = outer
                return f.pick([n for n in f.kinds if not n.startswith("__")])
        raise NotImplementedError(type(node).__name__)

    def unit(self) -> Frame:
        return Frame(self.spark.range(1).select(F.lit(1).alias("__one")), {})

    def in_graph(self, g: Any, inner: Any) -> Frame:
        if isinstance(g, IRI):
            if self.named is not None and g.value not in self.named:
                f = self.pattern(inner, g)
                return Frame(f.df.where(F.lit(False)), f.kinds)
            return self.pattern(inner, g)
        f = self.pattern(inner, g)
        if g.name not in f.kinds:  # a group without patterns: all graphs
            graphs = Frame(self.source.graphs().withColumnRenamed("g", g.name), {g.name: terms.IRI_KIND})
            f = join(f, graphs)
        if self.named is not None:
            f = Frame(f.df.where(terms.lexical(f.kinds[g.name], F.col(f"`{g.name}`")).isin(list(self.named))), f.kinds)
        return f

    def bgp(self, patterns: list[A.Pattern], graph: Any, ranges: dict) -> Frame:
        if not patterns:
            return self.unit()
        if graph is None and self.base is not None:
            graph = [*self.base]
        if isinstance(graph, list) and not hasattr(self.source, "df"):
            out = None
            for g in graph:  # a mapped source: its graphs are disjoint
                f = self.bgp(patterns, IRI(g), ranges)
                out = f if out is None else union(out, f)
            return out if out is not None else self.unit()
        plain = [p for p in patterns if isinstance(p.p, (IRI, Var))]
        stars: dict[Any, list[A.Pattern]] = {}
        for p in plain:
            stars.setdefault(p.s, []).append(p)
        frames = [(self.weight(ps), f) for ps in stars.values() for f in self.source.star(ps, graph, ranges)]
        frames += [(5.0, self.path_pattern(p, graph)) for p in patterns if not isinstance(p.p, (IRI, Var))]
        frames.sort(key=lambda x: x[0])
        out = frames.pop(0)[1]
        while frames:  # connected parts first, those with more constants before others
            at = next((i for i, (_, f) in enumerate(frames) if f.kinds.keys() & out.kinds.keys()), 0)
            out = join(out, frames.pop(at)[1])
        return out

    @staticmethod
    def weight(ps: list[A.Pattern]) -> float:
        constants = sum(not isinstance(t, Var) for p in ps for t in (p.s, p.o) if not (isinstance(p.p, IRI) and p.p.value == terms.RDF_TYPE and t is p.o))
        return -constants - 0.1 * len(ps) + 2 * any(isinstance(p.p, Var) for p in ps)

    def filtered(self, condition: Any, inner: Any, graph: Any) -> Frame:
        ranges: dict[str, list[tuple[str, float]]] = {}
        for c in conjuncts(condition):  # numeric bounds go along to the scan
            if isinstance(c, A.Call) and c.name in _FLIP:
                for a, b, op in ((*c.args, c.name), (*c.args[::-1], _FLIP[c.name])):
                    if isinstance(a, Var) and isinstance(b, Lit) and b.dt in NUMERICS:
                        ranges.setdefault(a.name, []).append((op, float(b.lex)))
        f = self.bgp(inner.patterns, graph, ranges) if isinstance(inner, A.BGP) else self.pattern(inner, graph)
        if isinstance(inner, A.BGP):
            f = self.near_region(f, inner.patterns, condition)
        return self.where(f, condition, graph)

    def near_region(self, f: Frame, patterns: list[A.Pattern], condition: Any) -> Frame:
        """With a tile index, only solutions whose geometry shares a tile with the region of a top-level ``sfIntersects``, on which the exact test follows."""
        index = getattr(self.source, "tiles", None)
        for c in conjuncts(condition) if index is not None else ():
            if not (isinstance(c, A.Call) and c.name == "iri:" + terms.GEOF + "sfIntersects"):
                continue
            shape = [a for a in c.args[:2] if isinstance(a, Var)]
            region = [a for a in c.args[:2] if isinstance(a, Lit)]
            scale = c.args[2] if len(c.args) > 2 else Lit("0", "xsd:integer")
            if len(shape) != 1 or len(region) != 1 or not (isinstance(scale, Lit) and scale.lex.isdigit()) or (len(c.args) > 2 and c.args[1] != region[0]):
                continue
            for p in patterns:
                if p.o == shape[0] and isinstance(p.s, Var) and isinstance(p.p, (IRI, Var)) and f.kinds[p.s.name].sort == "nt":
                    subjects = near(index, region[0].lex, int(scale.lex), terms.canonical(p.p) if isinstance(p.p, IRI) else None)
                    if subjects is not None:
                        f = join(f, Frame(subjects.withColumnRenamed("s", p.s.name), {p.s.name: NT}), "semi")
                    break
        return f

    def where(self, f: Frame, condition: Any, graph: Any = None, computed: dict | None = None) -> Frame:
        computed = dict(computed or {})
        f = self.with_outer(f, variables_of(condition))
        for c in conjuncts(condition):
            if isinstance(c, A.Exists) or (isinstance(c, A.Call) and c.name == "!" and isinstance(c.args[0], A.Exists)):
                e, flip = (c, False) if isinstance(c, A.Exists) else (c.args[0], True)
                f = self.exists(f, e, graph, e.negated != flip)
                continue
            for e in parts(c, A.Exists):
                f, column = self.marked(f, e, graph)
                computed[e] = (BOOLEAN, column)
            f = Frame(f.df.where(self.scope(f.kinds, computed).condition(c)), f.kinds)
        return f

    def with_outer(self, f: Frame, needed: set[str]) -> Frame:
        """``f`` joined with those variables from outside of the EXISTS being compiled that an expression needs and ``f`` lacks."""
        for rows in self.outer:
            lacking = needed & rows.kinds.keys() - f.kinds.keys()
            if lacking:
                some = rows.pick(sorted(lacking | (rows.kinds.keys() & f.kinds.keys())))
                f = join(f, Frame(some.df.distinct(), some.kinds))
        return f

    def inside(self, f: Frame, pattern: Any, graph: Any) -> Frame:
        """A pattern of EXISTS, compiled for the rows of ``f``."""
        self.outer.append(f)
        try:
            return self.pattern(pattern, graph)
        finally:
            self.outer.pop()

    def correlated(self, f: Frame, e: A.Exists, graph: Any) -> tuple[Frame, Any]:
        """The pattern of EXISTS and its top filter if that one needs variables from outside.

        Filters further down that need such variables are joined with their values, as if these had been put in.
        """
        inner = e.pattern
        if isinstance(inner, A.Filter) and not parts(inner.condition, A.Exists):
            body = self.inside(f, inner.pattern, graph)
            if variables_of(inner.condition) & f.kinds.keys() - body.kinds.keys():
                return body, inner.condition
        return self.inside(f, inner, graph), None

    def exists(self, f: Frame, e: A.Exists, graph: Any, negated: bool) -> Frame:
        body, condition = self.correlated(f, e, graph)
        keep = sorted(body.kinds.keys() & (f.kinds.keys() | variables_of(condition)))
        test = None if condition is None else lambda kinds: self.scope(kinds).condition(condition)
        rows = body.pick(keep) if keep else Frame(body.df.select(F.lit(1).alias("__any")), {})
        return join(f, rows, "anti" if negated else "semi", test)

    def marked(self, f: Frame, e: A.Exists, graph: Any) -> tuple[Frame, Column]:
        """``f`` with a column that tells for each row whether EXISTS holds: found for the distinct rows of the variables that matter."""
        body, condition = self.correlated(f, e, graph)
        name = self.fresh("exists")
        outer = sorted(f.kinds.keys() & (body.kinds.keys() | variables_of(condition)))
        copies = {v: f"{name}_{i}" for i, v in enumerate(outer)}
        rows = f.pick(outer) if outer else self.unit()
        rows = Frame(rows.df.distinct().select("*", *[F.col(f"`{v}`").alias(c) for v, c in copies.items()]), rows.kinds)
        rows = Frame(rows.df, {**rows.kinds, **{c: rows.kinds[v] for v, c in copies.items()}})
        keep = sorted(body.kinds.keys() & (f.kinds.keys() | variables_of(condition)))
        inner = body.pick(keep) if keep else Frame(body.df.select(F.lit(1).alias("__any")), {})
        met = join(rows, inner, "semi", None if condition is None else lambda kinds: self.scope(kinds).condition(condition))
        some = met.df.select(*copies.values(), F.lit(True).alias(name))
        if not outer:
            some = some.limit(1)
        on = [F.col(f"`{v}`").eqNullSafe(F.col(c)) for v, c in copies.items()]
        f = Frame(f.df.join(some, on or F.lit(True), "left").drop(*copies.values()), {**f.kinds, name: BOOLEAN})
        column = F.coalesce(F.col(name), F.lit(False))
        return f, ~column if e.negated else column

    def optional_star(self, node: A.LeftJoin, graph: Any) -> Frame | None:
        """Optional parts about the subject of a mapped table without a join, if the source can do that."""

        def plain(n: Any) -> bool:
            return not isinstance(n, A.LeftJoin) or (not parts(n.condition, A.Exists) and plain(n.left) and plain(n.right))

        if not hasattr(self.source, "optional_star") or (graph is None and self.base is not None) or self.outer or not plain(node):
            return None
        return self.source.optional_star(node, graph, lambda kinds, e: self.scope(kinds).condition(e))

    def optional(self, a: Any, b: Any, condition: Any, graph: Any) -> Frame:
        left, right = self.pattern(a, graph), self.pattern(b, graph)
        if not parts(condition, A.Exists):
            right = self.with_outer(right, variables_of(condition) - left.kinds.keys())
            return join(left, right, "left", lambda kinds: self.scope(kinds).condition(condition))
        # EXISTS speaks about rows of both sides: these are numbered, tested, and rows of the left without a match come back
        row = self.fresh("row")
        numbered = cut(left.df.withColumn(row, F.monotonically_increasing_id()))
        left = Frame(numbered, {**left.kinds, row: INTEGER})
        met = self.where(join(left, right), condition, graph)
        met = met.pick([v for v in met.kinds if v == row or not v.startswith("__exists")])
        met = Frame(cut(met.df), met.kinds)
        ids = met.df.select(F.col(row).alias("__r"))
        out = union(met, Frame(left.df.join(ids, F.col(row) == F.col("__r"), "left_anti"), left.kinds))
        return out.pick([v for v in out.kinds if v != row])

    def minus(self, left: Frame, right: Frame) -> Frame:
        shared = sorted(left.kinds.keys() & right.kinds.keys())
        return join(left, right.pick(shared), "anti", overlap=True) if shared else left

    def extend(self, f: Frame, name: str, expr: Any, computed: dict | None = None, graph: Any = None) -> Frame:
        computed = dict(computed or {})
        if not computed:
            f = self.with_outer(f, variables_of(expr))
        for e in parts(expr, A.Exists):
            f, column = self.marked(f, e, graph)
            computed[e] = (BOOLEAN, column)
        kind, c = self.scope(f.kinds, computed).compile(expr)
        return Frame(f.df.withColumn(name, c), {**f.kinds, name: kind.unbound()})

    def values(self, names: list[str], rows: list[list[Any]]) -> Frame:
        kinds, columns = {}, []
        for i, n in enumerate(names):
            cells = [r[i] for r in rows if r[i] is not None]
            known = [terms.literal(t)[0] for t in cells] or [NT]
            kind = known[0]
            for k in known[1:]:
                kind = common_kind(kind, k)
            kinds[n] = kind.unbound(len(cells) < len(rows))
            columns.append(kind)

        def cell(t: Any, kind: Kind) -> Any:
            if t is None:
                return None
            return terms.canonical(t) if kind.sort == "nt" else t.value if isinstance(t, IRI) else t.lex

        data = [tuple(cell(t, k) for t, k in zip(r, columns, strict=True)) for r in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names) or "`__none` string")
        for n, k in zip(names, columns, strict=True):
            if k.sort == "lit":
                df = df.withColumn(n, F.col(f"`{n}`").try_cast(terms.NATIVE[k.dt]))
        return Frame(df, kinds)

    # paths
    def path_pattern(self, p: A.Pattern, graph: Any) -> Frame:
        s, o = self.fresh("s"), self.fresh("o")
        start = p.s if not isinstance(p.s, Var) else None
        f = self.path(p.p, s, o, graph, start, p.o if not isinstance(p.o, Var) else None)
        for name, term in ((s, p.s), (o, p.o)):
            if not isinstance(term, Var):
                f = Frame(f.df.where(terms.text(f.kinds[name], F.col(name)) == terms.canonical(term)).drop(name), {k: v for k, v in f.kinds.items() if k != name})
        if isinstance(p.s, Var) and p.s == p.o:
            f = Frame(f.df.where(terms.text(f.kinds[s], F.col(s)) == terms.text(f.kinds[o], F.col(o))).drop(o), {k: v for k, v in f.kinds.items() if k != o})
        for name, term in ((s, p.s), (o, p.o)):
            if isinstance(term, Var) and name in f.kinds:
                f = Frame(f.df.withColumnRenamed(name, term.name), {term.name if k == name else k: v for k, v in f.kinds.items()})
        return f

    def path(self, path: Any, s: str, o: str, graph: Any, start: Any = None, end: Any = None) -> Frame:
        match path:
            case A.Link(iri):
                return self.bgp([A.Pattern(Var(s), iri, Var(o))], graph, {})
            case A.Inverse(inner):
                return self.path(inner, o, s, graph, end, start).pick([s, o])
            case A.Sequence(a, b):
                m = self.fresh("m")
                return join(self.path(a, s, m, graph, start), self.path(b, m, o, graph, None, end)).pick([s, o])
            case A.Alternative(a, b):
                return union(self.path(a, s, o, graph, start, end), self.path(b, s, o, graph, start, end)).pick([s, o])
            case A.Negated(forward, backward):
                out = None
                for iris, a, b in ((forward, s, o), (backward, o, s)):
                    if iris:
                        p = self.fresh("p")
                        f = self.bgp([A.Pattern(Var(a), Var(p), Var(b))], graph, {})
                        f = Frame(f.df.where(~terms.lexical(f.kinds[p], F.col(p)).isin([i.value for i in iris])), f.kinds).pick([s, o])
                        out = f if out is None else union(out, f)
                return out
            case A.Repeat(inner, sign):
                return self.repeat(inner, sign, s, o, graph, start, end)
        raise NotImplementedError(type(path).__name__)

    def repeat(self, inner: Any, sign: str, s: str, o: str, graph: Any, start: Any, end: Any) -> Frame:
        step = self.path(inner, s, o, graph)
        kind = common_kind(step.kinds[s], step.kinds[o])
        if sign in "*?":
            kind = NT if kind.sort != "nt" else kind
        step = step.with_kind(s, kind).with_kind(o, kind)
        kinds = {s: kind, o: kind}
        edges = step.df.select(F.col(s).alias("a"), F.col(o).alias("b")).distinct()
        fixed = lambda c, t: terms.text(kind, F.col(c)) == terms.canonical(t)
        if sign == "?":
            reach = edges
        else:
            edges = cut(edges)
            # from a fixed end only what can be reached from there
            back = start is None and end is not None
            walk = edges.select(F.col("b").alias("a"), F.col("a").alias("b")) if back else edges
            if start is None and end is None:
                reach = self.closure(edges)
            else:
                reach = self.frontier(walk, fixed("a", end if back else start))
            if back:
                reach = reach.select(F.col("b").alias("a"), F.col("a").alias("b"))
        if sign in "*?":
            end_term = start or end
            same = self.spark.createDataFrame([(terms.canonical(end_term),)], "a string") if end_term is not None else self.source.nodes(graph).df.select(F.col("n").alias("a"))
            reach = reach.unionByName(same.select("a", F.col("a").alias("b"))).distinct()
        return Frame(reach.select(F.col("a").alias(s), F.col("b").alias(o)), kinds)

    @staticmethod
    def closure(edges: DataFrame) -> DataFrame:
        """All pairs (a, b) with a path from a to b, in as many rounds as the longest shortest path has binary digits.

        Each pair carries the length of its shortest path. A round joins the pairs of length 2**k with all pairs of at
        most that length, which gives all up to twice as long, each once for each halfway node of a shortest path.
        Rounds are written next to each other and never copied.
        """
        found = [cut(edges.select("a", "b", F.lit(1).cast("long").alias("d")))]
        for k in itertools.count():
            reach = found[0]
            for x in found[1:]:
                reach = reach.unionByName(x)
            half = found[-1].where(F.col("d") == 1 << k).select(F.col("a").alias("x"), F.col("b").alias("m"))
            ahead = half.join(reach.select(F.col("a").alias("m"), "b", "d"), "m").groupBy(F.col("x").alias("a"), "b").agg((F.min("d") + (1 << k)).alias("d"))
            new = cut(ahead.join(reach.select("a", "b"), ["a", "b"], "left_anti"))
            if new.isEmpty():
                return reach.select("a", "b")
            found.append(new)

    @staticmethod
    def frontier(walk: DataFrame, start: Column) -> DataFrame:
        """The pairs (a, b) with a at the start, level by level; ends, as each round reaches new nodes."""
        new = cut(walk.where(start))
        reach = [new]
        for n in itertools.count(1):
            ahead = new.select(F.col("a").alias("x"), F.col("b").alias("m")).join(walk.select(F.col("a").alias("m"), "b"), "m").select(F.col("x").alias("a"), "b").distinct()
            every = reach[0]
            for x in reach[1:]:
                every = every.unionByName(x)
            new = cut(ahead.join(every, ["a", "b"], "left_anti"))
            if new.isEmpty():
                return every
            reach.append(new)
            if n % 20 == 0:  # unions of long chains stay small
                whole = cut(every.unionByName(new))
                release(*reach[:-1])
                reach = [whole]

    # queries
    def select(self, q: A.Query, graph: Any = None) -> Frame:
        f = self.pattern(q.where, graph)
        computed: dict[Any, Any] = {}
        exprs = [e for _, e in q.select or [] if e is not None] + q.having + [e for e, _ in q.order]
        aggregates = [a for e in exprs for a in parts(e, A.Aggregate)]
        if q.group is not None or aggregates:
            f, computed = self.grouped(f, q.group or [], aggregates, q.group is None)
        for h in q.having:
            f = Frame(f.df.where(self.scope(f.kinds, computed).condition(h)), f.kinds)
        names = [n for n in f.kinds if not n.startswith("__")] if q.select is None else [n for n, _ in q.select]
        for n, e in q.select or []:
            if e is not None:
                f = self.extend(f, n, e, computed, graph)
            elif n not in f.kinds:
                f = Frame(f.df.withColumn(n, F.lit(None).cast("string")), {**f.kinds, n: NT.unbound()})
        keys = [k for e, up in q.order for k in sort_keys(*self.scope(f.kinds, computed).compile(e), up)] if q.order and not q.distinct else []
        if keys:
            f = Frame(f.df.orderBy(*keys), f.kinds)
        f = f.pick(names) if names else f
        if q.distinct:
            f = Frame(f.df.distinct(), f.kinds)
            if q.order:
                keys = [k for e, up in q.order for k in sort_keys(*self.scope(f.kinds).compile(e), up)]
                f = Frame(f.df.orderBy(*keys), f.kinds)
        if q.offset:
            f = Frame(f.df.offset(q.offset), f.kinds)
        if q.limit is not None:
            f = Frame(f.df.limit(q.limit), f.kinds)
        return f

    def grouped(self, f: Frame, group: list, aggregates: list, implicit: bool) -> tuple[Frame, dict]:
        kinds, keys, computed = {}, [], {}
        for name, e in group:
            kind, c = self.scope(f.kinds).compile(e)
            label = name or self.fresh("g")
            kinds[label] = kind.unbound(kind.nullable or not isinstance(e, Var))
            keys.append(c.alias(label))
            computed[e] = (kinds[label], F.col(f"`{label}`")) if name is None else computed.get(e, (kinds[label], F.col(f"`{label}`")))
        made = []
        for a in dict.fromkeys(aggregates):
            label = self.fresh("a")
            kind, c = self.aggregate(f, a)
            made.append(c.alias(label))
            computed[a] = (kind, F.col(label))
            kinds[label] = kind
        if not made:
            df = f.df.select(*keys).distinct()
        else:
            df = f.df.agg(*made) if implicit else f.df.groupBy(*keys).agg(*made)
        return Frame(df, kinds), computed

    def aggregate(self, f: Frame, a: A.Aggregate) -> tuple[Kind, Column]:
        scope = self.scope(f.kinds)
        if a.arg is None:
            if not a.distinct:
                return INTEGER, F.count(F.lit(1))
            every = F.struct(*[F.coalesce(terms.text(k, F.col(f"`{n}`")), F.lit("")).alias(f"c{i}") for i, (n, k) in enumerate(f.kinds.items())])
            return INTEGER, F.count_distinct(every)
        kind, c = scope.compile(a.arg)
        if a.name == "COUNT":
            if a.distinct:
                return INTEGER, F.count_distinct(c)
            return INTEGER, F.count(c)
        if a.name in ("SUM", "AVG"):
            native = kind.sort == "lit" and kind.dt in NUMERICS
            n = c if native else scope.number((kind, c))
            out = kind if native else DOUBLE
            if native and kind.dt in INTEGERS:
                out = INTEGER if a.name == "SUM" else DECIMAL
                n = n.cast("bigint") if a.name == "SUM" else n.cast("decimal(38,18)")
            elif native and kind.dt == "xsd:float":
                out, n = DOUBLE, n.cast("double")
            if a.name == "SUM":
                value = F.sum_distinct(n) if a.distinct else F.sum(n)
            else:
                value = F.sum_distinct(n) / F.count_distinct(n) if a.distinct else F.avg(n)
            value = F.coalesce(value.cast(terms.NATIVE[out.dt]), F.lit(0).cast(terms.NATIVE[out.dt]))
            # an unbound or not numeric input is an error
            return (out, value) if native and not kind.nullable else (out, F.when(F.count(F.lit(1)) == F.count(n), value))
        if a.name in ("MIN", "MAX", "SAMPLE"):
            g = F.max if a.name == "MAX" else F.min
            if kind.sort != "nt":
                return kind.unbound(), g(c)
            key = F.when(c.isNotNull(), F.struct(F.when(c.startswith("_:"), 1).when(c.startswith("<"), 2).otherwise(3).alias("k"), scope.number((kind, c)).alias("n"), terms.lexical(kind, c).alias("l"), c.alias("t")))
            return NT.unbound(), g(key)["t"]
        texts = terms.lexical(kind, c)
        items = F.collect_set(texts) if a.distinct else F.collect_list(texts)
        return STRING, F.array_join(F.sort_array(items), a.separator)

    def frame(self, q: A.Query) -> Frame:
        """The solutions of a SELECT query, with what each column holds."""
        self.dataset(q)
        return self.select(q)

    def dataset(self, q: A.Query) -> None:
        if q.base_graphs or q.named_graphs:
            self.base, self.named = list(q.base_graphs), set(q.named_graphs)

    def run(self, q: A.Query) -> DataFrame:
        self.dataset(q)
        if q.form == "SELECT":
            return self.output(self.select(q))
        if q.form == "ASK":
            f = self.pattern(q.where)
            return f.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        f = self.modified(q) if q.where is not None else self.unit()
        if q.form == "CONSTRUCT":
            return self.construct(f, q.template)
        return self.describe(f, q)

    def modified(self, q: A.Query) -> Frame:
        return self.select(A.Query("SELECT", q.where, None, False, q.group, q.having, q.order, q.limit, q.offset))

    @staticmethod
    def output(f: Frame) -> DataFrame:
        """Literals of a known datatype in its Spark type, IRIs as text, other terms in canonical text."""
        return f.df.select(*[(terms.lexical(k, F.col(f"`{n}`")) if k.sort == "iri" else F.col(f"`{n}`")).alias(n) for n, k in f.kinds.items()])

    def construct(self, f: Frame, template: list[A.Pattern]) -> DataFrame:
        bnodes = sorted({t.name for p in template for t in (p.s, p.p, p.o) if isinstance(t, Var) and t.name.startswith(("__l_", "__b")) and t.name not in f.kinds})
        df = f.df
        if bnodes:
            row = F.md5(F.concat_ws("\x1f", *[F.coalesce(terms.text(k, F.col(f"`{n}`")), F.lit("")) for n, k in f.kinds.items()]))
            df = df.withColumn("__row", row)
        out = None

        def column(t: Any) -> Column:
            if isinstance(t, Var):
                if t.name in f.kinds:
                    return terms.text(f.kinds[t.name], F.col(f"`{t.name}`"))
                if t.name in bnodes:
                    return F.concat(F.lit(f"_:{t.name.strip('_')}x"), F.col("__row"))
                return F.lit(None).cast("string")
            return F.lit(terms.canonical(t))

        for p in template:
            rows = df.select(column(p.s).alias("s"), column(p.p).alias("p"), column(p.o).alias("o"))
            rows = rows.where(F.col("s").isNotNull() & F.col("p").startswith("<") & F.col("o").isNotNull() & ~F.col("s").startswith('"'))
            out = rows if out is None else out.unionByName(rows)
        return out.distinct() if out is not None else self.spark.createDataFrame([], "s string, p string, o string")

    def describe(self, f: Frame, q: A.Query) -> DataFrame:
        """Triples of the resources and, through blank objects, of the blank nodes they reach."""
        named = [t for t in q.describe if t is not None] or [Var(n) for n in f.kinds if not n.startswith("__")]
        roots = None
        for t in named:
            one = f.df.select(terms.text(f.kinds[t.name], F.col(f"`{t.name}`")).alias("s")) if isinstance(t, Var) else self.spark.createDataFrame([(terms.canonical(t),)], "s string")
            roots = one if roots is None else roots.unionByName(one)
        todo = cut(roots.where(F.col("s").isNotNull()).distinct())
        found = seen = None
        for n in itertools.count(1):  # ends, as each round has blank nodes not seen before
            new = cut(self.source.about(todo).distinct())
            found = new if found is None else found.unionByName(new)
            seen = todo if seen is None else seen.unionByName(todo)
            todo = cut(new.where(F.col("o").startswith("_:")).select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti"))
            if todo.isEmpty():
                break
            if n % 20 == 0:  # unions of long chains stay small
                found, seen = cut(found), cut(seen)
        return found.distinct()


