"""Relational tables as virtual quads: a row is a subject, its columns are literals and its keys links.

Patterns on one subject whose predicates belong to one table become a single projection of that table
(star collapse), optional ones too. Subjects stay keys under a static IRI template until they are printed, so joins compare integers.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.runtime import table
from quadloom.sparql.algebra import BGP, LeftJoin, Pattern
from quadloom.sparql.frame import Frame, union
from quadloom.terms import IRI, IRI_KIND, NT, RDF_TYPE, Kind, Lit, Var

COLUMN, LINK, ROW, GRAPH = "urn:c:", "urn:r:", "urn:t:", "urn:g:"
_TYPES = {"int": "xsd:int", "bigint": "xsd:long", "double": "xsd:double", "float": "xsd:float", "timestamp": "xsd:dateTime", "timestamp_ntz": "xsd:dateTime", "string": "xsd:string", "boolean": "xsd:boolean", "date": "xsd:date"}


@dataclass
class Table:
    """A mapped table: its key columns, and links as (target table, expression of the target's key)."""

    name: str
    keys: tuple[str, ...]
    links: dict[str, tuple[str, Callable[[], Column]]] = field(default_factory=dict)

    @property
    def template(self) -> str:
        return f"{ROW}{self.name}/"

    @property
    def cls(self) -> str:
        return ROW + self.name.capitalize()

    def key(self) -> Column:
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.concat_ws("-", *self.keys)


class MappedSource:
    """Virtual quads over the tables of a data folder. The default graph holds everything; ``urn:g:<table>`` repeats a table."""

    def __init__(self, spark: SparkSession, tables: list[Table], load: Callable[[str], DataFrame]):
        self.spark, self.tables, self._load, self._cache = spark, {t.name: t for t in tables}, load, {}

    def load(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def literals(self, t: Table) -> dict[str, str]:
        return {c: _TYPES[k] for c, k in self.load(t.name).dtypes if k in _TYPES}

    # candidates
    def _graph_tables(self, graph) -> list[Table]:
        if isinstance(graph, IRI):
            name = graph.value.removeprefix(GRAPH)
            return [self.tables[name]] if graph.value.startswith(GRAPH) and name in self.tables else []
        return list(self.tables.values())

    def _fits(self, t: Table, p: Pattern) -> bool:
        if isinstance(p.s, IRI) and not p.s.value.startswith(t.template):
            return False
        if isinstance(p.p, Var):
            return True
        iri = p.p.value
        if iri == RDF_TYPE:
            return not isinstance(p.o, IRI) or p.o.value == t.cls
        if iri.startswith(COLUMN):
            return iri[len(COLUMN) :] in self.literals(t)
        return iri.startswith(LINK) and iri[len(LINK) :] in t.links

    def star(self, patterns: list[Pattern], graph, ranges: dict | None = None) -> list[Frame]:
        """Frames that together answer patterns of one subject."""
        tables = self._graph_tables(graph)
        fits = [{t.name for t in tables if self._fits(t, p)} for p in patterns]
        both = set.intersection(*fits)
        fixed = all(not isinstance(p.p, Var) for p in patterns)
        if fixed and len(both) == 1 or len(patterns) == 1:
            names = sorted(both)
            if not names:
                return [self._nothing(patterns, graph)]
            parts = [self._one(self.tables[n], patterns, graph) for n in names]
            out = parts[0]
            for p in parts[1:]:
                out = union(out, p)
            return [out]
        if fixed and both and len(both) < len(fits[0] | set().union(*fits)):
            parts = [self._one(self.tables[n], patterns, graph) for n in sorted(both)]
            out = parts[0]
            for p in parts[1:]:
                out = union(out, p)
            return [out]
        return [f for p in patterns for f in self.star([p], graph)]

    def _nothing(self, patterns: list[Pattern], graph) -> Frame:
        names = {x.name for p in patterns for x in (p.s, p.p, p.o) if isinstance(x, Var)} | ({graph.name} if isinstance(graph, Var) else set())
        schema = ", ".join(f"`{n}` string" for n in sorted(names)) or "`__none` string"
        return Frame(self.spark.createDataFrame([], schema), {n: NT for n in names})

    def _bound(self, t: Table, patterns: list[Pattern], unpivoted: bool = False) -> tuple[dict[str, Kind], dict[str, Column], list[Column]]:
        """What the patterns of one subject bind over the rows of a table: kinds and expressions of variables, and conditions."""
        kinds, columns, conditions = {}, {}, []
        numbers = dict(self.load(t.name).dtypes).get(t.keys[0]) != "string"

        def bind(term, kind: Kind, c: Column) -> None:
            if isinstance(term, Var):
                if term.name in columns:
                    k, old = kinds[term.name], columns[term.name]
                    conditions.append(old == c if k.same(kind) else terms.text(k, old) == terms.text(kind, c))
                else:
                    kinds[term.name], columns[term.name] = kind, c
                conditions.append(c.isNotNull())
            elif kind.sort == "nt":
                conditions.append(c == F.lit(terms.canonical(term)))
            elif kind.sort == "iri":
                if not isinstance(term, IRI) or not term.value.startswith(kind.template):
                    conditions.append(F.lit(False))
                else:
                    rest = term.value[len(kind.template) :]
                    numeric = numbers and kind.template and len(self._keys(kind)) == 1
                    conditions.append(c == F.lit(int(rest)) if numeric and rest.lstrip("-").isdigit() else c.cast("string") == F.lit(rest))
            elif isinstance(term, Lit) and kind.dt in terms.NATIVE:
                same = term.dt == kind.dt or {term.dt, kind.dt} <= terms.NUMERICS
                conditions.append(c == F.lit(term.lex).try_cast(terms.NATIVE[kind.dt]) if same and not term.lang else F.lit(False))
            else:
                conditions.append(F.lit(False))

        if unpivoted:
            p = patterns[0]
            bind(p.s, Kind("iri", template=t.template), F.col("__s"))
            bind(p.p, IRI_KIND, F.col("__p"))
            bind(p.o, NT, F.col("__o"))
            return kinds, columns, conditions
        literal = self.literals(t)
        for p in patterns:
            bind(p.s, Kind("iri", template=t.template), t.key())
            iri = p.p.value
            if iri == RDF_TYPE:
                if isinstance(p.o, Var):
                    bind(p.o, IRI_KIND, F.lit(t.cls))
            elif iri.startswith(COLUMN):
                c = iri[len(COLUMN) :]
                bind(p.o, Kind("lit", literal[c]), F.col(c).cast("timestamp") if literal[c] == "xsd:dateTime" else F.col(c))
            else:
                target, link = t.links[iri[len(LINK) :]]
                bind(p.o, Kind("iri", template=f"{ROW}{target}/"), link())
        return kinds, columns, conditions

    def _one(self, t: Table, patterns: list[Pattern], graph) -> Frame:
        """One scan of a table for all patterns."""
        df = self.load(t.name)
        wild = [p for p in patterns if isinstance(p.p, Var)]
        if wild:
            df = self._unpivot(t)
        kinds, columns, conditions = self._bound(t, wild[:1] or patterns, bool(wild))
        if isinstance(graph, Var):
            kinds[graph.name], columns[graph.name] = Kind("iri", template=GRAPH), F.lit(t.name)
        for c in conditions:
            df = df.where(c)
        return Frame(df.select(*[c.alias(n) for n, c in columns.items()]) if columns else df.select(F.lit(1).alias("__one")), kinds)

    def optional_star(self, node: LeftJoin, graph, condition: Callable[[dict[str, Kind], Any], Column]) -> Frame | None:
        """A tree of optional patterns about one subject as one scan of its table, or null if that can't be.

        Rows have a subject of their own and at most one value for a predicate, so an optional part is its columns where
        all of its conditions hold, and null elsewhere. ``condition`` compiles a filter over variables of known kinds.
        """
        leaves: list[list[Pattern]] = []

        def collect(n) -> bool:
            if isinstance(n, BGP):
                leaves.append(n.patterns)
                return bool(n.patterns)
            return isinstance(n, LeftJoin) and collect(n.left) and collect(n.right)

        if isinstance(graph, (Var, list)) or not collect(node):
            return None
        every = [p for leaf in leaves for p in leaf]
        subject = every[0].s
        if not isinstance(subject, Var) or any(p.s != subject or not isinstance(p.p, IRI) or p.o == subject for p in every):
            return None
        tables = self._graph_tables(graph)
        fits = [{t.name for t in tables if self._fits(t, p)} for p in leaves[0]]
        home = set.intersection(*fits)
        if len(home) != 1:
            return None
        t = self.tables[home.pop()]
        if not all(self._fits(t, p) for p in every):
            return None
        own = [{p.o.name for p in leaf if isinstance(p.o, Var)} for leaf in leaves]
        if sum(map(len, own)) != len(set().union(*own)):
            return None  # a variable of two parts
        bound = [self._bound(t, leaf) for leaf in leaves]
        df = self.load(t.name)
        kinds, columns, conditions = bound[0]
        for c in conditions:
            df = df.where(c)
        met = lambda cs: functools.reduce(lambda a, b: a & b, cs, F.lit(True))
        hidden = [met(cs).alias(f"__met{i}") for i, (_, _, cs) in enumerate(bound) if i]
        values = [c.alias(n) for i, (_, cs, _) in enumerate(bound) for n, c in cs.items() if i == 0 or n != subject.name]
        df = df.select(*values, *hidden)
        kinds = dict(kinds)
        for i, (ks, _, _) in enumerate(bound):
            kinds.update({n: k.unbound(i > 0) for n, k in ks.items() if i == 0 or n != subject.name})
        number = iter(range(len(leaves)))

        def attach(df: DataFrame, n, outside: Column) -> tuple[DataFrame, Column, set[str]]:
            """``df`` with the variables of a part null where it isn't met; whether it is met; its variables."""
            if isinstance(n, BGP):
                i = next(number)
                return df, outside & F.coalesce(F.col(f"__met{i}"), F.lit(False)) if i else outside, own[i] | {subject.name}
            df, left, mine = attach(df, n.left, outside)
            df, right, new = attach(df, n.right, left)
            if n.condition is not None:  # sees the variables of its two sides only
                right = right & F.coalesce(condition({v: k for v, k in kinds.items() if v in mine | new}, n.condition), F.lit(False))
            flag = f"__ok{len(df.columns)}"
            df = df.withColumn(flag, right)
            df = df.withColumns({v: F.when(F.col(flag), F.col(f"`{v}`")) for v in sorted(new - {subject.name})})
            return df, left, mine | new

        df, _, _ = attach(df, node, F.lit(True))
        return Frame(df.select(*[f"`{n}`" for n in kinds]), kinds)

    def _keys(self, kind: Kind) -> tuple[str, ...]:
        return self.tables[kind.template[len(ROW) : -1]].keys if kind.template.startswith(ROW) else ("",)

    def _unpivot(self, t: Table, keys: DataFrame | None = None) -> DataFrame:
        """(__s, __p, __o) with all quads of a table, or of its rows with some keys (__k text), in one pass; null cells are absent."""
        items = [(RDF_TYPE, F.lit(f"<{t.cls}>"))]
        for c, dt in self.literals(t).items():
            value = F.col(c).cast("timestamp") if dt == "xsd:dateTime" else F.col(c)
            items.append((COLUMN + c, terms.text(Kind("lit", dt), value)))
        for name, (target, link) in t.links.items():
            items.append((LINK + name, terms.text(Kind("iri", template=f"{ROW}{target}/"), link())))
        pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in items])
        rows = self.load(t.name)
        if keys is not None:
            rows = rows.join(keys, t.key().cast("string") == F.col("__k"), "left_semi")
        return rows.select(t.key().alias("__s"), F.explode(pairs).alias("x")).where("x.o is not null").select("__s", F.col("x.p").alias("__p"), F.col("x.o").alias("__o"))

    def about(self, subjects: DataFrame) -> DataFrame:
        """(s, p, o) of subjects (s): rows are found by their keys before they are taken apart."""
        out = None
        for t in self.tables.values():
            start = "<" + t.template
            keys = subjects.where(F.col("s").startswith(start)).select(F.substring("s", len(start) + 1, 1_000_000).alias("k")).select(F.regexp_replace("k", ">$", "").alias("__k"))
            rows = self._unpivot(t, keys).select(terms.text(Kind("iri", template=t.template), F.col("__s")).alias("s"), terms.text(IRI_KIND, F.col("__p")).alias("p"), F.col("__o").alias("o"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def quads(self) -> DataFrame:
        """(g, s, p, o) in canonical text: each table in its graph, and all in the default graph."""
        out = None
        for t in self.tables.values():
            rows = self._unpivot(t).select(F.lit(f"<{GRAPH}{t.name}>").alias("g"), terms.text(Kind("iri", template=t.template), F.col("__s")).alias("s"), terms.text(IRI_KIND, F.col("__p")).alias("p"), F.col("__o").alias("o"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def graphs(self) -> DataFrame:
        return self.spark.createDataFrame([(GRAPH + n,) for n in sorted(self.tables)], "g string")

    def nodes(self, graph) -> Frame:
        """All subjects and objects of a graph."""
        a = [self._one(t, [Pattern(Var("n"), Var("__p1"), Var("__o1"))], graph if isinstance(graph, IRI) else None) for t in self._graph_tables(graph)]
        out = None
        for f in a:
            both = f.df.select(F.explode(F.array(terms.text(f.kinds["n"], F.col("n")), F.col("__o1"))).alias("n"))
            out = both if out is None else out.unionByName(both)
        return Frame(out.distinct(), {"n": NT})


def warehouse(spark: SparkSession, sf_dir: str) -> MappedSource:
    """The trade tables of a data folder with their foreign keys, and the synthetic links of events and nations."""
    fk = lambda c: (lambda: F.col(c))
    tables = [
        Table("region", ("r_regionkey",)),
        Table("nation", ("n_nationkey",), {"n_regionkey": ("region", fk("n_regionkey")), "next": ("nation", lambda: (F.col("n_nationkey") + 1) % 25)}),
        Table("customer", ("c_custkey",), {"c_nationkey": ("nation", fk("c_nationkey"))}),
        Table("supplier", ("s_suppkey",), {"s_nationkey": ("nation", fk("s_nationkey"))}),
        Table("part", ("p_partkey",)),
        Table("orders", ("o_orderkey",), {"o_custkey": ("customer", fk("o_custkey"))}),
        Table("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), {c: (t, fk(c)) for c, t in (("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier"))}),
        Table("events", ("event_id",), {"user_id": ("customer", fk("user_id")), "self": ("events", fk("user_id")), "parent": ("events", lambda: F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)))}),
        Table("documents", ("doc_id",)),
        Table("images", ("image_id",)),
    ]
    return MappedSource(spark, tables, lambda name: table(spark, sf_dir, name))
