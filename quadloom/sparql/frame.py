"""Solution tables: a DataFrame with one column per variable and what each column holds; joins between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.runtime import cut
from quadloom.terms import NT, Kind


@dataclass
class Frame:
    df: DataFrame
    kinds: dict[str, Kind]

    def col(self, name: str) -> Column:
        return self.df[f"`{name}`"]

    def with_kind(self, name: str, kind: Kind) -> Frame:
        """The column converted to canonical text, or to a whole IRI, if ``kind`` asks for that."""
        have = self.kinds[name]
        if have.same(kind):
            return Frame(self.df, {**self.kinds, name: kind.unbound(have.nullable)})
        c = terms.text(have, F.col(f"`{name}`")) if kind.sort == "nt" else terms.lexical(have, F.col(f"`{name}`"))
        return Frame(self.df.withColumn(name, c), {**self.kinds, name: kind.unbound(have.nullable)})

    def pick(self, names: list[str]) -> Frame:
        return Frame(self.df.select(*[f"`{n}`" for n in names]), {n: self.kinds[n] for n in names})


def common_kind(a: Kind, b: Kind) -> Kind:
    if a.same(b):
        return a
    return terms.IRI_KIND if a.sort == b.sort == "iri" else NT


def align(left: Frame, right: Frame) -> tuple[Frame, Frame]:
    """Both sides with equal kinds for the shared variables."""
    for v in left.kinds.keys() & right.kinds.keys():
        kind = common_kind(left.kinds[v], right.kinds[v])
        left, right = left.with_kind(v, kind), right.with_kind(v, kind)
    return left, right


def union(left: Frame, right: Frame) -> Frame:
    """Bag union; a variable of one side only is unbound on the other."""
    left, right = align(left, right)
    kinds = {}
    for v in left.kinds | right.kinds:
        sides = [f.kinds[v] for f in (left, right) if v in f.kinds]
        kinds[v] = sides[0].unbound(len(sides) < 2 or any(k.nullable for k in sides))
    return Frame(left.df.unionByName(right.df, allowMissingColumns=True), kinds)


def _parts(f: Frame, loose: list[str]) -> list[tuple[frozenset[str], Frame]]:
    """The rows of a frame by which of the variables ``loose`` are bound, with the bound ones; unbound columns are dropped."""
    out = [(frozenset(), f)]
    for v in loose:
        split = []
        for bound, g in out:
            c = F.col(f"`{v}`")
            if not f.kinds[v].nullable:
                split.append((bound | {v}, g))
                continue
            split.append((bound | {v}, Frame(g.df.where(c.isNotNull()), {**g.kinds, v: g.kinds[v].unbound(False)})))
            split.append((bound, Frame(g.df.where(c.isNull()).drop(v), {k: x for k, x in g.kinds.items() if k != v})))
        out = split
    return out


def _apart(left: Frame, right: Frame, how: str, condition, loose: list[str], overlap: bool) -> Frame:
    """A join on variables that may be unbound, as equi-joins between the rows of each side that have the same ones bound."""
    lefts, rights = _parts(left, loose), _parts(right, loose)
    if len(lefts) * len(rights) > 4:  # written once instead of being computed for each part
        left, right = Frame(cut(left.df), left.kinds), Frame(cut(right.df), right.kinds)
        lefts, rights = _parts(left, loose), _parts(right, loose)
    firm = (left.kinds.keys() & right.kinds.keys()) - set(loose)
    kinds = {**left.kinds, **{v: k.unbound(k.nullable or how == "left") for v, k in right.kinds.items() if v not in left.kinds}}
    out = None

    def add(f: Frame) -> None:
        nonlocal out
        out = f if out is None else union(out, f)

    for lb, lf in lefts:
        rest = lf
        for rb, rf in rights:
            if overlap and not firm and not lb & rb:
                continue  # nothing bound in common: MINUS takes nothing away
            mine = rf
            if how in ("semi", "anti"):
                keep = [v for v in rf.kinds if v in lf.kinds] if condition is None else list(rf.kinds)
                mine = rf.pick(keep)
            if how in ("inner", "left"):
                add(join(lf, mine, "inner", condition))
            elif how == "semi":
                add(join(rest, mine, "semi", condition))
            if how != "inner":
                rest = join(rest, mine, "anti", condition)
        if how in ("left", "anti"):
            add(rest)
    if how in ("semi", "anti"):
        kinds = left.kinds
    names = [v for v in kinds if v in out.kinds]
    return Frame(out.df.select(*[f"`{v}`" for v in names]), {v: out.kinds[v] for v in names})


def join(left: Frame, right: Frame, how: str = "inner", condition=None, overlap: bool = False) -> Frame:
    """``inner``, ``left``, ``semi`` or ``anti`` join on compatible shared variables.

    ``condition`` maps the kinds of both sides to an extra column condition. Where a shared variable may be
    unbound on a side, rows are compatible if either is unbound; such a join is taken apart into equi-joins of
    the bound and unbound rows. With ``overlap`` only rows that share a bound variable match, as for MINUS.
    """
    left, right = align(left, right)
    shared = sorted(left.kinds.keys() & right.kinds.keys())
    loose = [v for v in shared if left.kinds[v].nullable or right.kinds[v].nullable]
    if loose:
        return _apart(left, right, how, condition, loose, overlap)
    renamed = right.df
    for v in shared:
        renamed = renamed.withColumnRenamed(v, f"__r_{v}")
    on: Column | None = None
    for v in shared:
        c = F.col(f"`{v}`") == F.col(f"`__r_{v}`")
        on = c if on is None else on & c
    kinds = {**left.kinds, **{v: k for v, k in right.kinds.items() if v not in left.kinds}}
    if condition is not None:
        extra = condition(kinds)
        on = extra if on is None else on & extra
    name = {"inner": "inner", "left": "left_outer", "semi": "left_semi", "anti": "left_anti"}[how]
    if on is None:
        on = F.lit(True)
        if how in ("semi", "anti"):
            renamed = renamed.limit(1)  # whether there is any row decides
    df = left.df.join(renamed, on, name)
    if how in ("semi", "anti"):
        return Frame(df, left.kinds)
    df = df.drop(*[f"__r_{v}" for v in shared])
    return Frame(df, {v: k.unbound(k.nullable or (how == "left" and v not in left.kinds)) for v, k in kinds.items()})
