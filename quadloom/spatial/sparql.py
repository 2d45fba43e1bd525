"""geof:sfIntersects and its opposite in queries: always evaluated exactly, whichever argument is the constant."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadloom import terms
from quadloom.spatial import geometry
from quadloom.terms import BOOLEAN, GEOF, Lit


def _text(scope, arg):
    """WKT of an argument; null if it is no literal."""
    if isinstance(arg, Lit):
        return F.lit(arg.lex)
    kind, c = scope.compile(arg)
    return terms.lexical(kind, c) if kind.sort != "nt" else F.when(c.startswith('"'), terms.lexical(kind, c))


def _intersects(scope, args):
    a, b = (_text(scope, x) for x in args[:2])
    if len(args) > 2:  # the region is given at scale 0
        b = geometry.scaled(b, scope.number(scope.compile(args[2])))
    return BOOLEAN, geometry.sf_intersects(a, b)


def _disjoint(scope, args):
    kind, c = _intersects(scope, args)
    return kind, ~c


FUNCTIONS = {GEOF + "sfIntersects": _intersects, GEOF + "sfDisjoint": _disjoint}
