"""SPARQL expressions as Spark columns. An error is null, so the three-valued logic of SQL is SPARQL's."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.sparql import algebra as A
from quadloom.terms import BOOLEAN, DATETIME, DECIMAL, DOUBLE, INTEGER, INTEGERS, IRI_KIND, LANG_STRING, NT, NUMERICS, STRING, XSD, Kind, Lit, Var

Typed = tuple[Kind, Column]
_DECIMAL = "decimal(38,18)"


class Scope:
    """What expressions can see: kinds of the bound columns, columns of aggregates, and computed EXISTS markers."""

    def __init__(self, kinds: dict[str, Kind], computed: dict[Any, Typed] | None = None, extra: dict[str, Callable] | None = None):
        self.kinds, self.computed, self.extra = kinds, computed or {}, extra or {}

    def compile(self, e: Any) -> Typed:
        if e in self.computed:
            return self.computed[e]
        if isinstance(e, Var):
            kind = self.kinds.get(e.name)
            return (kind, F.col(f"`{e.name}`")) if kind else (NT, F.lit(None).cast("string"))
        if isinstance(e, (Lit, terms.IRI, terms.BNode)):
            return terms.literal(e)
        if isinstance(e, A.Call):
            return self.call(e.name, e.args)
        raise NotImplementedError(f"{type(e).__name__} can't stand here")

    # readings of a typed column
    def number(self, t: Typed) -> Column:
        """Double value, null if not numeric."""
        kind, c = t
        if kind.sort == "lit":
            return c.cast("double") if kind.dt in NUMERICS else F.lit(None).cast("double")
        if kind.sort == "nt":
            return F.when(terms.datatype(kind, c).isin(*sorted(NUMERICS)), terms.lexical(kind, c).try_cast("double"))
        return F.lit(None).cast("double")

    def string(self, t: Typed) -> Column:
        """Lexical form of a string literal with or without language, else null."""
        kind, c = t
        if kind.sort == "lit":
            return c if kind.dt == "xsd:string" else F.lit(None).cast("string")
        if kind.sort == "nt":
            return F.when(terms.datatype(kind, c).isin("xsd:string", LANG_STRING), terms.lexical(kind, c))
        return F.lit(None).cast("string")

    def moment(self, t: Typed) -> Column:
        kind, c = t
        if kind.sort == "lit":
            return c if kind.dt == "xsd:dateTime" else c.cast("timestamp") if kind.dt == "xsd:date" else F.lit(None).cast("timestamp")
        if kind.sort == "nt":
            return F.when(terms.datatype(kind, c).isin("xsd:dateTime", "xsd:date"), terms.lexical(kind, c).try_cast("timestamp"))
        return F.lit(None).cast("timestamp")

    def truth(self, t: Typed) -> Column:
        """Effective boolean value; null where it is an error."""
        kind, c = t
        if kind.sort == "lit":
            if kind.dt == "xsd:boolean":
                return c
            if kind.dt in NUMERICS:
                return (c != 0) & ~F.isnan(c.cast("double"))
            return c != "" if kind.dt == "xsd:string" else F.lit(None).cast("boolean")
        if kind.sort == "nt":
            n, lex = self.number(t), terms.lexical(kind, c)
            return F.when(terms.datatype(kind, c) == "xsd:boolean", lex.isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).otherwise(self.string(t) != "")
        return F.lit(None).cast("boolean")

    def condition(self, e: Any) -> Column:
        return self.truth(self.compile(e))

    # comparison
    def compare(self, op: str, a: Typed, b: Typed) -> Column:
        (ka, ca), (kb, cb) = a, b
        ops: dict[str, Callable[[Column, Column], Column]] = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
        f = ops[op]
        if ka.sort == kb.sort == "lit":
            if ka.dt in NUMERICS and kb.dt in NUMERICS:
                exact = {ka.dt, kb.dt} <= INTEGERS | {"xsd:decimal"}
                return f(ca, cb) if exact and ka.dt in INTEGERS and kb.dt in INTEGERS else f(ca.cast(_DECIMAL), cb.cast(_DECIMAL)) if exact else f(ca.cast("double"), cb.cast("double"))
            if ka.dt == kb.dt or {ka.dt, kb.dt} <= {"xsd:date", "xsd:dateTime"}:
                return f(ca, cb)
            return F.lit(None).cast("boolean") if op not in ("=", "!=") else f(terms.text(ka, ca), terms.text(kb, cb))
        if ka.sort == kb.sort == "iri":
            if ka.template == kb.template:
                return f(ca, cb) if op in ("=", "!=") else F.lit(None).cast("boolean")
            return f(terms.text(ka, ca), terms.text(kb, cb)) if op in ("=", "!=") else F.lit(None).cast("boolean")
        cases = [(self.number(a), self.number(b)), (self.moment(a), self.moment(b)), (self.string(a), self.string(b))]
        if op in ("=", "!="):
            same = terms.text(ka, ca) == terms.text(kb, cb)
            out = F.when(same, F.lit(op == "="))
            for x, y in cases[:2]:
                out = out.when(x.isNotNull() & y.isNotNull(), f(x, y))
            return out.when(F.lit(True), F.when(ca.isNotNull() & cb.isNotNull(), F.lit(op != "=")))
        out = F.when(F.lit(False), F.lit(None).cast("boolean"))
        for x, y in cases:
            out = out.when(x.isNotNull() & y.isNotNull(), f(x, y))
        return out

    def arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        known = [k.dt for k, _ in (a, b) if k.sort == "lit"]
        if len(known) < 2 or any(d not in NUMERICS for d in known):
            x, y, kind = self.number(a), self.number(b), DOUBLE
        else:
            (ka, ca), (kb, cb) = a, b
            if "xsd:double" in known:
                kind, to = DOUBLE, "double"
            elif "xsd:float" in known:
                kind, to = Kind("lit", "xsd:float"), "float"
            elif "xsd:decimal" in known or op == "/":
                kind, to = DECIMAL, _DECIMAL
            else:
                kind, to = INTEGER, "bigint"
            x, y = ca.cast(to), cb.cast(to)
        if op == "/":
            c = F.when(y != 0, x / y)
            return kind, c.cast(_DECIMAL) if kind is DECIMAL else c
        c = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y) if kind is INTEGER else {"+": x + y, "-": x - y, "*": x * y}[op]
        return kind, c.cast(_DECIMAL) if kind is DECIMAL else c

    def unify(self, items: list[Typed]) -> tuple[Kind, list[Column]]:
        """One kind for alternatives, canonical text if they differ."""
        known = [k for k, _ in items]
        if all(k.same(known[0]) for k in known):
            return Kind(known[0].sort, known[0].dt, known[0].template, True), [c for _, c in items]
        if all(k.sort == "lit" and k.dt in NUMERICS for k in known):
            return Kind("lit", "xsd:double", nullable=True), [c.cast("double") for _, c in items]
        return NT.unbound(), [terms.text(k, c) for k, c in items]

    # calls
    def call(self, name: str, args: tuple) -> Typed:
        if name.startswith("iri:"):
            return self.by_iri(name[4:], args)
        if name in ("&&", "||"):
            a, b = (self.condition(x) for x in args)
            return BOOLEAN, a & b if name == "&&" else a | b
        if name == "!":
            return BOOLEAN, ~self.condition(args[0])
        if name == "BOUND":
            return BOOLEAN, F.col(f"`{args[0].name}`").isNotNull() if args[0].name in self.kinds else F.lit(False)
        t = [self.compile(a) for a in args]
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return BOOLEAN, self.compare(name, *t)
        if name in ("+", "-", "*", "/"):
            return self.arithmetic(name, *t)
        if name == "IN":
            out = F.lit(False)
            for x in t[1:]:
                out = out | self.compare("=", t[0], x)
            return BOOLEAN, out
        if name == "IF":
            kind, (x, y) = self.unify(t[1:])
            test = self.truth(t[0])
            return kind, F.when(test, x).when(~test, y)
        if name == "COALESCE":
            kind, columns = self.unify(t)
            return kind, F.coalesce(*columns)
        if name == "SAMETERM":
            return BOOLEAN, terms.text(*t[0]) == terms.text(*t[1])
        method = getattr(self, "fn_" + name.lower(), None)
        if method is None:
            raise NotImplementedError(f"function {name}")
        return method(*t)

    def by_iri(self, iri: str, args: tuple) -> Typed:
        if iri in self.extra:
            return self.extra[iri](self, args)
        t = [self.compile(a) for a in args]
        if iri.startswith(XSD):
            return self.cast(iri[len(XSD) :], t[0])
        raise NotImplementedError(f"function <{iri}>")

    def cast(self, to: str, t: Typed) -> Typed:
        kind, c = t
        lex = F.btrim(terms.lexical(kind, c))
        plain = kind.sort == "iri"
        if to == "string":
            return STRING, terms.lexical(kind, c)
        if plain:
            return Kind("lit", f"xsd:{to}"), F.lit(None).cast(terms.NATIVE[f"xsd:{to}"])
        if to == "boolean":
            n = self.number(t)
            return BOOLEAN, F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False).when(n.isNotNull(), n != 0)
        if to in ("integer", "int", "long"):
            n = F.when(lex.isin("true"), F.lit(1)).when(lex.isin("false"), F.lit(0)).cast("bigint")
            whole = kind.sort == "lit" and kind.dt in NUMERICS and kind.dt not in INTEGERS
            number = self.number(t) if kind.sort == "nt" else F.lit(None).cast("double")
            value = c.try_cast("bigint") if whole else F.coalesce(F.when(lex.rlike(r"^[+-]?\d+$"), lex.try_cast("bigint")), number.try_cast("bigint"), n)
            return INTEGER, value
        if to in ("double", "float", "decimal"):
            kind2 = Kind("lit", f"xsd:{to}")
            b = F.when(lex == "true", F.lit("1")).when(lex == "false", F.lit("0")).otherwise(lex)
            return kind2, b.try_cast(terms.NATIVE[kind2.dt])
        if to == "dateTime":
            return DATETIME, c if kind.same(DATETIME) else F.when(lex.rlike(r"^-?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$"), lex.try_cast("timestamp"))
        if to == "date":
            return Kind("lit", "xsd:date"), lex.try_cast("date")
        raise NotImplementedError(f"xsd:{to}")

    # terms
    def fn_str(self, t: Typed) -> Typed:
        return STRING, terms.lexical(*t)

    def fn_lang(self, t: Typed) -> Typed:
        return STRING, terms.language(*t)

    def fn_datatype(self, t: Typed) -> Typed:
        dt = terms.datatype(*t)
        full = F.when(dt.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(dt, 5, 1000))).when(dt.startswith("rdf:"), F.concat(F.lit(terms.RDF), F.substring(dt, 5, 1000))).otherwise(dt)
        return IRI_KIND, F.when(t[1].isNotNull(), full)

    def fn_iri(self, t: Typed) -> Typed:
        return IRI_KIND, terms.lexical(*t)

    fn_uri = fn_iri

    def _is(self, t: Typed, sort: str, prefix: str) -> Typed:
        kind, c = t
        return BOOLEAN, c.startswith(prefix) if kind.sort == "nt" else F.when(c.isNotNull(), F.lit(kind.sort == sort))

    def fn_isiri(self, t: Typed) -> Typed:
        return self._is(t, "iri", "<")

    fn_isuri = fn_isiri

    def fn_isliteral(self, t: Typed) -> Typed:
        return self._is(t, "lit", '"')

    def fn_isblank(self, t: Typed) -> Typed:
        return self._is(t, "bnode", "_:")

    def fn_isnumeric(self, t: Typed) -> Typed:
        return BOOLEAN, F.when(t[1].isNotNull(), self.number(t).isNotNull())

    def fn_strdt(self, a: Typed, b: Typed) -> Typed:
        dt = terms.lexical(*b)
        short = F.when(dt.startswith(XSD), F.concat(F.lit("xsd:"), F.substring(dt, len(XSD) + 1, 1000))).otherwise(F.concat(F.lit("<"), dt, F.lit(">")))
        return NT, F.concat(F.lit('"'), terms.escaped(self.string(a)), F.lit('"^^'), short)

    def fn_strlang(self, a: Typed, b: Typed) -> Typed:
        return NT, F.concat(F.lit('"'), terms.escaped(self.string(a)), F.lit('"@'), F.lower(self.string(b)))

    def fn_bnode(self, *t: Typed) -> Typed:
        label = F.md5(self.string(t[0])) if t else F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
        return NT, F.concat(F.lit("_:b"), label)

    def fn_uuid(self) -> Typed:
        return Kind("iri", template="urn:uuid:"), F.expr("uuid()")

    def fn_struuid(self) -> Typed:
        return STRING, F.expr("uuid()")

    def fn_langmatches(self, a: Typed, b: Typed) -> Typed:
        x, y = F.lower(self.string(a)), F.lower(self.string(b))
        return BOOLEAN, F.when(y == "*", x != "").otherwise((x == y) | x.startswith(F.concat(y, F.lit("-"))))

    # strings
    def keep(self, t: Typed, c: Column) -> Typed:
        """A string like its argument, with its language if it has one."""
        if t[0].sort != "nt":
            return STRING, c
        lang = terms.language(*t)
        return NT, F.concat(F.lit('"'), terms.escaped(c), F.when(lang != "", F.concat(F.lit('"@'), lang)).otherwise(F.lit('"^^xsd:string')))

    def fn_strlen(self, t: Typed) -> Typed:
        return INTEGER, F.char_length(self.string(t)).cast("bigint")

    def fn_substr(self, t: Typed, start: Typed, length: Typed | None = None) -> Typed:
        s, b = self.string(t), self.number(start).cast("int")
        first = F.greatest(b, F.lit(1))
        if length is None:
            return self.keep(t, F.substring(s, first, F.char_length(s)))
        return self.keep(t, F.substring(s, first, F.greatest(b + self.number(length).cast("int") - first, F.lit(0))))

    def fn_ucase(self, t: Typed) -> Typed:
        return self.keep(t, F.upper(self.string(t)))

    def fn_lcase(self, t: Typed) -> Typed:
        return self.keep(t, F.lower(self.string(t)))

    def fn_strstarts(self, a: Typed, b: Typed) -> Typed:
        return BOOLEAN, self.string(a).startswith(self.string(b))

    def fn_strends(self, a: Typed, b: Typed) -> Typed:
        return BOOLEAN, self.string(a).endswith(self.string(b))

    def fn_contains(self, a: Typed, b: Typed) -> Typed:
        return BOOLEAN, self.string(a).contains(self.string(b))

    def fn_strbefore(self, a: Typed, b: Typed) -> Typed:
        s, x = self.string(a), self.string(b)
        at = F.position(x, s)
        return self.keep(a, F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.when(at.isNotNull(), F.lit(""))))

    def fn_strafter(self, a: Typed, b: Typed) -> Typed:
        s, x = self.string(a), self.string(b)
        at = F.position(x, s)
        return self.keep(a, F.when(at > 0, F.substring(s, at + F.char_length(x), F.char_length(s))).otherwise(F.when(at.isNotNull(), F.lit(""))))

    def fn_encode_for_uri(self, t: Typed) -> Typed:
        c = F.url_encode(self.string(t))
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return STRING, c

    def fn_concat(self, *t: Typed) -> Typed:
        return STRING, F.concat(*[self.string(x) for x in t]) if t else F.lit("")

    def pattern(self, p: Typed, flags: Typed | None) -> Column:
        if flags is None:
            return self.string(p)
        f = self.string(flags)
        return F.concat(F.when(f != "", F.concat(F.lit("(?"), F.replace(f, F.lit("q"), F.lit("")), F.lit(")"))).otherwise(F.lit("")), self.string(p))

    def fn_regex(self, t: Typed, p: Typed, flags: Typed | None = None) -> Typed:
        return BOOLEAN, F.regexp(self.string(t), self.pattern(p, flags))

    def fn_replace(self, t: Typed, p: Typed, by: Typed, flags: Typed | None = None) -> Typed:
        return self.keep(t, F.regexp_replace(self.string(t), self.pattern(p, flags), self.string(by)))

    # numbers
    def _numeric(self, t: Typed, f: Callable[[Column], Column]) -> Typed:
        kind, c = t
        if kind.sort == "lit" and kind.dt in NUMERICS:
            return kind, f(c).cast(terms.NATIVE.get(kind.dt, "bigint"))
        return DOUBLE, f(self.number(t)).cast("double")

    def fn_abs(self, t: Typed) -> Typed:
        return self._numeric(t, F.abs)

    def fn_neg(self, t: Typed) -> Typed:
        return self._numeric(t, lambda c: -c)

    def fn_ceil(self, t: Typed) -> Typed:
        return self._numeric(t, F.ceil)

    def fn_floor(self, t: Typed) -> Typed:
        return self._numeric(t, F.floor)

    def fn_round(self, t: Typed) -> Typed:
        return self._numeric(t, lambda c: F.floor(c + F.lit(0.5)) if t[0].dt not in INTEGERS else c)

    def fn_rand(self) -> Typed:
        return DOUBLE, F.rand()

    # dates
    def fn_now(self) -> Typed:
        return DATETIME, F.current_timestamp()

    def _part(self, f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
        return lambda t: (INTEGER, f(self.local(t)).cast("bigint"))

    def local(self, t: Typed) -> Column:
        """The moment as written, without moving it to UTC."""
        if t[0].sort == "nt":
            return F.when(self.moment(t).isNotNull(), F.regexp_replace(terms.lexical(*t), r"(Z|[+-]\d\d:\d\d)$", "")).try_cast("timestamp")
        return self.moment(t)

    def fn_year(self, t: Typed) -> Typed:
        return self._part(F.year)(t)

    def fn_month(self, t: Typed) -> Typed:
        return self._part(F.month)(t)

    def fn_day(self, t: Typed) -> Typed:
        return self._part(F.dayofmonth)(t)

    def fn_hours(self, t: Typed) -> Typed:
        return self._part(F.hour)(t)

    def fn_minutes(self, t: Typed) -> Typed:
        return self._part(F.minute)(t)

    def fn_seconds(self, t: Typed) -> Typed:
        return DECIMAL, F.date_part(F.lit("SECOND"), self.local(t)).cast(_DECIMAL)

    def _zone(self, t: Typed) -> Column:
        if t[0].sort == "nt":
            return F.when(self.moment(t).isNotNull(), F.regexp_extract(terms.lexical(*t), r"(Z|[+-]\d\d:\d\d)$", 1))
        return F.when(self.moment(t).isNotNull(), F.lit("Z"))

    def fn_tz(self, t: Typed) -> Typed:
        return STRING, self._zone(t)

    def fn_timezone(self, t: Typed) -> Typed:
        z = self._zone(t)
        hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        body = F.concat(F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
        text = F.when(z == "Z", F.lit("PT0S")).when(z.startswith("-"), F.concat(F.lit("-"), body)).when(z != "", body)
        return NT, F.concat(F.lit('"'), F.when(text == "PT", F.lit("PT0S")).otherwise(text), F.lit('"^^xsd:dayTimeDuration'))

    # hashes
    def fn_md5(self, t: Typed) -> Typed:
        return STRING, F.md5(self.string(t))

    def fn_sha1(self, t: Typed) -> Typed:
        return STRING, F.sha1(self.string(t))

    def fn_sha256(self, t: Typed) -> Typed:
        return STRING, F.sha2(self.string(t), 256)

    def fn_sha384(self, t: Typed) -> Typed:
        return STRING, F.sha2(self.string(t), 384)

    def fn_sha512(self, t: Typed) -> Typed:
        return STRING, F.sha2(self.string(t), 512)


def sort_keys(kind: Kind, c: Column, ascending: bool) -> list[Column]:
    """ORDER BY keys: unbound, blank, IRI, literal; numbers by value, then moments, then text."""
    way = (lambda k: k.asc_nulls_first()) if ascending else (lambda k: k.desc_nulls_last())
    if kind.sort != "nt":
        return [way(c)]
    s = Scope({})
    rank = F.when(c.startswith("_:"), 1).when(c.startswith("<"), 2).when(c.isNotNull(), 3)
    return [way(k) for k in (rank, s.number((kind, c)), s.moment((kind, c)), terms.lexical(kind, c), c)]
