"""RDF terms: syntax-tree terms, canonical N-Triples text and static descriptions of bound columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
GEO = "http://www.opengis.net/ont/geosparql#"
GEOF = "http://www.opengis.net/def/function/geosparql/"
RDF_TYPE = RDF + "type"
LANG_STRING = "rdf:langString"
WKT_LITERAL = GEO + "wktLiteral"
DEFAULT_GRAPH = "urn:x-graph:default"

INTEGERS = frozenset(f"xsd:{t}" for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
NUMERICS = INTEGERS | {"xsd:decimal", "xsd:double", "xsd:float"}
#: Datatypes with a Spark type of their own.
NATIVE = {"xsd:int": "int", "xsd:long": "bigint", "xsd:integer": "bigint", "xsd:double": "double", "xsd:float": "float", "xsd:decimal": "decimal(38,18)", "xsd:boolean": "boolean", "xsd:dateTime": "timestamp", "xsd:string": "string", "xsd:date": "date"}


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = "xsd:string"
    lang: str | None = None


def short(iri: str) -> str:
    """Datatype IRI with xsd: and rdf: shortened."""
    for prefix, space in (("xsd:", XSD), ("rdf:", RDF)):
        if iri.startswith(space):
            return prefix + iri[len(space) :]
    return iri


def escape(lex: str) -> str:
    return lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def datatype_text(dt: str) -> str:
    return dt if dt.startswith(("xsd:", "rdf:")) else f"<{dt}>"


def canonical(term: IRI | BNode | Lit) -> str:
    """Text that is equal exactly for equal terms."""
    if isinstance(term, IRI):
        return f"<{term.value}>"
    if isinstance(term, BNode):
        return f"_:{term.label}"
    quoted = f'"{escape(term.lex)}"'
    return f"{quoted}@{term.lang.lower()}" if term.lang else f"{quoted}^^{datatype_text(term.dt)}"


@dataclass(frozen=True)
class Kind:
    """What a column holds.

    ``iri``: the part of an IRI after ``template``; ``lit``: values of datatype ``dt`` in its native Spark type;
    ``nt``: canonical text of any term. ``nullable`` columns may be unbound.
    """

    sort: str
    dt: str | None = None
    template: str = ""
    nullable: bool = False

    def unbound(self, nullable: bool = True) -> Kind:
        return Kind(self.sort, self.dt, self.template, nullable)

    def same(self, other: Kind) -> bool:
        return (self.sort, self.dt, self.template) == (other.sort, other.dt, other.template)


NT = Kind("nt")
STRING, BOOLEAN, INTEGER, DOUBLE, DECIMAL, DATETIME = (Kind("lit", f"xsd:{t}") for t in ("string", "boolean", "integer", "double", "decimal", "dateTime"))
IRI_KIND = Kind("iri")


def escaped(c: Column) -> Column:
    for raw, text in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(text))
    return c


def unescaped(c: Column) -> Column:
    """Lexical form from canonical text between the quotes."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for raw, text in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(text), F.lit(raw))
    return F.replace(c, F.lit("\x00"), F.lit("\\"))


def decimal_text(c: Column) -> Column:
    t = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(t, r"\.$", "")


def lexical(kind: Kind, c: Column) -> Column:
    """Lexical form of a literal, or the IRI, as a string column."""
    if kind.sort == "nt":
        body = F.regexp_extract(c, r'(?s)^"(.*)"(?:@[^"]*|\^\^[^"]*)?$', 1)
        return F.when(c.startswith('"'), unescaped(body)).when(c.startswith("<"), F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)
    if kind.sort == "iri":
        return F.concat(F.lit(kind.template), c.cast("string")) if kind.template else c.cast("string")
    if kind.dt == "xsd:dateTime":
        return F.concat(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
    if kind.dt == "xsd:decimal":
        return decimal_text(c)
    return c.cast("string")


def text(kind: Kind, c: Column) -> Column:
    """Canonical text of a column of any kind; null stays null."""
    if kind.sort == "nt":
        return c
    if kind.sort == "iri":
        return F.concat(F.lit("<" + kind.template), c.cast("string"), F.lit(">"))
    return F.concat(F.lit('"'), escaped(lexical(kind, c)), F.lit(f'"^^{datatype_text(kind.dt)}'))


def datatype(kind: Kind, c: Column) -> Column:
    """Short datatype of literals, null for other terms."""
    if kind.sort == "nt":
        dt = F.regexp_extract(c, r'"\^\^<?([^">]*)>?$', 1)
        return F.when(~c.startswith('"'), None).when(c.rlike(r'"@[A-Za-z0-9-]+$'), F.lit(LANG_STRING)).when(dt == "", F.lit("xsd:string")).otherwise(dt)
    return F.lit(kind.dt if kind.sort == "lit" else None).cast("string")


def language(kind: Kind, c: Column) -> Column:
    """Language tag, empty for literals without; null for other terms."""
    if kind.sort == "nt":
        return F.when(c.startswith('"'), F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1))
    return F.when(c.isNotNull(), F.lit("")) if kind.sort == "lit" else F.lit(None).cast("string")


def literal(term: Lit | IRI | BNode) -> tuple[Kind, Column]:
    """Constant as a column of the most specific kind."""
    if isinstance(term, Lit) and not term.lang and term.dt in NATIVE:
        kind = Kind("lit", term.dt)
        if term.dt == "xsd:string":
            return kind, F.lit(term.lex)
        return kind, F.lit(term.lex).try_cast(NATIVE[term.dt])
    if isinstance(term, IRI):
        return IRI_KIND, F.lit(term.value)
    return NT, F.lit(canonical(term))
