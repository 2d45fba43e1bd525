"""Documents of query results: bindings as JSON, XML, CSV or TSV, triples as N-Triples, Turtle, JSON-LD or RDF/XML.

Every row becomes its piece of the document by column expressions; a document is a head, the pieces and a tail.
Pieces stay a distributed table until they are written in order through an iterator, so no result is held whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.sparql.frame import Frame
from quadloom.terms import NT, RDF, RDF_TYPE, XSD, Kind

SELECT_FORMATS, GRAPH_FORMATS = ("json", "xml", "csv", "tsv"), ("nt", "turtle", "jsonld", "rdfxml")


@dataclass
class Document:
    """``pieces`` has one column ``value``, in the order of the rows; ``between`` separates them."""

    head: str
    pieces: DataFrame
    between: str
    tail: str

    def lines(self):
        """The text of the document, piece by piece."""
        yield self.head
        for i, row in enumerate(self.pieces.toLocalIterator()):
            yield (self.between if i else "") + row.value
        yield self.tail

    def text(self) -> str:
        return "".join(self.lines())

    def write(self, path: str) -> None:
        """Writes the document to a file of the driver."""
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(self.lines())


def _full(dt: Column) -> Column:
    """Whole IRI of a short datatype."""
    for prefix, space in (("xsd:", XSD), ("rdf:", RDF)):
        dt = F.when(dt.startswith(prefix), F.concat(F.lit(space), F.substring(dt, len(prefix) + 1, 1000))).otherwise(dt)
    return dt


def _parts(c: Column, known: Kind = NT) -> tuple[Column, Column, Column, Column]:
    """Kind (uri, bnode, literal), lexical form, datatype other than plain strings, and language of a column; null where it is unbound."""
    nothing = F.lit(None).cast("string")
    if known.sort == "iri":
        return F.when(c.isNotNull(), "uri"), terms.lexical(known, c), nothing, nothing
    if known.sort == "lit":
        dt = F.when(c.isNotNull(), _full(F.lit(known.dt))) if known.dt != "xsd:string" else nothing
        return F.when(c.isNotNull(), "literal"), terms.lexical(known, c), dt, nothing
    kind = F.when(c.startswith("<"), "uri").when(c.startswith("_:"), "bnode").when(c.isNotNull(), "literal")
    lex = F.when(kind == "bnode", F.substring(c, 3, 1_000_000)).otherwise(terms.lexical(NT, c))
    lang = F.when(terms.language(NT, c) != "", terms.language(NT, c))
    dt = terms.datatype(NT, c)
    return kind, lex, F.when((kind == "literal") & lang.isNull() & (dt != "xsd:string"), _full(dt)), lang


def _xml(c: Column) -> Column:
    for raw, text in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(raw), F.lit(text))
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "�")  # characters that XML can't hold


def bindings(f: Frame, form: str) -> Document:
    """The rows of a SELECT result."""
    names = [n for n in f.kinds if not n.startswith("__")]
    cells = {n: F.col(f"`{n}`") for n in names}
    if form == "json":
        made = []
        for n, c in cells.items():
            kind, lex, dt, lang = _parts(c, f.kinds[n])
            made.append(F.when(c.isNotNull(), F.struct(kind.alias("type"), lex.alias("value"), dt.alias("datatype"), lang.alias("xml:lang"))).alias(n))
        row = F.to_json(F.struct(*made)) if made else F.lit("{}")
        quoted = ", ".join('"' + n.replace('"', '\\"') + '"' for n in names)
        return Document('{"head": {"vars": [' + quoted + ']}, "results": {"bindings": [\n', f.df.select(row.alias("value")), ",\n", "\n]}}\n")
    if form == "xml":
        made = []
        for n, c in cells.items():
            kind, lex, dt, lang = _parts(c, f.kinds[n])
            extra = F.when(lang.isNotNull(), F.concat(F.lit(' xml:lang="'), lang, F.lit('"'))).when(dt.isNotNull(), F.concat(F.lit(' datatype="'), _xml(dt), F.lit('"'))).otherwise(F.lit(""))
            made.append(F.when(c.isNotNull(), F.concat(F.lit(f'<binding name="{n}"><'), kind, extra, F.lit(">"), _xml(lex), F.lit("</"), kind, F.lit("></binding>"))).otherwise(F.lit("")))
        head = '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f'<variable name="{n}"/>' for n in names) + "</head><results>\n"
        return Document(head, f.df.select(F.concat(F.lit("<result>"), *made, F.lit("</result>")).alias("value")), "\n", "\n</results></sparql>\n")
    if form == "csv":
        plain = [F.when(c.startswith("_:"), c).otherwise(terms.lexical(NT, c)) if f.kinds[n].sort == "nt" else terms.lexical(f.kinds[n], c) for n, c in cells.items()]
        made = [F.coalesce(F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x), F.lit("")) for x in plain]
        return Document(",".join(names) + "\r\n", f.df.select(F.concat_ws(",", *made).alias("value")), "\r\n", "\r\n")
    if form == "tsv":
        made = [F.coalesce(_ntriples(terms.text(f.kinds[n], c)), F.lit("")) for n, c in cells.items()]
        return Document("\t".join("?" + n for n in names) + "\n", f.df.select(F.concat_ws("\t", *made).alias("value")), "\n", "\n")
    raise ValueError(f"no bindings as {form}; one of {SELECT_FORMATS}")


def boolean(answer: bool, form: str) -> str:
    """The document of an ASK result."""
    word = "true" if answer else "false"
    if form == "xml":
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{word}</boolean></sparql>\n'
    if form == "json":
        return f'{{"head": {{}}, "boolean": {word}}}\n'
    raise ValueError(f"no boolean as {form}")


def _ntriples(c: Column) -> Column:
    """Canonical text with whole datatypes."""
    for prefix, space in (("xsd:", XSD), ("rdf:", RDF)):
        c = F.regexp_replace(c, rf'"\^\^{prefix}(\w+)$', f'"^^<{space}$1>')
    return F.regexp_replace(c, r'(?s)^(".*")\^\^<http://www.w3.org/2001/XMLSchema#string>$', "$1")


def triples(df: DataFrame, form: str) -> Document:
    """Triples (s, p, o) in canonical text.

    Turtle groups by subject and predicate with windows that sort and spill; JSON-LD and RDF/XML have an object for
    each triple, which readers merge by subject, so that a subject with many triples is no larger piece than others.
    """
    s, p, o = (F.col(c) for c in "spo")
    if form == "nt":
        return Document("", df.select(F.concat_ws(" ", s, p, _ntriples(o), F.lit(".")).alias("value")), "\n", "\n")
    if form == "turtle":
        order = Window.partitionBy("s").orderBy("p", "o")
        last, follows = F.lag("p").over(order), F.lead("p").over(order)
        verb = F.when(p == f"<{RDF_TYPE}>", F.lit("a")).otherwise(p)
        piece = F.concat(F.when(last.isNull(), F.concat(s, F.lit(" "), verb, F.lit(" "))).when(last == p, F.lit("    , ")).otherwise(F.concat(F.lit("  ; "), verb, F.lit(" "))), _ntriples(o), F.when(follows.isNull(), F.lit(" .")).otherwise(F.lit("")))
        return Document("", df.select("s", "p", "o", piece.alias("value")).orderBy("s", "p", "o").select("value"), "\n", "\n")
    kind, lex, dt, lang = _parts(o)
    if form == "jsonld":
        subject = F.to_json(F.struct(F.when(s.startswith("<"), terms.lexical(NT, s)).otherwise(s).alias("@id")))
        target = F.when(kind == "literal", F.to_json(F.struct(lex.alias("@value"), dt.alias("@type"), lang.alias("@language")))).otherwise(F.to_json(F.struct(F.when(kind == "uri", lex).otherwise(o).alias("@id"))))
        key = F.when(p == f"<{RDF_TYPE}>", F.lit('"@type": [')).otherwise(F.concat(_json_string(terms.lexical(NT, p)), F.lit(": [")))
        value = F.when((p == f"<{RDF_TYPE}>") & (kind != "literal"), _json_string(F.when(kind == "uri", lex).otherwise(o))).otherwise(target)
        return Document("[\n", df.select(F.concat(F.regexp_replace(subject, r"\}$", ", "), key, value, F.lit("]}")).alias("value")), ",\n", "\n]\n")
    if form == "rdfxml":
        name = terms.lexical(NT, p)
        local = F.regexp_extract(name, r"([A-Za-z_][\w.\-]*)$", 1)
        space = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(local))
        about = F.when(s.startswith("<"), F.concat(F.lit('rdf:about="'), _xml(terms.lexical(NT, s)))).otherwise(F.concat(F.lit('rdf:nodeID="'), F.substring(s, 3, 1_000_000)))
        start = F.concat(F.lit("<rdf:Description "), about, F.lit('"><n:'), local, F.lit(' xmlns:n="'), _xml(space), F.lit('"'))
        extra = F.when(lang.isNotNull(), F.concat(F.lit(' xml:lang="'), lang, F.lit('"'))).when(dt.isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml(dt), F.lit('"'))).otherwise(F.lit(""))
        end = F.when(kind == "uri", F.concat(F.lit(' rdf:resource="'), _xml(lex), F.lit('"/>'))).when(kind == "bnode", F.concat(F.lit(' rdf:nodeID="'), lex, F.lit('"/>'))).otherwise(F.concat(extra, F.lit(">"), _xml(lex), F.lit("</n:"), local, F.lit(">")))
        return Document(f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n', df.where(local != "").select(F.concat(start, end, F.lit("</rdf:Description>")).alias("value")), "\n", "\n</rdf:RDF>\n")
    raise ValueError(f"no triples as {form}; one of {GRAPH_FORMATS}")


def _json_string(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def framed(df: DataFrame, type_iri: str, context: dict[str, str], type_predicate: str = RDF_TYPE, depth: int = 1) -> DataFrame:
    """``(s, json)``: the subjects of a type as JSON objects, with names shortened by the prefixes of ``context``.

    Objects that are subjects themselves are embedded ``depth`` levels deep, others are references. Values of a
    property are an array, sorted. Every object is one row, so its properties meet in one task.
    """

    def short(iri: Column) -> Column:
        out = iri
        for prefix, space in context.items():
            out = F.when(iri.startswith(space), F.concat(F.lit(prefix + ":"), F.substring(iri, len(space) + 1, 1_000_000))).otherwise(out)
        return out

    name = lambda c: F.when(c.startswith("<"), short(terms.lexical(NT, c))).otherwise(c)
    t = df.select("s", "p", "o").distinct()
    kind, lex, dt, lang = _parts(F.col("o"))
    literal = F.to_json(F.struct(lex.alias("@value"), short(dt).alias("@type"), lang.alias("@language")))
    reference = F.to_json(F.struct(name(F.col("o")).alias("@id")))
    key = F.when(F.col("p") == f"<{type_predicate}>", F.lit("@type")).otherwise(name(F.col("p")))
    plain = F.when(kind == "literal", F.when(dt.isNull() & lang.isNull(), _json_string(lex)).otherwise(literal))
    cells = t.select("s", "o", key.alias("key"), plain.alias("value"), reference.alias("ref"), _json_string(name(F.col("o"))).alias("id"))

    def objects(inner: DataFrame | None) -> DataFrame:
        found = cells
        if inner is not None:
            found = cells.join(inner.select(F.col("s").alias("o"), F.col("json").alias("inside")), "o", "left")
        target = F.coalesce("value", F.when(F.col("key") == "@type", F.col("id")), F.col("inside") if inner is not None else F.lit(None), "ref")
        lists = found.select("s", "key", target.alias("v")).groupBy("s", "key").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set("v")), ","), F.lit("]")).alias("v"))
        body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "v"))), lambda x: F.concat(_json_string(x["key"]), F.lit(":"), x["v"])), ",")
        return lists.groupBy("s").agg(body.alias("b")).select("s", F.concat(F.lit('{"@id":'), _json_string(name(F.col("s"))), F.lit(","), F.col("b"), F.lit("}")).alias("json"))

    made = None
    for _ in range(depth + 1):
        made = objects(made)
    roots = t.where((F.col("p") == f"<{type_predicate}>") & (F.col("o") == f"<{type_iri}>")).select("s").distinct()
    return made.join(roots, "s", "left_semi")
