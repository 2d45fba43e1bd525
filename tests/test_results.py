"""Documents of results: read back by public parsers or compared with hand-made text."""

import csv
import io
import json
import xml.etree.ElementTree as ET

import pytest

from quadloom.engine import Engine
from quadloom.sources import quads, turtle
from quadloom.sparql import results
from quadloom.terms import RDF_TYPE

ROWS = [
    ("<urn:a>", "<urn:v#p>", '"x, \\"y\\" & <z>\\n2"^^xsd:string'),
    ("<urn:a>", "<urn:v#p>", '"chat"@fr'),
    ("<urn:a>", "<urn:v#q>", '"5"^^xsd:int'),
    ("<urn:a>", f"<{RDF_TYPE}>", "<urn:T>"),
    ("_:b1", "<urn:v#p>", "<urn:a>"),
    ("<urn:c>", "<urn:v#own>", '"k"^^<urn:dt>'),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(quads.QuadSource(quads.typed(spark.createDataFrame([("<urn:x-graph:default>", *r) for r in ROWS], "g string, s string, p string, o string"))))


QUERY = "SELECT ?s ?o ?none WHERE { ?s <urn:v#p> ?o OPTIONAL { ?s <urn:none> ?none } } ORDER BY ?o"


def test_bindings(engine):
    found = json.loads(engine.document(QUERY, "json").text())
    assert found["head"] == {"vars": ["s", "o", "none"]}
    assert found["results"]["bindings"] == [
        {"s": {"type": "bnode", "value": "b1"}, "o": {"type": "uri", "value": "urn:a"}},
        {"s": {"type": "uri", "value": "urn:a"}, "o": {"type": "literal", "value": "chat", "xml:lang": "fr"}},
        {"s": {"type": "uri", "value": "urn:a"}, "o": {"type": "literal", "value": 'x, "y" & <z>\n2'}},
    ]
    table = list(csv.reader(io.StringIO(engine.document(QUERY, "csv").text())))
    assert table == [["s", "o", "none"], ["_:b1", "urn:a", ""], ["urn:a", "chat", ""], ["urn:a", 'x, "y" & <z>\n2', ""]]
    space = "{http://www.w3.org/2005/sparql-results#}"
    root = ET.fromstring(engine.document(QUERY, "xml").text())
    cells = [[(b.get("name"), b[0].tag[len(space) :], b[0].text) for b in r] for r in root.iter(space + "result")]
    assert cells[2] == [("s", "uri", "urn:a"), ("o", "literal", 'x, "y" & <z>\n2')] and len(cells) == 3
    assert engine.document(QUERY, "tsv").text().splitlines()[2] == '<urn:a>\t"chat"@fr\t'
    with pytest.raises(ValueError):
        engine.document(QUERY, "turtle")


def test_empty_and_boolean(engine):
    assert json.loads(engine.document("SELECT ?x { ?x <urn:nothing> ?y }", "json").text())["results"]["bindings"] == []
    assert json.loads(engine.document("ASK { ?x <urn:v#q> 5 }", "json").text())["boolean"] is False
    assert json.loads(engine.document("ASK { ?x <urn:v#q> ?y }", "json").text())["boolean"] is True
    assert "<boolean>true</boolean>" in engine.document("ASK { ?x <urn:v#q> ?y }", "xml").text()


ALL = "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }"


@pytest.mark.parametrize("form", ["nt", "turtle"])
def test_turtle_reads_back(spark, engine, tmp_path, form):
    engine.document(ALL, form).write(str(tmp_path / "x.ttl"))
    found, bad = turtle.load(spark, str(tmp_path))
    blank = lambda x: "_:" if x.startswith("_:") else x
    assert bad.count() == 0
    assert sorted(tuple(map(blank, (r.s, r.p, r.o))) for r in found.collect()) == sorted(tuple(map(blank, r)) for r in ROWS)


def test_jsonld_and_rdfxml(engine):
    nodes = json.loads(engine.document(ALL, "jsonld").text())
    assert len(nodes) == len(ROWS) and {"@id": "urn:a", "@type": ["urn:T"]} in nodes
    assert {"@id": "urn:a", "urn:v#p": [{"@value": "chat", "@language": "fr"}]} in nodes
    assert {"@id": "urn:a", "urn:v#q": [{"@value": "5", "@type": "http://www.w3.org/2001/XMLSchema#int"}]} in nodes
    assert {"@id": "_:b1", "urn:v#p": [{"@id": "urn:a"}]} in nodes
    root = ET.fromstring(engine.document(ALL, "rdfxml").text())
    assert len(root) == len(ROWS) and {c.tag for d in root for c in d} == {"{urn:v#}p", "{urn:v#}q", "{urn:v#}own", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}type"}


def test_frame(spark):
    data = [("<urn:f>", f"<{RDF_TYPE}>", "<urn:T>"), ("<urn:f>", "<urn:v/has>", "<urn:g>"), ("<urn:f>", "<urn:v/name>", '"n"^^xsd:string'), ("<urn:g>", "<urn:v/has>", "<urn:f>"), ("<urn:g>", "<urn:v/n>", '"1"^^xsd:int')]
    df = spark.createDataFrame(data + data[:1], "s string, p string, o string")
    got = [json.loads(r.json) for r in results.framed(df, "urn:T", {"v": "urn:v/"}).collect()]
    assert got == [{"@id": "urn:f", "@type": ["urn:T"], "v:has": [{"@id": "urn:g", "v:has": [{"@id": "urn:f"}], "v:n": [{"@value": "1", "@type": "http://www.w3.org/2001/XMLSchema#int"}]}], "v:name": ["n"]}]
    assert results.framed(df, "urn:none", {}).collect() == []


def test_functions_of_a_user(spark, engine):
    from pyspark.sql import functions as F

    from quadloom.terms import BOOLEAN

    longer = lambda scope, args: (BOOLEAN, F.char_length(scope.string(scope.compile(args[0]))) > 5)
    e = Engine(engine.source, functions={"urn:f:long": longer})
    assert e.sparql("SELECT ?o { ?s <urn:v#p> ?o FILTER(<urn:f:long>(?o)) }").count() == 1
    assert len(list(e.rows(ALL))) == len(ROWS) and len(list(e.stream())) == len(ROWS)
