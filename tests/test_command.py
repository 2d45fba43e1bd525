"""The command line, end to end in the test session."""

import json

from quadloom import __main__ as cli
from quadloom.engine import Engine

TTL = '@prefix geo: <http://www.opengis.net/ont/geosparql#> .\n<urn:a> geo:asWKT "POLYGON ((0 0, 600 0, 600 600, 0 600, 0 0))"^^geo:wktLiteral ; <urn:p> "@prefix x: <y> ."  .\n'


def test_load_query_export(spark, tmp_path, capsys):
    source, store = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    (source / "a.ttl").write_text(TTL)
    (source / "deep" / "b.nt").write_text("<urn:b> <urn:p> <urn:a> .\nbroken\n")
    (source / "empty.ttl").write_text("")
    (source / "other.txt").write_text("x")
    cli.main(["load", str(source), str(store / "all"), "--spatial", "--features", "--void"])
    assert "rejected: 1" in capsys.readouterr().out
    e = Engine.store(spark, str(store / "all"))
    assert e.source.tiles is not None and e.sparql("SELECT ?x { <urn:a> <urn:p> ?x }").first().x == '"@prefix x: <y> ."^^xsd:string'
    assert e.sparql("SELECT ?v { ?s <urn:x-graph:hal/shape2d/MeshSurface> ?v }").first().v == '"360000.0"^^xsd:double'
    assert e.sparql("SELECT ?n { GRAPH <urn:x-graph:void> { <urn:x-graph:default> <http://rdfs.org/ns/void#triples> ?n } }").first().n == '"3"^^xsd:integer'
    assert e.sparql("SELECT ?s { GRAPH <urn:x-graph:grid:0:1:1> { ?s ?p ?o } }").count() == 1
    cli.main(["load", str(source), str(store / "each"), "--each", "--status"])
    assert "stores: 2, passed over: 0, rejected: 1" in capsys.readouterr().out
    cli.main(["load", str(source), str(store / "each"), "--each"])
    assert "stores: 0, passed over: 2" in capsys.readouterr().out
    cli.main(["query", str(store / "each" / "deep" / "b"), "SELECT ?s { ?s ?p ?o }", "--format", "json"])
    assert json.loads(capsys.readouterr().out)["results"]["bindings"] == [{"s": {"type": "uri", "value": "urn:b"}}]
    cli.main(["export", str(store / "each" / "deep" / "b"), str(tmp_path / "nq")])
    assert [r.value for r in spark.read.text(str(tmp_path / "nq")).collect()] == ["<urn:b> <urn:p> <urn:a> ."]
