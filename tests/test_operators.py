"""Statistics, dictionaries, file listings and the registry."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadloom.operators import profile
from quadloom.sources import files

T = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def sample(spark):
    data = [("<g>", "<urn:data:things/1>", T, "<urn:T>"), ("<g>", "<urn:data:things/2>", T, "<urn:T>"), ("<g>", "<urn:data:things/2>", "<urn:v#p>", '"5"^^xsd:int'), ("<h>", "_:b", "<urn:v#p>", "<urn:data:things/2>")]
    return spark.createDataFrame(data, "g string, s string, p string, o string")


def test_profile(spark):
    q = sample(spark)
    assert rows(profile.void_stats(q)) == [("<g>", 3, 2, 1, 2, 2, 2), ("<h>", 1, 1, 0, 1, 1, 0)]  # entities are instances of classes
    assert rows(profile.property_partition(q)) == sorted([("<g>", T, 2, 2, 1), ("<g>", "<urn:v#p>", 1, 1, 1), ("<h>", "<urn:v#p>", 1, 1, 1)])
    assert rows(profile.class_partition(q)) == [("<g>", "<urn:T>", 2)]
    assert rows(profile.uri_space(q)) == [("<g>", "urn:data:things/", "^urn:data:things/.*")]
    assert rows(profile.vocabulary(q)) == sorted([("<g>", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", 1, 0), ("<g>", "urn:T#", 0, 1), ("<g>", "urn:v#", 1, 0), ("<h>", "urn:v#", 1, 0), ("<h>", "urn:data:things/", 0, 1)])
    told = rows(profile.void_quads(q).select("s", "p", "o"))
    assert len([r for r in told if r[1].startswith("<http://rdfs.org/ns/void#") and r[2].endswith("xsd:integer") and r[0] in ("<g>", "<h>")]) == 12
    v, sd = "<http://rdfs.org/ns/void#{}>".format, "<http://www.w3.org/ns/sparql-service-description#{}>".format
    by = {(s, p): o for s, p, o in told}
    parts = {by[o, v("property")]: by[o, v("triples")] for s, p, o in told if s == "<g>" and p == v("propertyPartition")}
    assert parts == {T: '"2"^^xsd:integer', "<urn:v#p>": '"1"^^xsd:integer'}
    assert [by[o, v("entities")] for s, p, o in told if p == v("classPartition")] == ['"2"^^xsd:integer'] and by["<g>", v("uriSpace")] == '"urn:data:things/"^^xsd:string'
    assert {by[o, sd("name")] for s, p, o in told if p == sd("namedGraph")} == {"<g>", "<h>"}
    assert profile.void_stats(q.limit(0)).collect() == []


def test_dictionary_is_ordered(spark):
    got = profile.dictionary_ids(sample(spark)).orderBy("role", "id").collect()
    for role in ("entity", "literal", "predicate"):
        own = [r for r in got if r.role == role]
        assert [r.id for r in own] == list(range(1, len(own) + 1)) and [r.term for r in own] == sorted(r.term for r in own)


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in ("a.ttl", "sub/b.png", "sub/deep/c"):
        (tmp_path / name).write_text("x" * 5)
    got = {r.name: r for r in files.items(spark, str(tmp_path)).collect()}
    assert {n: r.n_items for n, r in got.items() if r.is_container} == {tmp_path.name: 2, "sub": 2, "deep": 1}
    assert (got["a.ttl"].media_type, got["b.png"].media_type, got["c"].media_type) == ("text/turtle", "image/png", "application/octet-stream")
    described = files.items(spark, str(tmp_path))
    assert files.as_quads(described).where(F.col("p").contains("totalItems")).count() == 3
    found = {(r.s, r.p.rsplit("/", 1)[1], r.o) for r in files.as_quads(described, "http://x/store").collect()}
    assert {("<http://x/store>", "items>", "<http://x/store/sub>"), ("<http://x/store/sub/b.png>", "partOf>", "<http://x/store/sub>")} <= found
    assert [o for s, p, o in found if p == "owl#sameAs>" and s == "<http://x/store/a.ttl>"] == [f"<file:{tmp_path}/a.ttl>"]
    assert not [1 for s, p, o in found if s == "<http://x/store>" and p == "partOf>"]
    links = {r.path.rsplit("/", 1)[1]: json.loads(r.json)["linkset"][0] for r in files.linkset(described).collect()}
    assert links["b.png"]["mediaType"] == [{"href": "image/png"}] and links["b.png"]["size"] == [{"href": "5"}] and links["sub"]["type"] == [{"href": "https://www.w3.org/ns/lws#Container"}]
    files.container(spark, str(tmp_path), str(tmp_path / "packed"))
    assert {r.name: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "packed")).collect()} == {n: b"xxxxx" for n in ("a.ttl", "sub/b.png", "sub/deep/c")}


def test_page_links(spark):
    link = lambda n, number: tuple(files.page_links(spark.range(n), number, "u").collect()[0])
    assert link(45, 2) == (45, 3, "u?page=1", "u?page=1", "u?page=3", "u?page=3")
    assert link(20, 1) == (20, 1, "u?page=1", None, None, "u?page=1") and link(0, 1) == (0, 0, "u?page=1", None, None, "u?page=1")


def test_only_local_sessions_use_a_temporary_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from quadloom import runtime

    unset = SimpleNamespace(isDefined=lambda: False)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))))
    with pytest.raises(RuntimeError):
        runtime.checkpoint_dir(fake)
    kept = runtime.cut(spark.range(5))
    path = kept.__dict__["_cut_path"]
    runtime.release(kept)
    assert not os.path.exists(path.removeprefix("file:"))


def test_registry():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) > 100
    assert {f"p{n}_found" for n in (1, 3, 6)} <= queries.keys()


def test_dumps_are_in_order(spark):
    from quadloom.plans import store_queries

    for query, order in ((store_queries.dump_gspo, "gspo"), (store_queries.dump_gpos, "gpos")):
        got = [tuple(r[c] for c in order) for r in query(spark, "/root/testdata/sf0.001").collect()]
        assert len(got) > 100 and got == sorted(got, key=lambda r: [x.encode() for x in r])
