"""Registered queries of the quad store: look-ups, loading, writing and statistics, with their SQL oracles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.operators import profile
from quadloom.runtime import cut, shared_folder, table
from quadloom.sources import files, ntriples, quads
from quadloom.sources.mapped import warehouse
from quadloom.sparql import results
from quadloom.terms import IRI, WKT_LITERAL, Kind, escaped, text

SHARED, GEO_TYPE = "urn:x-graph:image/4", "urn:x-graph:hal/type"


def _store(spark: SparkSession, sf_dir: str) -> quads.QuadSource:
    return quads.QuadSource(table(spark, sf_dir, "quads"))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(_store(spark, sf_dir))


def _set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quads as a set."""
    return quads.dedup(_store(spark, sf_dir).df)


def find_spo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of one graph and predicate."""
    return _engine(spark, sf_dir).find(IRI(SHARED), None, IRI(GEO_TYPE), None).distinct()


def find_quads_any_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads with a predicate in any graph."""
    return _engine(spark, sf_dir).find(p=IRI("urn:x-graph:hal/reviewed")).distinct()


def find_named_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the default graph."""
    return _engine(spark, sf_dir).find(p=IRI(GEO_TYPE), named_only=True).distinct()


def dump_gspo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quads in the order g, s, p, o."""
    return _set(spark, sf_dir).select(*quads.KEY).orderBy("g", "s", "p", "o")


def dump_gpos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quads in the order g, p, o, s."""
    return _set(spark, sf_dir).select(*quads.KEY).orderBy("g", "p", "o", "s")


def list_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named graphs."""
    return _engine(spark, sf_dir).graphs()


def contains_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of a graph that is there, of one that isn't, and of a subject that is no graph."""
    e = _engine(spark, sf_dir)
    return spark.createDataFrame([(g, e.contains_graph(g)) for g in (SHARED, "urn:x-graph:image/nowhere", "urn:x-graph:class/6")], "g string, there boolean")


def distinct_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph terms."""
    return _engine(spark, sf_dir).distinct_terms("g")


def distinct_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject terms."""
    return _engine(spark, sf_dir).distinct_terms("s")


def distinct_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicate terms."""
    return _engine(spark, sf_dir).distinct_terms("p")


def distinct_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object terms."""
    return _engine(spark, sf_dir).distinct_terms("o")


def count_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the store."""
    return _engine(spark, sf_dir).count()


def dedup_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of rows and of different quads."""
    df = _store(spark, sf_dir).df
    return df.groupBy(*quads.KEY).agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_quads"))


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the store, reads it and lists the typed objects."""
    path = shared_folder(spark, "store")
    quads.write(_store(spark, sf_dir).quads(), path)
    return quads.read(spark, path).df.select(*quads.KEY, F.col("o_kind").cast("int").alias("o_kind"), "o_lex", "o_dt", "o_lang", "o_num")


def load_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports the store as gzipped N-Quads and loads them again."""
    path = shared_folder(spark, "nquads")
    ntriples.export(_set(spark, sf_dir).select(*quads.KEY), path)
    return ntriples.load(spark, path)[0]


def export_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the export."""
    return ntriples.to_lines(_set(spark, sf_dir).select(*quads.KEY))


def sorted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of lines, of chunks over 10,000 lines and of lines out of order inside a chunk."""
    path = shared_folder(spark, "chunks")
    ntriples.export(_set(spark, sf_dir).select(*quads.KEY), path, 10_000)
    lines = spark.read.option("wholetext", "true").text(path).select(F.monotonically_increasing_id().alias("f"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("i", "line"))
    parsed = lines.select("f", "i", *[F.regexp_extract("line", ntriples.LINE, n).alias(c) for n, c in ((4, "g"), (1, "s"), (2, "p"))])
    key = F.struct("g", "s", "p")
    before = F.lag(key).over(Window.partitionBy("f").orderBy("i"))
    per = parsed.withColumn("bad", F.coalesce((before > key).cast("long"), F.lit(0))).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    return per.agg(F.sum("n").alias("n_lines"), F.sum((F.col("n") > 10_000).cast("long")).alias("n_over"), F.sum("bad").alias("n_unsorted"))


def bnode_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal labels of two files become different nodes, equal labels of one file the same."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("_:n"), F.col("n_nationkey").cast("string"), F.lit(" <urn:k:in> _:r"), F.col("n_regionkey").cast("string"), F.lit(" .")).alias("value"))
    both = rows.withColumn("file", F.lit("a")).unionByName(rows.withColumn("file", F.lit("b")))
    return ntriples.parse(both, "value", "file")[0].agg(F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"), F.count(F.lit(1)).alias("n"))


def dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving ids of the terms."""
    return profile.dictionary_ids(_set(spark, sf_dir))


def void_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-graph description of the source quads, repeats included, by the data's own type predicate."""
    return profile.void_stats(_store(spark, sf_dir).df, GEO_TYPE)


def void_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the mapped tables, by rdf:type."""
    return profile.void_stats(warehouse(spark, sf_dir).quads()).select("g", "properties", "classes", "distinct_subjects", "entities")


def void_property_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per graph and property."""
    return profile.property_partition(_store(spark, sf_dir).df)


def void_class_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per graph and class."""
    return profile.class_partition(_store(spark, sf_dir).df, GEO_TYPE)


def void_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces of properties and objects."""
    return profile.vocabulary(_store(spark, sf_dir).df)


def void_urispace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common prefix of subjects."""
    return profile.uri_space(_store(spark, sf_dir).df)


def void_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the description as quads."""
    return profile.void_quads(_store(spark, sf_dir).df, GEO_TYPE).where(f"p LIKE '<{profile.VOID}%' AND s LIKE '<%' AND o LIKE '%xsd:integer'")


def void_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions, vocabularies, URI spaces and the dataset's graphs from the quads of the description, read back through their links."""
    q = Engine(quads.QuadSource(cut(profile.void_quads(_store(spark, sf_dir).df, GEO_TYPE)), unique=True))
    query = f"""PREFIX void: <{profile.VOID}> PREFIX sd: <{profile.SD}> SELECT ?g ?kind ?what ?n WHERE {{ GRAPH <{profile.VOID_GRAPH}> {{
        {{ ?g void:propertyPartition ?x . ?x void:property ?what ; void:triples ?n BIND('property' AS ?kind) }}
        UNION {{ ?g void:classPartition ?x . ?x void:class ?what ; void:entities ?n BIND('class' AS ?kind) }}
        UNION {{ ?g void:vocabulary ?what BIND('vocabulary' AS ?kind) }} UNION {{ ?g void:uriSpace ?what BIND('space' AS ?kind) }}
        UNION {{ ?d sd:namedGraph ?x . ?x sd:name ?g ; sd:graph ?what BIND('named' AS ?kind) }} UNION {{ ?d sd:defaultGraph ?g BIND('default' AS ?kind) }} }} }}"""
    return q.sparql(query).select("g", "kind", F.regexp_replace("what", '^[<"]|[>]$|"\\^\\^xsd:string$', "").alias("what"), F.regexp_extract("n", '^"([0-9]+)"', 1).alias("n"))

def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and lengths by datatype."""
    return profile.load_stats(_store(spark, sf_dir).df)


def geo_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries as quads, picked by their datatype."""
    g = table(spark, sf_dir, "geometries").where("as_wkt IS NOT NULL")
    o = F.concat(F.lit('"'), escaped(F.col("as_wkt")), F.lit(f'"^^<{WKT_LITERAL}>'))
    rows = g.select(F.concat(F.lit("<urn:x-graph:image/"), F.col("g"), F.lit(">")).alias("g"), text(Kind("iri"), F.col("s")).alias("s"), F.lit("<http://www.opengis.net/ont/geosparql#asWKT>").alias("p"), o.alias("o"))
    return quads.typed(quads.dedup(rows)).where(F.col("o_dt") == WKT_LITERAL).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SELECT result as one JSON object per row."""
    df = Engine(warehouse(spark, sf_dir)).sparql("SELECT ?r ?name WHERE { ?r c:r_name ?name }")
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents of all formats for bindings: each format's name and lines."""
    e = Engine(warehouse(spark, sf_dir))
    parts = []
    for form in ("json", "xml", "csv", "tsv"):
        d = e.document("SELECT ?r ?name ?k WHERE { ?r c:r_name ?name ; c:r_regionkey ?k }", form)
        parts.append(d.pieces.select(F.lit(form).alias("form"), "value"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of regions as documents of all formats for graphs."""
    e = Engine(warehouse(spark, sf_dir))
    parts = [e.document("CONSTRUCT { ?r <urn:k:name> ?name } WHERE { ?r c:r_name ?name }", form).pieces.select(F.lit(form).alias("form"), "value") for form in ("nt", "turtle", "jsonld", "rdfxml")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def framed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of the mapped tables as framed objects, regions embedded."""
    t = warehouse(spark, sf_dir).quads().where("g IN ('<urn:g:nation>', '<urn:g:region>') AND p IN ('<urn:c:n_name>', '<urn:c:r_name>', '<urn:r:n_regionkey>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>')")
    return results.framed(t, "urn:t:Nation", {"t": "urn:t:", "c": "urn:c:", "r": "urn:r:"}).select("json")


def frame_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects framed as JSON objects: predicate to sorted values."""
    q = _set(spark, sf_dir).select("s", "p", "o").distinct()
    lists = q.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("v")).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("m"))
    return lists.select("s", F.to_json(F.map_from_entries("m")).alias("json"))


def lws_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the data folder described as resources."""
    return files.items(spark, os.path.realpath(sf_dir)).select("name", "is_container", "size", "media_type", "n_items")


def container_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as quads."""
    return files.as_quads(files.items(spark, os.path.realpath(sf_dir)))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the second page."""
    return files.page_links(table(spark, sf_dir, "supplier"), 2, "urn:x-graph:suppliers/")


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a listing of suppliers."""
    return files.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), 2, "s_suppkey")


_FUNCTIONS = (
    find_spo, find_quads_any_graph, find_named_only, dump_gspo, dump_gpos, list_graphs, contains_graph, distinct_graphs, distinct_subjects, distinct_predicates, distinct_objects, count_triples, dedup_quads,
    store_roundtrip, load_nquads, export_nquads, sorted_chunks, bnode_relabel, dictionary_ids, void_stats, void_warehouse, void_property_partition, void_class_partition, void_vocabulary, void_urispace, void_quads, void_links,
    load_stats, geo_literals, result_json, result_documents, graph_documents, framed_json, frame_json, lws_items, container_tree, page_items, page_links,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_OK = "g IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"
_SET = f"(SELECT DISTINCT g, s, p, o FROM quads WHERE {_OK})"
_NUMERIC = "('xsd:integer', 'xsd:int', 'xsd:long', 'xsd:double', 'xsd:float', 'xsd:decimal')"
_FULL = "regexp_replace(o, '\"\\^\\^xsd:(\\w+)$', '\"^^<http://www.w3.org/2001/XMLSchema#\\1>')"
_TYPE = "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'"
_TYPED = f"p = '<{GEO_TYPE}>' AND o LIKE '<%' AND s LIKE '<%'"
_VOID = f"""SELECT g, count(*) AS triples, count(DISTINCT p) AS properties, count(DISTINCT o) FILTER (WHERE {_TYPED}) AS classes,
    count(DISTINCT s) AS distinct_subjects, count(DISTINCT o) AS distinct_objects, count(DISTINCT (o, s)) FILTER (WHERE {_TYPED}) AS entities FROM quads WHERE {_OK} GROUP BY g"""
_NAMESPACE = "CASE WHEN contains(t, '#') THEN regexp_extract(t, '^(.*#)', 1) WHEN contains(t, '/') THEN regexp_extract(t, '^(.*/)', 1) ELSE t || '#' END"
_VOCABULARY = f"SELECT DISTINCT g, r, trim(t, '<>') AS t FROM (SELECT g, 'p' AS r, p AS t FROM quads WHERE {_OK} UNION ALL SELECT g, 'o', o FROM quads WHERE {_OK} AND o LIKE '<%')"
_SPACE = f"""m AS (SELECT g, min(s)[2:-2] AS a, max(s)[2:-2] AS b FROM quads WHERE {_OK} AND s LIKE '<%' GROUP BY g),
    c AS (SELECT g, a, (SELECT coalesce(max(i), 0) FROM range(1, len(a) + 1) t(i) WHERE a[1:i] = b[1:i]) AS n FROM m), u AS (SELECT g, CASE WHEN len(x) > 10 THEN x END AS uri_space FROM (SELECT g, regexp_extract(a[1:n], '^(.*[#/])', 1) AS x FROM c))"""
#: Per mapped table the number of properties: type, columns and links.
_MAPPED = {"region": 3, "nation": 6, "customer": 7, "supplier": 6, "part": 7, "orders": 8, "lineitem": 15, "events": 10, "documents": 9, "images": 8}

ORACLES = {
    "find_spo": f"SELECT g, s, p, o FROM {_SET} WHERE g = '<{SHARED}>' AND p = '<{GEO_TYPE}>'",
    "find_quads_any_graph": f"SELECT g, s, p, o FROM {_SET} WHERE p = '<urn:x-graph:hal/reviewed>'",
    "find_named_only": f"SELECT g, s, p, o FROM {_SET} WHERE p = '<{GEO_TYPE}>' AND g <> '<urn:x-graph:default>'",
    "dump_gspo": f"SELECT g, s, p, o FROM {_SET}",
    "dump_gpos": f"SELECT g, s, p, o FROM {_SET}",
    "list_graphs": f"SELECT DISTINCT trim(g, '<>') AS g FROM quads WHERE {_OK} AND g <> '<urn:x-graph:default>'",
    "contains_graph": f"SELECT x AS g, EXISTS (SELECT 1 FROM quads WHERE {_OK} AND g = '<' || x || '>') AS there FROM (VALUES ('{SHARED}'), ('urn:x-graph:image/nowhere'), ('urn:x-graph:class/6')) t(x)",
    **{f"distinct_{n}": f"SELECT DISTINCT {c} FROM quads WHERE {_OK}" for n, c in (("graphs", "g"), ("subjects", "s"), ("predicates", "p"), ("objects", "o"))},
    "count_triples": f"SELECT count(*) AS n FROM quads WHERE {_OK}",
    "dedup_quads": f"SELECT (SELECT count(*) FROM quads WHERE {_OK}) AS n_rows, (SELECT count(*) FROM {_SET}) AS n_quads",
    "store_roundtrip": f"""SELECT DISTINCT g, s, p, o, CAST(CASE WHEN o LIKE '<%' THEN 2 ELSE 3 END AS INTEGER) AS o_kind, CASE WHEN o LIKE '<%' THEN trim(o, '<>') ELSE replace(regexp_extract(o, '^"(.*)"(@[^"]*|\\^\\^[^"]*)$', 1, 's'), '\\"', '"') END AS o_lex,
        CASE WHEN o LIKE '"%' THEN o_dt END AS o_dt, CASE WHEN o_dt = 'rdf:langString' THEN o_lang END AS o_lang,
        CASE WHEN o_dt IN {_NUMERIC} THEN TRY_CAST(regexp_extract(o, '^"(.*)"', 1, 's') AS DOUBLE) END AS o_num FROM quads WHERE {_OK}""",
    "load_nquads": f"SELECT g, s, p, o FROM {_SET}",
    "export_nquads": f"SELECT s || ' ' || p || ' ' || {_FULL} || CASE WHEN g <> '<urn:x-graph:default>' THEN ' ' || g ELSE '' END || ' .' AS value FROM {_SET}",
    "sorted_chunks": f"SELECT count(*) AS n_lines, 0 AS n_over, 0 AS n_unsorted FROM {_SET}",
    "bnode_relabel": "SELECT 2 * count(DISTINCT n_nationkey) AS subjects, 2 * count(DISTINCT n_regionkey) AS objects, 2 * count(*) AS n FROM nation",
    "dictionary_ids": f"""WITH q AS {_SET}, t AS (SELECT 'entity' AS role, g AS term FROM q UNION ALL SELECT 'entity', s FROM q UNION ALL SELECT 'predicate', p FROM q UNION ALL SELECT CASE WHEN o LIKE '"%' THEN 'literal' ELSE 'entity' END, o FROM q)
        SELECT role, term, count(*) AS n, row_number() OVER (PARTITION BY role ORDER BY term) AS id FROM t GROUP BY role, term""",
    "void_stats": _VOID,
    "void_warehouse": " UNION ALL ".join(f"SELECT '<urn:g:{t}>' AS g, {n} AS properties, 1 AS classes, count(*) AS distinct_subjects, count(*) AS entities FROM {t}" for t, n in _MAPPED.items()),
    "void_urispace": f"WITH {_SPACE} SELECT g, uri_space, '^' || regexp_replace(uri_space, '([.?+*()\\[\\]{{}}|^$\\\\])', '\\\\\\1', 'g') || '.*' AS uri_pattern FROM u",
    "void_links": f"""WITH {_SPACE}, q AS (SELECT * FROM quads WHERE {_OK}), v AS ({_VOCABULARY}) SELECT g, 'property' AS kind, trim(p, '<>') AS what, CAST(count(*) AS VARCHAR) AS n FROM q GROUP BY g, p
        UNION ALL SELECT g, 'class', trim(o, '<>'), CAST(count(DISTINCT s) AS VARCHAR) FROM q WHERE {_TYPED} GROUP BY g, o UNION ALL SELECT DISTINCT g, 'vocabulary', {_NAMESPACE}, NULL FROM v
        UNION ALL SELECT g, 'space', uri_space, NULL FROM u WHERE uri_space IS NOT NULL UNION ALL SELECT DISTINCT g, 'named', trim(g, '<>'), NULL FROM q WHERE g <> '<urn:x-graph:default>' UNION ALL SELECT DISTINCT g, 'default', NULL, NULL FROM q WHERE g = '<urn:x-graph:default>'""",
    "void_property_partition": f"SELECT g, p, count(*) AS triples, count(DISTINCT s) AS distinct_subjects, count(DISTINCT o) AS distinct_objects FROM quads WHERE {_OK} GROUP BY g, p",
    "void_class_partition": f"SELECT g, o AS class, count(DISTINCT s) AS entities FROM quads WHERE {_OK} AND {_TYPED} GROUP BY g, o",
    "void_vocabulary": f"SELECT g, {_NAMESPACE} AS vocabulary, count(*) FILTER (WHERE r = 'p') AS n_properties, count(*) FILTER (WHERE r = 'o') AS n_objects FROM ({_VOCABULARY}) GROUP BY 1, 2",
    "frame_json": f"""WITH v AS (SELECT s, p, to_json(list_sort(list(DISTINCT o))) AS l FROM {_SET} GROUP BY s, p) SELECT s, '{{' || string_agg(to_json(p) || ':' || l, ',' ORDER BY p) || '}}' AS json FROM v GROUP BY s""",
    "framed_json": """SELECT '{"@id":"t:nation/' || n_nationkey || '","@type":["t:Nation"],"c:n_name":["' || n_name || '"],"r:n_regionkey":[{"@id":"t:region/' || n_regionkey || '","@type":["t:Region"],"c:r_name":["' || r_name || '"]}]}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "result_documents": """SELECT 'json' AS form, '{"r":{"type":"uri","value":"urn:t:region/' || r_regionkey || '"},"name":{"type":"literal","value":"' || r_name || '"},"k":{"type":"literal","value":"' || r_regionkey || '","datatype":"http://www.w3.org/2001/XMLSchema#int"}}' AS value FROM region
        UNION ALL SELECT 'xml', '<result><binding name="r"><uri>urn:t:region/' || r_regionkey || '</uri></binding><binding name="name"><literal>' || r_name || '</literal></binding><binding name="k"><literal datatype="http://www.w3.org/2001/XMLSchema#int">' || r_regionkey || '</literal></binding></result>' FROM region
        UNION ALL SELECT 'csv', 'urn:t:region/' || r_regionkey || ',' || r_name || ',' || r_regionkey FROM region
        UNION ALL SELECT 'tsv', '<urn:t:region/' || r_regionkey || '>' || chr(9) || '"' || r_name || '"' || chr(9) || '"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#int>' FROM region""",
    "graph_documents": """WITH f AS (SELECT unnest(['nt', 'turtle']) AS form) SELECT form, '<urn:t:region/' || r_regionkey || '> <urn:k:name> "' || r_name || '" .' AS value FROM region, f
        UNION ALL SELECT 'jsonld', '{"@id":"urn:t:region/' || r_regionkey || '", "urn:k:name": [{"@value":"' || r_name || '"}]}' FROM region
        UNION ALL SELECT 'rdfxml', '<rdf:Description rdf:about="urn:t:region/' || r_regionkey || '"><n:name xmlns:n="urn:k:">' || r_name || '</n:name></rdf:Description>' FROM region""",
    "page_links": "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, 'urn:x-graph:suppliers/?page=1' AS first, 'urn:x-graph:suppliers/?page=1' AS prev, CASE WHEN 2 < ceil(count(*) / 20.0) THEN 'urn:x-graph:suppliers/?page=3' END AS next, 'urn:x-graph:suppliers/?page=' || CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS last FROM supplier",
    "void_quads": f"""WITH v AS ({_VOID}), x AS (SELECT g, unnest(['triples', 'properties', 'classes', 'distinctSubjects', 'distinctObjects', 'entities']) AS p, unnest([triples, properties, classes, distinct_subjects, distinct_objects, entities]) AS n FROM v)
        SELECT '<urn:x-graph:void>' AS g, g AS s, '<http://rdfs.org/ns/void#' || p || '>' AS p, '"' || n || '"^^xsd:integer' AS o FROM x""",
    "load_stats": f"SELECT o_dt, count(*) AS n, min(o_num) AS lo, max(o_num) AS hi, max(length(o_lex)) AS max_length FROM quads WHERE {_OK} GROUP BY o_dt",
    "geo_literals": "SELECT '<urn:x-graph:image/' || g || '>' AS g, count(DISTINCT (s, as_wkt)) AS n FROM geometries WHERE as_wkt IS NOT NULL AND s IS NOT NULL AND g IS NOT NULL GROUP BY geometries.g",
    "result_json": "SELECT '{\"r\":\"urn:t:region/' || r_regionkey || '\",\"name\":\"' || r_name || '\"}' AS json FROM region",
    "page_items": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 20",
}
