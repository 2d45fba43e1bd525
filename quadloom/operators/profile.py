"""Statistics of a quad table: per-graph description, partitions by property and class, vocabularies and load figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.terms import DEFAULT_GRAPH, RDF_TYPE, escaped

VOID_GRAPH, VOID, SD = "urn:x-graph:void", "http://rdfs.org/ns/void#", "http://www.w3.org/ns/sparql-service-description#"
DATASET = "urn:x-graph:dataset"
TYPE = f"<{RDF_TYPE}>"


def void_stats(quads: DataFrame, type_iri: str = RDF_TYPE) -> DataFrame:
    """``(g, triples, properties, classes, distinct_subjects, distinct_objects, entities)`` per graph.

    A class is an IRI that some IRI has as its type; entities are the instances of the classes, added up.
    Each count of distinct terms is a two-step aggregation: terms are first made unique per graph and role, so
    that a graph with most of the rows isn't one task's work.
    """
    typed = (F.col("p") == f"<{type_iri}>") & F.col("o").startswith("<") & F.col("s").startswith("<")
    roles = F.array(
        F.struct(F.lit("s").alias("role"), F.col("s").alias("t")),
        F.struct(F.lit("p").alias("role"), F.col("p").alias("t")),
        F.struct(F.lit("o").alias("role"), F.col("o").alias("t")),
        F.struct(F.lit("c").alias("role"), F.when(typed, F.col("o")).alias("t")),
        F.struct(F.lit("e").alias("role"), F.when(typed, F.concat("o", F.lit(" "), "s")).alias("t")),
    )
    terms = quads.select("g", F.explode(roles).alias("x")).where("x.t IS NOT NULL").groupBy("g", F.col("x.role").alias("role"), F.col("x.t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    per_role = terms.groupBy("g", "role").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    one = lambda role, c: F.coalesce(F.max(F.when(F.col("role") == role, F.col(c))), F.lit(0)).cast("long")
    return per_role.groupBy("g").agg(one("s", "n").alias("triples"), one("p", "k").alias("properties"), one("c", "k").alias("classes"), one("s", "k").alias("distinct_subjects"), one("o", "k").alias("distinct_objects"), one("e", "k").alias("entities"))


def property_partition(quads: DataFrame) -> DataFrame:
    """``(g, p, triples, distinct_subjects, distinct_objects)``."""
    roles = F.array(F.struct(F.lit("s").alias("r"), F.col("s").alias("t")), F.struct(F.lit("o").alias("r"), F.col("o").alias("t")))
    unique = quads.select("g", "p", F.explode(roles).alias("x")).groupBy("g", "p", F.col("x.r").alias("r"), F.col("x.t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    is_s = F.col("r") == "s"
    return unique.groupBy("g", "p").agg(F.sum(F.when(is_s, F.col("n"))).alias("triples"), F.sum(is_s.cast("long")).alias("distinct_subjects"), F.sum((~is_s).cast("long")).alias("distinct_objects"))


def class_partition(quads: DataFrame, type_iri: str = RDF_TYPE) -> DataFrame:
    """``(g, class, entities)`` of the classes that are IRIs, with their instances that are IRIs."""
    typed = (F.col("p") == f"<{type_iri}>") & F.col("o").startswith("<") & F.col("s").startswith("<")
    return quads.where(typed).select("g", F.col("o").alias("class"), "s").distinct().groupBy("g", "class").agg(F.count(F.lit(1)).alias("entities"))


def namespace(iri):
    """IRI text up to its last #, else its last /, else the IRI with a # added."""
    text = F.regexp_replace(iri, "^<|>$", "")
    return F.when(text.contains("#"), F.regexp_extract(text, r"^(.*#)", 1)).when(text.contains("/"), F.regexp_extract(text, r"^(.*/)", 1)).otherwise(F.concat(text, F.lit("#")))


def vocabulary(quads: DataFrame) -> DataFrame:
    """``(g, vocabulary, n_properties, n_objects)``: namespaces of the different properties and IRI objects of a graph, with their numbers."""
    roles = F.array(F.struct(F.lit("p").alias("r"), F.col("p").alias("t")), F.struct(F.lit("o").alias("r"), F.when(F.col("o").startswith("<"), F.col("o")).alias("t")))
    unique = quads.select("g", F.explode(roles).alias("x")).where("x.t IS NOT NULL").select("g", "x.r", "x.t").distinct()
    count = lambda r: F.sum((F.col("r") == r).cast("long"))
    return unique.groupBy("g", namespace(F.col("t")).alias("vocabulary")).agg(count("p").alias("n_properties"), count("o").alias("n_objects"))


def uri_space(quads: DataFrame) -> DataFrame:
    """``(g, uri_space, uri_pattern)``: longest common prefix of the IRI subjects, cut at its last / or #, if longer than ten characters.

    The common prefix of a set is that of its smallest and largest member, so two aggregates are enough.
    """
    ends = quads.where(F.col("s").startswith("<")).groupBy("g").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    a, b = F.regexp_replace("a", "^<|>$", ""), F.regexp_replace("b", "^<|>$", "")
    both = F.least(F.length(a), F.length(b))
    ends = ends.withColumns({"a": a, "b": b, "m": both})
    same = F.aggregate(F.sequence(F.lit(1), F.greatest("m", F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(F.col("a"), i, F.lit(1)) == F.substring(F.col("b"), i, F.lit(1))), i).otherwise(k))
    prefix = F.regexp_extract(F.substring(F.col("a"), F.lit(1), same), r"^(.*[#/])", 1)
    return ends.select("g", F.when(F.length(prefix) > 10, prefix).alias("uri_space")).select("g", "uri_space", F.concat(F.lit("^"), F.regexp_replace("uri_space", r"([.?+*()\[\]{}|^$\\])", r"\\$1"), F.lit(".*")).alias("uri_pattern"))


def void_quads(quads: DataFrame, type_iri: str = RDF_TYPE) -> DataFrame:
    """The description as quads of the void graph: counts, partitions by property and class, vocabularies, URI space, and the dataset with its graphs."""
    iri = lambda text: F.lit(f"<{text}>")
    number = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"^^xsd:integer'))
    string = lambda c: F.concat(F.lit('"'), escaped(F.col(c)), F.lit('"^^xsd:string'))

    def spread(df: DataFrame, *items) -> DataFrame:
        """Rows (s, p, o) of several statements for each row."""
        cells = F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in items])
        return df.select(F.explode(cells).alias("x")).select("x.s", "x.p", "x.o").where("o IS NOT NULL")

    g = F.col("g")
    node = lambda kind, *c: F.concat(F.lit(f"_:{kind}"), F.md5(F.concat_ws(" ", *c)))
    names = {"triples": "triples", "properties": "properties", "classes": "classes", "distinct_subjects": "distinctSubjects", "distinct_objects": "distinctObjects", "entities": "entities"}
    stats = void_stats(quads, type_iri)
    described = spread(stats, *[(g, iri(VOID + v), number(c)) for c, v in names.items()], (g, F.lit(TYPE), iri(VOID + "Dataset")), (g, F.lit(TYPE), iri(SD + "Graph")))
    default = g == f"<{DEFAULT_GRAPH}>"
    named = node("ng", g)
    listed = spread(
        stats.select("g"),
        (iri(DATASET), F.when(default, iri(SD + "defaultGraph")).otherwise(iri(SD + "namedGraph")), F.when(default, g).otherwise(named)),
        (named, F.lit(TYPE), F.when(~default, iri(SD + "NamedGraph"))),
        (named, iri(SD + "name"), F.when(~default, g)),
        (named, iri(SD + "graph"), F.when(~default, g)),
    )
    dataset = quads.sparkSession.createDataFrame([(f"<{DATASET}>", TYPE, f"<{SD}Dataset>")], "s string, p string, o string")
    by_property = node("pp", g, F.col("p"))
    properties = spread(property_partition(quads).where(F.col("p").startswith("<")), (g, iri(VOID + "propertyPartition"), by_property), (by_property, iri(VOID + "property"), F.col("p")), (by_property, iri(VOID + "triples"), number("triples")))
    by_class = node("cp", g, F.col("class"))
    classes = spread(class_partition(quads, type_iri), (g, iri(VOID + "classPartition"), by_class), (by_class, iri(VOID + "class"), F.col("class")), (by_class, iri(VOID + "entities"), number("entities")))
    spaces = spread(vocabulary(quads), (g, iri(VOID + "vocabulary"), F.concat(F.lit("<"), F.col("vocabulary"), F.lit(">"))))
    common = spread(uri_space(quads), (g, iri(VOID + "uriSpace"), string("uri_space")), (g, iri(VOID + "uriRegexPattern"), string("uri_pattern")))
    out = described
    for df in (listed, dataset, properties, classes, spaces, common):
        out = out.unionByName(df)
    return out.select(F.lit(f"<{VOID_GRAPH}>").alias("g"), "s", "p", "o")


def load_stats(quads: DataFrame) -> DataFrame:
    """``(o_dt, n, lo, hi, max_length)`` of the objects by datatype; IRIs and blank nodes have none."""
    return quads.groupBy("o_dt").agg(F.count(F.lit(1)).alias("n"), F.min("o_num").alias("lo"), F.max("o_num").alias("hi"), F.max(F.length("o_lex")).cast("long").alias("max_length"))


def dictionary(quads: DataFrame) -> DataFrame:
    """``(role, term, n)``: the distinct terms in the roles entity (g, s and IRI objects), predicate and literal, with their uses."""
    roles = F.array(
        F.struct(F.lit("entity").alias("role"), F.col("g").alias("term")),
        F.struct(F.lit("entity").alias("role"), F.col("s").alias("term")),
        F.struct(F.lit("predicate").alias("role"), F.col("p").alias("term")),
        F.struct(F.when(F.col("o").startswith('"'), F.lit("literal")).otherwise(F.lit("entity")).alias("role"), F.col("o").alias("term")),
    )
    return quads.select(F.explode(roles).alias("x")).where("x.term IS NOT NULL").groupBy("x.role", "x.term").agg(F.count(F.lit(1)).alias("n"))


def dictionary_ids(quads: DataFrame) -> DataFrame:
    """``(role, term, n, id)``: ids from 1 in term order within a role.

    Ranks come from a range sort: positions inside a sorted partition plus the counts of those before it.
    """
    from pyspark.sql import Window

    from quadloom.runtime import cut

    sorted_ = cut(dictionary(quads).repartitionByRange("role", "term").withColumn("__part", F.spark_partition_id()))
    counts = sorted_.groupBy("role", "__part").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select(F.col("role").alias("__r"), F.col("__part").alias("__q"), F.coalesce(F.sum("__c").over(Window.partitionBy("role").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("role", "__part").orderBy("term"))
    return sorted_.withColumn("__rank", rank).join(before, (F.col("role") == F.col("__r")) & (F.col("__part") == F.col("__q"))).select("role", "term", "n", (F.col("__before") + F.col("__rank")).cast("long").alias("id"))
