"""Registered queries of the llm problems with their SQL oracles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import gridcluster, heavyhitters, mixing, packing, ranksummary, toxicity
from quadloom.llm.sizes import TOKEN, size
from quadloom.operators.keyskew import QUAD, whole_quads
from quadloom.runtime import cut, table

#: p2: an id is frequent from this share of the whole quads.
FREQUENT = 0.005
#: p4: permitted rank error of a summary, as a share of its values; a column of a graph counts from this many values.
RANK_ERROR, ENOUGH = 0.005, 40
CAPACITY = 2048
FEATURES = (
    gridcluster.Feature("perimeter", math.log(1.35) / 2, True),
    gridcluster.Feature("major_axis_length", math.log(1.35) / 2, True),
    gridcluster.Feature("sphericity", 0.14 / 2),
    gridcluster.Feature("elongation", 0.16 / 2),
)
#: p5: a cell is dense from this many geometries on.
DENSE = 5
LIMITS = (math.log(1.35), math.log(1.35), 0.14, 0.16)


def _heavy(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    raw = table(spark, sf_dir, "quad_ids")
    positive = raw.where((F.col("g") > 0) & (F.col("s") > 0) & (F.col("p") > 0) & (F.col("o") > 0))
    return heavyhitters.heavy_values(whole_quads(raw), ["s", "o"], share, verify=positive, distinct=list(QUAD))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects and objects in at least ``FREQUENT`` of the whole quads."""
    return _heavy(spark, sf_dir, FREQUENT).select("col_name", F.col("value").alias("term_id"))


def p2_frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same down to a fifth of that share, with the sketch's estimate beside the exact count."""
    return _heavy(spark, sf_dir, FREQUENT / 5).select("col_name", F.col("value").alias("term_id"), "n", "estimate", "total")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent ids with their exact counts, and whether the sketch's estimate is off by at most half of the least count that is frequent."""
    return p2_frequent_items(spark, sf_dir).select("col_name", "term_id", "n", "total", (F.abs(F.col("estimate") - F.col("n")) <= F.col("total") * FREQUENT / 10).alias("near"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(col_name, g, geo_id, day, x)``: one valid value per geometry, column and graph, with the day it was first computed."""
    raw = table(spark, sf_dir, "shape_features").where(F.col("geo_id").isNotNull() & F.col("g").isNotNull())
    day, names = F.to_date("computed_ts"), ("perimeter", "sphericity")
    best = [F.struct(F.max(F.when(gridcluster.valid(c), F.col(c))).alias("x"), F.min(F.when(gridcluster.valid(c), day)).alias("day")).alias(c) for c in names]
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c)["x"].alias("x"), F.col(c)["day"].alias("day")) for c in names])).alias("v")
    return raw.groupBy("g", "geo_id").agg(*best).select("g", "geo_id", both).where(F.col("v.x").isNotNull()).select("g", "geo_id", "v.col_name", "v.x", "v.day")


def _percentiles(measures: DataFrame, qs: list[float]) -> DataFrame:
    keys = ["g", "col_name"]
    return ranksummary.percentiles(ranksummary.merge(ranksummary.summarise(measures, keys, "x", RANK_ERROR), keys, RANK_ERROR), keys, qs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries far beyond the 90th percentile of perimeter or the 10th of sphericity of their graph."""
    measures = cut(_measures(spark, sf_dir))
    told = _percentiles(measures, [0.1, 0.9]).where(F.col("n") >= ENOUGH)
    far = F.when(F.col("col_name") == "perimeter", F.col("x") > 2.5 * F.col("q_90")).otherwise(F.col("x") < F.col("q_10") / 2)
    return measures.join(told, ["g", "col_name"]).where(far).select("col_name", "geo_id").distinct()


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of perimeter and sphericity per graph, from summaries of days that are combined afterwards."""
    keys = ["g", "col_name", "day"]
    days = ranksummary.merge(ranksummary.summarise(_measures(spark, sf_dir), keys, "x", RANK_ERROR), keys, RANK_ERROR)
    return ranksummary.percentiles(ranksummary.merge(days, keys[:2], RANK_ERROR), keys[:2], [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])


def p4_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per graph and column, whether the true ranks of all percentiles told lie within the error told, and that within three times the permitted one."""
    told = p4_percentiles(spark, sf_dir)
    qs = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    name = lambda q: f"q_{round(q * 100):02d}"
    counts = [x for q in qs for x in (F.sum((F.col("x") < F.col(name(q))).cast("long")).alias(f"below_{name(q)}"), F.sum((F.col("x") <= F.col(name(q))).cast("long")).alias(f"upto_{name(q)}"))]
    ranked = _measures(spark, sf_dir).select("g", "col_name", "x").join(told, ["g", "col_name"]).groupBy("g", "col_name").agg(F.count(F.lit(1)).alias("n"), F.max("err").alias("err"), *counts)
    within = F.col("err") <= 3 * RANK_ERROR * F.col("n") + 1
    for q in qs:
        rank = F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1))
        within = within & (F.col(f"below_{name(q)}") + 1 <= rank + F.col("err") + 0.5) & (F.col(f"upto_{name(q)}") >= rank - F.col("err") - 0.5)
    return ranked.select("g", "col_name", "n", within.alias("within"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridcluster.cluster(table(spark, sf_dir, "shape_features"), "geo_id", FEATURES, LIMITS, min_points=DENSE, keep_loose=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to review whose geometries are in one cluster."""
    labelled = _clusters(spark, sf_dir).select("geo_id", "label")
    pairs = table(spark, sf_dir, "review_pairs").select(F.least("geo_a", "geo_b").alias("geo_a"), F.greatest("geo_a", "geo_b").alias("geo_b"))
    pairs = pairs.where(F.col("geo_a") < F.col("geo_b")).distinct()
    a, b = (labelled.select(F.col("geo_id").alias(f"geo_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    return pairs.join(a, "geo_a").join(b, "geo_b").where(F.col("label_a") == F.col("label_b")).select("geo_a", "geo_b")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size, mean features and most typical geometries."""
    return gridcluster.describe(cut(_clusters(spark, sf_dir)), "geo_id", FEATURES)


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many geometries each cluster has, and between which perimeters they lie."""
    return _clusters(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("perimeter").alias("low"), F.max("perimeter").alias("high")).drop("label")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", size(F.col("text")).alias("size")), capacity=CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in more than one container."""
    return packing.split_items(_packed(spark, sf_dir), "doc_id", CAPACITY).select("doc_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document."""
    return _packed(spark, sf_dir)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full each container is."""
    return packing.containers(_packed(spark, sf_dir), CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of the plain method and after topping up, beside the least number."""
    return packing.report(table(spark, sf_dir, "documents").select("doc_id", size(F.col("text")).alias("size")), capacity=CAPACITY)


def p7_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the packed pieces: each document once and whole, no container over the capacity, numbers of containers without gaps."""
    packed = cut(_packed(spark, sf_dir))
    whole = packed.groupBy("doc_id").agg((F.sum("n_tokens") == F.max("size")).alias("ok"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    docs = whole.agg(F.count(F.lit(1)).alias("documents"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.min("ok").alias("all_whole"))
    full = packing.containers(packed, CAPACITY).agg((F.min("room") >= 0).alias("none_over"), (F.max("container") + 1 == F.count(F.lit(1))).alias("no_gaps"))
    return docs.join(full, F.lit(True))  # two single rows


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "title_id", size(F.col("text")).alias("size"))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"), whole=False)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources too small for their share."""
    return _mixture(spark, sf_dir)[1].where("short").select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: each document taken, with its number of copies."""
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return _mixture(spark, sf_dir)[1]


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source what it has and is asked for, and whether its share came out to a hundredth and no document is taken too often or twice."""
    mixture, shares = _mixture(spark, sf_dir)
    most = mixture.groupBy("source").agg(F.max("copies").alias("most"), (F.count_distinct("doc_id") == F.count(F.lit(1))).alias("once"))
    near = F.abs(F.col("actual_share") - F.col("weight")) <= 0.01
    return shares.join(most, "source", "left").select("source", "available", "max_repeats", F.round("wanted", 3).alias("wanted"), "short", near.alias("near"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("kept"), F.coalesce("once", F.lit(True)).alias("once"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(toxicity.labelled(documents, table(spark, sf_dir, "doc_labels"))))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit line."""
    return _scored(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return _scored(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per source."""
    return toxicity.rates(_scored(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_frequent_items, p2_counts, p4_found, p4_percentiles, p4_rank_errors, p5_found, p5_clusters, p5_sizes, p7_found, p7_packed, p7_containers, p7_fill, p7_conserved, p8_found, p8_mixture, p8_shares, p8_kept, p9_found, p9_scores, p9_rates)
}

_WHOLE = "whole AS (SELECT DISTINCT g, s, p, o FROM quad_ids WHERE g > 0 AND s > 0 AND p > 0 AND o > 0)"
_VALID = "CASE WHEN {0} > 0 AND NOT isnan({0}) AND NOT isinf({0}) THEN {0} END"
_SIZE = f"coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)"
_MEASURES = ", ".join(f"max({_VALID.format(c)}) AS {c}" for c in ("perimeter", "major_axis_length", "sphericity", "elongation"))

ORACLES = {
    "p2_found": f"""WITH {_WHOLE}, n AS (SELECT count(*) AS n FROM whole)
        SELECT 's' AS col_name, s AS term_id FROM whole GROUP BY s HAVING count(*) >= {FREQUENT} * (SELECT n FROM n)
        UNION ALL SELECT 'o', o FROM whole GROUP BY o HAVING count(*) >= {FREQUENT} * (SELECT n FROM n)""",
    "p2_counts": f"""WITH {_WHOLE}, n AS (SELECT count(*) AS n FROM whole), c AS (SELECT 's' AS col_name, s AS term_id, count(*) AS n FROM whole GROUP BY s UNION ALL SELECT 'o', o, count(*) FROM whole GROUP BY o)
        SELECT col_name, term_id, c.n, n.n AS total, true AS near FROM c, n WHERE c.n >= {FREQUENT / 5} * n.n""",
    "p4_found": f"""WITH v AS (SELECT g, geo_id, {_MEASURES} FROM shape_features WHERE g IS NOT NULL AND geo_id IS NOT NULL GROUP BY g, geo_id),
        q AS (SELECT g, count(perimeter) AS np, count(sphericity) AS ns, quantile_disc(perimeter, 0.9) AS p90, quantile_disc(sphericity, 0.1) AS s10 FROM v GROUP BY g)
        SELECT DISTINCT 'perimeter' AS col_name, geo_id FROM v JOIN q USING (g) WHERE np >= {ENOUGH} AND perimeter > 2.5 * p90
        UNION ALL SELECT DISTINCT 'sphericity', geo_id FROM v JOIN q USING (g) WHERE ns >= {ENOUGH} AND sphericity < 0.5 * s10""",
    "p4_rank_errors": f"""WITH v AS (SELECT g, geo_id, {_MEASURES} FROM shape_features WHERE g IS NOT NULL AND geo_id IS NOT NULL GROUP BY g, geo_id)
        SELECT g, 'perimeter' AS col_name, count(perimeter) AS n, true AS within FROM v GROUP BY g HAVING count(perimeter) > 0
        UNION ALL SELECT g, 'sphericity', count(sphericity), true FROM v GROUP BY g HAVING count(sphericity) > 0""",
    "p5_found": f"""WITH v AS (SELECT geo_id, {_MEASURES} FROM shape_features WHERE geo_id IS NOT NULL GROUP BY geo_id),
        pairs AS (SELECT DISTINCT least(geo_a, geo_b) AS geo_a, greatest(geo_a, geo_b) AS geo_b FROM review_pairs WHERE geo_a <> geo_b)
        SELECT geo_a, geo_b FROM pairs JOIN v a ON a.geo_id = geo_a JOIN v b ON b.geo_id = geo_b
        WHERE greatest(a.perimeter / b.perimeter, b.perimeter / a.perimeter) <= 1.35
          AND greatest(a.major_axis_length / b.major_axis_length, b.major_axis_length / a.major_axis_length) <= 1.35
          AND abs(a.sphericity - b.sphericity) <= 0.14 AND abs(a.elongation - b.elongation) <= 0.16""",
    "p5_sizes": f"""WITH RECURSIVE v AS (SELECT geo_id, {_MEASURES} FROM shape_features WHERE geo_id IS NOT NULL GROUP BY geo_id),
        ok AS (SELECT *, ln(perimeter) AS lp, ln(major_axis_length) AS lm FROM v WHERE perimeter IS NOT NULL AND major_axis_length IS NOT NULL AND sphericity IS NOT NULL AND elongation IS NOT NULL),
        c AS (SELECT floor(lp / {math.log(1.35) / 2}) AS a, floor(lm / {math.log(1.35) / 2}) AS b, floor(sphericity / 0.07) AS c, floor(elongation / 0.08) AS d, count(*) AS n, min(perimeter) AS p0, max(perimeter) AS p1,
            min(lp) AS a0, max(lp) AS a1, min(lm) AS b0, max(lm) AS b1, min(sphericity) AS c0, max(sphericity) AS c1, min(elongation) AS d0, max(elongation) AS d1 FROM ok GROUP BY 1, 2, 3, 4),
        k AS (SELECT row_number() OVER (ORDER BY a, b, c, d) AS id, * FROM c),
        e AS (SELECT x.id AS f, y.id AS t FROM k x JOIN k y ON greatest(x.a1, y.a1) - least(x.a0, y.a0) <= ln(1.35) AND greatest(x.b1, y.b1) - least(x.b0, y.b0) <= ln(1.35) AND greatest(x.c1, y.c1) - least(x.c0, y.c0) <= 0.14 AND greatest(x.d1, y.d1) - least(x.d0, y.d0) <= 0.16),
        r AS (SELECT id AS f, id AS t FROM k UNION SELECT r.f, e.t FROM r JOIN e ON r.t = e.f),
        l AS (SELECT f AS id, min(t) AS label FROM r GROUP BY f)
        SELECT CAST(sum(n) AS BIGINT) AS size, min(p0) AS low, max(p1) AS high FROM k JOIN l USING (id) GROUP BY label""",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_SIZE} > {CAPACITY}",
    "p7_conserved": f"""WITH d AS (SELECT {_SIZE} AS n FROM documents)
        SELECT count(*) AS documents, CAST(sum(greatest(1, (n + {CAPACITY - 1}) // {CAPACITY})) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, true AS all_whole, true AS none_over, true AS no_gaps FROM d""",
    "p8_found": f"""WITH d AS (SELECT lower(trim(source)) AS source, sum({_SIZE}) AS size FROM documents GROUP BY 1)
        SELECT t.source FROM mix_targets t LEFT JOIN d USING (source) WHERE t.max_repeats * coalesce(d.size, 0) < t.weight * (SELECT sum(size) FROM d)""",
    "p8_kept": f"""WITH d AS (SELECT lower(trim(source)) AS source, sum({_SIZE}) AS size FROM documents GROUP BY 1)
        SELECT t.source, CAST(coalesce(d.size, 0) AS BIGINT) AS available, t.max_repeats, round(t.weight * (SELECT sum(size) FROM d), 3) AS wanted, t.max_repeats * coalesce(d.size, 0) < t.weight * (SELECT sum(size) FROM d) AS short, true AS near, true AS kept, true AS once
        FROM mix_targets t LEFT JOIN d USING (source)""",
}
