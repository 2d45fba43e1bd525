"""Registered queries of the general data problems (p1, p3, p6) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import keyskew, widen
from quadloom.plans.spatial_queries import EDGES
from quadloom.runtime import cut, table
from quadloom.spatial import nearby

#: A key of p1 is reported from this share of all whole quads, in per cent.
HOT_PER_CENT = 4
#: Two geometries of p3 are close up to this distance of their places, in pixels.
NEAR_PIXELS = 13


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs, predicates and pairs that hold at least ``HOT_PER_CENT`` of the whole quads."""
    keys = cut(keyskew.profile_keys(keyskew.positive(table(spark, sf_dir, "quad_ids"))))
    total = keys.where((F.col("g") != keyskew.ANY_ID) & (F.col("p") != keyskew.ANY_ID)).agg(F.sum("n_rows")).first()[0] or 0
    return keys.where(F.col("n_rows") * 100 >= F.lit(HOT_PER_CENT * total)).select("g", "p")


def p1_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads, distinct subjects, most frequent subject and quads per subject of every graph, predicate and pair."""
    return keyskew.profile_keys(keyskew.positive(table(spark, sf_dir, "quad_ids")))


def _geometry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    places = cut(nearby.places(table(spark, sf_dir, "geometries")))
    annotations = table(spark, sf_dir, "annotations").select(F.col("annotation_id").alias("region"), "g", "as_wkt")
    return places, annotations


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of close geometries of an image, and of geometries and the annotations they lie in."""
    places, annotations = _geometry(spark, sf_dir)
    inside = nearby.points_in_regions(places, annotations)
    return nearby.pairs_within(places, 2 * NEAR_PIXELS).unionByName(
        inside.select(F.least("geo_id", "region").alias("id_a"), F.greatest("geo_id", "region").alias("id_b"))
    )


def p3_near_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per placed geometry with the numbers of close geometries and of annotations around it."""
    places, annotations = _geometry(spark, sf_dir)
    pairs = nearby.pairs_within(places, 2 * NEAR_PIXELS)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("geo_id")).groupBy("geo_id").agg(F.count(F.lit(1)).alias("n_near"))
    around = nearby.points_in_regions(places, annotations).groupBy("geo_id").agg(F.count(F.lit(1)).alias("n_regions"))
    return (
        places.select("geo_id", "g").join(ends, "geo_id", "left").join(around, "geo_id", "left").select("geo_id", "g", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_regions", F.lit(0)).alias("n_regions"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the wide table without a readable value or with several."""
    states = widen.cell_states(table(spark, sf_dir, "quads"), table(spark, sf_dir, "wide_columns"))
    return states.where(F.col("cell_state") != "single").select("s", "attr", "cell_state")


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per subject."""
    return widen.widen(table(spark, sf_dir, "quads"), table(spark, sf_dir, "wide_columns"))


QUERIES = {f.__name__: f for f in (p1_found, p1_key_profile, p3_found, p3_near_counts, p6_found, p6_wide)}

_WHOLE = "whole AS (SELECT DISTINCT g, s, p, o FROM quad_ids WHERE g > 0 AND s > 0 AND p > 0 AND o > 0)"
_KEYED = f"""{_WHOLE}, keyed AS (
  SELECT g, p, s FROM whole UNION ALL SELECT g, -9 AS p, s FROM whole UNION ALL SELECT -9 AS g, p, s FROM whole)"""
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_CELLS = f"""lexed AS (
  SELECT q.s, w.attr, w.value_type AS vt, q.o_kind, trim(q.o_lex, {_BLANK}) AS t, q.load_ts, q.seq
  FROM quads q JOIN (SELECT DISTINCT attr, value_type, p FROM wide_columns) w ON q.p = w.p WHERE q.s IS NOT NULL),
read AS (SELECT s, attr, vt, load_ts, seq, CASE
    WHEN vt = 'iri' AND o_kind = 2 AND t <> '' THEN t
    WHEN o_kind <> 3 THEN NULL
    WHEN vt = 'string' AND t <> '' THEN t
    WHEN vt = 'long' AND regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(CAST(t AS HUGEINT) AS VARCHAR)
    WHEN vt = 'double' AND regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(TRY_CAST(t AS DOUBLE) AS VARCHAR)
    WHEN vt = 'boolean' AND t IN ('true', '1') THEN 'true'
    WHEN vt = 'boolean' AND t IN ('false', '0') THEN 'false'
    WHEN vt = 'timestamp' AND regexp_full_match(t, '[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]T[0-9][0-9]:[0-9][0-9]:[0-9][0-9]([.][0-9]+)?(Z|[+-][0-9][0-9]:[0-9][0-9])?')
      THEN CAST(epoch_us(TRY_CAST(CASE WHEN regexp_matches(t, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN t ELSE t || 'Z' END AS TIMESTAMPTZ)) AS VARCHAR)
  END AS v FROM lexed)"""
_TYPED = {"iri": "{}", "string": "{}", "long": "CAST({} AS BIGINT)", "double": "CAST({} AS DOUBLE)", "boolean": "CAST({} AS BOOLEAN)", "timestamp": "make_timestamp(CAST({} AS BIGINT))"}
_WIDE = {
    "begin_index": "long", "classification": "iri", "color": "string", "created": "timestamp", "elongation": "double", "height": "long", "kind": "iri", "label": "string", "layer_num": "long",
    "major_axis_length": "double", "mesh_surface": "double", "opacity": "double", "perimeter": "double", "probability": "double", "reviewed": "boolean", "scales": "long", "sphericity": "double", "width": "long",
}

#: Places of geometries, from decoded corners or texts: place(geo_id, g, x, y), and the pairs of the problem: near(a, b), inside(a, b).
_PLACES = f"""RECURSIVE {EDGES}, c AS (SELECT geo_id, min(g) AS g, max(list_filter(hilbert_corners, lambda v: v >= 0)) AS cs FROM geometries WHERE geo_id IS NOT NULL AND g IS NOT NULL GROUP BY geo_id),
    d AS (SELECT geo_id, h, h AS t, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, 0 AS j FROM (SELECT DISTINCT geo_id, unnest(cs) AS h FROM c) UNION ALL
      SELECT geo_id, h, t >> 2, CASE WHEN ry = 0 THEN fy ELSE fx END + (side * rx), CASE WHEN ry = 0 THEN fx ELSE fy END + (side * ry), j + 1
      FROM (SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN side - 1 - x ELSE x END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN side - 1 - y ELSE y END AS fy
        FROM (SELECT *, (t >> 1) & 1 AS rx, xor(t, (t >> 1) & 1) & 1 AS ry, CAST(1 AS BIGINT) << j AS side FROM d WHERE j < 17))),
    place AS (SELECT c.geo_id, c.g, coalesce(q.x, (b.x0 + b.x1) / 2) AS x, coalesce(q.y, (b.y0 + b.y1) / 2) AS y FROM c
      LEFT JOIN (SELECT geo_id, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y FROM d WHERE j = 17 GROUP BY geo_id) q USING (geo_id) LEFT JOIN box b ON b.k = c.geo_id AND q.x IS NULL WHERE coalesce(q.x, b.x0) IS NOT NULL),
    near AS (SELECT m.geo_id AS a, n.geo_id AS b FROM place m JOIN place n ON m.g = n.g AND m.geo_id < n.geo_id AND abs(m.x - n.x) <= {NEAR_PIXELS} WHERE (m.x - n.x) * (m.x - n.x) + (m.y - n.y) * (m.y - n.y) <= {NEAR_PIXELS ** 2}),
    side AS (SELECT m.geo_id AS a, e.k AS b, e.pg, (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1) AS s, x, y, e.x1, e.y1, e.x2, e.y2 FROM place m JOIN annotations r ON m.g = r.g JOIN box o ON o.k = r.annotation_id AND x BETWEEN o.x0 AND o.x1 AND y BETWEEN o.y0 AND o.y1 JOIN e ON e.k = r.annotation_id),
    inside AS (SELECT DISTINCT a, b FROM (SELECT a, b, pg FROM side GROUP BY a, b, pg HAVING bool_or(s = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) OR count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND (s > 0) = (y2 > y1)) % 2 = 1))"""

ORACLES = {
    "p3_found": f"WITH {_PLACES} SELECT a AS id_a, b AS id_b FROM near UNION ALL SELECT least(a, b), greatest(a, b) FROM inside",
    "p3_near_counts": f"""WITH {_PLACES}, n AS (SELECT v, count(*) AS n FROM (SELECT a AS v FROM near UNION ALL SELECT b FROM near) GROUP BY v), r AS (SELECT a AS v, count(*) AS n FROM inside GROUP BY a)
        SELECT geo_id, g, coalesce(n.n, 0) AS n_near, coalesce(r.n, 0) AS n_regions FROM place LEFT JOIN n ON n.v = geo_id LEFT JOIN r ON r.v = geo_id""",
    "p1_found": f"""WITH {_KEYED} SELECT g, p FROM keyed GROUP BY g, p
        HAVING count(*) * 100 >= {HOT_PER_CENT} * (SELECT count(*) FROM whole)""",
    "p1_key_profile": f"""WITH {_KEYED}, w AS (SELECT g, p, s, count(*) AS n FROM keyed GROUP BY g, p, s)
        SELECT g, p, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_values, arg_max(s, (n, -s)) AS mode_value, max(n) AS mode_count,
          quantile_cont(n, 0.5) AS freq_p50, quantile_cont(n, 0.9) AS freq_p90 FROM w GROUP BY g, p""",
    "p6_found": f"""WITH {_CELLS} SELECT s, attr, CASE WHEN count(v) = 0 THEN 'unreadable' ELSE 'multiple' END AS cell_state
        FROM read GROUP BY s, attr HAVING count(v) = 0 OR count(DISTINCT v) > 1""",
    "p6_wide": f"""WITH {_CELLS}, cells AS (SELECT s, attr, count(v) AS n, count(DISTINCT v) AS d, arg_max(v, (coalesce(load_ts, TIMESTAMP '0001-01-01'), seq)) FILTER (WHERE v IS NOT NULL) AS v
        FROM read GROUP BY s, attr) SELECT s, """
    + ", ".join(_TYPED[k].format(f"max(v) FILTER (WHERE attr = '{a}')") + f" AS {a}" for a, k in _WIDE.items())
    + """, CAST(count(*) FILTER (WHERE d > 1) AS INTEGER) AS n_multiple, CAST(count(*) FILTER (WHERE n = 0) AS INTEGER) AS n_unreadable FROM cells GROUP BY s""",
}
