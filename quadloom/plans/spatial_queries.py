"""Registered spatial queries over the geometries and annotations, and some over rectangles made from part keys, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.runtime import shuffle_width, table
from quadloom.sources import quads
from quadloom.spatial import derived, geometry, hilbert, index, ranges, wkt
from quadloom.terms import DEFAULT_GRAPH, WKT_LITERAL, Kind, escaped, text

BOX = (20000, 20000, 30000, 30000)
TRIANGLE = [(15000, 12000), (70000, 25000), (30000, 60000)]  # anticlockwise
#: Random query boxes of the batched join.
BOXES, BOX_SIDE = 1000, 255


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, x0, y0, x1, y1, as_wkt)``: an axis-aligned rectangle for each part."""
    k = F.col("p_partkey")
    x0, y0 = (k * 7919) % 100000, (k * 104729) % 80000
    parts = table(spark, sf_dir, "part").select("p_partkey").repartition(shuffle_width(spark), "p_partkey")  # polygon work is heavy, the file small
    df = parts.select(k.alias("k"), x0.alias("x0"), y0.alias("y0"), (x0 + 10 + (k % 37) * 40).alias("x1"), (y0 + 10 + (k % 23) * 30).alias("y1"))
    return df.withColumn("as_wkt", F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", "x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, as_wkt)``: the texts of the detected objects and of the annotated regions, whose numbers differ."""
    geometries = table(spark, sf_dir, "geometries").where("as_wkt IS NOT NULL").groupBy(F.col("geo_id").alias("k")).agg(F.max("as_wkt").alias("as_wkt"))
    regions = table(spark, sf_dir, "annotations").where("as_wkt IS NOT NULL").select(F.col("annotation_id").alias("k"), "as_wkt")
    return geometries.unionByName(regions)


def cornered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, h)``: objects with a readable text and the curve positions of all their corners, as the data have them."""
    g = table(spark, sf_dir, "geometries").where("as_wkt IS NOT NULL AND size(filter(hilbert_corners, v -> v IS NOT NULL)) = 4")
    one = g.groupBy(F.col("geo_id").alias("k")).agg(F.max("hilbert_corners").alias("hilbert_corners"), F.max("as_wkt").alias("as_wkt"))
    readable = geometry.framed(one, "k", "as_wkt").select(F.col("__k").alias("k"))
    return one.join(readable, "k", "left_semi").select("k", F.explode("hilbert_corners").alias("h"))


def sf_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that meet a constant region, as a query over quads with a tile index made from the corners."""
    as_wkt = "<http://www.opengis.net/ont/geosparql#asWKT>"
    g = table(spark, sf_dir, "geometries").withColumn("s", text(Kind("iri"), F.col("s")))
    q = g.where("as_wkt IS NOT NULL").select(F.lit(f"<{DEFAULT_GRAPH}>").alias("g"), "s", F.lit(as_wkt).alias("p"), F.concat(F.lit('"'), escaped(F.col("as_wkt")), F.lit(f'"^^<{WKT_LITERAL}>')).alias("o"))
    x0, y0, x1, y1 = BOX
    region = f"POLYGON(({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"
    source = quads.QuadSource(q, tiles=index.of_corners(g, "s", as_wkt, "hilbert_corners", "as_wkt"))
    return Engine(source).sparql(f'SELECT DISTINCT ?geo WHERE {{ ?geo geo:asWKT ?wkt FILTER(geof:sfIntersects(?wkt, "{region}"^^geo:wktLiteral)) }}')


def batch_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shapes that meet each of ``BOXES`` boxes, in one join."""
    i = F.col("id")
    boxes = spark.range(BOXES).select(i.alias("b"), ((i * 75577) % 100000).alias("x0"), ((i * 50021) % 80000).alias("y0"), ((i * 75577) % 100000 + BOX_SIDE).alias("x1"), ((i * 50021) % 80000 + BOX_SIDE).alias("y1"))
    return geometry.batch_intersects(shapes(spark, sf_dir), boxes, "k", "b")


def spatial_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a corner in the box: curve ranges narrow down, the decoded corner decides."""
    return _within(cornered(spark, sf_dir), hilbert.cover_box(*BOX), lambda p: p["x"].between(BOX[0], BOX[2]) & p["y"].between(BOX[1], BOX[3])).select("k").distinct()


def _within(corners: DataFrame, ranges: list[tuple[int, int]], exact) -> DataFrame:
    return geometry.in_ranges(corners, "h", ranges).withColumn("p", hilbert.hilbert_point(F.col("h"))).where(exact(F.col("p")))


def hilbert_ranges_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in a box, by curve ranges."""
    return _within(cornered(spark, sf_dir), hilbert.cover_box(*BOX), lambda p: p["x"].between(BOX[0], BOX[2]) & p["y"].between(BOX[1], BOX[3])).select("k", "p.x", "p.y").distinct()


def hilbert_ranges_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in a triangle, by the curve ranges of the polygon."""
    (ax, ay), (bx, by), (cx, cy) = TRIANGLE
    found = wkt.polygons(f"POLYGON (({ax} {ay}, {bx} {by}, {cx} {cy}, {ax} {ay}))")

    def inside(p):
        side = [(x2 - x1) * (p["y"] - y1) - (y2 - y1) * (p["x"] - x1) >= 0 for (x1, y1), (x2, y2) in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1], strict=True)]
        return side[0] & side[1] & side[2]

    return _within(cornered(spark, sf_dir), hilbert.cover_polygon(found), inside).select("k", "p.x", "p.y").distinct()


def hilbert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the data as points, each once: they are those of the box of the text."""
    return cornered(spark, sf_dir).select("k", hilbert.hilbert_point(F.col("h")).alias("p")).select("k", "p.x", "p.y").distinct()


def hilbert_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve positions of the corners, computed from the texts, beside those of the data."""
    have = cornered(spark, sf_dir).distinct()
    texts = shapes(spark, sf_dir).join(have.select("k").distinct(), "k", "left_semi")
    return geometry.framed(texts, "k", "as_wkt").select(F.col("__k").alias("k"), F.explode(F.array(*[hilbert.hilbert_index(F.col(f"__b.{x}"), F.col(f"__b.{y}")) for x, y in (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"))])).alias("h")).distinct()


def hilbert_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve position of the centres, read back."""
    b = geometry.framed(shapes(spark, sf_dir), "k", "as_wkt")
    p = b.select(F.col("__k").alias("k"), hilbert.hilbert_point(hilbert.hilbert_index(F.floor((F.col("__b.x0") + F.col("__b.x1")) / 2), F.floor((F.col("__b.y0") + F.col("__b.y1")) / 2))).alias("p"))
    return p.select("k", "p.x", "p.y")


def hilbert_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four corner positions of the rectangles, read back."""
    c = rectangles(spark, sf_dir).select("k", F.posexplode(geometry.corners(F.col("as_wkt"))).alias("i", "h"))
    return c.select("k", "i", hilbert.hilbert_point(F.col("h")).alias("p")).select("k", "i", "p.x", "p.y")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_type", ((k * 37) % 100003).alias("a"), ((k * 37) % 100003 + (k % 29)).alias("b"))


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and adjacent ranges merged per event type."""
    return geometry.merge_ranges(_spans(spark, sf_dir), "a", "b", ["event_type"])


def range_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells covered per event type."""
    return merge_ranges(spark, sf_dir).groupBy("event_type").agg(F.sum(F.col("high") - F.col("low") + 1).alias("area"), F.min("low").alias("lo"), F.max("high").alias("hi"))


def range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the cells that the curve positions of each event type cover."""
    q = ranges.range_squares(merge_ranges(spark, sf_dir), ["event_type"], "low", "high")
    return q.groupBy("event_type").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max(F.col("x") + F.col("side")) - 1).alias("x1"), (F.max(F.col("y") + F.col("side")) - 1).alias("y1"), F.sum(F.col("side") * F.col("side")).alias("cells"))


def range_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys in the merged ranges of one event type."""
    merged = geometry.merge_ranges(_spans(spark, sf_dir).where("event_type = 'error'"), "a", "b")
    return geometry.in_merged(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", merged, cell=1000)


def wkt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and point counts of the shapes, and whether they can be used."""
    return geometry.parsed(shapes(spark, sf_dir), "k", "as_wkt")


def degenerate_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes whose text can't be used."""
    return geometry.parsed(shapes(spark, sf_dir), "k", "as_wkt").where("degenerate").select("k")


def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """512-pixel tiles that the shapes meet."""
    return geometry.tiles(shapes(spark, sf_dir), ["k"], "as_wkt")


def grid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects per tile and image."""
    g = table(spark, sf_dir, "geometries").where("as_wkt IS NOT NULL").groupBy("geo_id").agg(F.max("g").alias("g"), F.max("as_wkt").alias("as_wkt"))
    return geometry.tiles(g, ["g", "geo_id"], "as_wkt").groupBy("g", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))


def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of every pyramid level of the rectangles."""
    p = geometry.pyramid(rectangles(spark, sf_dir), "k", "as_wkt").select("k", "level", geometry.bounds(F.col("wkt")).alias("b"))
    return p.select("k", "level", "b.x0", "b.y0", "b.x1", "b.y1")


def pyramid_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes' lowest pyramid level, their coordinates snapped to integers: area."""
    p = geometry.pyramid(shapes(spark, sf_dir), "k", "as_wkt").where("level = 0")
    return geometry.shape_features(p, "k", "wkt").select("k", F.col("mesh_surface").alias("area"))


def spatial_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of derived quads in the spatial graph per predicate: a text and four corners for each level below 15."""
    r = rectangles(spark, sf_dir).select(F.concat(F.lit("<urn:t:part/"), F.col("k"), F.lit(">")).alias("s"), "as_wkt")
    d = derived.derive(r, "s", "as_wkt").where(F.col("g") == f"<{derived.SPATIAL_GRAPH}>")
    return d.groupBy(F.regexp_extract("p", f"^<{derived.VOCAB}(.*)>$", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def derived_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived quads of the real polygons, in the spatial graph and the graphs of tiles."""
    g = table(spark, sf_dir, "geometries").select(text(Kind("iri"), F.col("s")).alias("s"), "as_wkt")
    return derived.derive(g, "s", "as_wkt")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.derive(shapes(spark, sf_dir).select(F.concat(F.lit("<urn:k/"), F.col("k"), F.lit(">")).alias("s"), "as_wkt"), "s", "as_wkt")
    return d.withColumn("k", F.regexp_extract("s", "([0-9]+)", 1).cast("long"))


def derived_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile graphs that the derived quads of the shapes' lowest level are in."""
    place = F.split(F.regexp_extract("g", f"^<{derived.GRID}:0:(.*)>$", 1), ":")
    return _derived(spark, sf_dir).where(F.col("g").startswith(f"<{derived.GRID}:0:")).select("k", place[0].cast("long").alias("tx"), place[1].cast("long").alias("ty"))


def derived_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners in the derived quads of the objects whose corners the data have."""
    d = _derived(spark, sf_dir).where(F.col("p") == f"<{derived.VOCAB}hilbertCorner0>").select("k", F.regexp_extract("o", '^"([0-9]+)"', 1).cast("long").alias("h"))
    return d.join(cornered(spark, sf_dir).select("k").distinct(), "k", "left_semi")


def num_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pyramid steps until an image fits 512 pixels."""
    return table(spark, sf_dir, "images").select("image_id", geometry.num_scales(F.col("width"), F.col("height"), F.lit(512)).alias("steps")).where("steps IS NOT NULL")


def pca_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex axes of the rectangles."""
    p = rectangles(spark, sf_dir).select("k", geometry.pca_axes(F.col("as_wkt")).alias("a"))
    return p.select("k", "a.cx", "a.cy", F.round("a.major", 6).alias("major"), F.round("a.minor", 6).alias("minor"))


def shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features of the rectangles."""
    f = geometry.shape_features(rectangles(spark, sf_dir), "k", "as_wkt")
    return f.select("k", *[F.round(c, 6).alias(c) for c in geometry.FEATURES])


def shape_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the shapes that follow from the vertices alone."""
    f = geometry.shape_features(shapes(spark, sf_dir), "k", "as_wkt")
    return f.select("k", "mesh_surface", F.round("perimeter", 5).alias("perimeter"), F.round("sphericity", 8).alias("sphericity"), F.round("maximum_2d_diameter", 5).alias("maximum_2d_diameter"))


_FUNCTIONS = (
    sf_intersects, batch_intersects, spatial_candidates, hilbert_ranges_box, hilbert_ranges_polygon, hilbert_roundtrip, hilbert_index, hilbert_centroid, hilbert_corners, merge_ranges, range_area, range_bounds, range_contains, wkt_parse, degenerate_polygons,
    grid_tiles, grid_lookup, pyramid_levels, pyramid_base, spatial_quads, derived_quads, derived_tiles, derived_corners, num_scales, pca_axes, shape_features, shape_measures,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_R = "r AS (SELECT p_partkey AS k, (p_partkey * 7919) % 100000 AS x0, (p_partkey * 104729) % 80000 AS y0, 10 + (p_partkey % 37) * 40 AS w, 10 + (p_partkey % 23) * 30 AS h, x0 + w AS x1, y0 + h AS y1 FROM part)"
_X0, _Y0, _X1, _Y1 = BOX
_IN = lambda x, y: f"({x} BETWEEN {_X0} AND {_X1} AND {y} BETWEEN {_Y0} AND {_Y1})"
_N = "[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?"
_RING = rf"\(\s*{_N}\s+{_N}\s*(,\s*{_N}\s+{_N}\s*)*\)"
_POLY = rf"\(\s*{_RING}(\s*,\s*{_RING})*\s*\)"
#: Edges of the readable shapes: e(k, pg, rn, i, x1, y1, x2, y2), and their boxes: box(k, x0, y0, x1, y1).
EDGES = rf"""shape AS (SELECT geo_id AS k, max(g) AS g, max(as_wkt) AS t FROM geometries WHERE as_wkt IS NOT NULL GROUP BY 1 UNION ALL SELECT annotation_id, g, as_wkt FROM annotations WHERE as_wkt IS NOT NULL),
    body AS (SELECT k, g, regexp_replace(t, '^\s*(<[^>]*>|SRID=[0-9]+;)\s*', '', 'i') AS t FROM shape),
    fits AS (SELECT k, g, t FROM body WHERE regexp_full_match(t, '\s*POLYGON\s*{_POLY}\s*', 'i') OR regexp_full_match(t, '\s*MULTIPOLYGON\s*\(\s*{_POLY}(\s*,\s*{_POLY})*\s*\)\s*', 'i')),
    poly AS (SELECT k, generate_subscripts(ps, 1) AS pg, unnest(ps) AS p FROM (SELECT k, regexp_extract_all(t, '\(\s*\([^()]*\)(\s*,\s*\([^()]*\))*\s*\)') AS ps FROM fits)),
    ring AS (SELECT k, pg, generate_subscripts(rs, 1) AS rn, unnest(rs) AS r FROM (SELECT k, pg, regexp_extract_all(p, '\([^()]+\)') AS rs FROM poly)),
    nums AS (SELECT k, pg, rn, list_transform(regexp_extract_all(r, '{_N}'), lambda v: CAST(v AS DOUBLE)) AS n FROM ring WHERE r ~ '.*[0-9].*'),
    bad AS (SELECT DISTINCT k FROM nums WHERE len(n) < 8 OR n[1] <> n[-2] OR n[2] <> n[-1]),
    e AS (SELECT k, pg, rn, i, n[2 * i - 1] AS x1, n[2 * i] AS y1, n[2 * i + 1] AS x2, n[2 * i + 2] AS y2 FROM (SELECT *, unnest(range(1, len(n) // 2)) AS i FROM nums WHERE k NOT IN (SELECT k FROM bad))),
    box AS (SELECT k, min(x1) AS x0, min(y1) AS y0, max(x1) AS x1, max(y1) AS y1 FROM e GROUP BY k)"""
#: Pairs of a shape and a box q(b, a0, b0, a1, b1) that share a point, from the pairs near(k, b, a0, b0, a1, b1) whose boxes meet.
_MEETS = """each_ AS (SELECT near.k, near.b, pg, least(x1, x2) <= a1 AND greatest(x1, x2) >= a0 AND least(y1, y2) <= b1 AND greatest(y1, y2) >= b0
        AND least((x2 - x1) * (b0 - y1), (x2 - x1) * (b1 - y1)) <= greatest((y2 - y1) * (a0 - x1), (y2 - y1) * (a1 - x1)) AND greatest((x2 - x1) * (b0 - y1), (x2 - x1) * (b1 - y1)) >= least((y2 - y1) * (a0 - x1), (y2 - y1) * (a1 - x1)) AS hit,
        ((y1 > b0) <> (y2 > b0)) AND (((x2 - x1) * (b0 - y1) > (y2 - y1) * (a0 - x1)) = (y2 > y1)) AS crossed FROM near JOIN e USING (k)),
    met AS (SELECT DISTINCT k, b FROM (SELECT k, b, pg FROM each_ GROUP BY k, b, pg HAVING bool_or(hit) OR count(*) FILTER (WHERE crossed) % 2 = 1))"""
_TILES = f"""{EDGES}, near AS (SELECT k, [tx, ty] AS b, tx * 512 AS a0, ty * 512 AS b0, tx * 512 + 512 AS a1, ty * 512 + 512 AS b1 FROM (SELECT k, y0, y1, unnest(range(CAST(floor(x0 / 512) AS BIGINT), CAST(floor(x1 / 512) AS BIGINT) + 1)) AS tx FROM box), LATERAL (SELECT unnest(range(CAST(floor(y0 / 512) AS BIGINT), CAST(floor(y1 / 512) AS BIGINT) + 1)) AS ty)), {_MEETS}"""
_CORNERED = "c AS (SELECT geo_id AS k, max(hilbert_corners) AS cs FROM geometries WHERE as_wkt IS NOT NULL AND len(list_filter(hilbert_corners, lambda v: v IS NOT NULL)) = 4 GROUP BY 1)"
_CORNERS = f"{EDGES}, {_CORNERED}, pt AS (SELECT DISTINCT k, x, y FROM (SELECT k, unnest([x0, x0, x1, x1]) AS x, unnest([y0, y1, y1, y0]) AS y FROM box JOIN c USING (k)))"
_SPANS = "e AS (SELECT event_type, (event_id * 37) % 100003 AS a, (event_id * 37) % 100003 + event_id % 29 AS b FROM events)"
_MERGED = f"""{_SPANS}, m AS (SELECT *, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
    merged AS (SELECT event_type, min(a) AS low, max(b) AS high FROM i GROUP BY event_type, island)"""
_LEVELS = f"""{_R}, l AS (SELECT k, s AS level, ceil(x0 / power(2, s)) AS x0, ceil(y0 / power(2, s)) AS y0, ceil(x1 / power(2, s)) AS x1, ceil(y1 / power(2, s)) AS y1 FROM r, range(20) t(s)),
    bad AS (SELECT k, min(level) AS first FROM l WHERE level > 0 AND (x1 - x0) * (y1 - y0) < 4 GROUP BY k),
    kept AS (SELECT l.* FROM l LEFT JOIN bad USING (k) WHERE first IS NULL OR level < first)"""
ORACLES = {
    "sf_intersects": f"""WITH {EDGES}, near AS (SELECT k, 0 AS b, {_X0} AS a0, {_Y0} AS b0, {_X1} AS a1, {_Y1} AS b1 FROM box WHERE x0 <= {_X1} AND x1 >= {_X0} AND y0 <= {_Y1} AND y1 >= {_Y0}), {_MEETS}
        SELECT DISTINCT '<' || s || '>' AS geo FROM met JOIN geometries ON k = geo_id""",
    "batch_intersects": f"""WITH {EDGES}, q AS (SELECT i AS b, (i * 75577) % 100000 AS a0, (i * 50021) % 80000 AS b0, a0 + {BOX_SIDE} AS a1, b0 + {BOX_SIDE} AS b1 FROM range({BOXES}) t(i)),
        near AS (SELECT k, b, a0, b0, a1, b1 FROM box JOIN q ON x0 <= a1 AND x1 >= a0 AND y0 <= b1 AND y1 >= b0), {_MEETS} SELECT k, b FROM met""",
    "spatial_candidates": f"WITH {_CORNERS} SELECT DISTINCT k FROM pt WHERE {_IN('x', 'y')}",
    "hilbert_ranges_box": f"WITH {_CORNERS} SELECT k, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM pt WHERE {_IN('x', 'y')}",
    "hilbert_roundtrip": f"WITH {_CORNERS} SELECT k, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM pt",
    "hilbert_centroid": f"WITH {EDGES} SELECT k, CAST(floor((x0 + x1) / 2) AS BIGINT) AS x, CAST(floor((y0 + y1) / 2) AS BIGINT) AS y FROM box",
    "hilbert_corners": f"WITH {_R} SELECT k, 0 AS i, x0 AS x, y0 AS y FROM r UNION ALL SELECT k, 1, x0, y1 FROM r UNION ALL SELECT k, 2, x1, y1 FROM r UNION ALL SELECT k, 3, x1, y0 FROM r",
    "merge_ranges": f"WITH {_MERGED} SELECT event_type, low, high FROM merged",
    "range_area": f"WITH {_MERGED} SELECT event_type, CAST(sum(high - low + 1) AS BIGINT) AS area, min(low) AS lo, max(high) AS hi FROM merged GROUP BY 1",
    "range_bounds": f"""WITH RECURSIVE {_MERGED}, c AS (SELECT DISTINCT event_type, unnest(range(low, high + 1)) AS h FROM merged),
        d AS (SELECT h, h AS t, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, 0 AS j FROM (SELECT DISTINCT h FROM c) UNION ALL
          SELECT h, t >> 2, CASE WHEN ry = 0 THEN fy ELSE fx END + (side * rx), CASE WHEN ry = 0 THEN fx ELSE fy END + (side * ry), j + 1
          FROM (SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN side - 1 - x ELSE x END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN side - 1 - y ELSE y END AS fy
            FROM (SELECT *, (t >> 1) & 1 AS rx, xor(t, (t >> 1) & 1) & 1 AS ry, CAST(1 AS BIGINT) << j AS side FROM d WHERE j < 9)))
        SELECT event_type, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS cells FROM c JOIN d USING (h) WHERE j = 9 GROUP BY event_type""",
    "range_contains": f"WITH {_SPANS} SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM e WHERE event_type = 'error' AND p_partkey BETWEEN a AND b)",
    "wkt_parse": f"""WITH {EDGES}, n AS (SELECT k, count(DISTINCT pg) AS a, count(DISTINCT (pg, rn)) AS b, count(*) + count(DISTINCT (pg, rn)) AS c FROM e GROUP BY k)
        SELECT shape.k, n.k IS NOT NULL OR regexp_full_match(body.t, '\\s*(MULTI)?POLYGON\\s*EMPTY\\s*', 'i') AS ok, CAST(coalesce(n.a, 0) AS INTEGER) AS n_polygons, CAST(coalesce(n.b, 0) AS INTEGER) AS n_rings, CAST(coalesce(n.c, 0) AS INTEGER) AS n_points, x0, y0, x1, y1, n.k IS NULL AS degenerate
        FROM shape JOIN body USING (k) LEFT JOIN n ON n.k = shape.k LEFT JOIN box ON box.k = shape.k""",
    "degenerate_polygons": f"WITH {EDGES} SELECT k FROM shape WHERE k NOT IN (SELECT k FROM e)",
    "grid_tiles": f"WITH {_TILES} SELECT k, b[1] AS tx, b[2] AS ty FROM met",
    "grid_lookup": f"WITH {_TILES} SELECT g, b[1] AS tx, b[2] AS ty, count(*) AS n FROM met JOIN shape USING (k) WHERE k IN (SELECT geo_id FROM geometries) GROUP BY 1, 2, 3",
    "pyramid_levels": f"WITH {_LEVELS} SELECT k, CAST(level AS INTEGER) AS level, x0, y0, x1, y1 FROM kept",
    "pyramid_base": f"""WITH {EDGES}, r AS (SELECT k, rn, abs(sum(floor(x1 + 0.5) * floor(y2 + 0.5) - floor(x2 + 0.5) * floor(y1 + 0.5))) / 2 AS a FROM e GROUP BY k, pg, rn) SELECT k, sum(CASE WHEN rn = 1 THEN a ELSE -a END) AS area FROM r GROUP BY k""",
    "spatial_quads": f"WITH {_LEVELS} SELECT 'asWKT' || level AS p, count(*) AS n FROM kept WHERE level < 15 GROUP BY level UNION ALL SELECT 'hilbertCorner' || level, 4 * count(*) FROM kept WHERE level < 15 GROUP BY level",
    "num_scales": "SELECT image_id, CAST(greatest(0, ceil(log2(greatest(width, height) / 512.0))) AS INTEGER) AS steps FROM images WHERE width IS NOT NULL OR height IS NOT NULL",
    "pca_axes": f"WITH {_R} SELECT k, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, round(2 * sqrt(greatest(w, h) * greatest(w, h) / 3), 6) AS major, round(2 * sqrt(least(w, h) * least(w, h) / 3), 6) AS minor FROM r",
    "shape_features": f"""WITH {_R}, f AS (SELECT *, CAST(w * h AS DOUBLE) AS a, CAST(2 * (w + h) AS DOUBLE) AS p, 4 * sqrt((power(greatest(w, h) + 1, 2) - 1) / 12) AS mj, 4 * sqrt((power(least(w, h) + 1, 2) - 1) / 12) AS mi FROM r)
        SELECT k, a AS mesh_surface, CAST((w + 1) * (h + 1) AS DOUBLE) AS pixel_surface, p AS perimeter, round(p / a, 6) AS perimeter_surface_ratio, round(2 * sqrt(pi() * a) / p, 6) AS sphericity, round(p / (2 * sqrt(pi() * a)), 6) AS spherical_disproportion,
        round(sqrt(w * w + h * h), 6) AS maximum_2d_diameter, round(mj, 6) AS major_axis_length, round(mi, 6) AS minor_axis_length, round(mi / mj, 6) AS elongation FROM f""",
    "derived_tiles": f"WITH {_TILES} SELECT k, b[1] AS tx, b[2] AS ty FROM met",
    "derived_corners": f"WITH {EDGES}, {_CORNERED} SELECT DISTINCT k, unnest(cs) AS h FROM c WHERE k IN (SELECT k FROM e)",
    "hilbert_index": f"WITH {EDGES}, {_CORNERED} SELECT DISTINCT k, unnest(cs) AS h FROM c WHERE k IN (SELECT k FROM e)",
    "hilbert_ranges_polygon": f"WITH {_CORNERS} SELECT k, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM pt WHERE " + " AND ".join(f"{x2 - x1} * (y - {y1}) - {y2 - y1} * (x - {x1}) >= 0" for (x1, y1), (x2, y2) in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1], strict=True)),
    "shape_measures": f"""WITH {EDGES}, v AS (SELECT DISTINCT k, x1, y1 FROM e WHERE rn = 1), far AS (SELECT a.k, max(sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1))) AS d FROM v a JOIN v b ON a.k = b.k GROUP BY 1),
        r AS (SELECT k, pg, rn, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS p FROM e GROUP BY k, pg, rn), t AS (SELECT k, sum(CASE WHEN rn = 1 THEN a ELSE -a END) AS a, sum(p) AS p FROM r GROUP BY k)
        SELECT k, a AS mesh_surface, round(p, 5) AS perimeter, round(2 * sqrt(pi() * a) / p, 8) AS sphericity, round(d, 5) AS maximum_2d_diameter FROM t JOIN far USING (k)""",
}
