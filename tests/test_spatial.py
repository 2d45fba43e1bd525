"""Hilbert curve, WKT, proximity joins and polygon operators against brute force and hand-made answers."""

import itertools
import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.engine import Engine
from quadloom.sources import quads
from quadloom.spatial import derived, geometry, hilbert, nearby, ranges, wkt

GEO = "geo_id long, g long, as_wkt string, hilbert_corners array<long>, x2 string, __a int"
REG = "region long, g long, as_wkt string"


def test_fixed_points():
    x, y = np.array([0, 0, 1, 1, 3, 100000]), np.array([0, 1, 1, 0, 4, 80000])
    assert hilbert.encode(x, y).tolist() == [0, 1, 2, 3, 31, 12440184490]
    assert [hilbert.encode(x[i : i + 1], y[i : i + 1])[0] for i in range(6)] == [0, 1, 2, 3, 31, 12440184490]


@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(0, 2**31 - 1)), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_roundtrip(points):
    x, y = np.array(points, dtype=np.int64).T
    assert (np.array(hilbert.decode(hilbert.encode(x, y))) == [x, y]).all()


def test_neighbours_are_adjacent():
    x, y = hilbert.decode(np.arange(4096))
    assert (np.abs(np.diff(x)) + np.abs(np.diff(y)) == 1).all()


@given(st.tuples(*[st.integers(0, 40)] * 4))
@settings(max_examples=40, deadline=None)
def test_cover_is_the_box(b):
    x0, x1, y0, y1 = min(b[:2]), max(b[:2]), min(b[2:]), max(b[2:])
    cells = {p for lo, hi in hilbert.cover_box(x0, y0, x1, y1, 10**6) for p in zip(*map(np.ndarray.tolist, hilbert.decode(np.arange(lo, hi + 1))), strict=True)}
    assert cells == set(itertools.product(range(x0, x1 + 1), range(y0, y1 + 1)))


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("POLYGON((0 0,4 0,4 4,0 0))", 1),
        ("<urn:crs> polygon (( 0.0 0 ,\n 4 0, 4 4, 0 0 ))", 1),
        ("MULTIPOLYGON(((0 0,4 0,4 4,0 0)),((9 9,10 9,10 10,9 9)))", 2),
        ("POLYGON EMPTY", 0),
        ("POLYGON ((0 0, 4 0, 4 4", None),
        ("POLYGON ((0, 4, 4, 0))", None),
        ("POLYGON ((0 0, 4 0, 4 4, 1 1))", None),
        ("POLYGON ((0 0, 4 0, 0 0))", None),
        ("not a geometry", None),
        ("", None),
        (None, None),
        ("POLYGON ((" + "123456 654321, " * 20000, None),
    ],
)
def test_wkt(text, parts):
    found = wkt.polygons(text)
    assert found is None if parts is None else len(found) == parts


def test_contains():
    ring = [np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float), np.array([[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]], float)]
    x, y = np.array([1, 5, 3, 10, 11, 0, 5]), np.array([1, 5, 5, 10, 5, 5, 7])
    assert wkt.contains(ring, x, y).tolist() == [True, False, True, True, False, True, True]


def test_places(spark):
    c = hilbert.encode(np.array([10, 10, 21, 21]), np.array([5, 8, 8, 5])).tolist()
    data = [
        (1, 1, None, c, "", 0),
        (1, 1, None, c, "", 0),
        (2, 1, "bad", [c[2], c[0], c[1]], "", 0),
        (3, 1, "POLYGON((0 0,4 0,4 4,0 0))", None, "", 0),
        (4, 1, "POLYGON EMPTY", [], "", 0),
        (5, 1, "POLYGON((0 0,2.5 0,2.5 4,0 0))", [None], "", 0),
        (6, None, None, c, "", 0),
        (None, 1, None, c, "", 0),
        (7, 1, None, None, "", 0),
    ]
    assert rows(nearby.places(spark.createDataFrame(data, GEO))) == [(1, 1, 31.0, 13.0), (2, 1, 31.0, 13.0), (3, 1, 4.0, 4.0), (5, 1, 2.5, 4.0)]


def test_pairs(spark):
    r = random.Random(3)
    points = [(i, r.choice([1, 1, 2]), float(r.randint(-60, 60)), float(r.randint(-60, 60))) for i in range(250)] + [(900 + i, 1, 5.0, 5.0) for i in range(12)]
    got = rows(nearby.pairs_within(spark.createDataFrame(points, "geo_id long, g long, x2 double, y2 double"), 9))
    want = sorted(((a[0], b[0]) for a in points for b in points if a[0] < b[0] and a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 81), key=repr)
    assert got == want


def star(r, cx, cy, n=9):
    ring = [(int(cx + d * np.cos(a)), int(cy + d * np.sin(a))) for a, d in ((2 * np.pi * i / n, r.randint(100, 900)) for i in range(n))]
    return "((" + ",".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"


def test_regions(spark):
    r = random.Random(5)
    regions = [(100 + i, r.choice([1, 2]), "MULTIPOLYGON(" + star(r, 1500, 1500) + "," + star(r, 2500, 1800) + ")" if i % 3 == 0 else "POLYGON" + star(r, r.randint(900, 3000), r.randint(900, 3000))) for i in range(8)]
    regions += [(200, 1, "POLYGON((1000 1000,2000 1000,2000 2000,1000 2000,1000 1000),(1400 1400,1600 1400,1600 1600,1400 1600,1400 1400))"), (201, 1, "bad"), (202, None, "POLYGON EMPTY"), (203, 1, None)]
    points = [(i, r.choice([1, 2]), float(r.randint(0, 8000)), float(r.randint(0, 8000))) for i in range(600)]
    points += [(1000, 1, 2000.0, 2500.0), (1001, 1, 3000.0, 3000.0), (1002, 1, 2800.0, 2800.0), (1003, 1, 4000.0, 4000.0), (1004, 1, 2000.0, 2000.0)]
    got = rows(nearby.points_in_regions(spark.createDataFrame(points, "geo_id long, g long, x2 double, y2 double"), spark.createDataFrame(regions, REG)))
    want = {(p[0], q[0]) for p in points for q in regions if p[1] == q[1] for part in wkt.polygons(q[2]) or [] if wkt.contains(part, np.array([p[2] / 2]), np.array([p[3] / 2]))[0]}
    assert got == sorted(want, key=repr) and (1000, 200) in want and (1001, 200) not in want and (1002, 200) in want


def test_empty_tables(spark):
    none = nearby.places(spark.createDataFrame([], GEO))
    assert none.collect() == [] and nearby.pairs_within(none, 5).collect() == []
    region = spark.createDataFrame([(1, 1, "POLYGON((0 0,4 0,4 4,0 0))")], REG)
    assert nearby.points_in_regions(none, region).collect() == []
    one = spark.createDataFrame([(1, 1, 2.0, 1.0)], "geo_id long, g long, x2 double, y2 double")
    assert nearby.points_in_regions(one, spark.createDataFrame([], REG)).collect() == []


def test_intersects():
    read = wkt.polygons
    a = read("POLYGON((0 0,10 0,10 10,0 10,0 0))")
    assert wkt.intersects(a, read("POLYGON((10 10,12 10,12 12,10 10))"))
    assert wkt.intersects(a, read("POLYGON((2 2,3 2,3 3,2 2))")) and wkt.intersects(read("POLYGON((2 2,3 2,3 3,2 2))"), a)
    assert not wkt.intersects(a, read("POLYGON((11 0,12 0,12 1,11 0))"))
    hole = read("POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,8 2,8 8,2 8,2 2))")
    assert not wkt.intersects(hole, read("POLYGON((4 4,5 4,5 5,4 4))"))


def test_square_features():
    f = dict(zip(geometry.FEATURES, geometry.shape(wkt.polygons("POLYGON((0 0,100 0,100 100,0 100,0 0))")), strict=True))
    assert f["mesh_surface"] == 10000 and f["pixel_surface"] == 101 * 101 and f["perimeter"] == 400 and f["elongation"] == 1
    assert abs(f["sphericity"] - 0.886227) < 1e-6 and abs(f["maximum_2d_diameter"] - 141.421356) < 1e-6


def test_triangle_pixels():
    runs = geometry.pixels(wkt.polygons("POLYGON((0 0,4 0,0 4,0 0))")[0])
    assert (runs[:, 2] - runs[:, 1] + 1).sum() == 15


def test_num_scales(spark):
    from pyspark.sql import functions as F

    data = [(100, 100, 100, 0), (1024, 768, 256, 2), (1000, 1000, 500, 1), (1024, 1024, 1000, 1)]
    df = spark.createDataFrame(data, "w int, h int, b int, want int")
    assert df.where(geometry.num_scales(F.col("w"), F.col("h"), F.col("b")) != F.col("want")).count() == 0


def test_merge_ranges(spark):
    r = random.Random(2)
    spans = [(k, a, a + r.randint(0, 30)) for k in (1, 2) for a in (r.randint(0, 2000) for _ in range(120))] + [(1, 5, 2), (1, None, 3)]
    got = rows(geometry.merge_ranges(spark.createDataFrame(spans, "k long, low long, high long"), "low", "high", ["k"]))
    want = []
    for k in (1, 2):
        cells = sorted({c for q, a, b in spans if q == k and a is not None for c in range(a, b + 1)})
        start = prev = cells[0]
        for c in [*cells[1:], None]:
            if c is None or c > prev + 1:
                want.append((k, start, prev))
                start = c
            prev = c
    assert got == sorted(want, key=repr)


def test_pyramid_and_empty(spark):
    df = spark.createDataFrame([(1, "POLYGON((0 0,16 0,16 16,0 16,0 0))"), (2, None), (3, "bad"), (4, "POLYGON((0 0,8 0,16 0,16 16,0 16,0 0))")], "k long, t string")
    got = rows(geometry.pyramid(df, "k", "t").select("k", "level"))
    assert got == [(k, s) for k in (1, 4) for s in range(4)]
    assert geometry.shape_features(df.where("k = 2"), "k", "t").collect() == []


def test_broken_text_meets_nothing(spark):
    data = [
        (1, "POLYGON((10 10,20 10,20 20,10 10))"),
        (2, "POLYGON((10 10,20 10,20 20"),
        (3, "POLYGON((10,10,20,20))"),
        (4, "POLYGON((10 10,20 10,20 20,11 11))"),
        (5, "POLYGON((10 10,600 10,600 20"),
        (6, "POLYGON EMPTY"),
        (7, None),
        (8, "<urn:crs> POLYGON((500 500,512 500,512 510,500 500))"),
        (9, "POLYGON((0 0,1500 0,0 1500,0 0))"),
    ]
    df = spark.createDataFrame(data, "k long, t string")
    big = [(9, x, y) for x in range(3) for y in range(3) if 512 * (x + y) <= 1500]
    assert rows(geometry.tiles(df, ["k"], "t")) == sorted([(1, 0, 0), (8, 0, 0), (8, 1, 0), *big], key=repr)
    assert rows(geometry.tiles(df, ["k"], "t", exact=False)) == sorted([(1, 0, 0), (8, 0, 0), (8, 1, 0), *((9, x, y) for x in range(3) for y in range(3))], key=repr)
    boxes = spark.createDataFrame([(0, 0, 0, 400, 400), (1, 0, 0, 4000, 4000), (2, 1400, 1400, 1450, 1450)], "b int, x0 int, y0 int, x1 int, y1 int")
    assert rows(geometry.batch_intersects(df, boxes, "k", "b", "t")) == [(1, 0), (1, 1), (8, 1), (9, 0), (9, 1)]


def test_tiles_of_is_the_intersection():
    r = random.Random(8)
    texts = ["POLYGON" + star(r, r.randint(-900, 3000), r.randint(-900, 3000)) for _ in range(40)] + ["MULTIPOLYGON(" + star(r, 1500, 1500) + "," + star(r, 4500, 900) + ")" for _ in range(10)]
    texts += ["POLYGON((-100 -100,900 -100,900 900,-100 900,-100 -100),(90 90,610 90,610 610,90 610,90 90))", "POLYGON((100 100,200 100,200 200,100 200,100 100))", "POLYGON((0 200,200 0,400 200,200 400,0 200))"]
    for found in map(wkt.polygons, texts):
        x0, y0, x1, y1 = (int(np.floor(v / 100)) for v in wkt.extent(found))
        square = lambda x, y: [[np.array([[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]], float) * 100]]
        want = [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if wkt.intersects(found, square(x, y))]
        assert list(geometry.tiles_of(found, 100)) == want


def test_derived_quads(spark, tmp_path):
    geo, as_wkt = "^^<http://www.opengis.net/ont/geosparql#wktLiteral>", "<http://www.opengis.net/ont/geosparql#asWKT>"
    texts = [("a", "POLYGON((510 0,514 0,514 4,510 4,510 0))"), ("a", "POLYGON((510 0,512 0,514 0,514 4,510 4,510 0))"), ("b", "POLYGON((0 0,4 0,4 4"), ("c", "POLYGON EMPTY")]
    data = [("<urn:x-graph:default>", f"<urn:{s}>", as_wkt, f'"{t}"{geo}') for s, t in texts] + [("<urn:x-graph:default>", "<urn:d>", "<urn:p>", '"POLYGON((0 0,4 0,4 4,0 0))"^^xsd:string')]
    source = spark.createDataFrame(data, "g string, s string, p string, o string")
    quads.write(derived.added(source), str(tmp_path / "store"))
    want = set(data)
    for n, (x0, x1, side), tiles in ((0, (510, 514, 4), (0, 1)), (1, (255, 257, 2), (0,))):
        shape, name = f'"POLYGON (({x0} 0, {x1} 0, {x1} {side}, {x0} {side}, {x0} 0))"{geo}', f"<urn:x-graph:hal/asWKT{n}>"
        want |= {(f"<{g}>", "<urn:a>", name, shape) for g in ("urn:x-graph:spatial", *(f"urn:x-graph:grid:{n}:{x}:0" for x in tiles))}
        for h in hilbert.encode(np.array([x0, x0, x1, x1]), np.array([0, side, side, 0])).tolist():
            want.add(("<urn:x-graph:spatial>", "<urn:a>", f"<urn:x-graph:hal/hilbertCorner{n}>", f'"{h}"^^xsd:long'))
    assert rows(quads.read(spark, str(tmp_path / "store")).quads()) == sorted(want, key=repr)
    assert derived.of_quads(source).count() == len(want) - len(data)


def test_ranges_without_keys(spark):
    r = random.Random(3)
    spans = [(a, a + r.randint(0, 9)) for a in (r.randint(0, 5000) for _ in range(800))]
    df = spark.createDataFrame(spans, "low long, high long").repartition(5)
    covered, want = sorted({v for a, b in spans for v in range(a, b + 1)}), []
    for v in covered:
        if want and want[-1][1] == v - 1:
            want[-1][1] = v
        else:
            want.append([v, v])
    merged = geometry.merge_ranges(df, "low", "high")
    assert rows(merged) == sorted(((a, b) for a, b in want), key=repr)
    assert sorted(r.id for r in geometry.in_merged(spark.range(5100), "id", merged, cell=7).collect()) == [v for v in covered if v < 5100]


BROKEN = ["POLYGON ((0 0, 40 0, 40 40, 0 40, 0 0), (10 10, 30 10, 30 30, 10 30, 10 10))", "POLYGON ((3.5 1, 90 60, 20 17.25, 3.5 1))", "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0)), ((50 50, 70 52, 60 75, 50 50)))"]


@pytest.mark.parametrize("text", BROKEN)
def test_cover_polygon_is_the_polygon(text):
    found = wkt.polygons(text)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(100), np.arange(100)))
    inside = np.logical_or.reduce([wkt.contains(p, x, y) for p in found])
    for budget in (10**6, 8):
        ranges = hilbert.cover_polygon(found, budget)
        cells = {p for lo, hi in ranges for p in zip(*map(np.ndarray.tolist, hilbert.decode(np.arange(lo, min(hi, lo + 40000) + 1))), strict=True)}
        want = set(zip(x[inside].tolist(), y[inside].tolist(), strict=True))
        assert cells == want if budget > 8 else cells >= want
    assert hilbert.cover_polygon([]) == []


@pytest.mark.parametrize(("text", "points"), [("POLYGON Z ((0 0 1, 4 0 1, 4 4 1, 0 0 1))", 4), ("polygon zm((0 0 1 2,4 0 1 2,4 4 1 2,0 0 1 2))", 4), ("POLYGON M ((0 0 5, 4 0 6, 4 4 7, 0 0 8))", 4), ("POLYGON Z ((0 0, 4 0, 4 4, 0 0))", None), ("POLYGON ((.5 .5, 3 .5, 3 3., .5 .5))", 4)])
def test_wkt_dimensions_and_numbers(text, points):
    found = wkt.polygons(text)
    assert found is None if points is None else [r.shape for p in found for r in p] == [(points, 2)]


def test_bounds_read_all_numbers(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("POLYGON ((.5 .25, 3. .25, 3 4e1, .5 .25))",)], "t string").select(geometry.bounds(F.col("t")).alias("b")).select("b.*").collect()
    assert tuple(got[0]) == (0.5, 0.25, 3.0, 40.0)


def test_hot_cells_are_salted(spark, monkeypatch):
    points = [(i, 1, float(i % 7), float(i % 5)) for i in range(60)] + [(100 + i, 2, 1000.0 * i, 0.0) for i in range(5)]
    df = spark.createDataFrame(points, "geo_id long, g long, x2 double, y2 double")
    plain = rows(nearby.pairs_within(df, 2))
    monkeypatch.setattr(nearby, "HOT_CELL", 8)
    want = sorted(((a[0], b[0]) for a, b in itertools.combinations(points, 2) if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 4), key=repr)
    assert rows(nearby.pairs_within(df, 2)) == plain == want


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_coverage_divides_to_few_edges(spark, most):
    r = random.Random(7)
    angle = np.sort(np.random.default_rng(7).uniform(0, 2 * np.pi, 400))
    radius = 300 + np.random.default_rng(8).uniform(-120, 120, 400)
    ring = [(round(float(500 + d * np.cos(a)), 2), round(float(500 + d * np.sin(a)), 2)) for a, d in zip(angle, radius, strict=True)]
    text = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "), (480 480, 520 480, 520 520, 480 520, 480 480))"
    points = [(i, 1, float(r.randint(0, 2000)), float(r.randint(0, 2000))) for i in range(3000)] + [(9000 + i, 1, 2 * x, 2 * y) for i, (x, y) in enumerate(ring)]
    found = wkt.polygons(text)[0]
    inside = wkt.contains(found, np.array([p[2] for p in points]) / 2, np.array([p[3] for p in points]) / 2)
    want = {p[0] for p, ok in zip(points, inside, strict=True) if ok}
    df = spark.createDataFrame(points, "geo_id long, g long, x2 double, y2 double")
    regions = spark.createDataFrame([(7, 1, text)], "region long, g long, as_wkt string")
    assert {x.geo_id for x in nearby.points_in_regions(df, regions, most=most).collect()} == want
    if most == 4:
        cells = nearby.coverage(regions, most=most).where("NOT inner").collect()
        assert all(len(c.edges) <= most or c.step == nearby.STEPS[0] for c in cells)


def test_region_filter_uses_tiles_and_misses_nothing(spark, tmp_path):
    r = random.Random(5)
    texts = [f"POLYGON (({x} {y}, {x + w} {y + 3}, {x + w} {y + h}, {x} {y}))" for x, y, w, h in ((r.randint(0, 4000), r.randint(0, 4000), r.choice([5, 900]), r.choice([7, 700])) for _ in range(150))]
    texts += ["POLYGON ((0 0, 9000 0, 9000 9000, 0 9000, 0 0))", "POLYGON ((1023 1023, 1024 1023, 1024 1024, 1023 1023))", "POLYGON ((1 1, 2", "POLYGON EMPTY"]
    wkt_type = "<http://www.opengis.net/ont/geosparql#wktLiteral>"
    data = [("<urn:x-graph:default>", f"<urn:s{i}>", "<urn:wkt>", f'"{t}"^^{wkt_type}') for i, t in enumerate(texts)]
    quads.write(spark.createDataFrame(data, "g string, s string, p string, o string"), str(tmp_path / "s"), spatial=True)
    indexed = Engine.store(spark, str(tmp_path / "s"))
    plain = Engine(quads.QuadSource(indexed.source.df))
    for region in ("POLYGON ((1024 1024, 1500 1024, 1400 2100, 1024 1024))", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOLYGON (((10 10, 20 10, 20 20, 10 10)), ((3000 3000, 3600 3000, 3600 3600, 3000 3000)))", "broken"):
        for args in (f'?w, "{region}"^^geo:wktLiteral', f'"{region}"^^geo:wktLiteral, ?w', f'?w, "{region}"^^geo:wktLiteral, 1'):
            q = f"SELECT ?s {{ ?s <urn:wkt> ?w FILTER(geof:sfIntersects({args})) }}"
            df = indexed.sparql(q)
            assert rows(df) == rows(plain.sparql(q))
        want = {f"<urn:s{i}>" for i, t in enumerate(texts) if wkt.polygons(t) and wkt.polygons(region) and wkt.intersects(wkt.polygons(t), wkt.polygons(region))}
        assert {x.s for x in indexed.sparql(f'SELECT ?s {{ ?s <urn:wkt> ?w FILTER(geof:sfIntersects(?w, "{region}"^^geo:wktLiteral)) }}').collect()} == want
    plan = indexed.sparql('SELECT ?s { ?s ?p ?w FILTER(geof:sfIntersects(?w, "POLYGON ((0 0, 9 0, 9 9, 0 0))"^^geo:wktLiteral)) }')._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "tx" in plan


@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 60)), max_size=8))
@settings(max_examples=40, deadline=None)
def test_squares_bounds_and_outlines(spans):
    covered = sorted({v for a, n in spans for v in range(a, a + n + 1)})
    merged: list = []
    for v in covered:
        if merged and merged[-1][1] == v - 1:
            merged[-1] = (merged[-1][0], v)
        else:
            merged.append((v, v))
    cells = set(zip(*map(np.ndarray.tolist, hilbert.decode(np.array(covered, dtype=np.int64))), strict=True)) if covered else set()
    _, x, y, side = ranges.squares(*np.array(merged, dtype=np.int64).reshape(-1, 2).T)
    got = [(a + i, b + j) for a, b, s in zip(x.tolist(), y.tolist(), side.tolist(), strict=True) for i in range(s) for j in range(s)]
    assert len(got) == len(set(got)) and set(got) == cells
    shapes = ranges.outline(merged)
    if not cells:
        assert shapes == [] and ranges.bounds(merged) is None and ranges.upper_left(merged) is None and ranges.fattened(merged) == []
        return
    xs, ys = zip(*cells, strict=True)
    assert ranges.bounds(merged) == (min(xs), min(ys), max(xs), max(ys))
    assert ranges.upper_left(merged) == min(cells, key=lambda c: c[::-1])
    wide = cells | {(a + 1, b) for a, b in cells} | {(a, b + 1) for a, b in cells}
    assert {p for lo, hi in ranges.fattened(merged) for p in zip(*map(np.ndarray.tolist, hilbert.decode(np.arange(lo, hi + 1))), strict=True)} == wide
    assert sum(wkt.area(p) for p in shapes) == len(cells)
    mids = np.array(sorted(itertools.product(range(max(xs) + 2), range(max(ys) + 2))), dtype=float)
    inside = np.logical_or.reduce([wkt.contains(p, mids[:, 0] + 0.5, mids[:, 1] + 0.5) for p in shapes])
    assert {(int(a), int(b)) for (a, b), ok in zip(mids, inside, strict=True) if ok} == cells
    assert wkt.polygons(geometry.to_text(shapes)) is not None
