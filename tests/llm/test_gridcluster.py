"""Clusters of synthetic groups: labels, sizes, members, invalid and repeated rows, empty tables."""

import math
import random

from quadloom.llm import gridcluster as gc
from quadloom.llm.catalogue import FEATURES, LIMITS

SCHEMA = "geo_id long, perimeter double, major_axis_length double, sphericity double, elongation double, label string, cell_rows int"
CENTRES = [(200, 60, 0.98, 0.9), (200, 60, 0.6, 0.9), (800, 240, 0.98, 0.6), (3000, 900, 0.4, 0.6)]


def data(n=400):
    r = random.Random(0)
    out = []
    for i in range(n):
        p, m, s, e = CENTRES[0 if r.random() < 0.4 else r.randrange(4)]
        out.append((i, p * math.exp(r.uniform(-0.08, 0.08)), m * math.exp(r.uniform(-0.08, 0.08)), s + r.uniform(-0.02, 0.015), e + r.uniform(-0.04, 0.04), "x", 1))
    return out


def truth(row):
    return min(range(4), key=lambda k: sum(abs(math.log(row[j + 1] / CENTRES[k][j])) for j in range(4)))


def test_clusters(spark):
    rows = data()
    bad = [(1000, None, 1.0, 1.0, 1.0, "x", 1), (1001, -1.0, 60.0, 0.9, 0.9, "x", 1), (1002, float("nan"), 60.0, 0.9, 0.9, "x", 1), (None, 200.0, 60.0, 0.98, 0.9, "x", 1), (1003, 0.0, 60.0, 0.9, 0.9, "x", 1)]
    split = [(2000, 200.0, 60.0, None, None, "x", 1), (2000, None, 60.0, 0.98, 0.9, "x", 1)]
    df = spark.createDataFrame(rows + rows[:50] + bad + split, SCHEMA)
    got = gc.cluster(df, "geo_id", FEATURES, LIMITS).collect()
    assert sorted(r.geo_id for r in got) == [*range(400), 2000]
    labels = {r.geo_id: r.label for r in got}
    by = {}
    for row in rows:
        by.setdefault(truth(row), set()).add(labels[row[0]])
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == 4
    told = gc.describe(gc.cluster(df, "geo_id", FEATURES, LIMITS), "geo_id", FEATURES).collect()
    assert sorted(r["size"] for r in told) == sorted([sum(truth(x) == k for x in rows) + (k == 0) for k in range(4)])
    assert all(1 <= len(r.typical) <= 5 and {labels[m] for m in r.typical} == {r.label} for r in told)


def test_noise(spark):
    rows = data() + [(5000, 9.0, 3.0, 0.1, 0.1, "x", 1)]
    got = gc.cluster(spark.createDataFrame(rows, SCHEMA), "geo_id", FEATURES, LIMITS, min_points=2)
    assert got.where("geo_id = 5000").count() == 0 and got.count() > 380


def test_chain_converges(spark):
    one = (gc.Feature("x", 1.0),)
    rows = [(i, 0.5 + i) for i in range(1, 60)] + [(100 + i, 200.5 + i) for i in range(3)]
    got = gc.cluster(spark.createDataFrame(rows, "geo_id long, x double"), "geo_id", one, (1.5,), reach=1).collect()
    assert len({r.label for r in got}) == 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert gc.cluster(none, "geo_id", FEATURES, LIMITS).collect() == []
    assert gc.describe(gc.cluster(none, "geo_id", FEATURES, LIMITS), "geo_id", FEATURES).collect() == []


def test_sparse_cells_join_a_dense_one_and_bridge_nothing(spark):
    one = (gc.Feature("x", 1.0),)
    rows = [(i, 10.5) for i in range(6)] + [(10 + i, 13.5) for i in range(6)] + [(20, 12.5), (21, 11.4)] + [(30, 50.5), (31, 51.5), (40, 90.5)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, 10.5), (50, None)], "geo_id long, x double")
    kept = {r.geo_id: (r.label, r.dense) for r in gc.cluster(df, "geo_id", one, (1.2,), min_points=5, reach=1, keep_loose=True).collect()}
    assert kept.keys() == {i for i, _ in rows}
    left, right = kept[0], kept[10]
    assert left != right and left[1] and right[1] and {kept[i] for i in range(6)} == {left} and kept[20] == right and kept[21] == left
    assert kept[30] == kept[31] and not kept[30][1] and kept[40] not in (kept[30], left, right)
    plain = gc.cluster(df, "geo_id", one, (1.2,), min_points=5, reach=1)
    assert {r.geo_id for r in plain.collect()} == kept.keys() - {30, 31, 40}
    told = {r["size"]: r.dense for r in gc.describe(gc.cluster(df, "geo_id", one, (1.2,), min_points=5, reach=1, keep_loose=True), "geo_id", one).collect()}
    assert told == {7: True, 2: False, 1: False}
