"""Frequent values against exact counts, with a hot value, nulls, ties and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest

from quadloom.llm import heavyhitters as hh

PLAN = hh.SketchPlan(width=1024)


def data(seed, n=6000):
    r = random.Random(seed)
    s = [7 if r.random() < 0.33 else r.choice([None, 11, 12, 13]) if r.random() < 0.1 else r.randint(100, 10**9) for _ in range(n)]
    return [(i, a, None if r.random() < 0.01 else r.randint(1, 300), "x") for i, a in enumerate(s)]


@pytest.mark.parametrize("seed", [1, 2])
def test_found(spark, seed):
    rows = data(seed)
    df = spark.createDataFrame(rows, "seq long, s long, o long, n string").repartition(5)
    got = {(r.col_name, r.value): r for r in hh.heavy_values(df, ["s", "o"], 0.005, plan=PLAN).collect()}
    want = {(c, v): k for c, i in (("s", 1), ("o", 2)) for v, k in Counter(r[i] for r in rows if r[i] is not None).items() if k >= 0.005 * len(rows)}
    assert {k: r.n for k, r in got.items()} == want
    assert all(abs(r.estimate - r.n) < 0.02 * len(rows) and r.total == len(rows) for r in got.values())


def test_ties_at_the_threshold(spark):
    rows = [(v,) for v in range(50) for _ in range(4)]
    assert hh.heavy_values(spark.createDataFrame(rows, "s long"), ["s"], 0.02, plan=PLAN).count() == 50


def test_strings_repeats_and_distinct(spark):
    rows = [("a" * 100_000, i // 2) for i in range(40)] + [("", 1), (None, 1)]
    got = hh.heavy_values(spark.createDataFrame(rows, "s string, k int").distinct(), ["s"], 0.3, verify=spark.createDataFrame(rows, "s string, k int"), distinct=["s", "k"], plan=PLAN).collect()
    assert [(r.value[:1], r.n) for r in got] == [("a", 20)]


def test_empty(spark):
    assert hh.heavy_values(spark.createDataFrame([], "s long, o long"), ["s", "o"], 0.1, plan=PLAN).collect() == []
    assert hh.heavy_values(spark.createDataFrame([(None,)], "s long"), ["s"], 0.1, plan=PLAN).collect() == []


def test_sketch_is_linear():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b, c = (np.zeros((len(PLAN.levels), PLAN.depth, PLAN.width), dtype=np.int64) for _ in range(3))
    PLAN.add(a, h[:1000], np.ones(1000)), PLAN.add(b, h[1000:], np.ones(2000)), PLAN.add(c, h, np.ones(3000))
    assert (a + b == c).all()


@pytest.mark.parametrize("share", [0.005, 0.0005, 0.0002])
def test_recall_at_small_shares(spark, share):
    r = np.random.default_rng(3)
    values = np.r_[r.zipf(1.3, 60_000) % 1_000_000, r.integers(10**7, 10**12, 140_000)]
    df = spark.createDataFrame([(int(v),) for v in values], "s long").repartition(4)
    want = {v for v, n in Counter(values.tolist()).items() if n >= share * len(values)}
    assert {x.value for x in hh.heavy_values(df, ["s"], share).collect()} == want and len(want) > 5


def test_narrow_sketches_are_widened_or_refused(spark, monkeypatch):
    values = [v for v in range(2000) for _ in range(5)] + [-1] * 200
    df = spark.createDataFrame([(v,) for v in values], "s long")
    narrow = hh.SketchPlan(width=16)
    assert [x.value for x in hh.heavy_values(df, ["s"], 0.015, plan=narrow).collect()] == [-1]
    monkeypatch.setattr(hh, "MAX_WIDTH", 32)
    with pytest.raises(hh.UnresolvedShare):
        hh.heavy_values(df, ["s"], 0.015, plan=narrow)
