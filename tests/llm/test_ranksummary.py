"""Rank errors of summaries against sorted values, over merges, ties, nulls and days."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import ranksummary as rs


def off(values, answer, q):
    x = np.sort(values)
    rank = max(int(np.ceil(q * len(x))), 1)
    return max(np.searchsorted(x, answer, "left") + 1 - rank, rank - np.searchsorted(x, answer, "right"), 0)


@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=200), min_size=1, max_size=8), st.sampled_from([0.0, 0.01, 0.1]))
@settings(max_examples=60, deadline=None)
def test_merge(parts, eps):
    s = [rs.compress(rs.exact(np.array(p, dtype=float)), eps) for p in parts]
    while len(s) > 1:
        s = [rs.combine(s[i], s[i + 1]) if i + 1 < len(s) else s[i] for i in range(0, len(s), 2)]
    s = rs.compress(s[0], eps)
    values = np.array([v for p in parts for v in p], dtype=float)
    assert s[2][-1] == len(values) and rs.rank_error(s) <= 3 * eps * len(values) + 1
    for q in (0, 0.1, 0.5, 0.9, 1):
        assert off(values, rs.quantile(s, q), q) <= rs.rank_error(s) + 0.5


def test_size_is_bounded():
    s = rs.compress(rs.exact(np.random.default_rng(0).normal(size=100_000)), 0.01)
    assert len(s[0]) < 120


@pytest.mark.parametrize("held", [50, 10**6])
def test_groups_and_days(spark, held, monkeypatch):
    monkeypatch.setattr(rs, "HELD", held)
    r = np.random.default_rng(4)
    rows = [(1 if r.random() < 0.6 else None if r.random() < 0.1 else int(r.integers(2, 5)), int(r.integers(0, 3)), float(r.integers(0, 500)), 1, "v") for _ in range(4000)]
    rows += [(9, 0, None, 1, "v"), (9, 0, float("nan"), 1, "v"), (8, 1, 3.0, 1, "v"), (8, 2, 3.0, 1, "v")]
    df = spark.createDataFrame(rows, "g long, day int, x double, n int, v string").repartition(6)
    direct = rs.merge(rs.summarise(df, ["g"], "x", 0.01), ["g"], 0.01)
    days = rs.merge(rs.merge(rs.summarise(df, ["g", "day"], "x", 0.01), ["g", "day"], 0.01), ["g"], 0.01)
    for s in (direct, days):
        got = {x.g: x for x in rs.percentiles(s, ["g"], [0.1, 0.5, 0.9]).collect()}
        assert got.keys() == {x[0] for x in rows} - {9}
        for g, x in got.items():
            values = np.array([v[2] for v in rows if v[0] == g and v[2] is not None])
            assert x.n == len(values) and x.err <= 0.04 * len(values) + 1
            assert all(off(values, x[f"q_{p}"], p / 100) <= x.err + 0.5 for p in (10, 50, 90))


def test_fan_in(spark, monkeypatch):
    monkeypatch.setattr(rs, "FAN_IN", 2)
    df = spark.range(1000).selectExpr("0 AS g", "CAST(id AS double) AS x").repartition(7)
    got = rs.percentiles(rs.merge(rs.summarise(df, ["g"], "x", 0.01), ["g"], 0.01), ["g"], [0.5]).collect()[0]
    assert got.n == 1000 and abs(got.q_50 - 499) <= got.err + 1


def test_empty_and_no_keys(spark):
    none = spark.createDataFrame([], "g long, x double")
    assert rs.percentiles(rs.merge(rs.summarise(none, ["g"], "x"), ["g"]), ["g"], [0.5]).collect() == []


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3), st.integers(0, 20)), min_size=1, max_size=300), st.sampled_from([0.0, 0.02, 0.1]))
@settings(max_examples=60, deadline=None)
def test_many_groups_at_once(rows, eps):
    """Groups folded together come out as each by itself."""
    group, part, value = (np.array(c) for c in zip(*rows, strict=True))
    keys, f = rs.exact_all(group * 10 + part, value.astype(float))
    f = rs.compress_all(f, eps)
    key, merged = rs.merge_all(f, keys // 10)
    assert key.tolist() == sorted(set(group.tolist()))
    for i, g in enumerate(key.tolist()):
        one = [rs.compress(rs.exact(value[(group == g) & (part == p)].astype(float)), eps) for p in range(4) if ((group == g) & (part == p)).any()]
        while len(one) > 1:
            one = [rs.combine(one[j], one[j + 1]) if j + 1 < len(one) else one[j] for j in range(0, len(one), 2)]
        own = slice(merged.starts[i], merged.starts[i + 1])
        assert all((a == b).all() for a, b in zip(one[0], (merged.v[own], merged.lo[own], merged.hi[own]), strict=True))
        for q in (0.0, 0.3, 0.9, 1.0):
            assert rs.quantiles_all(merged, q)[i] == rs.quantile(one[0], q)
        assert rs.errors_all(merged)[i] == rs.rank_error(one[0])


def test_keys_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(rs, "HELD", 40)
    rows = [(None if i % 7 == 0 else f"k{i % 5}", 2**60 + i % 2, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, g long, x double").repartition(4)
    got = rs.percentiles(rs.merge(rs.summarise(df, ["s", "g"], "x", 0.01), ["s", "g"], 0.01), ["s", "g"], [0.5]).collect()
    sizes: dict = {}
    for s, g, _ in rows:
        sizes[s, g] = sizes.get((s, g), 0) + 1
    assert {(r.s, r.g): r.n for r in got} == sizes
