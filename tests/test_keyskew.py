"""Key profiles against brute force, with nulls, repeats, hot keys, clashing columns and empty tables."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import rows

from quadloom.operators import keyskew

SCHEMA = "seq long, g long, s long, p long, o long, weight long, n long"


def data(seed=0, n=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.35
        q = (r.choice([1, 1, 1, 2, 3]), 7 if hot else r.randint(1, 50), r.choice([11, 11, 12, 13]), r.randint(1, 400))
        q = tuple(None if r.random() < 0.02 else -8 if r.random() < 0.02 else x for x in q)
        out.append((i, *q, 5, 6))
    return out + [(n + i, *x[1:]) for i, x in enumerate(out[:80])]


@pytest.mark.parametrize("salts", [1, 16])
def test_profile(spark, salts):
    raw = data()
    whole = {q[1:5] for q in raw if all(x is not None and x > 0 for x in q[1:5])}
    found = {(r.g, r.p): r for r in keyskew.profile_keys(keyskew.whole_quads(spark.createDataFrame(raw, SCHEMA)), salts=salts).collect()}
    by = defaultdict(Counter)
    for g, s, p, _ in whole:
        for key in ((g, p), (g, -9), (-9, p)):
            by[key][s] += 1
    assert found.keys() == by.keys()
    for key, c in by.items():
        r = found[key]
        top = max(c.values())
        assert (r.n_rows, r.n_values, r.mode_count) == (sum(c.values()), len(c), top)
        assert r.mode_value == min(s for s, k in c.items() if k == top)  # ties: the smallest


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert keyskew.profile_keys(keyskew.whole_quads(empty)).collect() == []
    assert keyskew.compress(empty, ["g"], "s").collect() == []


def test_compress_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 2), (1, 3)], "g long, s long")
    assert rows(keyskew.compress(df, ["g"], "s")) == sorted([(1, None, 2), (None, 2, 1), (1, 3, 1)], key=repr)


def test_weighted_percentiles(spark):
    r = random.Random(1)
    values = [(k, r.randint(0, 30), r.randint(1, 5)) for k in (1, None) for _ in range(100)] + [(1, None, 3), (1, 4, 0)]
    df = spark.createDataFrame(values, "k long, v long, w long")
    got = {(x.k, x.q): x.v for x in keyskew.weighted_percentiles(df, ["k"], "v", "w", [0.0, 0.5, 0.9, 1.0]).collect()}
    for k in (1, None):
        flat = sorted(v for a, v, w in values if a == k and v is not None for _ in range(w))
        for q in (0.0, 0.5, 0.9, 1.0):
            assert got[k, q] == flat[max(-(-round(q * len(flat) * 1000) // 1000) - 1, 0)]
