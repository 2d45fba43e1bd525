"""Mixtures: shares, caps, marginals, dirty sources, empty tables."""

import random

import numpy as np
import pandas as pd

from quadloom.llm import mixing

DOCS = "doc_id long, source string, lang string, title_id long, size long, copies int, weight double"
TARGETS = "source string, weight double, max_repeats int"


def docs(n=3000):
    r = random.Random(2)
    out = []
    for i in range(n):
        s = r.choice(["a"] * 6 + ["b", " B ", "c", None, "other"])
        out.append((i, s, r.choice(["en", "EN", "de", None, "xx"]), r.choice([1, 1, r.randint(2, 50)]), r.choice([0, r.randint(1, 60), None, 20]), 3, 4.0))
    return out


def test_mix(spark):
    data = docs()
    targets = [("A", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 1), ("c", 0.2, 1), ("nowhere", 0.0, 3)]
    mixture, shares = mixing.mix(spark.createDataFrame(data, DOCS), spark.createDataFrame(targets, TARGETS))
    rows, told = mixture.collect(), {r.source: r for r in shares.collect()}
    total = sum(d[4] or 0 for d in data)
    own = {s: sum(d[4] or 0 for d in data if (d[1] or "").strip().lower() == s) for s in "abc"}
    cap = {"a": 1, "b": 4, "c": 1}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        tokens = sum(r["size"] * r.copies for r in rows if r.source == s)
        assert told[s].tokens == tokens and told[s].short == (cap[s] * own[s] < w * total)
        want = min(w * total, cap[s] * own[s])
        assert abs(tokens - want) <= max(0.02 * want, 120)
        assert max(r.copies for r in rows if r.source == s) <= cap[s]
    assert told["nowhere"].tokens == 0 and abs(sum(t.actual_share for t in told.values()) - 1) < 1e-9
    assert len({r.doc_id for r in rows}) == len(rows) and {r.lang for r in rows} <= {"en", "de", "other"}


def test_largest_mixture_with_all_shares(spark):
    data = docs()
    targets = [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 3), ("nowhere", 0.1, 3)]
    mixture, shares = mixing.mix(spark.createDataFrame(data, DOCS), spark.createDataFrame(targets, TARGETS), whole=False)
    told = {r.source: r for r in shares.collect()}
    assert all(abs(told[s].actual_share - w) < 0.01 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and told["nowhere"].tokens == 0 and told["nowhere"].short
    own = {s: sum(d[4] or 0 for d in data if (d[1] or "").strip().lower() == s) for s in "abc"}
    most = min(own["a"] * 1 / 0.5, own["b"] * 1 / 0.3, own["c"] * 3 / 0.2)
    assert abs(sum(t.tokens for t in told.values()) - most) < 0.02 * most
    assert all(r.copies <= dict(a=1, b=1, c=3)[r.source] for r in mixture.collect())


def test_rake_meets_margins():
    r = np.random.default_rng(1)
    cells = pd.DataFrame([(s, g, t, float(r.integers(50, 200)), 10) for s in "ab" for g in ("en", "de") for t in range(3)], columns=["source", "lang", "topic", "mass", "rows"])
    got = mixing.rake(cells, pd.DataFrame({"source": ["a", "b"], "weight": [0.7, 0.3], "max_repeats": [9, 9]}), cells["mass"].sum())
    out = got["mass"] * got["factor"]
    assert np.allclose(out.groupby(got["source"]).sum() / out.sum(), [0.7, 0.3])
    assert np.allclose(out.groupby(got["lang"]).sum() / out.sum(), cells.groupby("lang")["mass"].sum() / cells["mass"].sum(), atol=1e-6)


def test_fill():
    assert np.allclose(mixing.fill(np.array([1.0, 1, 8]), np.ones(3), np.array([1.0, 4, 4]), 20), [1, 19 / 9, 19 / 9])
    assert mixing.fill(np.array([1.0]), np.ones(1), np.array([2.0]), 9).tolist() == [2]


def test_empty(spark):
    none, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 2)], TARGETS)
    mixture, shares = mixing.mix(none, targets)
    assert mixture.collect() == [] and [(r.source, r.tokens, r.short) for r in shares.collect()] == [("a", 0, False)]
    mixture, shares = mixing.mix(spark.createDataFrame(docs(20), DOCS), spark.createDataFrame([], TARGETS))
    assert mixture.collect() == [] and shares.collect() == []
