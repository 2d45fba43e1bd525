"""Packing: sizes, capacity, whole items, splits, fill, best bounds against brute force, broken and empty input."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.llm import packing
from quadloom.llm.sizes import size


@pytest.mark.parametrize(
    ("text", "n"),
    [(None, 0), ("", 0), (" \t\r\n  ", 0), ("Hello, world_1!", 4), ("a-b c", 4), ("ñandú ½ x²", 3), ("...", 3), ("﻿1", 2), ("♪ la ♪", 3), ("x" * 100_000, 1), ("日本語 テキスト", 2)],
)
def test_size(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(size(F.col("t"))).collect()[0][0] == n


@given(st.lists(st.integers(1, 12), min_size=1, max_size=40), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_bounds_are_optimal(items, k):
    sizes, counts = np.unique(items, return_counts=True)
    cost = lambda b: sum(n * (min(x for x in b if x >= s) - s) for s, n in zip(sizes, counts, strict=True))
    best = min(cost((*c, sizes[-1])) for j in range(min(k, len(sizes))) for c in itertools.combinations(sizes[:-1], j))
    got = packing.bucket_bounds(sizes, counts, k)
    assert len(got) <= k and cost(tuple(got)) == best


@pytest.mark.parametrize("buckets", [4, 64])
def test_pack(spark, buckets):
    r = random.Random(1)
    items = [(i, r.choice([30, 30, 30, r.randint(1, 100), r.randint(90, 350)]), 5, 6) for i in range(1500)] + [(7000, 0, 1, 1), (7001, None, 1, 1), (None, 40, 1, 1), (None, 40, 1, 1), (7002, 100, 1, 1), (7002, 100, 1, 1), (7003, 200, 1, 1)]
    got = packing.pack(spark.createDataFrame(items, "doc_id long, size long, container int, piece int"), capacity=100, buckets=buckets).collect()
    total, pieces = defaultdict(int), defaultdict(list)
    for x in got:
        if x.container is not None:
            total[x.container] += x.n_tokens
        pieces[x.doc_id].append(x)
    assert max(total.values()) <= 100 and sorted(total) == list(range(len(total)))
    assert sum(total.values()) == sum(s or 0 for _, s, *_ in items)
    assert {d for d, p in pieces.items() if p[0].n_pieces > 1} == {d for d, s, *_ in items if s and s > 100}
    for d, p in pieces.items():
        if p[0].n_pieces > 1:
            assert sorted((x.first_token, x.n_tokens) for x in p) == [(a, min(100, p[0]["size"] - a)) for a in range(0, p[0]["size"], 100)]
    assert pieces[7000][0].container is None and pieces[7001][0].n_tokens == 0 and len(pieces[None]) == len(pieces[7002]) == 2
    # against first fit decreasing, item by item
    rooms = []
    for n in sorted((x.n_tokens for x in got if x.n_tokens), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(100 - n)
        else:
            rooms[at] -= n
    assert len(total) <= (1.2 if buckets == 4 else 1.02) * len(rooms)
    told = packing.containers(packing.pack(spark.createDataFrame(items, "doc_id long, size long, a int, b int"), capacity=100, buckets=buckets), 100).collect()
    assert all(x.tokens + x.room == 100 for x in told) and len(told) == len(total)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, size long")).collect() == []
    assert [r.container for r in packing.pack(spark.createDataFrame([(1, 0)], "doc_id long, size long")).collect()] == [None]


def test_steps_and_split_items(spark):
    items = [(i, n) for i, n in enumerate([60] * 10 + [40] * 10 + [250, 100, 0])] + [(None, 5), (7, 60)]
    df = spark.createDataFrame(items, "doc_id long, size long")
    told = {r.step: r for r in packing.report(df, capacity=100, buckets=4).collect()}
    packed = packing.pack(df, capacity=100, buckets=4)
    made = packing.containers(packed, 100).count()
    assert told["least"].containers <= told["topped up"].containers == made < told["batches"].containers
    assert told["least"].tokens == sum(n for _, n in items) and abs(told["topped up"].fill - told["least"].tokens / (100 * made)) < 1e-9
    assert [(r.doc_id, r.tokens, r.n_containers) for r in packing.split_items(packed, "doc_id", 100).collect()] == [(20, 250, 3)]
    none = spark.createDataFrame([], "doc_id long, size long")
    assert {(r.containers, r.fill) for r in packing.report(none).collect()} == {(0, None)} and packing.split_items(packing.pack(none), "doc_id").collect() == []
