"""Filling fixed-capacity containers: optimal length buckets and token-budget batches.

Only the histogram of sizes (at most ``capacity`` numbers) goes to the driver. Dynamic programming over it
chooses the bucket bounds that waste least when every item of a bucket counts as long as its bound. Batches
form inside each bucket, as many items as the budget takes: the plain method, whose containers are counted. A
second step, measured against the first, tops up the room that a batch leaves with shorter items, so that
batches of their buckets are saved. The result is a short list of container patterns; items find their
container by their rank inside their bucket, which is computed in salted shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import cut, shuffle_width


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least total padding ``sum(count * (bound - size))``; sizes ascend."""
    m = len(sizes)
    if m <= buckets:
        return sizes.copy()
    n, s = np.r_[0, np.cumsum(counts)].astype(float), np.r_[0, np.cumsum(counts * sizes)].astype(float)
    cost = sizes[None, :] * (n[None, 1:] - n[:-1, None]) - (s[None, 1:] - s[:-1, None])  # items i..j in one bucket
    cost[np.tril_indices(m, -1)] = np.inf
    best, back = cost[0].copy(), np.zeros((buckets, m), dtype=np.int64)
    for k in range(1, buckets):
        through = np.r_[np.inf, best[:-1]][:, None] + cost
        back[k] = through.argmin(axis=0)
        now = through[back[k], np.arange(m)]
        back[k] = np.where(now < best, back[k], -1)
        best = np.minimum(now, best)
    bounds, j, k = [], m - 1, buckets - 1
    while j >= 0:
        while k and back[k][j] < 0:
            k -= 1
        bounds.append(sizes[j])
        j, k = (int(back[k][j]) - 1, k - 1) if k else (-1, 0)
    return np.array(bounds[::-1])


@dataclass(frozen=True)
class PackPlan:
    """Bucket bounds, rows (bucket, first rank, last rank + 1, items per container, first container), and numbers of containers.

    ``batches`` is the number of containers of batches inside buckets alone, ``containers`` that after topping up.
    """

    bounds: np.ndarray
    ranges: np.ndarray
    batches: int
    containers: int


def batches(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the items of a batch, as many as the budget takes if each is as long as the bound, and the number of batches."""
    each = capacity // bounds
    return each, -(-counts // each)


def top_up(bounds: np.ndarray, counts: np.ndarray, each: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """``ranges`` of a plan, and its containers: batches of the longest items first, their room filled with the longest shorter items that fit.

    Equal containers are planned at once, so the work grows with the number of buckets and not with that of items.
    """
    left, done, ranges, base = counts.copy(), np.zeros_like(counts), [], 0
    for b in range(len(bounds) - 1, -1, -1):
        while left[b]:
            pattern = [(b, min(int(each[b]), int(left[b])))]
            room = capacity - pattern[0][1] * int(bounds[b])
            for c in range(b - 1, -1, -1):
                if left[c] and (k := min(int(room // bounds[c]), int(left[c]))):
                    pattern.append((c, k))
                    room -= k * int(bounds[c])
            times = min(int(left[c]) // k for c, k in pattern)
            for c, k in pattern:
                ranges.append((c, done[c], done[c] + k * times, k, base))
                done[c] += k * times
                left[c] -= k * times
            base += times
    return np.array(sorted(ranges), dtype=np.int64).reshape(-1, 5), base


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int) -> PackPlan:
    """Containers for a histogram of sizes from 1 to ``capacity``."""
    if not len(sizes):
        return PackPlan(np.array([], dtype=np.int64), np.zeros((0, 5), dtype=np.int64), 0, 0)
    bounds = bucket_bounds(sizes, counts, buckets)
    inside = np.bincount(np.searchsorted(bounds, sizes), weights=counts, minlength=len(bounds)).astype(np.int64)
    each, alone = batches(bounds, inside, capacity)
    ranges, base = top_up(bounds, inside, each, capacity)
    return PackPlan(bounds, ranges, int(alone.sum()), base)


def histogram(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sizes ``__tokens`` above 0 that occur, ascending, and how often: at most ``capacity`` rows for the driver."""
    hist = sorted((r[0], r[1]) for r in pieces.where(F.col("__tokens") > 0).groupBy("__tokens").agg(F.count(F.lit(1))).collect())
    return tuple(np.array([h[i] for h in hist], dtype=np.int64) for i in (0, 1))


def pieces_of(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(__key, __size, __n, __piece, __tokens)``: full pieces and a rest of larger items, others as they are."""
    one = items.select(F.col(key).alias("__key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    pieces = F.greatest(F.ceil(F.col("__size") / F.lit(capacity)), F.lit(1)).cast("long")
    split = one.select("*", pieces.alias("__n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__piece"))
    return split.withColumn("__tokens", F.least(F.col("__size") - F.col("__piece") * capacity, F.lit(capacity)).cast("int"))


def report(items: DataFrame, key: str = "doc_id", size: str = "size", capacity: int = 2048, buckets: int = 128) -> DataFrame:
    """``(step, containers, tokens, fill)`` of the steps 'least' (tokens over capacity, rounded up), 'batches' (inside buckets) and 'topped up'."""
    sizes, counts = histogram(pieces_of(items, key, size, capacity))
    made, tokens = plan(sizes, counts, capacity, buckets), int((sizes * counts).sum())
    rows = [(step, n, tokens, tokens / (n * capacity) if n else None) for step, n in (("least", -(-tokens // capacity)), ("batches", made.batches), ("topped up", made.containers))]
    return items.sparkSession.createDataFrame(rows, "step string, containers long, tokens long, fill double")


def pack(items: DataFrame, key: str = "doc_id", size: str = "size", capacity: int = 2048, buckets: int = 128) -> DataFrame:
    """``(key, size, n_pieces, piece, first_token, n_tokens, container)`` for each piece of each item.

    Items within the capacity are one piece; larger ones are split into full pieces and a rest, full pieces
    having a container of their own. Items of size 0 or null size need no room: one piece in container null.
    Items with null or repeated keys are packed like any others. ``container`` counts from 0 without gaps. An
    empty table gives an empty result; other columns are ignored.
    """
    split = cut(pieces_of(items, key, size, capacity))
    sizes, counts = histogram(split)
    todo = plan(sizes, counts, capacity, buckets)
    shards = shuffle_width(items.sparkSession) * 4
    bucket = F.array_position(F.transform(F.lit(todo.bounds.tolist()), lambda b: b >= F.col("__tokens")), True) - 1 if len(sizes) else F.lit(0)
    salted = split.withColumns({"__bucket": F.when(F.col("__tokens") > 0, bucket).otherwise(-1).cast("int"), "__shard": F.pmod(F.xxhash64("__key", "__piece"), F.lit(shards)).cast("int")})
    per = salted.groupBy("__bucket", "__shard").agg(F.count(F.lit(1)).alias("__in"))  # buckets x shards rows
    before = F.coalesce(F.sum("__in").over(Window.partitionBy("__bucket").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(F.col("__bucket").alias("__b"), F.col("__shard").alias("__s"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket", "__shard").orderBy("__key", "__piece", "__size")) - 1
    ranked = salted.withColumn("__within", within).join(offsets, (F.col("__bucket") == F.col("__b")) & (F.col("__shard") == F.col("__s")))
    ranked = ranked.select("__key", "__size", "__n", "__piece", "__tokens", "__bucket", (F.col("__before") + F.col("__within")).cast("long").alias("__rank"))
    ranges, shift = todo.ranges, np.int64(2) ** 40
    starts = ranges[:, 0] * shift + ranges[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (5, 6))
            if len(starts):
                row = ranges[np.maximum(np.searchsorted(starts, b * shift + rank, "right") - 1, 0)]
                container = row[:, 4] + (rank - row[:, 1]) // row[:, 3]
            else:
                container = np.zeros_like(rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(container, mask=b < 0)], ["__key", "__size", "__n", "__piece", "__tokens", "container"])

    kind = dict(items.dtypes)[key]
    placed = ranked.mapInArrow(place, f"__key {kind}, __size long, __n long, __piece long, __tokens int, container long")
    return placed.select(F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__n").alias("n_pieces"), F.col("__piece").alias("piece"), (F.col("__piece") * capacity).alias("first_token"), F.col("__tokens").alias("n_tokens"), "container")


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(container, n_items, tokens, room)`` of the containers of ``pack``."""
    one = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").cast("long").alias("tokens"))
    return one.withColumn("room", F.lit(capacity) - F.col("tokens"))


def split_items(packed: DataFrame, key: str, capacity: int = 2048) -> DataFrame:
    """``(key, tokens, n_containers)`` of the items of ``pack`` that lie in several containers, as they don't fit one."""
    placed = packed.where(F.col("container").isNotNull()).groupBy(key).agg(F.max(F.col("first_token") + F.col("n_tokens")).alias("tokens"), F.count_distinct("container").alias("n_containers"))
    return placed.where((F.col("n_containers") > 1) & (F.col("tokens") > capacity))
