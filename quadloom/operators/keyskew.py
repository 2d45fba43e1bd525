"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first grouped by key *and* value, which map-side combining shrinks wherever a key is hot, and
only the weighted values ``(key, value, weight)`` travel on. Counts, exact distinct counts, modes and
percentiles of a key all follow from its weighted values, so no task ever sees the raw rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import cut

#: Id that stands for "any" in place of a key part.
ANY_ID = -9
QUAD = ("g", "s", "p", "o")


def positive(quad_ids: DataFrame) -> DataFrame:
    """The rows (g, s, p, o) with all four ids above 0, repeats included; null and placeholder ids fall out."""
    keep = F.lit(True)
    for c in QUAD:
        keep = keep & (F.col(c) > 0)
    return quad_ids.select(*QUAD).where(keep)


def whole_quads(quad_ids: DataFrame) -> DataFrame:
    """The distinct (g, s, p, o) with all four ids above 0."""
    return positive(quad_ids).dropDuplicates(list(QUAD))


def compress(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, value, weight)``: each value of a key once, with the number of its rows.

    Null keys and values are kept as groups of their own; an empty input gives an empty result.
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"))


def profile_keys(
    df: DataFrame,
    dims: tuple[str, str] = ("g", "p"),
    value: str = "s",
    distinct_on: Sequence[str] = QUAD,
    salts: int = 16,
    percentiles: Sequence[float] = (0.5, 0.9),
) -> DataFrame:
    """Rows and distinct values of every key of either dimension and of every pair of them.

    Result: the two dimensions (``ANY_ID`` where a dimension is left open), ``n_rows`` (distinct rows of
    ``distinct_on``), ``n_values`` (exact distinct values), ``mode_value``/``mode_count`` (the most frequent
    value; the smallest on ties) and ``freq_p<q>``, percentiles of the rows per value. Rows with a null in
    ``distinct_on`` are not counted; an empty table gives an empty result; other columns are ignored.

    Two shuffles carry data. The first spreads rows by value and a salt made from the rest of the row, so
    a value holding a third of all rows is spread over ``salts`` tasks while exact duplicates still meet.
    The second moves only compressed rows, by value. All keys of a value are then together and the
    distinct counts need no further shuffle; what is left is one row per key and frequency.
    """
    a, b = dims
    rest = [c for c in distinct_on if c != value]
    salt = F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int")
    rows = df.select(*distinct_on).dropna().withColumn("__salt", salt)
    spread = rows.repartition(value, "__salt").dropDuplicates([*distinct_on, "__salt"])
    packed = spread.groupBy(a, b, value, "__salt").agg(F.count(F.lit(1)).alias("__w")).select(a, b, value, "__w")
    keys = F.array(
        F.struct(F.col(a).alias("a"), F.col(b).alias("b")),
        F.struct(F.col(a).alias("a"), F.lit(ANY_ID).cast("long").alias("b")),
        F.struct(F.lit(ANY_ID).cast("long").alias("a"), F.col(b).alias("b")),
    )
    by_value = (
        packed.repartition(value)
        .groupBy(value, a, b)
        .agg(F.sum("__w").alias("__w"))
        .select(value, "__w", F.explode(keys).alias("__k"))
        .groupBy(value, F.col("__k.a").alias("__a"), F.col("__k.b").alias("__b"))
        .agg(F.sum("__w").alias("__w"))
    )
    frequencies = by_value.groupBy("__a", "__b", "__w").agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__v"))
    qs = [F.percentile("__w", F.lit(q), F.col("__n")).alias(f"freq_p{round(q * 100):d}") for q in percentiles]
    return frequencies.groupBy(F.col("__a").alias(a), F.col("__b").alias(b)).agg(
        F.sum(F.col("__w") * F.col("__n")).alias("n_rows"),
        F.sum("__n").alias("n_values"),
        F.max_by("__v", "__w").alias("mode_value"),
        F.max("__w").alias("mode_count"),
        *qs,
    )


def weighted_percentiles(weighted: DataFrame, keys: Sequence[str], value: str, weight: str, qs: Sequence[float]) -> DataFrame:
    """Exact percentiles per key from weighted values: ``(keys, q, value)``, the smallest value whose cumulative weight reaches ``q``.

    The values are range-partitioned by key and value; offsets per key and range are summed first, so the
    cumulative sums of a hot key run in parallel. Null values and non-positive weights are left out.
    """
    keys = list(keys)
    rows = weighted.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(value).alias("__v"), F.col(weight).alias("__w"))
    ranged = cut(rows.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))  # written: the ids must not change
    names = [f"__k{i}" for i in range(len(keys))]
    parts = ranged.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__part").alias("__p")).agg(F.sum("__w").alias("__pw"))
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*names, "__p", F.coalesce(F.sum("__pw").over(before), F.lit(0)).alias("__before"), F.sum("__pw").over(Window.partitionBy(*names)).alias("__total"))
    inside = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("__part") == F.col("__p")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = ranged.join(parts, on)
    hi = joined.withColumn("__hi", F.col("__before") + F.sum("__w").over(inside))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    hit = hi.select(*keys, "__v", "__w", "__hi", "__total", wanted).where((F.col("__hi") >= F.col("q") * F.col("__total")) & (F.col("__hi") - F.col("__w") < F.greatest(F.col("q") * F.col("__total"), F.lit(1e-9))))
    return hit.groupBy(*keys, "q").agg(F.min("__v").alias(value))
