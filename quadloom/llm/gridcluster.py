"""Grid density clustering with SQL: quantise, count cells, join adjacent dense cells, propagate minimum labels.

All work between the first aggregation and the last join is on occupied cells, whose number depends on the
extent of the data and the cell widths and not on the number of records.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import cut, release


@dataclass(frozen=True)
class Feature:
    """A column, its cell width, and whether the width is of the logarithm (a factor) or of the value itself."""

    column: str
    width: float
    log: bool = False

    def scaled(self) -> Column:
        x = F.col(self.column).cast("double")
        return F.log(x) if self.log else x

    def cell(self) -> Column:
        return F.floor(self.scaled() / F.lit(self.width)).cast("int")


def valid(column: str) -> Column:
    """A number above 0; null, NaN, 0 and below are not."""
    x = F.col(column).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x != float("inf"))


def one_per_id(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with the largest valid value of each column (null without any); rows with a null key fall out."""
    best = [F.max(F.when(valid(c), F.col(c).cast("double"))).alias(c) for c in columns]
    return df.select(key, *columns).where(F.col(key).isNotNull()).groupBy(key).agg(*best)


def _neighbours(cells: DataFrame, names: Sequence[str], reach: int, limits: Sequence[float]) -> DataFrame:
    """``(__from, __to)`` of different cells at most ``reach`` apart in every dimension whose members together stay within ``limits``, each pair once."""
    n = len(names)
    lows, highs = [f"__lo{i}" for i in range(n)], [f"__hi{i}" for i in range(n)]
    moves = [m for m in itertools.product(range(-reach, reach + 1), repeat=n) if m > (0,) * n]
    offsets = F.explode(F.array(*[F.array(*[F.lit(d) for d in m]) for m in moves])).alias("__m")
    left = cells.select(F.col("__id").alias("__from"), *[F.col(c).alias(f"{c}_l") for c in lows + highs], *names, offsets)
    left = left.select("__from", *[f"{c}_l" for c in lows + highs], *[(F.col(c) + F.col("__m")[i]).alias(c) for i, c in enumerate(names)])
    fits = F.lit(True)
    for i in range(n):
        fits = fits & (F.greatest(F.col(highs[i]), F.col(highs[i] + "_l")) - F.least(F.col(lows[i]), F.col(lows[i] + "_l")) <= F.lit(limits[i]))
    return left.join(cells, list(names)).where(fits).select("__from", F.col("__id").alias("__to"))


def _components(ids: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(__id, label)``: the smallest id of each component, by minimum-label propagation with pointer jumping to convergence. ``links`` go both ways."""
    kept = cut(ids.select("__id", F.col("__id").alias("label")))
    for _ in range(max_rounds):
        labels = kept.select("__id", "label")
        near = links.join(labels, F.col("__from") == F.col("__id")).groupBy(F.col("__to").alias("__id")).agg(F.min("label").alias("__near"))
        lower = labels.join(near, "__id", "left").select("__id", F.col("label").alias("__old"), F.least("label", F.coalesce("__near", "label")).alias("__new"))
        jump = lower.select(F.col("__id").alias("__j"), F.col("__new").alias("__far"))
        after = cut(lower.join(jump, F.col("__new") == F.col("__j"), "left").select("__id", "__old", F.least("__new", F.coalesce("__far", "__new")).alias("label")))
        release(kept)
        kept = after
        if after.where(F.col("label") != F.col("__old")).isEmpty():
            return kept.select("__id", "label")
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def label_cells(cells: DataFrame, names: Sequence[str], reach: int, limits: Sequence[float], min_points: int) -> DataFrame:
    """``(names..., label, dense)`` of the cells.

    Cells of at least ``min_points`` records are dense. Cells at most ``reach`` apart in every dimension are adjacent
    if all their members together stay within ``limits`` (in scaled units), which their per-cell extremes decide.
    Adjacent dense cells share a label. Any other cell joins the largest dense cell next to it (the smaller id on
    ties) and links nothing, so that thin bridges don't join clusters. Cells without a dense one next to them are
    linked among themselves and marked as not dense.
    """
    numbered = cut(cells.withColumns({"__id": F.xxhash64(*names), "__dense": F.col("cell_rows") >= min_points}))
    pairs = _neighbours(numbered, names, reach, limits)
    facts = numbered.select("__id", "__dense", "cell_rows")
    both = pairs.unionByName(pairs.select(F.col("__to").alias("__from"), F.col("__from").alias("__to")))
    both = both.join(facts.select(F.col("__id").alias("__from"), F.col("__dense").alias("__df"), F.col("cell_rows").alias("__rf")), "__from").join(facts.select(F.col("__id").alias("__to"), F.col("__dense").alias("__dt")), "__to")
    links = cut(both.select("__from", "__to", "__df", "__rf", "__dt"))
    # a sparse cell's host: the largest dense cell next to it
    host = links.where(F.col("__df") & ~F.col("__dt")).groupBy(F.col("__to").alias("__id")).agg(F.min(F.struct(-F.col("__rf"), F.col("__from").alias("h")))["h"].alias("__host"))
    hosted = cut(numbered.where(~F.col("__dense")).select("__id").join(host, "__id", "left"))
    loose = hosted.where(F.col("__host").isNull()).select("__id")
    free = links.where(~F.col("__df") & ~F.col("__dt")).join(loose.withColumnRenamed("__id", "__from"), "__from", "left_semi").join(loose.withColumnRenamed("__id", "__to"), "__to", "left_semi")
    core = numbered.where("__dense").select("__id").unionByName(loose)
    linked = cut(links.where(F.col("__df") & F.col("__dt")).select("__from", "__to").unionByName(free.select("__from", "__to")))
    labels = _components(core, linked)
    every = labels.unionByName(hosted.where(F.col("__host").isNotNull()).join(labels.withColumnRenamed("__id", "__host"), "__host").select("__id", "label"))
    told = numbered.select("__id", *names, "__dense").join(every, "__id").join(loose.withColumn("__loose", F.lit(True)), "__id", "left")
    return told.select(*names, "label", F.col("__loose").isNull().alias("dense"))


def cluster(records: DataFrame, key: str, features: Sequence[Feature], limits: Sequence[float], min_points: int = 1, reach: int = 2, keep_loose: bool = False) -> DataFrame:
    """``(key, features..., label, dense, cell_rows)``: the cluster of each record with all features valid.

    ``limits`` are the largest differences, in scaled units, inside a cluster; cells are half as wide, so that
    members of adjacent cells are alike. Cells of at least ``min_points`` records are dense and make the clusters;
    records of other cells belong to the dense cell next to theirs. Those without one are noise and fall out, or with
    ``keep_loose`` form clusters of sparse cells, for which ``dense`` is false. Records with an invalid feature or
    null key fall out. Repeated rows of a key count once. An empty table gives an empty result.
    """
    columns = [f.column for f in features]
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    names = [f"__c{i}" for i in range(len(features))]
    one = one_per_id(records, key, columns).where(ok).select(key, *columns, *[f.cell().alias(n) for f, n in zip(features, names, strict=True)])
    one = cut(one)
    extremes = [e for i, f in enumerate(features) for e in (F.min(f.scaled()).alias(f"__lo{i}"), F.max(f.scaled()).alias(f"__hi{i}"))]
    cells = cut(one.groupBy(*names).agg(F.count(F.lit(1)).alias("cell_rows"), *extremes))
    told = cells.select(*names, "cell_rows").join(label_cells(cells, names, reach, limits, min_points), names)
    labelled = one.join(told, names).select(key, *columns, "label", "dense", "cell_rows")
    return labelled if keep_loose else labelled.where("dense")


def describe(labelled: DataFrame, key: str, features: Sequence[Feature], members: int = 5) -> DataFrame:
    """One row per cluster: size, whether it is dense, mean features and its ``members`` most typical records, those of its densest cell nearest to the cluster's mean.

    Ties go to the smaller key. Sums are made per cluster with map-side combining; the candidates of a hot
    cluster are cut per salted shard before they meet.
    """
    columns = [f.column for f in features]
    means = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.max("dense").alias("dense"), F.max("cell_rows").alias("__top"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
    off = sum(((f.scaled() - (F.log(F.col(f"mean_{f.column}")) if f.log else F.col(f"mean_{f.column}"))) / F.lit(f.width)) ** 2 for f in features)
    dense = labelled.join(means, "label").where(F.col("cell_rows") == F.col("__top")).select("label", key, off.alias("__off"), F.pmod(F.xxhash64(key), F.lit(64)).alias("__salt"))
    by = [F.col("__off"), F.col(key)]
    first = dense.withColumn("__r", F.row_number().over(Window.partitionBy("label", "__salt").orderBy(*by))).where(F.col("__r") <= members)
    best = first.withColumn("__r", F.row_number().over(Window.partitionBy("label").orderBy(*by))).where(F.col("__r") <= members)
    typical = best.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", key))), lambda x: x[key]).alias("typical"))
    return means.join(typical, "label").drop("__top")
