"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Token totals of the cells (source, language, topic) go to the driver, as many numbers as the three small
domains multiply to. Raking alternates between the marginals; a cell's factor, the expected number of copies
of its documents, never exceeds what its source may be repeated. Raked to the size of all documents, the factors
tell which sources are too small: all their cells are at the cap and don't reach the share. The mixture is raked
to the largest size at which every source reaches its share. Documents are then taken by systematic sampling
along cells and sizes, and what a draw lacks or has too much is made up, so every share comes close to its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import cut

#: Languages kept apart; others, unknown and null count as "other".
LANGUAGES = ("de", "en", "es", "fr")
#: Values of the topic column with this share of all tokens are topics of their own, at most so many as go into 1; the others are hashed into ``TOPICS`` classes.
BIG_TOPIC, TOPICS = 0.02, 16
#: Documents of a source that are sampled along one ordering.
SHARD_ROWS = 20_000
#: Starts of a systematic draw that are compared.
STARTS = 64
#: mix_targets may list at most this many sources.
MAX_SOURCES = 10_000


def clean_source(source: Column) -> Column:
    return F.lower(F.btrim(source, F.lit(" \t\n\r\x0b\x0c")))


def clean_language(lang: Column) -> Column:
    x = F.lower(F.btrim(lang, F.lit(" \t\n\r\x0b\x0c")))
    return F.when(x.isin(*LANGUAGES), x).otherwise("other")


def fill(mass: np.ndarray, factor: np.ndarray, cap: np.ndarray, target: float) -> np.ndarray:
    """``min(scale * factor, cap)`` with the scale at which the mass of the cells reaches the target, or the caps where it can't."""
    if (cap * mass).sum() <= target:
        return cap.copy()
    out, free = np.zeros_like(factor), mass > 0
    fixed = np.zeros_like(free)
    while True:
        live = free & ~fixed
        weight = (factor * mass)[live].sum()
        if weight <= 0:
            return np.where(fixed, cap, out)
        scale = (target - (cap * mass)[fixed].sum()) / weight
        over = live & (factor * scale > cap)
        if not over.any():
            return np.where(fixed, cap, factor * scale)
        fixed |= over


def rake(cells: pd.DataFrame, targets: pd.DataFrame, total: float, rounds: int = 200) -> pd.DataFrame:
    """``cells`` (source, lang, topic, mass) with ``factor``: expected copies of each document of the cell.

    Source marginals are ``weight * total`` where the source has that much at ``max_repeats``, else all it
    has; they come last in every round and hold exactly. Languages and topics keep their shares of the cells' mass
    as nearly as the caps allow.
    """
    c = cells.merge(targets, on="source", how="inner").reset_index(drop=True)
    mass, cap = c["mass"].to_numpy(float), c["max_repeats"].to_numpy(float)
    factor = np.ones(len(c))
    of_source = list(c.groupby("source").indices.values())
    wanted = [min(c["weight"][i[0]] * total, (cap * mass)[i].sum()) for i in of_source]
    whole = sum(wanted)
    margins = [(i, mass[i].sum() / max(mass.sum(), 1e-300) * whole) for by in ("lang", "topic") for i in c.groupby(by).indices.values()]
    for _ in range(rounds):
        before = factor.copy()
        for i, target in margins:
            if target > 0:
                factor[i] = fill(mass[i], np.maximum(factor[i], 1e-12), cap[i], target)
        for i, target in zip(of_source, wanted, strict=True):
            factor[i] = fill(mass[i], np.maximum(factor[i], 1e-12), cap[i], target)
        if len(factor) and np.abs(factor - before).max() < 1e-9:
            break
    c["factor"] = factor
    return c


def largest_total(cells: pd.DataFrame, targets: pd.DataFrame, most: float) -> float:
    """The largest size of a mixture, up to ``most``, in which each source that has documents reaches its share."""
    mass = cells.groupby("source")["mass"].sum()
    t = targets[targets["source"].isin(mass.index) & (targets["weight"] > 0)]
    if not len(t):
        return 0.0
    whole = t["weight"].sum()  # sources without documents leave their share to the others
    return float(min(most, (t["max_repeats"] * mass.loc[t["source"]].to_numpy() * whole / t["weight"]).min()))


def short_sources(raked: pd.DataFrame, targets: pd.DataFrame, total: float) -> set[str]:
    """Sources that miss ``weight * total`` although all their cells are at the cap."""
    full = raked.assign(__m=raked["factor"] * raked["mass"], __cap=raked["factor"] >= raked["max_repeats"]).groupby("source").agg(got=("__m", "sum"), capped=("__cap", "all"))
    got = targets.merge(full, left_on="source", right_index=True, how="left")
    return set(got.loc[(got["capped"].isna() | got["capped"].eq(True)) & (got["got"].fillna(0.0) < got["weight"] * total), "source"])


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "size", topic: str = "title_id", seed: int = 7, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The mixture ``(key, source, lang, topic, size, copies)`` and the shares of its sources.

    ``documents`` needs key, source, lang, size and a topic column, whose largest values are topics of their own
    (numbers below 0) and whose others are hashed into ``TOPICS`` classes; sources are compared trimmed and in lower case. No document is taken more than ``max_repeats`` times. With
    ``whole`` the mixture is aimed at the size of all documents: short sources give what they have, and the other
    shares grow. Without, it is as large as it can be with each source at its share.
    Documents of other or null sources and those of size 0 count for the total only and are not taken. Shares:
    ``source, weight, max_repeats, available, wanted, tokens, n_docs, n_copies, actual_share, short``, where
    ``wanted`` and ``short`` are about the size of all documents; a source without documents is listed with
    zeros. Repeated target rows of a source count once, null weights as 0 and null repeats as 1. Empty tables
    give empty results.
    """
    spark = documents.sparkSession
    want = targets.select(clean_source(F.col("source")).alias("source"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    want = want.dropna().groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).toPandas()
    if len(want) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    source = F.when(clean_source(F.col("source")).isin(*want["source"].tolist()), clean_source(F.col("source"))) if len(want) else F.lit(None).cast("string")
    docs = cut(documents.select(F.col(key).alias("__key"), source.alias("__source"), clean_language(F.col("lang")).alias("__lang"), F.col(topic).alias("__title"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size")))
    total = float(docs.agg(F.sum("__size")).first()[0] or 0)
    big = docs.where(F.col("__title").isNotNull()).groupBy("__title").agg(F.sum("__size").alias("n")).where((F.col("n") >= BIG_TOPIC * total) & (F.col("n") > 0)).orderBy("__title").collect()  # at most 1 / BIG_TOPIC rows
    hashed = F.pmod(F.xxhash64("__title"), F.lit(TOPICS)).cast("int")
    own = F.array_position(F.array(*[F.lit(r[0]) for r in big]), F.col("__title")) if big else F.lit(0)
    docs = docs.withColumn("__topic", F.when(own > 0, -own).otherwise(hashed).cast("int"))
    cells = docs.groupBy("__source", "__lang", "__topic").agg(F.sum("__size").alias("mass"), F.sum(F.when(F.col("__size") > 0, 1).otherwise(0)).alias("rows")).toPandas()  # sources x languages x topics rows
    cells.columns = ["source", "lang", "topic", "mass", "rows"]
    own = cells[cells["source"].notna() & (cells["mass"] > 0)].sort_values(["source", "lang", "topic"])
    raked = rake(own, want, total)
    short = short_sources(raked, want, total)
    if not whole:
        raked = rake(own, want, largest_total(own, want, total))
    raked["shards"] = np.ceil(raked.groupby("source")["rows"].transform("sum") / SHARD_ROWS).astype(int) if len(raked) else []
    # sizes run up and down in turn, so that neighbours along the whole order are alike and a draw's luck cancels out
    raked["turn"] = 1 - 2 * (raked.groupby("source").cumcount() % 2) if len(raked) else []
    plan = spark.createDataFrame(list(raked[["source", "lang", "topic", "factor", "shards", "turn"]].itertuples(index=False, name=None)), "__s string, __l string, __t int, __factor double, __shards int, __turn int")
    on = (F.col("__source") == F.col("__s")) & (F.col("__lang") == F.col("__l")) & (F.col("__topic") == F.col("__t"))
    drawn = docs.where(F.col("__size") > 0).join(F.broadcast(plan), on)  # sources x languages x topics rows
    drawn = drawn.withColumns({"__shard": F.pmod(F.xxhash64("__key", F.lit(seed)), F.col("__shards")), "__part": F.col("__factor") - F.floor("__factor")})
    order = Window.partitionBy("__source", "__shard").orderBy("__lang", "__topic", F.col("__size") * F.col("__turn"), F.xxhash64("__key", F.lit(seed + 1)), "__key").rowsBetween(Window.unboundedPreceding, 0)
    drawn = cut(drawn.withColumn("__upto", F.sum("__part").over(order)))

    def extra(start):
        return F.greatest(F.floor(F.col("__upto") + start) - F.floor(F.col("__upto") - F.col("__part") + start), F.lit(0))

    # of some starts of the systematic draw, each shard takes the one that comes closest to the tokens wanted from it
    starts = [(k + 0.5) / STARTS for k in range(STARTS)]
    off = F.array(*[F.sum(F.col("__size") * (extra(F.lit(u)) - F.col("__part"))) for u in starts])
    best = drawn.groupBy("__source", "__shard").agg(off.alias("__off")).withColumn("__at", F.array_position(F.transform("__off", F.abs), F.array_min(F.transform("__off", F.abs))).cast("int"))
    best = best.select(F.col("__source").alias("__bs"), F.col("__shard").alias("__bh"), ((F.col("__at") - 0.5) / STARTS).alias("__start"), F.col("__off")[F.col("__at") - 1].alias("__left"))
    drawn = drawn.join(best, (F.col("__source") == F.col("__bs")) & (F.col("__shard") == F.col("__bh"))).withColumn("__extra", extra(F.col("__start")))
    # what is still lacking or too much, where a few large documents hold a source's tokens, is made up by documents it has room for
    turned = ((F.col("__left") < 0) & (F.col("__extra") == 0) & (F.col("__part") > 0) | (F.col("__left") > 0) & (F.col("__extra") == 1)) & (F.col("__size") <= F.abs("__left"))
    by_hash = Window.partitionBy("__source", "__shard").orderBy(F.xxhash64("__key", F.lit(seed + 3)), "__key").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("__turned", turned).withColumn("__sum", F.sum(F.when(F.col("__turned"), F.col("__size"))).over(by_hash))
    drawn = drawn.withColumn("__extra", F.when(F.col("__turned") & (F.col("__sum") <= F.abs("__left")), 1 - F.col("__extra")).otherwise(F.col("__extra")))
    taken = drawn.select("*", (F.floor("__factor") + F.col("__extra")).cast("int").alias("copies")).where(F.col("copies") > 0)
    mixture = taken.select(F.col("__key").alias(key), F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__size").alias("size"), "copies")
    mixture = cut(mixture)
    got = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies")).toPandas()  # one row per source
    available = cells.groupby("source")["mass"].sum()
    rows = want.merge(got, on="source", how="left").fillna(0)
    rows["available"] = [float(available.get(s, 0)) for s in rows["source"]]
    every = float(rows["tokens"].sum()) or 1.0
    listed = [(r.source, r.weight, int(r.max_repeats), int(r.available), r.weight * total, int(r.tokens), int(r.n_docs), int(r.n_copies), r.tokens / every, r.source in short) for r in rows.itertuples()]
    shares = spark.createDataFrame(listed, "source string, weight double, max_repeats int, available long, wanted double, tokens long, n_docs long, n_copies long, actual_share double, short boolean")
    return mixture, shares
