"""Most frequent values in bounded memory: hierarchical count-sketch over hash-bit prefixes.

Every value is hashed to 64 bits. For each prefix length a count-sketch (rows of signed counters) takes the
frequency of the prefix. Sketches are linear: each task fills its own over Arrow batches and they are summed.
The driver gets the summed counters (a fixed number, whatever the data) and descends: a prefix whose
estimate could reach the threshold is opened into its children. The prefixes left at the longest length
select candidates in a second scan, which counts them exactly.

The sketch tells its own error. Where that is too large for the share asked for, the counters are widened and
filled again, up to a limit beyond which the share is refused; a prefix that may be frequent is never cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters in a row of the first sketch, and the most a row may be widened to.
WIDTH, MAX_WIDTH = 4096, 1 << 20
#: Prefixes that a level may keep, as a multiple of 1 / share.
KEPT = 16


class UnresolvedShare(ValueError):
    """The sketch can't tell values of the share from the rest."""


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift, public splitmix constants), one for each seed."""
    z = h + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class SketchPlan:
    """Size of the sketches: ``levels`` are prefix lengths in bits, each with ``depth`` rows of ``width`` counters, a power of two."""

    levels: tuple[int, ...] = (8, 12, 16, 20, 24, 28, 32)
    depth: int = 5
    width: int = 4096

    def cells(self) -> int:
        return len(self.levels) * self.depth * self.width

    def exact(self, level: int) -> bool:
        """Whether the prefixes of a level are so few that each has a counter of its own."""
        return 1 << self.levels[level] <= self.width

    def _hit(self, prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        if self.exact(level):
            return prefix.astype(np.int64), np.ones(len(prefix), dtype=np.int64)
        z = _mix(prefix, 1 + level * self.depth + row)
        return (z & np.uint64(self.width - 1)).astype(np.int64), 1 - 2 * (z >> np.uint64(63)).astype(np.int64)

    def add(self, sketch: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> None:
        """Adds weighted 64-bit hashes to a sketch of shape (levels, depth, width)."""
        for k, bits in enumerate(self.levels):
            prefix, where = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)
            w = np.bincount(where, weights=weights, minlength=len(prefix))
            for r in range(self.depth):
                at, sign = self._hit(prefix, k, r)
                sketch[k, r] += np.bincount(at, weights=sign * w, minlength=self.width).astype(np.int64)

    def estimate(self, sketch: np.ndarray, prefix: np.ndarray, k: int) -> np.ndarray:
        rows = []
        for r in range(self.depth):
            at, sign = self._hit(prefix, k, r)
            rows.append(sketch[k, r][at] * sign)
        return np.median(np.stack(rows), axis=0)

    def error(self, sketch: np.ndarray, k: int) -> float:
        """Standard error of one row at a level, from the sketch's own second moment without its large counters."""
        if self.exact(k):
            return 0.0
        rows = np.sort(np.abs(sketch[k].astype(np.float64)), axis=1)[:, : self.width - self.width // 64]
        return float(np.sqrt(np.median((rows**2).sum(axis=1)) / self.width * 1.1))

    @staticmethod
    def of_share(share: float) -> SketchPlan:
        """Rows of at least 16 / share counters, so that chance meetings of values below a share stay small against it."""
        width = WIDTH
        while width < min(16 / share, MAX_WIDTH):
            width *= 2
        return SketchPlan(width=width)

    def descend(self, sketch: np.ndarray, threshold: float, total: int, sigmas: float = 4.0) -> np.ndarray:
        """Prefixes of the longest length whose estimate may reach the threshold: at most ``KEPT * total / threshold`` on any level.

        A prefix is kept from ``sigmas`` standard errors below the threshold on. Where those are more than half of
        the threshold, or too many prefixes stay, ``UnresolvedShare`` is raised instead of cutting any off. A frequent
        prefix is lost only if three of five rows are all off by ``sigmas`` to the same side: by Chebyshev's
        inequality in fewer than 0.3 % of cases, whatever the data, and practically never for many rare values.
        """
        limit = KEPT * total / threshold
        prefix = np.arange(1 << self.levels[0], dtype=np.uint64)
        for k, bits in enumerate(self.levels):
            if k:
                step = bits - self.levels[k - 1]
                prefix = ((prefix[:, None] << np.uint64(step)) | np.arange(1 << step, dtype=np.uint64)).ravel()
            margin = sigmas * self.error(sketch, k)
            if margin > threshold / 2:
                raise UnresolvedShare(f"{self.width} counters leave an error of {margin:.0f} at a threshold of {threshold:.0f}")
            prefix = prefix[self.estimate(sketch, prefix, k) >= max(threshold - margin, 0.5)]
            if len(prefix) > max(limit, 256):
                raise UnresolvedShare(f"{len(prefix)} prefixes of {bits} bits may be frequent")
        return prefix


@dataclass
class HeavyHitters:
    """Sketch of several columns: ``total`` rows and, per column, the counters."""

    plan: SketchPlan
    total: int
    sketches: dict[str, np.ndarray] = field(default_factory=dict)


def _hash(column: str):
    return F.xxhash64(F.col(column))


def sketch(df: DataFrame, columns: list[str], plan: SketchPlan = SketchPlan()) -> HeavyHitters:
    """One pass over ``df``. Null values of a column are not counted; ``total`` counts all rows."""
    hashed = df.select(*[F.when(F.col(c).isNotNull(), _hash(c)).alias(f"h{i}") for i, c in enumerate(columns)])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((n, len(plan.levels), plan.depth, plan.width), dtype=np.int64)
        rows, waiting, held = 0, [[] for _ in range(n)], 0

        def flush() -> None:
            for i in range(n):
                if waiting[i]:
                    h, w = np.unique(np.concatenate(waiting[i]), return_counts=True)
                    plan.add(own[i], h.view(np.uint64), w)
                    waiting[i].clear()

        for batch in batches:
            rows += batch.num_rows
            held += batch.num_rows
            for i in range(n):
                waiting[i].append(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
            if held > 500_000:
                flush()
                held = 0
        flush()
        rows_of = own.reshape(-1, plan.width)
        for at in range(0, len(rows_of), 64):
            part = rows_of[at : at + 64]
            some = np.flatnonzero(part.any(axis=1))
            ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * plan.width)
            yield pa.RecordBatch.from_arrays([pa.array((some + at).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(part[some].ravel()))], ["row", "amounts"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([[rows]], pa.list_(pa.int64()))], ["row", "amounts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most one entry for each row of counters
        for batch in batches:
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for i, row in enumerate(batch.column(0).to_numpy().tolist()):
                part = flat[ends[i] : ends[i + 1]]
                sums[row] = sums[row] + part if row in sums else part.copy()
        for row, amounts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([amounts], pa.list_(pa.int64()))], ["row", "amounts"])

    kind = "row int, amounts array<long>"
    got = hashed.mapInArrow(run, kind).repartition("row").mapInArrow(add, kind).toArrow()  # columns x levels x depth rows, whatever the input
    out, rows_of = HeavyHitters(plan, 0), np.zeros((n * len(plan.levels) * plan.depth, plan.width), dtype=np.int64)
    for row, amounts in zip(got["row"].to_pylist(), got["amounts"], strict=True):
        amounts = amounts.values.to_numpy()
        if row < 0:
            out.total += int(amounts[0])
        else:
            rows_of[row] = amounts
    for i, c in enumerate(columns):
        out.sketches[c] = rows_of.reshape(n, len(plan.levels), plan.depth, plan.width)[i]
    return out


def frequent_prefixes(df: DataFrame, columns: list[str], share: float, plan: SketchPlan | None = None) -> tuple[HeavyHitters, dict[str, np.ndarray]]:
    """The sketch, and per column the prefixes that may hold a value of the share, at most ``KEPT / share``."""
    plan = plan or SketchPlan.of_share(share)
    while True:
        found = sketch(df, columns, plan)
        try:
            return found, {c: plan.descend(found.sketches[c], share * found.total, found.total) if found.total else np.zeros(0, dtype=np.uint64) for c in columns}
        except UnresolvedShare as e:
            if plan.width * 4 > MAX_WIDTH:
                raise UnresolvedShare(f"a share of {share} can't be resolved: {e}") from None
            plan = SketchPlan(plan.levels, plan.depth, plan.width * 4)


def heavy_values(df: DataFrame, columns: list[str], share: float, verify: DataFrame | None = None, distinct: list[str] | None = None, plan: SketchPlan | None = None) -> DataFrame:
    """``(col_name, value, n, estimate, total)`` of the values in at least ``share`` of the rows.

    ``df`` is sketched; ``verify`` (``df`` by default) is scanned again for the candidates and counts them
    exactly, on its distinct rows of ``distinct`` if given. Ties at the threshold all come out. Nulls are no
    values. An empty table gives an empty result. The columns must be of one type; others are ignored. The first
    width of the sketch follows from the share unless ``plan`` gives one; a share that ``MAX_WIDTH`` counters can't
    resolve raises ``UnresolvedShare``.
    """
    found, heavy = frequent_prefixes(df, columns, share, plan)
    rows, spark, bits = df if verify is None else verify, df.sparkSession, found.plan.levels[-1]
    last, told = len(found.plan.levels) - 1, []
    for i, c in enumerate(columns):
        e = found.plan.estimate(found.sketches[c], heavy[c], last).astype(np.int64)
        mine = F.broadcast(spark.createDataFrame(pa.table({f"__p{i}": pa.array(heavy[c].astype(np.int64)), f"__e{i}": pa.array(e)})))  # at most KEPT / share rows
        rows = rows.join(mine, F.shiftrightunsigned(_hash(c), 64 - bits) == F.col(f"__p{i}"), "left")
        told.append(F.when(F.col(c).isNotNull() & F.col(f"__e{i}").isNotNull(), F.struct(F.lit(c).alias("col_name"), F.col(c).alias("value"), F.col(f"__e{i}").alias("estimate"))))
    rows = rows.where(F.coalesce(*[F.col(f"__e{i}") for i in range(len(columns))]).isNotNull())
    if distinct:
        rows = rows.dropDuplicates(distinct)
    counted = rows.select(F.explode(F.array_compact(F.array(*told))).alias("x")).groupBy("x.col_name", "x.value", "x.estimate").agg(F.count(F.lit(1)).alias("n"))
    total = F.lit(found.total).cast("long")
    return counted.where(F.col("n") >= F.lit(share) * total).select("col_name", "value", "n", "estimate", total.alias("total"))
