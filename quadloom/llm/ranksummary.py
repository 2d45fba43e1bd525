"""Percentiles with bounded rank error: deterministic rank-interval summaries that merge.

A summary of n values is a sorted list of tuples ``(v, rmin, rmax)``: the rank of ``v`` among the values is
surely between ``rmin`` and ``rmax``. Each partition makes summaries of its own rows, compressed as far as the
permitted uncertainty ``2 * eps * n`` allows. Merging adds the rank bounds of neighbours, so the accumulated
error stays visible in the tuples and is reported as ``err`` with every summary.

All steps work on many summaries at once (``Flat``), so that a task with a hundred thousand small groups costs no
more than one with a few large ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import shuffle_width

SUMMARY = "n long, err double, v array<double>, rmin array<long>, rmax array<long>"
_FIELDS = ["n", "err", "v", "rmin", "rmax"]
#: Rows, or tuples of summaries, held per task before they are folded.
HELD = 400_000
#: From more tasks than this on, partial summaries of a key are first merged in salted groups of so many.
FAN_IN = 1024
#: Summaries in one Arrow batch.
BATCH = 20_000

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Flat:
    """Summaries one behind the other, none of them empty: the tuples of summary i are those from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    v: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts) - 1

    def owner(self) -> np.ndarray:
        """The summary of each tuple."""
        return np.repeat(np.arange(self.count), np.diff(self.starts))

    def last(self) -> np.ndarray:
        return self.starts[1:] - 1

    def sizes(self) -> np.ndarray:
        """How many values each summary stands for."""
        return self.hi[self.last()]

    def kept(self, keep: np.ndarray) -> Flat:
        """The tuples marked; each summary must keep one."""
        upto = np.r_[0, np.cumsum(keep)]
        return Flat(upto[self.starts], self.v[keep], self.lo[keep], self.hi[keep])


def _ends(owner: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a tuple is the first, and the last, of its run of equal values."""
    change = (owner[1:] != owner[:-1]) | (v[1:] != v[:-1])
    return np.r_[True, change][: len(v)], np.r_[change, True][-len(v) :] if len(v) else np.zeros(0, dtype=bool)


def exact_all(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, Flat]:
    """The groups that occur, ascending, and their summaries without uncertainty: first and last occurrence of every value, with their ranks."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    names, starts = np.unique(g, return_index=True)
    rank = np.arange(1, len(g) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    first, last = _ends(g, v)
    return names, Flat(np.r_[starts, len(g)], v, rank, rank).kept(first | last)


def combine_all(f: Flat, key: np.ndarray) -> tuple[np.ndarray, Flat]:
    """Merges each two neighbouring summaries of one key; ``key`` ascends and has one entry per summary.

    A rank in the union is the own rank plus the bounds of the rank among the others; on ties the first summary's
    tuples come first. The last of an odd number stays as it is.
    """
    where = np.unique(key, return_index=True)[1]
    place = np.arange(f.count) - np.repeat(where, np.diff(np.r_[where, f.count]))
    second = place % 2 == 1
    pair = np.cumsum(~second) - 1
    owner = f.owner()
    order = np.lexsort((second[owner], f.v, pair[owner]))
    own = owner[order]
    late = second[own]
    # of the other summary of its pair, how many tuples lie before each tuple
    upto = np.r_[0, np.cumsum(late)]
    begin = np.r_[0, np.cumsum(np.bincount(pair[owner], minlength=pair[-1] + 1 if len(pair) else 0))][pair[own]]
    seconds = upto[:-1] - upto[begin]
    before = np.where(late, np.arange(len(own)) - begin - seconds, seconds)
    partner = np.where(late, own - 1, np.minimum(own + 1, f.count - 1))
    alone = ~late & ~((own + 1 < f.count) & np.r_[second, False][own + 1])
    at, size = f.starts[partner], np.diff(f.starts)[partner]
    limit = len(f.lo) - 1
    low = np.where(before > 0, f.lo[np.clip(at + before - 1, 0, limit)], 0)
    high = np.where(before < size, f.hi[np.clip(at + before, 0, limit)] - 1, f.hi[np.clip(at + size - 1, 0, limit)])
    lo = f.lo[order] + np.where(alone, 0, low)
    hi = f.hi[order] + np.where(alone, 0, high)
    counts = np.bincount(pair, weights=np.diff(f.starts)).astype(np.int64)
    return key[~second], Flat(np.r_[0, np.cumsum(counts)], f.v[order], lo, hi)


def merge_all(f: Flat, key: np.ndarray) -> tuple[np.ndarray, Flat]:
    """One summary per key, pairwise, so that errors add up over a logarithmic number of merges."""
    while len(key) > 1 and (key[1:] == key[:-1]).any():
        key, f = combine_all(f, key)
    return key, f


def compress_all(f: Flat, eps: float) -> Flat:
    """Fewer tuples: neighbours merge while ranks between those kept stay known within ``eps * n``; runs of a value keep their ends."""
    if not f.count:
        return f
    first, last = _ends(f.owner(), f.v)
    f = f.kept(first | last)
    limit = (2 * eps * f.sizes()).astype(np.int64)
    keep = np.repeat(limit == 0, np.diff(f.starts))
    keep[f.starts[:-1]] = True
    live = np.flatnonzero(limit > 0)
    stride = int(f.hi.max() + limit.max()) + 2
    line = f.owner() * stride + f.hi
    at, end = f.starts[:-1][live], f.last()[live]
    while len(live):
        at = np.maximum(np.searchsorted(line, live * stride + f.lo[at] + limit[live], "right") - 1, at + 1)
        go = at <= end
        keep[at[go]] = True
        go &= at < end
        live, at, end = live[go], at[go], end[go]
    return f.kept(keep)


def errors_all(f: Flat) -> np.ndarray:
    """Per summary, the largest distance by which the rank of an answer can be off."""
    own = (f.hi - f.lo).astype(np.float64)
    gap = np.where(f.v[1:] == f.v[:-1], np.maximum(own[1:], own[:-1]), (f.hi[1:] - f.lo[:-1]) / 2)
    gap = np.r_[0.0, gap][: len(own)]
    gap[f.starts[:-1]] = 0.0
    return np.maximum.reduceat(gap, f.starts[:-1]) if f.count else np.zeros(0)


def quantiles_all(f: Flat, q: float) -> np.ndarray:
    """Per summary, the value whose rank is nearest to ``ceil(q * n)``, at least 1."""
    if not f.count:
        return np.zeros(0)
    owner = f.owner()
    rank = np.maximum(np.ceil(q * f.sizes()), 1)[owner]
    off = np.maximum(rank - f.lo, f.hi - rank).astype(np.float64)
    run = (owner[1:] == owner[:-1]) & (f.v[1:] == f.v[:-1]) & (f.hi[:-1] <= rank[:-1]) & (f.lo[1:] >= rank[:-1])
    off[:-1][run] = -np.inf
    best = np.flatnonzero(off == np.minimum.reduceat(off, f.starts[:-1])[owner])
    return f.v[best[np.unique(owner[best], return_index=True)[1]]]


def _one(s: Summary) -> Flat:
    return Flat(np.array([0, len(s[0])]), *s)


def exact(values: np.ndarray) -> Summary:
    """The exact summary of one set of values."""
    _, f = exact_all(np.zeros(len(values), dtype=np.int64), np.asarray(values, dtype=np.float64))
    return f.v, f.lo, f.hi


def combine(a: Summary, b: Summary) -> Summary:
    """The summary of the union of two sets."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    both = Flat(np.array([0, len(a[0]), len(a[0]) + len(b[0])]), *(np.concatenate(x) for x in zip(a, b, strict=True)))
    _, f = combine_all(both, np.zeros(2, dtype=np.int64))
    return f.v, f.lo, f.hi


def compress(s: Summary, eps: float) -> Summary:
    if not len(s[0]):
        return s
    f = compress_all(_one(s), eps)
    return f.v, f.lo, f.hi


def rank_error(s: Summary) -> float:
    return float(errors_all(_one(s))[0]) if len(s[0]) else 0.0


def quantile(s: Summary, q: float) -> float | None:
    return float(quantiles_all(_one(s), q)[0]) if len(s[0]) else None


def _groups(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for the keys of each row, and of each number a row that has it. Nulls are equal."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        found = table.column(k).combine_chunks()
        found = (found.chunk(0) if isinstance(found, pa.ChunkedArray) else found).dictionary_encode(null_encoding="encode")
        own = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(found.dictionary) + 1) + own, return_inverse=True)[1]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, first


def _packed(table: pa.Table, keys: Sequence[str], rows: np.ndarray, f: Flat) -> Iterator[pa.RecordBatch]:
    """Rows of summaries; the keys of summary i are those of row ``rows[i]``."""
    errors, sizes = errors_all(f), f.sizes() if f.count else np.zeros(0, dtype=np.int64)
    names = table.select(list(keys)).take(pa.array(rows)).combine_chunks()
    for at in range(0, f.count, BATCH):
        to = min(at + BATCH, f.count)
        a, b = f.starts[at], f.starts[to]
        ends = pa.array((f.starts[at : to + 1] - a).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[a:b])) for x in (f.v, f.lo, f.hi)]
        own = [names.column(k).slice(at, to - at).combine_chunks() for k in keys]
        own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
        yield pa.RecordBatch.from_arrays([*own, pa.array(sizes[at:to]), pa.array(errors[at:to]), *lists], [*keys, *_FIELDS])


def _flat(table: pa.Table | pa.RecordBatch) -> Flat:
    """The summaries in the rows of a table."""
    columns = [table.column(c) for c in ("v", "rmin", "rmax")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    sizes = columns[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    v, lo, hi = (c.flatten().to_numpy(zero_copy_only=False) for c in columns)
    return Flat(np.r_[0, np.cumsum(sizes)], v, lo, hi)


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def summarise(df: DataFrame, keys: Sequence[str], value: str, eps: float = 0.005) -> DataFrame:
    """Partial summaries ``(keys, n, err, v, rmin, rmax)``, possibly several per key: one per task and fold.

    Null and NaN values are left out; null keys are keys. No shuffle: rows are folded where they are.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__value")).where(F.col("__value").isNotNull() & ~F.isnan("__value"))

    def fold(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        number, first = _groups(whole, keys)
        names, f = exact_all(number, whole.column("__value").to_numpy())
        yield from _packed(whole, keys, first[names], compress_all(f, eps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= HELD:
                yield from fold(held)
                held, n = [], 0
        if n:
            yield from fold(held)

    return rows.mapInArrow(run, _key_ddl(df, keys) + SUMMARY)


def merge(partial: DataFrame, keys: Sequence[str], eps: float = 0.005) -> DataFrame:
    """One summary per key.

    Partial summaries meet by key and are folded in key order over Arrow batches. A session with more than
    ``FAN_IN`` shuffle partitions merges them first in salted groups, so that a key of all tasks isn't one
    task's work; a key whose summaries outgrow the memory of ``HELD`` tuples is folded on the way.
    """
    keys = list(keys)

    def folded(whole: pa.Table, by: list[str]) -> tuple[pa.Table, np.ndarray, Flat]:
        number, first = _groups(whole, by)
        order = np.argsort(number, kind="stable")
        whole = whole.take(pa.array(order))
        key, f = merge_all(_flat(whole), number[order])
        return whole, np.searchsorted(number[order], key), compress_all(f, eps)

    def level(df: DataFrame, by: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(pa.Table.from_batches([batch]))
                n += len(batch.column(len(by) + 2).flatten())
                if n < HELD:
                    continue
                whole = pa.concat_tables(held)
                number, _ = _groups(whole, by)
                open_ = int(np.flatnonzero(number == number[-1])[0])  # rows come in key order: the last key may go on
                if open_:
                    yield from _packed(*_args(folded(whole.slice(0, open_), by), by))
                rest = whole.slice(open_)
                if len(rest.column("v").combine_chunks().flatten()) >= HELD:
                    rest = pa.Table.from_batches(list(_packed(*_args(folded(rest, by), by))), rest.schema)
                held, n = [rest], len(rest.column("v").combine_chunks().flatten())
            if held:
                yield from _packed(*_args(folded(pa.concat_tables(held), by), by))

        together = df.repartition(*by).sortWithinPartitions(*by) if by else df.coalesce(1)
        return together.mapInArrow(run, _key_ddl(df, by) + SUMMARY)

    def _args(made: tuple[pa.Table, np.ndarray, Flat], by: list[str]):
        return made[0], by, made[1], made[2]

    now = partial.select(*keys, *_FIELDS)
    width = shuffle_width(partial.sparkSession)
    if width > FAN_IN:
        salt = F.pmod(F.spark_partition_id(), F.lit(-(-width // FAN_IN))).cast("int").alias("__salt")
        now = level(now.select(*keys, salt, *_FIELDS), [*keys, "__salt"]).select(*keys, *_FIELDS)
    return level(now, keys)


def percentiles(summaries: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``(keys, n, err, q_<percent>...)`` read off merged summaries."""
    keys, qs = list(keys), list(qs)
    names = [f"q_{round(q * 100):02d}" for q in qs]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _flat(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 2], *(pa.array(quantiles_all(f, q), pa.float64()) for q in qs)], [*keys, "n", "err", *names])

    return summaries.select(*keys, *_FIELDS).mapInArrow(read, _key_ddl(summaries, keys) + "n long, err double, " + ", ".join(f"{c} double" for c in names))
