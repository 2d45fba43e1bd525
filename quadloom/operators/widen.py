"""Entity, attribute, value rows into one typed row per entity: ``combineByKey`` over slot registers.

Values are recognised and normalised by Catalyst expressions; the rows that are left, ``(entity, slot,
value, order)``, go through one RDD ``combineByKey``. A register holds, per slot that the entity has, only
counts, the smallest and largest value and the latest one, so cells merge associatively on the map side
and the register of an entity with a third of all rows is no larger than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r\x0b\x0c"
TYPES = {"iri": T.StringType(), "string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
#: A wide table has at most this many columns; more attributes are an error, not a larger closure.
MAX_SLOTS = 5000
#: Rows of listed attributes for each reduce task of the register shuffle.
ROWS_PER_TASK = 100_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Microseconds of the first and last moment that a client's datetime can hold.
_FIRST, _LAST = ((t.replace(tzinfo=timezone.utc) - _EPOCH) // timedelta(microseconds=1) for t in (datetime.min, datetime.max))


def readable(value_type: Column, kind: Column, lex: Column) -> Column:
    """The trimmed text if it reads as the type, else null; longs without plus and leading zeros, timestamps as microseconds since 1970.

    iri: any IRI object; long: digits with an optional sign; double: a decimal number with optional sign and
    exponent; boolean: true, false, 1, 0; timestamp: a valid ISO date and time with optional fraction and
    zone, UTC without one; string: any literal that isn't blank. Null text is never readable.
    """
    t = F.btrim(lex, F.lit(BLANKS))
    literal = kind == 3
    stamp = F.concat(t, F.when(t.rlike(r"(?:Z|[+-]\d\d:\d\d)$"), F.lit("")).otherwise(F.lit("Z")))
    micros = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?$"), F.unix_micros(stamp.try_cast("timestamp")).cast("string"))
    return (
        F.when(value_type == "iri", F.when((kind == 2) & (t != ""), t))
        .when(value_type == "string", F.when(literal & (t != ""), t))
        .when(value_type == "long", F.when(literal & t.rlike(r"^[+-]?[0-9]+$"), F.regexp_replace(F.regexp_replace(t, r"^\+?(-?)0*(?=[0-9])", "$1"), "^-0$", "0")))
        .when(value_type == "double", F.when(literal & t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t))
        .when(value_type == "boolean", F.when(literal & t.isin("true", "1"), F.lit("1")).when(literal & t.isin("false", "0"), F.lit("0")))
        .when(value_type == "timestamp", F.when(literal, micros))
    )


def _reader(value_type: str):
    """Python value for comparison. Longs stay text, as they may have any number of digits: equal texts are equal numbers."""
    return {"double": float, "boolean": int, "timestamp": int}.get(value_type, str)


def registers(quads: DataFrame, wide_columns: DataFrame) -> tuple[RDD, list[tuple[str, str]]]:
    """``(entity, {slot: cell})`` for entities with at least one listed attribute, and the slots' (attr, type).

    A cell is ``(rows, smallest, largest, order of the latest, latest)`` over readable values (longs as text and in
    its order), with ``None`` for all four where no value was readable. ``quads`` needs s, p, o_kind, o_lex, load_ts and seq; rows with
    null s or p are left out. ``order`` is (load_ts, seq), nulls first.
    """
    listed = sorted({(r.attr, r.value_type, r.p) for r in wide_columns.select("attr", "value_type", "p").dropna().limit(MAX_SLOTS + 1).collect()})
    if len(listed) > MAX_SLOTS:
        raise ValueError(f"more than {MAX_SLOTS} wide columns")
    kinds = {attr: kind for attr, kind, _ in listed}
    if bad := {k for k in kinds.values() if k not in TYPES}:
        raise ValueError(f"unknown value types {sorted(bad)}")
    slots = sorted(kinds.items())
    number = {attr: i for i, (attr, _) in enumerate(slots)}
    spark = quads.sparkSession
    if not slots:
        return spark.sparkContext.emptyRDD(), slots
    lookup = F.broadcast(spark.createDataFrame([(p, number[a], k) for a, k, p in listed], "__p string, __slot int, __kind string"))  # at most MAX_SLOTS rows
    rows = quads.join(lookup, F.col("p") == F.col("__p")).where(F.col("s").isNotNull()).select(
        F.col("s").alias("e"), "__slot", readable(F.col("__kind"), F.col("o_kind"), F.col("o_lex")).alias("v"), F.unix_micros(F.col("load_ts").cast("timestamp")).alias("t"), F.col("seq").alias("n")
    )
    width = max(1, -(-quads.where(F.col("p").isin([p for _, _, p in listed])).count() // ROWS_PER_TASK))
    readers = [_reader(k) for _, k in slots]
    low = -(2**63)

    def cell(row):
        if row[2] is None:
            return row[1], (1, None, None, None, None)
        v = readers[row[1]](row[2])
        return row[1], (1, v, v, (low if row[3] is None else row[3], low if row[4] is None else row[4]), v)

    def join(a, b):
        if b[3] is None:
            return (a[0] + b[0], *a[1:])
        if a[3] is None:
            return (a[0] + b[0], *b[1:])
        late = a if (a[3], a[4]) >= (b[3], b[4]) else b
        return a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), late[3], late[4]

    def create(row):
        k, c = cell(row)
        return {k: c}

    def add(register, row):
        k, c = cell(row)
        old = register.get(k)
        register[k] = c if old is None else join(old, c)
        return register

    def merge(a, b):
        for k, c in b.items():
            old = a.get(k)
            a[k] = c if old is None else join(old, c)
        return a

    return rows.rdd.map(lambda r: (r[0], r)).combineByKey(create, add, merge, width), slots


def cell_states(quads: DataFrame, wide_columns: DataFrame) -> DataFrame:
    """``(s, attr, n_rows, cell_state)`` of every cell: 'unreadable' (no readable value), 'multiple' (readable values that differ), else 'single'."""
    combined, slots = registers(quads, wide_columns)

    def states(item):
        for k, c in item[1].items():
            yield item[0], slots[k][0], c[0], "unreadable" if c[3] is None else "single" if c[1] == c[2] else "multiple"

    return quads.sparkSession.createDataFrame(combined.flatMap(states), "s string, attr string, n_rows long, cell_state string", verifySchema=False)


def widen(quads: DataFrame, wide_columns: DataFrame, extra: Sequence[str] = ("n_multiple", "n_unreadable")) -> DataFrame:
    """One row per entity: ``s``, a column of its own type per attr (alphabetically), and the numbers of multiple and unreadable cells.

    A cell with several readable values takes the latest by (load_ts, seq), nulls first; a cell without any,
    a long outside 64 bits and a timestamp outside the years 1 to 9999 are null. Entities appear if they have a listed attribute at all. Attributes
    named like ``s`` or the two counts get a trailing underscore.
    """
    combined, slots = registers(quads, wide_columns)

    def typed(kind, v):
        if kind == "boolean":
            return bool(v)
        if kind == "timestamp":
            return _EPOCH + timedelta(microseconds=v) if _FIRST <= v <= _LAST else None
        if kind == "long":
            return int(v) if len(v) <= 20 and -(2**63) <= int(v) < 2**63 else None
        return v

    def row(item):
        cells = item[1]
        values = [None if (c := cells.get(k)) is None or c[3] is None else typed(kind, c[4]) for k, (_, kind) in enumerate(slots)]
        return (item[0], *values, sum(c[3] is not None and c[1] != c[2] for c in cells.values()), sum(c[3] is None for c in cells.values()))

    taken = {"s", *extra}
    fields = [T.StructField("s", T.StringType())] + [T.StructField(a + "_" if a in taken else a, TYPES[k]) for a, k in slots] + [T.StructField(c, T.IntegerType()) for c in extra]
    return quads.sparkSession.createDataFrame(combined.map(row), T.StructType(fields), verifySchema=False)
