"""Wide tables: readable forms, conflicts, latest values, broken rows, empty tables and names that clash."""

import datetime

import pytest
from conftest import rows

from quadloom.operators import widen

Q = "seq long, s string, p string, o_kind int, o_lex string, load_ts timestamp, e string, v string"
W = "attr string, value_type string, p string"
COLUMNS = [("num", "long", "<n>"), ("num", "long", "<n2>"), ("size", "double", "<d>"), ("ok", "boolean", "<b>"), ("at", "timestamp", "<t>"), ("label", "string", "<l>"), ("kind", "iri", "<k>"), ("s", "string", "<s>")]


def quads(spark, items):
    t0 = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, s, p, k, x, t0 + datetime.timedelta(hours=i), "x", "y") for i, (s, p, k, x) in enumerate(items)], Q)


CASES = [
    ("<n>", 3, ["5", "+5", " 05 "], "single"),
    ("<n>", 3, ["5", "6"], "multiple"),
    ("<n>", 3, ["0x1F", "", None, "1,024"], "unreadable"),
    ("<n>", 3, ["99999999999999999999", "99999999999999999998"], "multiple"),
    ("<n>", 3, ["7" * 6000, "+0" + "7" * 6000], "single"),
    ("<n>", 3, ["7" * 6000, "7" * 5999 + "8"], "multiple"),
    ("<n>", 3, ["-0", "+0", "000"], "single"),
    ("<n>", 3, ["-05", "5"], "multiple"),
    ("<t>", 3, ["0000-01-01T00:00:00Z"], "single"),
    ("<d>", 3, ["1.0340E+03", "1034", "+1034."], "single"),
    ("<d>", 3, [".5", "0.5e0"], "single"),
    ("<d>", 3, ["nil", "3,14", "NaN"], "unreadable"),
    ("<b>", 3, ["true", "1"], "single"),
    ("<b>", 3, ["true", "0"], "multiple"),
    ("<b>", 3, ["yes"], "unreadable"),
    ("<t>", 3, ["2024-06-01T10:00:00Z", "2024-06-01T12:00:00+02:00", "2024-06-01T10:00:00.000"], "single"),
    ("<t>", 3, ["2024-06-01T10:00:00", "2024-06-01T10:00:00.5Z"], "multiple"),
    ("<t>", 3, ["2024-13-01T10:00:00Z", "yesterday", "2024-06-01"], "unreadable"),
    ("<l>", 3, [" a ", "a"], "single"),
    ("<l>", 3, ["a", "A"], "multiple"),
    ("<l>", 3, ["   "], "unreadable"),
    ("<k>", 2, ["urn:a"], "single"),
    ("<k>", 3, ["urn:a"], "unreadable"),
    ("<l>", 3, ["x" * 200_000, "x" * 200_000], "single"),
]


def test_states(spark):
    items = [(f"<e{i}>", p, k, x) for i, (p, k, xs, _) in enumerate(CASES) for x in xs] + [(None, "<n>", 3, "1"), ("<z>", None, 3, "1"), ("<z>", "<other>", 3, "1")]
    got = {r.s: r.cell_state for r in widen.cell_states(quads(spark, items), spark.createDataFrame(COLUMNS + COLUMNS[:1], W)).collect()}
    assert got == {f"<e{i}>": c[3] for i, c in enumerate(CASES)}


def test_wide(spark):
    items = [("<a>", "<n>", 3, "1"), ("<a>", "<n2>", 3, "2"), ("<a>", "<n>", 3, "bad"), ("<a>", "<b>", 3, "1"), ("<a>", "<t>", 3, "2024-06-01T12:00:00+02:00"), ("<a>", "<s>", 3, "own"), ("<b>", "<d>", 3, "?"), ("<b>", "<n>", 3, "99999999999999999999")]
    df = widen.widen(quads(spark, items), spark.createDataFrame(COLUMNS, W))
    assert df.columns == ["s", "at", "kind", "label", "num", "ok", "s_", "size", "n_multiple", "n_unreadable"]
    a, b = (r.asDict() for r in df.orderBy("s").collect())
    assert (a["num"], a["ok"], a["s_"], a["n_multiple"], a["n_unreadable"]) == (2, True, "own", 1, 0)
    assert a["at"] == datetime.datetime(2024, 6, 1, 10)
    assert (b["num"], b["size"], b["n_unreadable"]) == (None, None, 1)


def test_values_beyond_the_columns_are_null(spark):
    items = [("<a>", "<n>", 3, "9" * 5000), ("<b>", "<t>", 3, "0000-01-01T00:00:00Z"), ("<c>", "<t>", 3, "9999-12-31T23:59:59-10:00"), ("<d>", "<n>", 3, "-009223372036854775808"), ("<e>", "<t>", 3, "0001-01-02T00:00:00Z")]
    got = {r.s: (r.num, r.at, r.n_unreadable) for r in widen.widen(quads(spark, items), spark.createDataFrame(COLUMNS, W)).collect()}
    assert got == {"<a>": (None, None, 0), "<b>": (None, None, 0), "<c>": (None, None, 0), "<d>": (-(2**63), None, 0), "<e>": (None, datetime.datetime(1, 1, 2), 0)}


def test_ties_do_not_depend_on_order(spark):
    t = datetime.datetime(2025, 1, 1)
    items = [(1, "<a>", "<n>", 3, x, t, "", "") for x in ("3", "9", "4")]
    for order in (items, items[::-1]):
        assert widen.widen(spark.createDataFrame(order, Q), spark.createDataFrame(COLUMNS, W)).collect()[0].num == 9


def test_empty(spark):
    none, columns = spark.createDataFrame([], Q), spark.createDataFrame(COLUMNS, W)
    assert widen.widen(none, columns).collect() == [] and widen.cell_states(none, columns).collect() == []
    assert rows(widen.cell_states(quads(spark, [("<a>", "<n>", 3, "1")]), spark.createDataFrame([], W))) == []


def test_unknown_type(spark):
    with pytest.raises(ValueError, match="unknown"):
        widen.registers(quads(spark, []), spark.createDataFrame([("a", "blob", "<p>")], W))
