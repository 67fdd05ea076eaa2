"""The comparison tables, over every pair of kinds of values, against a plain statement of them."""

import itertools
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values
from weftgraph.functions.expressions import p
from weftgraph.sources.graph import Graph

COLUMNS = {"i": [None, 1, 2], "f": [None, 1.0, 1.5, float("nan")], "b": [None, False, True], "s": [None, "a", "b"]}
TYPES = {"i": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "s": T.StringType()}


def order(a, b):
    """-1, 0 or 1; 0 also where there is no order."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
    if numbers and (math.isnan(a) or math.isnan(b)) or not numbers and type(a) is not type(b):
        return 0
    return (a > b) - (a < b)


def expected(op, a, b):
    same = a is None and b is None or type(a) is type(b) and a == b
    return {"=": same, "<>": not same, "<": order(a, b) < 0, "<=": order(a, b) <= 0, ">": order(a, b) > 0, ">=": order(a, b) >= 0}[op]


@pytest.mark.parametrize("left,right", [*itertools.product(COLUMNS, COLUMNS)])
def test_value_position(spark, left, right):
    pairs = [*itertools.product(COLUMNS[left], COLUMNS[right])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], T.StructType([T.StructField("n", T.LongType()), T.StructField("a", TYPES[left]), T.StructField("b", TYPES[right])]))
    ka, kb = values.kind(TYPES[left]), values.kind(TYPES[right])
    a, b = F.col("a"), F.col("b")
    checked(df, pairs, a, ka, b, kb)
    for x, kx, y, ky in ((values.tagged(a, ka), values.TAGGED, b, kb), (a, ka, values.tagged(b, kb), values.TAGGED), (values.tagged(a, ka), values.TAGGED, values.tagged(b, kb), values.TAGGED)):
        checked(df, pairs, x, kx, y, ky)


def checked(df, pairs, a, ka, b, kb):
    made = {"=": values.equal(a, ka, b, kb), "<>": ~values.equal(a, ka, b, kb), "<": values.less(a, ka, b, kb), "<=": values.at_most(a, ka, b, kb), ">": ~values.at_most(a, ka, b, kb), ">=": ~values.less(a, ka, b, kb)}
    for row in df.select("n", *[c.alias(op) for op, c in made.items()]).collect():
        for op in made:
            assert row[op] is expected(op, *pairs[row["n"]]), (op, pairs[row["n"]])


@pytest.mark.parametrize("kind", [*COLUMNS])
def test_filter_position(spark, kind):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(COLUMNS[kind])], T.StructType([T.StructField("id", T.LongType()), T.StructField("x", TYPES[kind])]))
    rows = Graph(spark).with_nodes("N", df).match("n", "N")
    for value in (1, 1.0, 1.5, True, "a"):
        x = p("n.x")
        for op, condition in {"=": x == value, "<>": x != value, "<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}.items():
            got = {r[0] for r in rows.filter(condition).returns(p("n.id")).collect()}
            assert got == {i for i, y in enumerate(COLUMNS[kind]) if expected(op, y, value)}, (op, value)


def test_logic_takes_only_true(spark):
    df = spark.createDataFrame([(0, True, 5), (1, False, 5), (2, None, 5)], "id long, b boolean, i long")
    rows = Graph(spark).with_nodes("N", df).match("n", "N")
    ids = lambda c: sorted(r[0] for r in rows.filter(c).returns(p("n.id")).collect())
    assert ids(p("n.b")) == [0]
    assert ids(~p("n.b")) == [1, 2]
    assert ids(~p("n.i")) == [0, 1, 2]
    assert ids(p("n.i") & p("n.b")) == []
    assert ids(p("n.i") | p("n.b")) == [0]
    assert ids(~p("n.missing")) == [0, 1, 2]
