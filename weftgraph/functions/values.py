"""Comparison and logic with two truth values, as Spark columns.

There is no unknown: a missing value is a value of its own, equal to itself and smaller than
any other. Whole and floating numbers are never equal but are ordered together; values of
types that have no common order are neither smaller nor larger than each other. NaN is not
equal to itself and not smaller or larger than a number. Only an exact true counts as true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, FLOATING, BOOLEAN, STRING, OTHER, MISSING, TAGGED = "whole", "floating", "boolean", "string", "other", "missing", "tagged"

#: A property that holds values of several types: the type's number and a field for each type.
TAGS = {WHOLE: 1, FLOATING: 2, BOOLEAN: 3, STRING: 4}
TAGGED_TYPE = T.StructType([T.StructField("t", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("s", T.StringType())])


def kind(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return MISSING
    if isinstance(t, T.StructType) and t.fieldNames() == TAGGED_TYPE.fieldNames():
        return TAGGED
    if isinstance(t, T.IntegralType):
        return WHOLE
    if isinstance(t, T.FractionalType):
        return FLOATING
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    return STRING if isinstance(t, T.StringType) else f"{OTHER}:{t.simpleString()}"


def comparable(a: str, b: str) -> bool:
    return a == b or {a, b} == {WHOLE, FLOATING}


def _nan(x: Column, of: str) -> Column:
    return F.coalesce(F.isnan(x), F.lit(False)) if of == FLOATING else F.lit(False)


def tagged(x: Column, of: str) -> Column:
    """A value with its type's number; missing stays missing."""
    if of == TAGGED:
        return x
    if of == MISSING:
        return F.lit(None).cast(TAGGED_TYPE)
    if of not in TAGS:
        raise TypeError(f"no property value: {of}")
    fields = {WHOLE: "i", FLOATING: "f", BOOLEAN: "b", STRING: "s"}
    made = [F.lit(TAGS[of]).cast("byte").alias("t"), *[(x if fields[of] == f.name else F.lit(None)).cast(f.dataType).alias(f.name) for f in TAGGED_TYPE.fields[1:]]]
    return F.when(x.isNotNull(), F.struct(*made)).otherwise(F.lit(None)).cast(TAGGED_TYPE)


def plain_order(x: Column) -> Column:
    """What orders a tagged property: numbers by value, strings and booleans among themselves."""
    return F.when(x.isNotNull(), F.struct(F.coalesce(x["f"], x["i"].cast("double")).alias("number"), x["i"].alias("i"), x["s"].alias("s"), x["b"].alias("b")))


def _tagged_order(a: Column, b: Column, none: bool, of_nan: bool, op) -> Column:
    """``op`` where two tagged values have an order; ``none`` where they have not."""
    number = lambda x: F.coalesce(x["f"], x["i"].cast("double"))
    nan = _nan(a["f"], FLOATING) | _nan(b["f"], FLOATING)
    return (
        F.when((a["t"] == TAGS[WHOLE]) & (b["t"] == TAGS[WHOLE]), op(a["i"], b["i"]))
        .when((a["t"] <= TAGS[FLOATING]) & (b["t"] <= TAGS[FLOATING]), F.when(nan, F.lit(of_nan)).otherwise(op(number(a), number(b))))
        .when(a["t"] != b["t"], F.lit(none)).when(a["t"] == TAGS[STRING], op(a["s"], b["s"])).otherwise(op(a["b"], b["b"]))
    )


def equal(a: Column, ka: str, b: Column, kb: str) -> Column:
    if TAGGED in (ka, kb):
        x, y = tagged(a, ka), tagged(b, kb)
        return x.eqNullSafe(y) & ~F.coalesce(_nan(x["f"], FLOATING), F.lit(False))
    if ka != kb:
        return a.isNull() & b.isNull()
    return a.eqNullSafe(b) & ~_nan(a, ka) if ka == FLOATING else a.eqNullSafe(b)


def less(a: Column, ka: str, b: Column, kb: str) -> Column:
    """Strictly before in order."""
    if TAGGED in (ka, kb):
        x, y = tagged(a, ka), tagged(b, kb)
        return F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(_tagged_order(x, y, False, False, lambda m, n: m < n))
    if not comparable(ka, kb):
        return a.isNull() & b.isNotNull()
    ordered = F.when(_nan(a, ka) | _nan(b, kb), F.lit(False)).otherwise(a < b) if FLOATING in (ka, kb) else a < b
    return F.when(a.isNull(), b.isNotNull()).when(b.isNull(), F.lit(False)).otherwise(ordered)


def at_most(a: Column, ka: str, b: Column, kb: str) -> Column:
    """Before in order, or without an order between them."""
    if TAGGED in (ka, kb):
        x, y = tagged(a, ka), tagged(b, kb)
        return F.when(x.isNull(), F.lit(True)).when(y.isNull(), F.lit(False)).otherwise(_tagged_order(x, y, True, True, lambda m, n: m <= n))
    if not comparable(ka, kb):
        return a.isNull() | b.isNotNull()
    ordered = F.when(_nan(a, ka) | _nan(b, kb), F.lit(True)).otherwise(a <= b) if FLOATING in (ka, kb) else a <= b
    return F.when(a.isNull(), F.lit(True)).when(b.isNull(), F.lit(False)).otherwise(ordered)


def against_literal(op: str, x: Column, kx: str, value: object, kv: str) -> Column:
    """The same rows in a form that Parquet filters can use, where a column meets a literal in a filter."""
    v = F.lit(value)
    if kx == TAGGED:
        return {"=": lambda: equal(x, kx, v, kv), "<>": lambda: ~equal(x, kx, v, kv), "<": lambda: less(x, kx, v, kv), "<=": lambda: at_most(x, kx, v, kv), ">": lambda: ~at_most(x, kx, v, kv), ">=": lambda: ~less(x, kx, v, kv)}[op]()
    nan = F.isnan(x) if kx == FLOATING else None
    if op in ("=", "<>"):
        same = kx == kv
        if op == "=":
            return x == v if same else F.lit(False)
        return (x != v) | x.isNull() if same else F.lit(True)
    if not comparable(kx, kv):
        return {"<": x.isNull(), "<=": F.lit(True), ">": F.lit(False), ">=": x.isNotNull()}[op]
    if op == "<":
        return (x < v) | x.isNull()
    if op == "<=":
        return (x <= v) | x.isNull() | nan if nan is not None else (x <= v) | x.isNull()
    if op == ">":
        return (x > v) & ~nan if nan is not None else x > v
    return x >= v


def unified(frames: list):
    """Frames whose columns of one name have one type: what differs in kind between them is tagged in all."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(kind(f.dataType))
    mixed = {n for n, k in kinds.items() if len(k - {MISSING}) > 1}
    out = []
    for df in frames:
        own = {f.name: kind(f.dataType) for f in df.schema.fields}
        out.append(df.withColumns({n: tagged(F.col(n), own[n]) for n in mixed if n in own}) if mixed & {*own} else df)
    return out


def true(x: Column, of: str) -> Column:
    if of == TAGGED:
        return F.coalesce(x["b"], F.lit(False))
    return F.coalesce(x, F.lit(False)) if of == BOOLEAN else F.lit(False)
