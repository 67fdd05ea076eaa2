"""Changes: each makes a new graph from whole-table DataFrame operations."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.errors import ConstraintError, PlanError
from weftgraph.functions.expressions import as_expression
from weftgraph.functions.values import TAGGED, equal, kind, tagged, unified
from weftgraph.sources.folders import checkpointed
from weftgraph.sources.graph import KEY_BITS, EdgeTable, Graph, next_id

if TYPE_CHECKING:
    from weftgraph.plans.rows import Rows

#: What Spark leaves for a partition's rows in the numbers that it gives.
PARTITION_BITS = 33


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once, with a number in ``row#`` for each row, from 0 and without gaps."""
    kept = checkpointed(df.withColumn("row#", F.monotonically_increasing_id()))
    part, place = F.shiftright("row#", PARTITION_BITS).cast("int"), F.col("row#").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    sizes = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    if not any(sizes):
        return kept
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    starts = df.sparkSession.createDataFrame(starts, "`part#` int, `start#` long")
    return kept.withColumn("part#", part).join(F.broadcast(starts), "part#").withColumn("row#", place + F.col("start#")).drop("part#", "start#")


def _evaluated(rows: Rows, properties: dict) -> dict[str, Column]:
    out = {}
    for k, x in properties.items():
        c, t = as_expression(x).column(rows.scope)
        if isinstance(t, T.StructType) and kind(t) != TAGGED:
            raise PlanError(f"a whole node or edge cannot be the value of {k!r}")
        out[k] = c
    return out


def _as(x: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value in the type of the column that takes it."""
    return tagged(x, kind(have)) if kind(want) == TAGGED else x.cast(want)


def _next_node(graph: Graph, label: str) -> tuple[Graph, int]:
    """A graph that has the label's table, and the least id above all that its nodes have ever had."""
    if label not in graph.nodes:
        graph = graph.with_nodes(label, graph.spark.createDataFrame([], "id long"))
    table = graph.nodes[label]
    return graph, max(table.number << KEY_BITS, next_id([table]))


def _appended(table: DataFrame, new: DataFrame) -> DataFrame:
    void = [f.name for f in new.schema.fields if isinstance(f.dataType, T.NullType)]
    types = {f.name: f.dataType for f in table.schema.fields}
    new = new.withColumns({c: F.col(c).cast(types.get(c, T.StringType())) for c in void}) if void else new
    table, new = unified([table, new])
    return table.unionByName(new, allowMissingColumns=True)


def _fetched(rows: Rows, variable: str, label: str, graph: Graph, df: DataFrame) -> Rows:
    """Rows whose ``variable`` has id ``variable$id`` and the columns of its table."""
    from weftgraph.plans.rows import NODE, Bound, prefixed

    table = graph.nodes[label]
    nodes = prefixed(table.df.withColumn("label", F.lit(label)), "fetched")
    out = df.join(nodes, F.col(f"{variable}$id") == F.col("fetched$id")).drop("fetched$id").withColumnsRenamed({c: f"{variable}${c.removeprefix('fetched$')}" for c in nodes.columns if c != "fetched$id"})
    return rows.bind(out, variable, Bound(NODE, label, tuple(table.properties)), graph)


def _without(rows: Rows, variable: str) -> Rows:
    if variable not in rows.bound:
        return rows
    return replace(rows, df=rows.df.drop(*[c for c in rows.df.columns if c.startswith(f"{variable}$")]), bound={k: b for k, b in rows.bound.items() if k != variable})


def create_node(rows: Rows, variable: str, label: str, properties: dict) -> Rows:
    from weftgraph.plans.rows import NODE, Bound

    made = _evaluated(rows, properties)
    graph, first = _next_node(rows.graph, label)
    df = numbered(rows.df.withColumns({f"new${k}": c for k, c in made.items()}) if made else rows.df)
    df = df.withColumn("made#", F.lit(first) + F.col("row#"))
    new = df.select(F.col("made#").alias("id"), *[F.col(f"new${k}").alias(k) for k in made])
    table = _appended(graph.nodes[label].df, new)
    graph = graph.with_nodes(label, table)
    graph.check([label])
    rows = _without(replace(rows, df=df), variable)
    df = rows.df.drop("row#").withColumnRenamed("made#", f"{variable}$id").withColumn(f"{variable}$label", F.lit(label))
    types = {f.name: f.dataType for f in table.schema.fields}
    df = df.withColumns({f"{variable}${c}": _as(F.col(f"new${c}"), rows.df.schema[f"new${c}"].dataType, types[c]) if c in made else F.lit(None).cast(types[c]) for c in graph.nodes[label].properties}).drop(*[f"new${k}" for k in made])
    return rows.bind(df, variable, Bound(NODE, label, tuple(graph.nodes[label].properties)), graph)


def create_edge(rows: Rows, start: str, type_: str, end: str, properties: dict, edge: str | None) -> Rows:
    from weftgraph.plans.rows import EDGE, Bound

    for x in dict.fromkeys((start, end)):
        if x not in rows.bound:
            rows = create_node(rows, x, "", {})
    made = _evaluated(rows, properties)
    src, dst = rows.bound[start].label, rows.bound[end].label
    have = next((e for e in rows.graph.edges if (e.type, e.src, e.dst) == (type_, src, dst) and e.df is not None), None)
    first = next_id([e for e in rows.graph.edges if e.type == type_ and e.df is not None])
    df = numbered(rows.df.withColumns({f"new${k}": c for k, c in made.items()}) if made else rows.df)
    df = df.withColumn("made#", F.lit(first) + F.col("row#")).drop("row#")
    new = df.select(F.col("made#").alias("id"), F.col(f"{start}$id").alias("src"), F.col(f"{end}$id").alias("dst"), *[F.col(f"new${k}").alias(k) for k in made])
    base = have.df if have else new.limit(0)
    graph = rows.graph.with_edges(type_, _appended(base, new), src, dst)
    if edge:
        rows = _without(replace(rows, df=df), edge)
        df = rows.df.withColumns({f"{edge}$id": F.col("made#"), f"{edge}$type": F.lit(type_), f"{edge}$src": F.col(f"{start}$id"), f"{edge}$dst": F.col(f"{end}$id"), **{f"{edge}${k}": F.col(f"new${k}") for k in made}})
        rows = rows.bind(df, edge, Bound(EDGE, type_, tuple(made)), graph)
    return replace(rows, df=df.drop("made#", *[f"new${k}" for k in made]), graph=graph, started=True)


def merge_node(rows: Rows, variable: str, label: str, properties: dict) -> Rows:
    from weftgraph.plans.rows import NODE, Bound

    made = _evaluated(rows, properties)
    rows = _without(replace(rows, df=rows.df.withColumns({f"new${k}": c for k, c in made.items()})), variable)
    graph, first = _next_node(rows.graph, label)
    table = graph.nodes[label]
    names = [f"new${k}" for k in made]
    # what is written are the distinct values that the rows ask for, never the rows
    wanted = numbered(rows.df.select(*names).distinct())
    types = {f.name: f.dataType for f in table.df.schema.fields}
    asked = {k: kind(wanted.schema[f"new${k}"].dataType) for k in made}
    fits = all(k in types and (kind(types[k]) == asked[k] or TAGGED in (kind(types[k]), asked[k])) for k in made)
    if fits:
        old = table.df.select("id", *[F.col(k).alias(f"old${k}") for k in made])
        same = reduce(lambda a, b: a & b, [equal(F.col(f"new${k}"), asked[k], F.col(f"old${k}"), kind(types[k])) for k in made], F.lit(True))
        found = wanted.join(old, same).groupBy("row#").agg(F.min("id").alias("found"))
        keyed = wanted.join(found, "row#", "left")
    else:
        keyed = wanted.withColumn("found", F.lit(None).cast("long"))
    keyed = checkpointed(keyed.withColumn("to$id", F.coalesce("found", F.lit(first) + F.col("row#"))))
    new = keyed.where("found is null").select(F.col("to$id").alias("id"), *[F.col(f"new${k}").alias(k) for k in made])
    graph = graph.with_nodes(label, _appended(table.df, new))
    graph.check([label])
    again = keyed.select(F.col("to$id").alias(f"{variable}$id"), *[F.col(n).alias(f"m{n}") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"m{n}")) for n in names], F.lit(True))
    df = rows.df.join(again, same).drop(*[f"m{n}" for n in names])
    table = graph.nodes[label]
    if {*table.properties} <= {*made}:  # all that the nodes have is known
        types = {f.name: f.dataType for f in table.df.schema.fields}
        have = {f.name: f.dataType for f in df.schema.fields}
        df = df.withColumns({f"{variable}$label": F.lit(label), **{f"{variable}${k}": _as(F.col(f"new${k}"), have[f"new${k}"], types[k]) for k in table.properties}})
        return rows.bind(df.drop(*names), variable, Bound(NODE, label, tuple(table.properties)), graph)
    return _fetched(rows, variable, label, graph, df.drop(*names))


def set_property(rows: Rows, variable: str, key: str, value) -> Rows:
    from weftgraph.plans.rows import NODE, Bound

    if variable not in rows.bound:
        raise PlanError(f"unknown variable {variable!r}")
    of = rows.bound[variable]
    if of.label is None:
        raise PlanError(f"{variable!r} has no one label or type: bind it with one to set its properties")
    new = _evaluated(rows, {key: value})[key]
    order = [F.col(f"{x}$id") if b.kind == NODE else -F.col(f"{x}$id") for x, b in rows.bound.items()]
    last = checkpointed(rows.df.select(F.col(f"{variable}$id").alias("set$id"), new.alias("set$value"), F.struct(*order).alias("set$at")).groupBy("set$id").agg(F.max_by("set$value", "set$at").alias("set$value")))

    def written(df: DataFrame, id_: str, column: str) -> DataFrame:
        t = last.schema["set$value"].dataType
        have = df.schema[column].dataType if column in df.columns else None
        old, new_ = F.col(column) if have else F.lit(None), F.col("set$value")
        if have is None:
            old, new_ = old.cast(t if not isinstance(t, T.NullType) else "string"), new_.cast(t if not isinstance(t, T.NullType) else "string")
        elif kind(have) != kind(t) and not isinstance(t, T.NullType):  # another type: the property now holds both
            old, new_ = tagged(old, kind(have)), tagged(new_, kind(t))
        else:
            new_ = _as(new_, t, have)
        joined = df.join(last, F.col(id_) == F.col("set$id"), "left")
        return joined.withColumn(column, F.when(F.col("set$id").isNotNull(), new_).otherwise(old)).drop("set$id", "set$value")

    graph = rows.graph
    if of.kind == NODE:
        graph = graph.with_nodes(of.label, written(graph.table(of.label).df, "id", key))
        graph.check([of.label])
    else:
        tables = [e for e in graph.edges if e.type == of.label]
        if any(e.df is None for e in tables):
            raise PlanError(f"edges of {of.label!r} are a node's key and have no properties")
        for e in tables:
            graph = graph.with_edges(e.type, written(e.df, "id", key), e.src, e.dst)
    # every variable that may stand for the written entity reads the new value
    for x, b in rows.bound.items():
        if b.kind == of.kind and b.label in (of.label, None):
            df = written(rows.df, f"{x}$id", f"{x}${key}")
            rows = rows.bind(df, x, Bound(b.kind, b.label, tuple(dict.fromkeys((*b.properties, key)))))
    return replace(rows, graph=graph)


def delete(rows: Rows, variables: tuple[str, ...], detach: bool) -> Rows:
    from weftgraph.plans.rows import EDGE, NODE

    for x in variables:
        if x not in rows.bound:
            raise PlanError(f"unknown variable {x!r}")
    graph = rows.graph
    edges, nodes = ([x for x in dict.fromkeys(variables) if rows.bound[x].kind == k] for k in (EDGE, NODE))
    if edges:
        types = {rows.bound[x].label for x in edges}
        gone = checkpointed(reduce(DataFrame.union, [rows.df.select(F.col(f"{x}$id").alias("gone"), F.col(f"{x}$type").alias("type")) for x in edges]).distinct())
        for e in graph.edges:
            if e.type in types or None in types:
                own = gone.where(F.col("type") == e.type).select("gone")
                graph = _edges_without(graph, e, lambda d, own=own: d.join(own, d["id"] == own["gone"], "left_anti"), lambda h, own=own: h.join(own.withColumn("hit", F.lit(True)), F.col("id") == F.col("gone"), "left").drop("gone"))
    if nodes:
        labels = {rows.bound[x].label for x in nodes}
        among = lambda label: label is None or label in labels or None in labels
        gone = checkpointed(reduce(DataFrame.union, [rows.df.select(F.col(f"{x}$id").alias("gone")) for x in nodes]).distinct())
        near = [e for e in graph.edges if among(e.src) or among(e.dst)]
        if not detach and near:
            ends = reduce(DataFrame.union, [graph.edge_frame(e).select(F.explode(F.array("src", "dst")).alias("gone")) for e in near])
            if gone.join(ends, "gone", "left_semi").take(1):
                raise ConstraintError("a node that still has edges cannot be deleted: detach it")
        for e in near if detach else ():

            def kept(d: DataFrame, e: EdgeTable = e) -> DataFrame:
                for end, label in (("src", e.src), ("dst", e.dst)):
                    d = d.join(gone, d[end] == gone["gone"], "left_anti") if among(label) else d
                return d

            if e.df is not None:
                graph = _edges_without(graph, e, kept, None)
            elif among(other := e.dst if e.holder == "src" else e.src):  # a removed holder takes its key along
                offset = graph.table(other).number << KEY_BITS
                graph = _edges_without(graph, e, None, lambda h, e=e, offset=offset: h.join(gone.withColumn("hit", F.lit(True)), F.col(e.key) + F.lit(offset) == F.col("gone"), "left").drop("gone"))
        for label, table in graph.nodes.items():
            if among(label):
                graph = graph.with_nodes(label, table.df.join(gone, table.df["id"] == gone["gone"], "left_anti"), given=True)
    return replace(rows, graph=graph, df=rows.df.where(F.lit(False)))


def _edges_without(graph: Graph, e: EdgeTable, kept, hit) -> Graph:
    """The graph without some edges of a table: rows go, or a holder's key becomes null."""
    if e.df is not None:
        return graph.with_edges(e.type, kept(e.df), e.src, e.dst, given=True)
    label = e.src if e.holder == "src" else e.dst
    table = graph.table(label)
    marked = hit(table.df)
    return graph.with_nodes(label, marked.withColumn(e.key, F.when(F.col("hit").isNull(), F.col(e.key))).select(*table.df.columns))
