"""Hops along edges, as equi-joins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import PlanError
from weftgraph.functions.values import unified
from weftgraph.sources.graph import KEY_BITS, EdgeTable

if TYPE_CHECKING:
    from weftgraph.plans.rows import Rows

#: Columns of a hop's two ends, until it has arrived.
ENDS = ("near$id", "far$id", "far$label")
WAYS = {"out": (("src", "dst"),), "in": (("dst", "src"),), "both": (("src", "dst"), ("dst", "src"))}


@dataclass(frozen=True)
class Way:
    """An edge table walked from its end ``near`` to its end ``far``."""

    edge: EdgeTable
    near: str
    far: str

    @property
    def near_label(self) -> str | None:
        return self.edge.src if self.near == "src" else self.edge.dst

    @property
    def far_label(self) -> str | None:
        return self.edge.src if self.far == "src" else self.edge.dst


def ways(rows: Rows, start: str, type_: str | None, direction: str, label: str | None) -> list[Way]:
    """The edge tables and directions that can lead from the start's label to the wanted one."""
    if direction not in WAYS:
        raise PlanError(f"direction is out, in or both, not {direction!r}")
    fits = lambda want, have: want is None or have is None or want == have
    found = [Way(e, near, far) for e in rows.graph.edges if type_ in (None, e.type) for near, far in WAYS[direction]]
    return [w for w in found if fits(rows.bound[start].label, w.near_label) and fits(label, w.far_label)]


def hop(rows: Rows, start: str, to: str, type_: str | None, direction: str, label: str | None, edge: str | None, where: dict | None, edge_where: dict | None, fetch: bool) -> Rows:
    from weftgraph.plans.rows import EDGE, NODE, Bound

    if start not in rows.bound or rows.bound[start].kind != NODE:
        raise PlanError(f"a hop starts from a bound node, not {start!r}")
    walked = ways(rows, start, type_, direction, label)
    if len(walked) == 1 and walked[0].edge.df is None and edge not in rows.bound and not edge_where:
        out = _by_key(rows, start, to, walked[0], edge, fetch)
        if out is not None:
            return _tested(out, to, label, where)
    name = edge or f"_{len(rows.bound)}"
    edges = _edges(rows, walked, name)
    df = rows.df.join(edges, F.col(f"{start}$id") == F.col("near$id"))
    if name in rows.bound:  # the same edge again
        df = df.where((F.col("edge$id") == F.col(f"{name}$id")) & (F.col("edge$type") == F.col(f"{name}$type"))) if rows.bound[name].kind == EDGE else df.where(F.lit(False))
        df = df.drop(*[c for c in edges.columns if c not in ENDS])
        out = rows.bind(df, name, rows.bound[name])
    else:
        fixed = ("id", "type", "src", "dst")
        properties = tuple(c.removeprefix("edge$") for c in edges.columns if c.startswith("edge$") and c.removeprefix("edge$") not in fixed)
        df = df.withColumnsRenamed({c: f"{name}${c.removeprefix('edge$')}" for c in edges.columns if c.startswith("edge$")})
        out = rows.bind(df, name, Bound(EDGE, type_, properties))
    out = out.filter(*out.conditions(name, edge_where))
    labels = {w.far_label for w in walked}
    return _tested(_arrived(out, to, label, labels, fetch), to, label, where, drop=None if edge else name)


def _edges(rows: Rows, walked: list[Way], name: str) -> DataFrame:
    """All the walked edges with their near and far ends; a loop is walked once."""
    frames = []
    for w in walked:
        e = rows.graph.edge_frame(w.edge)
        if w.near == "dst" and any(x.edge is w.edge and x.near == "src" for x in walked):
            e = e.where("src <> dst")
        frames.append(e.select(F.col(w.near).alias("near$id"), F.col(w.far).alias("far$id"), F.lit(w.far_label).cast("string").alias("far$label"), F.lit(w.edge.type).alias("edge$type"), *[F.col(c).alias(f"edge${c}") for c in e.columns]))
    if not frames:
        return rows.graph.spark.createDataFrame([], "`near$id` long, `far$id` long, `far$label` string, `edge$type` string, `edge$id` long, `edge$src` long, `edge$dst` long")
    frames = unified(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _by_key(rows: Rows, start: str, to: str, w: Way, edge: str | None, fetch: bool) -> Rows | None:
    """A hop along a foreign key needs no edge table: none at all from the holder, one join to it."""
    from weftgraph.plans.rows import EDGE, Bound, prefixed

    graph, key = rows.graph, w.edge.key
    if w.edge.holder == w.near:
        if key not in rows.bound[start].properties:
            return None
        df = rows.df.where(F.col(f"{start}${key}").isNotNull()).withColumn("far$id", F.col(f"{start}${key}") + F.lit(graph.table(w.far_label).number << KEY_BITS))
        holder, out = start, rows.bind(df, start, rows.bound[start])
        out = _arrived(out, to, w.far_label, {w.far_label}, fetch)
    else:
        if to in rows.bound:
            return None
        held = graph.scan_nodes(w.far_label)
        there = F.col(key) + F.lit(graph.table(w.near_label).number << KEY_BITS)
        held = prefixed(held.withColumn("near", there), to).where(F.col(f"{to}$near").isNotNull())
        df = rows.df.join(held, F.col(f"{start}$id") == F.col(f"{to}$near")).drop(f"{to}$near")
        holder, out = to, rows.bind(df, to, Bound("node", w.far_label, tuple(graph.table(w.far_label).properties)))
    if edge:
        ends = {w.near: F.col(f"{start}$id"), w.far: F.col(f"{to}$id")}
        df = out.df.withColumns({f"{edge}$id": F.col(f"{holder}$id"), f"{edge}$type": F.lit(w.edge.type), f"{edge}$src": ends["src"], f"{edge}$dst": ends["dst"]})
        out = out.bind(df, edge, Bound(EDGE, w.edge.type, ()))
    return out


def _arrived(rows: Rows, to: str, label: str | None, labels: set[str | None], fetch: bool) -> Rows:
    """Binds the far end, or tests it against what is bound; ``labels`` are those that the walked edges lead to, None for any."""
    from weftgraph.plans.rows import NODE, Bound, prefixed

    ends = [c for c in ENDS if c in rows.df.columns]
    if to in rows.bound:
        same = F.col("far$id") == F.col(f"{to}$id") if rows.bound[to].kind == NODE else F.lit(False)
        return rows.bind(rows.df.where(same).drop(*ends), to, rows.bound[to])
    one = next(iter(labels)) if len(labels) == 1 else None
    if not fetch and labels and None not in labels:  # edges that tell the label need no node table
        df = rows.df.withColumn(f"{to}$id", F.col("far$id")).withColumn(f"{to}$label", F.lit(one) if one else F.col("far$label"))
        return rows.bind(df.drop(*ends), to, Bound(NODE, one, ()))
    label = one or label
    nodes = rows.graph.scan_nodes(label) if label is not None or not labels or None in labels else rows.graph.scan_labels(sorted(labels))
    if not fetch:
        nodes = nodes.select("id", "label")
    df = rows.df.join(prefixed(nodes, to), F.col("far$id") == F.col(f"{to}$id")).drop(*ends)
    return rows.bind(df, to, Bound(NODE, label, tuple(c for c in nodes.columns if c not in ("id", "label"))))


def _tested(rows: Rows, to: str, label: str | None, where: dict | None, drop: str | None = None) -> Rows:
    if label is not None and rows.bound[to].label != label:
        rows = rows.bind(rows.df.where(F.col(f"{to}$label") == label), to, rows.bound[to])
    out = rows.filter(*rows.conditions(to, where))
    if drop:  # an edge that nobody named
        from dataclasses import replace

        out = replace(out, df=out.df.drop(*[c for c in out.df.columns if c.startswith(f"{drop}$")]), bound={k: b for k, b in out.bound.items() if k != drop})
    return out
