"""A property graph as a catalog of DataFrames: one per node label and one per edge type.

Graphs are values: whatever changes one returns another, and the unchanged tables are shared.
Node tables have ``id`` and a column per property; edge tables have ``id``, ``src``, ``dst``
and properties. A label's ids share its number in the high bits, so that ids are unique
across labels. An edge that is a foreign key of a node table has no table of its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.errors import ConstraintError, PlanError
from weftgraph.functions.values import unified

#: Keys of one label's nodes lie below 2**KEY_BITS.
KEY_BITS = 48
UNLABELLED = ""


@dataclass(frozen=True)
class NodeTable:
    """``floor`` and the ids in ``past`` keep an id from being given again after its node is gone."""

    label: str
    number: int
    df: DataFrame
    floor: int = 0
    past: tuple[DataFrame, ...] = ()

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c != "id"]


@dataclass(frozen=True)
class EdgeTable:
    """``holder`` is the end whose node table has the other end's key in column ``key``, for foreign keys; else ``df`` holds the edges."""

    type: str
    src: str | None
    dst: str | None
    df: DataFrame | None = None
    holder: str | None = None
    key: str | None = None
    floor: int = 0
    past: tuple[DataFrame, ...] = ()

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "src", "dst")] if self.df is not None else []


def next_id(tables: list[NodeTable] | list[EdgeTable]) -> int:
    """The least id above all that these tables have ever held."""
    ids = [df.select("id") for t in tables for df in ((t.df,) if t.df is not None else ()) + t.past]
    most = reduce(DataFrame.union, ids).agg(F.max("id")).first()[0] if ids else None
    return max([t.floor for t in tables] + [0 if most is None else most + 1])


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: tuple[EdgeTable, ...] = ()
    unique: frozenset[tuple[str, str]] = frozenset()
    clustered: frozenset[tuple[str, str]] = frozenset()

    # ---- tables ----

    def with_nodes(self, label: str, df: DataFrame, key: str | None = None, given: bool = False) -> Graph:
        """Adds or replaces a label's table; ``key`` names the column that numbers its nodes, ``given`` keeps the ids of the old one from being given again."""
        number = self.nodes[label].number if label in self.nodes else 1 + max((t.number for t in self.nodes.values()), default=0)
        df = _widened(df)
        if key is not None:
            df = df.withColumn("id", F.col(key) + F.lit(number << KEY_BITS))
        if "id" not in df.columns:
            raise PlanError(f"nodes of {label!r} need an id column or a key")
        old = self.nodes.get(label)
        floor, past = (old.floor, old.past + ((old.df.select("id"),) if given else ())) if old else (0, ())
        return replace(self, nodes={**self.nodes, label: NodeTable(label, number, df, floor, past)})

    def node_id(self, label: str, key: str) -> Column:
        """The id of the node of ``label`` that ``key`` numbers."""
        return F.col(key) + F.lit(self.table(label).number << KEY_BITS)

    def with_edges(self, type: str, df: DataFrame, src: str | None = None, dst: str | None = None, given: bool = False) -> Graph:
        """Adds edges of one type between two labels, or any; replaces those of the same type and labels; ``given`` as in ``with_nodes``."""
        df = _widened(df)
        if missing := {"id", "src", "dst"} - {*df.columns}:
            raise PlanError(f"edges of {type!r} need columns {sorted(missing)}")
        rest = tuple(e for e in self.edges if (e.type, e.src, e.dst) != (type, src, dst))
        old = next((e for e in self.edges if (e.type, e.src, e.dst) == (type, src, dst)), None)
        floor, past = (old.floor, old.past + ((old.df.select("id"),) if given and old.df is not None else ())) if old else (0, ())
        return replace(self, edges=(*rest, EdgeTable(type, src, dst, df, None, None, floor, past)))

    def with_key_edges(self, type: str, src: str, dst: str, holder: str, key: str) -> Graph:
        """Adds edges that column ``key`` of one end's node table implies."""
        if holder not in ("src", "dst"):
            raise PlanError("holder is src or dst")
        return replace(self, edges=(*self.edges, EdgeTable(type, src, dst, None, holder, key)))

    def table(self, label: str) -> NodeTable:
        if label not in self.nodes:
            raise PlanError(f"unknown label {label!r}")
        return self.nodes[label]

    def scan_nodes(self, label: str | None = None) -> DataFrame:
        """Nodes of a label, or all with a ``label`` column; an unknown label has none."""
        if label is not None:
            found = self.nodes.get(label)
            return (found.df if found else self._empty("id long")).withColumn("label", F.lit(label))
        return self.scan_labels(self.nodes)

    def scan_labels(self, labels: Iterable[str]) -> DataFrame:
        """Nodes of several labels, with a ``label`` column."""
        tables = [self.scan_nodes(x) for x in labels]
        if not tables:
            return self._empty("id long, label string")
        tables = unified(tables)
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return out

    def node(self, ids: DataFrame, label: str | None = None) -> DataFrame:
        """The nodes whose ids are in column ``id``, of a label or any, with a ``label`` column."""
        return self.scan_nodes(label).join(ids.select("id"), "id", "left_semi")

    def edge(self, ids: DataFrame, type: str) -> DataFrame:
        """The edges of a type whose ids are in column ``id``."""
        return self.scan_edges(type).join(ids.select("id"), "id", "left_semi")

    def properties(self, ids: DataFrame, label: str) -> DataFrame:
        """(id, key, value) of what the nodes of a label store, values as text."""
        found, keys = self.node(ids, label), self.table(label).properties
        text = lambda k: F.to_json(k) if isinstance(found.schema[k].dataType, T.StructType) else F.col(k).cast("string")
        told = F.array(*[F.struct(F.lit(k).alias("key"), text(k).alias("value")) for k in keys])
        return found.select("id", F.explode(told).alias("x")).select("id", "x.key", "x.value").where("value is not null")

    def edge_frame(self, edge: EdgeTable) -> DataFrame:
        """An edge table's (id, src, dst, properties), made from the holder's table for foreign keys."""
        if edge.df is not None:
            return edge.df
        holder, other = (edge.src, edge.dst) if edge.holder == "src" else (edge.dst, edge.src)
        own = self.table(holder)
        there = F.col(edge.key) + F.lit(self.table(other).number << KEY_BITS)
        ends = {edge.holder: F.col("id"), "dst" if edge.holder == "src" else "src": there}
        return own.df.where(F.col(edge.key).isNotNull()).select("id", ends["src"].alias("src"), ends["dst"].alias("dst"))

    def scan_edges(self, type: str | None = None) -> DataFrame:
        """Edges of a type, or all, with a ``type`` column."""
        tables = unified([self.edge_frame(e).withColumn("type", F.lit(e.type)) for e in self.edges if type in (None, e.type)])
        if not tables:
            return self._empty("id long, src long, dst long, type string")
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return out

    def neighbours(self, ids: DataFrame, type: str | None = None, direction: str = "both") -> DataFrame:
        """(id, neighbour, type) of the nodes in column ``id``."""
        edges = self.scan_edges(type).select("src", "dst", "type")
        ways = {"out": edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "type"), "in": edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "type")}
        if direction == "both":
            turned = edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "type")
            return ids.select("id").join(ways["out"].union(turned), "id")
        return ids.select("id").join(ways[direction], "id")

    def has_edges(self, ids: DataFrame, label: str | None = None) -> DataFrame:
        """The nodes in column ``id`` that have an edge; only edges that can touch ``label`` are read, if all are of one.

        Each task first drops repeated ends, so that what meets grows with the nodes, not with their edges.
        """
        ends = [self.edge_frame(e).select(F.col(end).alias("id")) for e in self.edges for end, of in (("src", e.src), ("dst", e.dst)) if label is None or of in (None, label)]
        there = reduce(DataFrame.union, ends).distinct() if ends else self._empty("id long")
        return ids.select("id").join(there, "id", "left_semi")

    def degrees(self, type: str | None = None, direction: str = "both") -> DataFrame:
        """(id, n): how many edges of a type, or any, each node has in a direction; a loop is one, and nodes without edges are left out."""
        edges = self.scan_edges(type).select("src", "dst")
        ways = {"out": edges.select(F.col("src").alias("id")), "in": edges.select(F.col("dst").alias("id"))}
        ends = ways["out"].union(edges.where("src <> dst").select(F.col("dst").alias("id"))) if direction == "both" else ways[direction]
        return ends.where("id is not null").groupBy("id").agg(F.count("*").alias("n"))

    def labels(self) -> list[str]:
        return sorted(x for x in self.nodes if x != UNLABELLED)

    def edge_types(self) -> list[str]:
        return sorted({e.type for e in self.edges})

    def property_keys(self) -> list[str]:
        return sorted({c for t in self.nodes.values() for c in t.properties} | {c for e in self.edges for c in e.properties})

    # ---- constraints and layout ----

    def duplicates(self, label: str, key: str) -> DataFrame:
        """Values of a property that several nodes have, with their number; a missing value is one if it is stored as null."""
        return self.table(label).df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")

    def with_unique(self, label: str, key: str) -> Graph:
        """Demands that a property be unique; fails if it is not. Asking again changes nothing."""
        if (label, key) in self.unique:
            return self
        made = replace(self, unique=self.unique | {(label, key)})
        made.check([label])
        return made

    def has_unique(self, label: str, key: str) -> bool:
        return (label, key) in self.unique

    def check(self, labels: list[str] | None = None) -> None:
        """Raises if a unique property is not unique."""
        for label, key in sorted(self.unique):
            if (labels is None or label in labels) and label in self.nodes and key in self.nodes[label].df.columns and (found := self.duplicates(label, key).take(1)):
                raise ConstraintError(f"{label}.{key} is unique, but several nodes have {found[0][key]!r}")

    def cluster_by(self, label: str, key: str) -> Graph:
        """A hint to lay a table out by a property when it is written; results never depend on it."""
        return replace(self, clustered=self.clustered | {(label, key)})

    def indexes(self) -> list[tuple[str, str, str]]:
        return sorted([("unique", *x) for x in self.unique] + [("clustered", *x) for x in self.clustered])

    def match(self, variable: str, label: str | None = None, where: dict | None = None):
        """Starts a pattern: every node of ``label`` (any, if None) whose properties equal ``where``."""
        from weftgraph.plans.rows import Rows

        return Rows.unit(self).match(variable, label, where)

    def unit(self):
        """The pipeline's start: one row that binds nothing."""
        from weftgraph.plans.rows import Rows

        return Rows.unit(self)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)


def _widened(df: DataFrame) -> DataFrame:
    """Whole numbers as longs and floating ones as doubles, the two number types of properties."""
    small = {f.name: "double" if isinstance(f.dataType, T.FloatType) else "long" for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType))}
    return df.withColumns({n: F.col(n).cast(t) for n, t in small.items()}) if small else df
