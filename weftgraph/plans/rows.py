"""A pipeline of pattern steps: each takes rows of bound variables to rows of bound variables.

A bound variable ``n`` has columns ``n$id``, ``n$label`` (or ``n$type``, ``n$src``, ``n$dst``)
and ``n$key`` for each property. Steps are lazy DataFrame operations; Catalyst prunes what
no later step reads. Steps that change the graph return rows with the changed graph in
``.graph``; what they number is checkpointed first, so that ids are given once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.errors import PlanError
from weftgraph.functions.expressions import Entity, Expression, as_expression
from weftgraph.functions.values import TAGGED, kind, plain_order
from weftgraph.operators import expand, mutate
from weftgraph.plans.result import Result
from weftgraph.sources.graph import UNLABELLED, Graph

NODE, EDGE = "node", "edge"
FIXED = {NODE: ("id", "label"), EDGE: ("id", "type", "src", "dst")}


@dataclass(frozen=True)
class Bound:
    """What a variable is bound to; ``label`` is the label or type where all rows share one."""

    kind: str
    label: str | None
    properties: tuple[str, ...]


@dataclass(frozen=True)
class Rows:
    graph: Graph
    df: DataFrame
    bound: dict[str, Bound] = field(default_factory=dict)
    started: bool = True

    @staticmethod
    def unit(graph: Graph) -> Rows:
        return Rows(graph, graph.spark.range(1).select(), {}, started=False)

    # ---- reading columns ----

    def scope(self, variable: str, key: str | None) -> tuple[Column, T.DataType]:
        if variable not in self.bound:
            raise PlanError(f"unknown variable {variable!r}")
        of = self.bound[variable]
        if key is None:
            fields = [F.col(f"{variable}${c}").alias(c) for c in FIXED[of.kind]]
            inner = [F.col(f"{variable}${c}").alias(c) for c in of.properties]
            whole = F.struct(*fields, (F.struct(*inner) if inner else F.create_map().cast("map<string,string>")).alias("properties"))
            return whole, T.StructType()
        name = f"{variable}${key}"
        if key in of.properties or key in FIXED[of.kind]:
            return F.col(name), self.df.schema[name].dataType
        return F.lit(None), T.NullType()

    def bind(self, df: DataFrame, variable: str, bound: Bound, graph: Graph | None = None) -> Rows:
        return replace(self, df=df, bound={**self.bound, variable: bound}, graph=graph or self.graph, started=True)

    def conditions(self, variable: str, where: dict | None) -> list[Expression]:
        from weftgraph.functions.expressions import Property

        return [Property(variable, k) == as_expression(x) for k, x in (where or {}).items()]

    # ---- patterns ----

    def match(self, variable: str, label: str | None = None, where: dict | None = None, on: Expression | None = None) -> Rows:
        """Binds ``variable`` to every node of ``label`` for each row, or tests it if it is bound.

        ``on`` joins by a condition with variables bound before; without it, and without a later
        ``filter`` that relates the two, every row meets every node.
        """
        if variable in self.bound:
            of = self.bound[variable]
            if of.kind == EDGE:
                return replace(self, df=self.df.where(F.lit(False)))
            out = self if label is None or of.label == label else replace(self, df=self.df.where(F.col(f"{variable}$label") == label))
            return out.filter(*self.conditions(variable, where))
        scan = self.graph.scan_nodes(label)
        found = Rows(self.graph, prefixed(scan, variable), {variable: Bound(NODE, label, tuple(c for c in scan.columns if c not in FIXED[NODE]))})
        literal = [c for c in found.conditions(variable, where) if not isinstance(c.right, Expression) or not _variables(c.right)]
        late = [c for c in found.conditions(variable, where) if _variables(c.right)]
        found = found.filter(*literal)
        if not self.started:
            out = replace(self, df=found.df, bound={**self.bound, **found.bound}, started=True)
        elif on is None:
            out = self.bind(self.df.crossJoin(found.df), variable, found.bound[variable])
        else:
            both = replace(self, df=self.df.crossJoin(found.df), bound={**self.bound, **found.bound})
            out = self.bind(self.df.join(found.df, on.condition(both.scope)), variable, found.bound[variable])
        return out.filter(*late)

    def expand(self, start: str, to: str, type: str | None = None, direction: str = "out", label: str | None = None, edge: str | None = None, where: dict | None = None, edge_where: dict | None = None, fetch: bool = True) -> Rows:
        """One hop from a bound node along edges of ``type``: binds ``to``, and ``edge`` if named, or tests them if bound.

        ``direction`` is out, in or both. Without ``fetch`` the target's properties stay unread
        and, where the edges imply its label, its table too.
        """
        return expand.hop(self, start, to, type, direction, label, edge, where, edge_where, fetch)

    def filter(self, *conditions: Expression) -> Rows:
        """Keeps rows for which each condition is exactly true."""
        df = self.df
        for c in conditions:
            df = df.where(as_expression(c).condition(self.scope))
        return replace(self, df=df)

    # ---- results ----

    def returns(self, *items, order_by: list | tuple = (), skip: int | None = None, limit: int | None = None) -> Result:
        """Projects ``items`` (expressions, values, or (item, name) pairs), after ordering the rows.

        Order items are expressions or (expression, "desc") pairs over the bound variables; a
        missing value is the smallest. A slice of rows without a full order is made definite by
        the order of nested loops: older nodes first, newer edges first.
        """
        df = self.df
        keys = []
        for item in order_by:
            expression, way = item if isinstance(item, tuple) else (item, "asc")
            c, t = as_expression(expression).column(self.scope)
            c = plain_order(c) if kind(t) == TAGGED else c
            keys.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_first())
        if skip is not None or limit is not None:
            keys += [F.col(f"{x}$id").asc() if b.kind == NODE else F.col(f"{x}$id").desc() for x, b in self.bound.items()]
        if keys:
            df = df.orderBy(*keys)
        df = df.offset(skip) if skip else df
        df = df.limit(limit) if limit is not None else df
        named = [(as_expression(i[0]), i[1]) if isinstance(i, tuple) else (as_expression(i), None) for i in items]
        columns = [name or e.name for e, name in named]
        picked = df.select(*[e.column(self.scope)[0].alias(f"c{i}") for i, (e, _) in enumerate(named)])
        return Result(picked.toDF(*columns), columns, self.graph)

    # ---- changes ----

    def create_node(self, variable: str, label: str = UNLABELLED, properties: dict | None = None) -> Rows:
        """One new node for each row, bound to ``variable`` (anew, if it is bound)."""
        return mutate.create_node(self, variable, label, properties or {})

    def create_edge(self, start: str, type: str, end: str, properties: dict | None = None, edge: str | None = None) -> Rows:
        """One new edge for each row; ends that are not bound become new unlabelled nodes."""
        return mutate.create_edge(self, start, type, end, properties or {}, edge)

    def merge_node(self, variable: str, label: str = UNLABELLED, properties: dict | None = None) -> Rows:
        """Binds the oldest node of ``label`` with equal properties, creating it where there is none."""
        return mutate.merge_node(self, variable, label, properties or {})

    def set(self, variable: str, key: str, value) -> Rows:
        """Writes a property; of several rows that write one entity the last wins."""
        return mutate.set_property(self, variable, key, value)

    def delete(self, *variables: str, detach: bool = False) -> Rows:
        """Removes the bound entities, with ``detach`` also the edges of removed nodes; no rows remain."""
        return mutate.delete(self, variables, detach)


def prefixed(df: DataFrame, variable: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{variable}${c}") for c in df.columns])


def _variables(e: object) -> set[str]:
    if isinstance(e, Entity) or hasattr(e, "variable"):
        return {e.variable}
    return set().union(*[_variables(x) for x in vars(e).values() if isinstance(x, Expression)]) if isinstance(e, Expression) else set()
