"""Pattern steps over a stream: each arriving row finds its node and goes on from there.

The graph's tables are the static side of stream-static joins, so a hop keeps no state.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.rows import NODE, Bound, Rows
from weftgraph.sources.graph import Graph


def arriving(graph: Graph, stream: DataFrame, variable: str, label: str, key: str) -> Rows:
    """Rows that bind ``variable`` to the node of ``label`` that column ``key`` numbers, with the stream's columns as its properties."""
    own = [c for c in stream.columns]
    df = stream.select(graph.node_id(label, key).alias(f"{variable}$id"), F.lit(label).alias(f"{variable}$label"), *[F.col(c).alias(f"{variable}${c}") for c in own])
    return replace(Rows.unit(graph), df=df, bound={variable: Bound(NODE, label, tuple(own))}, started=True)
