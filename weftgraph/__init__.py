"""Property-graph queries and training-data operators on Spark DataFrames."""

from weftgraph.errors import ConstraintError, GraphError, PlanError, StorageError
from weftgraph.functions.expressions import p, v
from weftgraph.plans.result import Result
from weftgraph.plans.rows import Rows
from weftgraph.sources.graph import Graph
from weftgraph.sources.store import load, save
from weftgraph.sources.tables import sales_graph

__all__ = ["ConstraintError", "Graph", "GraphError", "PlanError", "Result", "Rows", "StorageError", "load", "p", "sales_graph", "save", "v"]
