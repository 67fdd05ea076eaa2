"""The sales, events and document tables of a folder as one graph.

Keys that point to another table are edges without a table of their own; order lines are
edges with properties from orders to parts and from suppliers to parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.graph import Graph

NODES = {
    "Region": ("region", "r_", "regionkey"), "Nation": ("nation", "n_", "nationkey"), "Customer": ("customer", "c_", "custkey"), "Supplier": ("supplier", "s_", "suppkey"),
    "Part": ("part", "p_", "partkey"), "Order": ("orders", "o_", "orderkey"), "Event": ("events", "", "event_id"),
}
KEY_EDGES = (("IN_REGION", "Nation", "Region", "src", "regionkey"), ("IN_NATION", "Customer", "Nation", "src", "nationkey"), ("BASED_IN", "Supplier", "Nation", "src", "nationkey"), ("PLACED", "Customer", "Order", "dst", "custkey"))
#: Rows of a file have numbers below 2**ROW_BITS.
ROW_BITS = 36
#: What separates a file's scheme from its path.
SLASHES = ":/+"
#: Up to so many files, their names (some 200 bytes each) are sent to every task.
SENT_FILES = 50_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered_rows(df: DataFrame) -> DataFrame:
    """``df``, just read from Parquet, with an ``id`` from each row's file and place in it: no shuffle, and the same each time."""
    files = sorted(df.inputFiles())
    placed = df.select("*", F.col("_metadata.row_index").alias("row#"), F.col("_metadata.file_path").alias("file#"))
    if len(files) <= 1:
        return placed.withColumn("id", F.col("row#")).drop("row#", "file#")
    # one file system's name of a file may differ from another's in the slashes behind the scheme
    of = df.sparkSession.createDataFrame([(re.sub(SLASHES, ":/", f), i << ROW_BITS) for i, f in enumerate(files)], "`file#` string, `first#` long")
    of = F.broadcast(of) if len(files) <= SENT_FILES else of
    known = placed.withColumn("file#", F.regexp_replace("file#", SLASHES, ":/")).join(of, "file#", "left")
    first = F.coalesce("first#", F.raise_error(F.concat(F.lit("a file of no known name: "), "file#")).cast("long"))
    return known.withColumn("id", first + F.col("row#")).drop("file#", "row#", "first#")


def sales_graph(spark: SparkSession, folder: str) -> Graph:
    graph = Graph(spark)
    for label, (name, prefix, key) in NODES.items():
        df = read(spark, folder, name)
        graph = graph.with_nodes(label, df.withColumnsRenamed({c: c.removeprefix(prefix) for c in df.columns}), key)
    for edge in KEY_EDGES:
        graph = graph.with_key_edges(*edge)
    lines = numbered_rows(read(spark, folder, "lineitem"))  # which have no key of their own
    lines = lines.withColumnsRenamed({c: c.removeprefix("l_") for c in lines.columns})
    kept = ("linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")
    graph = graph.with_edges("CONTAINS", lines.select("id", graph.node_id("Order", "orderkey").alias("src"), graph.node_id("Part", "partkey").alias("dst"), *kept), "Order", "Part")
    return graph.with_edges("SUPPLIES", lines.select("id", graph.node_id("Supplier", "suppkey").alias("src"), graph.node_id("Part", "partkey").alias("dst"), *kept), "Supplier", "Part")
