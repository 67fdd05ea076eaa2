"""Graphs in a folder: each save writes a new version's tables and then names it current.

Tables are Parquet. A save first claims its version's number, which one saver alone can do.
A version counts once its manifest is written, which is its last file, so a save that fails
leaves the folder as it was. Everything goes through Spark's readers and writers and works
on any file system that they reach.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.errors import StorageError
from weftgraph.sources.graph import EdgeTable, Graph, NodeTable, next_id


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs = _files(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_path(spark, f"{folder}/{n}/manifest/_SUCCESS")))


def claimed(spark: SparkSession, folder: str) -> int:
    """The least version number above all finished ones that no other saver has claimed, now claimed."""
    fs, version = _files(spark, folder), max(_versions(spark, folder), default=0) + 1
    while not fs.createNewFile(_path(spark, f"{folder}/claims/{version}")):
        version += 1
    return version


def save(graph: Graph, folder: str) -> int:
    """Checks the constraints, writes a new version and returns its number."""
    graph.check()
    spark = graph.spark
    version = claimed(spark, folder)
    base = f"{folder}/v{version}"
    spec: dict = {"nodes": [], "edges": [], "unique": sorted(graph.unique), "clustered": sorted(graph.clustered)}
    for label, t in graph.nodes.items():
        name = f"n{t.number}"
        keys = [k for of, k in sorted(graph.clustered) if of == label and k in t.df.columns]
        df = t.df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else t.df
        df.write.parquet(f"{base}/{name}")
        spec["nodes"].append({"label": label, "number": t.number, "name": name, "floor": next_id([t]) if t.past else t.floor})
    for i, e in enumerate(graph.edges):
        if e.df is not None:
            e.df.write.parquet(f"{base}/e{i}")
        spec["edges"].append({"type": e.type, "src": e.src, "dst": e.dst, "holder": e.holder, "key": e.key, "name": f"e{i}" if e.df is not None else None, "floor": next_id([e]) if e.past else e.floor})
    spec["token"] = uuid.uuid4().hex
    spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.text(f"{base}/manifest")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None) -> Graph:
    """The current version of a folder, or an earlier one."""
    versions = _versions(spark, folder)
    if not versions or version is not None and version not in versions:
        raise StorageError(f"no graph in {folder}" if version is None else f"no version {version} in {folder}")
    base = f"{folder}/v{version or versions[-1]}"
    spec = json.loads(spark.read.text(f"{base}/manifest").first()["value"])
    nodes = {n["label"]: NodeTable(n["label"], n["number"], spark.read.parquet(f"{base}/{n['name']}"), n.get("floor", 0)) for n in spec["nodes"]}
    edges = tuple(EdgeTable(e["type"], e["src"], e["dst"], spark.read.parquet(f"{base}/{e['name']}") if e["name"] else None, e["holder"], e["key"], e.get("floor", 0)) for e in spec["edges"])
    return Graph(spark, nodes, edges, frozenset(map(tuple, spec["unique"])), frozenset(map(tuple, spec["clustered"])))


def versions(spark: SparkSession, folder: str) -> list[int]:
    return _versions(spark, folder)


def edge_list(graph: Graph):
    """(src, dst, type) of all edges, for exchange with other tools."""
    return graph.scan_edges().select("src", "dst", F.col("type"))
