import numpy as np
import pytest
from pyspark.errors import PythonException

from weftgraph.llm import topk_search as K


def by_hand(rows, every=50, k=5):
    usable = [(i, np.floor(np.array(x, np.float64) * 256).astype(np.int64)) for i, x in rows if i is not None and x and None not in x and np.isfinite(np.array(x, float)).all()]
    out = []
    for q, (i, x) in enumerate(usable):
        if i % every == 0:
            scores = [(-int(sum(int(a) * int(b) for a, b in zip(x, y, strict=False))), j) for p, (j, y) in enumerate(usable) if p != q]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, K.op7_topk_search(spark, "/root/testdata/sf0.001").collect())) == by_hand(rows)


def test_awkward_vectors(spark, folder, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (100, [-3.0]), (100, [-3.0]), (8, [0.001, -0.001, 5.0]), (9, [1e9, 1e9]), (None, [9.0]), (-50, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS norm", "1 AS row", "2 AS band")
    assert sorted(map(tuple, K.op7_topk_search(spark, folder(embeddings=df)).collect())) == by_hand(rows)
    assert K.op7_topk_search(spark, folder(embeddings=df.where("false"))).collect() == []


def test_large_products_are_exact_or_refused():
    a, b = np.array([[1 << 40, 3], [1 << 31, -7]]), np.array([[1 << 22, 5], [-(1 << 22), 1]])
    assert K.products(a, b).tolist() == [[sum(x * y for x, y in zip(r, s, strict=True)) for s in b.tolist()] for r in a.tolist()]
    with pytest.raises(OverflowError):
        K.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_too_large_components_are_refused(spark):
    with pytest.raises(PythonException, match="too large"):
        K.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_many_bands_and_ties(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "FIRST", 16)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.integers(-3, 4, 24) * rng.choice([0.25, 1.0, 4.0])).tolist()) for i in range(700)]
    rows += [(1000 + i, [1.0] * 24) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, K.top_k(df).collect())) == by_hand(rows)


def test_rounds_raise_thresholds_and_deal_queries(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("FIRST", 8), ("ROUND", 1), ("GROWTH", 2), ("QUERIES", 4), ("TOGETHER", 1)):
        monkeypatch.setattr(K, name, value)
    assert list(K.rounds(9)) == [(0, 1), (1, 3), (3, 7), (7, 9)] and list(K.rounds(0)) == []
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.normal(size=20) * rng.choice([1.0, 1.0, 1.0, 90.0])).tolist()) for i in range(400)]  # two and four bytes a component
    rows += [(500 + i, [0.0] * 20) for i in range(60)] + [(50, rows[3][1]), (50, rows[4][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, K.top_k(df, every=10).collect())) == by_hand(rows, every=10)
    assert sorted(map(tuple, K.top_k(df.where("vec_id < 3"), every=10).collect())) == by_hand(rows[:3], every=10)
