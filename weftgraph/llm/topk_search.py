"""Exact top-k inner products over norm-sorted vectors (operator 7).

Vectors are dealt into bands by descending length and packed into blocks. A first look at
the longest ones gives each query a score that its k-th best cannot fall below; a query only
meets bands whose longest vector could still reach it. Bands are met in rounds, each of more
bands than the one before, and what a round finds raises that score for the next; once no
query can gain from the next band, none can from any behind it. Where block and query meet,
both are rotated to the singular directions of a sample, the leading coordinates are
multiplied, and the Cauchy-Schwarz bound of the rest prunes; what remains is scored in whole
numbers. The rotation only decides how early pruning works, never the result.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no
part; of vectors of unequal length the missing components count as 0; repeated rows are rows
of their own, a query leaves out only its own row; ties go to the smaller id; an empty table
gives an empty result; a null id takes no part; a component or an inner product that 64 bits
do not hold stops the query with an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, table

K, EVERY = 5, 50
#: Rows of a block of vectors, of a block of queries, and of the first look.
BLOCK, QUERIES, FIRST = 8192, 1024, 4096
#: Bands of the first round, and how many times more each round meets than the one before.
ROUND, GROWTH = 4, 8
#: Query blocks that meet a block of vectors in one task, about.
TOGETHER = 64
#: Vectors that the rotation is fitted on, about, and the leading coordinates.
SAMPLE, LEADING = 20_000, 16
LARGEST = 2.0**53


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, norm, packed): floor(256 x) of the usable vectors as packed 64-bit integers."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch["vec_id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.floor(np.array(v, np.float64) * 256)
                if not np.isfinite(np.array(v, np.float64)).all():
                    continue
                if not np.abs(x).max() < 2.0**62:
                    raise OverflowError(f"a component of vector {i} is too large for whole numbers of 64 bits")
                rows.append((i, float(np.sqrt((x * x).sum())), x.astype("<i8").tobytes()))
            ids, norms, packed = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "norm": pa.array(norms, pa.float64()), "packed": pa.array(packed, pa.binary())})

    picked = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return picked.mapInArrow(work, "vec_id long, norm double, packed binary").withColumn("row", F.monotonically_increasing_id())


def unpacked(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` integers, short ones filled up with 0."""
    if all(len(p) == 8 * width for p in packed):
        return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), width)
    out = np.zeros((len(packed), width), np.int64)
    for r, p in enumerate(packed):
        out[r, : len(p) // 8] = np.frombuffer(p, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows; in floating point only where that is exact, and an error where 64 bits do not hold one."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < LARGEST:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if exact.size and (exact.max() >= 1 << 63 or exact.min() < -(1 << 63)):
        raise OverflowError("an inner product does not fit in 64 bits")
    return exact.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; fewer if there are fewer."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def rotation(sample: np.ndarray) -> np.ndarray:
    """The right singular vectors of a sample, largest first."""
    x = sample.astype(np.float64)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def meet(q: np.ndarray, q_rows: np.ndarray, least: np.ndarray, v: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of a query block's best in a vector block, at least its known score."""
    q_norm, v_norm = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (q, v))
    live = np.flatnonzero(q_norm * v_norm.max(initial=0) * (1 + 1e-9) + 1 >= least)
    if not len(live):
        return
    q, q_rows, least, q_norm = q[live], q_rows[live], least[live], q_norm[live]
    q_turned, v_turned = q.astype(np.float64) @ turn, v.astype(np.float64) @ turn
    rest = lambda x: np.sqrt(np.maximum((x[:, LEADING:] ** 2).sum(axis=1), 0))
    bound = q_turned[:, :LEADING] @ v_turned[:, :LEADING].T + np.outer(rest(q_turned), rest(v_turned))
    bound += 1 + 1e-9 * np.outer(q_norm, v_norm)  # rounding of the rotation
    open_ = bound >= least[:, None]
    dense = open_.mean() > 0.1
    exact = products(q, v) if dense else None
    for i in range(len(q)):
        places = np.flatnonzero(open_[i] & (v_rows != q_rows[i]))
        scores = exact[i, places] if dense else products(q[i : i + 1], v[places])[0]
        enough = scores >= least[i]
        places, scores = places[enough], scores[enough]
        top = best(scores, v_ids[places], k)
        yield live[i], places[top], scores[top]


def rounds(bands: int) -> Iterator[tuple[int, int]]:
    """The bands of each round, as (from, to)."""
    low, size = 0, ROUND
    while low < bands:
        yield low, min(low + size, bands)
        low, size = low + size, size * GROWTH


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of every row whose id is divisible by ``every``, against all other rows."""
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, key, vector))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.length("packed")).alias("bytes"), F.max("norm").alias("norm")).first()
    count, width = facts["n"], (facts["bytes"] or 8) // 8
    # no component is larger than the longest vector; what is shuffled has no more bytes than that needs
    kind = next(t for t, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", np.inf)) if (facts["norm"] or 0) * (1 + 1e-9) < most - 1)
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(count, 1)) * (1 << 30))).select("packed").toArrow()
    turn = rotation(unpacked(sample["packed"].to_pylist(), width)) if sample.num_rows else np.eye(width)
    first = rows.orderBy(F.desc("norm"), "vec_id", "row").limit(FIRST).select("row", "vec_id", "packed").toArrow()
    shared = spark.sparkContext.broadcast((turn, first["row"].to_numpy(), first["vec_id"].to_numpy(), unpacked(first["packed"].to_pylist(), width)))

    bands = max(1, -(-count // BLOCK))
    banded = rows.repartitionByRange(bands, F.desc("norm"), F.asc("vec_id"), F.asc("row")).sortWithinPartitions(F.desc("norm"), "vec_id", "row").withColumn("band", F.spark_partition_id())

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                yield pa.RecordBatch.from_pydict({
                    "band": part["band"].slice(0, 1), "norm": part["norm"].slice(0, 1), "v_rows": pa.array([part["row"].to_numpy().tobytes()], pa.binary()),
                    "v_ids": pa.array([part["vec_id"].to_numpy().tobytes()], pa.binary()), "v": pa.array([unpacked(part["packed"].to_pylist(), width).astype(kind).tobytes()], pa.binary()),
                })

    blocks = cut(banded.mapInArrow(pack, "band int, norm double, v_rows binary, v_ids binary, v binary"))
    longest = {r["band"]: r["norm"] for r in blocks.groupBy("band").agg(F.max("norm").alias("norm")).collect()}  # one row a band
    names = sorted(longest)
    limits = np.array([longest[b] for b in names])

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, f_rows, f_ids, f = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, QUERIES):
                part = batch.slice(low, QUERIES)
                q, q_rows, norms = unpacked(part["packed"].to_pylist(), width), part["row"].to_numpy(), part["norm"].to_numpy()
                scores, least = products(q, f), np.full(len(q), -np.inf)
                for i in range(len(q)):
                    own = scores[i][f_rows != q_rows[i]]
                    if len(own) >= k:
                        least[i] = np.partition(own, len(own) - k)[len(own) - k]
                yield pa.RecordBatch.from_pydict({"row": part["row"], "vec_id": part["vec_id"], "norm": part["norm"], "packed": part["packed"], "least": pa.array(least)})

    asked = cut(rows.where(F.col("vec_id") % every == 0).mapInArrow(look, "row long, vec_id long, norm double, packed binary, least double"))
    ways = max(1, -(-count // every // QUERIES))
    deals = max(1, -(-ways // TOGETHER))

    def grouping(low: int, high: int):
        def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    part = batch.slice(at, QUERIES)
                    need = part["need"].to_numpy().min()
                    met = [b for b, limit in zip(names[low:high], limits[low:high], strict=True) if limit >= need]
                    one = {"q_rows": part["row"].to_numpy().tobytes(), "q_ids": part["vec_id"].to_numpy().tobytes(), "q": unpacked(part["packed"].to_pylist(), width).astype(kind).tobytes(), "least": part["least"].to_numpy().tobytes()}
                    deal = part["deal"][0].as_py() % deals
                    yield pa.RecordBatch.from_pydict({"band": pa.array(met, pa.int32()), "deal": pa.array([deal] * len(met), pa.int32())} | {n: pa.array([v] * len(met), pa.binary()) for n, v in one.items()})

        return group

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for r in batch.to_pylist():
                q, v = (np.frombuffer(r[c], kind).astype(np.int64).reshape(-1, width) for c in ("q", "v"))
                q_rows, q_ids, v_rows, v_ids = (np.frombuffer(r[c], np.int64) for c in ("q_rows", "q_ids", "v_rows", "v_ids"))
                for i, places, scores in meet(q, q_rows, np.frombuffer(r["least"], np.float64), v, v_rows, v_ids, shared.value[0], k):
                    for c, x in zip(out, (np.full(len(places), q_rows[i]), np.full(len(places), q_ids[i]), v_ids[places], scores), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for n, c in zip(("row", "query_id", "vec_id", "score"), out, strict=True)})

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = spark.createDataFrame([], "row long, query_id long, vec_id long, score long, rank int")
    for low, high in rounds(len(names)):
        reached = found.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("reached"))
        raised = asked.join(reached, "row", "left").withColumn("least", F.greatest("least", "reached")).drop("reached") if low else asked
        # the shortest vector that can still matter: no band below it need be met
        need = F.when(F.col("norm") > 0, F.col("least") / F.col("norm") * F.when(F.col("least") > 0, 1 - 1e-9).otherwise(1.0) - 1).otherwise(float("-inf"))
        live = cut(raised.withColumn("need", need).where(F.col("need") <= float(limits[low])))
        if live.isEmpty():
            break
        ordered = live.repartitionByRange(ways, "need", "row").sortWithinPartitions("need", "row").withColumn("deal", F.spark_partition_id())
        questions = ordered.mapInArrow(grouping(low, high), "band int, deal int, q_rows binary, q_ids binary, q binary, least binary")
        # a block of vectors goes once to each of the tasks that share its band's query blocks
        dealt = blocks.where(F.col("band").between(names[low], names[high - 1])).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        met = questions.join(dealt, ["band", "deal"]).select("q_rows", "q_ids", "q", "least", "v_rows", "v_ids", "v")
        better = met.mapInArrow(answer, "row long, query_id long, vec_id long, score long").union(found.drop("rank"))
        found = cut(better.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return found.select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS r, q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM usable q JOIN usable v ON q.r <> v.r WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= {K}
"""
