"""Exact top-k by inner product over vectors in descending length.

Vectors are rotated by the eigenvectors of their second-moment matrix (the right singular vectors of the table), so that the
leading coordinates carry most of a product. Blocks of candidates hold vectors of similar length, blocks of queries ones that
need candidates of similar length (their bound over their own length). Two blocks meet only if the longest candidate reaches
the least such need, which is found from a row a block, before any vector moves; within a block, products over the leading
coordinates plus the product of the residual lengths (Cauchy-Schwarz) rule candidates out; the rest are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed, table

#: Vectors of a block; a block of candidates meets each block of queries.
BLOCK = 1024
#: The longest vectors, which give each query its first bound (bounds what is broadcast).
PILOT = 1024
#: Blocks that one task takes for a block of queries, and that a task cuts from sorted rows.
SLICE_BLOCKS = 16
#: Leading coordinates of the rotated vectors, by turns.
STEPS = (8, 16, 32)


def vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (floor(scale * x) as doubles, x as double), norm of the rows that have an id and a vector of finite components only."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.floor(e * scale).cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(F.col("embedding").cast("array<double>"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return rows.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))


def rotation(points: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of v v', strongest first. Each task adds up its own; width * width numbers reach the driver from each."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = matrix(batch.column(0), width)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    cells = points.select("v").mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    whole = np.zeros(width * width)
    for x in cells:
        whole[x.cell] = x.value
    return np.linalg.eigh(whole.reshape(width, width))[1][:, ::-1]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError("vectors of different lengths have no inner product")
    return flat.reshape(-1, width)


def in_blocks(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """block, items (structs of the rows): the n rows in order, cut into runs of BLOCK at most. Rows are dealt out by ranges of the order, sorted and cut as they stream by."""
    inner = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema)
    parts = max(1, -(-n // (BLOCK * SLICE_BLOCKS)))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), F.struct(*rows.columns).alias("item"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k, part = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            held.append(batch.column(1))
            while sum(map(len, held)) >= BLOCK:
                whole = pa.concat_arrays(held)
                yield block_row(part, k, whole[:BLOCK])
                held, k = [whole[BLOCK:]], k + 1
        if sum(map(len, held)):
            yield block_row(part, k, pa.concat_arrays(held))

    return checkpointed(placed.mapInArrow(cut, f"block long, items array<struct<{inner}>>"))


def block_row(part: int, k: int, items: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)], ["block", "items"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Pruned:
    """A block of candidates, rotated, that answers queries above their bounds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray) -> None:
        self.ids, self.v = ids, v
        self.turned = v @ turn
        tail = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(np.column_stack([tail, np.zeros(len(v))]))

    def above(self, q: np.ndarray, turned: np.ndarray, query: int, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of this block's k best that reach the bound."""
        alive = np.arange(len(self.ids))
        rest = np.sqrt(np.concatenate([np.cumsum((turned**2)[::-1])[::-1], [0.0]]))
        done, partial = 0, np.zeros(len(alive))
        slack = 1e-6 * (1 + rest[0] * self.rest[:, 0].max())  # rounding of the rotated sums
        for step in STEPS:
            if step >= len(turned) or not len(alive):
                break
            partial = partial + self.turned[alive, done:step] @ turned[done:step]
            done = step
            stay = partial + self.rest[alive, step] * rest[step] + slack >= bound
            alive, partial = alive[stay], partial[stay]
        alive = alive[self.ids[alive] != query]
        scores = self.v[alive] @ q  # whole numbers below 2**53: exact
        reach = scores >= bound
        alive, scores = alive[reach], scores[reach]
        at = best(scores, self.ids[alive], k)
        return self.ids[alive[at]], scores[at]


class Asked:
    """A block of queries with the best candidates so far; candidates come in descending length, so bounds tighten as early as can be."""

    def __init__(self, q: pa.StructArray, width: int, turn: np.ndarray, k: int) -> None:
        self.ids, self.v, self.norms, self.bounds = q.field(0).to_numpy(), matrix(q.field(1), width), q.field(2).to_numpy(), q.field(3).to_numpy().copy()
        self.turn, self.turned, self.width, self.k = turn, self.v @ turn, width, k
        self.best = [(np.empty(0, np.int64), np.empty(0)) for _ in self.ids]

    def meet(self, c: pa.StructArray, longest: float) -> None:
        asking = np.flatnonzero(self.norms * longest * (1 + 1e-9) >= self.bounds)
        if not len(asking):
            return
        block = Pruned(c.field(0).to_numpy(), matrix(c.field(1), self.width), self.turn)
        for j in asking:
            ids, scores = block.above(self.v[j], self.turned[j], self.ids[j], self.bounds[j], self.k)
            if len(ids):
                ids, scores = np.concatenate([self.best[j][0], ids]), np.concatenate([self.best[j][1], scores])
                at = best(scores, ids, self.k)
                self.best[j] = ids[at], scores[at]
                if len(at) == self.k:
                    self.bounds[j] = max(self.bounds[j], scores[at[-1]])

    def found(self) -> pa.RecordBatch:
        sizes = [len(x) for x, _ in self.best]
        ids, scores = np.concatenate([x for x, _ in self.best]), np.concatenate([x for _, x in self.best])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, sizes)), pa.array(ids), pa.array(scores.astype(np.int64))], ["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row of queries (vec_id, v, norm) the k best of rows but itself, all if fewer.

    Both come from vectors(), which leaves out null ids, null vectors and null or non-finite components; v holds whole numbers.
    Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates of their own; as queries they count once for each distinct vector.
    Vectors of different lengths raise an error; an empty table, or no queries, gives no rows. Vectors of length zero score zero.
    """
    spark = rows.sparkSession
    rows = checkpointed(rows.select("vec_id", "v", "norm"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = len(rows.first().v)
    turn = spark.sparkContext.broadcast(rotation(rows, width))
    # the first bound of each query: its k-th score among the longest vectors
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(PILOT).collect()
    pilot = spark.sparkContext.broadcast((np.array([x.vec_id for x in longest]), np.array([x.v for x in longest])))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = pilot.value
        for batch in batches:
            own, q = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            scores = q @ v.T
            scores[own[:, None] == ids[None, :]] = -np.inf
            bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(bound)], ["vec_id", "v", "norm", "bound"])

    candidates = in_blocks(rows, n, F.desc("norm"), F.col("vec_id"), F.xxhash64("v"))
    asked = queries.select("vec_id", "v", "norm").distinct()
    own = asked.mapInArrow(bounded, "vec_id long, v array<double>, norm double, bound double")
    # the length a candidate must have: none where the bound is no more than nothing
    own = checkpointed(own.withColumn("need", F.when(F.col("bound") > 0, F.col("bound") / F.col("norm")).otherwise(F.lit(0.0))))
    own = in_blocks(own, own.count(), F.col("need"), F.col("vec_id"), F.xxhash64("v"))
    # a row a block decides which blocks meet; the longest candidate and the least need come first in their blocks
    c, q = candidates.select("block", F.col("items")[0]["norm"].alias("longest")), own.select(F.col("block").alias("q_block"), F.col("items")[0]["need"].alias("need"))
    pairs = c.join(q, F.col("longest") * (1 + 1e-9) >= F.col("need")).select("block", "q_block", "longest")
    # a block of queries meets the candidates in slices of SLICE_BLOCKS blocks or so, each in descending length
    slices = -(-n // (BLOCK * SLICE_BLOCKS))
    met = pairs.join(candidates, "block").join(own.select(F.col("block").alias("q_block"), F.col("items").alias("q")), "q_block")
    met = met.select(F.col("items").alias("c"), "q", "longest", "q_block", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice")).repartition("q_block", "slice").sortWithinPartitions("q_block", "slice", F.desc("longest"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if at != (batch.column(3)[i].as_py(), batch.column(4)[i].as_py()):
                    if held is not None:
                        yield held.found()
                    at, held = (batch.column(3)[i].as_py(), batch.column(4)[i].as_py()), Asked(batch.column(1)[i].values, width, turn.value, k)
                held.meet(batch.column(0)[i].values, batch.column(2)[i].as_py())
        if held is not None:
            yield held.found()

    found = met.mapInArrow(scored, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
