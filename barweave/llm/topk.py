"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Components are quantised to integers. The eigenvectors of the Gram matrix (right singular vectors of the data) rotate all
vectors so that the leading coordinates carry most of the length. Candidates are dealt into blocks of similar length, longest
first. A first pass scores every query against the ``SEED`` longest candidates (a fixed number, sent to all tasks) and leaves
each query a score that its k-th result reaches at least. A block then meets a block of queries only if the product of their
largest lengths can still reach the lowest of these scores; inside, the sum over the leading coordinates plus the product of
the residual lengths bounds each inner product, and only pairs at or above the query's score are computed, in integers.

Blocks of queries and candidates are joined on a grid of block numbers, at most ``BLOCK`` x ``BLOCK`` vectors a task step; no
pairs of single rows are formed and neither side is collected.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; a row without id takes no part; rows repeated with equal id and vector count once, and of different vectors
under one id each is a candidate but not for queries of that id. Scores are exact while they fit 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import saved

K = 5
SCALE = 256
EVERY = 50
SEED = 1024
BLOCK = 2048
LEAD = 0.35


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double>, norm) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).distinct()
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def rotation(rows: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Right singular vectors, strongest first, and how many of them lead; what is gathered are width x width sums."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = matrix(b.column(0), width)
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    got = rows.select("v").mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((width, width))
    total[got["i"], got["j"]] = got["s"]
    _, vectors = np.linalg.eigh((total + total.T) / 2)
    return vectors[:, ::-1].copy(), max(1, int(np.ceil(LEAD * width)))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, lead: int, floor: np.ndarray, k: int):
    """(query id, candidate id, score) of the k best candidates of a block for each query, as far as they reach ``floor``."""
    qr, cr = q @ turn, c @ turn
    q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(axis=1)) for x in (qr, cr))
    slack = 1e-9 * np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((c**2).sum(axis=1)).max(initial=0) + 1e-6
    bound = qr[:, :lead] @ cr[:, :lead].T + q_rest[:, None] * c_rest[None] + slack
    hopeful = (bound >= floor[:, None]) & (q_ids[:, None] != c_ids[None])
    rows = np.flatnonzero(hopeful.any(axis=1))
    out = []
    if len(rows):
        columns = np.flatnonzero(hopeful[rows].any(axis=0))
        scores = q[rows] @ c[columns].T  # integers, exact in double precision below 2**53
        for r, s in zip(rows, scores):
            ok = np.flatnonzero(hopeful[r, columns] & (s >= floor[r]))
            top = ok[best(c_ids[columns[ok]], s[ok], k)]
            out += [(int(q_ids[r]), int(c_ids[columns[j]]), int(s[j])) for j in top]
    return out


def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows numbered in blocks of about ``size`` vectors of similar length; block 0 is the longest."""
    parts = max(1, -(-rows.count() // size))
    dealt = rows.repartitionByRange(parts, F.col("norm").desc(), "id")
    return saved(dealt.withColumn(name, F.spark_partition_id()), name)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
                       scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query among all ``vectors`` but those of its own id."""
    rows = saved(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = saved(quantised(queries, id_col, vector_col, scale), "queries")
    width = rows.union(asked).agg(F.max(F.size("v"))).first()[0] or 1
    turn, lead = rotation(rows, width)
    context = rows.sparkSession.sparkContext
    first = rows.orderBy(F.col("norm").desc(), "id").limit(seed).collect()  # ``seed`` rows at most
    seeds = context.broadcast((np.array([r["id"] for r in first], np.int64), matrix(pd.Series([r["v"] for r in first], dtype=object), width)))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = seeds.value
        for b in batches:
            q_ids, q = b.column("id").to_numpy(), matrix(b.column("v"), width)
            scores = np.where(q_ids[:, None] == ids[None], -np.inf, q @ c.T)
            floor = np.partition(scores, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(q), -np.inf)
            yield pa.record_batch([*b.columns, pa.array(floor)], names=["id", "v", "norm", "floor"])

    floored = blocks(asked.mapInArrow(start, "id bigint, v array<double>, norm double, floor double"), "q_block", block)
    dealt = blocks(rows, "c_block", block)

    # One row per pair of blocks that can still hold a result: numbers of blocks, not of vectors.
    q_edge = floored.groupBy("q_block").agg(F.max("norm").alias("q_norm"), F.min("floor").alias("q_floor"))
    c_edge = dealt.groupBy("c_block").agg(F.max("norm").alias("c_norm"))
    last = c_edge.agg(F.max("c_block")).first()[0]
    grid = q_edge.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(last if last is not None else 0)))).join(c_edge, "c_block")
    grid = grid.where(F.col("q_norm") * F.col("c_norm") * (1 + 1e-9) >= F.col("q_floor")).select("q_block", "c_block")

    q_packed = floored.groupBy("q_block").agg(F.collect_list(F.struct("id", "v", "floor")).alias("q"))
    c_packed = dealt.groupBy("c_block").agg(F.collect_list(F.struct("id", "v")).alias("c"))
    met = grid.join(c_packed, "c_block").join(q_packed, "q_block").select("q", "c")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, c = (b.column(n)[i].values for n in ("q", "c"))
                found = search(q.field("id").to_numpy(), matrix(q.field("v"), width), c.field("id").to_numpy(), matrix(c.field("v"), width),
                               turn, lead, q.field("floor").to_numpy(), k)
                columns = zip(*found) if found else ((), (), ())
                yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    scored = met.mapInArrow(pairs, "query_id bigint, vec_id bigint, score bigint").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
