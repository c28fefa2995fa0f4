"""Exact top-k by distributed histogram selection.

Vectors become integers floor(scale * x). Every candidate is scored against every query in blocks (one integer matrix
product a block, done in doubles only where they are exact). Each pass adds, per query, a histogram of the scores that
can still hold the k-th value, summed over all candidates; the bin with the k-th highest score becomes the next range,
until a query's range holds few scores or one value. A last pass filters by that bound, keeps each task's k best with
ties to the smaller id, and ranks what is left. Queries are walked in blocks of at most ``block`` rows, so that what is
broadcast stays bounded; candidates are never gathered.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors
of different lengths compare as if filled up with zeros; an empty vector scores 0 with all; rows that share the query's id
are its own; query rows of one id and different vectors are queries of their own, equal ones one; repeated candidate rows count as rows; components beyond +-2^62 / scale saturate, and scores beyond 64 bits
saturate as well; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, slices, table

BINS = 64
LIMIT = (1 << 62) - 1


def integers(vectors: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v array<bigint>) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    whole = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # the cast of a double saturates at the ends of a long
    return vectors.filter(whole).select(F.col(vec_id).cast("bigint").alias("id"), F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * scale)))).alias("v"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integers, filled up with zeros to the longest."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(lengths.max(initial=0)))
    if len(flat) == len(lengths) * width:
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T  # rare: components of astronomic size
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _scores(batches: Iterable[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores (queries, candidates), mask of pairs that count) block by block."""
    for batch in slices(batches, rows):
        own = batch.column(0).to_numpy()
        yield own, products(queries, matrix(batch.column(1))), ids[:, None] != own[None, :]


def _histograms(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Counts (queries, BINS + 2) of scores by (score - low) // width; below the range first, at high or above last."""
    spark = candidates.sparkSession
    shipped = spark.sparkContext.broadcast((ids, queries, low, high, width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, low, high, width = shipped.value
        total = np.zeros(len(ids) * (BINS + 2), np.int64)
        base = (np.arange(len(ids)) * (BINS + 2))[:, None]
        for _, scores, counts in _scores(batches, ids, queries):
            bins = np.clip((scores - low[:, None]) // width[:, None], -1, BINS - 1)
            bins[scores >= high[:, None]] = BINS
            bins += base + 1
            total += np.bincount(bins[counts], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    summed = candidates.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # queries of one block * bins
    out = np.zeros(len(ids) * (BINS + 2), np.int64)
    out[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    shipped.unpersist()
    return out.reshape(len(ids), BINS + 2)


def _select(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k best candidates of each query of one block: query_id, vec_id, score, rank."""
    spark = candidates.sparkSession
    spread = np.abs(queries).sum(1).astype(np.float64)
    top = candidates.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    reach = np.minimum(spread * float(top) + 1, 2.0**61).astype(np.int64)
    low = -reach
    width, high = np.maximum(1, -(-2 * reach // BINS)), reach + 1
    need = np.full(len(ids), k, np.int64)  # how many of the range, from above, are still looked for
    bound, open_ = np.full(len(ids), -(1 << 63), np.int64), np.ones(len(ids), bool)
    while open_.any():
        live = np.flatnonzero(open_)
        counts = _histograms(candidates, ids[live], queries[live], low[live], high[live], width[live])[:, 1:-1]
        above = counts[:, ::-1].cumsum(1)[:, ::-1]
        for row, i in enumerate(live):
            if above[row, 0] < need[i]:  # fewer than k scores in all
                open_[i] = False
                continue
            b = int(np.flatnonzero(above[row] >= need[i])[-1])
            low[i], high[i] = low[i] + b * width[i], min(high[i], low[i] + (b + 1) * width[i])
            need[i] -= above[row, b + 1] if b + 1 < BINS else 0
            bound[i] = low[i]
            open_[i] = width[i] > 1 and counts[row, b] > 4 * k
            width[i] = max(1, -(-width[i] // BINS))
    shipped = spark.sparkContext.broadcast((ids, queries, bound))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, bound = shipped.value
        q, c, s = (np.zeros(0, np.int64) for _ in range(3))
        for own, scores, counts in _scores(batches, ids, queries):
            i, j = np.nonzero(counts & (scores >= bound[:, None]))
            q, c, s = np.concatenate([q, i]), np.concatenate([c, own[j]]), np.concatenate([s, scores[i, j]])
            order = np.lexsort((c, ~s, q))  # ~s orders as -s and cannot overflow
            q, c, s = q[order], c[order], s[order]
            start = np.searchsorted(q, q)  # first place of each query
            best = np.arange(len(q)) - start < k
            q, c, s = q[best], c[best], s[best]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q]), pa.array(c), pa.array(s)], ["q", "query_id", "vec_id", "score"])

    near = candidates.mapInArrow(run, "q bigint, query_id bigint, vec_id bigint, score bigint")  # k rows a query and task at most
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of each distinct query row; is_query: a predicate on ``id``."""
    candidates = materialize(integers(vectors, scale), "vectors")
    queries = candidates.filter(is_query).dropDuplicates(["id", "v"])
    found, ids, rows = [], [], []
    for r in queries.orderBy("id", "v").toLocalIterator():
        ids.append(r["id"])
        rows.append(r["v"])
        if len(ids) == block:
            found.append(materialize(_block(candidates, ids, rows, k), "top"))
            ids, rows = [], []
    if ids or not found:
        found.append(_block(candidates, ids, rows, k))
    return reduce(DataFrame.unionAll, found)


def _block(candidates: DataFrame, ids: list[int], rows: list[list[int]], k: int) -> DataFrame:
    if not ids:
        return candidates.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return _select(candidates, np.array(ids, np.int64), matrix(pa.array(rows, pa.list_(pa.int64()))), k)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


#: The same rows in DuckDB SQL.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
