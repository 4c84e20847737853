"""Exact top-k search by distributed histogram selection.

Queries go in blocks of bounded size; each block is scored against all
candidates where they lie. A round counts, for every query, the scores of the
whole corpus in ``BINS`` equal bins of its current interval; the bin that holds
the kth highest score becomes the next interval, until it is one score wide.
Scores are integers, so the kth value is found exactly in a fixed number of
rounds. A last pass keeps what scores above the kth value and, of those equal
to it, the smallest identifiers that are still needed; each task keeps at most
that many ties of a query, so a vector with very many copies costs no more.

Nothing but the counts is shuffled. Scoring all candidates for every block is
the work that exactness asks for; the candidates are read, not moved.

Defined results: vectors that are null, hold null or non-finite components, or
have no identifier take no part. Vectors of unequal length do not compare: each
query meets the candidates of its own length. Components whose floor does not fit a
long count as the nearest one that does, and so do scores; vectors so large are
scored with Python's integers. Rows with a query's own
identifier are the query's own; of rows that repeat a query's identifier the
smallest vector asks. Queries with no candidate give no rows, an empty table
neither. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apptflow.llm.common import scratch_path, stored

BLOCK = 4096
LARGEST = (1 << 63) - 1
BINS = 256
#: candidates scored at a time in a task, and queries of a block at a time
CHUNK, PART = 2048, 512


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of every component, for vectors that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    d = vectors.filter(v.isNotNull() & F.col(id_col).isNotNull()).filter(~bad)
    return d.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(
        v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int, kind: type) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _scored(dim: int, kind: type, ids: np.ndarray, block: np.ndarray,
            use: Callable) -> Callable[[Iterator[pa.RecordBatch]], None]:
    """Call use(first query, candidate ids, scores, whose own they are) for all candidates of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> None:
        for batch in batches:
            own_ids = batch.column("vec_id").to_numpy()
            rows = _matrix(batch, dim, kind)
            for c in range(0, len(rows), CHUNK):
                part, cand = rows[c:c + CHUNK], own_ids[c:c + CHUNK]
                for q in range(0, len(block), PART):
                    scores = block[q:q + PART] @ part.T
                    if kind is object:
                        scores = np.clip(scores, -LARGEST, LARGEST)
                    scores = np.ascontiguousarray(scores.astype(np.int64))
                    use(q, cand, scores, ids[q:q + PART, None] == cand[None, :])
    return run


def _counts(candidates: DataFrame, dim: int, kind: type, ids: np.ndarray, block: np.ndarray, low: np.ndarray,
            span: int, width: int) -> np.ndarray:
    """Scores of all candidates in each query's bins of [low, low + span), highest bin first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(block), BINS), np.int64)

        def use(q, cand, scores, own):
            n = len(scores)
            over = scores.view(np.uint64) - low[q:q + n, None].view(np.uint64)  # right above low, whatever the span
            fit = (scores >= low[q:q + n, None]) & (over < np.uint64(span)) & ~own
            at = (over // np.uint64(width)).astype(np.int64)
            rows = np.broadcast_to(np.arange(n)[:, None], at.shape)
            total[q:q + n] += np.bincount(rows[fit] * BINS + at[fit], minlength=n * BINS).reshape(n, BINS)

        _scored(dim, kind, ids, block, use)(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    sums = candidates.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros((len(block), BINS), np.int64)  # at most BLOCK * BINS counts come back
    found = sums.toArrow()
    out.ravel()[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out[:, ::-1]


def _block_top_k(candidates: DataFrame, dim: int, bound: int, ids: np.ndarray, block: np.ndarray, k: int) -> DataFrame:
    # float64 adds integers exactly below 2**53
    kind = np.float64 if bound < 2 ** 53 else np.int64 if bound < 2 ** 62 else object
    bound = min(bound, LARGEST)
    block = block.astype(kind)
    n = len(block)
    low, span = np.full(n, -bound, np.int64), 2 * bound + 1
    above = np.zeros(n, np.int64)  # scores over the interval
    while True:
        width = -(-span // BINS)
        counts = _counts(candidates, dim, kind, ids, block, low, span, width)
        upto = above[:, None] + np.cumsum(counts, 1)
        short = upto[:, -1] < k  # fewer than k candidates: all are wanted
        at = np.where(short, BINS - 1, np.argmax(upto >= k, 1))
        above = np.where(at > 0, upto[np.arange(n), at - 1], above)
        low = (low.view(np.uint64) + (BINS - 1 - at).astype(np.uint64) * np.uint64(width)).view(np.int64)
        if width == 1:
            break
        span = width
    kth = np.where(short, np.iinfo(np.int64).min, low)
    ties = np.where(short, 0, k - above)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        equal: dict[int, np.ndarray] = {}

        def use(q, cand, scores, own):
            m = len(scores)
            i, j = np.nonzero((scores > kth[q:q + m, None]) & ~own)
            out.append((ids[q + i], cand[j], scores[i, j]))
            i, j = np.nonzero((scores == kth[q:q + m, None]) & ~own)
            for row in np.unique(i):
                have = np.concatenate([equal.get(q + row, np.empty(0, np.int64)), cand[j[i == row]]])
                equal[q + row] = np.sort(have)[:ties[q + row]]

        _scored(dim, kind, ids, block, use)(batches)
        out += [(np.full(len(v), ids[i]), v, np.full(len(v), kth[i])) for i, v in equal.items()]
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    d = candidates.mapInArrow(keep, "query_id long, vec_id long, score long")
    return d.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``is_query`` reads the column ``vec_id``."""
    spark: SparkSession = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vector_col, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("square")).orderBy("dim").collect()
    path = scratch_path(spark, "top")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for dim, largest in ((r["dim"], r["square"]) for r in dims if r["dim"]):
        here = rows.filter(F.size("v") == dim)
        asked = here.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
        asked = stored(asked, "queries")
        last = None
        while True:  # block after block in the order of identifiers
            more = asked if last is None else asked.filter(F.col("vec_id") > int(last))
            block = more.orderBy("vec_id").limit(BLOCK).select("vec_id", "v").toArrow()
            if not block.num_rows:
                break
            ids = block.column("vec_id").to_numpy()
            v = np.array(block.column("v").to_pylist(), np.int64).reshape(-1, dim)
            # |score| is at most the product of the two largest lengths
            found = _block_top_k(here, dim, int(np.ceil(largest)) + 1, ids, v, k)
            found = found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
            found.write.mode("append").parquet(path)  # a plan of its own for each block
            last = ids[-1]
            if len(ids) < BLOCK:
                break
    return spark.read.schema(schema).parquet(path)
