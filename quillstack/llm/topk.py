"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query of a block.  Global histograms of the scores locate
the k-th value of each query: the range of possible scores is cut into ``BINS`` bins, the bin that
holds the k-th score becomes the next range, and so on down to single values.  A last scoring keeps
what lies above that value and, of what equals it, the least ids that are still needed.  No task
sends more than k bins or k ties a query, however many candidates tie.

Scores are integer inner products of ``floor(scale * x)``.  Queries are streamed through the driver
in blocks of at most ``BLOCK`` vectors and broadcast; candidates are never shuffled.

Defined results: vectors that are null or hold a null, or whose scaled components are not all
finite, take no part, nor do rows without an id; vectors of different lengths are not compared; a
query's own row is any row with its id; repeated candidate rows hold a rank each; a query row that
is repeated as a whole counts once; scores beyond the range of a long are held to its ends; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path

BLOCK, BINS, ROWS = 2048, 512, 1024
LONG = (-(1 << 63), (1 << 63) - 1)


class Queries(NamedTuple):
    """A block of queries of one length, with the range that holds the k-th score of each."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray  #: first value of the range, as Python integers
    width: int  #: values in the range, the same for all
    above: np.ndarray  #: candidates above the range


def _usable(vector: Column, scale: float) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` as floats; whole numbers."""
    return np.floor(scale * values)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, exact, as longs."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.frompyfunc(int, 1, 1)
    product = exact(a).dot(exact(b).T)
    return np.frompyfunc(lambda x: min(max(x, LONG[0]), LONG[1]), 1, 1)(product).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], length: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, vectors)`` of the rows of that length, some at a time."""
    for b in batches:
        lists = b.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        rows = np.flatnonzero(sizes == length)
        if not len(rows):
            continue
        ids = b.column(0).to_numpy()
        values = lists.flatten().to_numpy()
        if len(rows) < len(sizes):
            values = values[np.repeat(sizes == length, sizes)]
        vectors = values.reshape(len(rows), length)
        for lo in range(0, len(rows), ROWS):
            yield ids[rows[lo : lo + ROWS]], scaled(vectors[lo : lo + ROWS], scale)


def _histogram(candidates: DataFrame, block, k: int, scale: float) -> DataFrame:
    """``(q, bin, n)`` of the scores within each query's range; of each task, only the bins that can hold the k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = block.value
        n, step = len(q.ids), max(1, q.width // BINS)
        counts = np.zeros(n * BINS, np.int64)
        for ids, vectors in _batches(batches, q.vectors.shape[1], scale):
            score = inner(q.vectors, vectors)
            inside = (score >= q.low[:, None]) & (ids != q.ids[:, None])
            at = score.view(np.uint64) - q.low.view(np.uint64)[:, None]  # the distance, without overflow
            inside &= at < np.uint64(q.width) if q.width < 1 << 64 else True
            row, col = np.nonzero(inside)
            counts += np.bincount(row * BINS + (at[row, col] // np.uint64(step)).astype(np.int64), minlength=n * BINS)
        counts = counts.reshape(n, BINS)
        higher = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        row, col = np.nonzero((counts > 0) & (higher < k))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(counts[row, col])], ["q", "bin", "n"])

    return candidates.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _refine(candidates: DataFrame, q: Queries, k: int, scale: float) -> Queries:
    """The next, narrower range of each query."""
    block = candidates.sparkSession.sparkContext.broadcast(q)
    upto = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))
    hist = _histogram(candidates, block, k, scale).withColumn("upto", upto)
    above = candidates.sparkSession.createDataFrame([(i, int(a)) for i, a in enumerate(q.above)], "q long, above long")
    found = hist.join(F.broadcast(above), "q").filter("upto + above >= %d" % k).groupBy("q").agg(F.max("bin").alias("bin"), F.min_by(F.col("upto") - F.col("n"), F.col("upto")).alias("more"))
    step = max(1, q.width // BINS)
    low, over = q.low.copy(), q.above.copy()
    for r in found.collect():  # one row a query of the block
        low[r["q"]] = int(q.low[r["q"]]) + r["bin"] * step
        over[r["q"]] += r["more"]
    block.unpersist()
    return q._replace(low=low, above=over, width=step)


def _select(candidates: DataFrame, q: Queries, k: int, scale: float) -> DataFrame:
    """``(query_id, rank, vec_id, score)``, now that ``low`` is the k-th value, or the least value if there are fewer."""
    block = candidates.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = block.value
        ties: list[np.ndarray] = [np.empty(0, np.int64)] * len(q.ids)
        for ids, vectors in _batches(batches, q.vectors.shape[1], scale):
            score = inner(q.vectors, vectors)
            other = ids != q.ids[:, None]
            row, col = np.nonzero((score > q.low[:, None]) & other)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids[col]), pa.array(score[row, col])], ["q", "vec_id", "score"])
            row, col = np.nonzero((score == q.low[:, None]) & other)
            for r in np.unique(row):
                ties[r] = np.sort(np.append(ties[r], ids[col[row == r]]))[: k - q.above[r]]
        row = np.repeat(np.arange(len(ties)), [len(t) for t in ties])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(ties)), pa.array(q.low[row])], ["q", "vec_id", "score"])

    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.mapInArrow(run, "q long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = candidates.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(q.ids)], "q long, query_id long")
    return ranked.join(F.broadcast(named), "q").select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of ``(ids, scaled vectors)`` of one length each; what waits on the driver is less than a block a length."""
    waiting: dict[int, list] = {}
    for r in queries.distinct().toLocalIterator():
        rows = waiting.setdefault(len(r["vector"]), [])
        rows.append((r["id"], r["vector"]))
        if len(rows) == BLOCK or sum(map(len, waiting.values())) >= 4 * BLOCK:
            yield _block(waiting.pop(len(r["vector"])), scale)
    for rows in waiting.values():
        yield _block(rows, scale)


def _block(rows: list, scale: float) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for i, _ in rows], np.int64), scaled(np.array([v for _, v in rows], float).reshape(len(rows), -1), scale)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``vectors`` for each row of ``queries``, without its own."""
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(_usable(F.col("vector"), scale) & F.col("id").isNotNull())
    candidates, queries = ready(vectors), ready(queries)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    largest = candidates.agg(F.max(norm)).first()[0] or 0.0
    path = shared_path(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, matrix in _blocks(queries, scale):
        # By Cauchy and Schwarz no score lies further from 0 than this.
        reach = float(np.sqrt((matrix**2).sum(axis=1).max(initial=0) * largest)) * (1 + 1e-9) + 1
        bits = next(b for b in range(1, 64) if b == 63 or reach < 2.0**b)
        low = np.full(len(ids), -(1 << bits), np.int64)
        width = 1 << (bits + 1)
        q = Queries(ids, matrix, low, width, np.zeros(len(ids), np.int64))
        while q.width > 1:
            q = _refine(candidates, q, k, scale)
        _select(candidates, q, k, scale).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
