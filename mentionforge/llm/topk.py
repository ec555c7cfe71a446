"""Exact top-k search: distributed histogram selection over integer inner products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import save

SCALE = 1024
#: Queries that a pass holds (the bound on what is broadcast), bins of a histogram, rows scored at once.
BLOCK, BINS, ROWS = 1024, 1024, 2048


def vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number matrix) for each vector length in the batch; vectors that are null or hold nulls or non-finite numbers are left out."""
    column = batch.column("embedding")
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())) if len(column) else column.values
    numbers = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    begin = np.cumsum(lengths) - lengths
    there = np.asarray(column.is_valid()) & np.asarray(batch.column("vec_id").is_valid())
    ids = batch.column("vec_id").fill_null(0).to_numpy()
    for n in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == n))
        part = numbers[begin[rows][:, None] + np.arange(n)]
        good = np.isfinite(part).all(axis=1)
        yield ids[rows[good]], np.floor(scale * part[good])


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as whole numbers: in floats while they hold every sum, else in 64-bit integers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Queries:
    """A block of queries of one length, with the score range in which each still looks for its k-th score."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, scale: int):
        self.ids, self.matrix, self.scale = ids, matrix, scale

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, scores of all queries, which pairs count) for some rows at a time."""
        for batch in batches:
            for ids, matrix in vectors(batch, self.scale):
                if matrix.shape[1] == self.matrix.shape[1]:
                    for at in range(0, len(ids), ROWS):
                        own = ids[at : at + ROWS]
                        yield own, exact_products(self.matrix, matrix[at : at + ROWS]), self.ids[:, None] != own


def minmax(q: Queries) -> Callable:
    """Per query the least and greatest score and the number of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(q.ids)
        least, most, count = np.full(n, 1 << 62), np.full(n, -(1 << 62)), np.zeros(n, np.int64)
        for _, scores, counts in q.scored(batches):
            least = np.minimum(least, np.where(counts, scores, 1 << 62).min(axis=1, initial=1 << 62))
            most = np.maximum(most, np.where(counts, scores, -(1 << 62)).max(axis=1, initial=-(1 << 62)))
            count += counts.sum(axis=1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least[at]), pa.array(most[at]), pa.array(count[at])], names=["q", "least", "most", "n"])

    return run


def histogram(q: Queries, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> Callable:
    """Counts of scores by bin above each query's ``low``; scores outside its range aren't counted, nor are queries whose range is one score."""
    open_ = (high > low)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q.ids) * BINS, np.int64)
        for _, scores, counts in q.scored(batches):
            bins = (scores - low[:, None]) // width[:, None]
            ok = counts & open_ & (scores >= low[:, None]) & (scores <= high[:, None])
            total += np.bincount((np.arange(len(q.ids))[:, None] * BINS + bins)[ok], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // BINS), pa.array(at % BINS), pa.array(total[at])], names=["q", "bin", "c"])

    return run


def best(q: Queries, kth: np.ndarray, ties: np.ndarray) -> Callable:
    """Every pair above its query's k-th score, and of those that equal it the least ids that a batch can add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores, counts in q.scored(batches):
            row, col = np.nonzero(counts & (scores > kth[:, None]))
            equal_row, equal_col = np.nonzero(counts & (scores == kth[:, None]))
            order = np.lexsort((ids[equal_col], equal_row))
            equal_row, equal_col = equal_row[order], equal_col[order]
            place = np.arange(len(order)) - np.searchsorted(equal_row, equal_row)
            few = place < ties[equal_row]
            row, col = np.append(row, equal_row[few]), np.append(col, equal_col[few])
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[row]), pa.array(ids[col]), pa.array(scores[row, col])], names=["query_id", "vec_id", "score"])

    return run


def select_block(rows: DataFrame, q: Queries, k: int) -> DataFrame:
    """The k best of each query of one block: refine histograms until each bin is one score, then filter."""
    n = len(q.ids)
    seen = rows.mapInArrow(minmax(q), "q long, least long, most long, n long").groupBy("q").agg(F.min("least"), F.max("most"), F.sum("n"))
    low, high, want = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    for i, a, b, c in seen.collect():  # one row a query of the block
        low[i], high[i], want[i] = a, b, min(k, c)
    while (high > low).any():
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        bins = rows.mapInArrow(histogram(q, low, high, width), "q long, bin long, c long").groupBy("q", "bin").agg(F.sum("c").alias("c"))
        above = F.sum("c").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        need = F.array(*(F.lit(int(x)) for x in want))
        # the first bin from the top that reaches the wanted count holds the k-th score
        hit = bins.withColumns({"upto": above, "need": F.get(need, F.col("q").cast("int"))}).where("upto >= need and upto - c < need")
        for i, b, upto, c in hit.select("q", "bin", "upto", "c").collect():
            low[i], high[i], want[i] = low[i] + b * width[i], min(high[i], low[i] + (b + 1) * width[i] - 1), want[i] - (upto - c)
    found = rows.mapInArrow(best(q, low, want), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``embeddings`` (vec_id, embedding) with the
    highest integer inner product with each row of ``queries`` (the same columns).

    Components x become floor(scale * x). Equal scores go to the smaller vec_id;
    fewer candidates give fewer rows. Rows with the query's own vec_id aren't its
    candidates, nor are vectors of another length. Null vectors, vectors holding
    null or non-finite components and null ids take no part. A vec_id that repeats
    among the queries asks once, with its least vector; repeated candidates count
    as often as they occur. Empty tables give an empty result; other columns are
    ignored. Scores are held in 64 bits: components must be small enough for the sum of products of floor(scale * x)
    to fit, beyond which scores are undefined. Queries go in blocks of BLOCK, each held by every task and written out when it
    is done; candidates are never gathered.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    asked = asked.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    blocks = []
    held: list = []

    def flush() -> None:
        if held:
            q = Queries(np.array([r.vec_id for r in held], np.int64), np.floor(scale * np.array([r.embedding for r in held], np.float64).reshape(len(held), held[0].dim)), scale)
            blocks.append(save(select_block(rows, q, k), "topk"))
            held.clear()

    for r in asked.orderBy("dim", "vec_id").toLocalIterator():  # a partition of queries at a time
        if held and (len(held) == BLOCK or held[0].dim != r.dim):
            flush()
        held.append(r)
    flush()
    if not blocks:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
        return embeddings.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, blocks)
