"""Vector codes: codebooks of whole numbers, fitted and applied by tries over distinct parts of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import save
from .topk import exact_products

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Nodes of one depth that are held at once; labels that are sent to every task at most; copies of a label's sum beyond that.
NODES, LABELS, SALTS = 256, 100_000, 64


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """For each of the sorted ``rows`` how many leading dimensions it shares with the one before; -1 for the first."""
    same = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)
    return np.concatenate(([-1], same.sum(axis=1)))


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``entries`` (ties to the lower index) and its squared distance, for distinct rows in lexicographic order.

    The rows form a trie, a level for each dimension. It is walked depth first, NODES siblings
    at a time; a node's distances to all entries are its parent's and those of its own
    dimension, so rows with equal beginnings share them. Below the last branching what is
    left of a row is added at once.
    """
    n, depth = rows.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    shared = shared_prefixes(rows) if n else np.zeros(0, np.int64)

    def children(level: int, starts: np.ndarray, end: int, above: np.ndarray) -> Iterator[tuple]:
        """The nodes of ``level`` below those that begin at ``starts``, some at a time: (level, starts, end, distances)."""
        at = starts[0] + np.flatnonzero(shared[starts[0] : end] < level)
        for i in range(0, len(at), NODES):
            own = at[i : i + NODES]
            parent = np.searchsorted(starts, own, "right") - 1
            step = rows[own, level - 1][:, None] - entries[:, level - 1]
            yield level, own, int(at[i + NODES]) if i + NODES < len(at) else end, above[parent] + step * step

    walk = [iter([(0, np.zeros(1, np.int64), n, np.zeros((1, len(entries)), np.int64))])] if n else []
    while walk:
        node = next(walk[-1], None)
        if node is None:
            walk.pop()
            continue
        level, starts, end, sums = node
        if len(starts) == end - starts[0]:  # one row a node
            tail, there = rows[starts, level:], entries[:, level:]
            sums = sums + ((tail * tail).sum(axis=1)[:, None] - 2 * exact_products(tail, there) + (there * there).sum(axis=1))
            index[starts] = sums.argmin(axis=1)
            distance[starts] = sums.min(axis=1)
        else:
            walk.append(children(level + 1, starts, end, sums))
    return index, distance


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as rows of whole numbers."""
    flat = np.asarray(column.flatten()).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def in_order(rows: np.ndarray) -> np.ndarray:
    """The lexicographic order of ``rows``."""
    return np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))


def gather(books: list[np.ndarray]) -> Callable:
    """Per task and entry the weighted sums of the parts that are nearest to it, and their number under the dimension -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            part, count = np.asarray(batch.column("part")), np.asarray(batch.column("n"))
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                rows = matrix(batch.column("v").take(pa.array(at)))
                order = in_order(rows)
                rows, n = rows[order], count[at][order]
                entry, _ = nearest(rows, books[p])
                np.add.at(sums[p], entry, np.column_stack((n, rows * n[:, None])))
        for p, s in enumerate(sums):
            entry, column = np.nonzero(np.broadcast_to(s[:, :1] > 0, s.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), pa.array(column - 1, pa.int32()), pa.array(s[entry, column])], names=["part", "entry", "dim", "s"]
            )

    return run


def encode(books: list[np.ndarray]) -> Callable:
    """vec_id, label, code and error of each vector; a batch's equal parts are told apart first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"))
            codes, error = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
            for p, own in enumerate(np.split(rows, len(books), axis=1)):
                order = in_order(own)
                first = shared_prefixes(own[order]) < own.shape[1] if len(own) else np.zeros(0, bool)
                first[:1] = True
                entry, far = nearest(own[order][first], books[p])
                which = np.cumsum(first) - 1
                codes[order, p] = entry[which]
                error[order] += far[which]
            text = codes.tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
            )

    return run


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def whole_vectors(embeddings: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component, for vectors without null or non-finite components."""
    numbers = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", "label", numbers.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # squared distances of whole vectors stay below 2 ** 62
    limit = F.sqrt(F.lit(float(1 << 60)) / F.greatest(F.size("x"), F.lit(1)))
    fits = lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return rows.select("vec_id", "label", F.transform("x", fits).alias("v"))


def distinct_parts(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """part, v, n: every different part of each position and how many vectors have it, in lexicographic order."""
    pieces = F.array(*(F.struct(F.lit(p).alias("part"), F.slice("v", p * width + 1, width).alias("v")) for p in range(parts)))
    return vectors.select(F.inline(pieces)).groupBy("part", "v").agg(F.count("*").alias("n")).repartitionByRange("part", "v").sortWithinPartitions("part", "v")


def encode_vectors(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, labels: int = LABELS,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of ``embeddings`` (vec_id, embedding, label).

    Components become floor(scale * x); a vector is cut into ``parts`` equal parts. A
    position's codebook begins as that part of the ``entries`` (at most 256) vectors with
    the smallest ids (equal ids by vector, null ids last) and is refined ``rounds`` times: every part goes to the
    nearest entry, every entry becomes the floored mean of its parts. Rounds read the
    distinct parts with their numbers; the last assignment reads the vectors. Only codebooks and
    their sums pass through the driver: parts x entries x width numbers.

    Null vectors and those holding null or non-finite components are dropped. Repeated
    rows count as often as they occur, null ids and labels stay and null labels are one
    label; vectors of no components have error 0; an empty table gives an empty result; other
    columns are ignored. Vectors of different lengths, or of a length that ``parts`` doesn't
    divide, and components too large for exact distances in 64 bits are errors.
    """
    vectors = save(whole_vectors(embeddings, parts, scale), "vectors")
    spark = embeddings.sparkSession
    least, most = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    kind = {f.name: f.dataType for f in vectors.schema.fields}
    if least is None:
        shape = [("vec_id", kind["vec_id"]), ("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())]
        return spark.createDataFrame([], T.StructType([T.StructField(*f) for f in shape]))
    if least != most or least % parts:
        raise ValueError(f"vectors of {least} to {most} components can't be cut into {parts} equal parts")
    width = least // parts
    begin = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    first = np.array([r.v for r in begin], np.int64).reshape(len(begin), least)
    books = np.split(first, parts, axis=1)
    if width:
        pieces = save(distinct_parts(vectors, parts, width), "parts")
        for _ in range(rounds):
            found = pieces.mapInArrow(gather(books), "part int, entry int, dim int, s long").groupBy("part", "entry", "dim").agg(F.sum("s").alias("s"))
            sums = np.zeros((parts, len(first), width + 1), np.int64)
            for p, e, d, s in found.collect():  # parts x entries x (width + 1) numbers at most
                sums[p, e, d + 1] = s
            books = [np.where(s[:, :1] > 0, s[:, 1:] // np.maximum(s[:, :1], 1), b) for s, b in zip(sums, books, strict=True)]
    shape = T.StructType([T.StructField("vec_id", kind["vec_id"]), T.StructField("label", kind["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = save(vectors.mapInArrow(encode(books), shape), "codes")
    totals = save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    if totals.count() <= labels:
        both = coded.join(totals.hint("broadcast"), same)
    else:  # a label with many vectors is dealt out over copies of its sum
        salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = coded.withColumn("of_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), same & (F.col("of_salt") == F.col("salt")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
