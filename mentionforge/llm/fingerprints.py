"""Document fingerprints: context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .storage import save

#: The 64 signs of a signature.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SIGN = np.frombuffer(SIGNS.encode(), np.uint8)
#: Bytes that the rolling hash sees; the least block; most signs at a block size.
ROLL, LEAST_BLOCK, SIGNATURE = 7, 4, 64


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the ROLL bytes that end there (fewer at the start of the data)."""
    padded = np.concatenate((np.zeros(ROLL, A.U), A.SYMBOLS[data]))
    out = np.zeros(len(data), A.U)
    for k in range(ROLL):
        out += padded[ROLL - k : len(padded) - k] * A.mix(np.array([k + 1], A.U))[0]
    return A.mix(out)


def signature(sums: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """One sign for each chunk between boundaries, the rest after the last included; the last sign
    stands for all that is left once SIGNATURE - 1 chunks are taken."""
    cuts = ends[: SIGNATURE - 1]
    begin = np.concatenate((np.zeros(1, np.int64), cuts))
    end = np.append(cuts, n)
    full = end > begin
    h = A.spans_hash(sums, begin[full], end[full])
    return SIGN[(h >> A.U(58)).astype(np.int64)]


def fingerprint(text: bytes) -> str:
    """``block:signs:signs`` at the block size and twice it; ``4::`` for an empty text.

    A chunk ends where the rolling hash is 0 modulo the block size, a power of two,
    so boundaries depend on the bytes around them only and those of twice the size
    are among them. The size starts where about SIGNATURE chunks are expected and
    halves while less than half as many appear.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    roll = rolling(data)
    block = LEAST_BLOCK
    while block * SIGNATURE < n:
        block *= 2
    ends = np.flatnonzero((roll & A.U(LEAST_BLOCK - 1)) == 0)
    levels = roll[ends]
    while True:
        own = ends[(levels & A.U(block - 1)) == 0] + 1
        if block == LEAST_BLOCK or len(own) >= SIGNATURE // 2:
            break
        block //= 2
    double = ends[(levels & A.U(2 * block - 1)) == 0] + 1
    sums = A.prefix_sums(A.SYMBOLS[data])
    return f"{block}:{signature(sums, own, n).tobytes().decode()}:{signature(sums, double, n).tobytes().decode()}"


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Least insertions and deletions between pairs of signatures of up to 64 signs.

    Bit-parallel over a whole batch: one 64-bit word a pair holds a column of the
    longest-common-subsequence table, and each step takes one sign of b.
    """
    la, lb = (np.array([len(x) for x in side]) for side in (a, b))
    wide = [np.frombuffer("".join(x.ljust(SIGNATURE, pad) for x in side).encode(), np.uint8).reshape(-1, SIGNATURE) for side, pad in ((a, "\0"), (b, "\1"))]
    masks = np.zeros((len(a), 128), A.U)
    row = np.arange(len(a))
    for k in range(SIGNATURE):
        masks[row, wide[0][:, k]] |= A.U(1) << A.U(k)
    masks[:, :2] = 0
    v = np.full(len(a), ~A.U(0), A.U)
    for k in range(SIGNATURE):
        m = masks[row, wide[1][:, k]]
        u = v & m
        v = (v + u) | (v - u)
    common = np.bitwise_count(~v).astype(np.int64)
    return la + lb - 2 * common


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: 1 less the edit distance over both lengths at the
    compatible block size that fits best, 0 where the sizes are more than a factor two apart."""
    out = np.zeros(len(a))
    left, right, at = [], [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[k] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = (z.split(":") for z in (x, y))
        bx, by = int(bx), int(by)
        for p, q in ((x1, y1), (x2, y2)) if bx == by else ((x2, y1),) if by == 2 * bx else ((x1, y2),) if bx == 2 * by else ():
            if p and q:
                left.append(p)
                right.append(q)
                at.append(k)
    if at:
        total = np.array([len(p) + len(q) for p, q in zip(left, right, strict=True)])
        np.maximum.at(out, at, 1 - edit_distances(left, right) / total)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by as many of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive by bucket in document order, with the next bucket's first document behind each bucket."""
        held = None
        for pdf in batches:
            rows, held = ([held] if held else []) + list(pdf.itertuples(index=False)), None
            out = []
            prints: dict[str, str] = {}

            def of(text: str, prints=prints) -> str:
                if text not in prints:
                    prints[text] = fingerprint(text.encode())
                return prints[text]

            for a, b in zip(rows, rows[1:], strict=False):
                if not a.guest:
                    new = edited(a.text, b.text)
                    out.append((a.doc_id, len(a.text), hashlib.sha256(new.encode()).hexdigest(), of(a.text), fingerprint(new.encode()), of(b.text)))
            if rows:
                held = rows[-1]
            if out:
                i, n, sha, own, other, nxt = map(list, zip(*out, strict=True))
                yield pd.DataFrame({"doc_id": pd.array(i, "Int64") if kind == "bigint" else i, "n_chars": n, "edited_sha256": sha, "fingerprint": own, "edited_fingerprint": other, "near_edited": likeness(own, other), "near_next": likeness(own, nxt)})

    return run


def fingerprint_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of its edited text, one row a row.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (likeness of its fingerprint to the edited text's and
    to the next document's, 0 to 1; equal fingerprints give 1). The next document
    is the next in ascending (doc_id, text), null ids first and null texts as empty;
    after the last comes the first, so a single document follows itself. Repeated
    rows follow each other and give a row each; an empty table gives an empty
    result; other columns are ignored.

    Documents are dealt out by range of doc_id; only the first of each range also
    travels to the range before it.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bounds from quantiles of the ids: at most n numbers
    cuts = sorted(set(texts.select(F.col("doc_id").cast("double").alias("d")).where("d is not null").approxQuantile("d", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    edges = F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>")
    bucket = F.coalesce(F.size(F.filter(edges, lambda e: e < F.col("doc_id").cast("double"))), F.lit(0))
    dealt = texts.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket)).withColumn("guest", F.lit(False))
    first = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    heads = save(first.select("bucket", "f.*"), "heads")
    filled = [r.bucket for r in heads.select("bucket").orderBy("bucket").collect()]  # at most n numbers
    if filled:
        before = F.create_map(*(F.lit(x) for k, b in enumerate(filled) for x in (b, filled[k - 1])))
        guests = heads.select("doc_id", "text", before[F.col("bucket")].alias("bucket"), F.lit(True).alias("guest"))
        dealt = dealt.unionByName(guests)
    # one bucket a partition; a guest sorts behind its hosts
    placed = dealt.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")
    return placed.mapInPandas(compare_neighbours(kind), f"doc_id {kind}, {FIELDS}")
