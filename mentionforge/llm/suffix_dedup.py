"""Suffix-array dedup: difference-cover suffix sorting over buckets of byte runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .repeats import Unit, long_type, repeated_spans, with_spans

WINDOW, GRAM = 400, 64
#: The pipeline's window: below the shortest passage of over 50 words (271 bytes at scale 0.1).
STAGE_WINDOW, STAGE_GRAM = 240, 32


def names_of(a: np.ndarray, b: np.ndarray, c: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the triples (a, b, c) and the name of each, from 1: equal triples share a name, names sort as triples do."""
    if top < 1 << 21:
        key = (a << 42) | (b << 21) | c
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((c, b, a))
        new = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate(([1], 1 + np.cumsum(new)))
    return order, rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The sorted suffixes of ``s`` (numbers from 1) by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: list(s[i:])), np.int64)
    s = np.concatenate((s, np.zeros(3, np.int64)))
    top = int(s.max())
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    extra = n0 - n1  # n % 3 == 1: one empty sampled suffix, so that each mod 0 suffix has its neighbour
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    order, name = names_of(s[sample], s[sample + 1], s[sample + 2], top)
    if name.max() < len(sample):
        order = suffix_array(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]

    rest = np.arange(0, n, 3)
    if n < 1 << 31 and top < 1 << 31:
        rest = rest[np.argsort((s[rest] << 32) | rank[rest + 1], kind="stable")]
    else:
        rest = rest[np.lexsort((rank[rest + 1], s[rest]))]
    # how many sampled suffixes come before each remaining one
    is_one = sorted_sample % 3 == 1
    ones, twos = sorted_sample[is_one], sorted_sample[~is_one]
    before = np.searchsorted((s[ones] << 32) | rank[ones + 1], (s[rest] << 32) | rank[rest + 1])
    pair = s[:-1] * (top + 1) + s[1:]
    key_two, key_rest = (pair[twos], rank[twos + 2]), (pair[rest], rank[rest + 2])
    if top < 1 << 20 and n < 1 << 22:
        before = before + np.searchsorted((key_two[0] << 22) | key_two[1], (key_rest[0] << 22) | key_rest[1])
    else:  # too wide for one number: name the pairs first
        _, name = np.unique(np.concatenate((key_two[0], key_rest[0])), return_inverse=True)
        before = before + np.searchsorted((name[: len(twos)] << 32) | key_two[1], (name[len(twos) :] << 32) | key_rest[1])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sorted_sample
    return out


def adjacent_prefixes(window: int) -> Callable:
    """Flags the windows of packed byte strings that occur twice: sort all suffixes, compare neighbours' prefixes."""

    def compare(bodies: list[bytes], counts: list[int]) -> np.ndarray:
        lengths = np.array([len(b) + 1 for b in bodies])
        begin = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        s = data.astype(np.int64) + 2
        s[begin + lengths - 1] = 1  # ends of strings sort before every byte
        counts = np.array(counts)
        first = np.cumsum(counts) - counts
        starts = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(begin, counts)
        index = np.full(len(s), -1, np.int64)
        index[starts] = np.arange(len(starts))
        sorted_starts = index[suffix_array(s)]
        sorted_starts = sorted_starts[sorted_starts >= 0]
        sums = A.prefix_sums(A.SYMBOLS[data])
        at = starts[sorted_starts]
        prefix = A.spans_hash(sums, at, at + window)
        same = prefix[1:] == prefix[:-1]
        flags = np.zeros(len(starts), bool)
        flags[sorted_starts[1:][same]] = True
        flags[sorted_starts[:-1][same]] = True
        return flags

    return compare


def remove(text: bytes, spans, window: int) -> tuple[bytes, int, int]:
    """What is left of ``text``, the bytes removed and the spans they formed."""
    if not spans:
        return text, 0, 0
    gone = A.covered([(s["a"], s["b"]) for s in spans], window)
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), sum(b - a for a, b in gone), len(gone)


def digests(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                text = text.as_py()
                kept, removed, n = remove(text, spans.as_py(), window)
                rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_byte_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th, spans: first and last start, in bytes, of the runs of windows that occur twice."""
    return repeated_spans(docs, Unit(window, gram, False), adjacent_prefixes(window), "suffix")


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of the UTF-8 text goes if a ``window``-byte string that covers it starts
    at a second place of the corpus, the same row included; strings are judged on
    the input. A null or empty text has no bytes (the digest of nothing); repeated
    rows count as places of their own and give a row each; a null doc_id stays
    null; an empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_byte_spans(docs, window, gram)
    return with_spans(docs, spans).mapInArrow(digests(window), f"doc_id {long_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_documents(docs: DataFrame, window: int = STAGE_WINDOW, gram: int = STAGE_GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut out of text and n_chars (if it is a column) set anew.

    ``window`` is shorter than that of ``dedup_suffixes``: passages of little more
    than 50 words have under 300 bytes and never fill a window of 400. The first
    place of a repeated string goes as well, as in ``dedup_suffixes``. Bytes that a
    cut leaves as half a character are dropped. Null texts stay null and their
    n_chars as it was; empty texts stay empty; repeated rows are places of their own
    and are cut alike; an empty table gives an empty one. Other columns, whatever
    their names, pass through.
    """
    spans = repeated_byte_spans(docs, window, gram)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or s is None or not len(s) else remove(t.encode(), list(s), window)[0].decode("utf-8", "ignore"))

    # the whole row travels in one column, so that no name of it can clash
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    joined = rows.join(spans.hint("merge"), F.col("row.doc_id").eqNullSafe(spans["doc_id"]) & (rows["th"] == spans["th"]), "left")
    text = F.when(spans["spans"].isNull(), F.col("row.text")).otherwise(cut("row.text", spans["spans"]))
    cut_rows = joined.select("row", text.alias("text"))
    fields = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return cut_rows.select(*(fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
