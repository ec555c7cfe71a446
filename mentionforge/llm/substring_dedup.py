"""Substring dedup: super-k-mer partitioning of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .repeats import Unit, long_type, repeated_spans, with_spans

WINDOW, GRAM = 35, 8


def count_windows(window: int) -> Callable:
    """Flags the windows of packed word strings that occur twice, by sorting the windows.

    Words become whole numbers, equal for equal words only. Windows are sorted
    by a hash of their numbers; neighbours with one hash are then compared
    number by number, so the count is exact.
    """

    def compare(bodies: list[bytes], counts: list[int]) -> np.ndarray:
        codes: dict[bytes, int] = {}
        numbers, starts, at = [], [], 0
        for body, n in zip(bodies, counts, strict=True):
            parts = body.split(b" ")
            numbers += [codes.setdefault(w, len(codes)) for w in parts]
            starts.append(np.arange(at, at + n))
            at += len(parts)
        word, start = np.array(numbers, np.int64), np.concatenate(starts)
        h = A.grams_hash(A.prefix_sums(A.mix(word.astype(A.U) + A.U(1))), window)
        h = h[start]
        order = np.argsort(h, kind="stable")
        flags = np.zeros(len(start), bool)
        near = np.flatnonzero(h[order][1:] == h[order][:-1])
        if len(near):
            a, b = start[order[near]], start[order[near + 1]]
            same = np.ones(len(near), bool)
            for k in range(window):
                same &= word[a + k] == word[b + k]
            if not same.all():  # two windows share a hash: sort the windows themselves
                table = np.lib.stride_tricks.sliding_window_view(word, window)[start]
                _, inverse, times = np.unique(table, axis=0, return_inverse=True, return_counts=True)
                return times[inverse.ravel()] > 1
            flags[order[near]] = True
            flags[order[near + 1]] = True
        return flags

    return compare


def kept_words(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().split()
                total.append(len(words))
                gone = 0
                if spans.is_valid:
                    for a, b in reversed(A.covered([(s["a"], s["b"]) for s in spans.as_py()], window)):
                        gone += b - a
                        del words[a:b]
                removed.append(gone)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_word_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, th, spans: first and last start, in words, of the runs of windows that occur twice."""
    return repeated_spans(docs, Unit(window, gram, True), count_windows(window), "superkmer")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it starts at a second
    place of the corpus. Words are separated by space and 0x09-0x0D. A null or
    empty text has no words (the digest of nothing); repeated rows count as places
    of their own and give a row each; a null doc_id stays null; an empty table
    gives an empty result; other columns are ignored whatever their names.
    """
    spans = repeated_word_spans(docs, window, gram)
    return with_spans(docs, spans).mapInArrow(kept_words(window), f"doc_id {long_type(docs)}, n_words long, n_removed long, kept_sha256 string")
