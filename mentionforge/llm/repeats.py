"""Windows that occur at two places of a corpus, found through shared minimisers.

The plan that substring dedup (words) and suffix-array dedup (bytes) share.
Equal windows have equal minimisers, so they meet where Spark deals runs of
windows out by minimiser:

1. each row's windows are grouped into runs that share a minimiser (no text moves);
2. minimisers that stand at one place in the corpus are dropped: their windows can't repeat;
3. equal runs are counted before anything else moves; a run with copies repeats throughout;
4. the text of one copy of every other run goes to its minimiser's bucket, where the
   operator's own method compares windows;
5. a minimiser with more than ``HOT`` different runs is not gathered: its windows are
   dealt out again by window fingerprint, with their text, and windows of one
   fingerprint are compared with each other;
6. the found windows go back to every copy of their run and, joined by row, to the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .storage import discard, keyed_texts, same_row, save

#: Most different runs, and most values in all of them, that a minimiser's bucket gathers.
HOT, HOT_VALUES = 256, 1 << 19
#: Windows of a hot minimiser that one task sorts, about.
HOT_TASK = 1 << 16
FOUND = "anchor long, rhash long, n int, runs array<struct<a:int,b:int>>"


def ids(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column("doc_id").take(pa.array(rows)), batch.column("th").take(pa.array(rows))]


class Unit:
    """What a window counts: bytes, or words. ``values`` of a slice of a batch, and ``cut``, the packed text of a run."""

    def __init__(self, window: int, gram: int, by_words: bool):
        self.window, self.gram, self.by_words = window, gram, by_words

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            return A.SYMBOLS[data], offsets
        starts, ends, rows = A.words(data, offsets)
        return A.word_values(data, starts, ends), rows

    def cut(self, text: bytes, runs: list) -> Iterator[bytes]:
        parts = text.split() if self.by_words else text
        for r in runs:
            part = parts[r["start"] : r["start"] + r["n"] + self.window - 1]
            yield b" ".join(part) if self.by_words else part


def scan(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("text"))
            for lo, hi in A.slices(offsets):
                r = A.minimiser_runs(*unit.values(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), unit.window, unit.gram)
                if len(r["row"]):
                    yield pa.RecordBatch.from_arrays(
                        [*ids(batch, r["row"] + lo), pa.array(r["anchor"]), pa.array(r["rhash"]), pa.array(r["start"].astype(np.int32)), pa.array(r["n"].astype(np.int32)), pa.array(r["inner"])],
                        names=["doc_id", "th", "anchor", "rhash", "start", "n", "inner"],
                    )

    return run


def cutter(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                runs = runs.as_py()
                out += [(r["anchor"], r["rhash"], r["n"], part) for r, part in zip(runs, unit.cut(text.as_py(), runs), strict=True)]
                if len(out) > 2000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    return run


def packed(rows: list[tuple]) -> pa.RecordBatch:
    a, h, n, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], names=["anchor", "rhash", "n", "body"])


def in_buckets(unit: Unit, compare: Callable, size: int = 1 << 18) -> Callable:
    """Rows arrive sorted by anchor; whole buckets are compared together, about ``size`` bytes at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        weight = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if held and weight >= size and row.anchor != held[-1].anchor:
                    yield found(held, compare)
                    held, weight = [], 0
                held.append(row)
                weight += len(row.body)
        if held:
            yield found(held, compare)

    def found(held: list, compare: Callable) -> pd.DataFrame:
        flags = compare([r.body for r in held], [r.n for r in held])
        out, at = [], 0
        for r in held:
            first, last = A.flag_runs(flags[at : at + r.n])
            at += r.n
            if len(first):
                out.append((r.anchor, r.rhash, r.n, [{"a": int(a), "b": int(b)} for a, b in zip(first, last, strict=True)]))
        return pd.DataFrame(out, columns=["anchor", "rhash", "n", "runs"])

    return run


PRINTS = ["anchor", "part", "rhash", "n", "h", "at", "first", "body"]


def fingerprints(unit: Unit) -> Callable:
    """Hot runs to packed windows, one row for each part of the fingerprint space: fingerprints, places, and the stretch
    of the run, from its unit ``first`` on, that these windows cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for row in pdf.itertuples(index=False):
                data = np.frombuffer(row.body, np.uint8)
                values, _ = unit.values(data, np.array([0, len(data)]))
                h = A.grams_hash(A.prefix_sums(values), unit.window)
                part = (h >> A.U(40)).astype(np.int64) % row.parts
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                pieces = [np.sort(p) for p in np.split(order, cuts)]
                bodies = unit.cut(row.body, [{"start": int(p[0]), "n": int(p[-1] - p[0]) + 1} for p in pieces])
                for places, body in zip(pieces, bodies, strict=True):
                    out.append((row.anchor, int(part[places[0]]), row.rhash, row.n, h[places].tobytes(), places.astype(np.int32).tobytes(), int(places[0]), body))
                    size += len(body) + 12 * len(places)
                if size > 1 << 22:
                    yield pd.DataFrame(out, columns=PRINTS)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=PRINTS)

    return run


class Windows:
    """The text of each window of some rows of packed windows."""

    def __init__(self, unit: Unit, rows: list):
        self.bodies = [r.body for r in rows]
        self.row = np.repeat(np.arange(len(rows)), [len(r.at) // 4 for r in rows])
        begin, end = [], []
        for r in rows:
            at = np.frombuffer(r.at, np.int32) - r.first
            if unit.by_words:
                gaps = np.flatnonzero(np.frombuffer(r.body, np.uint8) == 32)
                starts, ends = np.append(0, gaps + 1), np.append(gaps, len(r.body))
                begin.append(starts[at])
                end.append(ends[at + unit.window - 1])
            else:
                begin.append(at)
                end.append(at + unit.window)
        self.begin, self.end = np.concatenate(begin).tolist(), np.concatenate(end).tolist()

    def __getitem__(self, k: int) -> bytes:
        return self.bodies[self.row[k]][self.begin[k] : self.end[k]]


def sort_windows(unit: Unit) -> Callable:
    """Rows arrive sorted by (anchor, part); each group's windows are sorted by fingerprint, and those of one
    fingerprint are compared with the first of them. Two texts under one fingerprint are told apart."""

    def equal(rows: list) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(r.h, np.uint64) for r in rows])
        order = np.argsort(h, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])), len(h))
        texts, hit = Windows(unit, rows), np.zeros(len(h), bool)
        for k in np.flatnonzero(np.diff(cuts) > 1):
            group = order[cuts[k] : cuts[k + 1]]
            first = texts[group[0]]
            if all(texts[x] == first for x in group[1:]):
                hit[group] = True
            else:
                counts = Counter(texts[x] for x in group)
                hit[group] = [counts[texts[x]] > 1 for x in group]
        out, at = [], 0
        for r in rows:
            places = np.frombuffer(r.at, np.int32)
            own = places[hit[at : at + len(places)]]
            at += len(places)
            if len(own):
                cut = np.flatnonzero(np.diff(own) > 1)
                out.append((r.anchor, r.rhash, r.n, [{"a": int(a), "b": int(b)} for a, b in zip(own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)], strict=True)]))
        return pd.DataFrame(out, columns=["anchor", "rhash", "n", "runs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if held and (row.anchor, row.part) != (held[-1].anchor, held[-1].part):
                    yield equal(held)
                    held = []
                held.append(row)
        if held:
            yield equal(held)

    return run


def repeated_spans(docs: DataFrame, unit: Unit, compare: Callable, name: str) -> DataFrame:
    """doc_id, th, spans: the runs of window starts, in units, whose windows also start elsewhere.

    ``compare(bodies, counts)`` is the operator's method: for the packed runs of
    whole buckets it flags each window that has an equal in another place.
    """
    texts = keyed_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = save(texts.mapInArrow(scan(unit), f"doc_id {kind}, th long, anchor long, rhash long, start int, n int, inner boolean"), f"{name}-runs")
    shared = runs.groupBy("anchor").agg(F.count("*").alias("c"), F.max("inner").alias("i")).where("c > 1 or i").select("anchor")
    live = save(runs.join(shared.hint("merge"), "anchor"), f"{name}-live")

    each = live.groupBy("anchor", "rhash", "n").agg(F.count("*").alias("copies"), F.max("inner").alias("inner"), F.min(F.struct("doc_id", "th", "start")).alias("at"))
    each = save(each, f"{name}-each")
    several = each.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("windows"), F.sum(F.col("n") + unit.window - 1).alias("size"))
    counted = each.join(several.hint("merge"), "anchor")
    open_ = counted.where("kinds > 1 or copies = 1").withColumns({
        "hot": F.expr(f"kinds > {HOT} or size > {HOT_VALUES}"),
        "parts": F.expr(f"cast(1 + windows div {HOT_TASK} as int)"),
    })
    wanted = open_.select("at.*", F.struct("anchor", "rhash", "at.start", "n").alias("r")).groupBy("doc_id", "th").agg(F.collect_list("r").alias("runs"))
    sources = texts.join(wanted.hint("merge"), same_row(texts, wanted)).select(F.col("text").cast("binary").alias("text"), "runs")
    bodies = save(sources.mapInArrow(cutter(unit), "anchor long, rhash long, n int, body binary"), f"{name}-bodies")

    marks = open_.select("anchor", "rhash", "n", "hot", "parts", "copies")
    dealt = bodies.join(marks.hint("merge"), ["anchor", "rhash", "n"])
    cold = dealt.where("not hot").select("anchor", "rhash", "n", "body").repartition("anchor").sortWithinPartitions("anchor", "rhash", "n")
    cold_found = cold.mapInPandas(in_buckets(unit, compare), FOUND)
    hot = dealt.where("hot").select("anchor", "rhash", "n", "body", "parts")
    prints = hot.mapInPandas(fingerprints(unit), "anchor long, part int, rhash long, n int, h binary, at binary, first int, body binary")
    hot_found = prints.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInPandas(sort_windows(unit), FOUND)
    compared = cold_found.unionByName(hot_found).groupBy("anchor", "rhash", "n").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    whole = each.select("anchor", "rhash", "n", "copies")
    full = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    some = save(whole.join(compared.hint("merge"), ["anchor", "rhash", "n"], "left").withColumn("runs", F.when(F.col("copies") > 1, full).otherwise(F.col("runs"))).where("runs is not null").drop("copies"), f"{name}-found")
    discard(runs, each, bodies)
    back = live.select("doc_id", "th", "anchor", "rhash", "n", "start").join(some.hint("merge"), ["anchor", "rhash", "n"])
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    return back.select("doc_id", "th", moved.alias("spans")).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text as bytes, spans (null: none) for every row."""
    texts = keyed_texts(docs)
    return texts.join(spans.hint("merge"), same_row(texts, spans), "left").select(texts["doc_id"], F.col("text").cast("binary").alias("text"), "spans")


def long_type(df: DataFrame) -> str:
    return T.DataType.simpleString(df.schema["doc_id"].dataType)
