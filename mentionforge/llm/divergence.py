"""Source divergence: how the words of each source differ from those of its language and of the other sources."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dictionary import small_or_shuffled
from .arrays import text_buffers
from .storage import save

MIN_DOCS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: A block of documents: at most so many documents (two bytes tell them apart) and bytes, one longer document alone.
BLOCK_DOCS, BLOCK_BYTES = 32_768, 32 << 20
#: Counts that a task holds before it passes them on; numbers of a matrix; rows of (source, term) that are compared in one task; sources compared at once.
HELD, CELLS, BUCKET, SOURCES = 1_000_000, 4_000_000, 50_000, 256
#: Postings that are unfolded at once, about.
STEP = 500_000
#: Letters A-Z, a-z and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CHUNKS = pa.schema([("block", pa.int64()), ("chunk", pa.binary()), ("data", pa.binary())])
TERMS = pa.schema([("block", pa.int64()), ("terms", pa.binary()), ("data", pa.binary())])
#: A document of a block, and how often it holds the chunk; larger counts take several postings.
POSTING, MOST = np.dtype([("doc", "<u2"), ("n", "u1")]), 255


def chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as rows: each different white-space chunk of a block with its postings, which tell the documents
    of the block that hold it and how often. One row of a block, its header, has its documents' langs and sources as JSON in
    place of postings; its chunk is a blank, which no chunk holds, and the block's number, so that headers spread."""
    blocks, part = count(), TaskContext.get().partitionId() << 32
    texts, langs, sources, size = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        block = part | next(blocks)
        words = pc.ascii_split_whitespace(pa.concat_arrays(texts))
        texts.clear()
        per_doc, flat = np.diff(np.asarray(words.offsets)), words.flatten()
        del words
        flat = flat.dictionary_encode()
        chunks, empty = flat.dictionary.cast(pa.binary()), flat.dictionary.index("").as_py()
        # by chunk, then by document; white space at the ends of a text leaves empty pieces
        key = np.asarray(flat.indices).astype(np.int64)
        del flat
        key <<= 16
        key |= np.repeat(np.arange(len(langs), dtype=np.uint16), per_doc)
        key = key if empty < 0 else key[key >> 16 != empty]
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        n, key = np.diff(np.append(first, len(key))), key[first]
        times = -(-n // MOST)
        last = np.cumsum(times) - 1
        full = np.full(int(times.sum()), MOST)
        full[last] = n - (times - 1) * MOST
        postings = np.empty(len(full), POSTING)
        postings["doc"], postings["n"] = np.repeat(key & 0xFFFF, times), full
        ends = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(key >> 16, times), minlength=len(chunks)))))
        for lo in range(0, len(chunks), 10_000):
            some, own = chunks.slice(lo, 10_000), ends[lo : lo + 10_001]
            at = pa.py_buffer(((own - own[0]) * POSTING.itemsize).astype(np.int32))
            rows = pa.Array.from_buffers(pa.binary(), len(some), [None, at, pa.py_buffer(postings[own[0] : own[-1]].tobytes())])
            rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), some, rows], schema=CHUNKS)
            yield rows if not lo <= empty < lo + len(some) else rows.filter(pc.not_equal(some, b""))
        yield pa.RecordBatch.from_pylist([{"block": block, "chunk": b" %d" % block, "data": json.dumps([langs, sources]).encode()}], schema=CHUNKS)
        size = 0
        for held in (texts, langs, sources):
            held.clear()

    for batch in batches:
        column, begun = batch.column("text").cast(pa.string()), 0
        for i, (width, lang, source) in enumerate(zip(*(c.to_pylist() for c in (pc.binary_length(column), batch.column("lang"), batch.column("source"))), strict=True)):
            if langs and (len(langs) == BLOCK_DOCS or size + width > BLOCK_BYTES):
                texts.append(column.slice(begun, i - begun))
                yield from flush()
                begun = i
            langs.append(lang)
            sources.append(source)
            size += width
        texts.append(column.slice(begun))
    if langs:
        yield from flush()


def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms, joined by blanks, in place of chunks, from rows in the chunks' order: a chunk's rows stand together, so each
    is cut up once. Chunks without terms go; a header has null terms."""
    last, terms = None, b""
    for batch in batches:
        found, keep = [], []
        for i, chunk in enumerate(batch.column("chunk").to_pylist()):
            if chunk.startswith(b" "):
                keep.append(i)
                found.append(None)
                continue
            if chunk != last:
                last, terms = chunk, b" ".join(TERM.findall(chunk.translate(LOWER)))
            if terms:
                keep.append(i)
                found.append(terms)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("block").take(at), pa.array(found, pa.binary()), batch.column("data").take(at)], schema=TERMS)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that stand together and agree on ``keys``, as one table each."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        edges = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and rows[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = rows[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys, ascending, and the sums of their values."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], *(np.add.reduceat(v[order], first) for v in values)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, docs (documents of the language with the term), sources: a line for each source, its name as JSON, a tab and
    its occurrences; summed over the blocks of a task. JSON holds neither tabs nor line ends as they are."""
    terms: dict[bytes, int] = {}
    groups: dict[tuple, int] = {}
    held, size = [], 0

    def drain(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs = list(dict.fromkeys(lang for lang, _ in groups))
        group = key & 0xFFFFFFFF
        lang = np.array([langs.index(x) for x, _ in groups], np.int64)[group]
        order = np.lexsort((lang, key >> 32))
        term, lang, docs = (key >> 32)[order], lang[order], docs[order]
        names = [f"{json.dumps(source)}\t" for _, source in groups]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))))
        edges = np.append(first, len(term))
        total = np.add.reduceat(docs, first)
        words, langs = pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(langs, pa.string())
        group, n = group[order], n[order]
        for lo in range(0, len(first), 50_000):
            at, own = first[lo : lo + 50_000], edges[lo : lo + 50_001]
            some = slice(own[0], own[-1])
            entries = [f"{names[g]}{x}" for g, x in zip(group[some].tolist(), n[some].tolist(), strict=True)]
            ends = (own - own[0]).tolist()
            sources = ["\n".join(entries[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[at])), words.take(pa.array(term[at])), pa.array(total[lo : lo + 50_000]), pa.array(sources, pa.string())], names=["lang", "term", "docs", "sources"])

    for table in groups_of(batches, ["block"]):
        langs, sources = json.loads(table.filter(table["terms"].is_null())["data"][0].as_py())
        group = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
        rows = table.filter(table["terms"].is_valid())
        column = pc.split_pattern(rows["terms"].combine_chunks().cast(pa.string()), " ")
        flat = column.flatten().dictionary_encode()
        own = np.array([terms.setdefault(t.encode(), len(terms)) for t in flat.dictionary.to_pylist()], np.int64)
        term, per_row = own[np.asarray(flat.indices)] if len(flat) else own, np.diff(np.asarray(column.offsets)) if len(column) else own
        data, ends = text_buffers(rows["data"].combine_chunks())
        postings, ends = data.view(POSTING), ends // POSTING.itemsize
        del table, column, flat
        order = np.argsort(term, kind="stable")
        term, row = term[order], np.repeat(np.arange(len(per_row)), per_row)[order]
        wide = np.diff(ends)
        upto, lo = np.cumsum(wide[row]), 0
        while lo < len(row):  # each term of a row meets each posting of it; all rows of a term at once, so that a document counts once
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP)))
            hi = int(np.searchsorted(term, term[hi - 1], side="right"))
            some = row[lo:hi]
            each = wide[some]
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - ends[some], each)
            key, n = summed(np.repeat(term[lo:hi], each) << 32 | postings["doc"][at], postings["n"][at].astype(np.int64))
            lo = hi
            key, n, docs = summed(key >> 32 << 32 | group[key & 0xFFFFFFFF], n, np.ones(len(key), np.int64))
            held.append((key, n, docs))
            size += len(key)
        if size > 2 * HELD:
            held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > HELD:
                yield from drain(*held[0])
                held, size, terms, groups = [], 0, {}, {}
    if size:
        yield from drain(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, lang_n, one: occurrences of the terms that ``least`` documents of a language hold, in each of its
    sources and in all; ``one`` is 1 in one row of a term."""
    chunks = docs.mapInArrow(chunk_counts, "block long, chunk binary, data binary")
    cut = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(tokenise, "block long, terms binary, data binary")
    counted = cut.repartition("block").sortWithinPartitions("block").mapInArrow(count_terms, "lang string, term string, docs long, sources string")
    of_term = Window.partitionBy("lang", "term")
    kept = counted.withColumn("lang_docs", F.sum("docs").over(of_term)).where(F.col("lang_docs") >= least)
    each = kept.select("lang", "term", F.explode(F.split("sources", "\n")).alias("s"))
    said, n = F.substring_index("s", "\t", 1), F.substring_index("s", "\t", -1).cast("long")
    found = each.select("lang", "term", said.alias("said"), n.alias("n")).groupBy("lang", "term", "said").agg(F.sum("n").alias("n"))
    # most names are the letters between their quotes
    name = F.when(F.contains("said", F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), "said", F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.expr("substring(said, 2, length(said) - 2)"))
    found = found.select("lang", "term", name.alias("source"), "n")
    one = (F.min("source").over(of_term) == F.col("source")).cast("int")
    return found.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), one.alias("one"))


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value: for two sources of a language, a before b, the differences of their chances summed over the
    terms of a bucket. Rows: lang, bucket, source, term, p; those without a term give the chance of terms that a source lacks."""
    for table in groups_of(batches, ["lang", "bucket"]):
        lang = table["lang"][0].as_py()
        absent = table.filter(table["term"].is_null()).sort_by("source")
        sources, base = absent["source"].to_pylist(), np.asarray(absent["p"])
        place = {s: i for i, s in enumerate(sources)}
        present = table.filter(table["term"].is_valid())
        who = np.array([place[s] for s in present["source"].to_pylist()], np.int64)
        term = np.asarray(present["term"].combine_chunks().dictionary_encode().indices).astype(np.int64) if len(present) else np.zeros(0, np.int64)
        p = np.asarray(present["p"])
        order = np.argsort(term, kind="stable")
        who, term, p = who[order], term[order], p[order]
        step = max(1, CELLS // max(1, len(sources)))
        for lo in range(0, len(sources), SOURCES):
            some = np.arange(lo, min(len(sources), lo + SOURCES))
            total = np.zeros((len(some), len(sources)), np.int64)
            for first in range(0, int(term.max(initial=-1)) + 1, step):
                a, b = np.searchsorted(term, [first, first + step])
                chances = np.repeat(base[:, None], int(term[b - 1]) + 1 - first, axis=1)
                chances[who[a:b], term[a:b] - first] = p[a:b]
                for i, s in enumerate(some):
                    total[i, s + 1 :] += np.abs(chances[s + 1 :] - chances[s]).sum(axis=1)
            for i, s in enumerate(some):
                others = sources[s + 1 :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(others), pa.string()), pa.array([sources[s]] * len(others), pa.string()), pa.array(others, pa.string()), pa.array(total[i, s + 1 :])], names=["lang", "a", "b", "value"]
                )


def chance(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)), in decimals, as UNIT * n passes 64 bits."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.when(total + SMOOTHING * terms > 0, F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (whole(n) + SMOOTHING), whole(total + SMOOTHING * terms)) + 1)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the sources of each language apart in ``docs`` (text, lang, source).

    A language keeps the terms that ``min_docs`` of its documents hold. A term's chance p in a group (lang, source)
    or language is 1 + floor(UNIT * (n + SMOOTHING) / (N + SMOOTHING * V)), for n occurrences, N of all kept terms, V kept
    terms. Part ``pair``: for each other source of the language the differences of the chances, summed over the
    kept terms. Part ``term``: the kept terms of the group whose chance is above the language's, by the difference,
    the first ``top``. Ranks from 1, by value, largest first, equal ones by item.

    Texts are counted as white-space chunks, block by block of documents; each chunk that differs from
    all others of the corpus is cut into terms once. Its terms go back to the blocks, where a document counts once for
    a term that several of its chunks hold. What moves is a row for each chunk and block, so no chunk, group or
    document weighs on one task.

    Null text, lang and source count as empty; a group without terms takes part in pairs (value 0 where its language keeps no
    term); rows that repeat are documents of their own; an empty table gives an empty result; other columns are
    ignored. A group's sums are held in 64 bits, which fails rather than wraps.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = save(kept_terms(rows, min_docs), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("one").alias("v"), F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left")
    groups = save(groups.fillna({"total": 0, "lang_total": 0, "v": 0, "buckets": 1}), "groups")
    known = kept.join(small_or_shuffled(groups), ["lang", "source"])
    known = known.withColumns({"p": chance(F.col("n"), F.col("total"), F.col("v")), "q": chance(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    lacking = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "source", F.lit(None).cast("string").alias("term"), chance(F.lit(0), F.col("total"), F.col("v")).alias("p"))
    dealt = known.select("lang", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"), "source", "term", "p").unionByName(lacking)
    sums = dealt.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(pair_sums, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)
