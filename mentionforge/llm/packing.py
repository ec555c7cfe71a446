"""Packing: each window is seeded by a document and filled with its lexical neighbours."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .storage import save

LENGTH, SEPARATOR = 1024, 0
#: Documents and tokens of an index shard, at most (one longer document comes alone); a seed asks its own shard and the next.
SHARD_DOCS, SHARD_TOKENS = 512, 2_000_000
# The constants of BM25.
K1, B = 1.2, 0.75
#: How the vocabulary's own pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without two white-space characters in a row; without looking ahead it is much faster.
PATTERN_SINGLE = PATTERN.replace(r"\s+(?!\S)|", "")
#: Beyond these the two libraries' Unicode tables may differ, so the slower, defining one is used.
OTHER_SCRIPTS = re.compile(r"[^\x00-˿‐-‧‰-›]")
#: The faster library's pattern keeps a place for each character of a run of white space and gives up at a million; longer runs
#: than this go through the defining one.
LONG_SPACE = re.compile(r"\s{10000}")
TWO_SPACES = re.compile(r"\s\s")
#: Every ASCII character that counts as white space, as a space.
AS_SPACE = bytes(32 if chr(i).isspace() and i < 128 else i for i in range(256))


@lru_cache(maxsize=2)
def encoders(path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding, Tokenizer]:
    """For texts without runs of white space, for texts with them, and the defining library."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    single, runs = (tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for p in (PATTERN_SINGLE, PATTERN))
    return single, runs, library


def two_spaces(text: str) -> bool:
    """Whether white-space characters stand in a row."""
    return b"  " in text.encode().translate(AS_SPACE) if text.isascii() else bool(TWO_SPACES.search(text))


def encode(text: str, path: str) -> np.ndarray:
    """The ids of ``text`` without added tokens, then the separator."""
    single, runs, library = encoders(path)
    spaced = two_spaces(text)
    if not text.isascii() and OTHER_SCRIPTS.search(text) or spaced and LONG_SPACE.search(text):
        ids = library.encode(text, add_special_tokens=False).ids
    else:
        ids = (runs if spaced else single).encode_to_numpy(text, allowed_special="all")
    return np.append(np.asarray(ids, np.uint32), np.uint32(SEPARATOR))


def packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four, marked by the first byte."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def tokenise(path: str) -> Callable:
    """Per document its ids. A last row of each partition (n_documents set) holds, in place of ids, in how many of
    its documents each term occurs; the separator is no term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, documents, kind = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = []
                for text in part.column("text").to_pylist():
                    ids = encode(text, path)
                    if len(ids) > 1 and (most := int(ids.max())) >= len(total):
                        total, last = (np.append(x, np.zeros(most + 1 - len(total), np.int64)) for x in (total, last))
                    # each term counts where it stands last
                    at = np.arange(len(ids))
                    last[ids] = at
                    own = ids[last[ids] == at]
                    total[own[own != SEPARATOR]] += 1
                    rows.append((len(ids), packed(ids)))
                documents += len(rows)
                n, data = zip(*rows, strict=True)
                yield token_rows(part.column("doc_id"), n, data, [None] * len(rows))
        at = np.flatnonzero(total)
        yield token_rows(pa.nulls(1, kind), [0], [at.astype("<u4").tobytes() + total[at].astype("<i8").tobytes()], [documents])

    return run


def token_rows(doc_id, n, data, documents) -> pa.RecordBatch:
    columns = [pa.array(n, pa.int64()), pa.array(data, pa.binary()), pa.array(documents, pa.int64())]
    return pa.RecordBatch.from_arrays([doc_id, *columns], names=["doc_id", "doc_tokens", "ids", "n_documents"])


def rarity(df: np.ndarray) -> np.ndarray:
    """Each term's place among the terms that documents share, rarest first; the others come last of all."""
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
    return np.where(df > 1, place, len(df))


def route(df: np.ndarray) -> Callable:
    """Adds r1, r2: a document's two rarest terms that others share, so that documents with rare terms in common sort together."""
    place = rarity(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for x in batch.column("ids"):
                own = place[unpacked(x.as_py())]
                r1 = own.min()
                keys.append((r1, own[own > r1].min(initial=len(place))))
            r1, r2 = zip(*keys, strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(r1, pa.int64()), pa.array(r2, pa.int64())], names=["doc_id", "ids", "r1", "r2"])

    return run


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) from the partitions' last rows."""
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            n = len(x) // 12
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<u4", n).astype(np.int64)), pa.array(np.frombuffer(x, "<i8", n, 4 * n))], names=["term", "df"])


def term_counts(document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct terms and how often each occurs."""
    # sorts of two bytes are much faster
    ids = np.sort(document.astype(np.uint16) if document.max() < 1 << 16 else document, kind="stable")
    ids = ids[np.searchsorted(ids, SEPARATOR, side="right") :]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.append(first, len(ids)))


class Index:
    """BM25 over some shards: postings of all their documents, corpus-wide document frequencies."""

    def __init__(self, documents: list[np.ndarray], df: np.ndarray, n: int, mean: float, known: list[tuple] | None = None):
        terms, counts = zip(*(known or map(term_counts, documents)), strict=True)
        self.terms, sizes = terms, np.array([len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(counts)
        doc = np.repeat(np.arange(len(documents)), sizes)
        length = np.array([len(d) for d in documents])[doc]
        idf = np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        term = term[order]
        self.first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.known, self.count = term[self.first], np.diff(np.append(self.first, len(order)))
        self.size = self.alive = len(documents)

    def keep(self, open_: np.ndarray) -> None:
        """Postings of documents that aren't ``open_`` any more go, once they are many; the others' scores stay as they are."""
        if (now := int(open_.sum())) > 0.7 * self.alive:
            return
        self.alive, held = now, open_[self.doc]
        upto = np.concatenate(([0], np.cumsum(held)))
        self.doc, self.weight = self.doc[held], self.weight[held]
        self.count, self.first = upto[self.first + self.count] - upto[self.first], upto[self.first]

    def scores(self, document: int) -> np.ndarray:
        """BM25 of every document of the shard for the terms of ``document``; of those that ``keep`` was told of no more."""
        at = np.searchsorted(self.known, self.terms[document])
        first, count = self.first[at], self.count[at]
        places = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        return np.bincount(self.doc[places], self.weight[places], self.size)


class Packer:
    """Fills windows from one partition, shard by shard: a shard's documents seed windows once the next shard is there, and find neighbours in both."""

    def __init__(self, df: np.ndarray, n: int, mean: float, length: int, first_sequence: int):
        self.df, self.n, self.mean, self.length, self.sequence = df, n, mean, length, first_sequence
        self.rows: list[tuple] = []
        self.left: list[tuple] = []  # (doc_id, ids, start of what is left, the document's terms and counts)

    def put(self, pieces: list[tuple]) -> None:
        """One sequence of (doc_id, ids, start, end)."""
        offset = 0
        for doc_id, ids, a, b in pieces:
            self.rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), self.sequence, offset))
            offset += b - a
        self.sequence += 1

    def shard(self, documents: list[tuple]) -> None:
        """documents: (doc_id, ids). Whole windows of a long document stand alone; its tail seeds or fills a shared one."""
        seeds, tails = len(self.left), self.left
        for doc_id, ids in documents:
            whole = len(ids) // self.length * self.length
            for a in range(0, whole, self.length):
                self.put([(doc_id, ids, a, a + self.length)])
            if whole < len(ids):
                tails.append((doc_id, ids, whole, term_counts(ids)))
        self.fill(tails, seeds)

    def fill(self, tails: list[tuple], seeds: int) -> None:
        """Windows seeded by the first ``seeds`` of ``tails``, with neighbours among them all."""
        self.left = tails
        if not seeds:
            return
        index = Index([t[1] for t in tails], self.df, self.n, self.mean, [t[3] for t in tails])
        start = np.array([t[2] for t in tails])
        remain = np.array([len(t[1]) for t in tails]) - start
        total = int(remain.sum())
        for seed in np.argsort(-remain[:seeds], kind="stable"):
            if not remain[seed]:
                continue
            if total < self.length:
                break
            window, space = [], self.length

            def take(d: int, k: int) -> None:
                nonlocal space, total
                window.append((tails[d][0], tails[d][1], int(start[d]), int(start[d]) + k))  # noqa: B023
                start[d] += k
                remain[d] -= k
                space -= k
                total -= k

            take(seed, int(remain[seed]))
            if space:
                live = np.flatnonzero(remain)
                index.keep(remain > 0)
                near = live[np.argsort(-index.scores(seed)[live], kind="stable")]
                fit = near[remain[near] <= space]
                while len(fit):  # neighbours that fit, best first
                    take(int(fit[0]), int(remain[fit[0]]))
                    fit = fit[1:]
                    fit = fit[remain[fit] <= space]
                if space:  # the best of the rest is cut to fit
                    take(int(near[remain[near] > 0][0]), space)
            self.put(window)
        self.left = [(t[0], t[1], int(a), t[3]) for t, a, r in zip(tails, start, remain, strict=True) if r]

    def finish(self) -> None:
        """The last shard's windows; the rest goes into sequences whose lengths are powers of two, which need no padding."""
        self.fill(self.left, len(self.left))
        todo = [t[:3] for t in self.left[::-1]]
        rest = sum(len(ids) - a for _, ids, a in todo)
        while rest:
            space = 1 << (rest.bit_length() - 1)
            rest -= space
            window = []
            while space:
                doc_id, ids, a = todo.pop()
                b = min(len(ids), a + space)
                window.append((doc_id, ids, a, b))
                space -= b - a
                if b < len(ids):
                    todo.append((doc_id, ids, b))
            self.put(window)
        self.left = []

    def drain(self, doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_partition(df: np.ndarray, n: int, mean: float, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(df, n, mean, length, TaskContext.get().partitionId() << 40)
        shard, tokens, kind = [], 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = unpacked(x)
                if shard and (len(shard) == SHARD_DOCS or tokens + len(ids) > SHARD_TOKENS):
                    packer.shard(shard)
                    yield packer.drain(kind)
                    shard, tokens = [], 0
                shard.append((doc_id, ids))
                tokens += len(ids)
        packer.shard(shard)
        packer.finish()
        yield packer.drain(kind)

    return run


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """Pieces of sequences of at most ``length`` tokens (a power of two): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the vocabulary file at ``path`` and the separator id;
    a null or empty text is the separator alone. Every id of every row lies in one
    piece; repeated rows are packed as often as they occur; null ids stay null; an
    empty table gives an empty result; other columns are ignored. Every sequence
    is full but for the last few of each partition, which are powers of two.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = f"doc_id {kind}, doc_tokens long, ids binary, n_documents long"
    rows = save(texts.mapInArrow(tokenise(path), fields), "tokens")
    tokens, last = rows.where("n_documents is null"), rows.where("n_documents is not null")
    # one number a vocabulary entry and two sums
    counts = last.select("ids").mapInArrow(document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect()
    n, total = rows.agg(F.sum("n_documents"), F.sum("doc_tokens")).first()
    df = np.zeros(max((t for t, _ in counts), default=0) + 1, np.int64)
    for t, c in counts:
        df[t] = c
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["r1", "r2", "doc_id", F.crc32("ids")]
    routed = tokens.select("doc_id", "ids").mapInArrow(route(df), f"doc_id {kind}, ids binary, r1 long, r2 long")
    placed = routed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return placed.mapInArrow(pack_partition(df, n or 0, (total or 0) / max(n or 0, 1) or 1.0, length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
