"""Language ID: unigram pieces over a fixed vocabulary, every segmentation summed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .storage import as_row, texts_of

#: Starts each word, as the vocabulary has it.
MARK = "▁"
#: Places of a word whose pieces are looked up at a time, and what sums may shrink to before they are scaled up again.
BLOCK, SHRUNK = 4096, 1e-200
#: Added to every piece count, and the least chance of a character outside the vocabulary.
SMOOTHING, LEAST = 0.1, 1e-7
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_P = np.uint64(0x100000001B3)


class Pieces:
    """The vocabulary as a hash table that numpy can probe for many substrings at once."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        # text is lower-cased, so only pieces that lower-casing leaves alone can match
        self.texts = sorted(t for t in texts if t == t.lower() and all(c == MARK or c.isalpha() for c in t))
        self.longest = max(map(len, self.texts))
        self.hashes = np.array([self.hash(t) for t in self.texts], np.uint64)
        self.bits = (22, 14)
        self.tables = [np.full(1 << b, -1, np.int32) for b in self.bits]
        for i, h in enumerate(self.hashes):
            for table, slot in zip(self.tables, (self.slot(np.array([h]), k)[0] for k in range(2)), strict=True):
                if table[slot] < 0:
                    table[slot] = i
                    break
            else:
                raise ValueError("two pieces share both slots")
        self.unknown = len(self.texts)

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_P) + ord(c) + 1) & (1 << 64) - 1
        return h

    def slot(self, h: np.ndarray, k: int) -> np.ndarray:
        h = h ^ (h >> np.uint64(29))
        return ((h * _K[k]) >> np.uint64(64 - self.bits[k])).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(h.shape, -1, np.int32)
        for k in range(2):
            i = self.tables[k][self.slot(h, k)]
            good = (i >= 0) & (self.hashes[i] == h)
            out[good] = i[good]
        return out

    def lattice(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words of one length (a row each), per piece length l: the piece that starts at each place, or -1.
        A character outside the vocabulary is the unknown piece."""
        out, h = [], np.zeros(codes.shape, np.uint64)
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            h = h[:, : codes.shape[1] - n + 1] * _P + codes[:, n - 1 :] + np.uint64(1)
            found = self.find(h)
            if n == 1:
                found[found < 0] = self.unknown
            out.append(found)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def lattices(vocabulary: Pieces, codes: np.ndarray, backwards: bool = False) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """The lattice of words of one length, for BLOCK starts at a time: (first start, end of the starts, lattice)."""
    n = codes.shape[1]
    for lo in range(0, n, BLOCK)[:: -1 if backwards else 1]:
        hi = min(n, lo + BLOCK)
        found = vocabulary.lattice(codes[:, lo : min(n, hi + vocabulary.longest - 1)])
        yield lo, hi, [f[:, : hi - lo] for f in found]


def safe_steps(p: np.ndarray) -> int:
    """After how many places sums that begin at 1 may have shrunk to SHRUNK, as each place can be passed by one piece:
    the fewer the smaller the least chance, which falls as the training text grows."""
    return max(1, int(np.log(SHRUNK) / np.log(min(p.min(), 0.1))))


def forward(vocabulary: Pieces, codes: np.ndarray, p: np.ndarray, seen: Callable | None = None) -> np.ndarray:
    """Per word (row of codes) and language the log chance of all segmentations together; p: piece by language, a last
    row of zeros. Holds the sums of the places that the longest piece spans, scaled up as they shrink, whatever the
    length of the words. ``seen(place, sums, logs)`` is told each place's sum."""
    m, n = codes.shape
    size = vocabulary.longest + 1
    ring, logs = np.zeros((size, m, p.shape[1])), np.zeros((m, p.shape[1]))
    ring[0] = 1
    every = safe_steps(p[:-1])
    for lo, hi, lattice in lattices(vocabulary, codes):
        for s in range(lo, hi):
            if s and s % every == 0:
                most = ring.max(axis=0)
                ring /= most
                logs += np.log(most)
            own = ring[s % size]
            if seen:
                seen(s, own, logs)
            for k, found in enumerate(lattice, 1):
                if s - lo < found.shape[1]:
                    ring[(s + k) % size] += own * p[found[:, s - lo]]
            own[:] = 0
    return np.log(ring[n % size]) + logs


def expected(vocabulary: Pieces, codes: np.ndarray, p: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` (piece by language) how often each piece stands in a segmentation, by its chance;
    weight: word by language. p is one language's. Holds four numbers a letter."""
    m, n = codes.shape
    alpha, alpha_log, beta, beta_log = (np.zeros((n + 1, m)) for _ in range(4))

    def seen(s: int, sums: np.ndarray, logs: np.ndarray) -> None:
        alpha[s], alpha_log[s] = sums[:, 0], logs[:, 0]

    whole = forward(vocabulary, codes, p, seen)[:, 0]
    beta[n] = 1
    every = safe_steps(p[:-1])
    for lo, hi, lattice in lattices(vocabulary, codes, backwards=True):
        for s in range(hi - 1, lo - 1, -1):
            base = beta_log[s + 1]
            for k, found in enumerate(lattice, 1):
                if s - lo < found.shape[1]:
                    beta[s] += p[found[:, s - lo], 0] * (beta[s + k] if n <= every else beta[s + k] * np.exp(beta_log[s + k] - base))
            beta_log[s] = base
            if s % every == 0 and n > every:
                beta_log[s] += np.log(beta[s])
                beta[s] = 1
        for k, found in enumerate(lattice, 1):
            start = np.arange(lo, lo + found.shape[1])
            with np.errstate(divide="ignore"):  # places that no segmentation reaches
                share = np.log(alpha[start]) + alpha_log[start] + np.log(beta[start + k]) + beta_log[start + k]
            share = np.exp(share - whole) * p[found.T, 0]
            at = np.flatnonzero(found.T >= 0)
            piece, share, word = found.T.reshape(-1)[at], share.reshape(-1)[at], at % m
            for g in range(weight.shape[1]):
                total[:, g] += np.bincount(piece, share * weight[word, g], len(total))


def marked_words(text: str) -> list[str]:
    """The marked lower-case words of a text."""
    return [MARK + w for w in LETTERS.findall(text.lower())]


def by_length(words: list[str], at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code matrix) for words of one length at a time, about ``at_once`` letters."""
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        many = max(1, min(1 << 15, at_once // int(n)))
        for k in range(0, len(rows), many):
            part = rows[k : k + many]
            yield part, codes[begin[part][:, None] + np.arange(n)]


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, and how many words each text has."""
    known: dict[str, int] = {}
    codes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = marked_words(t)
        counts[k] = len(words)
        codes += [known.setdefault(w, len(known)) for w in words]
    return list(known), np.array(codes, np.int64), counts


def count_pieces(path: str) -> Callable:
    """Expected piece counts by language under equal piece chances, for all rows of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces(path)
        p = np.zeros((vocabulary.unknown + 2, 1))
        p[:-2] = 1 / vocabulary.unknown
        p[-2] = LEAST
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                langs, which = np.unique(part["lang"].to_numpy(str), return_inverse=True)
                words, codes, counts = numbered(part["text"].tolist())
                if not words:
                    continue
                weight = np.bincount(codes * len(langs) + np.repeat(which, counts), minlength=len(words) * len(langs)).reshape(len(words), len(langs))
                total = np.zeros((vocabulary.unknown + 1, len(langs)))
                for rows, matrix in by_length(words):
                    expected(vocabulary, matrix, p, weight[rows], total)
                for g, lang in enumerate(langs):
                    totals[lang] = totals.get(lang, 0) + total[:, g]
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": at, "c": total[at]})

    return run


def classify(path: str, langs: list[str], p: np.ndarray, names: list[str]) -> Callable:
    """Adds two columns: the language under which all segmentations together are likeliest, and its share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        table = np.vstack([p, np.zeros((1, p.shape[1]))])
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                words, codes, counts = numbered([t or "" for t in texts_of(part).to_pylist()])
                score = np.zeros((len(words), len(langs)))
                if words and langs:
                    for rows, matrix in by_length(words):
                        score[rows] = forward(vocabulary, matrix, table)
                total = np.zeros((part.num_rows, len(langs)))
                full = np.flatnonzero(counts)
                if len(full) and langs:
                    first = (np.cumsum(counts) - counts)[full]
                    total[full] = np.add.reduceat(score[codes], first, axis=0)
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                known = (counts > 0) & bool(langs)
                pred = [langs[best[k]] if known[k] else UNDETERMINED for k in range(part.num_rows)]
                value = [float(share[k, best[k]]) if known[k] else 0.0 for k in range(part.num_rows)]
                kept = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(value, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def fold(doc_id: Column, parts: int, out: int) -> Column:
    """Whether a row is held out; rows without an id aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == out, F.lit(False))


def learn(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` (text, lang) and their piece probabilities: at most a number for each piece and language."""
    counts = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    rows = counts.mapInPandas(count_pieces(path), "lang string, piece int, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).toPandas()
    langs = sorted(rows["lang"].unique())
    p = np.full((pieces(path).unknown + 1, len(langs)), SMOOTHING)
    for g, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        p[own["piece"].to_numpy(), g] += own["c"].to_numpy()
    p /= p.sum(axis=0)
    p[-1] = np.maximum(p[-1] / 1000, LEAST)  # the unknown piece stands for many characters
    return langs, p


def identify_languages(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Piece probabilities are learned per language from rows with text and lang whose
    crc32(doc_id) modulo 3 isn't 1 (those are held out); a word is scored whole,
    whatever its length, over all its segmentations. lang_pred is ``und`` with
    score 0 if the text is null, has no letter, or nothing could be learned; ties
    go to the first language in order. Repeated rows are counted and answered each;
    a null doc_id isn't held out, an empty table gives an empty result, and other
    columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 3, 1))
    langs, p = learn(rows.where("not held_out"), path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(classify(path, langs, p, names), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least``; all columns, whatever their names, stay.

    Null texts and texts without a letter go; repeated rows stay or go together; an
    empty table, or one that teaches no language, gives an empty one.
    """
    langs, p = learn(docs.where(~fold(F.col("doc_id"), 3, 1)), path)
    rows = as_row(docs)
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    told = rows.mapInArrow(classify(path, langs, p, ["row"]), schema)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
