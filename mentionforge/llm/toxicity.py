"""Toxicity: noisy-channel restoration of disguised words, then a linear score of what they say."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .language import fold
from .storage import as_row, discard, save, texts_of

# The letters that a sign may stand for in disguised words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l",
}
#: Signs that may be mere separators inside a word.
SEPARATORS = " .-_*~,'’·/\\#&%^"
# The letters that the language model tells apart; all others share one class.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáçéèêëíîïñóôöúùûüßœæøåãõ"
CLASSES = 64
EDGE, OTHER = 0, CLASSES - 1
#: Most labelled rows that fit the classifier (a random part of them if there are more).
LABELLED = 8_000
#: Least toxic texts that a feature must occur in, and most features kept.
SUPPORT, FEATURES = 4, 4_000
PREFIXES = (4, 5, 6, 7, 8)

#: What may be a disguised word: runs that mix letters with signs, also at their ends; words with a doubled
#: letter; and at least three chunks of one or two letters kept apart.
_SIGNS = re.escape("".join(LEET)) + r".\-_*~"
DISGUISED = re.compile(rf"(?:[^\W\d_]|[{_SIGNS}])+")
APART_LETTERS = re.compile(r"(?<![^\W\d_])[^\W\d_]{1,2}(?:[ .\-_*~,/]{1,2}[^\W\d_]{1,2}){2,}(?![^\W\d_])")
DOUBLED = re.compile(r"([^\W\d_])\1")
#: A run without a letter is a candidate if one of its signs is no digit ("@$$", not "2024") and not all are the same.
NO_DIGITS = re.compile("[" + re.escape("".join(c for c in LEET if not c.isdigit())) + "]")
#: After so many characters, what all readings share is settled.
SETTLE = 64
WORDS = re.compile(r"[^\W\d_]+")


def char_classes() -> dict[str, int]:
    return {c: k + 1 for k, c in enumerate(LETTERS)}


CLASS_OF = char_classes()
_TABLE = np.full(0x180, OTHER, np.int64)
for _c, _k in CLASS_OF.items():
    _TABLE[ord(_c)] = _k
for _c in " \t\n\r\x0b\x0c.,;:?()\"":
    _TABLE[ord(_c)] = EDGE


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each triple of character classes occurs in a partition's texts."""
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            text = "\n\n".join(t.as_py() for t in batch.column("text").slice(lo, 500)).lower()
            codes = np.frombuffer(f"\n\n{text}\n\n".encode("utf-32-le"), np.uint32)
            k = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], OTHER)
            total += np.bincount((k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "c"])


class CharModel:
    """log P(c | a, b), interpolated with the shorter histories."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + CLASSES)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        self.log_p = np.log((c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)).astype(np.float32)

    @cached_property
    def flat(self) -> list[float]:
        """``log_p`` as plain numbers, which single look-ups read faster; made where it is used."""
        return self.log_p.reshape(-1).tolist()


def learn_characters(docs: DataFrame) -> CharModel:
    """Over every text; at most one number for each triple of classes reaches the driver."""
    texts = docs.where("text is not null").select("text")
    rows = texts.mapInArrow(trigrams, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(CLASSES**3, np.int64)
    for gram, c in rows:
        counts[gram] = c
    return CharModel(counts)


# log chances of the channel: how a letter is written
PLAIN, AS_SIGN, REPEATED, APART, STAYS = math.log(0.9), math.log(0.05), math.log(0.3), math.log(0.3), math.log(0.5)
#: A single separator between chunks kept apart is a word end.
ENDS = math.log(0.1)


#: Chunks kept apart: their single separators are seldom word ends.
SPELT = re.compile(r"[^\W\d_]{1,2}(?:[ .\-_*~,/]{1,2}[^\W\d_]{1,2})+")


@lru_cache(maxsize=1 << 16)
def options(c: str, last: str, spelt: bool) -> tuple[tuple[str, float], ...]:
    """What an observed character may stand for, with its log chance: letters, or nothing."""
    if c.isalpha():
        out = [(c, PLAIN)]
        if c == last:
            out.append(("", REPEATED))
        return tuple(out)
    out = [(letter, AS_SIGN) for letter in LEET.get(c, "")]
    if last and last in LEET.get(c, ""):
        out.append(("", REPEATED))
    if c in SEPARATORS:
        out += [("", APART), (" ", ENDS if spelt else STAYS)]
    if not out or c in LEET:
        out.append((c, STAYS))
    return tuple(out)


def restore(span: str, model: CharModel) -> str:
    """Viterbi over the lattice of what each character may stand for: the likeliest original under the character
    model. What all readings share is put aside as it settles, so a long span costs no more a character."""
    settled: list[str] = []
    flat, spelt, class_of = model.flat, bool(SPELT.fullmatch(span)), CLASS_OF.get
    # states are (last two classes as one number, last letter)
    beams: dict[tuple[int, str], tuple[float, str]] = {(EDGE * CLASSES + EDGE, ""): (0.0, "")}
    for at, c in enumerate(span):
        # the second of two separators is as good a word end as not
        single = spelt and not (at and c in SEPARATORS and span[at - 1] in SEPARATORS)
        new: dict[tuple[int, str], tuple[float, str]] = {}
        for (ab, last), (score, text) in beams.items():
            for letter, chance in options(c, last, single):
                if not letter:
                    key, value, out = (ab, last), score + chance, text
                else:
                    k = EDGE if letter == " " else class_of(letter, OTHER)
                    key, value, out = (ab % CLASSES * CLASSES + k, letter), score + chance + flat[ab * CLASSES + k], text + letter
                seen = new.get(key)
                if seen is None or seen[0] < value:
                    new[key] = (value, out)
        beams = new
        if at % SETTLE == SETTLE - 1:
            done = commonprefix([text for _, text in beams.values()])
            settled.append(done)
            beams = {k: (score, text[len(done) :]) for k, (score, text) in beams.items()}
    return "".join(settled) + max((score + flat[ab * CLASSES + EDGE], text) for (ab, _), (score, text) in beams.items())[1]


def disguised(token: str) -> list[str]:
    """The parts of a lower-case token that may be disguises."""
    found = []
    if not token.isalpha():
        for m in DISGUISED.finditer(token):
            span = m[0].strip(".-_*~")
            if not span.isalpha() and (WORDS.search(span) or (len(span) > 2 and len(set(span)) > 1 and NO_DIGITS.search(span))):
                found.append(span)
    return found + [w for w in WORDS.findall(token) if DOUBLED.search(w)] if DOUBLED.search(token) else found


class Restorer(dict):
    """token -> its words, as written and as restored; tokens and short spans are decoded once, a bounded number is kept."""

    def __init__(self, model: CharModel, most: int = 300_000):
        self.model, self.most = model, most
        self.spans: dict[str, list[str]] = {}

    def look(self, token: str) -> list[str]:
        found = WORDS.findall(token)
        for span in disguised(token):
            found += self.restored(span)
        return found

    def __missing__(self, token: str) -> tuple[str, ...]:
        out = tuple(dict.fromkeys(self.look(token)))
        if len(self) >= self.most:
            self.clear()
        self[token] = out
        return out

    def apart(self, text: str) -> set[str]:
        """Words restored from letters kept apart in a lower-case text."""
        found: set[str] = set()
        for m in APART_LETTERS.finditer(text):
            found.update(self.restored(m[0]))
        return found

    def restored(self, span: str) -> list[str]:
        words = self.spans.get(span)
        if words is None:
            words = WORDS.findall(restore(span, self.model))
            if len(span) <= 32:
                if len(self.spans) >= self.most:
                    self.spans.clear()
                self.spans[span] = words
        return words

    def words(self, text: str) -> set[str]:
        """The distinct words of a text as written, and of its disguised parts as restored."""
        text = text.lower()
        found = self.apart(text)
        for own in map(self.__getitem__, set(text.split())):
            found.update(own)
        return found


def features(word: str) -> list[str]:
    """A word stands for itself and for its beginnings, which inflected forms share."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def text_features(text: str | None, restorer: Restorer) -> set[str]:
    return {f for w in restorer.words(text or "") for f in features(w)}


def count_features(model: CharModel) -> Callable:
    """In how many toxic and other texts of a partition each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, totals = Restorer(model), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                totals[toxic].update(text_features(text, restorer))
        names = list(totals[0] | totals[1])
        for lo in range(0, len(names), 100_000):
            part = names[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([totals[k][f] for f in part], pa.int64()) for k in (1, 0))], names=["f", "t", "n"])

    return run


def present(model: CharModel, index: dict[str, int]) -> Callable:
    """Which of the chosen features each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            found = [sorted(index[f] for f in text_features(t, restorer) if f in index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "x"])

    return run


class Classifier:
    """Logistic regression on the presence of features."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = index, weights, bias

    @classmethod
    def fit(cls, index: dict[str, int], rows: list[list[int]], y: np.ndarray, penalty: float = 1.0, steps: int = 300) -> Classifier:
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([f for r in rows for f in r], np.int64)
        w, b = np.zeros(len(index)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -3.0
        size_w, size_b = np.full(len(index), 1e-8), 1e-8
        for _ in range(steps if len(y) else 0):  # steps scaled by the gradients so far
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[col], len(rows)), -30, 30)))
            g, gb = np.bincount(col, (p - y)[doc], len(index)) + penalty * w, (p - y).sum()
            size_w += g * g
            size_b += gb * gb
            w -= 0.3 * g / np.sqrt(size_w)
            b -= 0.3 * gb / math.sqrt(size_b)
        return cls(index, w, b)


class TokenFeatures(dict):
    """token -> the chosen features that its words bring, for scoring; bounded."""

    def __init__(self, restorer: Restorer, index: dict[str, int], most: int = 300_000):
        self.restorer, self.index, self.most = restorer, index, most

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = tuple({self.index[f]: 0 for w in self.restorer.look(token) for f in features(w) if f in self.index})
        if len(self) >= self.most:
            self.clear()
        self[token] = found
        return found


#: What a worker process has decoded, by model: tasks that follow each other there share it.
_DECODED: dict[int, TokenFeatures] = {}


def decoded(model: CharModel, classifier: Classifier) -> TokenFeatures:
    """The worker's bounded cache for this pair of models; another pair's is dropped."""
    key = hash((model.log_p.tobytes(), classifier.weights.tobytes(), tuple(classifier.index)))
    if key not in _DECODED:
        _DECODED.clear()
        _DECODED[key] = TokenFeatures(Restorer(model), classifier.index)
    return _DECODED[key]


def score_texts(model: CharModel, classifier: Classifier, names: list[str]) -> Callable:
    """Adds the score to the columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = decoded(model, classifier)
        restorer = known.restorer
        for batch in batches:
            out = []
            for text in texts_of(batch):
                text = (text.as_py() or "").lower()
                hits = {f for w in restorer.apart(text) for f in known[w]}
                for found in filter(None, map(known.__getitem__, set(text.split()))):
                    hits.update(found)
                z = classifier.bias + sum(classifier.weights[k] for k in sorted(hits))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[CharModel, Classifier]:
    """The character model from every text; the classifier from at most about ``most`` labelled rows that aren't held out."""
    model = learn_characters(docs)
    usable = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~fold(F.col("doc_id"), 5, 0))
    share = most / max(1, usable.count())
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded by ``most``, so it may go to every task
    sample = save(docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id"), "toxicity-sample")
    # one half finds features, the other weighs them
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    counted = sample.where(half == 0).repartition(8, "doc_id").mapInArrow(count_features(model), "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    t_all, n_all = (sample.where((half == 0) & (F.col("toxic") == k)).count() for k in (1, 0))
    rate = t_all / max(1, t_all + n_all)
    expected = rate * (F.col("t") + F.col("n"))
    chosen = counted.where((F.col("t") >= SUPPORT) & (F.col("t") > 2 * expected)).withColumn("gain", F.col("t") * F.log(F.col("t") / expected)).orderBy(F.desc("gain"), "f").limit(FEATURES)
    index = {r.f: k for k, r in enumerate(chosen.select("f").collect())}
    rows = sample.where(half == 1).mapInArrow(present(model, index), "toxic int, x array<int>").toPandas()
    discard(sample)
    order = sorted(range(len(rows)), key=lambda k: (rows["toxic"][k], list(rows["x"][k])))  # the same fit whatever the row order
    return model, Classifier.fit(index, [list(rows["x"][k]) for k in order], rows["toxic"].to_numpy(float)[order] if order else np.zeros(0))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) teach the classifier, but for rows whose
    crc32(doc_id) modulo 5 is 0, which are held out; a repeated id counts as toxic
    if any of its labels does, null labels are ignored. At most about ``LABELLED``
    labelled rows, a random part, fit the classifier; of their features the FEATURES
    best that stand in SUPPORT toxic texts or more are weighed. The character model
    counts every text. A null or empty text is
    scored as one without words; repeated rows give a row each; a null doc_id isn't
    held out; without labels all scores are low; an empty table gives an empty
    result; other columns are ignored.
    """
    model, classifier = learn(docs, labels)
    rows = docs.select("doc_id", fold(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    schema = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType())])
    scored = rows.mapInArrow(score_texts(model, classifier, ["doc_id", "held_out"]), schema)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast(IntegerType()).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``most``; all columns, whatever their names, stay.

    Null and empty texts score as texts without words; repeated rows have equal
    scores and stay or go together; null ids teach nothing; an empty table gives an
    empty one.
    """
    model, classifier = learn(docs, labels)
    rows = as_row(docs)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(score_texts(model, classifier, ["row"]), schema).where(F.col("score") < most).select("row.*")
