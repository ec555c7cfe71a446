"""Scalar text functions as Spark columns."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keyword patterns of the intent gates.
LINKING_INTENT = r"(?iU)\b(show|check|query|open|compare|run|metrics?|kpi|usage|speed|iops|monitor|monitoring|abnormal|alarm)\b|查询|查看|指标|网元|告警"
CATALOG_INTENT = r"(?iU)\b(show|check|query|open|compare|run|metrics?|kpi|usage|speed|iops|monitor|monitoring|abnormal)\b|查询|查看|指标|网元|告警"
NOT_REQUIRED = r"(?iU)\b(dashboard|system health|health summary|operations dashboard)\b"
ALARM_INTENT = r"(?iU)\balarm\b|告警|ALM-\d+"
# Shapes of entity-like tokens and alarm numbers.
SHAPED_TOKEN = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_.()/-]*\d)[A-Za-z][A-Za-z0-9_.]*(?:[-_/().][A-Za-z0-9_.()]+)+(?![A-Za-z0-9_])"
ALARM_ID = r"(?i)(?<![A-Za-z0-9])ALM-\d+(?![A-Za-z0-9])"
NUMBER_AFTER_ALARM = r"(?iU)((?:\balarm\b|告警)\s*(?:id|number|编号|号)?\s*[:：#-]?\s*)(\d+)"
TERMINAL = ".,;:!?"
SPAN = "struct<span_start:int,span_end:int,text:string>"


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def normalize_text(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


@F.pandas_udf(T.StringType())
def _fold_whole(s: pd.Series) -> pd.Series:
    fold = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if not c.isspace())
    return pd.Series([fold(t) for t in s], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("norm", T.StringType()), T.StructField("pos", T.ArrayType(T.IntegerType()))]))
def _fold_each(s: pd.Series) -> pd.DataFrame:
    norms, places = [], []
    for t in s:
        kept = [] if t is None else [(x, i) for i, c in enumerate(t) for x in unicodedata.normalize("NFKC", c).casefold() if not x.isspace()]
        norms.append(None if t is None else "".join(x for x, _ in kept))
        places.append(None if t is None else [i for _, i in kept])
    return pd.DataFrame({"norm": pd.Series(norms, dtype=object), "pos": pd.Series(places, dtype=object)})


def normalize_word(c: Column) -> Column:
    """A word's key: whole-string NFKC and case folding, no white space; null gives ''. Only non-ASCII rows leave the JVM."""
    return F.coalesce(F.when(is_ascii(c), normalize_text(c)).otherwise(_fold_whole(F.when(~is_ascii(c), c))), F.lit(""))


def positions(n: Column) -> Column:
    """0 .. n - 1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def normalize_query(c: Column) -> Column:
    """struct(norm, pos): character-wise NFKC and case folding, and each kept character's place in the text."""
    places = F.transform(F.split(c, ""), lambda ch, i: F.when(~ch.isin(*" \t\n\x0b\f\r", ""), i))
    native = F.struct(normalize_text(c).alias("norm"), F.filter(places, lambda i: i.isNotNull()).alias("pos"))
    folded = _fold_each(F.when(~is_ascii(c), c))
    return F.when(is_ascii(c), native).otherwise(folded)


def restore_span(pos: Column, start: Column, end: Column) -> Column:
    """struct(span_start, span_end) in the raw text of [start, end) in the normalised one; null when out of range."""
    ok = (start >= 0) & (end > start) & (end <= F.size(pos))
    return F.when(ok, F.struct(F.get(pos, start).alias("span_start"), (F.get(pos, end - 1) + 1).alias("span_end")))


def alarm_dedup_key(c: Column) -> Column:
    return F.regexp_replace(normalize_text(c), "^alm-", "")


def is_alarm_identifier(c: Column) -> Column:
    return F.trim(c).rlike(r"(?iU)^(alm-\d+|\d+)$")


def tokens(c: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the word tokens; 0 if either side has none."""
    x, y = tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit("")))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def ratio_bound(a: Column, b: Column) -> Column:
    """Never below the Ratcliff-Obershelp ratio: what the lengths, and the letters shared, allow."""
    both = F.length(a) + F.length(b)

    def counts(c: Column) -> Column:
        return F.split(c, "")

    shared = F.aggregate(F.array_distinct(counts(a)), F.lit(0), lambda n, ch: n + F.least(F.size(F.filter(counts(a), lambda x: x == ch)), F.size(F.filter(counts(b), lambda x: x == ch))))
    return F.when(both == 0, 1.0).otherwise(F.least(2 * F.least(F.length(a), F.length(b)) / both, 2 * shared / both))


def seq_ratio(a: Column, b: Column) -> Column:
    """The Ratcliff-Obershelp ratio 2M / T; the argument order matters."""
    return _ratio(a, b)


def common_letters(a: list[str], b: list[str]) -> np.ndarray:
    """The lengths of the longest common subsequences of pairs of texts of up to 63 letters, all pairs at once, a bit for each letter."""
    codes = lambda t: np.array(t, dtype=f"U{max(1, max(map(len, t)))}").view(np.uint32).reshape(len(t), -1)
    x, y = codes(a), codes(b)
    p, q = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    weights = np.where(np.arange(x.shape[1]) < p[:, None], np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64), np.uint64(0))
    left = np.full(len(a), ~np.uint64(0))
    for j in range(y.shape[1]):
        same = np.where((x == y[:, j : j + 1]) & (j < q)[:, None], weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        left = (left + (left & same)) | (left & ~same)
    return np.bitwise_count(~left & ((np.uint64(1) << p.astype(np.uint64)) - np.uint64(1)))


def seq_ratio_from(least: float) -> Callable[[Column, Column], Column]:
    """``seq_ratio`` of texts that aren't null, where it can be at least ``least``; elsewhere it may be 0. A ratio's letters
    are a common subsequence, so the longest one bounds it."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, pairs = np.zeros(len(a)), list(zip(a, b, strict=True))
        short = [i for i, (x, y) in enumerate(pairs) if len(x) < 64 and len(y) < 64]
        may = np.ones(len(a), dtype=bool)
        if short:
            both = np.array([len(pairs[i][0]) + len(pairs[i][1]) for i in short])
            may[short] = 2 * common_letters([pairs[i][0] for i in short], [pairs[i][1] for i in short]) >= least * both - 1e-9
        for i in np.flatnonzero(may):
            out[i] = difflib.SequenceMatcher(None, *pairs[i]).ratio()
        return pd.Series(out)

    # else a condition on the ratio is moved before a shuffle, and the ratio computed once more behind it
    return ratio.asNondeterministic()


def clamp_score(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c, 4)))


def ascii_alnum(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]$")


def has_token_boundary(text: Column, start: Column, end: Column) -> Column:
    """No ASCII letter or digit touches [start, end)."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    return ~ascii_alnum(before) & ~ascii_alnum(F.substring(text, end + 1, F.lit(1)))


def context_pattern(keywords: Column) -> Column:
    """A pattern that finds any of the keywords in lower-cased text; null without keywords."""
    return F.when(F.size(keywords) > 0, F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("\\Q"), F.lower(k), F.lit("\\E"))), "|"))


def context_confirms(text: Column, pattern: Column) -> Column:
    """Some keyword stands in the text, whatever the case; no keywords confirm nothing."""
    return F.coalesce(F.rlike(F.lower(text), pattern), F.lit(False))


def sweep(items: Column, start: Column, kind: str, state: Callable, takes: Callable, gives: Callable) -> Column:
    """What a fold over an array gives out on its way, in order, as ``array<kind>``; null for a null array.

    ``state(s, item)`` is the next state, ``start`` the first; where ``takes(s, item)``, ``gives(s, item)`` is added to what is given
    out. Arrays are copied when something is added to them, so a fold that grows one takes time quadratic in its
    length. Here blocks of about the square root of the length are folded one by one, and only whole blocks
    are added up: the length times its square root at most.
    """
    none = F.array().cast(f"array<{kind}>")

    def bound(value: Column, body: Callable) -> Column:
        """``body`` of ``value``, which is computed once however often it is named."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def item(s: Column, x: Column) -> Column:
        out = F.when(takes(s["state"], x), F.concat(s["out"], F.array(gives(s["state"], x)))).otherwise(s["out"])
        return F.struct(state(s["state"], x).alias("state"), out.alias("out"))

    def block(s: Column, b: Column) -> Column:
        folded = F.aggregate(b, F.struct(s["state"].alias("state"), none.alias("out")), item)
        return bound(folded, lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], r["out"]).alias("out")))

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v)))).cast("int")
        last = F.greatest(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * width + 1, width))

    return F.aggregate(bound(items, blocks), F.struct(start.alias("state"), none.alias("out")), block, lambda s: s["out"])


def regex_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a regular expression with its offsets. ``group`` 2 of a pattern of two groups gives that group's.

    Matches are marked with two control characters, and offsets come from the lengths between the marks. Where
    the text holds these characters itself, others stand for them while it is searched.
    """
    odd = F.contains(text, F.lit("\u0001")) | F.contains(text, F.lit("\u0002"))
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002", "\u0003\u0004"), pattern, "\u0001$0\u0002" if group == 0 else "$1\u0001$2\u0002")
    parts = F.split(marked, "[\u0001\u0002]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), odd.alias("odd"))

    def end(s: Column, part: Column) -> Column:
        return (s["at"] + F.length(part)).cast("int")

    def after(s: Column, part: Column) -> Column:
        return F.struct(end(s, part).alias("at"), (~s["inside"]).alias("inside"), s["odd"].alias("odd"))

    def hit(s: Column, part: Column) -> Column:
        own = F.when(s["odd"], F.substring(text, s["at"] + 1, F.length(part))).otherwise(part)
        return F.struct(s["at"].alias("span_start"), end(s, part).alias("span_end"), own.alias("text"))

    return sweep(parts, start, SPAN, after, lambda s, _: s["inside"], hit)


def trim_terminal(spans: Column) -> Column:
    """Spans without the punctuation at their ends; those left empty stay, with no text."""

    def trimmed(s: Column) -> Column:
        text = F.regexp_replace(s["text"], r"[.,;:!?]+$", "")
        return F.struct(s["span_start"], (s["span_start"] + F.length(text)).cast("int").alias("span_end"), text.alias("text"))

    return F.transform(spans, trimmed)
