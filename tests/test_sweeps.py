"""Folds over long arrays: the same spans as plain Python's, in time that doesn't grow with the square."""

import random
import re
import time

from pyspark.sql import functions as F

from mentionforge.functions import text as X
from mentionforge.operators import dictionary as D


def test_regex_spans_equal_those_of_python(spark):
    rng = random.Random(5)
    texts = ["", "12", "a1", "1\u00012 3", "\u0001\u00027\u0002", None, "x" * 70, "1 " * 64, "1 " * 65, "é9😀10"]
    texts += ["".join(rng.choice("a1 \u0001\u0002é") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.regex_spans(F.col("t"), "[0-9]+").alias("s")).collect()
    for r in rows:
        t = texts[r.i]
        want = None if t is None else [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", t)]
        assert (None if r.s is None else [tuple(x) for x in r.s]) == want, t
    # a group's own text and place, control characters kept
    two = spark.createDataFrame([("no \u0001 alarm\u00015, alarm 6",)], "t string").select(X.regex_spans(F.col("t"), r"(alarm\W)(\d)", 2).alias("s")).first().s
    assert [tuple(x) for x in two] == [(11, 12, "5"), (20, 21, "6")]


def greedy(spans):
    end, out = 0, []
    for a, b in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if a >= end:
            out.append((a, b))
            end = b
    return out


def test_select_spans_of_many_sizes(spark):
    rng = random.Random(6)
    groups = {g: {(a, a + rng.randrange(1, 9)) for a in (rng.randrange(3 * n + 1) for _ in range(n))} for g, n in enumerate([1, 2, 63, 64, 65, 128, 129, 1000, 5000])}
    rows = [(g, a, b) for g, spans in groups.items() for a, b in spans]
    got = D.select_spans(spark.createDataFrame(rows, "g int, span_start int, span_end int"), "g", [F.lit(0)], []).collect()
    for g, spans in groups.items():
        mine = sorted((r.mention_idx, r.span_start, r.span_end) for r in got if r.g == g)
        assert [x[1:] for x in mine] == greedy(spans) and [x[0] for x in mine] == list(range(len(mine)))


def test_a_text_of_100000_spans_takes_seconds(spark):
    n = 100_000
    began = time.time()
    spans = spark.range(1).select(F.repeat(F.lit("1 "), n).alias("t")).select(X.regex_spans(F.col("t"), "[0-9]+").alias("s"))
    assert spans.select(F.size("s"), F.get("s", F.lit(n - 1))["span_end"]).first()[:] == (n, 2 * n - 1)
    chosen = D.select_spans(spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("span_start"), (F.col("id") + 2).cast("int").alias("span_end")), "g", [F.lit(0)], [])
    assert chosen.agg(F.count("*"), F.max("span_start")).first()[:] == (n // 2, n - 2)
    assert time.time() - began < 30


def test_detect_literal_takes_places_that_dont_overlap(spark):
    q = spark.createDataFrame([(1, "AA aa aaa " * 50)], "query_id long, query string")
    got = D.detect_literal(q, spark.createDataFrame([("aa aa",)], "name string")).collect()
    text, at, want = q.first().query.lower(), 0, []
    while (at := text.find("aa aa", at)) >= 0:
        if not text[at - 1 : at].isalnum() and not text[at + 5 : at + 6].isalnum():
            want.append(at)
        at += 5
    assert sorted(r.span_start for r in got) == want
