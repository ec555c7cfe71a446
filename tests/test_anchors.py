"""The index of anchors: broadcast or sieved, built anew or found again, it finds what a nested loop finds."""

import random

import pytest
from pyspark.sql import functions as F

from mentionforge.operators import anchors as A
from mentionforge.operators import dictionary as D
from mentionforge.sources import store

KEYS = ["a", "ab", "aba", "abcdefgh", "bcdefghi", "aaaaaaa", "é日x", "x y z w v", "no such key here"]


def places(text, key):
    return [i for i in range(len(text) - len(key) + 1) if text.startswith(key, i)]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    texts = ["".join(r.choice([*KEYS[:8], "q", " ", "abcdefg"]) for _ in range(r.randint(0, 12))) for _ in range(60)] + [None, "", "aaaaaaaaaaaa", "aaaaaaaaaaaa"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    w = spark.createDataFrame([(k,) for k in [*KEYS, None, ""]], "k string")
    want = sorted((i, k, at) for i, x in enumerate(texts) for k in KEYS for at in places(x or "", k))
    return t, w, want


@pytest.mark.parametrize("most_rows", [0, 100])
def test_occurrences(spark, tables, most_rows):
    t, w, want = tables
    index = A.build_index(w, "k", most_rows=most_rows)
    assert index.small == (most_rows > 0) and (index.sieve is None) == index.small
    for _ in range(2):  # one index for any number of joins
        assert sorted((r.id, r.k, r.at) for r in D.occurrences(t, w, "t", "k", index).collect()) == want


def test_no_keys(spark, tables):
    t, w, _ = tables
    for most_rows in (0, 100):
        index = A.build_index(w.where("k is null or k = ''"), "k", most_rows=most_rows)
        assert D.occurrences(t, w, "t", "k", index).count() == 0
    empty = A.build_index(w.limit(0), "k", most_rows=-1)
    pieces = spark.createDataFrame([("abc",), (None,)], "gram string")
    assert not empty.small and empty.meet(pieces).count() == 0


def test_the_sieve_loses_no_anchor_and_lets_few_others_through(spark):
    keys = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    index = A.build_index(keys, "k", most_rows=0)
    assert index.bits >= A.BITS_EACH * 20_000 and index.rows.where(~index.may_hold(F.col("gram"))).count() == 0
    others = spark.range(100_000).select(F.substring(F.sha1(F.col("id").cast("string")), 1, 6).alias("gram")).join(index.rows, "gram", "left_anti")
    assert others.where(index.may_hold(F.col("gram"))).count() < 0.03 * others.count()


def test_pieces_are_sieved_before_they_shuffle(spark, tables):
    t, w, _ = tables
    index = A.build_index(w, "k", most_rows=0)
    plan = D.occurrences(t, w, "t", "k", index)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.lower() or "bit_get" in plan.lower()
    assert A.build_index(w, "k").sieve is None  # few anchors go to every task instead


def test_built_once_for_a_version(spark, tables, tmp_path, monkeypatch):
    t, w, want = tables
    base = str(tmp_path / "index")
    built = []
    real = A._build
    monkeypatch.setattr(A, "_build", lambda *a: built.append(a) or real(*a))
    monkeypatch.setattr(store, "create_once", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # killed before it counts
        A.index_once(w, "k", base, "v/1")
    monkeypatch.undo()
    monkeypatch.setattr(A, "_build", lambda *a: built.append(a) or real(*a))
    first, again = (A.index_once(w, "k", base, "v/1") for _ in range(2))
    assert len(built) == 2 and first.rows.inputFiles() == again.rows.inputFiles()
    other = A.index_once(w.where("k = 'ab'"), "k", base, "v2", most_rows=0)
    assert len(built) == 3 and not other.small and other.rows.count() == 1
    assert sorted((r.id, r.k, r.at) for r in D.occurrences(t, w, "t", "k", again).collect()) == want


@pytest.mark.parametrize("rows", [0, 200_000])
def test_keys_that_share_an_anchor_are_told_apart_at_once(spark, monkeypatch, rows):
    """Only places of keys go back to the texts, not each key with an anchor like theirs; keys too long for that are found too."""
    monkeypatch.setattr(D, "AROUND", 12)
    long = "x" * 30 + "123456" + "y" * 30
    keys = [f"{a}{b}-123456" for a in "abcdefgh" for b in "abcdefgh"] + ["123456", long]
    w = spark.createDataFrame([(k,) for k in keys], "k string")
    t = spark.createDataFrame([(1, "see ab-123456 and 123456"), (2, "nothing 12345 6"), (3, f"1 {long[1:]}"), (4, f"2 {long}")], "id int, t string")
    index = A.build_index(w, "k", most_rows=rows)
    assert index.small == (rows > 0) and index.fits(12) == index.small and index.fits(len(long))
    want = sorted((i, k, p) for i, text in t.collect() for k in keys for p in range(len(text)) if text.startswith(k, p))
    assert sorted((r.id, r.k, r.at) for r in D.occurrences(t, w, "t", "k", index).collect()) == want
    # 2,000 texts each meet the anchor of 64 keys, and hold one of them
    few = A.build_index(w.where("length(k) = 9"), "k", most_rows=rows)
    many = spark.range(2000).selectExpr("cast(id as int) as id", "concat('ab-123456 ', id) as t")
    seen = []
    distinct = type(many).distinct
    monkeypatch.setattr(type(many), "distinct", lambda df: (seen.append(df.count()), distinct(df))[1])
    assert D._places(many, "t", few).count() == 2000
    assert seen == [2000]
