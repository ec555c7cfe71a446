import random

import numpy as np
import pytest

import corpus_pipeline
from mentionforge.llm import arrays as A
from mentionforge.llm import near_dedup


def test_near_dedup_takes_pairs_of_four_fifths(spark):
    """Pairs that share 100 - d of 100 + d shingles: 0.835, 0.818 and 0.802 go, 0.786 stays."""
    rows = []
    for k, d in enumerate([9, 10, 11, 12] * 10):
        base = [f"w{k}x{j}" for j in range(104)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-d] + [f"v{k}x{j}" for j in range(d)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i // 2 % 4 == 3}


@pytest.mark.parametrize("n", [9, 45, 450])
def test_bands_meet_at_four_fifths(n):
    """Sets of n elements that share 8 of 9: Jaccard 0.8."""
    r = np.random.default_rng(n)
    missed = 0
    for _ in range(200):
        h = r.integers(0, 1 << 63, n + n // 9, dtype=np.uint64) * A.U(2)
        reg = near_dedup.registers([np.sort(h[:n]), np.sort(h[n // 9 :])])[:, : near_dedup.BANDS * near_dedup.BAND_ROWS]
        missed += not (reg[0] == reg[1]).reshape(near_dedup.BANDS, -1).all(axis=1).any()
    assert missed <= 2


def test_suffix_stage_finds_passages_of_little_more_than_fifty_words(spark):
    """Passages of 51 to 59 words and under 400 bytes, each in two documents, go whole; everything else stays."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abdeghiklmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(n))
    passages = []
    while len(passages) < 12:
        p = " " + prose(r.randint(51, 59)) + " "
        if 250 <= len(p) < 400:
            passages.append(p)
    around = [(prose(r.randint(1, 80)), prose(r.randint(1, 80))) for _ in range(24)]
    rows = [(k, a + passages[k % 12] + b) for k, (a, b) in enumerate(around)]
    rows += [(100 + k, prose(r.randint(1, 200))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text for x in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    for k, (a, b) in enumerate(around):
        # chance may add a letter at either end to what both places share
        assert len(a) + len(b) - 4 <= len(got[k]) <= len(a) + len(b)
        assert got[k][: len(a) - 2] == a[:-2] and got[k].endswith(b[2:])
    assert all(got[100 + k] == rows[24 + k][1] for k in range(20))


#: Names that the operators themselves use, or used, and one with a dot.
CLASHING = ["th", "spans", "span_id", "span_th", "_th", "kept_id", "component_id", "kept", "n", "lang_pred", "score", "Score_", "_toxicity", "_lang", "row", "a.b", "text_"]


def odd_documents(spark):
    """Nulls in every column, empty, letterless and long texts, copies, repeated rows, clashing column names."""
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abdeghiklmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(n))
    long, some = prose(20_000), prose(90)
    rows = [(1, some, "en", 5), (2, some, "en", 5), (2, some, "en", 5), (3, None, "en", None), (4, "", None, 0), (None, some + " x", None, 7), (None, None, None, None), (5, long, "en", 9), (6, "123 !", "en", 5), (7, "w", "en", 1)]
    rows = [row + tuple(f"{row[0]}{k}" for k in range(len(CLASHING))) for row in rows]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows_and_clashing_names(spark, tmp_path, k):
    docs, rows = odd_documents(spark)
    spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    assert out.schema.names == docs.schema.names
    got = sorted([tuple(x) for x in out.collect()], key=str)
    want = {
        "toxicity": rows,
        "language": [x for x in rows if x[1] and any(c.isalpha() for c in x[1])],
        # one of rows 1 and 2; a null id is linked with nothing
        "near_dedup": [x for x in rows if x[0] != 2],
        "suffix_dedup": [(*x[:1], {0: "", 2: " x"}.get(len(x[1] or "") - len(rows[0][1]), x[1]), x[2], x[3], *x[4:]) for x in rows],
    }[name]
    if name == "suffix_dedup":  # n_chars is set anew where there is a text
        want = [(*x[:3], x[3] if x[1] is None else len(x[1]), *x[4:]) for x in want]
    assert got == sorted(want, key=str)
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.schema.names == docs.schema.names


def test_every_stage_takes_effect(spark, tmp_path):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abdeghiklmnoprstu") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(r.randint(20, 120)), "en", "s", 0) for i in range(120)]
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(200, 260):
        rows.append((i, prose(20) + " idiot " + prose(10), "en", "s", 0))
        labels.append((i, 0, 1))
    shared = prose(100)
    rows += [(300, rows[5][1], "en", "s", 0), (301, prose(30) + shared, "en", "s", 0), (302, shared + prose(30), "en", "s", 0), (303, None, None, "s", None), (304, "123", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, at = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x.doc_id: x for x in at.collect()}
        if k < 4:
            assert at.columns == docs.columns
    assert len(set(range(200, 260)) & set(seen["toxicity"])) < 6 and set(range(120)) <= set(seen["toxicity"])
    assert not {303, 304} & set(seen["language"]) and set(range(120)) <= set(seen["language"])
    assert 300 not in seen["near_dedup"] and 5 in seen["near_dedup"]
    assert shared[10:-10] not in seen["suffix_dedup"][301].text + seen["suffix_dedup"][302].text
    assert seen["suffix_dedup"][7].text == rows[7][1]
    assert set(seen["packing"]) == set(seen["suffix_dedup"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
