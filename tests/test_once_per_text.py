"""Work on queries is done once for each different text."""

from pyspark.sql import functions as F

from mentionforge.operators import dictionary as D
from mentionforge.plans import linking as L


def test_each_text_is_worked_on_once(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAST_HOT", 3)
    monkeypatch.setattr(D, "HOT", 4)
    rows = [(i, "hot text", i % 2) for i in range(40)] + [(100, "a b", 7), (101, "a b", 8), (102, "", 9), (103, None, 10), (104, None, 11), (105, "nothing", 12)]
    queries = spark.createDataFrame(rows, "query_id long, query string, other int").repartition(3)
    seen = []

    def work(texts):
        seen.extend(r.query for r in texts.collect())
        found = texts.where("query is null or query <> 'nothing'")
        return found.select("query_id", "query", F.explode(F.array(F.lit(1), F.length("query"))).alias("n"))

    got = sorted(map(tuple, D.once_per_text(queries, work).collect()), key=repr)
    assert sorted(seen, key=repr) == sorted({r[1] for r in rows}, key=repr)
    assert got == sorted([(i, t, o, n) for i, t, o in rows if t != "nothing" for n in (1, None if t is None else len(t))], key=repr)


def test_pieces_are_made_of_different_texts(spark):
    """A text that all queries share is normalised and cut into pieces once."""
    queries = spark.range(2000).select(F.col("id").alias("query_id"), F.lit("check old rod now").alias("query"))
    words = spark.createDataFrame([("P:1", "part", "old rod", "oldrod", "entity_name", "EXACT_WORD", False, [], 0)], "entity_id string, entity_type string, entity_word string, normalized_key string, source string, match_mode string, min_context_required boolean, context_keywords array<string>, priority int")
    seen = []
    of_texts = D.matches_of_texts
    D.matches_of_texts = lambda texts, *rest: (seen.append(texts.count()), of_texts(texts, *rest))[1]
    try:
        assert D.match_words(queries, words).where("span_start = 6 and span_end = 13 and text = 'old rod'").count() == 2000
    finally:
        D.matches_of_texts = of_texts
    assert seen == [1]


def test_texts_are_linked_once(spark, monkeypatch):
    """link_contains judges a text that all queries share once; blank texts stay invalid for each."""
    queries = spark.range(2000).select(F.col("id").alias("query_id"), F.when(F.col("id") < 1990, "check old rod now").alias("query"))
    words = spark.createDataFrame([("P:1", "part", "old rod", "oldrod", "entity_name", "EXACT_WORD", False, [], 0)], "entity_id string, entity_type string, entity_word string, normalized_key string, source string, match_mode string, min_context_required boolean, context_keywords array<string>, priority int")
    entities = spark.createDataFrame([("P:1",)], "entity_id string")
    seen, gate = [], L.request_gate
    monkeypatch.setattr(L, "request_gate", lambda texts: (seen.append(texts.count()), gate(texts))[1])
    got = L.link_contains(queries, words, entities).groupBy("status", "error_code", "linked_ids", "n_mentions", "n_entities").count().collect()
    assert sorted(map(tuple, got)) == [("invalid_input", "invalid_input", "", 0, 0, 10), ("linked", None, "P:1", 1, 1, 1990)]
    assert seen == [2]
