import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mentionforge.operators import evaluation as E
from mentionforge.operators import publish as P
from mentionforge.operators import quality as Q
from mentionforge.operators import safety as S
from mentionforge.schemas import ENTITY
from mentionforge.sources import files


def entity(i, name="n", alias=(), rel=(), kind="kpi"):
    return (i, kind, name, list(alias), "d", {}, list(rel), "L0_SYNTHETIC", "s", "active")


def test_documents_are_read(spark, tmp_path):
    body = {"metadata": {}, "entities": [{"entity_id": "A", "entity_type": "kpi", "entity_name": "Größe"}, {"entity_id": "B", "alias": ["x"]}]}
    (tmp_path / "new.json").write_text("﻿" + json.dumps(body), encoding="utf-8")
    got = {x.entity_id: x for x in files.read_catalog(spark, str(tmp_path / "new.json")).collect()}
    assert got["A"].entity_name == "Größe" and got["A"].alias == [] and got["A"].data_layer == "L0_SYNTHETIC" and got["B"].alias == ["x"]
    old = {"entities": [{"entity_id": "A", "canonical_name": "c", "aliases": ["a"], "description": "d"}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    row = files.read_entity_store(spark, str(tmp_path / "old.json"), legacy_names=True).first()
    assert (row.entity_name, row.alias, row.desc, row.data_layer) == ("c", ["a"], "d", None)
    gold = {"queries": [{"id": "q", "query": "see A", "expected_status": "linked", "mentions": [{"text": "A", "span": [4, 5], "expected_entity_ids": ["A"]}], "expected_entities": [{"entity_id": "A"}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    q, m = files.read_gold(spark, str(tmp_path / "gold.json"))
    assert q.first().expected_ids == ["A"] and tuple(m.first())[2:5] == ("A", 4, 5)


def test_publication_is_fail_closed_and_idempotent(spark, tmp_path):
    now = spark.createDataFrame([entity("A", "one", ["uno"]), entity("B", "two")], ENTITY)
    change = now.where("entity_id = 'B'").withColumns({"op": F.lit("upsert"), "seq": F.lit(1), "entity_name": F.lit("three")})
    after = P.upsert(now, change)
    assert {x.entity_id: x.entity_name for x in P.upsert(after, change).collect()} == {"A": "one", "B": "three"}
    assert P.publish(now, change, str(tmp_path), "v2")[1]
    assert {x.normalized_key for x in spark.read.parquet(f"{tmp_path}/v2/entity_words").collect()} == {"one", "uno", "three"}
    clash = change.withColumn("entity_name", F.lit("U NO"))
    found, ok = P.publish(now, clash, str(tmp_path), "v3")
    assert not ok and {x.error_code for x in found.collect()} == {"key_conflict"} and not (tmp_path / "v3").exists()


def test_rules_find_what_they_should(spark):
    e = spark.createDataFrame([entity("A"), entity("A"), entity("B", " ", ["x", "X "], [("Z", "r", "s", "l"), ("A", "r", "s", "l"), ("A", "R", "s", "l"), ("", "r", "s", "l")], "odd")], ENTITY)
    codes = lambda df: sorted((x.key, x.error_code) for x in df.collect())
    assert codes(Q.required(e, "e", "entity_id", ["entity_name"], {"entity_type": ["kpi"]})) == [("B", "invalid_value"), ("B", "missing_field")]
    assert codes(Q.duplicate_ids(e, "e", "entity_id")) == [("A", "duplicate_id")]
    assert codes(Q.dangling_relations(e)) == [("B", "relationship_target_missing")] * 2
    assert codes(Q.duplicate_relations(e)) == [("B", "duplicate_relationship"), ("B", "empty_relationship")]
    assert codes(Q.alias_rules(e)) == [("B", "duplicate_alias")]
    assert Q.gate(Q.duplicate_ids(e.limit(0), "e", "entity_id")) and not Q.gate(Q.duplicate_ids(e, "e", "entity_id"))


def test_secrets_and_attributes(spark):
    texts = [("a", "Authorization: Bearer abcdefgh12345 x"), ("b", "see https://localhost/ and https://.../v1 only"), ("c", None), ("d", "sk-abcdefghijk https://x.org/a raw_prompt")]
    df = spark.createDataFrame(texts, "source string, text string")
    got = sorted((x.source, x.issue_type, x.value) for x in S.scan_secrets(df).collect())
    assert got == [("a", "authorization_bearer_value", "bearer <redacted>"), ("d", "concrete_base_url_value", "https://<redacted>"), ("d", "raw_llm_payload_key", "raw_prompt"), ("d", "secret_like_api_key", "sk-<redacted>")]
    assert {x.source: x.ok for x in S.scan_summary(df).collect()} == {"a": False, "b": True, "c": True, "d": False}
    m = spark.createDataFrame([({"severity": "major", "Vendor": "x" * 301, "unit": "my host", "domain": '["a","b"]', "token": "1", "category": '{"a":1}'},)], "m map<string,string>")
    a = m.select(S.safe_attributes(F.col("m")).alias("a")).first().a
    assert a.safe == {"severity": "major", "domain": "a, b"} and a.omitted == 4
    nested = spark.createDataFrame([((1, "s"), [("h", 2)])], "a struct<x:int,Password:string>, b array<struct<host:string,n:int>>")
    r = S.redact(nested).first()
    assert r.a.Password == "[REDACTED]" and r.a.x == 1 and r.b[0].host == "[REDACTED]" and r.b[0].n == 2


def test_evaluation_by_hand(spark):
    want = spark.createDataFrame([(1, 0, "CPU", 0, ["C"], "linked", "kpi"), (2, 0, "zz", 3, [], "no_match", None), (3, 0, "amb", 0, ["A", "B"], "ambiguous", "kpi")], "query_id long, idx int, text string, span_start int, expected_ids array<string>, expected_status string, expected_type string")
    got = spark.createDataFrame([(1, 0, "cpu", 0, "linked", "X", "kpi", ["X"]), (1, 1, "more", 9, "no_match", None, None, []), (3, 0, "the amb", 0, "ambiguous", None, None, ["B", "A"])], "query_id long, mention_idx int, text string, span_start int, status string, entity_id string, entity_type string, candidate_ids array<string>")
    cases = E.score_mentions(want, got)
    assert sorted((x.query_id, x.idx, x.passed, x.tp, x.fp, x.fn, x.tn, x.nfp) for x in cases.collect()) == [(1, 0, False, 0, 1, 1, 0, 0), (1, 1001, False, 0, 1, 0, 0, 0), (2, 0, False, 0, 1, 0, 0, 1), (3, 0, True, 1, 0, 0, 0, 0)]
    gold = spark.createDataFrame([(1, "linked", 1), (2, "no_match", 1), (3, "ambiguous", 1), (4, "not_required", 0)], "query_id long, expected_status string, n_expected long")
    results = spark.createDataFrame([(1, "linked", 2), (2, "no_match", 0), (3, "ambiguous", 1), (4, "not_required", 0)], "query_id long, status string, n_mentions long")
    rows = E.score_cases(gold, results, cases)
    assert {x.query_id: x.passed for x in rows.collect()} == {1: False, 2: False, 3: True, 4: True}
    t = E.totals(rows).first()
    assert (t.tp, t.fp, t.fn, t.tn, t.nfp, t.precision, t.recall, t["passed"]) == (1, 3, 1, 1, 1, 0.25, 0.5, False)
    empty = E.totals(rows.limit(0)).first()
    assert (empty.precision, empty.recall, empty.notes) == (1.0, 1.0, "no_positive_predictions,no_expected_positive_cases")


def test_registry():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 80


@pytest.mark.parametrize("name", ["norm_offsets", "select_spans", "link_contains"])
def test_oracle_on_the_small_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf_dir)
    r = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(x[k] for k in at)) for x in r.fetchall())
