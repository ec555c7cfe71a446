"""Publication by requests, incremental words, pinned streams, strict documents and hidden map values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mentionforge.operators import dictionary as D
from mentionforge.operators import ledger as LG
from mentionforge.operators import publish as P
from mentionforge.operators import safety as S
from mentionforge.schemas import ENTITY
from mentionforge.sources import files, store
from mentionforge.streaming import link_stream as LS


def entity(i, name, alias=()):
    return (i, "kpi", name, list(alias), "d", {}, [], "L0_SYNTHETIC", "s", "active")


def change(spark, rows, request, op="upsert", seq=1):
    return spark.createDataFrame([entity(*r) for r in rows], ENTITY).withColumns({"request_id": F.lit(request), "op": F.lit(op), "seq": F.lit(seq)})


def words(version):
    return sorted((x.entity_id, x.normalized_key) for x in version.words.collect())


def test_requests_count_once(spark, tmp_path):
    base = str(tmp_path)
    assert LG.read_version(spark, base) is None and LG.requests(spark, base).count() == 0
    first = change(spark, [("A", "one", ["uno"]), ("B", "two")], "r1")
    assert LG.publish_requests(spark, base, first)[:2] == (1, True)
    assert LG.publish_requests(spark, base, first)[:2] == (1, False)
    both = first.withColumn("entity_name", F.lit("changed")).unionByName(change(spark, [("B", "three")], "r2")).unionByName(change(spark, [("A", "one")], "r2", "delete", 2))
    assert LG.publish_requests(spark, base, both)[:2] == (2, True)  # of r1 nothing counts again
    assert words(LG.read_version(spark, base)) == [("B", "three")] and words(LG.read_version(spark, base, 1)) == [("A", "one"), ("A", "uno"), ("B", "two")]
    assert sorted(map(tuple, LG.requests(spark, base).collect())) == [("r1", 1), ("r2", 2)]
    clash = LG.publish_requests(spark, base, change(spark, [("C", "Th ree")], "r3"))
    assert not clash.written and [x.error_code for x in clash.violations.collect()] == ["key_conflict"] and LG.read_version(spark, base).number == 2
    assert LG.publish_requests(spark, base, change(spark, [("C", "four")], "r3")).written  # a refused request may come again
    for blank in (None, "", "  "):
        with pytest.raises(ValueError):
            LG.publish_requests(spark, base, change(spark, [("D", "x")], blank))


@pytest.mark.parametrize("part", ["entities", "entity_words", "requests", "manifest", "half a manifest"])
def test_a_killed_publication_is_invisible(spark, tmp_path, monkeypatch, part):
    base = str(tmp_path)
    LG.publish_requests(spark, base, change(spark, [("A", "one")], "r1"))
    second = change(spark, [("B", "two")], "r2")

    class Killed(Exception):
        pass

    def stop(*_):
        raise Killed

    with monkeypatch.context() as m:
        if part == "entities":
            m.setattr(LG, "upsert", stop)
        elif part == "entity_words":
            m.setattr(LG, "rebuild_words", stop)
        elif part == "requests":
            m.setattr(LG, "gate", stop)
        else:
            m.setattr(LG.store, "create_once", stop)
        if part == "half a manifest":
            (tmp_path / "manifests" / f"{2:012d}").write_text('{"data": ')
        else:
            with pytest.raises(Killed):
                LG.publish_requests(spark, base, second)
    assert words(LG.read_version(spark, base)) == [("A", "one")] and LG.requests(spark, base).count() == 1
    assert LG.publish_requests(spark, base, second).written
    assert words(LG.read_version(spark, base)) == [("A", "one"), ("B", "two")] and LG.requests(spark, base).count() == 2


def test_an_overtaken_publication_raises(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    LG.publish_requests(spark, base, change(spark, [("A", "one")], "r1"))
    real = LG.violations

    def overtake(after, made):
        monkeypatch.setattr(LG, "violations", real)
        LG.publish_requests(spark, base, change(spark, [("C", "three")], "r3"))
        return real(after, made)

    monkeypatch.setattr(LG, "violations", overtake)
    with pytest.raises(RuntimeError):
        LG.publish_requests(spark, base, change(spark, [("B", "two")], "r2"))
    assert LG.publish_requests(spark, base, change(spark, [("B", "two")], "r2")).written
    assert words(LG.read_version(spark, base)) == [("A", "one"), ("B", "two"), ("C", "three")]


def test_words_of_some_equal_the_full_rebuild(spark):
    r = random.Random(5)
    row = lambda i: (f"E{i}", f"Name {r.randint(0, 99)} {i}", [f"a{r.randint(0, 9)} {i}" for _ in range(r.randint(0, 3))])
    before = [row(i) for i in range(60)]
    touched = set(r.sample(range(60), 20))
    after = [row(i) if i in touched else before[i] for i in range(60) if not (i in touched and i % 4 == 0)] + [row(99)]
    make = lambda rows: spark.createDataFrame([entity(*x) for x in rows], ENTITY)
    ids = spark.createDataFrame([(f"E{i}",) for i in [*touched, 99, 99]], "entity_id string")
    got = D.rebuild_words(make(after), ids, D.rebuild_words(make(before)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.rebuild_words(make(after)).collect()))
    assert {x.entity_id for x in D.rebuild_words(make(after), ids).collect()} <= {f"E{i}" for i in [*touched, 99]}


def test_a_version_can_be_published_again_until_it_is_complete(spark, tmp_path):
    now = spark.createDataFrame([entity("A", "one")], ENTITY)
    nothing = now.limit(0).withColumns({"op": F.lit("upsert"), "seq": F.lit(1)})
    now.limit(0).write.parquet(f"{tmp_path}/v1/entities")  # an earlier attempt stopped here
    assert P.publish(now, nothing, str(tmp_path), "v1")[1] and P.publish(now, nothing, str(tmp_path), "v1")[1]
    assert spark.read.parquet(f"{tmp_path}/v1/entities").count() == 1


def test_a_retried_batch_sees_its_first_version(spark, tmp_path):
    tables = {v: (D.rebuild_words(e).withColumns({"match_mode": F.lit("EXACT_WORD"), "min_context_required": F.lit(False), "context_keywords": F.array().cast("array<string>"), "priority": F.lit(0)}), e)
              for v, e in (("v1", spark.createDataFrame([entity("A", "cpu")], ENTITY)), ("v2", spark.createDataFrame([entity("B", "cpu")], ENTITY)))}
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([(1, "show cpu now")], "query_id long, query string").write.parquet(source)
    current, fail = ["v1"], [True]

    def snapshot(pinned):
        version = pinned or current[0]
        words, entities = tables[version]
        if fail[0] and pinned is None:  # the batch stops after its version was settled
            fail[0] = False
            return words, None, version
        return words, entities, version

    stream = lambda: LS.link_stream(spark.readStream.schema("query_id long, query string").parquet(source), snapshot, out, checkpoint)
    with pytest.raises(Exception):
        stream().awaitTermination()
    current[0] = "v2"  # published between the attempts
    stream().awaitTermination()
    assert [(x.linked_ids, x.data_version) for x in spark.read.parquet(out).collect()] == [("A", "v1")]
    spark.createDataFrame([(2, "show cpu again")], "query_id long, query string").write.mode("append").parquet(source)
    stream().awaitTermination()
    assert sorted((x.query_id, x.linked_ids, x.data_version) for x in spark.read.parquet(out).collect()) == [(1, "A", "v1"), (2, "B", "v2")]


GOOD = {"entity_id": "A", "entity_type": "kpi", "entity_name": "n"}


@pytest.mark.parametrize("text", [
    "not json", "", "[1,2]", "7", '{"items": []}', '{"entities": "x"}', '{"entities": {"a": 1}}', '{"entities": null}', '{"entities": [1]}', '{"entities": [null]}', '{"metadata": "x", "entities": []}', '{"entities": [',
    *(json.dumps({"entities": [GOOD, GOOD | bad]}) for bad in ({"entity_type": 5}, {"entity_name": ["x"]}, {"alias": "x"}, {"alias": [1]}, {"alias": ["a", 1]}, {"attributes": []}, {"relationships": {}}, {"relationships": ["x"]}, {"desc": True})),
])
def test_wrong_documents_are_errors(spark, tmp_path, text):
    (tmp_path / "catalog.json").write_text(text)
    with pytest.raises(ValueError):
        files.read_catalog(spark, str(tmp_path / "catalog.json"))


def test_sound_documents_are_read(spark, tmp_path):
    body = {"metadata": {"n": 1}, "entities": [GOOD | {"alias": None, "attributes": {"a": {"b": 1}, "c": "x"}, "relationships": []}, {"entity_id": "B", "alias": [], "other": 5}]}
    (tmp_path / "catalog.json").write_text("﻿" + json.dumps(body), encoding="utf-8")
    got = {x.entity_id: x for x in files.read_catalog(spark, str(tmp_path / "catalog.json")).collect()}
    assert json.loads(got["A"].attributes["a"]) == {"b": 1} and got["A"].attributes["c"] == "x" and got["B"].alias == [] and set(got) == {"A", "B"}
    (tmp_path / "empty.json").write_text('{"entities": []}')
    assert files.read_catalog(spark, str(tmp_path / "empty.json")).count() == 0
    (tmp_path / "lines.json").write_text('{"entity_id": "A"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_entity_store(spark, str(tmp_path / "lines.json"), "lines").collect()


def test_map_values_are_hidden_whatever_their_kind(spark):
    df = spark.sql("""select map('api_token', 12345, 'n', 7) as numbers, map('secret', array('a', 'b'), 'tags', array('c')) as lists, map('x', named_struct('Password', 'p', 'k', 1), 'cookie', named_struct('Password', 'q', 'k', 2)) as parts,
        map('a', map('token', 1, 'm', 2)) as deep, array(map('host', true, 'ok', false)) as many, map(5, 'v') as keyed, map('url', cast(null as int), 'n', cast(null as int)) as empty, cast(null as map<string,int>) as nothing""")
    r = S.redact(df).first()
    assert r.numbers == {"api_token": "[REDACTED]", "n": "7"} and r.lists == {"secret": "[REDACTED]", "tags": '["c"]'}
    assert r.parts == {"x": '{"Password":"[REDACTED]","k":1}', "cookie": "[REDACTED]"} and r.deep == {"a": '{"token":"[REDACTED]","m":"2"}'}
    assert r.many == [{"host": "[REDACTED]", "ok": "false"}] and r.keyed == {5: "v"} and r.empty == {"url": "[REDACTED]", "n": None} and r.nothing is None
