"""Queries that SQL can't express, over their whole tables, against the definitions in plain Python."""

import difflib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mentionforge.operators.candidates import fuzzy_pairs, share_a_rare_letter
from mentionforge.operators.similar import similar
from mentionforge.plans import linking as L
from mentionforge.schemas import FUZZY_WEIGHT, KEEP_MIN, TYPE_BONUS
from mentionforge.sources import views as V

SF = "/root/testdata/sf0.001"
flat = lambda t: "".join(t.lower().split())
ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
clamp = lambda x: max(0.0, min(1.0, round(x, 4)))


@pytest.fixture(scope="module")
def entities(spark):
    return [r.asDict(recursive=True) for r in V.entities(spark, SF).collect()]


def asked(e):
    number = e["entity_id"][2:]
    return e["entity_type"] in ("nation", "region") or (number.isdigit() and int(number) % 20 == 0)


def names_of(e):
    return [e["entity_name"], *e["alias"]]


def test_seq_ratio(spark, entities):
    got = {(r.entity_id, r.ratio) for r in __spark_entry__.queries()["seq_ratio"](spark, SF).collect()}
    rows = __spark_entry__.queries()["seq_ratio"](spark, SF).collect()
    assert rows and all(r.bound >= r.ratio - 1e-9 for r in rows)
    by_id = {e["entity_id"]: e for e in entities}
    for i, r in got:
        e = by_id[i]
        assert any(abs(ratio(a, b) - r) < 1e-12 for a in map(flat, names_of(e)) for b in map(flat, names_of(e))) or any(abs(ratio(a, b) - r) < 1e-12 for a in names_of(e) for b in names_of(e))


def test_score_fuzzy(spark, entities):
    want = {}
    for e in filter(asked, entities):
        for k, name in enumerate(names_of(e)):
            text = name[:2] + name[3:]
            m, scored = flat(text), []
            for o in entities:
                best = 0.0
                for j, other in enumerate(names_of(o)):
                    n = flat(other)
                    best = max(best, (0.99 if j == 0 else 0.92) if m == n else 0.78 if m in n or n in m else ratio(m, n) * 0.7)
                if best >= 0.45:
                    scored.append((-clamp(best), o["entity_id"]))
            want[e["entity_id"], k] = [(i, -s) for s, i in sorted(scored)[:5]]
    got = {}
    for r in __spark_entry__.queries()["score_fuzzy"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.entity_id, r.confidence))
    # query ids are hashes: compare the answers
    assert sorted(map(str, got.values())) == sorted(map(str, filter(None, want.values())))


def test_link_catalog_fuzzy(spark, entities):
    """Every mention scored against every name, then decided and rolled up by hand."""
    queries = V.queries(spark, SF).where("query is not null")
    found = L.catalog_mentions(queries, V.names(spark, SF)).collect()
    names = [(e["entity_id"], e["entity_type"], flat(n), j) for e in entities for j, n in enumerate(names_of(e))]
    decided = {}
    for text, kind in {(m.text, m.predicted_type) for m in found}:
        m, best = flat(text), {}
        for i, own, n, j in names:
            if kind in (None, own):
                score = (0.99 if j == 0 else 0.92) if m == n else 0.78 if m in n or n in m else ratio(m, n) * 0.7
                best[i] = max(best.get(i, 0), score + (0.05 if kind else 0))
        top = sorted((-clamp(s), i) for i, s in best.items() if s >= 0.45)[:5]
        if not top or -top[0][0] < 0.70:
            decided[text, kind] = ("no_match", None, top)
        elif len(top) > 1 and round((top[1][0] - top[0][0]) * 10000) / 10000 < 0.08:
            decided[text, kind] = ("ambiguous", None, top)
        else:
            decided[text, kind] = ("linked", top[0][1], top)
    per = {}
    for m in sorted(found, key=lambda m: m.mention_idx):
        per.setdefault(m.query_id, []).append((*decided[m.text, m.predicted_type], m.predicted_type))
    want = {}
    for q, rows in per.items():
        linked = [i for s, i, _, _ in rows if s == "linked"]
        status = "linked" if len(linked) == len(rows) else "partial" if linked else "ambiguous" if any(r[0] == "ambiguous" for r in rows) else "no_match"
        offered = {}
        for s, _, top, kind in rows:
            if s != "no_match" or kind:
                for score, i in top:
                    offered.setdefault(i, score)
        tops = [i for _, i in sorted((s, i) for i, s in offered.items())[:5]]
        want[q] = (status, ",".join(linked), len(rows), ",".join(tops))
    got = {r.query_id: (r.status, r.linked_ids, r.n_mentions, r.top_ids) for r in __spark_entry__.queries()["link_catalog_fuzzy"](spark, SF).collect()}
    assert {q: x for q, x in got.items() if x[2]} == want and len(got) == queries.count()
    plain = {r.query_id: r.top_ids for r in __spark_entry__.queries()["link_catalog"](spark, SF).collect()}
    assert any(plain[q] != x[3] for q, x in got.items())  # similarity offers entities that nothing else does


def test_fuzzy_candidates_are_few(spark):
    """Pairs that meet before any bound is computed, against those whose ratio is reached."""
    named = V.names(spark, SF).selectExpr("entity_id", "entity_type as e_type", "name", "is_canonical", "lower(replace(name, ' ', '')) as n")
    asked = named.where("crc32(entity_id) % 20 = 0").selectExpr("name as text", "e_type as predicted_type", "n as m").distinct()
    low = (KEEP_MIN - TYPE_BONUS) / FUZZY_WEIGHT
    met = share_a_rare_letter(asked, named, "m", "n", F.lit(low), low).where("predicted_type = e_type").select("m", "n").distinct()
    reached = fuzzy_pairs(asked, named).select("m", "n").distinct().count()
    assert reached <= met.count() < 20 * reached


@pytest.mark.parametrize("name", ["link_catalog", "link_catalog_fuzzy", "similar_native"])
def test_plans_stay_short(spark, name):
    """Shared tables are written once, so a plan doesn't read the tables over and over."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") < 60


def test_alarm_phrase(spark, entities):
    suppliers = [e for e in entities if e["entity_type"] == "supplier"]
    want = set()
    for q in suppliers:
        m, entries = flat(q["entity_name"].replace("pp", "p")), {}
        every = [(o["entity_id"], flat(n), j) for o in suppliers for j, n in enumerate(names_of(o))]
        exact = [(i, 1.0 if j == 0 else 0.96) for i, n, j in every if n == m]
        for i, s in exact or [(i, 0.78 + 0.1 * ratio(m, n)) for i, n, j in every if ratio(m, n) >= 0.9]:
            entries[i] = max(entries.get(i, 0), s)
        for rank, (s, i) in enumerate(sorted((-clamp(s), i) for i, s in entries.items())[:5], 1):
            want.add((int(q["entity_id"][2:]), i, -s, rank))
    got = {(r.query_id, r.entity_id, r.confidence, r["rank"]) for r in __spark_entry__.queries()["alarm_phrase"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["similar_full", "similar_native"])
def test_similar(spark, entities, name):
    words = lambda e: set("".join(c if c.isalnum() or c == "_" else " " for c in e["desc"].lower()).split())
    want = set()
    for q in filter(asked, entities):
        scored = []
        for o in entities:
            if o is q:
                continue
            r = max(ratio(flat(a), flat(b)) for a in names_of(q) for b in names_of(o)) if name == "similar_full" else 0
            a, b = words(q), words(o)
            score = 0.3 * (r if r > 0.45 else 0) + 0.2 * (len(a & b) / len(a | b) if a and b else 0) + 0.15 * (q["entity_type"] == o["entity_type"]) + 0.2 * (o["entity_id"] in [x["target_entity_id"] for x in q["relationships"]])
            if clamp(score) > 0:
                scored.append((-clamp(score), o["entity_id"]))
        want |= {(q["entity_id"], i, -s, k) for k, (s, i) in enumerate(sorted(scored)[:5], 1)}
    got = {(r.query_entity_id, r.entity_id, r.score, r["rank"]) for r in __spark_entry__.queries()[name](spark, SF).collect()}
    assert got == want


def test_similar_and_fuzzy_meet_by_equality(spark):
    """No nested loop and no Cartesian product, however many sources there are."""
    e = V.entities(spark, SF)
    named = V.names(spark, SF).selectExpr("entity_id", "entity_type as e_type", "name", "is_canonical", "lower(name) as n")
    pairs = fuzzy_pairs(named.selectExpr("name as text", "cast(null as string) as predicted_type", "n as m").distinct(), named)
    for df in (similar(e, e, 5), similar(e, e, 5, names=True), pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
