import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from mentionforge.functions import text as X
from mentionforge.operators import candidates as C
from mentionforge.operators import dictionary as D
from mentionforge.operators.similar import similar
from mentionforge.plans import linking as L
from mentionforge.schemas import ENTITY

WORD = "entity_id string, entity_type string, entity_word string, normalized_key string, source string, match_mode string, min_context_required boolean, context_keywords array<string>, priority int"


def word(i, text, mode="EXACT_WORD", keywords=(), kind="kpi", priority=0):
    key = "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if not c.isspace())
    return (i, kind, text, key, "entity_name", mode, False, list(keywords), priority)


def norm_query(t):
    kept = [(x, i) for i, c in enumerate(t) for x in unicodedata.normalize("NFKC", c).casefold() if not x.isspace()]
    return "".join(x for x, _ in kept), [i for _, i in kept]


def brute_contains(text, words, ids=None):
    """Confirmed, greedily chosen matches, written from the rules."""
    norm, pos = norm_query(text)
    alnum = lambda c: c.isascii() and c.isalnum()
    found = []
    for i, _, _, key, _, mode, _, keywords, priority in words:
        at = norm.find(key)
        while at >= 0:
            a, b = pos[at], pos[at + len(key) - 1] + 1
            ok = mode != "EXACT_WORD" or not ((a and alnum(text[a - 1])) or (b < len(text) and alnum(text[b])))
            if mode == "CONTEXT_REQUIRED":
                ok = any(k.casefold() in text.casefold() for k in keywords)
            if ok:
                found.append((a, a - b, -priority, i, b))
            at = norm.find(key, at + 1)
    out, end = [], 0
    for a, _, _, i, b in sorted(found):
        if a >= end:
            out.append((a, b, i))
            end = b
    return out


@pytest.mark.parametrize("gram", [2, 6])
def test_containment_matches_brute_force(spark, monkeypatch, gram):
    monkeypatch.setattr(D, "GRAM", gram)
    r = random.Random(gram)
    text = lambda n: "".join(r.choice("abcAB ß１é-") for _ in range(n))
    words = [w for k in range(40) if (w := word(f"E{k}", text(r.randint(1, 5)), r.choice(["EXACT_WORD", "FREE", "CONTEXT_REQUIRED"]), ["ab"], priority=r.randint(0, 2)))[3]]
    queries = [(k, text(r.randint(0, 40))) for k in range(80)] + [(900, "Check CPU  Usage now"), (901, "ＣＰＵ Usage")]
    words.append(word("CPU", "CPU Usage"))
    q, w = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(words, WORD)
    got = {}
    for m in L.contains_mentions(q, w).orderBy("query_id", "mention_idx").collect():
        got.setdefault(m.query_id, []).append((m.span_start, m.span_end, m.entity_id))
    want = {k: v for k, t in queries if (v := brute_contains(t, words))}
    assert got == want and want[900] == [(6, 16, "CPU")] and want[901] == [(0, 9, "CPU")]


def test_statuses_of_containment(spark):
    words = [word("A", "ALM-51020"), word("S", "SYSTEM", "CONTEXT_REQUIRED", ["tablespace"]), word("G", "ghost")]
    q = spark.createDataFrame([(1, "Check ALM-51020 and more."), (2, "Explain ALM-5102."), (3, "SYSTEM here"), (4, "SYSTEM Tablespace"), (5, "  "), (6, None), (7, "a ghost")], "query_id long, query string")
    entities = spark.createDataFrame([("A",), ("S",)], "entity_id string")
    w = spark.createDataFrame(words, WORD)
    got = {x.query_id: (x.status, x.linked_ids) for x in L.link_contains(q, w, entities).collect()}
    assert got == {1: ("linked", "A"), 2: ("no_match", ""), 3: ("no_match", ""), 4: ("linked", "S"), 5: ("invalid_input", ""), 6: ("invalid_input", ""), 7: ("dependency_failed", "")}
    other = {x.status for x in L.link_contains(q, w, entities, "v1", "v2").where("query_id = 1").collect()}
    assert other == {"dependency_failed"}


def test_linking_plans_have_no_product(spark):
    w = spark.createDataFrame([word("A", "alpha"), word("B", "beta")], WORD)
    q = spark.createDataFrame([(1, "alpha and beta")], "query_id long, query string")
    plan = L.contains_mentions(q, w)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_word_pipeline(spark):
    words = [word("C", "CPU Usage"), word("V", "CloudHost-VM-1-1")]
    e = spark.createDataFrame([("C", "kpi"), ("V", "ne")], "entity_id string, entity_type string")
    rows = [(1, "Show CPU Usage for CloudHost-VM-1-1-000000."), (2, "Open the operations dashboard."), (3, "Show nothing known"), (4, "hello"), (5, "check cpu usage, CPU USAGE"), (6, "")]
    q = spark.createDataFrame(rows, "query_id long, query string")
    got = {x.query_id: (x.status, x.n_mentions, x.linked_ids) for x in L.link_words(q, spark.createDataFrame(words, WORD), e).collect()}
    assert got[1] == ("linked", 2, "C,V")  # the known name ends before "-", so the longer token overlaps it and is dropped
    assert got[2][0] == "not_required" and got[3][0] == "no_match" and got[4][0] == "not_required" and got[5] == ("linked", 2, "C,C") and got[6][0] == "invalid_input"


def test_normalised_texts_and_ratios(spark):
    r = random.Random(5)
    texts = ["", " ", "ＣＰＵ Usage", "Straße ﬁ", "é a"] + ["".join(r.choice("abcé ") for _ in range(r.randint(0, 12))) for _ in range(60)]
    rows = [(t, r.choice(texts)) for t in texts]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select("a", "b", X.normalize_word(F.col("a")).alias("w"), X.normalize_query(F.col("a")).alias("q"), X.seq_ratio(F.col("a"), F.col("b")).alias("r"), X.ratio_bound(F.col("a"), F.col("b")).alias("u"), X.token_jaccard(F.col("a"), F.col("b")).alias("j"))
    for x in out.collect():
        assert x.w == "".join(c for c in unicodedata.normalize("NFKC", x.a).casefold() if not c.isspace())
        assert (x.q.norm, x.q.pos) == norm_query(x.a)
        assert x.r == difflib.SequenceMatcher(None, x.a, x.b).ratio() and x.u >= x.r - 1e-9
        s, t = set(x.a.lower().split()), set(x.b.lower().split())
        if all(c.isalnum() or c.isspace() for c in x.a + x.b):
            assert abs(x.j - (len(s & t) / len(s | t) if s and t else 0.0)) < 1e-9


def score(mention, kind, names):
    """Best score of each entity, written from the rules."""
    best = {}
    m = "".join(mention.lower().split())
    for i, e_type, name, canonical in names:
        if kind and kind != e_type:
            continue
        n = "".join(name.lower().split())
        s = (0.99 if canonical else 0.92) if m == n else 0.78 if m in n or n in m else 0.7 * difflib.SequenceMatcher(None, m, n).ratio()
        best[i] = max(best.get(i, 0), s + (0.05 if kind else 0))
    ranked = sorted(((-round(min(1.0, s), 4), i) for i, s in best.items() if s >= 0.45))
    return [(i, -s) for s, i in ranked[:5]]


def test_candidates_by_brute_force(spark):
    r = random.Random(6)
    name = lambda: "".join(r.choice("abcd ") for _ in range(r.randint(2, 9))).strip() or "a"
    names = [(f"E{k // 2}", f"t{k // 2 % 2}", name(), k % 2 == 0) for k in range(60)]
    mentions = [(k, 0, name() if k % 3 else names[k][2].upper(), r.choice([None, "t0", "t1"])) for k in range(40)]
    n = spark.createDataFrame([(i, t, x, c, 0 if c else 1) for i, t, x, c in names], "entity_id string, entity_type string, name string, is_canonical boolean, name_idx int")
    m = spark.createDataFrame(mentions, "query_id long, mention_idx int, text string, predicted_type string")
    got = {}
    for x in C.rank_candidates(C.score_candidates(m, n, fuzzy=True)).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.entity_id, x.confidence))
    want = {k: v for k, _, t, kind in mentions if (v := score(t, kind, names))}
    assert got == want


def test_catalog_pipeline(spark):
    rows = [("A1", "kpi", "cpu usage", ["load"]), ("A2", "kpi", "disk usage", []), ("N1", "ne", "host alpha", []), ("N2", "ne", "host beta", ["alpha two"])]
    e = spark.createDataFrame([(i, t, n, a, "d", {}, [], "L1_SANITIZED", "s", "active") for i, t, n, a in rows], ENTITY)
    names = e.select("entity_id", "entity_type", F.posexplode(F.concat(F.array("entity_name"), "alias")).alias("name_idx", "name")).withColumn("is_canonical", F.col("name_idx") == 0)
    q = spark.createDataFrame([(1, "show cpu usage of host alpha"), (2, "Open the dashboard"), (3, "check Foo-1."), (4, "load"), (5, None)], "query_id long, query string")
    got = {x.query_id: x for x in L.link_catalog(q, e, names).collect()}
    assert (got[1].status, got[1].linked_ids, got[1].data_layer) == ("linked", "A1,N1", "L1_SANITIZED")
    assert got[2].status == "not_required" and got[3].status == "no_match" and got[4].linked_ids == "A1" and got[5].status == "invalid_input"


def test_similar_by_definition(spark):
    rows = [(f"E{k}", f"t{k % 2}", n, [], d, {}, [("E0", "r", "s", "l")] if k == 3 else [], "L0_SYNTHETIC", "s", "active") for k, (n, d) in enumerate([("alpha one", "big red"), ("alpha two", "big blue"), ("gamma", "red"), ("delta", "x"), ("alpha one", "y")])]
    e = spark.createDataFrame(rows, ENTITY)
    got = [(x.query_entity_id, x.entity_id, x.score) for x in similar(e, e.where("entity_id in ('E0', 'E3')"), 3, names=True).orderBy("query_entity_id", "rank").collect()]

    def pair(a, b):
        ratio = difflib.SequenceMatcher(None, a[2].replace(" ", ""), b[2].replace(" ", "")).ratio()
        s, t = set(a[4].split()), set(b[4].split())
        linked = any(x[0] == b[0] for x in a[6])
        return round((0.3 * ratio if ratio > 0.45 else 0) + 0.2 * len(s & t) / len(s | t) + 0.15 * (a[1] == b[1]) + 0.2 * linked, 4)

    want = []
    for a in (rows[0], rows[3]):
        ranked = sorted(((-pair(a, b), b[0]) for b in rows if b[0] != a[0] and pair(a, b) > 0))[:3]
        want += [(a[0], i, -s) for s, i in ranked]
    assert got == want


ALARMS = [
    ("A1", "ALM-51020", ["disk array is full"]), ("A2", "ALM-51021", ["certificate is about to expire"]),
    ("A3", "ALM-151", ["certificate is about to expire", "Certificate expires"]),
]


def alarm_tables(spark):
    e = spark.createDataFrame([(i, "alarm", n, a, "d", {}, [], "L0_SYNTHETIC", "s", "active") for i, n, a in ALARMS], ENTITY)
    names = e.select("entity_id", "entity_type", F.posexplode(F.concat(F.array("entity_name"), "alias")).alias("name_idx", "name")).withColumn("is_canonical", F.col("name_idx") == 0)
    return e, names


@pytest.mark.parametrize("text,status,linked,tops", [
    ("What is alarm 51?", "no_match", "", ""),
    ("Explain ALM-5102.", "no_match", "", ""),
    ("Check ALM-51020 and ALM-51021", "linked", "A1", "A1"),
    ("what to do if Certificate is about to expire?", "ambiguous", "", "A2,A3"),
    ("Open the operations dashboard.", "not_required", "", ""),
    ("Any alarm?", "no_match", "", ""),
    ("  ", "invalid_input", "", ""),
])
def test_alarm_pipeline(spark, text, status, linked, tops):
    e, names = alarm_tables(spark)
    got = L.link_catalog(spark.createDataFrame([(1, text)], "query_id long, query string"), e, names, alarm_only=True).first()
    assert (got.status, got.linked_ids, got.top_ids) == (status, linked, tops)


def test_alarm_mentions_of_a_mixed_catalogue_go_to_alarm_keys(spark):
    """A name that is part of an alarm's isn't one; the other types still match in part."""
    e, names = alarm_tables(spark)
    host = spark.createDataFrame([("N1", "ne", "host alpha", [], "d", {}, [], "L0_SYNTHETIC", "s", "active")], ENTITY)
    names = names.unionByName(spark.createDataFrame([("N1", "ne", 0, "host alpha", True)], "entity_id string, entity_type string, name_idx int, name string, is_canonical boolean"))
    q = spark.createDataFrame([(1, "check x"), (2, "check y"), (3, "check z")], "query_id long, query string")
    said = spark.createDataFrame([(1, [("certificate is about to expir", "alarm")]), (2, [("ALM-5102", "alarm"), ("host alpha two", "ne")]), (3, [])], "query_id long, mentions array<struct<text:string,predicted_type:string>>")
    got = {x.query_id: x for x in L.link_catalog(q, e.unionByName(host), names, proposals=said).collect()}
    assert (got[1].status, got[1].top_ids) == ("ambiguous", "A2,A3")
    assert (got[2].status, got[2].linked_ids) == ("partial", "N1")
    assert (got[3].status, got[3].n_mentions) == ("no_match", 0)


def test_proposals_replace_detected_mentions(spark):
    e, names = alarm_tables(spark)
    q = spark.createDataFrame([(k, "Check ALM-51020 now") for k in range(5)], "query_id long, query string")
    kind = "query_id long, mentions array<struct<text:string,predicted_type:string>>"
    said = spark.createDataFrame([(0, [("x", "ne"), ("151", None), ("ALM-151", "alarm")]), (1, [("ALM-151", "no_type")]), (2, None), (3, [("host", None)])], kind)
    got = {x.query_id: x for x in L.link_catalog(q, e, names, alarm_only=True, proposals=said).collect()}
    # a type outside the catalogue's, no list and no row at all are degraded; without an alarm what was detected counts
    assert [(got[k].status, got[k].linked_ids, got[k].error_code) for k in range(5)] == [("linked", "A1", "llm_schema_error"), ("linked", "A1", "llm_schema_error"), ("linked", "A1", "llm_missing"), ("linked", "A1", None), ("linked", "A1", "llm_missing")]
    good = spark.createDataFrame([(0, [("151", None), ("ALM-151", "alarm")]), (4, [])], kind)
    got = {x.query_id: x for x in L.link_catalog(q, e, names, alarm_only=True, proposals=good, fallback=False).collect()}
    # the first alarm-shaped mention counts, and no alarm is named 151
    assert (got[0].status, got[0].n_mentions) == ("no_match", 1)
    assert (got[1].status, got[1].error_code, got[4].linked_ids) == ("dependency_failed", "dependency_failed", "A1")
