"""Sources, rules, safety, evaluation, publication, similarity and streams over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dictionary as D
from ..operators import evaluation as E
from ..operators import ledger as LG
from ..operators import publish as P
from ..operators import quality as Q
from ..operators import safety as S
from ..operators.similar import similar
from ..sources import files
from ..sources import raw as raw_sources
from ..sources import views as V
from ..sources.store import folder, write_out
from ..streaming import link_stream as LS
from . import linking as L
from .linking_queries import _P2
from .registry import query


FX = V.oracle_ctes("fx_entities")
NUM = "try_cast(substr(entity_id, 3) as bigint)"


# ---- sources ---------------------------------------------------------------
@query(f"with {FX} select entity_id, entity_name, coalesce(alias1, '') as alias, descr as \"desc\", coalesce(target, '') as target, 'L0_SYNTHETIC' as data_layer from fx_entities")
def catalog_scan(spark, sf_dir):
    path = folder(spark, "catalog")
    V.entities(spark, sf_dir).drop("data_layer", "status").write.json(path)
    e = files.read_catalog(spark, path, "lines")
    return e.select("entity_id", "entity_name", F.array_join("alias", ",").alias("alias"), "desc", F.coalesce(F.get("relationships", F.lit(0))["target_entity_id"], F.lit("")).alias("target"), "data_layer")


@query(f"with {FX} select entity_id, entity_type, cast(null as varchar) as data_layer, relation_type from fx_entities")
def entity_store_scan(spark, sf_dir):
    path = folder(spark, "store")
    V.entities(spark, sf_dir).drop("data_layer").write.json(path)
    return files.read_entity_store(spark, path, "lines").select("entity_id", "entity_type", "data_layer", F.get("relationships", F.lit(0))["relation_type"].alias("relation_type"))


@query(f"with {V.oracle_ctes('fx_words')} select entity_word, normalized_key, entity_id, source, match_mode, false as min_context_required, 0 as priority from fx_words")
def word_table_scan(spark, sf_dir):
    path = folder(spark, "words")
    V.words(spark, sf_dir).drop("min_context_required", "priority").write.json(path)
    return files.read_entity_words(spark, path, "lines").select("entity_word", "normalized_key", "entity_id", "source", "match_mode", "min_context_required", "priority")


@query(f"with {FX} select entity_type, count(*) as n from fx_entities group by 1 union all select 'base', count(*) from fx_entities where entity_type in ('region', 'nation')")
def catalog_union(spark, sf_dir):
    e = V.entities(spark, sf_dir)
    base, main = e.where("entity_type in ('region', 'nation')"), e.where("entity_type not in ('region', 'nation')")
    both = files.merge_catalogs([base], main)
    return both.groupBy("entity_type").agg(F.count("*").alias("n")).unionByName(base.agg(F.count("*").alias("n")).withColumn("entity_type", F.lit("base")))


GOLD = V.oracle_ctes("fx_gold_mentions", "fx_gold")


def queries_once(spark, sf_dir):
    """The view of the queries, written out: gold answers and results all come from it."""
    return {"fx_queries": write_out(V.view(spark, sf_dir, "fx_queries"), "queries")}


def gold(spark, sf_dir, made=None):
    """(gold queries, gold mentions) of the view, in the operators' columns."""
    made = made or queries_once(spark, sf_dir)
    m = V.view(spark, sf_dir, "fx_gold_mentions", made).withColumns({"span_end": F.col("span_start") + F.length("text"), "expected_ids": F.array("expected_entity_id")}).drop("expected_entity_id")
    m = write_out(m, "gold-mentions")
    g = V.view(spark, sf_dir, "fx_gold", made)
    per = m.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("expected_ids"))).alias("expected_ids"), F.count("*").alias("n_expected"))
    g = g.join(per.hint("merge"), "query_id", "left").withColumns({"expected_ids": F.coalesce("expected_ids", F.array().cast("array<string>")), "n_expected": F.coalesce("n_expected", F.lit(0))})
    return g, m


@query(f"with {GOLD} select cast(query_id as varchar) as query_id, cast(idx as integer) as idx, text, cast(span_start as integer) as span_start, cast(span_start + length(text) as integer) as span_end, expected_entity_id as ids, 'linked' as expected_status from fx_gold_mentions")
def gold_scan(spark, sf_dir):
    g, m = gold(spark, sf_dir)
    nested = m.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", F.array("span_start", "span_end").alias("span"), F.col("expected_ids").alias("expected_entity_ids"), "expected_type"))).alias("mentions"))
    path = folder(spark, "gold")
    g.join(nested.hint("merge"), "query_id", "left").select(F.col("query_id").cast("string").alias("id"), "query", "expected_status", "mentions").write.json(path)
    _, back = files.read_gold(spark, path, "lines")
    return back.select("query_id", "idx", "text", "span_start", "span_end", F.array_join("expected_ids", ",").alias("ids"), "expected_status")


@query(f"with {V.oracle_ctes('fx_queries')} select query_id, query, '[REDACTED]' as auth_token, 'offline' as mode, true as has_id from fx_queries")
def run_log(spark, sf_dir):
    """Run records of all linked queries, as read back; ids and times differ from run to run."""
    path = folder(spark, "runs")
    LS.append_runs(V.queries(spark, sf_dir).withColumn("auth_token", F.lit("x")), path)
    return spark.read.json(path).select("query_id", "query", "auth_token", "mode", F.col("run_id").isNotNull().alias("has_id"))


# ---- publication -----------------------------------------------------------
_CHANGES = f"""ch as (select entity_id, 1 as seq, 'upsert' as op, concat(entity_name, ' II') as name from fx_entities where entity_type = 'supplier' and {NUM} % 3 = 0
    union all select entity_id, 2, 'delete', entity_name from fx_entities where entity_type = 'supplier' and {NUM} % 6 = 0
    union all select concat('X:', {NUM}), 1, 'upsert', concat('New ', {NUM}) from fx_entities where entity_type = 'nation'),
last as (select entity_id, arg_max(op, seq) as op, arg_max(name, seq) as name from ch group by 1)"""


def _changes(e):
    s = e.where("entity_type = 'supplier'").withColumn("n", F.expr(NUM))
    up = s.where("n % 3 = 0").withColumns({"entity_name": F.concat("entity_name", F.lit(" II")), "seq": F.lit(1), "op": F.lit("upsert")}).drop("n")
    gone = s.where("n % 6 = 0").withColumns({"seq": F.lit(2), "op": F.lit("delete")}).drop("n")
    new = e.where("entity_type = 'nation'").withColumns({"entity_id": F.concat(F.lit("X:"), F.expr(NUM)), "entity_name": F.concat(F.lit("New "), F.expr(NUM)), "seq": F.lit(1), "op": F.lit("upsert")})
    return up.unionByName(gone).unionByName(new)


@query(f"with {FX}, {_CHANGES} select entity_id, entity_name from fx_entities where entity_id not in (select entity_id from last) union all select entity_id, name from last where op = 'upsert'")
def publish_upsert(spark, sf_dir):
    e = V.entities(spark, sf_dir)
    return P.upsert(e, _changes(e)).select("entity_id", "entity_name")


@query(f"""with {FX}, r as (select entity_id, entity_name as w, 0 as i from fx_entities union all select entity_id, alias1, 1 from fx_entities where alias1 is not null)
select entity_id, lower(replace(w, ' ', '')) as normalized_key, arg_min(w, i) as entity_word, case when min(i) = 0 then 'entity_name' else 'confirmed_alias' end as source from r group by 1, 2""")
def rebuild_words(spark, sf_dir):
    return D.rebuild_words(V.entities(spark, sf_dir)).select("entity_id", "normalized_key", "entity_word", "source")


@query(f"""with {V.oracle_ctes('fx_words')}, {_CHANGES}, after as (select entity_id, entity_name as name, alias1 from fx_entities where entity_id not in (select entity_id from last)
    union all select l.entity_id, name, (select e.alias1 from fx_entities e where e.entity_id = l.entity_id or e.entity_id = replace(l.entity_id, 'X:', 'N:')) from last l where op = 'upsert'),
rw as (select entity_id, name as entity_word, lower(replace(name, ' ', '')) as normalized_key, 'entity_name' as source from after union all select entity_id, alias1, lower(replace(alias1, ' ', '')), 'confirmed_alias' from after where alias1 is not null),
st as (select entity_id, entity_word, normalized_key, source from fx_words)
select *, 'rebuilt' as side from (select * from rw except all select * from st) union all select *, 'stored' from (select * from st except all select * from rw)""")
def word_diff(spark, sf_dir):
    e = V.entities(spark, sf_dir)
    return P.word_diff(D.rebuild_words(P.upsert(e, _changes(e))), V.words(spark, sf_dir))


@query(f"""with {FX}, {_CHANGES}, after as (select entity_id, entity_name as name, alias1 from fx_entities where entity_id not in (select entity_id from last)
    union all select l.entity_id, name, (select e.alias1 from fx_entities e where e.entity_id = l.entity_id) from last l where op = 'upsert')
select entity_id, name as entity_word, lower(replace(name, ' ', '')) as normalized_key from after union all select entity_id, alias1, lower(replace(alias1, ' ', '')) from after where alias1 is not null""")
def publish_version(spark, sf_dir):
    """Sound changes become a new version of both tables; its words, as read back."""
    e, path = V.entities(spark, sf_dir), folder(spark, "version")
    changes = _changes(e).withColumn("alias", F.when(F.col("entity_id").startswith("X:"), F.array().cast("array<string>")).otherwise(F.col("alias")))
    _, written = P.publish(e, changes, path, "v2")
    assert written
    return spark.read.parquet(f"{path}/v2/entity_words").select("entity_id", "entity_word", "normalized_key")


@query(f"with {FX} select 'entity_words' as \"table\", lower(alias1) as key, 'normalized_key' as field, 'key_conflict' as error_code, 'error' as severity, false as written from fx_entities where entity_type = 'nation'")
def publish_refused(spark, sf_dir):
    """Changes that give a nation's alias to a second entity: nothing is written, the violations say why."""
    e = V.entities(spark, sf_dir)
    found, written = P.publish(e, _changes(e), folder(spark, "version"), "v2")
    return found.withColumn("written", F.lit(written))


def _published(spark, sf_dir):
    """A base folder: each entity type loaded by a request of its own, then changes, sent twice, and a refused request."""
    e, base = V.entities(spark, sf_dir), folder(spark, "published")
    load = e.withColumns({"request_id": F.concat(F.lit("load-"), "entity_type"), "op": F.lit("upsert"), "seq": F.lit(0)})
    assert LG.publish_requests(spark, base, load).written
    changes = _changes(e).withColumns({"request_id": F.lit("change"), "alias": F.when(F.col("entity_id").startswith("X:"), F.array().cast("array<string>")).otherwise(F.col("alias"))})
    assert LG.publish_requests(spark, base, changes).number == 2
    assert not LG.publish_requests(spark, base, changes.unionByName(load)).written
    assert not LG.publish_requests(spark, base, _changes(e).withColumn("request_id", F.lit("clash"))).written
    return base


@query(f"""with {FX}, {_CHANGES}, after as (select entity_id, entity_name as name, alias1 from fx_entities where entity_id not in (select entity_id from last)
    union all select l.entity_id, name, (select e.alias1 from fx_entities e where e.entity_id = l.entity_id) from last l where op = 'upsert')
select entity_id, name as entity_word, lower(replace(name, ' ', '')) as normalized_key, cast(2 as integer) as number from after union all select entity_id, alias1, lower(replace(alias1, ' ', '')), 2 from after where alias1 is not null""")
def publish_requests(spark, sf_dir):
    """The words of the current version after requests that came once, twice or not soundly."""
    now = LG.read_version(spark, _published(spark, sf_dir))
    return now.words.select("entity_id", "entity_word", "normalized_key", F.lit(now.number).alias("number"))


@query(f"with {FX} select distinct concat('load-', entity_type) as request_id, cast(1 as integer) as number from fx_entities union all select 'change', 2")
def request_ledger(spark, sf_dir):
    """The requests that were taken in, with their versions."""
    return LG.requests(spark, _published(spark, sf_dir))


@query(f"""with {FX}, n as (select entity_id, case when entity_type = 'supplier' and {NUM} % 3 = 0 then concat(entity_name, ' II') else entity_name end as name, alias1 from fx_entities where not (entity_type = 'supplier' and {NUM} % 7 = 0)),
r as (select entity_id, name as w, 0 as i from n union all select entity_id, alias1, 1 from n where alias1 is not null)
select entity_id, lower(replace(w, ' ', '')) as normalized_key, arg_min(w, i) as entity_word, case when min(i) = 0 then 'entity_name' else 'confirmed_alias' end as source from r group by 1, 2""")
def rebuild_words_of(spark, sf_dir):
    """Words after some suppliers took new names and some left: those made anew for them, the others as they were."""
    e, n = V.entities(spark, sf_dir), F.expr(NUM)
    supplier = F.col("entity_type") == "supplier"
    after = e.where(~supplier | (n % 7 != 0)).withColumn("entity_name", F.when(supplier & (n % 3 == 0), F.concat("entity_name", F.lit(" II"))).otherwise(F.col("entity_name")))
    touched = e.where(supplier & ((n % 3 == 0) | (n % 7 == 0)))
    return D.rebuild_words(after, touched, D.rebuild_words(e)).select("entity_id", "normalized_key", "entity_word", "source")


# ---- rules: the view is spoilt by rule, so that each finds something -----------
def spoilt(spark, sf_dir):
    n = F.expr(NUM)
    cust = F.col("entity_type") == "customer"
    relation = V.relation_type()
    extra = F.array(F.struct(F.lit("N:999").alias("target_entity_id"), F.lit("located_in").alias("relation_type"), F.lit("x").alias("source"), F.lit("x").alias("data_layer")))
    twice = F.transform("relationships", lambda r: F.struct(r["target_entity_id"].alias("target_entity_id"), F.upper(r["relation_type"]).alias("relation_type"), r["source"].alias("source"), r["data_layer"].alias("data_layer")))
    return V.entities(spark, sf_dir).withColumns({
        "relationships": F.when(cust & (n % 50 == 1), F.concat("relationships", extra)).when(cust & (n % 50 == 2), F.concat("relationships", twice)).otherwise(F.col("relationships")).cast(relation),
        "alias": F.when(cust & (n % 50 == 3), F.concat("alias", F.transform("alias", F.lower))).otherwise(F.col("alias")),
        "data_layer": F.when(cust & (n % 50 == 4), "L3_REAL_READONLY").otherwise(F.col("data_layer")),
        "entity_type": F.when(cust & (n % 50 == 5), "unknown_type").otherwise(F.col("entity_type")),
        "entity_name": F.when(cust & (n % 50 == 6), "  ").otherwise(F.col("entity_name")),
    })


TYPES = ["region", "nation", "supplier", "customer", "part_name"]
_C = f"with {FX}, c as (select *, {NUM} as n from fx_entities where entity_type = 'customer')"


def _v(table, key, field, code, severity="error"):
    return f"select '{table}' as \"table\", cast({key} as varchar) as key, {field} as field, '{code}' as error_code, '{severity}' as severity"


@query(f"{_C} {_v('entities', 'entity_id', chr(39) + 'entity_name' + chr(39), 'missing_field')} from c where n % 50 = 6 union all {_v('entities', 'entity_id', chr(39) + 'entity_type' + chr(39), 'invalid_value')} from c where n % 50 = 5")
def rule_required(spark, sf_dir):
    return Q.required(spoilt(spark, sf_dir), "entities", "entity_id", ["entity_id", "entity_type", "entity_name"], {"entity_type": TYPES})


@query(f"{_v('orders', 'o_custkey', chr(39) + 'o_custkey' + chr(39), 'duplicate_id')} from (select o_custkey from orders group by 1 having count(*) > 1)")
def rule_dup_id(spark, sf_dir):
    return Q.duplicate_ids(V.table(spark, sf_dir, "orders"), "orders", "o_custkey")


@query(f"{_C} {_v('entities', 'entity_id', chr(39) + 'N:999' + chr(39), 'relationship_target_missing')} from c where n % 50 = 1")
def rule_dangling(spark, sf_dir):
    return Q.dangling_relations(spoilt(spark, sf_dir))


@query(f"{_C} {_v('entities', 'entity_id', 'target', 'duplicate_relationship')} from c where n % 50 = 2")
def rule_dup_rel(spark, sf_dir):
    return Q.duplicate_relations(spoilt(spark, sf_dir))


@query(f"""{_C}, cnt as (select case when entity_type = 'customer' and {NUM} % 50 = 5 then 'unknown_type' else entity_type end as t, count(*) as c from fx_entities group by 1)
{_v('entities', 't', chr(39) + 'count' + chr(39), 'metadata_count_mismatch')} from (select said.t, coalesce(cnt.c, 0) as c, w from (values ('region', 5), ('nation', 24), ('*', 1)) said(t, w) left join (select * from cnt union all select '*', sum(c) from cnt) cnt on cnt.t = said.t) where c <> w
union all {_v('entities', 't', chr(39) + 'entity_type' + chr(39), 'type_out_of_scope')} from cnt where t = 'unknown_type'""")
def rule_metadata(spark, sf_dir):
    return Q.metadata_mismatch(spoilt(spark, sf_dir), "entities", {"region": 5, "nation": 24, "*": 1}, TYPES)


@query(f"{_C} {_v('entities', 'entity_id', chr(39) + 'data_layer' + chr(39), 'layer_not_allowed')} from c where n % 50 = 4")
def rule_layer(spark, sf_dir):
    return Q.layer_gate(spoilt(spark, sf_dir), ["L0_SYNTHETIC", "L1_SANITIZED"])


@query(f"{_C} {_v('entities', 'entity_id', chr(39) + 'alias' + chr(39), 'duplicate_alias')} from c where n % 50 = 3")
def rule_alias(spark, sf_dir):
    return Q.alias_rules(spoilt(spark, sf_dir))


@query(f"""with {V.oracle_ctes('fx_words')}, w as (select *, {NUM} as n, row_number() over () as r from fx_words where entity_type = 'supplier')
{_v('entity_words', 'entity_word', chr(39) + 'entity_word' + chr(39), 'key_mismatch')} from w where n % 10 = 1
union all {_v('entity_words', 'entity_word', chr(39) + 'entity_word' + chr(39), 'source_not_allowed')} from w where n % 10 = 2
union all {_v('entity_words', 'entity_word', chr(39) + 'entity_word' + chr(39), 'version_not_allowed')} from w where n % 10 = 3
union all {_v('entity_words', 'entity_word', chr(39) + 'entity_word' + chr(39), 'entity_missing')} from w where n % 10 = 4
union all {_v('entity_words', 'entity_word', chr(39) + 'entity_word' + chr(39), 'word_not_a_name')} from w where n % 10 = 5""")
def rule_word(spark, sf_dir):
    n = F.expr(NUM)
    s = F.col("entity_type") == "supplier"
    w = V.words(spark, sf_dir).withColumns({
        "normalized_key": F.when(s & (n % 10 == 1), F.concat("normalized_key", F.lit("!"))).otherwise(F.col("normalized_key")),
        "source": F.when(s & (n % 10 == 2), "guess").otherwise(F.col("source")),
        "normalization_version": F.when(s & (n % 10 == 3), "v0").otherwise(F.col("normalization_version")),
        "entity_id": F.when(s & (n % 10 == 4), F.concat(F.lit("Z:"), "entity_id")).when(s & (n % 10 == 5), "R:1").otherwise(F.col("entity_id")),
    })
    return Q.word_rules(w, V.entities(spark, sf_dir))


@query(f"""with {V.oracle_ctes('fx_words')}, w as (select entity_id, case when entity_type = 'supplier' then concat('k', {NUM} % 20) else normalized_key end as k from fx_words
    union all select entity_id, normalized_key from fx_words where entity_type = 'region'), per as (select k, count(distinct entity_id) as e, count(*) as n from w group by 1)
{_v('entity_words', 'k', chr(39) + 'normalized_key' + chr(39), 'key_conflict')} from per where e > 1
union all {_v('entity_words', 'k', chr(39) + 'normalized_key' + chr(39), 'duplicate_key', 'warning')} from per where e = 1 and n > 1""")
def rule_key_conflict(spark, sf_dir):
    w = V.words(spark, sf_dir).withColumn("normalized_key", F.when(F.col("entity_type") == "supplier", F.concat(F.lit("k"), F.expr(NUM) % 20)).otherwise(F.col("normalized_key")))
    return Q.key_conflicts(w.unionByName(w.where("entity_type = 'region'")))


@query(f"""with {GOLD}
{_v('gold', "concat_ws('#', query_id, idx)", chr(39) + 'span' + chr(39), 'span_mismatch')} from fx_gold_mentions where query_id % 97 = 1
union all {_v('gold', 'query_id', "concat(expected_entity_id, '?')", 'unknown_entity')} from fx_gold_mentions where query_id % 97 = 2
union all {_v('gold', 'query_id', chr(39) + 'expected_ids' + chr(39), 'id_set_mismatch')} from (select distinct query_id from fx_gold_mentions where query_id % 97 in (2, 3))
union all {_v('gold', 'query_id', chr(39) + 'expected_status' + chr(39), 'status_shape')} from (select query_id from fx_gold where query_id % 97 = 4 and template in (1, 2))""")
def rule_gold(spark, sf_dir):
    g, m = gold(spark, sf_dir)
    k = F.col("query_id") % 97
    m = m.withColumns({"span_start": F.when(k == 1, F.col("span_start") + 1).otherwise(F.col("span_start")), "expected_ids": F.when(k == 2, F.transform("expected_ids", lambda x: F.concat(x, F.lit("?")))).otherwise(F.col("expected_ids"))})
    m = m.withColumn("span_end", F.col("span_start") + F.length("text"))
    bad = F.array_append(F.col("expected_ids"), "R:1x")
    g = g.withColumns({"expected_ids": F.when((k == 3) & (F.col("n_expected") > 0), bad).otherwise(F.col("expected_ids")), "expected_status": F.when(k == 4, "linked").otherwise(F.col("expected_status"))})
    return Q.gold_rules(g, m, V.entities(spark, sf_dir))


@query(f"{_C} {_v('entities', 'entity_id', chr(39) + 'data_version' + chr(39), 'version_mismatch')} from c where n % 40 = 7")
def rule_version(spark, sf_dir):
    e = V.entities(spark, sf_dir)
    stale = (F.col("entity_type") == "customer") & (F.expr(NUM) % 40 == 7)
    return Q.version_mismatch("v2", e.withColumn("data_version", F.when(stale, "v1").otherwise("v2")), "data_version")


@query(f"""{_v('raw', 'event_id', chr(39) + 'raw' + chr(39), 'malformed_row')} from events where event_id % 40 = 3
union all {_v('raw', 'event_id', chr(39) + 'raw' + chr(39), 'missing_field')} from events where event_id % 40 = 4""")
def rule_ingest(spark, sf_dir):
    k = F.col("event_id") % 40
    raw = V.table(spark, sf_dir, "events").select("event_id", F.when(k == 3, "{broken").when(k == 4, '{"j": 1}').otherwise(F.col("props")).alias("raw"))
    return Q.well_formed(raw, "event_id", "raw", "k int", ["k"])


# ---- safety ----------------------------------------------------------------
@query("""select event_id, case when event_type <> 'error' then event_type else '' end as severity, case when length(event_type) > 4 then concat(event_type, ', ', 'x') else '' end as category,
    cast(3 + case when event_type = 'error' then 1 else 0 end + case when length(event_type) <= 4 then 1 else 0 end as integer) as omitted from events""")
def safe_attributes(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", "my secret").otherwise(F.col("event_type"))
    items = F.when(F.length("event_type") > 4, F.to_json(F.array("event_type", F.lit("x")))).otherwise(F.lit("[1,2]"))
    m = F.create_map(F.lit("severity"), value, F.lit("category"), items, F.lit("auth_token"), F.lit("x"), F.lit("domain"), F.lit('{"a":1}'), F.lit("unlisted"), F.lit("y"))
    a = e.withColumn("a", S.safe_attributes(m))
    get = lambda k: F.coalesce(F.col("a.safe")[k], F.lit(""))
    return a.select("event_id", get("severity").alias("severity"), get("category").alias("category"), F.col("a.omitted").alias("omitted"))


@query("select event_id, '[REDACTED]' as payload, '[REDACTED]' as user_token, event_type as kind, '[REDACTED]' as inner_host, value as inner_value, '[REDACTED]' as map_url, cast(user_id as varchar) as map_user from events")
def redact(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    nested = e.select(
        "event_id", F.col("props").alias("payload"), F.col("user_id").alias("user_token"), F.struct(F.col("event_type").alias("kind"), F.struct(F.col("event_type").alias("Host"), "value").alias("inner")).alias("s"),
        F.create_map(F.lit("base_url"), F.lit("http://x"), F.lit("user"), F.col("user_id").cast("string")).alias("m"),
    )
    r = S.redact(nested)
    return r.select("event_id", "payload", "user_token", F.col("s.kind").alias("kind"), F.col("s.inner.Host").alias("inner_host"), F.col("s.inner.value").alias("inner_value"), F.col("m")["base_url"].alias("map_url"), F.col("m")["user"].alias("map_user"))


@query("""select event_id, '[REDACTED]' as api_token, cast(user_id as varchar) as user, '[REDACTED]' as secret, concat('["', event_type, '","x"]') as tags, '{"password":"[REDACTED]","kind":"' || event_type || '"}' as inner from events""")
def redact_maps(spark, sf_dir):
    """Maps of numbers, of arrays and of structures: values under forbidden keys go, the others are kept as text."""
    e = V.table(spark, sf_dir, "events")
    r = S.redact(e.select(
        "event_id", F.create_map(F.lit("API_token"), "user_id", F.lit("user"), "user_id").alias("numbers"),
        F.create_map(F.lit("secret"), F.array("event_type"), F.lit("tags"), F.array("event_type", F.lit("x"))).alias("lists"),
        F.create_map(F.lit("inner"), F.struct(F.lit("x").alias("password"), F.col("event_type").alias("kind"))).alias("parts"),
    ))
    get = lambda m, k: F.col(m)[k]
    return r.select("event_id", get("numbers", "API_token").alias("api_token"), get("numbers", "user").alias("user"), get("lists", "secret").alias("secret"), get("lists", "tags").alias("tags"), get("parts", "inner").alias("inner"))


@query("""select concat('p', page_id) as source, 1 as findings, false as ok from pages where regexp_matches(url, 'https?://[^\\s"''<>]+') union all select concat('p', page_id), 0, true from pages where not regexp_matches(url, 'https?://[^\\s"''<>]+')
union all select concat('e', event_id), case event_id % 4 when 0 then 2 when 1 then 1 when 2 then 1 else 0 end, event_id % 4 = 3 from events""")
def secret_scan(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("source"), F.concat(F.lit("see "), "url").alias("text"))
    h = F.md5(F.col("event_id").cast("string"))
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Authorization: Bearer "), h, F.lit(" and sk-"), h)).when(k == 1, F.concat(F.lit("x raw_request "), h)).when(k == 2, F.concat(F.lit("bearer "), h)).otherwise(F.concat(F.lit("bearer of news, https://localhost/"), h))
    events = V.table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("source"), text.alias("text"))
    return S.scan_summary(pages.unionByName(events)).select("source", F.col("findings").cast("int").alias("findings"), "ok")


@query(f"""with recursive {_P2}, ag as (select query_id, count(*) as n, count(*) filter (where status = 'linked') as l from res group by 1)
select q.query_id, case when ag.query_id is null then case when template = 2 then 'not_required' else 'no_match' end when l = n then 'linked' when l > 0 then 'partial' else 'no_match' end as status,
    case when ag.query_id is null then case when template = 2 then 'entity linking is not required' else 'no entity candidate found' end when l = n then 'all detected mentions linked'
         when l > 0 then 'partial result: at least one mention linked and at least one mention unresolved' else 'no entity candidate found' end as safe_summary
from fx_queries q left join ag using (query_id)""")
def result_projection(spark, sf_dir):
    from .projection import result_projection as project

    return project(L.link_words(V.queries(spark, sf_dir), V.words(spark, sf_dir), V.entities(spark, sf_dir))).select("query_id", "status", "safe_summary")


# ---- evaluation: the word-table pipeline against the gold view ------------------
_EVAL = f"""{V.oracle_ctes('fx_words', 'fx_queries', 'fx_gold_mentions', 'fx_gold')}, {_P2[len(V.oracle_ctes('fx_words', 'fx_queries')) + 2:]},
ag as (select query_id, count(*) as n, count(*) filter (where status = 'linked') as l from res group by 1),
qs as materialized (select q.query_id, template, case when ag.query_id is null then case when template = 2 then 'not_required' else 'no_match' end when l = n then 'linked' when l > 0 then 'partial' else 'no_match' end as status, coalesce(n, 0) as n from fx_queries q left join ag using (query_id)),
mt as (select g.query_id, g.idx, r.mention_idx, case when lower(replace(g.text, ' ', '')) = r.normalized_key then 0 else 1 end as tier from fx_gold_mentions g join res r on r.query_id = g.query_id
    and (lower(replace(g.text, ' ', '')) = r.normalized_key or contains(r.normalized_key, lower(replace(g.text, ' ', ''))) or contains(lower(replace(g.text, ' ', '')), r.normalized_key))),
mg as materialized (select g.query_id, g.idx, b.tier, b.mention_idx from fx_gold_mentions g left join (select * from mt qualify row_number() over (partition by query_id, idx order by tier, mention_idx) = 1) b on b.query_id = g.query_id and b.idx = g.idx),
mc as materialized (select g.query_id, g.idx, 'linked' as expected_status, coalesce(r.status, 'missing') as actual_status, g.expected_type, coalesce(r.entity_type, '') as actual_type, coalesce(r.entity_id, '') as actual_id,
    coalesce(r.status = 'linked' and r.entity_id = g.expected_entity_id, false) as passed
    from fx_gold_mentions g join mg on mg.query_id = g.query_id and mg.idx = g.idx left join res r on r.query_id = mg.query_id and r.mention_idx = mg.mention_idx),
ux as materialized (select r.* from res r where not exists (select 1 from mg where mg.query_id = r.query_id and mg.mention_idx = r.mention_idx)),
ms as materialized (select *, passed::int as tp, (not passed and actual_id <> '')::int as fp, (not passed)::int as fn, 0 as tn, 0 as nfp from mc
    union all select query_id, mention_idx + 1000, 'unexpected', status, '', coalesce(entity_type, ''), coalesce(entity_id, ''), false, 0, 1, 0, 0, (entity_id is not null)::int from ux),
pc as (select query_id, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, bool_and(passed) as ap, sum(nfp) as nfp, bool_or(actual_id <> '') as anyid, arg_min(concat('expected ', expected_status, ', got ', actual_status), idx) filter (where not passed) as failed from ms group by 1),
cs as (select g.query_id, g.expected_status, qs.status as actual_status, g.template in (1, 2) as at_query,
    case when g.template in (1, 2) then qs.status = 'no_match' and not coalesce(anyid, false) else qs.status = g.expected_status end as qp, coalesce(ap, true) as ap, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(pc.nfp, 0) as nfp, failed
    from fx_gold g join qs on qs.query_id = g.query_id left join pc on pc.query_id = g.query_id),
cc as (select query_id, expected_status, actual_status, qp and ap as passed, case when qp and ap then '' else coalesce(failed, concat('expected status=', expected_status, ', got status=', actual_status)) end as reason,
    tp, fp + (at_query and not qp)::int as fp, fn, (at_query and qp)::int as tn, nfp + (at_query and not qp)::int as nfp from cs)"""
_N = ", ".join(f"cast({c} as bigint) as {c}" for c in E.COUNTS)


def _actual(spark, sf_dir, made):
    w, e = V.words(spark, sf_dir), V.entities(spark, sf_dir)
    found = L.word_mentions(made["fx_queries"].select("query_id", "query"), w, e)
    return write_out(found.withColumn("candidate_ids", F.when(F.col("entity_id").isNotNull(), F.array("entity_id")).otherwise(F.array().cast("array<string>"))), "actual-mentions")


def _judged(spark, sf_dir):
    """(gold queries, gold mentions, actual mentions, query results)"""
    made = queries_once(spark, sf_dir)
    g, m = gold(spark, sf_dir, made)
    actual = _actual(spark, sf_dir, made)
    return g, m, actual, L.query_results(made["fx_queries"].select("query_id", "query"), actual)


def _mention_cases(spark, sf_dir, strict=False):
    _, m, actual, _ = _judged(spark, sf_dir)
    return E.score_mentions(m, actual, strict)


def _cases(spark, sf_dir):
    g, m, actual, results = _judged(spark, sf_dir)
    return E.score_cases(g, results, E.score_mentions(m, actual))


@query(f"with recursive {_EVAL} select query_id, cast(idx as integer) as idx, cast(tier as integer) as tier, cast(mention_idx as integer) as mention_idx from mg")
def gold_match(spark, sf_dir):
    _, m, actual, _ = _judged(spark, sf_dir)
    return E.match_gold(m, actual)


@query(f"with recursive {_EVAL} select query_id, cast(mention_idx as integer) as mention_idx, text, status from ux")
def unexpected_mentions(spark, sf_dir):
    _, m, a, _ = _judged(spark, sf_dir)
    return E.unexpected_mentions(E.match_gold(m, a), a).select("query_id", "mention_idx", "text", "status")


@query(f"with recursive {_EVAL} select query_id, cast(idx as integer) as idx, expected_status, actual_status, expected_type, actual_type, actual_id, passed, tp, fp, fn, tn, nfp from ms")
def eval_mentions(spark, sf_dir):
    return _mention_cases(spark, sf_dir)


@query(f"with recursive {_EVAL} select query_id, expected_status, actual_status, passed, reason, {_N} from cc")
def eval_cases(spark, sf_dir):
    return _cases(spark, sf_dir)


@query(f"""with recursive {_EVAL}, t as (select count(*) as total, count(*) filter (where passed) as pass, count(*) filter (where not passed) as fail, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn, sum(nfp) as nfp from cc)
select total, pass, fail, {_N}, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, '' as notes, false as passed from t""")
def eval_totals(spark, sf_dir):
    return E.totals(_cases(spark, sf_dir))


@query(f"""with recursive {_EVAL}, t as (select count(*) as total, count(*) filter (where passed) as pass, count(*) filter (where not passed) as fail, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn, sum(nfp) as nfp from cc)
select total, pass, fail, {_N}, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, '' as notes, false as passed from t""")
def evaluate(spark, sf_dir):
    """The whole evaluation of the word pipeline: gate, scores, report; the report as read back."""
    g, m, actual, results = _judged(spark, sf_dir)
    path = folder(spark, "report")
    E.evaluate(g, m, results, actual, V.entities(spark, sf_dir), path)
    return E.read_report(spark, path)


@query(f"""with recursive {_EVAL}, u as (select expected_type as entity_type, tp, fn, 0 as fp from ms union all select actual_type, 0, 0, fp from ms), t as (select entity_type, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from u where entity_type <> '' group by 1)
select entity_type, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(case when tp + fp = 0 then 1.0 else tp / (tp + fp) end, 4) as precision, round(case when tp + fn = 0 then 1.0 else tp / (tp + fn) end, 4) as recall from t""")
def eval_by_type(spark, sf_dir):
    return E.by_type(_mention_cases(spark, sf_dir))


@query(f"""with recursive {_EVAL} select count(*) filter (where passed) as passed, count(*) as n from (
    select coalesce(mg.tier = 0 and r.status = 'linked' and r.entity_id = g.expected_entity_id and r.span_start = g.span_start, false) as passed from fx_gold_mentions g join mg on mg.query_id = g.query_id and mg.idx = g.idx left join res r on r.query_id = mg.query_id and r.mention_idx = mg.mention_idx)""")
def eval_strict(spark, sf_dir):
    c = _mention_cases(spark, sf_dir, strict=True).where("expected_status <> 'unexpected'")
    return c.agg(F.count_if("passed").alias("passed"), F.count("*").alias("n"))


@query(f"with {GOLD} select expected_status, count(*) as n from fx_gold group by 1")
def status_hist(spark, sf_dir):
    g, _ = gold(spark, sf_dir)
    return g.groupBy("expected_status").agg(F.count("*").alias("n"))


# ---- external proposals ------------------------------------------------------
@query(f"""with recursive {_P2}, pr as (select query_id, case when query_id % 5 = 0 then 'bad_type' when query_id % 5 < 3 then 'supplier' end as t from fx_queries where query_id % 5 < 4),
kn as (select query_id, count(*) as k from known group by 1)
select q.query_id, t is not null and t <> 'bad_type' as used, case when t = 'bad_type' or pr.query_id is null then true when t is null then true else false end as fallback_used,
    case when t = 'bad_type' then 'llm_schema_error' when pr.query_id is null or t is null then 'llm_missing' end as error_code, coalesce(case when t is not null and t <> 'bad_type' then 1 else k end, 0) as n_mentions
from fx_queries q left join pr using (query_id) left join kn using (query_id)""")
def merge_proposals(spark, sf_dir):
    from .proposals import merge_proposals as merge

    q, w = V.queries(spark, sf_dir), V.words(spark, sf_dir)
    k = F.col("query_id") % 5
    proposals = q.where(k < 3).select("query_id", F.array(F.struct(F.lit("text").alias("text"), F.when(k == 0, "bad_type").otherwise("supplier").alias("predicted_type"))).alias("mentions"))
    proposals = proposals.unionByName(q.where(k == 3).select("query_id", F.lit(None).cast(proposals.schema["mentions"].dataType).alias("mentions")))
    _, per_query = merge(q, proposals, L.known_mentions(q, w).withColumn("predicted_type", F.lit(None).cast("string")), TYPES)
    return per_query


# ---- similarity ---------------------------------------------------------------
@query(f"""with {FX}, src as (select * from fx_entities where entity_type in ('region', 'nation') or {NUM} % 20 = 0), p as (
    select s.entity_id as query_entity_id, e.entity_id, list_distinct(regexp_extract_all(lower(s.descr), '\\w+')) as x, list_distinct(regexp_extract_all(lower(e.descr), '\\w+')) as y, s.entity_type = e.entity_type as same, coalesce(s.target = e.entity_id, false) as nb
    from src s join fx_entities e on s.entity_id <> e.entity_id),
sc as (select query_entity_id, entity_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) as d, same, nb from p),
t as (select *, least(1, greatest(0, round(0.2 * d + 0.15 * same::int + 0.2 * nb::int, 4))) as score from sc)
select query_entity_id, entity_id, cast(score as double) as score, concat_ws(', ', case when d > 0 then 'desc semantic overlap' end, case when same then 'same entity type' end, case when nb then 'topology neighbor' end) as similarity_reason,
    cast(row_number() over (partition by query_entity_id order by score desc, entity_id) as integer) as rank from t where score > 0 qualify rank <= 5""")
def similar_native(spark, sf_dir):
    """Sources: all regions and nations, and every other entity whose number is divisible by 20."""
    e = V.entities(spark, sf_dir)
    return similar(e, e.where(f"entity_type in ('region', 'nation') or {NUM} % 20 = 0"), 5)


@query()
def similar_full(spark, sf_dir):
    """With name ratios, which SQL lacks; sources as in ``similar_native``. Tests compare all rows with the definition."""
    e = V.entities(spark, sf_dir)
    return similar(e, e.where(f"entity_type in ('region', 'nation') or {NUM} % 20 = 0"), 5, names=True)


# ---- preparation and streams ----------------------------------------------------
@query("""with r as (select case when p_partkey % 2 = 0 then p_name else upper(p_name) end as name, case when p_partkey % 3 = 0 then concat('A', p_partkey % 4) end as alias, case when p_partkey % 2 = 0 then 'c1' end as conf from part)
select concat('part:', lower(replace(name, ' ', ''))) as entity_id, min(name) as entity_name, coalesce(string_agg(distinct alias, ',' order by alias) filter (where conf is not null and alias is not null), '') as alias from r group by 1""")
def prepared_sources(spark, sf_dir):
    p = F.col("p_partkey")
    raw = V.table(spark, sf_dir, "part").select(
        F.lit("part").alias("entity_type"), F.when(p % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("entity_name"), F.when(p % 3 == 0, F.concat(F.lit("A"), p % 4)).alias("alias"),
        F.when(p % 2 == 0, "c1").alias("confirmation_id"), F.lit("d").alias("desc"),
    )
    entities, _ = P.prepare_sources(raw)
    return entities.select("entity_id", "entity_name", F.array_join("alias", ",").alias("alias"))


def _intake(spark, sf_dir):
    """Parts as a required source; customers as an optional one, of which every tenth line breaks off and every seventh
    of the others lacks a name; suppliers as an optional one whose columns are of another kind; one that isn't there."""
    def line(kind, name):
        return F.struct(F.lit(kind).alias("entity_type"), name.alias("entity_name"), F.lit("d").alias("desc"))

    base = folder(spark, "raw")
    V.table(spark, sf_dir, "part").select(line("part", F.col("p_name")).alias("r")).select("r.*").write.parquet(f"{base}/parts")
    key = F.col("c_custkey")
    whole = F.to_json(line("customer", F.when(key % 7 != 0, F.col("c_name")).otherwise(" ")))
    V.table(spark, sf_dir, "customer").select(F.when(key % 10 == 0, F.concat(F.lit('{"entity_name": '), key)).otherwise(whole).alias("value")).write.text(f"{base}/customers")
    V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_name"), F.lit("supplier").alias("entity_type")).write.parquet(f"{base}/suppliers")
    at = lambda name, required, layout: raw_sources.Source(name, f"{base}/{name}", required, layout)
    return raw_sources.read_sources(spark, [at("parts", True, "parquet"), at("customers", False, "lines"), at("suppliers", False, "parquet"), at("absent", False, "lines")])


@query("""with c as (select count(*) filter (where c_custkey % 10 <> 0 and c_custkey % 7 <> 0) as good, count(*) as n, count(distinct c_name) filter (where c_custkey % 10 <> 0 and c_custkey % 7 <> 0) as names from customer)
select 'parts' as source, true as required, 'ok' as status, count(*) as n_rows, 0::bigint as n_bad, count(distinct lower(replace(p_name, ' ', ''))) as n_entities from part
union all select 'customers', false, case when n > good then 'degraded' else 'ok' end, good, n - good, names from c union all select 'suppliers', false, 'failed', 0, 0, 0 union all select 'absent', false, 'failed', 0, 0, 0""")
def source_report(spark, sf_dir):
    """How each source of an intake fared, and how many entities it gave."""
    intake = _intake(spark, sf_dir)
    entities, _ = P.prepare_sources(intake.rows)
    made = entities.groupBy(F.concat("entity_type", F.lit("s")).alias("source")).agg(F.count("*").alias("n_entities"))
    return intake.report.join(made.hint("merge"), "source", "left").select("source", "required", "status", "n_rows", "n_bad", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


@query("""select 'customers' as source, case when c_custkey % 10 = 0 then concat('{"entity_name": ', c_custkey) else '{"entity_type":"customer","entity_name":" ","desc":"d"}' end as record,
    case when c_custkey % 10 = 0 then 'not JSON' else 'missing: entity_name' end as problem from customer where c_custkey % 10 = 0 or c_custkey % 7 = 0""")
def quarantined_rows(spark, sf_dir):
    """The rows that an intake puts aside."""
    return _intake(spark, sf_dir).quarantine.select("source", "record", "problem")


@query(f"""with recursive {V.oracle_ctes('fx_words', 'fx_queries')} select query_id, case when template in (0, 3, 4, 5) then 'linked' else 'no_match' end as status,
    case template when 0 then concat('P:', p_name, ',S:', skey) when 3 then concat('P:', p_name) when 4 then concat('P:', p_name, ',N:', nkey) when 5 then concat('P:', p_name, ',R:', rkey) else '' end as linked_ids, 'v1' as data_version from fx_queries""")
def link_stream(spark, sf_dir):
    """All queries as a stream, linked batch by batch, read back."""
    source, out = folder(spark, "stream-in"), folder(spark, "stream-out")
    queries = V.queries(spark, sf_dir)
    queries.write.parquet(source)
    words, entities = V.words(spark, sf_dir), V.entities(spark, sf_dir)
    stream = spark.readStream.schema(queries.schema).parquet(source)
    LS.link_stream(stream, lambda pinned: (words, entities, "v1"), out, folder(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("query_id", "status", "linked_ids", "data_version")


@query("select distinct user_id as query_id, '[REDACTED]' as user_token from events")
def run_log_stream(spark, sf_dir):
    """One record a user from the event stream, read back."""
    source, out = folder(spark, "log-in"), folder(spark, "log-out")
    events = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("user_token"))
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    LS.run_log_stream(stream, out, folder(spark, "log-checkpoint")).awaitTermination()
    return spark.read.schema("query_id long, user_token string").json(out).select("query_id", "user_token")
