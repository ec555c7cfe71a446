"""Scalar text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import views as V
from .registry import query

NORM = r"lower(regexp_replace({0}, '\s+', '', 'g'))"


@query(f"select doc_id, {NORM.format('text')} as norm from documents")
def norm_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


@query(f"with {V.oracle_ctes('fx_words')} select entity_id, entity_word, {NORM.format('entity_word')} as norm_key from fx_words")
def norm_word(spark, sf_dir):
    return V.view(spark, sf_dir, "fx_words").select("entity_id", "entity_word", X.normalize_word(F.col("entity_word")).alias("norm_key"))


@query(f"""with {V.oracle_ctes('fx_queries')}, c as (
    select query_id, query, unnest(range(length(query))) as i from fx_queries
) select query_id, {NORM.format('any_value(query)')} as norm, string_agg(i, ',' order by i) filter (where not regexp_matches(substr(query, i + 1, 1), '\\s')) as pos
from c group by query_id""")
def norm_offsets(spark, sf_dir):
    q = V.queries(spark, sf_dir).withColumn("n", X.normalize_query(F.col("query")))
    return q.select("query_id", F.col("n.norm").alias("norm"), F.concat_ws(",", F.col("n.pos").cast("array<string>")).alias("pos"))


@query(f"""with {V.oracle_ctes('fx_queries')}, c as (
    select query_id, i, row_number() over (partition by query_id order by i) - 1 as k
    from (select query_id, query, unnest(range(length(query))) as i from fx_queries) where not regexp_matches(substr(query, i + 1, 1), '\\s')
) select query_id, cast(min(i) filter (where k = 3) as integer) as span_start, cast(max(i) filter (where k = 11) + 1 as integer) as span_end, max(k) >= 1000 as beyond
from c group by query_id""")
def restore_span(spark, sf_dir):
    q = V.queries(spark, sf_dir).withColumn("n", X.normalize_query(F.col("query")))
    inside, beyond = (X.restore_span(F.col("n.pos"), F.lit(a), F.lit(b)) for a, b in ((3, 12), (0, 1001)))
    return q.withColumn("s", inside).select("query_id", "s.span_start", "s.span_end", beyond.isNotNull().alias("beyond"))


_IDS = """select s_suppkey as k, s_name as t from supplier union all select s_suppkey, concat('ALM-', s_suppkey) from supplier
    union all select s_suppkey, concat(' ', s_suppkey) from supplier union all select s_suppkey, concat('alm-', s_suppkey, 'x') from supplier"""


@query(f"""with ids as ({_IDS}) select k, t, regexp_replace({NORM.format('t')}, '^alm-', '') as dedup_key,
    regexp_matches(trim(t), '(?i)^(alm-\\d+|\\d+)$') as is_identifier from ids""")
def id_keys(spark, sf_dir):
    ids = spark.sql(_IDS.replace("from supplier", "from {supplier}"), supplier=V.table(spark, sf_dir, "supplier"))
    return ids.select("k", "t", X.alarm_dedup_key(F.col("t")).alias("dedup_key"), X.is_alarm_identifier(F.col("t")).alias("is_identifier"))


@query(f"""with {V.oracle_ctes('fx_entities')}, p as (
    select a.entity_id, list_distinct(regexp_extract_all(lower(a.descr), '\\w+')) as x, list_distinct(regexp_extract_all(lower(b.descr), '\\w+')) as y
    from fx_entities a join fx_entities b on a.target = b.entity_id
) select entity_id, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) as jaccard from p""")
def token_jaccard(spark, sf_dir):
    e = V.view(spark, sf_dir, "fx_entities")
    b = e.select(F.col("entity_id").alias("target"), F.col("descr").alias("other"))
    return e.join(b.hint("merge"), "target").select("entity_id", X.token_jaccard(F.col("descr"), F.col("other")).alias("jaccard"))


@query()
def seq_ratio(spark, sf_dir):
    """Names against their aliases; SQL has no such ratio, tests compare it with the definition."""
    e = V.view(spark, sf_dir, "fx_entities").where("alias1 is not null")
    a, b = X.normalize_text(F.col("entity_name")), X.normalize_text(F.col("alias1"))
    return e.select("entity_id", X.seq_ratio(a, b).alias("ratio"), X.ratio_bound(a, b).alias("bound"))


_WORDS = "show|check|query|open|compare|run|metrics?|kpi|usage|speed|iops|monitor|monitoring|abnormal"


@query(f"""with {V.oracle_ctes('fx_queries')}, t as (
    select cast(query_id as varchar) as id, query as text from fx_queries union all select concat('c', conv_id, '-', turn), text from conversations
) select id, regexp_matches(text, '(?i)\\b({_WORDS}|alarm)\\b|查询|查看|指标|网元|告警') as intent,
    regexp_matches(text, '(?i)\\b(dashboard|system health|health summary|operations dashboard)\\b') as not_required,
    regexp_matches(text, '(?i)\\balarm\\b|告警|ALM-\\d+') as alarm from t""")
def intent_gate(spark, sf_dir):
    q = V.queries(spark, sf_dir).select(F.col("query_id").cast("string").alias("id"), F.col("query").alias("text"))
    c = V.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    t = F.col("text")
    return q.unionByName(c).select("id", t.rlike(X.LINKING_INTENT).alias("intent"), t.rlike(X.NOT_REQUIRED).alias("not_required"), t.rlike(X.ALARM_INTENT).alias("alarm"))


@query(f"""with {V.oracle_ctes('fx_queries')}, s as (select query_id, query, instr(query, 'SUP-1') - 1 as a from fx_queries where instr(query, 'SUP-1') > 0
    union all select query_id, query, instr(query, p_name) - 1 from fx_queries where instr(query, p_name) > 0)
select query_id, cast(a as integer) as span_start, not regexp_matches(case when a > 0 then substr(query, a, 1) else '' end, '^[A-Za-z0-9]$')
    and not regexp_matches(substr(query, a + 6, 1), '^[A-Za-z0-9]$') as bounded from s""")
def boundary_guard(spark, sf_dir):
    q = V.view(spark, sf_dir, "fx_queries")
    a = q.select("query_id", "query", (F.instr("query", "SUP-1") - 1).alias("a")).unionByName(q.select("query_id", "query", (F.expr("locate(p_name, query)") - 1).alias("a"))).where("a >= 0")
    return a.select("query_id", F.col("a").alias("span_start"), X.has_token_boundary(F.col("query"), F.col("a"), F.col("a") + 5).alias("bounded"))


@query("select doc_id, contains(lower(text), 'license') or contains(lower(text), 'rights reserved') as confirmed from documents")
def context_gate(spark, sf_dir):
    pattern = X.context_pattern(F.array(F.lit("License"), F.lit("RIGHTS reserved")))
    return V.table(spark, sf_dir, "documents").select("doc_id", X.context_confirms(F.col("text"), pattern).alias("confirmed"))


_TOKENS = """
    select query_id, 17 as span_start, concat('SUP-', skey + 1000000) as text from fx_queries where template = 1
    union all select query_id, 5 + length(p_name) + 5, concat('Unknown-', okey) from fx_queries where template = 3
    union all select query_id, 8 + length(p_name) + 4, n_name from fx_queries where template = 4
"""


@query(f"with {V.oracle_ctes('fx_queries')} select query_id, cast(span_start as integer) as span_start, cast(span_start + length(text) as integer) as span_end, text from ({_TOKENS})")
def shaped_tokens(spark, sf_dir):
    """The SQL side builds the tokens from the queries' templates, since its regular expressions have no look-around."""
    from .linking import shaped_tokens as tokens

    return tokens(V.queries(spark, sf_dir))


@query("""select doc_id, len(regexp_extract_all(text, '[0-9]+')) as n_numbers, coalesce(regexp_extract(text, '[0-9]+'), '') as first_number from documents""")
def number_spans(spark, sf_dir):
    """All numbers of a text with their offsets; count and first text are compared, offsets must cut out the text again."""
    d = V.table(spark, sf_dir, "documents").withColumn("s", X.regex_spans(F.col("text"), r"[0-9]+"))
    ok = F.forall("s", lambda x: F.substring("text", x["span_start"] + 1, x["span_end"] - x["span_start"]) == x["text"])
    return d.select("doc_id", F.when(ok, F.size("s").cast("long")).otherwise(F.lit(-1).cast("long")).alias("n_numbers"), F.coalesce(F.get("s", F.lit(0))["text"], F.lit("")).alias("first_number"))
