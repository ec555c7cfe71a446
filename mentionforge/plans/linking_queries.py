"""Joins, selections and pipelines of linking over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates as C
from ..operators import dictionary as D
from ..operators.anchors import index_once
from ..sources import store
from ..sources import views as V
from . import linking as L
from .registry import query

# ---- SQL building blocks -------------------------------------------------
# q: queries with normalised text and the places of its characters
_Q = """q as (select query_id, query, lower(replace(query, ' ', '')) as norm,
    list_filter(range(length(query)), lambda i: substr(query, i + 1, 1) <> ' ') as pos from fx_queries)"""
# hit: every place of every key, found by its first four characters (no key is shorter)
_HIT = """g as (select query_id, p, substr(norm, p, 4) as gram from (select query_id, norm, unnest(range(1, length(norm) - 2)) as p from q)),
hit as (select q.query_id, q.query, w.entity_id, w.entity_type, w.entity_word, w.normalized_key, w.source, w.match_mode,
    cast(q.pos[g.p] as integer) as span_start, cast(q.pos[g.p + length(w.normalized_key) - 1] + 1 as integer) as span_end
    from g join fx_words w on substr(w.normalized_key, 1, 4) = g.gram join q on q.query_id = g.query_id and substr(q.norm, g.p, length(w.normalized_key)) = w.normalized_key)"""
_BOUND = """not regexp_matches(case when span_start > 0 then substr({q}, span_start, 1) else '' end, '^[A-Za-z0-9]$') and not regexp_matches(substr({q}, span_end + 1, 1), '^[A-Za-z0-9]$')"""
_OK = f"""ok as (select *, substr(query, span_start + 1, span_end - span_start) as text from hit where case when match_mode = 'CONTEXT_REQUIRED' then contains(lower(query), 'region')
    else {_BOUND.format(q='query')} end)"""


def greedy(source: str, name: str, order: str) -> str:
    """Recursive greedy choice of spans that don't overlap, leftmost first, then longest."""
    return f"""{name}_o as materialized (select *, row_number() over (partition by query_id order by span_start, span_start - span_end, {order}) as n from {source}),
{name}_r as (select query_id, n, true as taken, span_end as last_end from {name}_o where n = 1
    union all select o.query_id, o.n, o.span_start >= r.last_end, case when o.span_start >= r.last_end then o.span_end else r.last_end end
    from {name}_r r join {name}_o o on o.query_id = r.query_id and o.n = r.n + 1),
{name} as materialized (select o.*, row_number() over (partition by o.query_id order by o.n) - 1 as mention_idx from {name}_o o join {name}_r r on o.query_id = r.query_id and o.n = r.n where r.taken)"""


_P1 = f"{V.oracle_ctes('fx_words', 'fx_queries')}, {_Q}, {_HIT}, {_OK}, {greedy('ok', 'sel', 'entity_id')}"
# literal names in the raw text: lower-cased, white space kept, found by the first four characters
_LIT = f"""lw as (select distinct lower(entity_word) as k from fx_words),
lg as (select query_id, p, substr(low, p, 4) as gram, low from (select query_id, lower(query) as low, unnest(range(1, length(query) - 2)) as p from fx_queries)),
lit0 as (select lg.query_id, lw.k, cast(lg.p - 1 as integer) as span_start, cast(lg.p - 1 + length(lw.k) as integer) as span_end from lg join lw on substr(lw.k, 1, 4) = lg.gram and substr(lg.low, lg.p, length(lw.k)) = lw.k),
lit as materialized (select l.query_id, k, span_start, span_end, substr(q.query, span_start + 1, span_end - span_start) as text from lit0 l join fx_queries q on q.query_id = l.query_id where {_BOUND.format(q='q.query')}),
{greedy('lit', 'known', 'text')},
tok as (select query_id, cast(span_start as integer) as span_start, cast(span_start + length(text) as integer) as span_end, text from (
    select query_id, 17 as span_start, concat('SUP-', skey + 1000000) as text from fx_queries where template = 1
    union all select query_id, 5 + length(p_name) + 5, concat('Unknown-', okey) from fx_queries where template = 3
    union all select query_id, 8 + length(p_name) + 4, n_name from fx_queries where template = 4)),
unk as materialized (select t.* from tok t where not exists (select 1 from known k where k.query_id = t.query_id and t.span_start < k.span_end and k.span_start < t.span_end)),
men as (select query_id, span_start, span_end, text, known, row_number() over (partition by query_id order by span_start) - 1 as mention_idx from (
    select query_id, span_start, span_end, text, true as known from known union all select query_id, span_start, span_end, text, false from unk)),
res as materialized (select m.*, lower(replace(m.text, ' ', '')) as normalized_key, w.entity_id, w.entity_type,
    case when w.entity_id is not null then 'hit' else 'miss' end as word_status, case when w.entity_id is not null then 'linked' else 'no_match' end as status
    from men m left join fx_words w on w.normalized_key = lower(replace(m.text, ' ', '')))"""
_P2 = f"{V.oracle_ctes('fx_words', 'fx_queries')}, {_LIT}"


@query(f"with recursive {_P1} select query_id, entity_id, source, count(*) as places from hit group by all")
def match_words(spark, sf_dir):
    hits = D.match_words(V.queries(spark, sf_dir), V.words(spark, sf_dir))
    return hits.groupBy("query_id", "entity_id", "source").agg(F.count("*").alias("places"))


@query(f"with recursive {_P1} select query_id, entity_id, source, count(*) as places from hit group by all")
def match_words_indexed(spark, sf_dir):
    """As match_words, by an index that is built once, found again, and too large to broadcast: pieces go through its sieve."""
    q, w = V.queries(spark, sf_dir), V.words(spark, sf_dir)
    base = store.folder(spark, "word-anchors")
    for _ in range(2):
        index = index_once(w, "normalized_key", base, "v1", most_rows=0)
    return D.match_words(q, w, index).groupBy("query_id", "entity_id", "source").agg(F.count("*").alias("places"))


@query(f"with recursive {_P1} select query_id, entity_id, source, span_start, span_end from hit")
def match_positions(spark, sf_dir):
    return D.match_words(V.queries(spark, sf_dir), V.words(spark, sf_dir)).select("query_id", "entity_id", "source", "span_start", "span_end")


@query(f"with recursive {_P1} select query_id, entity_id, match_mode, span_start, span_end, text from ok")
def confirm_matches(spark, sf_dir):
    return D.match_words(V.queries(spark, sf_dir), V.words(spark, sf_dir), then=D.confirm).select("query_id", "entity_id", "match_mode", "span_start", "span_end", "text")


@query(f"with recursive {_P1} select query_id, cast(mention_idx as integer) as mention_idx, span_start, span_end, text, entity_id, match_mode from sel")
def select_spans(spark, sf_dir):
    return L.contains_mentions(V.queries(spark, sf_dir), V.words(spark, sf_dir)).select("query_id", "mention_idx", "span_start", "span_end", "text", "entity_id", "match_mode")


@query(f"""with recursive {_P1}, agg as (select query_id, count(*) as n_mentions, string_agg(entity_id, ',' order by mention_idx) as linked_ids, count(distinct entity_id) as n_entities from sel group by 1)
select q.query_id, case when a.query_id is null then 'no_match' else 'linked' end as status, cast(null as varchar) as error_code, coalesce(linked_ids, '') as linked_ids,
    coalesce(n_mentions, 0) as n_mentions, coalesce(n_entities, 0) as n_entities from fx_queries q left join agg a using (query_id)""")
def link_contains(spark, sf_dir):
    return L.link_contains(V.queries(spark, sf_dir), V.words(spark, sf_dir), V.entities(spark, sf_dir))


@query(f"with recursive {_P2} select query_id, k as name_key, span_start, span_end, text from lit")
def detect_literal(spark, sf_dir):
    words = V.view(spark, sf_dir, "fx_words").select(F.lower("entity_word").alias("name")).distinct()
    return D.detect_literal(V.queries(spark, sf_dir), words).select("query_id", F.col("name").alias("name_key"), "span_start", "span_end", "text")


@query(f"with recursive {_P2} select query_id, span_start, span_end, text from unk")
def unknown_tokens(spark, sf_dir):
    return L.unknown_mentions(V.queries(spark, sf_dir), V.words(spark, sf_dir)).select("query_id", "span_start", "span_end", "text")


@query(f"with recursive {_P2} select query_id, cast(mention_idx as integer) as mention_idx, span_start, span_end, text, known from men")
def all_mentions(spark, sf_dir):
    return L.all_mentions(V.queries(spark, sf_dir), V.words(spark, sf_dir)).select("query_id", "mention_idx", "span_start", "span_end", "text", "known")


@query(f"with recursive {_P2} select query_id, cast(mention_idx as integer) as mention_idx, normalized_key, word_status, entity_id as word_entity_id from res")
def word_lookup(spark, sf_dir):
    w = V.words(spark, sf_dir)
    return C.lookup_word(L.all_mentions(V.queries(spark, sf_dir), w), w).select("query_id", "mention_idx", "normalized_key", "word_status", "word_entity_id")


# every seventh supplier's details are left out, so that some words lead nowhere

def _with_gap(spark, sf_dir):
    return V.entities(spark, sf_dir).where("not (entity_type = 'supplier' and try_cast(substr(entity_id, 3) as bigint) % 7 = 3)")


@query(f"""with recursive {_P2} select query_id, cast(mention_idx as integer) as mention_idx, word_status,
    case when word_status = 'hit' then case when entity_type = 'supplier' and try_cast(substr(entity_id, 3) as bigint) % 7 = 3 then 'entity_miss' else 'hit' end end as entity_status,
    case when word_status <> 'hit' then 'no_match' when entity_type = 'supplier' and try_cast(substr(entity_id, 3) as bigint) % 7 = 3 then 'dependency_failed' else 'linked' end as status from res""")
def two_step_lookup(spark, sf_dir):
    w = V.words(spark, sf_dir)
    found = L.two_step_lookup(L.all_mentions(V.queries(spark, sf_dir), w), w, _with_gap(spark, sf_dir))
    return found.select("query_id", "mention_idx", "word_status", "entity_status", "status")


_RES2 = "select *, case when status = 'linked' and entity_type = 'supplier' and try_cast(substr(entity_id, 3) as bigint) % 7 = 3 then 'dependency_failed' else status end as s2 from res"
_AGG2 = f"""r2 as ({_RES2}), ag as (select query_id, count(*) as n_mentions, count(*) filter (where s2 = 'linked') as n_linked, count(*) filter (where s2 = 'no_match') as n_missed,
    count(*) filter (where s2 = 'dependency_failed') as n_failed, string_agg(entity_id, ',' order by mention_idx) filter (where s2 = 'linked') as linked_ids,
    max(entity_id) filter (where s2 = 'linked') as one from r2 group by 1)"""


@query(f"""with recursive {_P2}, {_AGG2} select q.query_id,
    case when ag.query_id is null then case when template = 2 then 'not_required' else 'no_match' end
         when n_failed > 0 and n_linked > 0 then 'partial' when n_failed > 0 then 'dependency_failed' when n_linked = n_mentions then 'linked' when n_linked > 0 then 'partial' else 'no_match' end as status,
    coalesce(linked_ids, '') as linked_ids, case when n_linked = 1 then one end as linked_entity_id,
    coalesce(n_mentions, 0) as n_mentions, coalesce(n_linked, 0) as n_linked, coalesce(n_missed, 0) as n_missed, coalesce(n_failed, 0) as n_failed
from fx_queries q left join ag using (query_id)""")
def link_words(spark, sf_dir):
    return L.link_words(V.queries(spark, sf_dir), V.words(spark, sf_dir), _with_gap(spark, sf_dir))


@query(f"with recursive {_P2}, {_AGG2} select query_id, n_mentions, n_linked, n_missed, n_failed from ag")
def stage_counts(spark, sf_dir):
    return L.word_rollup(V.queries(spark, sf_dir), V.words(spark, sf_dir), _with_gap(spark, sf_dir)).select("query_id", "n_mentions", "n_linked", "n_missed", "n_failed")


@query(f"""with recursive {_P2}, {_AGG2} select query_id, case when n_failed > 0 and n_linked > 0 then 'partial' when n_failed > 0 then 'dependency_failed' when n_linked = n_mentions then 'linked'
    when n_linked > 0 then 'partial' else 'no_match' end as status from ag""")
def status_words(spark, sf_dir):
    r = L.word_rollup(V.queries(spark, sf_dir), V.words(spark, sf_dir), _with_gap(spark, sf_dir))
    return r.select("query_id", L.status_words(F.col("n_mentions"), F.col("n_linked"), F.col("n_failed"), F.col("n_ambiguous")).alias("status"))


@query(f"""with recursive {_P2}, {_AGG2} select query_id, case when n_failed > 0 then 'dependency_failed' when n_linked > 0 and n_missed > 0 then 'partial' when n_linked = n_mentions then 'linked'
    when n_linked > 0 then 'partial' else 'no_match' end as status from ag""")
def status_catalog(spark, sf_dir):
    """Degraded here: some mention missed."""
    r = L.word_rollup(V.queries(spark, sf_dir), V.words(spark, sf_dir), _with_gap(spark, sf_dir))
    return r.select("query_id", L.status_catalog(F.col("n_mentions"), F.col("n_linked"), F.col("n_failed"), F.col("n_ambiguous"), F.col("n_missed") > 0).alias("status"))


@query(f"""with recursive {_P2}, r2 as ({_RES2}) select query_id, string_agg('entity word and entity found', '; ') filter (where s2 = 'linked') as summary_reason,
    max('dependency_failed') filter (where s2 = 'dependency_failed') as first_error_code, case when count(*) filter (where s2 = 'linked') = 1 then max(entity_id) filter (where s2 = 'linked') end as linked_entity_id
from r2 group by query_id""".replace("as summary_reason", "as sr").replace("select query_id, string_agg", "select query_id, coalesce(sr, '') as summary_reason, first_error_code, linked_entity_id from (select query_id, string_agg") + ")")
def query_rollup(spark, sf_dir):
    r = L.word_rollup(V.queries(spark, sf_dir), V.words(spark, sf_dir), _with_gap(spark, sf_dir))
    return r.select("query_id", "summary_reason", "first_error_code", "linked_entity_id")


@query(f"""with {V.oracle_ctes('fx_entities', 'fx_lines')}, asked as (select distinct concat('S:', skey) as id from fx_lines union select distinct concat('N:', skey) from fx_lines)
select id as entity_id, e.entity_name, e.entity_id is null as missing from asked left join fx_entities e on e.entity_id = id""")
def batch_get(spark, sf_dir):
    lines = V.view(spark, sf_dir, "fx_lines")
    ids = lines.select(F.concat(F.lit("S:"), "skey").alias("entity_id")).unionByName(lines.select(F.concat(F.lit("N:"), "skey").alias("entity_id"))).distinct()
    known = V.entities(spark, sf_dir).select("entity_id", "entity_name", F.lit(False).alias("gone"))
    return ids.join(D.small_or_shuffled(known), "entity_id", "left").select("entity_id", "entity_name", F.coalesce("gone", F.lit(True)).alias("missing"))


@query(f"with {V.oracle_ctes('fx_entities')} select a.entity_id, a.target as neighbor_id, a.relation_type from fx_entities a join fx_entities b on a.target = b.entity_id")
def neighbors(spark, sf_dir):
    return C.neighbors(V.entities(spark, sf_dir))


@query(f"""with {V.oracle_ctes('fx_entities')}, p as (select entity_id as a, concat('N:', try_cast(substr(entity_id, 3) as bigint) % 25) as b from fx_entities where entity_type in ('supplier', 'customer')
    union all select concat('R:', try_cast(substr(entity_id, 3) as bigint) % 5), entity_id from fx_entities where entity_type = 'nation')
select a, b, exists (select 1 from fx_entities e where (e.entity_id = a and e.target = b) or (e.entity_id = b and e.target = a)) as linked from p""")
def relation_pairs(spark, sf_dir):
    e = V.entities(spark, sf_dir)
    n = F.expr("try_cast(substr(entity_id, 3) as bigint)")
    one = e.where("entity_type in ('supplier', 'customer')").select(F.col("entity_id").alias("a"), F.concat(F.lit("N:"), n % 25).alias("b"))
    two = e.where("entity_type = 'nation'").select(F.concat(F.lit("R:"), n % 5).alias("a"), F.col("entity_id").alias("b"))
    return C.relation_linked(one.unionByName(two), e)


# texts that people might look up: every nation's and supplier's name or part of it, part names, nonsense
_LOOK = """select concat('n', n_nationkey) as query_id, n_name as text from nation union all select concat('s', s_suppkey), concat('see ', lower(s_name), ' now') from supplier
    union all select distinct concat('p', p_name), p_name from part union all select concat('d', n_nationkey), concat('nation_', n_nationkey, ' x') from nation"""


@query(f"""with {V.oracle_ctes('fx_entities')}, look as ({_LOOK}), t as (select query_id, lower(replace(text, ' ', '')) as m from look),
names as (select entity_id, lower(replace(entity_name, ' ', '')) as n from fx_entities union all select entity_id, lower(replace(alias1, ' ', '')) from fx_entities where alias1 is not null),
b as (select query_id, entity_id, min(case when m = n then 0 else 1 end) as tier from t join names on contains(m, n) or contains(n, m) group by all)
select query_id, entity_id, cast(tier as integer) as tier, cast(row_number() over (partition by query_id order by tier, entity_id) as integer) as rank from b qualify rank <= 20""")
def search(spark, sf_dir):
    look = spark.sql(V.re.sub(r"from (nation|supplier|part)\b", r"from {\1}", _LOOK), **{t: V.table(spark, sf_dir, t) for t in ("nation", "supplier", "part")})
    return C.search(look, V.names(spark, sf_dir))


_ALARM = """asked as (select o_orderkey as query_id, 0 as mention_idx, case o_orderkey % 3 when 0 then concat('SUP-', o_custkey % 120) when 1 then concat('supplier #', lpad(cast(o_custkey % 90 as {string}), 9, '0')) else concat('sup', o_custkey) end as text from {orders})"""


@query(f"""with {V.oracle_ctes('fx_entities')}, {_ALARM.format(string='varchar', orders='orders')},
n as (select entity_id, entity_name as name, 1.0 as score, 'canonical alarm name match' as reason from fx_entities where entity_type = 'supplier' union all select entity_id, alias1, 0.96, 'alarm alias match' from fx_entities where entity_type = 'supplier'),
b as (select query_id, cast(mention_idx as integer) as mention_idx, entity_id, cast(max(score) as double) as confidence, max_by(reason, score) as match_reason, max_by(lower(replace(name, ' ', '')), score) as dedup_key
    from asked join n on lower(replace(text, ' ', '')) = lower(replace(name, ' ', '')) group by all)
select *, cast(row_number() over (partition by query_id, mention_idx order by confidence desc, entity_id) as integer) as rank from b""")
def alarm_exact(spark, sf_dir):
    m = spark.sql("with " + _ALARM.format(string="string", orders="{orders}") + " select * from asked", orders=V.table(spark, sf_dir, "orders"))
    return C.alarm_candidates(m, V.names(spark, sf_dir).where("entity_type = 'supplier'"), phrases=False)


@query()
def alarm_phrase(spark, sf_dir):
    """Misspelt supplier names against all supplier names, as alarms are of one type; a similarity that SQL lacks, so
    tests compare all rows with the definition."""
    m = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.lit(0).alias("mention_idx"), F.regexp_replace("s_name", "pp", "p").alias("text"))
    return C.alarm_candidates(m, V.names(spark, sf_dir).where("entity_type = 'supplier'"))


# mentions for scoring: typed and untyped, exact names, aliases and parts of names
_MEN = """men as (select o_orderkey as query_id, cast(o_orderkey % 2 as int) as mention_idx,
    case o_orderkey % 4 when 0 then concat('Supplier#', lpad(cast(o_custkey % 150 as {string}), 9, '0')) when 1 then concat('NATION_', o_custkey % 25) when 2 then concat('sup-', o_custkey % 300) else 'asia' end as text,
    case when o_orderkey % 8 < 4 then null when o_orderkey % 4 = 1 then 'nation' when o_orderkey % 4 = 3 then 'region' else 'supplier' end as predicted_type from {orders})"""
_SCORED = f"""{V.oracle_ctes('fx_entities')}, {_MEN.format(string='varchar', orders='orders')},
nm as (select entity_id, entity_type, lower(replace(entity_name, ' ', '')) as n, true as c from fx_entities union all select entity_id, entity_type, lower(replace(alias1, ' ', '')), false from fx_entities where alias1 is not null),
dm as (select distinct text, predicted_type, lower(replace(text, ' ', '')) as m from men),
sc as (select text, predicted_type, entity_id, case when m = n then case when c then 0.99 else 0.92 end else 0.78 end + case when predicted_type is not null then 0.05 else 0 end as score,
    case when m = n then case when c then 'canonical name match' else 'alias match' end else 'partial name match' end as reason, c
    from dm join nm on (predicted_type is null or predicted_type = entity_type) and (contains(m, n) or contains(n, m))),
bs as (select * from (select text, predicted_type, entity_id, round(least(1.0, cast(max(score) as double)), 4) as confidence, arg_max(reason, row(score, c)) as match_reason from sc group by all)
    qualify row_number() over (partition by text, predicted_type order by confidence desc, entity_id) <= 5),
rk as (select query_id, mention_idx, men.predicted_type, entity_id, confidence, match_reason, row_number() over (partition by query_id, mention_idx order by confidence desc, entity_id) as rank
    from men join bs on men.text = bs.text and men.predicted_type is not distinct from bs.predicted_type)"""


def _mentions(spark, sf_dir):
    return spark.sql("with " + _MEN.format(string="string", orders="{orders}") + " select * from men", orders=V.table(spark, sf_dir, "orders"))


def _ranked(spark, sf_dir):
    return C.rank_candidates(C.score_candidates(_mentions(spark, sf_dir), V.names(spark, sf_dir)))


@query(f"with {_SCORED} select query_id, mention_idx, entity_id, confidence, match_reason from rk")
def score_exact_partial(spark, sf_dir):
    scored = C.score_candidates(_mentions(spark, sf_dir), V.names(spark, sf_dir))
    return scored.select("query_id", "mention_idx", "entity_id", "confidence", "match_reason")


@query()
def score_fuzzy(spark, sf_dir):
    """Names with a letter lost, of regions, nations and every entity whose number is divisible by 20, against all
    names; tests compare all rows with the definition."""
    named = V.names(spark, sf_dir)
    m = named.where("entity_type in ('nation', 'region') or try_cast(substr(entity_id, 3) as bigint) % 20 = 0").select(F.xxhash64("entity_id", "name").alias("query_id"), F.lit(0).alias("mention_idx"), F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")).alias("text"), F.lit(None).cast("string").alias("predicted_type"))
    return C.rank_candidates(C.score_candidates(m, named, fuzzy=True))


@query(f"with {_SCORED} select query_id, mention_idx, entity_id, cast(rank as integer) as rank, confidence from rk")
def rank_candidates(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "mention_idx", "entity_id", "rank", "confidence")


_DECIDED = """dc as (select query_id, mention_idx, entity_id, confidence, rank, lead(confidence) over (partition by query_id, mention_idx order by rank) as second from rk qualify rank = 1),
dd as (select query_id, mention_idx, case when confidence < 0.7 then 'no_match' when round((confidence - second) * 10000) / 10000 < 0.08 then 'ambiguous' else 'linked' end as status, entity_id as top, confidence from dc)"""
_DECIDED = _DECIDED.replace("from rk qualify rank = 1", "from rk").replace("from dc)", "from dc where rank = 1)")


@query(f"with {_SCORED}, {_DECIDED} select query_id, mention_idx, status, case when status = 'linked' then top end as entity_id, confidence from dd")
def ambiguity(spark, sf_dir):
    return C.decide(_ranked(spark, sf_dir)).drop("reason")


@query(f"""with {_SCORED}, f as (select query_id, entity_id, arg_min(confidence, mention_idx) as confidence from rk group by all)
select *, cast(row_number() over (partition by query_id order by confidence desc, entity_id) as integer) as rank from f qualify rank <= 5""")
def query_candidates(spark, sf_dir):
    return C.query_candidates(_ranked(spark, sf_dir))


@query(f"""with {_SCORED}, {_DECIDED}, sel as (select query_id, mention_idx, concat('S:', query_id % 300) as sel, (query_id % 10) / 10.0 as conf from men),
o as (select dd.*, sel.sel, sel.conf, exists (select 1 from rk where rk.query_id = dd.query_id and rk.mention_idx = dd.mention_idx and rk.entity_id = sel.sel) and exists (select 1 from fx_entities e where e.entity_id = sel.sel) and sel.conf >= 0.7 as ok
    from dd left join sel using (query_id, mention_idx))
select query_id, mention_idx, case when status = 'ambiguous' and ok then 'linked' else status end as status, status = 'ambiguous' and not ok as degraded,
    case when status = 'linked' then top when status = 'ambiguous' and ok then sel end as entity_id from o""")
def apply_selection(spark, sf_dir):
    m, ranked = _mentions(spark, sf_dir), _ranked(spark, sf_dir)
    results = L.mention_results(m, ranked).join(ranked.select("query_id", "mention_idx").distinct().hint("merge"), ["query_id", "mention_idx"], "left_semi")
    sel = m.select("query_id", "mention_idx", F.concat(F.lit("S:"), F.col("query_id") % 300).alias("selected_entity_id"), ((F.col("query_id") % 10) / 10.0).alias("confidence"), F.lit("chosen").alias("reason"))
    return C.apply_selection(results, ranked, sel, V.entities(spark, sf_dir)).select("query_id", "mention_idx", "status", "degraded", "entity_id")


# catalogue linking: typed names and untyped shaped tokens, chosen greedily, scored, decided and rolled up
_CATALOG = f"""{V.oracle_ctes('fx_entities', 'fx_queries')},
nm as materialized (select entity_id, entity_type, lower(replace(entity_name, ' ', '')) as n, lower(entity_name) as low, true as c from fx_entities
    union all select entity_id, entity_type, lower(replace(alias1, ' ', '')), lower(alias1), false from fx_entities where alias1 is not null),
ln as materialized (select distinct low as k, entity_type from nm),
cg as (select query_id, p, substr(low, p, 4) as gram, low from (select query_id, lower(query) as low, unnest(range(1, length(query) - 2)) as p from fx_queries)),
cl0 as (select cg.query_id, ln.entity_type, cast(cg.p - 1 as integer) as span_start, cast(cg.p - 1 + length(ln.k) as integer) as span_end from cg join ln on substr(ln.k, 1, 4) = cg.gram and substr(cg.low, cg.p, length(ln.k)) = ln.k),
cl as materialized (select l.query_id, entity_type, span_start, span_end, substr(q.query, span_start + 1, span_end - span_start) as text from cl0 l join fx_queries q on q.query_id = l.query_id where {_BOUND.format(q='q.query')}
    union all select query_id, null, cast(span_start as integer), cast(span_start + length(text) as integer), text from (
        select query_id, 17 as span_start, concat('SUP-', skey + 1000000, '.') as text from fx_queries where template = 1
        union all select query_id, 5 + length(p_name) + 5, concat('Unknown-', okey, '.') from fx_queries where template = 3
        union all select query_id, 8 + length(p_name) + 4, concat(n_name, '.') from fx_queries where template = 4)),
{greedy('cl', 'cm', 'text, entity_type is null, entity_type')},
dm as (select distinct text, entity_type as predicted_type, lower(replace(text, ' ', '')) as m from cm),
sc as (select text, predicted_type, entity_id, case when m = n then case when c then 0.99 else 0.92 end else 0.78 end + case when predicted_type is not null then 0.05 else 0 end as score,
    case when m = n then case when c then 'canonical name match' else 'alias match' end else 'partial name match' end as reason, c
    from dm join nm on (predicted_type is null or predicted_type = entity_type) and (contains(m, n) or contains(n, m))),
bs as materialized (select * from (select text, predicted_type, entity_id, round(least(1.0, cast(max(score) as double)), 4) as confidence, arg_max(reason, row(score, c)) as match_reason from sc group by all)
    qualify row_number() over (partition by text, predicted_type order by confidence desc, entity_id) <= 5),
rk as materialized (select query_id, mention_idx, cm.entity_type as predicted_type, entity_id, confidence, match_reason, row_number() over (partition by query_id, mention_idx order by confidence desc, entity_id) as rank
    from cm join bs on cm.text = bs.text and cm.entity_type is not distinct from bs.predicted_type),
dc as (select query_id, mention_idx, entity_id, confidence, match_reason, rank, lead(confidence) over (partition by query_id, mention_idx order by rank) as second from rk),
dd as materialized (select query_id, mention_idx, entity_id, match_reason, case when confidence < 0.7 then 'no_match' when round((confidence - second) * 10000) / 10000 < 0.08 then 'ambiguous' else 'linked' end as status from dc where rank = 1),
mr as materialized (select cm.query_id, cm.mention_idx, cm.entity_type as predicted_type, coalesce(status, 'no_match') as status, case when status = 'linked' then entity_id end as entity_id,
    case status when 'linked' then match_reason when 'ambiguous' then 'top candidates are within ambiguity margin' end as reason from cm left join dd on dd.query_id = cm.query_id and dd.mention_idx = cm.mention_idx),
ag as (select query_id, count(*) as n, count(*) filter (where status = 'linked') as l, count(*) filter (where status = 'ambiguous') as a, string_agg(entity_id, ',' order by mention_idx) as linked_ids, max(entity_id) as one,
    string_agg(reason, '; ' order by mention_idx) as summary_reason from mr group by 1),
sh as (select rk.* from rk join mr on mr.query_id = rk.query_id and mr.mention_idx = rk.mention_idx where mr.status <> 'no_match' or mr.predicted_type is not null),
tp as (select query_id, string_agg(entity_id, ',' order by r) as top_ids from (select *, row_number() over (partition by query_id order by confidence desc, entity_id) as r from (
    select query_id, entity_id, arg_min(confidence, mention_idx) as confidence from sh group by 1, 2)) where r <= 5 group by 1)"""


_CATALOG_ROWS = """select q.query_id, case when ag.query_id is null then case when template = 2 then 'not_required' else 'no_match' end when l = n then 'linked' when l > 0 then 'partial' when a > 0 then 'ambiguous' else 'no_match' end as status,
    coalesce(linked_ids, '') as linked_ids, case when l = 1 then one end as linked_entity_id, coalesce(summary_reason, '') as summary_reason, 'L0_SYNTHETIC' as data_layer, coalesce(top_ids, '') as top_ids,
    coalesce(n, 0) as n_mentions, coalesce(l, 0) as n_linked, coalesce(a, 0) as n_ambiguous, cast(null as varchar) as error_code
from fx_queries q left join ag on ag.query_id = q.query_id left join tp on tp.query_id = q.query_id"""


@query(f"with recursive {_CATALOG} {_CATALOG_ROWS}")
def link_catalog(spark, sf_dir):
    """All queries through the catalogue pipeline."""
    e = V.entities(spark, sf_dir)
    return L.link_catalog(V.queries(spark, sf_dir), e, V.entity_names(e), fuzzy=False)


@query("with recursive " + _CATALOG.replace("entity_type from nm)", "entity_type from nm where entity_type in ('supplier', 'region'))") + _CATALOG_ROWS)
def link_catalog_hints(spark, sf_dir):
    """The catalogue pipeline told to look for suppliers and regions: other names aren't found, other tokens still are."""
    e = V.entities(spark, sf_dir)
    return L.link_catalog(V.queries(spark, sf_dir), e, V.entity_names(e), fuzzy=False, type_hints=["supplier", "region"])


@query()
def link_catalog_fuzzy(spark, sf_dir):
    """All queries through the catalogue pipeline with similar names, which SQL lacks. Tests compare all rows with the definition."""
    e = V.entities(spark, sf_dir)
    return L.link_catalog(V.queries(spark, sf_dir), e, V.entity_names(e))


# an outside model's mentions: a sound one, a type that doesn't exist, or none at all
_SAID = "case when query_id % 5 < 3 then case when query_id % 5 = 0 then 'bad_type' else 'supplier' end end"


def proposed(queries):
    k = F.col("query_id") % 5
    m = F.array(F.struct(F.concat(F.lit("sup-"), F.col("query_id") % 120).alias("text"), F.when(k == 0, "bad_type").otherwise("supplier").alias("predicted_type")))
    p = queries.where(k < 3).select("query_id", m.alias("mentions"))
    return p.unionByName(queries.where(k == 3).select("query_id", F.lit(None).cast(p.schema["mentions"].dataType).alias("mentions")))


@query(f"""with recursive {_CATALOG}, e as (select entity_id, alias1 from fx_entities where entity_type = 'supplier'), pr as (select q.query_id, q.template, query_id % 5 in (1, 2) as used, lower(concat('sup-', query_id % 120)) as m from fx_queries q),
ex as (select pr.query_id, e.entity_id from pr join e on used and lower(e.alias1) = pr.m),
nr as (select pr.query_id, count(*) as c from pr join (select distinct query_id % 120 as k from fx_queries) d on d.k = pr.query_id % 120 join e on used and lower(e.alias1) <> pr.m and (contains(pr.m, lower(e.alias1)) or contains(lower(e.alias1), pr.m)) group by 1)
select pr.query_id, case when used then case when ex.entity_id is not null then 'linked' when c = 1 then 'linked' when c > 1 then 'ambiguous' else 'no_match' end
        when ag.query_id is null then case when template = 2 then 'not_required' else 'no_match' end when l > 0 then 'partial' when a > 0 then 'ambiguous' else 'no_match' end as status,
    case when not used then case when query_id % 5 = 0 then 'llm_schema_error' else 'llm_missing' end end as error_code,
    case when used then 1 else coalesce(n, 0) end as n_mentions
from pr left join ag using (query_id) left join ex using (query_id) left join nr using (query_id)""")
def link_proposals(spark, sf_dir):
    """The catalogue pipeline with proposed mentions: sound ones are linked, else detected ones are and the query is degraded."""
    e, q = V.entities(spark, sf_dir), V.queries(spark, sf_dir)
    return L.link_catalog(q, e, V.entity_names(e), fuzzy=False, proposals=proposed(q)).select("query_id", "status", "error_code", "n_mentions")


# alarms: suppliers under the type alarm, named by identifiers
_ALARMS = """al as (select s_suppkey as k, concat('A:', s_suppkey) as entity_id, concat('ALM-', 51000 + s_suppkey) as entity_name, concat('link ', s_suppkey, ' is down') as phrase from supplier),
aq as (select o_orderkey as query_id, case o_orderkey % 5 when 0 then concat('Check ALM-', 51000 + o_custkey % 120, ' impact, then ALM-51001.') when 1 then concat('What is alarm ', 51000 + o_custkey % 120, '?')
    when 2 then concat('Why: Link ', o_custkey % 120, ' is down now') when 3 then 'Open the operations dashboard.' else 'Any alarm today?' end as query, o_orderkey % 5 as t, o_custkey % 120 as c from orders)"""


@query(f"""with {_ALARMS} select query_id, case when t in (0, 2) and k is not null then 'linked' when t = 3 or (t = 2 and k is null) then 'not_required' else 'no_match' end as status,
    case when t in (0, 2) and k is not null then entity_id else '' end as linked_ids, cast(case when t in (0, 1) or (t = 2 and k is not null) then 1 else 0 end as bigint) as n_mentions from aq left join al on k = c""")
def link_alarms(spark, sf_dir):
    """A catalogue of alarms only: ids, numbers after a keyword and phrases; the first mention of a query counts."""
    t = {n: V.table(spark, sf_dir, n) for n in ("supplier", "orders")}
    made = V.re.sub(r"from (supplier|orders)\b", r"from {\1}", _ALARMS)
    al = spark.sql(f"with {made} select * from al", **t)
    e = al.select("entity_id", F.lit("alarm").alias("entity_type"), "entity_name", F.array("phrase").alias("alias"), F.lit("L0_SYNTHETIC").alias("data_layer"))
    q = spark.sql(f"with {made} select query_id, query from aq", **t)
    return L.link_catalog(q, e, V.entity_names(e), alarm_only=True).select("query_id", "status", "linked_ids", "n_mentions")


@query(f"with {V.oracle_ctes('fx_entities')} select entity_type, count(*) as n from fx_entities group by 1")
def type_counts(spark, sf_dir):
    return V.entities(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(f"""with {V.oracle_ctes('fx_entities')} select entity_id, entity_type, name, cast(name_idx as integer) as name_idx, name_idx = 0 as is_canonical from (
    select entity_id, entity_type, entity_name as name, 0 as name_idx from fx_entities union all select entity_id, entity_type, alias1, 1 from fx_entities where alias1 is not null)""")
def entity_names(spark, sf_dir):
    return V.names(spark, sf_dir)


@query(f"with {V.oracle_ctes('fx_entities')} select entity_id, entity_type, entity_name from fx_entities where entity_type = 'customer' order by entity_id limit 200")
def browse(spark, sf_dir):
    """One type's first entities by id; the limit is clamped to 200."""
    from .browsing import browse as first

    return first(V.entities(spark, sf_dir), "customer", 1000)


@query("""with e as (select conv_id, turn, role, text, row_number() over (partition by conv_id, role order by turn) as n from conversations) select conv_id, role, turn, text from e where n = 1""")
def first_wins(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", "role").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f")).select("conv_id", "role", "f.*")


@query("""with e as (select o_custkey, concat('S:', o_orderkey % 7) as entity_id, o_orderkey as place, round(cast(o_orderkey % 5 as double) / 5, 4) as score from orders)
select o_custkey as query_id, entity_id, arg_max(place, row(score, -place)) as place, max(score) as score from e group by all""")
def best_per_entity(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("S:"), F.col("o_orderkey") % 7).alias("entity_id"), F.col("o_orderkey").alias("place"), F.round((F.col("o_orderkey") % 5).cast("double") / 5, 4).alias("score"))
    entries = o.withColumns({"reason": F.lit("r"), "name": F.col("place")})
    return C.best_per_entity(entries, ["query_id"]).select("query_id", "entity_id", F.col("name").alias("place"), "score")


@query(f"with recursive {_P2} select query_id, min(text) as text, cast(min(span_start) as integer) as span_start from (select *, row_number() over (partition by query_id order by span_start, span_start - span_end, lower(text)) as n from lit) where n = 1 group by 1")
def first_mention(spark, sf_dir):
    """Alarm mode keeps a query's first mention only."""
    words = V.view(spark, sf_dir, "fx_words").select(F.col("entity_word").alias("name")).distinct()
    hits = D.detect_literal(V.queries(spark, sf_dir), words)
    first = hits.groupBy("query_id").agg(F.min_by(F.struct("text", "span_start"), F.struct("span_start", F.col("span_start") - F.col("span_end"), F.lower("text"))).alias("m"))
    return first.select("query_id", "m.*")


@query("""with r as (select o_custkey as query_id, case o_orderkey % 5 when 0 then 'L0_SYNTHETIC' when 1 then 'L1_SANITIZED' when 2 then 'L2_SIMULATED_INTERFACE' when 3 then 'L3_REAL_READONLY' else 'other' end as l from orders)
select query_id, case max(case l when 'L1_SANITIZED' then 1 when 'L2_SIMULATED_INTERFACE' then 2 when 'L3_REAL_READONLY' then 3 else 0 end) when 0 then 'L0_SYNTHETIC' when 1 then 'L1_SANITIZED' when 2 then 'L2_SIMULATED_INTERFACE' else 'L3_REAL_READONLY' end as data_layer from r group by 1""")
def highest_layer(spark, sf_dir):
    layer = F.get(F.array(*map(F.lit, ["L0_SYNTHETIC", "L1_SANITIZED", "L2_SIMULATED_INTERFACE", "L3_REAL_READONLY", "other"])), (F.col("o_orderkey") % 5).cast("int"))
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), layer.alias("data_layer"))
    return C.highest_layer(rows, "query_id")


@query("select concat(conv_id, '-', turn) as query_id, length(trim(text)) > 0 as valid, case when length(trim(text)) > 0 then null else 'invalid_input' end as gate_error from (select conv_id, turn, case when turn % 4 = 3 then '  ' else text end as text from conversations)")
def request_gate(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.col("text")).alias("query"))
    return L.request_gate(c).drop("query")
