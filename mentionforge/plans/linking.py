"""The composite linking pipelines: containment, word table and catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dictionary as D
from ..operators import candidates as C
from ..operators.anchors import AnchorIndex
from ..schemas import LAYERS, MAX_CANDIDATES
from ..sources.store import write_out
from .proposals import merge_proposals

MENTION = ["query_id", "mention_idx", "span_start", "span_end", "text"]


def request_gate(queries: DataFrame) -> DataFrame:
    """valid and gate_error for each query: blank text stays in the output as invalid input."""
    blank = F.col("query").isNull() | (X.normalize_text(F.col("query")) == "")
    return queries.withColumns({"valid": ~blank, "gate_error": F.when(blank, "invalid_input")})


def contains_mentions(queries: DataFrame, words: DataFrame, strict_context: bool = False, index: AnchorIndex | None = None) -> DataFrame:
    """Confirmed, non-overlapping matches of normalised keys: query_id, mention_idx, span, text, entity_id, entity_type, source, match_mode."""
    if "entity_types" in queries.columns:
        return _selected(D.match_words(queries, words, index, lambda found: D.confirm(found, strict_context)))
    return D.once_per_text(queries.select("query_id", "query"), lambda texts: _contained_in_texts(texts, words, strict_context, index)).drop("query")


def _contained_in_texts(texts: DataFrame, words: DataFrame, strict_context: bool, index: AnchorIndex | None) -> DataFrame:
    return _selected(D.confirm(D.matches_of_texts(texts, words, index), strict_context))


def _selected(found: DataFrame) -> DataFrame:
    order = [-F.coalesce("priority", F.lit(0)), F.col("entity_id")]
    return D.select_spans(found, "query_id", order, ["text", "entity_id", "entity_type", "source", "match_mode"])


def link_contains(queries: DataFrame, words: DataFrame, entities: DataFrame, words_version: str = "v1", entities_version: str = "v1", strict_context: bool = False, index: AnchorIndex | None = None) -> DataFrame:
    """One row a query: status (linked, no_match, invalid_input, dependency_failed), error_code, linked_ids in span
    order, n_mentions, n_words (confirmed matches chosen) and n_entities. A chosen id without details, or tables
    of different versions, fail the query; they never make it no_match."""
    if "entity_types" in queries.columns:
        return _link_contains(queries, words, entities, words_version != entities_version, strict_context, index)
    # nothing but the text decides
    alone = lambda texts: _link_contains(texts, words, entities, words_version != entities_version, strict_context, index)
    return D.once_per_text(queries.select("query_id", "query"), alone).drop("query")


def _link_contains(queries: DataFrame, words: DataFrame, entities: DataFrame, apart: bool, strict_context: bool, index: AnchorIndex | None) -> DataFrame:
    """``link_contains``; without entity_types of different texts. ``apart``: the tables are of different versions."""
    gated = request_gate(queries)
    valid = gated.where("valid")
    if "entity_types" in queries.columns:
        chosen = contains_mentions(valid.select("query_id", "query", "entity_types"), words, strict_context, index)
    else:
        chosen = _contained_in_texts(valid.select("query_id", "query"), words, strict_context, index)
    known = entities.select(F.col("entity_id").alias("_known")).distinct()
    checked = chosen.join(D.small_or_shuffled(known), F.col("entity_id") == F.col("_known"), "left")
    per_query = checked.groupBy("query_id").agg(
        F.count("*").alias("n_mentions"), F.count_if(F.col("_known").isNull()).alias("missing"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("mention_idx", "entity_id"))), lambda m: m["entity_id"])).alias("linked_ids"),
        F.count_distinct("entity_id").alias("n_entities"),
    )
    out = gated.select("query_id", "valid").join(per_query.hint("merge"), "query_id", "left")
    failed = (F.col("missing") > 0) | F.lit(apart)
    status = F.when(~F.col("valid"), "invalid_input").when(F.col("n_mentions").isNull(), "no_match").when(failed, "dependency_failed").otherwise("linked")
    out = out.withColumn("status", status)
    linked = F.col("status") == "linked"
    return out.select(
        "query_id", "status", F.when(F.col("status") == "invalid_input", "invalid_input").when(F.col("status") == "dependency_failed", "entity_miss").alias("error_code"),
        F.when(linked, F.col("linked_ids")).otherwise("").alias("linked_ids"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"),
        F.when(linked, F.col("n_entities")).otherwise(0).alias("n_entities"),
    )


def known_mentions(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Literal word hits chosen greedily per query."""
    return D.once_per_text(queries.select("query_id", "query"), lambda texts: _known_of_texts(texts, words)).drop("query")


def _known_of_texts(texts: DataFrame, words: DataFrame) -> DataFrame:
    literal = D.literals_of_texts(texts, words.select(F.col("entity_word").alias("name")).distinct())
    return D.select_spans(literal, "query_id", [F.col("text")], ["text"])


def shaped_tokens(queries: DataFrame, trim: bool = True) -> DataFrame:
    """Entity-shaped tokens with offsets, without punctuation at their ends if ``trim``."""
    spans = X.regex_spans(F.col("query"), X.SHAPED_TOKEN)
    return queries.select("query_id", F.inline(X.trim_terminal(spans) if trim else spans))


def unknown_tokens(queries: DataFrame, known: DataFrame) -> DataFrame:
    """Entity-shaped tokens that overlap no known mention."""
    tokens = shaped_tokens(queries)
    k = known.select(F.col("query_id").alias("_q"), F.col("span_start").alias("_s"), F.col("span_end").alias("_e"))
    return tokens.join(k.hint("merge"), (F.col("query_id") == F.col("_q")) & (F.col("span_start") < F.col("_e")) & (F.col("_s") < F.col("span_end")), "left_anti")


def unknown_mentions(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Entity-shaped tokens that overlap no known mention of ``words``."""
    return D.once_per_text(queries.select("query_id", "query"), lambda texts: unknown_tokens(texts, _known_of_texts(texts, words))).drop("query")


def all_mentions(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Known and unknown mentions in span order."""
    return D.once_per_text(queries.select("query_id", "query"), lambda texts: _mentions_of_texts(texts, words)).drop("query")


def _mentions_of_texts(queries: DataFrame, words: DataFrame) -> DataFrame:
    known = write_out(_known_of_texts(queries, words), "known-mentions")
    # chosen names, and tokens of one pattern that touch none of them, overlap nowhere: numbers are all that is left to give
    both = known.drop("mention_idx").withColumn("known", F.lit(True)).unionByName(unknown_tokens(queries, known).withColumn("known", F.lit(False)))
    placed = both.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "text", "known"))).alias("_all"))
    return placed.select("query_id", F.posexplode("_all").alias("mention_idx", "_m")).select("query_id", "mention_idx", "_m.*")


def two_step_lookup(mentions: DataFrame, words: DataFrame, entities: DataFrame) -> DataFrame:
    """Word, then entity: adds normalized_key, word_status (hit, miss, invalid_key), entity_status (hit, entity_miss), entity_id, entity_type and status."""
    keyed = C.lookup_word(mentions, words)
    known = entities.select(F.col("entity_id").alias("_id"), F.col("entity_type").alias("_type")).dropDuplicates(["_id"])
    both = keyed.join(D.small_or_shuffled(known), F.col("word_entity_id") == F.col("_id"), "left")
    entity_status = F.when(F.col("word_status") == "hit", F.when(F.col("_id").isNotNull(), "hit").otherwise("entity_miss"))
    both = both.withColumn("entity_status", entity_status)
    status = F.when(F.col("word_status") != "hit", "no_match").when(F.col("entity_status") == "hit", "linked").otherwise("dependency_failed")
    return both.withColumns({"entity_id": F.col("_id"), "entity_type": F.col("_type"), "status": status}).drop("_id", "_type", "word_entity_id")


def status_words(n: Column, linked: Column, failed: Column, ambiguous: Column) -> Column:
    """Query status by the word-table rules: a failure beside a link is partial."""
    return (
        F.when((failed > 0) & (linked > 0), "partial").when(failed > 0, "dependency_failed").when(linked == n, "linked")
        .when(linked > 0, "partial").when(ambiguous > 0, "ambiguous").otherwise("no_match")
    )


def status_catalog(n: Column, linked: Column, failed: Column, ambiguous: Column, degraded: Column, alarm_only: bool = False) -> Column:
    """Query status by the catalogue rules: any failure fails, a degraded link is partial unless only alarms are linked."""
    partial = (linked > 0) & degraded & F.lit(not alarm_only)
    return (
        F.when(failed > 0, "dependency_failed").when(partial, "partial").when(linked == n, "linked")
        .when(linked > 0, "partial").when(ambiguous > 0, "ambiguous").otherwise("no_match")
    )


def rollup(results: DataFrame) -> DataFrame:
    """Per query of mention results (query_id, mention_idx, status, entity_id, reason, error_code): counts, joined reason,
    first error code, and the linked entity if there is exactly one."""
    linked = F.col("status") == "linked"
    reasons = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("reason", F.lit("")) != "", F.struct("mention_idx", "reason")))), lambda r: r["reason"])
    return results.groupBy("query_id").agg(
        F.count("*").alias("n_mentions"), F.count_if(linked).alias("n_linked"), F.count_if(F.col("status") == "no_match").alias("n_missed"),
        F.count_if(F.col("status") == "dependency_failed").alias("n_failed"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"),
        F.concat_ws("; ", reasons).alias("summary_reason"), F.min_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("mention_idx"))).alias("first_error_code"),
        F.when(F.count_if(linked) == 1, F.max(F.when(linked, F.col("entity_id")))).alias("linked_entity_id"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(linked, F.struct("mention_idx", "entity_id")))), lambda r: r["entity_id"])).alias("linked_ids"),
    )


def word_mentions(queries: DataFrame, words: DataFrame, entities: DataFrame) -> DataFrame:
    """Mention results of the word-table pipeline."""
    return D.once_per_text(queries.select("query_id", "query"), lambda texts: _results_of_texts(texts, words, entities)).drop("query")


def _results_of_texts(texts: DataFrame, words: DataFrame, entities: DataFrame) -> DataFrame:
    found = two_step_lookup(_mentions_of_texts(texts, words), words, entities)
    return found.withColumns({
        "reason": F.when(F.col("status") == "linked", "entity word and entity found").otherwise(""),
        "error_code": F.when(F.col("status") == "dependency_failed", "dependency_failed"),
    })


def word_rollup(queries: DataFrame, words: DataFrame, entities: DataFrame) -> DataFrame:
    """``rollup`` of the word-table pipeline's mention results."""
    return D.once_per_text(queries.select("query_id", "query"), lambda texts: rollup(_results_of_texts(texts, words, entities))).drop("query")


def link_words(queries: DataFrame, words: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a query by the word-table pipeline: status, linked_ids, linked_entity_id and the counts of mentions."""

    def work(texts: DataFrame) -> DataFrame:
        valid = request_gate(texts).where("valid").select("query_id", "query")
        return query_results(texts, _results_of_texts(valid, words, entities))

    return D.once_per_text(queries.select("query_id", "query"), work).drop("query")


def query_results(queries: DataFrame, mentions: DataFrame) -> DataFrame:
    """The query rows of the word-table pipeline from its mention results."""
    gated = request_gate(queries)
    per_query = rollup(mentions)
    out = gated.join(per_query.hint("merge"), "query_id", "left")
    none = F.when(F.col("query").rlike(X.LINKING_INTENT) & ~F.col("query").rlike(X.NOT_REQUIRED), "no_match").otherwise("not_required")
    status = F.when(~F.col("valid"), "invalid_input").when(F.col("n_mentions").isNull(), none)
    status = status.otherwise(status_words(F.col("n_mentions"), F.col("n_linked"), F.col("n_failed"), F.col("n_ambiguous")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_mentions", "n_linked", "n_missed", "n_failed")]
    return out.select("query_id", status.alias("status"), F.coalesce("linked_ids", F.lit("")).alias("linked_ids"), "linked_entity_id", *counts)


ALARM = "alarm"


def catalog_mentions(queries: DataFrame, names: DataFrame, alarm_only: bool = False) -> DataFrame:
    """Names of catalogue entities, typed, and entity-shaped tokens, untyped, chosen greedily per query. With ``alarm_only``:
    names of alarms, alarm ids and numbers after an alarm keyword; a query's first stays."""
    return D.once_per_text(queries.select("query_id", "query"), lambda texts: _catalog_of_texts(texts, names, alarm_only)).drop("query")


def _catalog_of_texts(queries: DataFrame, names: DataFrame, alarm_only: bool) -> DataFrame:
    if alarm_only:
        literal = D.literals_of_texts(queries, names.where(F.col("entity_type") == ALARM).select("name").distinct()).select("query_id", "span_start", "span_end", "text")
        ids = queries.select("query_id", F.inline(X.regex_spans(F.col("query"), X.ALARM_ID)))
        numbers = queries.select("query_id", F.inline(X.regex_spans(F.col("query"), X.NUMBER_AFTER_ALARM, 2)))
        found = D.select_spans(literal.unionByName(ids).unionByName(numbers), "query_id", [F.lower("text")], ["text"])
        return found.where("mention_idx = 0").withColumn("predicted_type", F.lit(ALARM))
    literal = D.literals_of_texts(queries, names.select("name", "entity_type").distinct())
    shaped = shaped_tokens(queries, trim=False).withColumn("entity_type", F.lit(None).cast("string"))
    both = literal.select("query_id", "span_start", "span_end", "text", "entity_type").unionByName(shaped)
    # among equal spans the type's name decides, untyped last
    return D.select_spans(both, "query_id", [F.col("text"), F.col("entity_type").isNull(), F.col("entity_type")], ["text", "entity_type"]).withColumnRenamed("entity_type", "predicted_type")


def catalog_candidates(mentions: DataFrame, names: DataFrame, fuzzy: bool = False, alarm_only: bool = False) -> DataFrame:
    """Ranked candidates of mentions: those typed alarm (all, with ``alarm_only``) by alarm keys and phrases, the others by name scores."""
    columns = ["query_id", "mention_idx", "predicted_type", "entity_id", "confidence", "match_reason", "rank"]
    by_name = lambda m: C.rank_candidates(C.score_candidates(m, names, fuzzy)).select(*columns)
    alarms = names.where(F.col("entity_type") == ALARM)
    if not alarm_only and alarms.isEmpty():
        return by_name(mentions)  # a mention typed alarm finds nothing either way
    of_alarms = F.lit(alarm_only) | F.coalesce(F.col("predicted_type") == ALARM, F.lit(False))
    found = C.alarm_candidates(mentions.where(of_alarms).select("query_id", "mention_idx", "text"), alarms)
    found = found.join(mentions.select("query_id", "mention_idx", "predicted_type").hint("merge"), ["query_id", "mention_idx"]).select(*columns)
    return found if alarm_only else by_name(mentions.where(~of_alarms)).unionByName(found)


def mention_results(mentions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Status of each mention from its ranked candidates: under the threshold no match, within the margin ambiguous."""
    best = C.decide(ranked)
    out = mentions.join(best.hint("merge"), ["query_id", "mention_idx"], "left")
    return out.withColumns({
        "status": F.coalesce("status", F.lit("no_match")),
        "reason": F.coalesce("reason", F.lit("")),
        "error_code": F.lit(None).cast("string"),
    })


def link_catalog(
    queries: DataFrame, entities: DataFrame, names: DataFrame, fuzzy: bool = True, selections: DataFrame | None = None, alarm_only: bool = False,
    proposals: DataFrame | None = None, fallback: bool = True, type_hints: list[str] | None = None,
) -> DataFrame:
    """One row a query by the catalogue pipeline: status, linked_ids, linked_entity_id, summary_reason, data_layer,
    top_ids (up to five candidates over all mentions), counts and the first error_code.

    ``proposals`` (query_id, mentions: array of text, predicted_type) take the place of detected
    mentions where they are sound; else the detected ones are linked and the query
    is degraded, or fails without ``fallback``. ``selections`` settles ambiguous
    mentions. ``type_hints``: names of other types aren't looked for; alarms as the only hint, or
    ``alarm_only``: a catalogue of alarms, one mention a query. ``fuzzy`` scores names by similarity as well.
    """
    alarm_only = alarm_only or type_hints == [ALARM]
    if proposals is None and selections is None:
        # nothing but the text decides
        alone = lambda texts: _link_catalog(texts, entities, names, fuzzy, None, alarm_only, None, fallback, type_hints)
        return D.once_per_text(queries.select("query_id", "query"), alone).drop("query")
    return _link_catalog(queries, entities, names, fuzzy, selections, alarm_only, proposals, fallback, type_hints)


def _link_catalog(
    queries: DataFrame, entities: DataFrame, names: DataFrame, fuzzy: bool, selections: DataFrame | None, alarm_only: bool,
    proposals: DataFrame | None, fallback: bool, type_hints: list[str] | None,
) -> DataFrame:
    # what is read several times below is written out, so that no plan holds another's whole past
    gated = write_out(request_gate(queries), "catalog-queries")
    valid = gated.where("valid").select("query_id", "query")
    names = write_out(names, "catalog-names")
    looked_for = names.where(F.col("entity_type").isin(type_hints)) if type_hints else names
    different = proposals is None and selections is None
    mentions = (_catalog_of_texts if different else catalog_mentions)(valid, looked_for, alarm_only).select("query_id", "mention_idx", "text", "predicted_type")
    said = None
    if proposals is not None:
        types = sorted(r[0] for r in names.select("entity_type").distinct().collect())  # a closed set
        mentions, said = merge_proposals(valid, proposals, mentions, [*types, ALARM], fallback, alarm_only)
        said = said.select("query_id", F.col("used"), (~F.col("used")).alias("bad"), F.col("error_code").alias("said_code"))
    mentions = write_out(mentions, "catalog-mentions")
    ranked = write_out(catalog_candidates(mentions, names, fuzzy, alarm_only), "catalog-ranked")
    results = mention_results(mentions, ranked)
    if selections is not None:
        results = C.apply_selection(results, ranked, selections, entities)
    results = results.withColumn("degraded", F.coalesce("degraded", F.lit(False)) if "degraded" in results.columns else F.lit(False))
    results = write_out(results, "catalog-results")
    degraded = results.groupBy("query_id").agg(F.bool_or("degraded").alias("degraded"))
    per_query = rollup(results).join(degraded.hint("merge"), "query_id")
    shown = ranked.join(results.where((F.col("status") != "no_match") | F.col("predicted_type").isNotNull()).select("query_id", "mention_idx").hint("merge"), ["query_id", "mention_idx"], "left_semi")
    tops = C.query_candidates(shown, MAX_CANDIDATES).groupBy("query_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))), lambda r: r["entity_id"])).alias("top_ids"))
    layers = C.highest_layer(shown.join(D.small_or_shuffled(entities.select("entity_id", "data_layer")), "entity_id"), "query_id")
    out = gated.join(per_query.hint("merge"), "query_id", "left").join(tops.hint("merge"), "query_id", "left").join(layers.hint("merge"), "query_id", "left")
    if said is None:
        out = out.withColumns({"used": F.lit(False), "bad": F.lit(False), "said_code": F.lit(None).cast("string")})
    else:
        out = out.join(said.hint("merge"), "query_id", "left")
    intent = F.col("query").rlike(X.ALARM_INTENT if alarm_only else X.CATALOG_INTENT)
    needed = intent if alarm_only else intent & ~F.col("query").rlike(X.NOT_REQUIRED)
    # proposals without mentions say that there is nothing to find, unless alarms were looked for after them
    empty = F.when(F.col("bad") & F.lit(not fallback), "dependency_failed").when(needed | (F.col("used") & F.lit(not alarm_only)), "no_match").otherwise("not_required")
    status = F.when(~F.col("valid"), "invalid_input").when(F.col("n_mentions").isNull(), empty)
    status = status.otherwise(status_catalog(F.col("n_mentions"), F.col("n_linked"), F.col("n_failed"), F.col("n_ambiguous"), F.col("degraded") | F.coalesce("bad", F.lit(False)), alarm_only))
    code = F.when(~F.col("valid"), "invalid_input").otherwise(F.coalesce("said_code", "first_error_code"))
    return out.select(
        "query_id", status.alias("status"), F.coalesce("linked_ids", F.lit("")).alias("linked_ids"), "linked_entity_id", F.coalesce("summary_reason", F.lit("")).alias("summary_reason"),
        F.coalesce("data_layer", F.lit(LAYERS[0])).alias("data_layer"), F.coalesce("top_ids", F.lit("")).alias("top_ids"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_mentions", "n_linked", "n_ambiguous")], code.alias("error_code"),
    )
