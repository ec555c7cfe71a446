"""Precision and recall of linking results against labelled queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import write_out
from .quality import gate, gold_rules
from .safety import redact

COUNTS = ["tp", "fp", "fn", "tn", "nfp"]


def match_gold(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The actual mention of each expected one (query_id, idx, text): equal normalised text first, else containment
    either way, the lowest mention_idx on ties; null if none. One actual mention may answer several."""
    e = expected.select("query_id", "idx", X.normalize_text(F.col("text")).alias("_e"))
    a = actual.select("query_id", "mention_idx", X.normalize_text(F.col("text")).alias("_a"))
    met = e.join(a.hint("merge"), "query_id")
    contains = (F.col("_e") != "") & (F.contains("_a", "_e") | F.contains("_e", "_a"))
    tier = F.when(F.col("_a") == F.col("_e"), 0).when(contains, 1)
    best = met.withColumn("tier", tier).where("tier is not null").groupBy("query_id", "idx").agg(F.min(F.struct("tier", "mention_idx")).alias("b"))
    return expected.select("query_id", "idx").join(best.select("query_id", "idx", "b.*").hint("merge"), ["query_id", "idx"], "left")


def _counts(tp: Column, fp: Column, fn: Column, tn: Column, nfp: Column) -> list[Column]:
    return [F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in zip(COUNTS, (tp, fp, fn, tn, nfp), strict=True)]


def score_mentions(expected: DataFrame, actual: DataFrame, strict: bool = False) -> DataFrame:
    """A case for each expected mention and each actual one that none expects.

    expected: query_id, idx, text, span_start, expected_ids (array), expected_status, expected_type; actual: query_id,
    mention_idx, text, span_start, status, entity_id, entity_type, candidate_ids (array). ``strict`` matches
    by equal text and also asks for the same place.
    """
    matched = write_out(match_gold(expected, actual), "matched")
    if strict:
        matched = matched.withColumn("mention_idx", F.when(F.col("tier") == 0, F.col("mention_idx")))
    a = actual.select("query_id", "mention_idx", F.col("span_start").alias("a_start"), "status", "entity_id", "entity_type", "candidate_ids")
    pairs = expected.join(matched.hint("merge"), ["query_id", "idx"]).join(a.hint("merge"), ["query_id", "mention_idx"], "left")
    entity, ids = F.coalesce("entity_id", F.lit("")), F.coalesce("candidate_ids", F.array().cast("array<string>"))
    same_place = F.coalesce(F.col("a_start") == F.col("span_start"), F.lit(False)) if strict else F.lit(True)
    status, want = F.coalesce("status", F.lit("missing")), F.col("expected_status")
    shown = (F.size(ids) > 0) | (entity != "")
    linked = (want == "linked") & (status == "linked") & F.array_contains("expected_ids", entity) & same_place
    ambiguous = (want == "ambiguous") & (status == "ambiguous") & (F.size(F.array_except("expected_ids", F.slice(ids, 1, 5))) == 0) & same_place
    negative = ~want.isin("linked", "ambiguous") & (status == want) & ~shown & same_place
    passed = linked | ambiguous | negative
    positive = want.isin("linked", "ambiguous")
    miss = positive & ~passed & F.when(want == "linked", shown).otherwise(F.size(ids) > 0)
    cases = pairs.select(
        "query_id", "idx", want.alias("expected_status"), status.alias("actual_status"), F.coalesce("expected_type", F.lit("")).alias("expected_type"), F.coalesce("entity_type", F.lit("")).alias("actual_type"),
        entity.alias("actual_id"), passed.alias("passed"),
        *_counts(positive & passed, miss | (~positive & ~passed), positive & ~passed, negative, ~positive & ~passed),
    )
    extra = unexpected_mentions(matched, actual)
    extra_ids = F.coalesce("candidate_ids", F.array().cast("array<string>"))
    carries = (F.size(extra_ids) > 0) | (F.coalesce("entity_id", F.lit("")) != "")
    extra = extra.select(
        "query_id", (F.col("mention_idx") + 1000).alias("idx"), F.lit("unexpected").alias("expected_status"), F.col("status").alias("actual_status"), F.lit("").alias("expected_type"),
        F.coalesce("entity_type", F.lit("")).alias("actual_type"), F.coalesce("entity_id", F.lit("")).alias("actual_id"), F.lit(False).alias("passed"),
        *_counts(F.lit(False), F.lit(True), F.lit(False), F.lit(False), carries),
    )
    return cases.unionByName(extra)


def unexpected_mentions(matched: DataFrame, actual: DataFrame) -> DataFrame:
    """Actual mentions that answer no expectation."""
    used = matched.where("mention_idx is not null").select("query_id", "mention_idx").distinct()
    return actual.join(used.hint("merge"), ["query_id", "mention_idx"], "left_anti")


def score_cases(gold: DataFrame, results: DataFrame, mention_cases: DataFrame) -> DataFrame:
    """A case for each gold query (query_id, expected_status, n_expected) with its result's status and n_mentions: counts,
    passed, and the first failure. Negatives without expected mentions count at query level."""
    firsts = F.concat(F.lit("expected "), "expected_status", F.lit(", got "), "actual_status")
    per = mention_cases.groupBy("query_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.bool_and("passed").alias("all_passed"), F.min_by(firsts, F.when(~F.col("passed"), F.col("idx"))).alias("failed"),
        F.bool_or((F.col("expected_status") == "linked") & F.col("passed")).alias("some_linked"), F.bool_or((F.col("expected_status") != "linked") & F.col("passed")).alias("some_other"),
        F.bool_or(F.col("actual_id") != "").alias("any_id"),
    )
    j = gold.join(results.select("query_id", F.col("status").alias("actual_status"), "n_mentions").hint("merge"), "query_id", "left").join(per.hint("merge"), "query_id", "left")
    want, got = F.col("expected_status"), F.coalesce("actual_status", F.lit("missing"))
    quiet = ~F.coalesce("any_id", F.lit(False))
    at_query = (want == "not_required") | ((want == "no_match") & (F.col("n_expected") == 0))
    silent = quiet & F.when(want == "not_required", F.col("n_mentions") == 0).otherwise(True)
    partial = (got == "partial") & F.coalesce("some_linked", F.lit(False)) & F.coalesce("some_other", F.lit(False))
    query_passed = F.when(at_query, (got == want) & silent).when(want == "partial", partial).otherwise(got == want)
    j = j.withColumn("_q", query_passed).withColumn("passed", F.col("_q") & F.coalesce("all_passed", F.lit(True)))
    bad = (at_query & ~F.col("_q")).cast("int")
    extra = {"tn": (at_query & F.col("_q")).cast("int"), "fp": bad, "nfp": bad}
    sums = [(F.coalesce(c, F.lit(0)) + extra.get(c, F.lit(0))).alias(c) for c in COUNTS]
    reason = F.when(F.col("passed"), "").otherwise(F.coalesce("failed", F.concat(F.lit("expected status="), want, F.lit(", got status="), got)))
    return j.select("query_id", want.alias("expected_status"), got.alias("actual_status"), "passed", reason.alias("reason"), *sums)


def rates(df: DataFrame) -> DataFrame:
    """Adds precision and recall from tp, fp, fn: 1 where nothing could be wrong."""
    share = lambda d: F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(d)), F.lit(1.0)), 4)
    return df.withColumns({"precision": share("fp"), "recall": share("fn")})


def totals(cases: DataFrame) -> DataFrame:
    """One row: counts over all cases, precision, recall, notes on empty denominators, and whether everything passed."""
    t = rates(cases.agg(F.count("*").alias("total"), F.count_if("passed").alias("pass"), F.count_if(~F.col("passed")).alias("fail"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]))
    notes = F.concat_ws(",", F.when(F.col("tp") + F.col("fp") == 0, "no_positive_predictions"), F.when(F.col("tp") + F.col("fn") == 0, "no_expected_positive_cases"))
    return t.withColumns({"notes": notes, "passed": (F.col("fail") == 0) & (F.col("nfp") == 0) & (F.col("precision") == 1) & (F.col("recall") == 1)})


def by_type(mention_cases: DataFrame) -> DataFrame:
    """Per type: hits and misses of the expected type, false positives of the actual one."""
    want = mention_cases.select(F.col("expected_type").alias("entity_type"), "tp", "fn", F.lit(0).alias("fp"))
    got = mention_cases.select(F.col("actual_type").alias("entity_type"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), "fp")
    return rates(want.unionByName(got).where("entity_type <> ''").groupBy("entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def report(totals_row: DataFrame, path: str) -> None:
    """The totals as a JSON report."""
    totals_row.select(F.to_json(F.struct(*totals_row.columns)).alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """What ``report`` wrote, as one row."""
    counts = ", ".join(f"{c} long" for c in ("total", "pass", "fail", *COUNTS))
    return spark.read.schema(f"{counts}, precision double, recall double, notes string, passed boolean").json(path)


def evaluate(gold: DataFrame, expected: DataFrame, results: DataFrame, actual: DataFrame, entities: DataFrame, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """The whole evaluation: gold data must pass its rules, then mentions and queries are scored and the totals reported at ``path``.

    gold, expected: as in ``gold_rules``; results: query_id, status, n_mentions; actual: as in
    ``score_mentions``. Gives violations, and unless one is an error also mention_cases, cases, totals,
    types and failures. Gold data that break a rule are never scored.
    """
    violations = gold_rules(gold, expected, entities)
    if not gate(violations):
        return {"violations": violations}
    mention_cases = write_out(score_mentions(expected, actual, strict), "mention-cases")
    cases = write_out(score_cases(gold, results, mention_cases), "cases")
    whole = totals(cases)
    report(redact(whole), path)
    failures = cases.where(~F.col("passed")).select("query_id", "expected_status", "actual_status", "reason")
    return {"violations": violations, "mention_cases": mention_cases, "cases": cases, "totals": whole, "types": by_type(mention_cases), "failures": failures}
