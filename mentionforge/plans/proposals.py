"""Mentions proposed by an outside model, checked and merged with detected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def merge_proposals(queries: DataFrame, proposals: DataFrame, detected: DataFrame, types: list[str], fallback: bool = True, alarm_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mentions, per query): a query's proposals (query_id, mentions: array of text, predicted_type) if they are a list
    whose texts aren't empty and whose types are known; else what was detected, or nothing without ``fallback``. With
    ``alarm_only`` the first alarm mention stays, an untyped identifier being one, and a query without any takes what was detected. per query: used, fallback_used, error_code, n_mentions."""
    p = proposals.select("query_id", F.col("mentions").alias("_m"), F.lit(True).alias("_there"))
    good = F.forall("_m", lambda m: (F.coalesce(m["text"], F.lit("")) != "") & (m["predicted_type"].isNull() | m["predicted_type"].isin(types)))
    j = queries.select("query_id").join(p.hint("merge"), "query_id", "left")
    code = F.when(F.col("_there").isNull() | F.col("_m").isNull(), "llm_missing").when(~good, "llm_schema_error")
    if not fallback:
        code = F.when(code.isNotNull(), "dependency_failed")
    j = j.withColumn("error_code", code)
    proposed = j.where("error_code is null").select("query_id", F.posexplode("_m").alias("mention_idx", "m")).select("query_id", "mention_idx", "m.text", "m.predicted_type")
    bad = F.col("error_code").isNotNull()
    if alarm_only:
        proposed = proposed.withColumn("predicted_type", F.when(F.col("predicted_type").isNull() & X.is_alarm_identifier(F.col("text")), "alarm").otherwise(F.col("predicted_type")))
        first = proposed.where("predicted_type = 'alarm'").groupBy("query_id").agg(F.min("mention_idx").alias("mention_idx"))
        proposed = proposed.join(first.hint("merge"), ["query_id", "mention_idx"]).withColumn("mention_idx", F.lit(0))
        none = j.where(~bad).join(first.hint("merge"), "query_id", "left_anti").select("query_id")
        detected_for = none.unionByName(j.where(bad).select("query_id")) if fallback else none
    else:
        detected_for = j.where(bad & F.lit(fallback)).select("query_id")
    rest = detected.join(detected_for.hint("merge"), "query_id", "left_semi")
    mentions = proposed.unionByName(rest.select("query_id", "mention_idx", "text", "predicted_type"))
    n = mentions.groupBy("query_id").agg(F.count("*").alias("n"))
    out = j.join(n.hint("merge"), "query_id", "left").select("query_id", (~bad).alias("used"), (bad & F.lit(fallback)).alias("fallback_used"), "error_code", F.coalesce("n", F.lit(0)).alias("n_mentions"))
    return mentions, out
