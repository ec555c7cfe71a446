"""The public, flat form of linking results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_projection(results: DataFrame) -> DataFrame:
    """Adds safe_summary, a sentence by status, to query results; a result's own reasons come first where it has them."""

    def own(name: str, text: str):
        return F.when(F.col(name) != "", F.col(name)).otherwise(F.lit(text)) if name in results.columns else F.lit(text)

    s = F.col("status")
    summary = (
        F.when(s == "not_required", own("bypass_reason", "entity linking is not required"))
        .when(s == "no_match", own("no_match_reason", "no entity candidate found"))
        .when(s == "partial", F.lit("partial result: at least one mention linked and at least one mention unresolved"))
        .when(s == "linked", own("summary_reason", "all detected mentions linked"))
        .otherwise(s)
    )
    return results.withColumn("safe_summary", summary)
