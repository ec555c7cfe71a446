"""Versioned publication of entities and words, and preparation of raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import store
from . import quality as Q
from .dictionary import rebuild_words


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``current`` after ``changes`` (op upsert or delete, seq, then the columns of current): each entity's last change counts,
    so applying a request twice gives the same table."""
    last = changes.groupBy("entity_id").agg(F.max_by(F.struct(*[c for c in changes.columns if c not in ("entity_id", "seq")]), "seq").alias("c")).select("entity_id", "c.*")
    kept = current.join(last.select("entity_id").hint("merge"), "entity_id", "left_anti")
    return kept.unionByName(last.where("op = 'upsert'").select(*current.columns))


def violations(after: DataFrame, words: DataFrame) -> DataFrame:
    """What the rules find in an entity table and its words."""
    return Q.union([Q.required(after, "entities", "entity_id", ["entity_id", "entity_type", "entity_name"]), Q.duplicate_ids(after, "entities", "entity_id"), Q.dangling_relations(after), Q.duplicate_relations(after), Q.alias_rules(after), Q.key_conflicts(words)])


def publish(current: DataFrame, changes: DataFrame, path: str, version: str) -> tuple[DataFrame, bool]:
    """The violations of the table after ``changes``, and whether it is there, with its words, as a version directory.

    A file ``complete`` is written last; a version without it may be published again, one with it is left as it is.
    """
    spark, done = current.sparkSession, f"{path}/{version}/complete"
    after = upsert(current, changes)
    words = rebuild_words(after)
    found = violations(after, words)
    if store.exists(spark, done):
        return found, True
    ok = Q.gate(found)
    if ok:
        after.write.mode("overwrite").parquet(f"{path}/{version}/entities")
        words.write.mode("overwrite").parquet(f"{path}/{version}/entity_words")
        store.create_once(spark, done, version)
    return found, ok


def word_diff(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """Words only in one of two word tables, with the side that has them."""
    columns = ["entity_id", "entity_word", "normalized_key", "source"]
    a, b = rebuilt.select(*columns), stored.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("rebuilt")).unionByName(b.exceptAll(a).withColumn("side", F.lit("stored")))


def prepare_sources(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and violations from raw rows (entity_type, entity_name, alias, confirmation_id, desc): rows of one type and
    normalised name are one entity (its least name), an alias counts only with a confirmation id; names that
    differ before normalising are reported."""
    keyed = raw.withColumn("key", X.normalize_text(F.col("entity_name"))).where("key <> ''")
    alias = F.when(~Q.blank(F.col("confirmation_id")) & ~Q.blank(F.col("alias")), F.col("alias"))
    made = keyed.groupBy("entity_type", "key").agg(F.min("entity_name").alias("entity_name"), F.array_sort(F.collect_set(alias)).alias("alias"), F.min("desc").alias("desc"), F.count_distinct("entity_name").alias("names"))
    entities = made.select(F.concat_ws(":", "entity_type", "key").alias("entity_id"), "entity_type", "entity_name", "alias", "desc")
    return entities, Q._rows(made.where("names > 1"), "raw", F.concat_ws(":", "entity_type", "key"), "entity_name", "name_conflict", "warning")
