"""Fail-closed table rules: each gives violations (table, key, field, error_code, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import WORD_SOURCES, WORD_VERSION
from .dictionary import small_or_shuffled


def _rows(df: DataFrame, table: str, key: Column, field: str | Column, code: str, severity: str = "error") -> DataFrame:
    name = F.lit(field) if isinstance(field, str) else field
    return df.select(F.lit(table).alias("table"), key.cast("string").alias("key"), name.alias("field"), F.lit(code).alias("error_code"), F.lit(severity).alias("severity"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def required(df: DataFrame, table: str, key: str, fields: list[str], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """Missing or blank fields, and values outside their closed sets; one pass over the table."""
    checks = [F.when(blank(F.col(f)), F.struct(F.lit(f).alias("field"), F.lit("missing_field").alias("code"))) for f in fields]
    checks += [F.when(~blank(F.col(f)) & ~F.col(f).isin(values), F.struct(F.lit(f).alias("field"), F.lit("invalid_value").alias("code"))) for f, values in (domains or {}).items()]
    bad = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return bad.select(F.lit(table).alias("table"), "key", "v.field", F.col("v.code").alias("error_code"), F.lit("error").alias("severity"))


def duplicate_ids(df: DataFrame, table: str, key: str) -> DataFrame:
    return _rows(df.groupBy(key).count().where("count > 1"), table, F.col(key), key, "duplicate_id")


def dangling_relations(entities: DataFrame) -> DataFrame:
    edges = entities.select("entity_id", F.inline("relationships"))
    known = entities.select(F.col("entity_id").alias("target_entity_id")).distinct()
    return _rows(edges.join(small_or_shuffled(known), "target_entity_id", "left_anti"), "entities", F.col("entity_id"), F.col("target_entity_id"), "relationship_target_missing")


def duplicate_relations(entities: DataFrame) -> DataFrame:
    """The same relation, whatever its case, to the same target twice in an entity; empty parts."""
    edges = entities.select("entity_id", F.inline("relationships"))
    twice = edges.groupBy("entity_id", F.lower("relation_type").alias("r"), "target_entity_id").count().where("count > 1")
    empty = edges.where(blank(F.col("relation_type")) | blank(F.col("target_entity_id")))
    return union([_rows(twice, "entities", F.col("entity_id"), F.col("target_entity_id"), "duplicate_relationship"), _rows(empty, "entities", F.col("entity_id"), "relationships", "empty_relationship")])


def metadata_mismatch(df: DataFrame, table: str, declared: dict[str, int], types: list[str] | None = None) -> DataFrame:
    """A declared count that isn't the table's, by entity_type and in all (key '*'), and types out of scope."""
    counts = df.groupBy("entity_type").agg(F.count("*").alias("n")).persist()
    every = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("*").alias("entity_type"), "n")
    said = df.sparkSession.createDataFrame(list(declared.items()), "k string, said long")
    off = counts.unionByName(every).join(F.broadcast(said), F.col("entity_type") == F.col("k"), "right").where("coalesce(n, 0) <> said")
    out = [_rows(off, table, F.col("k"), "count", "metadata_count_mismatch")]
    if types is not None:
        out.append(_rows(counts.where(~F.col("entity_type").isin(types)), table, F.col("entity_type"), "entity_type", "type_out_of_scope"))
    return union(out)


def layer_gate(entities: DataFrame, allowed: list[str], confirmed: bool = False) -> DataFrame:
    return _rows(entities.where(~F.col("data_layer").isin(allowed) & F.lit(not confirmed)), "entities", F.col("entity_id"), "data_layer", "layer_not_allowed")


def alias_rules(entities: DataFrame, need_alias: bool = False) -> DataFrame:
    """Aliases that agree after normalising within an entity; no alias where one is needed."""
    keys = F.transform("alias", X.normalize_text)
    twice = entities.where(F.size(F.array_distinct(keys)) < F.size("alias"))
    out = [_rows(twice, "entities", F.col("entity_id"), "alias", "duplicate_alias")]
    if need_alias:
        out.append(_rows(entities.where(F.size("alias") <= 0), "entities", F.col("entity_id"), "alias", "missing_alias"))
    return union(out)


def word_rules(words: DataFrame, entities: DataFrame) -> DataFrame:
    """Per word: its key recomputed, source and version allowed, its entity there, the word one of its names."""
    known = entities.select(F.col("entity_id").alias("_id"), F.concat(F.array("entity_name"), F.coalesce("alias", F.array().cast("array<string>"))).alias("_names"))
    j = words.join(small_or_shuffled(known), F.col("entity_id") == F.col("_id"), "left").withColumn("_key", X.normalize_word(F.col("entity_word")))
    code = lambda cond, name: F.when(cond, F.lit(name))
    codes = F.array_compact(F.array(
        code(F.col("_key") != F.col("normalized_key"), "key_mismatch"), code(~F.col("source").isin(WORD_SOURCES), "source_not_allowed"),
        code(F.col("normalization_version") != WORD_VERSION, "version_not_allowed"), code(F.col("_id").isNull(), "entity_missing"),
        code(F.col("_id").isNotNull() & ~F.array_contains("_names", F.col("entity_word")), "word_not_a_name"),
    ))
    bad = j.select("entity_word", F.explode(codes).alias("error_code"))
    return bad.select(F.lit("entity_words").alias("table"), F.col("entity_word").alias("key"), F.lit("entity_word").alias("field"), "error_code", F.lit("error").alias("severity"))


def key_conflicts(words: DataFrame) -> DataFrame:
    """A key of several entities is an error; of one entity several times a warning."""
    per = words.groupBy("normalized_key").agg(F.count_distinct("entity_id").alias("e"), F.count("*").alias("n"))
    return union([
        _rows(per.where("e > 1"), "entity_words", F.col("normalized_key"), "normalized_key", "key_conflict"),
        _rows(per.where("e = 1 and n > 1"), "entity_words", F.col("normalized_key"), "normalized_key", "duplicate_key", "warning"),
    ])


def gold_rules(gold: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """gold: query_id, query, expected_status, expected_ids; mentions: query_id, idx, text, span_start, span_end, expected_ids,
    expected_status. Unique ids, spans that cut out their text, known ids, mention ids that make up the
    query's, and a shape that fits the status."""
    out = [duplicate_ids(gold, "gold", "query_id")]
    j = mentions.join(gold.select("query_id", "query").dropDuplicates(["query_id"]).hint("merge"), "query_id")
    inside = (F.col("span_start") >= 0) & (F.col("span_end") <= F.length("query")) & (F.col("span_start") < F.col("span_end"))
    cut = F.substring("query", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    out.append(_rows(j.where(~inside | (cut != F.col("text"))), "gold", F.concat_ws("#", "query_id", "idx"), "span", "span_mismatch"))
    known = entities.select(F.col("entity_id").alias("id")).distinct()
    ids = mentions.select("query_id", F.explode("expected_ids").alias("id")).join(small_or_shuffled(known), "id", "left_anti")
    out.append(_rows(ids, "gold", F.col("query_id"), F.col("id"), "unknown_entity"))
    made = mentions.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("expected_ids")))).alias("made"), F.count_if(F.col("expected_status") == "linked").alias("linked"))
    g = gold.join(made.hint("merge"), "query_id", "left")
    none = F.array().cast("array<string>")
    out.append(_rows(g.where(F.coalesce("made", none) != F.array_sort(F.array_distinct("expected_ids"))), "gold", F.col("query_id"), "expected_ids", "id_set_mismatch"))
    s, n = F.col("expected_status"), F.size(F.coalesce("made", none))
    shape = ((s == "linked") & (n == 0)) | ((s == "ambiguous") & (n < 2)) | (s.isin("no_match", "not_required") & (n > 0))
    out.append(_rows(g.where(shape), "gold", F.col("query_id"), "expected_status", "status_shape"))
    return union(out)


def version_mismatch(words_version: str, entities: DataFrame, version_column: str) -> DataFrame:
    """Details of another data version than the words'."""
    return _rows(entities.where(~F.col(version_column).eqNullSafe(F.lit(words_version))), "entities", F.col("entity_id"), version_column, "version_mismatch")


def well_formed(raw: DataFrame, key: str, value: str, schema: str, needed: list[str]) -> DataFrame:
    """Raw JSON rows that don't parse, or lack a needed field."""
    parsed = raw.select(F.col(key).cast("string").alias("k"), F.from_json(value, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    lacks = reduce(lambda a, b: a | b, [F.col(f"r.{f}").isNull() for f in needed])
    return union([_rows(parsed.where(broken), "raw", F.col("k"), value, "malformed_row"), _rows(parsed.where(~broken & lacks), "raw", F.col("k"), value, "missing_field")])


def gate(violations: DataFrame) -> bool:
    """Whether a table may be published: no violation of severity error."""
    return violations.where("severity = 'error'").isEmpty()
