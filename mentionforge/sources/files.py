"""Readers of entity, word and gold files: one JSON document, JSON lines, or parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ENTITY, ENTITY_WORD, GOLD, LEGACY_NAMES, LEGACY_SOURCES
from .store import empty_files


#: What a field of each kind may be in a JSON document, by the type that Spark tells of it.
_KINDS = {T.StringType: "STRING|VOID", T.BooleanType: "BOOLEAN|VOID", T.IntegerType: "BIGINT|VOID", T.MapType: "OBJECT<.*>|VOID"}


def _fits(value: Column, kind: T.DataType) -> Column:
    """Whether a JSON value (variant) is null or of ``kind``."""
    said = F.schema_of_variant(value)
    if isinstance(kind, T.ArrayType):
        element = {T.StringType: "STRING|VOID", T.IntegerType: "BIGINT|VOID", T.StructType: "OBJECT<.*>|VOID"}[type(kind.elementType)]
        return said.rlike(rf"(?s)^(VOID|ARRAY<({element})>)$")
    return said.rlike(rf"(?s)^({_KINDS[type(kind)]})$")


def item_problem(item: str, shape: T.StructType) -> Column:
    """What keeps a column of JSON values (variants) from being rows of ``shape``; null where nothing does."""
    field = lambda f: F.try_variant_get(item, f"$.{f.name}", "variant")
    wrong = F.concat_ws(", ", *[F.when(field(f).isNotNull() & ~_fits(field(f), f.dataType), f.name) for f in shape.fields])
    no_object = F.col(item).isNull() | ~F.schema_of_variant(item).startswith("OBJECT<")
    return F.when(no_object, "an item is no object").when(wrong != "", F.concat(F.lit("wrong type: "), wrong))


def document_problems(spark: SparkSession, path: str, shape: T.StructType, member: str) -> DataFrame:
    """file, problem: what keeps the JSON documents at ``path`` from holding ``member`` as a list of rows of ``shape``:
    text that isn't JSON, a root that is no object or lacks the list, metadata that is no object, an item that is no
    object or has a field of another type."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\\uFEFF", "")
    docs = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.try_parse_json(text).alias("v"))
    root = F.schema_of_variant("v")
    part = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    rows, meta = part(member), F.schema_of_variant(part("metadata"))
    is_list = F.coalesce(F.schema_of_variant(rows).startswith("ARRAY<"), F.lit(False))
    problem = (
        F.when(F.col("v").isNull(), "not JSON").when(~root.startswith("OBJECT<"), "the root is no object").when(~is_list, f"no list {member}")
        .when(meta.isNotNull() & ~meta.rlike("(?s)^(OBJECT<.*>|VOID)$"), "metadata is no object")
    )
    roots = docs.select("file", problem.alias("problem")).where("problem is not null")
    items = docs.where(is_list).select("file", F.explode(F.try_variant_get("v", f"$.{member}", "array<variant>")).alias("item"))
    return roots.unionByName(items.select("file", item_problem("item", shape).alias("problem")).where("problem is not null").distinct())


def _read(spark: SparkSession, path: str, row: T.StructType, member: str, layout: str, legacy: bool) -> DataFrame:
    """Rows of ``member`` of one JSON document (layout document), or one row a line (lines), or parquet. A document
    that isn't as it should be is an error at once, a line that isn't JSON one when it is read."""
    old = {new: name for name, new in LEGACY_NAMES.items()} if legacy else {}
    shape = T.StructType([T.StructField(old.get(f.name, f.name), f.dataType) for f in row.fields])
    if layout == "document":
        wrong = document_problems(spark, path, shape, member).limit(20).collect()  # a few to name in the error
        said = [f"{r.file}: {r.problem}" for r in wrong] + [f"{f}: empty" for f in empty_files(spark, path)]
        if said:
            raise ValueError("; ".join(sorted(said)))
        whole = T.StructType([T.StructField(member, T.ArrayType(shape))])
        rows = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline(member))
    else:
        reader = spark.read.schema(shape)
        rows = reader.option("mode", "FAILFAST").json(path) if layout == "lines" else reader.parquet(path)
    return rows.select(*[F.col(old.get(f.name, f.name)).alias(f.name) for f in row.fields])


def read_catalog(spark: SparkSession, path: str, layout: str = "document", legacy_names: bool = False) -> DataFrame:
    """Entities with defaults for what a catalogue may leave out."""
    rows = _read(spark, path, ENTITY, "entities", layout, legacy_names)
    defaults = {
        "desc": F.lit(""), "alias": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>"),
        "relationships": F.array().cast(ENTITY["relationships"].dataType), "data_layer": F.lit("L0_SYNTHETIC"), "source": F.lit("catalog"), "status": F.lit("active"),
    }
    return rows.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})


def read_entity_store(spark: SparkSession, path: str, layout: str = "document", legacy_names: bool = False) -> DataFrame:
    """Entities as stored: nothing is filled in, so that the rules can see what is missing."""
    return _read(spark, path, ENTITY, "entities", layout, legacy_names)


def read_entity_words(spark: SparkSession, path: str, layout: str = "document", legacy_names: bool = False) -> DataFrame:
    rows = _read(spark, path, ENTITY_WORD, "entity_words", layout, False)
    if legacy_names:
        rows = rows.replace(LEGACY_SOURCES, subset=["source"])
    return rows.withColumns({
        "match_mode": F.coalesce("match_mode", F.lit("EXACT_WORD")), "min_context_required": F.coalesce("min_context_required", F.lit(False)),
        "context_keywords": F.coalesce("context_keywords", F.array().cast("array<string>")), "priority": F.coalesce("priority", F.lit(0)),
    })


def read_gold(spark: SparkSession, path: str, layout: str = "document") -> tuple[DataFrame, DataFrame]:
    """(queries, mentions) of a gold file."""
    rows = _read(spark, path, GOLD, "queries", layout, False)
    queries = rows.select(F.col("id").alias("query_id"), "query", "expected_status", "negative_reason", F.transform("expected_entities", lambda e: e["entity_id"]).alias("expected_ids"))
    m = rows.select(F.col("id").alias("query_id"), "expected_status", F.posexplode("mentions").alias("idx", "m"))
    mentions = m.select(
        "query_id", "idx", "m.text", F.get("m.span", F.lit(0)).alias("span_start"), F.get("m.span", F.lit(1)).alias("span_end"), F.col("m.expected_entity_ids").alias("expected_ids"),
        F.coalesce("m.expected_status", "expected_status").alias("expected_status"), F.col("m.expected_entity_type").alias("expected_type"),
    )
    return queries, mentions


def merge_catalogs(bases: list[DataFrame], main: DataFrame) -> DataFrame:
    """Base catalogues, then the main one; each is to pass the rules on its own."""
    return reduce(DataFrame.unionByName, [*bases, main])
