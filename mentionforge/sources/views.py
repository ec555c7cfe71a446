"""Entities, words, queries and gold answers derived from the star tables.

The statements are read by Spark here and inlined as common table expressions
in the SQL that checks the queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "pages", "conversations", "labels", "embeddings")

VIEW_SQL = {
    "fx_entities": """
        select concat('R:', r_regionkey) as entity_id, 'region' as entity_type, r_name as entity_name, cast(null as {string}) as alias1,
               concat('Region ', r_name) as descr, cast(null as {string}) as target, cast(null as {string}) as relation_type from region
        union all
        select concat('N:', n_nationkey), 'nation', n_name, replace(n_name, '_', '-'), concat('Nation in region ', n_regionkey), concat('R:', n_regionkey), 'belongs_to' from nation
        union all
        select concat('S:', s_suppkey), 'supplier', s_name, concat('SUP-', s_suppkey), concat('Supplier in nation ', s_nationkey), concat('N:', s_nationkey), 'located_in' from supplier
        union all
        select concat('C:', c_custkey), 'customer', c_name, concat('CUST-', c_custkey), concat('Customer segment ', c_mktsegment), concat('N:', c_nationkey), 'located_in' from customer
        union all
        select distinct concat('P:', p_name), 'part_name', p_name, cast(null as {string}), concat('Part sold as ', p_name), cast(null as {string}), cast(null as {string}) from part
    """,
    "fx_words": """
        select entity_id, entity_type, entity_name as entity_word, lower(replace(entity_name, ' ', '')) as normalized_key, 'entity_name' as source,
               case when entity_type = 'region' then 'CONTEXT_REQUIRED' else 'EXACT_WORD' end as match_mode from fx_entities
        union all
        select entity_id, entity_type, alias1, lower(replace(alias1, ' ', '')), 'confirmed_alias', 'EXACT_WORD' from fx_entities where alias1 is not null and alias1 <> entity_name
    """,
    "fx_lines": """
        select l_orderkey as okey, l_linenumber as lno, min(l_partkey) as pkey, min(l_suppkey) as skey from lineitem group by l_orderkey, l_linenumber
    """,
    "fx_queries": """
        select okey * 10 + lno as query_id, cast((okey + lno) % 6 as int) as template, okey, skey, p_name, s_name, n_name, r_name, n_nationkey as nkey, r_regionkey as rkey,
               case cast((okey + lno) % 6 as int)
                 when 0 then concat('Check ', p_name, ' for ', s_name, '.')
                 when 1 then concat('Show metrics for SUP-', skey + 1000000, '.')
                 when 2 then 'Open the operations dashboard.'
                 when 3 then concat('Show ', p_name, ' for Unknown-', okey, '.')
                 when 4 then concat('Compare ', upper(p_name), ' in ', n_name, '.')
                 else concat('Query ', replace(p_name, ' ', '  '), ' in ', r_name, ' region.') end as query
        from fx_lines join part on p_partkey = pkey join supplier on s_suppkey = skey
        join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
    """,
    "fx_gold_mentions": """
        select query_id, 0 as idx, case template when 0 then 6 when 3 then 5 when 4 then 8 else 6 end as span_start,
               case when template = 5 then replace(p_name, ' ', '  ') when template = 4 then upper(p_name) else p_name end as text,
               concat('P:', p_name) as expected_entity_id, 'linked' as expected_status, 'part_name' as expected_type
        from fx_queries where template in (0, 3, 4, 5)
        union all
        select query_id, 1, 6 + length(p_name) + 5, s_name, concat('S:', skey), 'linked', 'supplier' from fx_queries where template = 0
        union all
        select query_id, 1, 8 + length(p_name) + 4, n_name, concat('N:', nkey), 'linked', 'nation' from fx_queries where template = 4
        union all
        select query_id, 1, 6 + length(replace(p_name, ' ', '  ')) + 4, r_name, concat('R:', rkey), 'linked', 'region' from fx_queries where template = 5
    """,
    "fx_gold": """
        select query_id, query, template, case when template in (0, 3, 4, 5) then 'linked' else 'no_match' end as expected_status from fx_queries
    """,
}
NEEDS = {k: [v for v in VIEW_SQL if v != k and re.search(rf"\b{v}\b", sql)] for k, sql in VIEW_SQL.items()}


def oracle_ctes(*names: str) -> str:
    """``name as (...)`` for the views asked for and those they need, in order, for DuckDB."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    return ",\n".join(f"{n} as ({VIEW_SQL[n].format(string='varchar')})" for n in wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """One of the views, over the tables in ``sf_dir``; those in ``made`` are taken as they are."""
    if made and name in made:
        return made[name]
    sql = VIEW_SQL[name].format(string="string")
    inputs = {n: view(spark, sf_dir, n, made) for n in NEEDS[name]} | {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)}
    marked = re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in inputs else m[0], sql)
    return spark.sql(marked, **inputs)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table in its full schema."""
    fx = view(spark, sf_dir, "fx_entities")
    strings = F.array().cast("array<string>")
    relation = F.array(F.struct(F.col("target").alias("target_entity_id"), "relation_type", F.lit("star").alias("source"), F.lit("L0_SYNTHETIC").alias("data_layer")))
    return fx.select(
        "entity_id", "entity_type", "entity_name", F.when(F.col("alias1").isNotNull(), F.array("alias1")).otherwise(strings).alias("alias"), F.col("descr").alias("desc"),
        F.create_map(F.lit("kind"), F.col("entity_type"), F.lit("owner_token"), F.concat(F.lit("t-"), "entity_id")).alias("attributes"),
        F.when(F.col("target").isNotNull(), relation).otherwise(F.array().cast(relation_type())).alias("relationships"),
        F.lit("L0_SYNTHETIC").alias("data_layer"), F.lit("star").alias("source"), F.lit("active").alias("status"),
    )


def relation_type() -> str:
    return "array<struct<target_entity_id:string,relation_type:string,source:string,data_layer:string>>"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = view(spark, sf_dir, "fx_words")
    return fx.withColumns({
        "min_context_required": F.lit(False),
        "context_keywords": F.when(F.col("match_mode") == "CONTEXT_REQUIRED", F.array(F.lit("region"))).otherwise(F.array().cast("array<string>")),
        "priority": F.lit(0),
        "normalization_version": F.lit("v3.entity_word_norm.1"),
    })


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_queries").select("query_id", "query")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, entity_type, name, is_canonical: one row for each name of an entity."""
    return entity_names(entities(spark, sf_dir))


def entity_names(ents: DataFrame) -> DataFrame:
    """One row for the name and each alias of every entity."""
    both = F.concat(F.array("entity_name"), F.coalesce("alias", F.array().cast("array<string>")))
    return ents.select("entity_id", "entity_type", F.posexplode(both).alias("name_idx", "name")).withColumn("is_canonical", F.col("name_idx") == 0)
