"""Table schemas, closed value sets and thresholds of the linking operators."""

from __future__ import annotations

from pyspark.sql import types as T

RELATION = T.StructType([T.StructField(n, T.StringType()) for n in ("target_entity_id", "relation_type", "source", "data_layer")])
ENTITY = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_name", T.StringType()),
    T.StructField("alias", T.ArrayType(T.StringType())),
    T.StructField("desc", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("relationships", T.ArrayType(RELATION)),
    T.StructField("data_layer", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()),
])
ENTITY_WORD = T.StructType([
    T.StructField("entity_word", T.StringType()),
    T.StructField("normalized_key", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("normalization_version", T.StringType()),
    T.StructField("match_mode", T.StringType()),
    T.StructField("min_context_required", T.BooleanType()),
    T.StructField("context_keywords", T.ArrayType(T.StringType())),
    T.StructField("priority", T.IntegerType()),
])
GOLD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("expected_status", T.StringType()),
    T.StructField("negative_reason", T.StringType()),
    T.StructField("mentions", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("span", T.ArrayType(T.IntegerType())),
        T.StructField("expected_entity_ids", T.ArrayType(T.StringType())),
        T.StructField("expected_status", T.StringType()),
        T.StructField("expected_entity_type", T.StringType()),
    ]))),
    T.StructField("expected_entities", T.ArrayType(T.StructType([T.StructField("entity_id", T.StringType())]))),
])

# Old column names of shipped files, and what the code calls them.
LEGACY_NAMES = {"canonical_name": "entity_name", "aliases": "alias", "description": "desc", "relations": "relationships"}
LEGACY_SOURCES = {"canonical_name": "entity_name", "confirmed_aliases": "confirmed_alias"}
# Data layers from lowest to highest.
LAYERS = ["L0_SYNTHETIC", "L1_SANITIZED", "L2_SIMULATED_INTERFACE", "L3_REAL_READONLY", "LOCAL_REAL_ARTIFACT"]
WORD_SOURCES = ["entity_name", "confirmed_alias"]
WORD_VERSION = "v3.entity_word_norm.1"
# Thresholds of candidate scoring.
LINK_MIN, AMBIGUITY_MARGIN, RERANK_MIN, MAX_CANDIDATES, KEEP_MIN = 0.70, 0.08, 0.70, 5, 0.45
NAME_SCORE, ALIAS_SCORE, PARTIAL_SCORE, FUZZY_WEIGHT, TYPE_BONUS = 0.99, 0.92, 0.78, 0.7, 0.05
