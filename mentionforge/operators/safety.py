"""Redaction and secret scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# What attribute keys may be shown, and what neither keys nor values may hold.
SAFE_KEYS = ["severity", "category", "domain", "vendor", "unit", "task_type", "measurement_type", "object_type", "ne_type", "source_type", "lifecycle_state"]
FORBIDDEN = ["api_key", "token", "secret", "password", "authorization", "base_url", "url", "host", "raw_request", "raw_response", "prompt", "llm"]
# Parts of field names whose values are redacted in records.
REDACTED_PARTS = [
    "api_key", "api_base", "base_url", "token", "cookie", "authorization", "password", "secret", "endpoint_url", "host", "url", "traceback",
    "exception", "payload", "raw_request", "raw_response", "llm_full_log",
]
# What must not appear in published text, in the order in which overlapping hits count.
SECRETS = {
    "raw_llm_payload_key": r"(?iU)\braw_(?:request|response|prompt)\b",
    "authorization_bearer_value": r"(?iU)\bauthorization\b\s*[:=]\s*bearer\s+[A-Za-z0-9._-]{8,}",
    "bearer_token_value": r"(?iU)\bbearer\s+[A-Za-z0-9._-]{12,}",
    "secret_like_api_key": r"(?iU)\bsk-[A-Za-z0-9_-]{8,}\b",
    "concrete_base_url_value": r"(?U)https?://(?!\.\.\./v1)(?!localhost\b)(?!127\.0\.0\.1\b)[^\s\"'<>]+",
}
HIDDEN = "[REDACTED]"


def _holds(c: Column, parts: list[str]) -> Column:
    return F.lower(c).rlike("|".join(p.replace(".", r"\.") for p in parts))


def safe_attributes(attributes: Column) -> Column:
    """struct(safe, omitted) of a map of JSON-encoded values: whitelisted keys with short plain values, and how many were left out.
    Lists of short strings are joined by commas; objects, null and longer strings are left out."""
    as_list = lambda v: F.from_json(v, "array<string>")

    def safe(k: Column, v: Column) -> Column:
        plain = ~v.rlike(r"^\s*[\[{]") & (v != "null") & (F.length(v) <= 300) & ~_holds(v, FORBIDDEN)
        items = v.rlike(r"^\s*\[") & ~v.rlike(r"[\[,]\s*[^\s\"\],]") & F.coalesce(F.forall(as_list(v), lambda x: F.length(x) <= 120), F.lit(False))
        return F.coalesce(F.lower(k).isin(SAFE_KEYS) & ~_holds(k, FORBIDDEN) & (plain | items), F.lit(False))

    kept = F.map_filter(attributes, safe)
    shown = F.transform_values(kept, lambda _, v: F.when(v.rlike(r"^\s*\["), F.array_join(as_list(v), ", ")).otherwise(v))
    return F.struct(shown.alias("safe"), (F.size(attributes) - F.size(kept)).alias("omitted"))


def redact(df: DataFrame) -> DataFrame:
    """Every value under a field or map key whose name holds a forbidden part becomes [REDACTED], at any depth;
    decided from the schema, without a function per row. A map's values may be hidden row by row, so those that aren't
    text become text: numbers and the like as they are written, anything nested as JSON."""

    def forbidden(name: str) -> bool:
        return any(p in name.lower() for p in REDACTED_PARTS)

    def words_of(key: Column, kind: T.DataType) -> Column:
        return key.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(key)

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = [(F.lit(HIDDEN) if forbidden(f.name) else clean(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.AtomicType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            def hide(k: Column, v: Column) -> Column:
                inner = clean(v, kind.valueType)
                nested = isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType))
                return F.when(_holds(words_of(k, kind.keyType), REDACTED_PARTS), HIDDEN).otherwise(F.to_json(inner) if nested else inner.cast("string"))

            return F.transform_values(c, hide)
        return c

    return df.select(*[(F.lit(HIDDEN) if forbidden(f.name) else clean(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])


def scan_secrets(texts: DataFrame) -> DataFrame:
    """source, issue_type, span_start, value (redacted) of each finding in texts (source, text); a hit that overlaps one of an
    earlier pattern, or an earlier one, is dropped."""

    def hits(k: int, name: str, pattern: str) -> Column:
        spans = X.regex_spans(F.col("text"), pattern)
        return F.transform(spans, lambda s: F.struct(F.lit(k).alias("k"), F.lit(name).alias("issue_type"), s["span_start"].alias("a"), s["span_end"].alias("b"), s["text"].alias("v")))

    all_hits = F.flatten(F.array(*(hits(k, name, pattern) for k, (name, pattern) in enumerate(SECRETS.items()))))
    kind = "array<struct<k:int,issue_type:string,a:int,b:int,v:string>>"
    kept = F.aggregate(all_hits, F.array().cast(kind), lambda out, h: F.when(F.exists(out, lambda o: (h["a"] < o["b"]) & (o["a"] < h["b"])), out).otherwise(F.concat(out, F.array(h))))
    found = texts.where("text is not null").select("source", F.inline(kept))
    low = F.lower("v")
    value = F.when(F.contains(low, F.lit("bearer")), "bearer <redacted>").when(F.startswith(low, F.lit("sk-")), "sk-<redacted>").when(low.rlike("^https?://"), "https://<redacted>").otherwise(F.col("v"))
    return found.select("source", "issue_type", F.col("a").alias("span_start"), value.alias("value"))


def scan_summary(texts: DataFrame) -> DataFrame:
    """source, findings, ok for each text."""
    counts = scan_secrets(texts).groupBy("source").agg(F.count("*").alias("n"))
    return texts.select("source").join(counts.hint("merge"), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("findings"), F.col("n").isNull().alias("ok"))
