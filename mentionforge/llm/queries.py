"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .divergence import source_divergence
from .fingerprints import fingerprint_documents
from .language import identify_languages
from .licenses import scan_licenses
from .near_dedup import group_near_duplicates
from .packing import pack_documents
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_suffixes
from .topk import top_k
from .toxicity import score_toxicity
from .url_rules import judge_urls
from .vector_codes import ENTRIES, PARTS, ROUNDS, encode_vectors


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near_duplicates(documents(spark, sf_dir))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(embeddings, embeddings.where("vec_id % 100 = 0"), 10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad where the labels under its number say toxic or of no quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_suffix_array_dedup, op3_toxicity, op4_language_id, op5_bpe,
        op6_fingerprints, op7_minhash_near_dedup, op8_top_k, op9_packing, op10_substring_dedup,
        op11_vector_codes, op12_source_divergence, op13_url_filters,
    )
    return {f.__name__: f for f in found}


def vector_codes_sql() -> str:
    """The codebooks of each round and the last assignment, one table each."""
    far = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = "select p.r, p.p, p.v, unnest(min([{far}, b.j])[2:2]) as j, min([{far}, b.j])[1] as d from parts p join book{k} b using (p) group by p.r, p.p, p.v"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"hit{k} as materialized ({assign.format(far=far, k=k)})")
        steps.append(f"""book{k + 1} as materialized (
            select b.p, b.j, coalesce(m.v, b.v) as v from book{k} b left join (
                select p, j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v
                from (select p, j, i, cast(sum(v[i]) as bigint) as s, cast(count(*) as bigint) as n from (select *, unnest(range(1, len(v) + 1)) as i from hit{k}) group by p, j, i) group by p, j
            ) m on m.p = b.p and m.j = b.j)""")
    return f"""
        with vectors as materialized (
            select row_number() over (order by vec_id nulls last, e) as r, vec_id, label, e from (
                select vec_id, label, list_transform(embedding, lambda x: cast(floor({1024} * cast(x as double)) as bigint)) as e from embeddings
                where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
        ), parts as materialized (
            select r, p, e[p * len(e) // {PARTS} + 1:(p + 1) * len(e) // {PARTS}] as v from (select *, unnest(range({PARTS})) as p from vectors)
        ), book0 as materialized (select p, r - 1 as j, v from parts where r <= {ENTRIES}),
        {",".join(steps)}, last as ({assign.format(far=far, k=ROUNDS)}),
        coded as (select r, string_agg(printf('%02x', j), '' order by p) as code, cast(sum(d) as bigint) as error from last group by r),
        digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, j)) as codebooks_sha256 from book{ROUNDS})
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from vectors join coded using (r), digest
    """


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op12_source_divergence": r"""
        with d as (
            select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   unnest(list_concat([''], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) as term
            from documents
        ), kept as materialized (select lang, term, count(*) as n from d where term <> '' group by lang, term having count(distinct r) >= 30),
        g as (select distinct lang, source from d),
        langs as (select lang, coalesce(sum(n), 0) as total, count(n) as v from (select distinct lang from g) left join kept using (lang) group by lang),
        counts as materialized (
            select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n from g join kept k using (lang)
            left join (select lang, source, term, count(*) as n from d group by all) c on c.lang = g.lang and c.source = g.source and c.term = k.term
        ), chances as materialized (
            select lang, source, term, n, cast(1 + (1000000000 * (cast(n as hugeint) + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as bigint) as p,
                   cast(1 + (1000000000 * (cast(lang_n as hugeint) + 5)) // (total + 5 * v) as bigint) as q
            from counts join langs using (lang)
        ), pairs as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
            left join (
                select x.lang, x.source, y.source as other, cast(sum(abs(x.p - y.p)) as bigint) as value
                from chances x join chances y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
            ) s on s.lang = a.lang and s.source = a.source and s.other = b.source
        ), found as (
            select * from pairs union all
            select lang, source, 'term', term, p - q from chances where n > 0 and p > q
        )
        select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
        from found qualify part = 'pair' or rank <= 50
    """,
    "op8_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and vec_id is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify rank <= 10
    """,
    "op10_substring_dedup": r"""
        with w as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
        ), wins as (
            select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s
            from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)
        ), gone as (
            select distinct doc_id, unnest(range(i, i + 35)) as k
            from wins where s in (select s from wins group by s having count(*) > 1)
        ), kept as (
            select doc_id, string_agg(ws[k], ' ' order by k) as t
            from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as k from w) a anti join gone using (doc_id, k) group by doc_id
        )
        select doc_id, cast(len(ws) as bigint) as n_words, coalesce(c, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from w left join (select doc_id, count(*) as c from gone group by doc_id) using (doc_id) left join kept using (doc_id)
    """,
}
