"""Candidate entities for mentions: lookup, scoring, ranking, decisions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import write_out
from ..schemas import ALIAS_SCORE, AMBIGUITY_MARGIN, FUZZY_WEIGHT, KEEP_MIN, LAYERS, LINK_MIN, MAX_CANDIDATES, NAME_SCORE, PARTIAL_SCORE, RERANK_MIN, TYPE_BONUS
from .dictionary import occurrences, small_or_shuffled


#: Texts of up to ``SHORT`` letters meet by several letters at once: at most ``TOGETHER``, with ``KEYS`` combinations at most for a length of the other.
SHORT, TOGETHER, KEYS = 48, 10, 64
#: Up to so many shapes of texts are compared each with each; more meet by letters.
SHAPES = 1_000
#: Where no more pairs than these can have the least ratio that counts, no rounds come before it.
FEW_PAIRS = 10_000_000
#: Ratios that are looked for one after the other, until a text has enough candidates that nothing below can overtake.
ROUNDS = (0.93, 0.86, 0.79, 0.72)


def lookup_word(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """Adds normalized_key, word_entity_id and word_status: hit, miss, or invalid_key for an empty key. A key of
    several rows takes its least (source, entity_id): the name before an alias."""
    first = words.groupBy("normalized_key").agg(F.min(F.struct(F.col("source") != "entity_name", "entity_id")).alias("_w"))
    first = first.select(F.col("normalized_key").alias("_k"), F.col("_w.entity_id").alias("word_entity_id"))
    keyed = mentions.withColumn("normalized_key", X.normalize_word(F.col("text")))
    found = keyed.join(small_or_shuffled(first), F.col("normalized_key") == F.col("_k"), "left")
    status = F.when(F.col("normalized_key") == "", "invalid_key").when(F.col("_k").isNotNull(), "hit").otherwise("miss")
    return found.withColumn("word_status", status).drop("_k")


def score_candidates(mentions: DataFrame, names: DataFrame, fuzzy: bool = False) -> DataFrame:
    """query_id, mention_idx, entity_id, confidence, match_reason for mentions (text, predicted_type) and entity names.

    Per entity the best of: canonical name, alias, containment either way, and with
    ``fuzzy`` text similarity; a typed mention sees its type only and earns a bonus.
    Distinct (text, type) pairs are scored once. Exact and containment pairs come
    from equality joins; fuzzy pairs from equality joins on rare letters and bounds that lose no
    pair, the most similar first: a text that has five candidates which nothing less similar can overtake is done.
    Of entities with one name the first five by id count, as the others can't be among a mention's five.
    """
    asked = mentions.select("text", "predicted_type").distinct().withColumn("m", X.normalize_text(F.col("text")))
    asked = asked.where("m <> ''")
    named = names.withColumn("n", X.normalize_text(F.col("name"))).where("n <> ''").select("entity_id", F.col("entity_type").alias("e_type"), "name", "is_canonical", "n")
    named = first_of_a_name(named, ["n", "e_type", "is_canonical"])
    fits = F.col("predicted_type").isNull() | (F.col("predicted_type") == F.col("e_type"))
    exact = asked.join(small_or_shuffled(named), F.col("m") == F.col("n")).where(fits)
    exact = exact.withColumns({"base": F.when(F.col("is_canonical"), NAME_SCORE).otherwise(ALIAS_SCORE), "match_reason": F.when(F.col("is_canonical"), "canonical name match").otherwise("alias match")})
    inside = occurrences(asked, named, "m", "n").where(fits & (F.col("m") != F.col("n"))).drop("at")
    around = occurrences(named, asked, "n", "m").where(fits & (F.col("m") != F.col("n"))).drop("at")
    partial = inside.unionByName(around).withColumns({"base": F.lit(PARTIAL_SCORE), "match_reason": F.lit("partial name match")})
    scored = exact.unionByName(partial)
    bonus = F.when(F.col("predicted_type").isNotNull(), TYPE_BONUS).otherwise(0.0)
    columns = ["text", "predicted_type", "entity_id", "is_canonical", "score", "match_reason"]
    scored = scored.withColumn("score", F.col("base") + bonus).select(*columns)
    if fuzzy:
        scored = _with_similar(write_out(asked, "asked-texts"), write_out(named, "first-names"), write_out(scored, "scored-names"), columns)
    best = scored.groupBy("text", "predicted_type", "entity_id").agg(
        F.max("score").alias("score"), F.max_by("match_reason", F.struct("score", F.col("is_canonical"))).alias("match_reason")
    )
    best = best.where(F.col("score") >= KEEP_MIN).withColumn("confidence", X.clamp_score(F.col("score")))
    cut = Window.partitionBy("text", "predicted_type").orderBy(F.desc("confidence"), "entity_id")
    best = best.withColumn("_r", F.row_number().over(cut)).where(F.col("_r") <= MAX_CANDIDATES).withColumnsRenamed({"text": "_text", "predicted_type": "_type"})
    met = mentions.join(best.hint("merge"), (F.col("text") == F.col("_text")) & F.col("predicted_type").eqNullSafe(F.col("_type")))
    return met.select("query_id", "mention_idx", "predicted_type", "entity_id", "confidence", "match_reason")


def first_of_a_name(named: DataFrame, by: list[str], limit: int = MAX_CANDIDATES) -> DataFrame:
    """Of the entities that agree in ``by``, which fixes what a name of theirs scores, the first ``limit`` by id: those behind score
    no better through it and lose every tie, so they can't be among the best ``limit`` because of it."""
    order = Window.partitionBy(*by).orderBy("entity_id")
    return named.withColumn("_d", F.dense_rank().over(order)).where(F.col("_d") <= limit).drop("_d")


def _with_similar(asked: DataFrame, named: DataFrame, scored: DataFrame, columns: list[str]) -> DataFrame:
    """``scored`` and what the similarity of names adds, as far as it can be among the best candidates of a text.

    Texts that share too little with the shape of any name are left out first. Then, round by round, down to the cut: pairs of a ratio from one
    bound up to the last, or all down to the cut where few are left. After a round a text is left out if its last
    candidate that counts beats whatever a smaller ratio can give, in the rounded scores that are compared.
    """
    low, high = (KEEP_MIN - TYPE_BONUS) / FUZZY_WEIGHT, KEEP_MIN / FUZZY_WEIGHT
    names = write_out(named.select("n").distinct(), "similar-to")
    left = write_out(_with_partners(asked, names, "m", "n", F.when(F.col("predicted_type").isNull(), high).otherwise(low), low), "asked-reach")
    parts, above = [scored], None
    bonus = F.when(F.col("predicted_type").isNotNull(), TYPE_BONUS).otherwise(0.0)
    for least in (*ROUNDS, high, low):
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        if above is not None:
            one = every.groupBy("text", "predicted_type", "entity_id").agg(F.max("score").alias("score"))
            order = Window.partitionBy("text", "predicted_type").orderBy(F.desc("score"))
            last = one.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == MAX_CANDIDATES)
            done = last.where(F.round("score", 4) > F.round(F.lit(above * FUZZY_WEIGHT) + bonus, 4)).select(F.col("text").alias("_text"), F.col("predicted_type").alias("_type"))
            left = left.join(done.hint("merge"), (F.col("text") == F.col("_text")) & F.col("predicted_type").eqNullSafe(F.col("_type")), "left_anti")
            if least == low:
                left = left.where("predicted_type is not null")  # the others' cut is behind them
            left = write_out(left, "asked-still")
        n, most = left.agg(F.count("*"), F.sum("_most")).first()
        if n == 0:
            break
        least = low if most <= FEW_PAIRS else least
        pairs = alike(left.select("m").distinct(), names, "m", "n", least, above)
        met = left.join(pairs.hint("merge"), "m").join(named.hint("merge"), "n")
        apart = (F.col("m") != F.col("n")) & ~F.contains("m", "n") & ~F.contains("n", "m")
        met = met.where(apart & (F.col("predicted_type").isNull() | (F.col("predicted_type") == F.col("e_type"))))
        met = met.withColumns({"score": F.col("ratio") * FUZZY_WEIGHT + bonus, "match_reason": F.lit("fuzzy text similarity")}).where(F.col("score") >= KEEP_MIN)
        # of an entity its best name counts, of a text only its best entities of this round
        met = met.groupBy("text", "predicted_type", "entity_id").agg(F.max("score").alias("score"), F.max_by("is_canonical", "score").alias("is_canonical"), F.first("match_reason").alias("match_reason"))
        best = Window.partitionBy("text", "predicted_type").orderBy(F.desc(F.round("score", 4)), "entity_id")
        met = met.withColumn("_d", F.dense_rank().over(best)).where(F.col("_d") <= MAX_CANDIDATES)
        parts.append(write_out(met.select(*columns), "similar-names"))
        above = least
        if above == low:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alike(xs: DataFrame, ys: DataFrame, x: str, y: str, least: float, above: float | None = None) -> DataFrame:
    """x, y, ratio: all pairs of different texts ``xs`` (x) and ``ys`` (y) whose Ratcliff-Obershelp ratio is at least ``least`` (and
    under ``above``). They meet by rare letters; the longest common subsequence settles most before the ratio is computed."""
    xs, ys = write_out(xs.select(x), "alike-left"), write_out(ys.select(y), "alike-right")
    # so long that a partner may be beyond SHORT; these pairs meet by single letters and the scale of their lengths
    reach = (2 - least) / least + 1e-6
    long = lambda df, c: df.where(F.length(c) * reach > SHORT)
    met = _share_letters(xs.where(F.length(x) <= SHORT), ys.where(F.length(y) <= SHORT), x, y, least)
    far_x, far_y = long(xs, x), long(ys, y)
    if not far_x.isEmpty() and not far_y.isEmpty():
        far = share_a_rare_letter(far_x, far_y, x, y, F.lit(least), least).where((F.length(x) > SHORT) | (F.length(y) > SHORT))
        # a ratio r leaves at most (1 - r) of all letters to be taken out or put in; no more edits are needed
        edits = F.floor((1 - least) * (F.length(x) + F.length(y)) + 1e-9).cast("int")
        met = met.unionByName(far.select(x, y).where(F.call_function("levenshtein", F.col(x), F.col(y), edits) >= 0))
    # written out, as the ratio would else be computed before pairs that met several times are one
    met = write_out(met.distinct().repartition(_parts(met)), "alike-pairs").repartition(_parts(met))
    met = met.withColumn("ratio", X.seq_ratio_from(least)(F.col(x), F.col(y))).where(F.col("ratio").between(least, above or 2.0))
    # written out, so that no later step computes ratios again
    met = write_out(met, "alike-ratios")
    return met.where(F.col("ratio") < above) if above is not None else met


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _meeting_keys(least: float, others: list[int], first: bool):
    """A function that gives the keys under which a text meets others, from the text and the places of its letters, rarest first;
    ``others``: their lengths.

    Texts of lengths p and q with a ratio r have a common subsequence of at least M = r * (p + q) / 2 letters. Its k rarest
    ones, the earlier first, are the same in both, and stand among the first p - M + k and q - M + k of each: a
    combination of k of these, in the order of the text, is a key of both. k is the largest that keeps combinations few.
    """
    others = sorted(others)

    def plan(p: int, q: int) -> tuple[int, int]:
        m = max(1, ceil(least * (p + q) / 2 - 1e-9))
        if m > min(p, q):
            return 0, 0
        fit = [k for k in range(1, min(TOGETHER, m) + 1) if k == 1 or max(comb(p - m + k, k), comb(q - m + k, k)) <= KEYS]
        return m, fit[-1]

    plans = {p: [(q, *plan(p, q)) for q in others if floor(p * least / (2 - least) - 1e-6) <= q <= ceil(p * (2 - least) / least + 1e-6)] for p in range(SHORT + 1)}

    @F.pandas_udf("array<string>")
    def keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ranked in batches:
            out = []
            for text, places in zip(texts, ranked, strict=True):
                p, found = len(text), set()
                for q, m, k in plans[p]:
                    if k:
                        mark = f"{p},{q}," if first else f"{q},{p},"
                        own = [text[i] for i in sorted(places[: p - m + k])]
                        found.update(mark + "".join(c) for c in combinations(own, k))
                out.append(list(found))
            yield pd.Series(out, dtype=object)

    return keys


def _share_letters(xs: DataFrame, ys: DataFrame, x: str, y: str, least: float) -> DataFrame:
    """The pairs of texts of at most ``SHORT`` letters that can reach the ratio ``least``, and some others, perhaps several times.

    A text's shape is the text with all digits alike. Shapes whose longest common subsequence is too short part all their
    texts. Of the others a common subsequence takes so many letters at most as the shapes without digits share, so the digits of
    two texts must have the rest in common: texts meet by combinations of their rarest digits, within a pair of shapes.
    """
    xs, ys = (df.where(F.length(t) > 0).repartition(_parts(df)) for df, t in ((xs, x), (ys, y)))
    both = _shapes_that_meet(xs.select(_shape(x).alias("_sx")).distinct(), ys.select(_shape(y).alias("_sy")).distinct(), least)
    # ten numbers at most
    held = ys.select(F.explode(F.array_distinct(F.split(y, ""))).alias("v")).where(F.col("v").between("0", "9")).groupBy("v").agg(F.count("*").alias("n")).collect()
    seen = {r["v"]: r["n"] for r in held}
    order = sorted("0123456789", key=lambda v: (seen.get(v, 0), v))

    def keyed(df: DataFrame, text: str, own: str) -> DataFrame:
        plans = both.select(F.col(own).alias("_shape"), "_pair", "need", "together").distinct()
        met = df.withColumn("_shape", _shape(text)).join(small_or_shuffled(plans), "_shape").select(text, "_pair", "need", "together")
        return met.mapInArrow(_digit_keys("".join(order)), f"{text} string, _pair long, _key long")

    # texts without a partner's shape make no keys
    left = write_out(keyed(xs, x, "_sx"), "alike-keys")
    # a number of its own: few bytes make many pairs, so that partitions put together by size are too few
    return keyed(ys, y, "_sy").repartition(_parts(ys), "_pair", "_key").join(small_or_shuffled(left), ["_pair", "_key"]).select(x, y)


def _shape(text: str) -> Column:
    return F.translate(text, "123456789", "000000000")


def _shapes_that_meet(of_x: DataFrame, of_y: DataFrame, least: float) -> DataFrame:
    """Pairs of the shapes of ``of_x`` (_sx) and ``of_y`` (_sy) whose texts can reach the ratio ``least``, with a number of their own (_pair)
    and the plan of ``_digits_in_common``."""
    of_x, of_y = write_out(of_x, "alike-shapes"), write_out(of_y, "alike-shapes")
    if of_x.limit(SHAPES + 1).count() <= SHAPES and of_y.limit(SHAPES + 1).count() <= SHAPES:
        every = of_y.agg(F.collect_list("_sy").alias("_sy"))
        both = of_x.repartition(_parts(of_x)).withColumn("_sy", F.explode(every.scalar()))
    else:
        both = _share_in_order(of_x, of_y, "_sx", "_sy", least).distinct()
    both = both.repartition(_parts(of_x)).withColumn("_plan", _digits_in_common(least)("_sx", "_sy")).where("_plan.need is not null")
    return write_out(both.select("_sx", "_sy", F.xxhash64("_sx", "_sy").alias("_pair"), "_plan.*"), "alike-shape-pairs")


def _with_partners(xs: DataFrame, ys: DataFrame, x: str, y: str, least: Column, lowest: float) -> DataFrame:
    """The rows of ``xs`` whose text ``x`` may reach the ratio ``least`` (a column of ``xs``, nowhere under ``lowest``) with a text of ``ys``, as
    far as shapes tell, and how many texts have such a shape (_most). Texts that may have a partner beyond ``SHORT`` stay, with all texts."""
    reach = (2 - lowest) / lowest + 1e-6
    long = F.length(x) * reach > SHORT
    counted = write_out(ys.where((F.length(y) > 0) & (F.length(y) <= SHORT)).groupBy(_shape(y).alias("_sy")).agg(F.count("*").alias("_n")), "alike-shapes-counted")
    of_x = xs.where((F.length(x) > 0) & ~long).select(_shape(x).alias("_sx")).distinct()
    met = _shapes_that_meet(of_x, counted.select("_sy"), lowest).join(small_or_shuffled(counted), "_sy")
    both = F.length("_sx") + F.length("_sy")
    by_shape = met.groupBy("_sx").agg(F.sum("_n").alias("_most"), F.max(2 * F.col("_common") / both).alias("_best"))
    found = xs.where(~long).withColumn("_sx", _shape(x)).join(small_or_shuffled(by_shape), "_sx").where(F.col("_best") >= least - 1e-9).drop("_sx", "_best")
    return found.unionByName(xs.where(long).withColumn("_most", F.lit(ys.count())))


def _digits_in_common(least: float):
    """For two shapes: how many digits (need) their texts must have in common for the ratio ``least``, and how many of these are looked up
    together, with the letters and digits that the shapes share (_common); nulls if no texts of theirs can reach it."""

    @F.pandas_udf("need int, together int, _common int")
    def plan(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        a, b = list(a), list(b)
        if not a:
            return pd.DataFrame({c: pd.Series([], dtype="Int32") for c in ("need", "together", "_common")})
        bare = lambda t: [s.replace("0", "") for s in t]
        all_of, letters = X.common_letters(a, b), X.common_letters(bare(a), bare(b))
        rows = []
        for s, t, most, alike_letters in zip(a, b, all_of.tolist(), letters.tolist(), strict=True):
            m = max(1, ceil(least * (len(s) + len(t)) / 2 - 1e-9))
            p, q, need = s.count("0"), t.count("0"), max(0, m - alike_letters)
            if most < m or need > min(p, q):
                rows.append((None, None, None))
            else:
                fit = [k for k in range(1, min(TOGETHER, need) + 1) if k == 1 or max(comb(p - need + k, k), comb(q - need + k, k)) <= KEYS]
                rows.append((need, fit[-1] if fit else 0, most))
        return pd.DataFrame(rows, columns=["need", "together", "_common"]).astype("Int32")

    return plan


def _digit_keys(order: str):
    """The keys, as numbers, of texts (the text, _pair, need, together): all combinations of ``together`` of the digits that can be the rarest of
    ``need`` common ones, in the order of the text. ``order``: all digits, the rarest first."""
    rank = np.array([order.index(v) for v in "0123456789"], dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.schema.names
            need, together = (batch.column(names.index(c)).to_numpy() for c in ("need", "together"))
            digits = ["".join(c for c in t if "0" <= c <= "9") for t in texts]
            groups: dict[tuple[int, int, int], list[int]] = {}
            for i, (t, m, k) in enumerate(zip(digits, need.tolist(), together.tolist(), strict=True)):
                groups.setdefault((len(t), m, k), []).append(i)
            for (p, m, k), rows in groups.items():
                choose = np.array(list(combinations(range(p - m + k), k)), dtype=np.int64).reshape(comb(p - m + k, k), k)
                # some keys at a time
                step = max(1, 500_000 // max(1, choose.size))
                for lo in range(0, len(rows), step):
                    at = np.array(rows[lo : lo + step])
                    if k == 0:
                        where, keys = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
                    else:
                        own = np.frombuffer("".join(digits[i] for i in at).encode(), dtype=np.uint8).reshape(len(at), p) - 48
                        places = np.sort(np.argsort(rank[own], axis=1, kind="stable")[:, : p - m + k], axis=1)
                        chosen = np.take_along_axis(own, places, axis=1)[:, choose].astype(np.int64)
                        made = np.sort(chosen @ (10 ** np.arange(k, dtype=np.int64)), axis=1)
                        fresh = np.ones(made.shape, dtype=bool)
                        fresh[:, 1:] = made[:, 1:] != made[:, :-1]
                        where, keys = np.nonzero(fresh)[0], made[fresh]
                    part = batch.take(pa.array(at[where]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(names.index("_pair")), pa.array(keys, pa.int64())], names=[names[0], "_pair", "_key"])

    return run


def _share_in_order(xs: DataFrame, ys: DataFrame, x: str, y: str, least: float) -> DataFrame:
    """``_share_letters`` by rare letters of all kinds, in the order of the text."""
    # at most SHORT + 1 lengths
    have = lambda df, text: [r[0] for r in df.select(F.length(text)).distinct().collect()]
    of_x, of_y = have(xs, x), have(ys, y)
    xs, ys = xs.where(F.length(x) > 0), ys.where(F.length(y) > 0)
    seen = ys.repartition(_parts(ys)).select(F.explode(F.array_distinct(F.split(y, ""))).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    # how many names hold each letter: a number for each letter there is
    seen = write_out(seen.agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("_seen")), "alike-letters")

    def keyed(df: DataFrame, text: str, others: list[int], first: bool) -> DataFrame:
        df = df.repartition(_parts(df)).withColumn("_seen", seen.scalar())
        # a letter is as rare wherever it stands in the text
        ranked = F.array_sort(F.transform(F.split(text, ""), lambda v, i: F.struct(F.coalesce(F.element_at("_seen", v), F.lit(0).cast("long")).alias("n"), v.alias("v"), i.alias("i"))))
        return df.select(text, F.explode(_meeting_keys(least, others, first)(F.col(text), F.transform(ranked, lambda r: r["i"]))).alias("_key"))

    left = small_or_shuffled(write_out(keyed(xs, x, of_y, True), "alike-keys"))
    # a number of its own: few bytes make many pairs, so that partitions put together by size are too few
    return keyed(ys, y, of_x, False).repartition(_parts(ys), "_key").join(left, "_key").select(x, y)


def share_a_rare_letter(a: DataFrame, b: DataFrame, x: str, y: str, least: Column, lowest: float) -> DataFrame:
    """The pairs of rows of ``a`` and ``b`` whose texts ``x`` and ``y`` can reach the ratio ``least`` (a column of ``a``, nowhere
    under ``lowest``), and some others; a pair may come several times.

    A ratio r means that r * (length + length) / 2 letters match, so at least r / (2 - r)
    times a text's own length. Letters are told apart by how often they stood before
    (the second e is another letter); rarest first, one of a text's first
    length - matches + 1 letters is then among the other's. So texts meet by equality on
    those letters and on the scale of their lengths, which differ at most by the factor (2 - r) / r;
    ``lowest`` is the least ratio that any pair must reach.
    """
    factor = (2 - lowest) / lowest + 1e-6
    scale = lambda text, by: F.floor(F.log(F.length(text) * F.lit(float(by))) / F.log(F.lit(factor)))

    def letters(df: DataFrame, text: str) -> DataFrame:
        each = F.split(F.col(text), "")
        nth = F.transform(each, lambda ch, i: F.concat(ch, F.size(F.filter(F.slice(each, 1, i + 1), lambda o: o == ch)).cast("string")))
        return df.withColumn("_l", nth)

    def placed(df: DataFrame, text: str, ratio: Column) -> DataFrame:
        ranked = F.array_sort(F.transform("_l", lambda v: F.struct(F.coalesce(F.element_at("_seen", v), F.lit(0).cast("long")).alias("n"), v.alias("v"))))
        matches = F.ceil(ratio / (2 - ratio) * F.length(text) - 1e-9)
        return df.withColumn("_key", F.explode(F.transform(F.slice(ranked, 1, F.greatest(F.lit(1), F.size("_l") - matches.cast("int") + 1)), lambda r: r["v"]))).drop("_l", "_seen")

    a, b = letters(a, x), letters(b, y)
    # how many names hold each letter: at most some numbers for each letter there is
    seen = b.select(F.explode("_l").alias("v")).groupBy("v").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("_seen"))
    left = placed(a.withColumn("_seen", seen.scalar()), x, least)
    right = placed(b.withColumn("_seen", seen.scalar()), y, F.lit(lowest))
    left = left.withColumn("_scale", F.explode(F.sequence(scale(x, (1 - 1e-9) / factor), scale(x, (1 + 1e-9) * factor))))
    return left.join(right.withColumn("_scale", scale(y, 1)).hint("merge"), ["_key", "_scale"]).drop("_key", "_scale")


def fuzzy_pairs(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs whose similarity can reach the cut: met by rare letters, then the bounds, then the ratio itself."""
    typed = F.col("predicted_type").isNotNull()
    low, high = (KEEP_MIN - TYPE_BONUS) / FUZZY_WEIGHT, KEEP_MIN / FUZZY_WEIGHT
    least = F.when(typed, low).otherwise(high)
    met = share_a_rare_letter(asked, named, "m", "n", least, low)
    met = met.where(F.col("predicted_type").isNull() | (F.col("predicted_type") == F.col("e_type")))
    # ratio >= r needs min / max length >= r / (2 - r)
    lengths = F.least(F.length("m"), F.length("n")) >= least / (2 - least) * F.greatest(F.length("m"), F.length("n")) - 1e-9
    apart = (F.col("m") != F.col("n")) & ~F.contains("m", "n") & ~F.contains("n", "m")
    met = met.where(lengths & apart).distinct().where(X.ratio_bound(F.col("m"), F.col("n")) >= least - 1e-9)
    return met.withColumns({"base": X.seq_ratio(F.col("m"), F.col("n")) * FUZZY_WEIGHT, "match_reason": F.lit("fuzzy text similarity")})


def rank_candidates(scored: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The best ``limit`` candidates of each mention, ranked by confidence, then id."""
    w = Window.partitionBy("query_id", "mention_idx").orderBy(F.desc("confidence"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def decide(ranked: DataFrame) -> DataFrame:
    """Per mention: status, entity_id (if linked), confidence and reason."""
    w = Window.partitionBy("query_id", "mention_idx").orderBy("rank")
    top = ranked.withColumn("_second", F.lead("confidence").over(w)).where("rank = 1")
    # scores have four places, so the margin is compared in whole ten-thousandths
    near = F.round((F.col("confidence") - F.col("_second")) * 10000) / 10000 < AMBIGUITY_MARGIN
    status = F.when(F.col("confidence") < LINK_MIN, "no_match").when(near, "ambiguous").otherwise("linked")
    top = top.withColumn("status", status)
    reason = F.when(F.col("status") == "linked", F.col("match_reason")).when(F.col("status") == "ambiguous", "top candidates are within ambiguity margin").otherwise("")
    return top.select("query_id", "mention_idx", "status", F.when(F.col("status") == "linked", F.col("entity_id")).alias("entity_id"), "confidence", reason.alias("reason"))


def query_candidates(ranked: DataFrame, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """Candidates of a query: of each entity the first mention's row, ranked by confidence, then id."""
    first = ranked.groupBy("query_id", "entity_id").agg(F.min_by("confidence", "mention_idx").alias("confidence"))
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "entity_id")
    out = first.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def best_per_entity(entries: DataFrame, by: list[str]) -> DataFrame:
    """Of each entity's entries the highest score, the earliest place on ties."""
    return entries.groupBy(*by, "entity_id").agg(F.max_by(F.struct("score", "reason", "name"), F.struct("score", -F.col("place"))).alias("b")).select(*by, "entity_id", "b.*")


def highest_layer(rows: DataFrame, by: str) -> DataFrame:
    """The highest data layer of each group, by the fixed precedence; unknown layers count as the lowest."""
    ordinal = F.coalesce(*[F.when(F.col("data_layer") == name, k) for k, name in enumerate(LAYERS)], F.lit(0))
    top = rows.groupBy(by).agg(F.max(ordinal).alias("_o"))
    return top.select(by, F.get(F.array(*map(F.lit, LAYERS)), F.col("_o")).alias("data_layer"))


def apply_selection(results: DataFrame, ranked: DataFrame, selections: DataFrame, entities: DataFrame) -> DataFrame:
    """Settles ambiguous mentions by a chooser's output (query_id, mention_idx, selected_entity_id, confidence, reason): taken if
    the id is among the candidates and known and its confidence high enough; else the mention stays and is degraded."""
    offered = ranked.groupBy("query_id", "mention_idx").agg(F.collect_set("entity_id").alias("_ids"))
    known = entities.select(F.col("entity_id").alias("_known")).distinct()
    s = selections.select("query_id", "mention_idx", F.col("selected_entity_id").alias("_sel"), F.col("confidence").alias("_conf"), F.col("reason").alias("_why"))
    out = results.join(s.hint("merge"), ["query_id", "mention_idx"], "left").join(offered.hint("merge"), ["query_id", "mention_idx"], "left").join(small_or_shuffled(known), F.col("_sel") == F.col("_known"), "left")
    ambiguous = F.col("status") == "ambiguous"
    ok = F.coalesce(F.array_contains("_ids", F.col("_sel")) & F.col("_known").isNotNull() & (F.col("_conf") >= RERANK_MIN), F.lit(False))
    return out.withColumns({
        "degraded": ambiguous & ~ok,
        "error_code": F.when(ambiguous & ~ok, "llm_schema_error").otherwise(F.col("error_code")),
        "entity_id": F.when(ambiguous & ok, F.col("_sel")).otherwise(F.col("entity_id")),
        "confidence": F.when(ambiguous & ok, X.clamp_score(F.col("_conf"))).otherwise(F.col("confidence")),
        "reason": F.when(ambiguous & ok, F.coalesce("_why", F.lit("llm disambiguation"))).otherwise(F.col("reason")),
        "status": F.when(ambiguous & ok, "linked").otherwise(F.col("status")),
    }).drop("_sel", "_conf", "_why", "_ids", "_known")


def search(texts: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, entity_id, tier, rank: entities with a name equal to the text (tier 0), then those with one that
    contains it or that it contains (tier 1); a non-null entity_type of the text restricts them."""
    asked = texts.withColumn("m", X.normalize_text(F.col("text"))).where("m <> ''")
    asked = asked if "entity_type" in texts.columns else asked.withColumn("entity_type", F.lit(None).cast("string"))
    asked = asked.select("query_id", "m", F.col("entity_type").alias("want"))
    named = names.withColumn("n", X.normalize_text(F.col("name"))).where("n <> ''").select("entity_id", "entity_type", "n")
    fits = F.col("want").isNull() | (F.col("want") == F.col("entity_type"))
    inside = occurrences(asked, named, "m", "n").where(fits)
    around = occurrences(named, asked, "n", "m").where(fits)
    both = inside.unionByName(around).select("query_id", "entity_id", F.when(F.col("m") == F.col("n"), 0).otherwise(1).alias("tier"))
    best = both.groupBy("query_id", "entity_id").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("query_id").orderBy("tier", "entity_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, limit))


def neighbors(entities: DataFrame) -> DataFrame:
    """entity_id, neighbor_id, relation_type: relationships whose target exists."""
    edges = entities.select("entity_id", F.inline("relationships")).select("entity_id", F.col("target_entity_id").alias("neighbor_id"), "relation_type")
    known = entities.select(F.col("entity_id").alias("neighbor_id")).distinct()
    return edges.join(small_or_shuffled(known), "neighbor_id").select("entity_id", "neighbor_id", "relation_type")


def relation_linked(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds linked to pairs (a, b): a relationship leads from one to the other, either way."""
    edges = entities.select("entity_id", F.inline("relationships")).select(F.col("entity_id").alias("a"), F.col("target_entity_id").alias("b"))
    either = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("_l", F.lit(True))
    return pairs.join(small_or_shuffled(either), ["a", "b"], "left").withColumn("linked", F.coalesce("_l", F.lit(False))).drop("_l")


def alarm_candidates(mentions: DataFrame, names: DataFrame, phrases: bool = True) -> DataFrame:
    """Candidates of alarm mentions (query_id, mention_idx, text): equal keys; with ``phrases``, mentions without
    one that aren't identifiers take names of ratio 0.9 and above. Best entry an entity, ranked, five at most."""
    asked = mentions.withColumn("m", X.normalize_text(F.col("text")))
    named = names.withColumn("n", X.normalize_text(F.col("name"))).where("n <> ''").select("entity_id", "name", "n", F.col("name_idx").alias("place"), "is_canonical")
    # an entity may have a name twice; of those that share one the first ones count
    named = first_of_a_name(named, ["n", "is_canonical"])
    exact = asked.join(small_or_shuffled(named), F.col("m") == F.col("n"))
    exact = exact.withColumns({"score": F.when(F.col("is_canonical"), 1.0).otherwise(0.96), "reason": F.when(F.col("is_canonical"), "canonical alarm name match").otherwise("alarm alias match")})
    by = ["query_id", "mention_idx"]
    entries = exact
    if phrases:
        rest = asked.join(exact.select(*by).distinct().hint("merge"), by, "left_anti").where(~X.is_alarm_identifier(F.col("text")) & (F.col("m") != ""))
        b = named.where(~X.is_alarm_identifier(F.col("name")))
        near = alike(rest.select("m").distinct(), b.select("n").distinct(), "m", "n", 0.9)
        near = rest.join(near.hint("merge"), "m").join(b.hint("merge"), "n")
        near = near.withColumns({"score": 0.78 + F.col("ratio") * 0.1, "reason": F.lit("alarm phrase similarity")}).select(*exact.columns)
        entries = exact.unionByName(near)
    best = best_per_entity(entries, by)
    scored = best.select(*by, "entity_id", X.clamp_score(F.col("score")).alias("confidence"), F.col("reason").alias("match_reason"), X.alarm_dedup_key(F.col("name")).alias("dedup_key"))
    return rank_candidates(scored)
