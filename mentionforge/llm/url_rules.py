"""URL filters: a list of rules for hosts and paths, and association rules of URL tokens mined from labels."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dictionary import small_or_shuffled
from .storage import save

#: (verdict, host, path): the rule fits the host and its subdomains where the url's path begins with the path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The least share of the labelled urls, and the least number of them, that a combination must stand in with its
#: verdict, and the least share of the urls with the combination that must bear it.
SUPPORT, LEAST, CONFIDENCE = 0.001, 20, 0.8
#: Tokens of a url up to which FP-growth makes all its combinations; where some url has more, they grow token by token.
SPAN = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = {True: "=block", False: "=allow"}


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_part(url: Column, group: int) -> Column:
    """Host (1), path (2) or the rest (3) of a url; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", group)


def host_of(url: Column) -> Column:
    return lower_ascii(url_part(url, 1))


def list_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    found = [F.when(ok, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for ok, (v, h, p) in zip(fits, longest, strict=True)]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def url_tokens(url: Column) -> Column:
    """What a url is told by, in order and each once: labels of the host, pieces of the path, names in the query."""
    pieces = lambda c, at, mark: F.transform(F.filter(F.split(c, at), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(url_part(url, 3), r"(?s)^\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(
        pieces(host_of(url), r"[.]", "h="), pieces(lower_ascii(url_part(url, 2)), r"[/._-]+", "p="),
        F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit("q="), lower_ascii(x))),
    ))


def grown_rules(rows: DataFrame, least: float, confidence: float) -> DataFrame:
    """antecedent, consequent, confidence, n: the rules of ``rows`` (verdict, tokens), whatever a row's length, but for some that
    say no more than one with a token less.

    Combinations grow by a token a round, from those that a row holds and that differ in their last token. A combination is
    grown on if ``least`` rows hold it with a verdict, if each one with a token less stands in more rows (else the two
    stand in the same ones, and so do all that are grown from them) and if its rows are of both verdicts (else nothing
    that is grown from it is surer). What is left out says no more than something that stays.
    """
    bad = (F.col("verdict") == VERDICT[True]).cast("long")
    often = F.greatest("bad", F.col("n") - F.col("bad")) >= least
    ids = save(rows.withColumn("id", F.monotonically_increasing_id()), "url-ids")
    each = ids.select("id", "verdict", F.explode("tokens").alias("token"))
    known = save(each.groupBy("token").agg(F.count("*").alias("n"), F.sum(bad).alias("bad")).where(often), "url-often")
    # rows that are alike in tokens that count are one with a weight
    alike = each.join(small_or_shuffled(known.select("token")), "token").groupBy("id", "verdict").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    alike = alike.groupBy("verdict", "tokens").agg(F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id())
    alike = save(alike, "url-alike")
    sets = known.select(F.array("token").alias("tokens"), "n", "bad")
    held = alike.select("id", "verdict", "w", F.explode("tokens").alias("token")).select("id", "verdict", "w", F.array("token").alias("tokens"))
    rules = []
    while True:
        for says, own in ((True, F.col("bad")), (False, F.col("n") - F.col("bad"))):
            told = sets.where((own >= least) & (own / F.col("n") >= confidence))
            rules.append(told.select(F.col("tokens").alias("antecedent"), F.array(F.lit(VERDICT[says])).alias("consequent"), (own / F.col("n")).alias("confidence"), own.alias("n")))
        mixed = sets.where("bad > 0 and bad < n")
        stem = F.slice("tokens", 1, F.size("tokens") - 1)
        held = held.join(small_or_shuffled(mixed.select("tokens")), "tokens").groupBy("id", "verdict", "w", stem.alias("stem"))
        held = held.agg(F.array_sort(F.collect_list(F.element_at("tokens", -1))).alias("ends")).where(F.size("ends") > 1)
        first = held.select("id", "verdict", "w", "stem", "ends", F.posexplode("ends").alias("at", "a"))
        pairs = first.select("id", "verdict", "w", "stem", "a", F.explode(F.slice("ends", F.col("at") + 2, F.size("ends"))).alias("b"))
        held = save(pairs.select("id", "verdict", "w", F.concat("stem", F.array("a", "b")).alias("tokens")), "url-held")
        grown = held.groupBy("tokens").agg(F.sum("w").alias("n"), F.sum(F.col("w") * bad).alias("bad")).where(often)
        fewer = grown.select("tokens", "n", "bad", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("fewer"))
        fewer = fewer.join(mixed.select(F.col("tokens").alias("fewer"), F.col("n").alias("more")).hint("merge"), "fewer").where("more > n")
        sets = save(fewer.groupBy("tokens", "n", "bad").agg(F.count("*").alias("c")).where(F.col("c") == F.size("tokens")).drop("c"), "url-sets")
        if sets.isEmpty():
            break
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def mine_rules(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, span: int = SPAN) -> DataFrame:
    """tokens, verdict, confidence, support: combinations of tokens that go with a verdict in ``labelled`` (url, bad).

    A combination that says no more than one with a token less (the same verdict, no less confidence) goes. FP-growth finds the
    combinations where no url has more than ``span`` tokens, so that a url gives at most 2 ** ``span``. Where some
    have more, ``grown_rules`` finds them, which makes none that would go.
    """
    tokens = url_tokens(F.col("url"))
    rows = labelled.where("bad is not null").select(F.when(F.col("bad"), VERDICT[True]).otherwise(VERDICT[False]).alias("verdict"), tokens.alias("tokens"))
    rows = save(rows, "url-tokens")
    n, longest = rows.agg(F.count("*"), F.max(F.size("tokens"))).first()
    found = "antecedent array<string>, consequent array<string>, confidence double, lift double, support double"
    if max(support, least / max(n, 1)) > 1:
        mined = labelled.sparkSession.createDataFrame([], found)
    elif longest <= span:
        parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        items = rows.select(F.array_append("tokens", F.col("verdict")).alias("items"))
        mined = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=confidence, numPartitions=parts).fit(items).associationRules
    else:
        mined = grown_rules(rows, max(least, support * n), confidence).withColumn("support", F.col("n") / n)
    held = F.array(*map(F.lit, VERDICT.values()))
    rules = mined.where(F.arrays_overlap("consequent", held) & ~F.arrays_overlap("antecedent", held))
    rules = save(rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.get("consequent", F.lit(0)), 2, 100).alias("verdict"), "confidence", "support"), "url-rules")
    # the combination without each of its tokens, where that is a rule too
    less = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token")).where(F.size("tokens") > 1)
    less = less.select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("token")).alias("fewer"))
    known = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("sure"))
    implied = less.join(known.hint("merge"), ["fewer", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    return rules.join(implied.hint("merge"), ["tokens", "verdict"], "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, said: for each different url that some rule fits, the verdict of the most confident (allow on a tie).

    An inverted index holds each rule under the token that fewest rules hold; urls look their tokens up there.
    """
    each = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    common = each.withColumn("n", F.count("*").over(Window.partitionBy("token")))
    index = common.groupBy("tokens", "verdict", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token")).withColumnRenamed("tokens", "needs")
    index = save(index, "url-index")
    asked = urls.select("url").where("url is not null").distinct().select("url", url_tokens(F.col("url")).alias("has"))
    met = asked.select("url", "has", F.explode("has").alias("token")).join(small_or_shuffled(index), "token").where(F.size(F.array_except("needs", "has")) == 0)
    return met.groupBy("url").agg(F.max_by("verdict", F.struct("confidence", F.col("verdict") == "allow")).alias("said"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) for each row of ``pages`` (page_id, url).

    The longest rule of ``rules`` (verdict, host, path) that fits decides. Else the association rules that are mined
    from ``labels`` (page_id, bad: boolean) decide, the most confident first; else a page is allowed. A page is bad if any
    of its labels says so.

    A null url, or one without ``://``, has an empty host and path and is allowed. Repeated rows are
    judged alike, rows of equal urls count each in mining; null ids stay; pages without labels, labels without
    pages and null labels aren't mined; empty tables give an empty result, or no mined rules;
    other columns are ignored.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), url_part(F.col("url"), 2).alias("path"))
    said = labels.where("bad is not null").groupBy(F.col("page_id").alias("of")).agg(F.bool_or("bad").alias("bad"))
    mined = mine_rules(rows.select("page_id", "url").join(said.hint("merge"), F.col("page_id") == F.col("of")).select("url", "bad"), support, least, confidence)
    open_ = rows.where(list_rule(F.col("host"), F.col("path"), rules or RULES).isNull())
    matched = save(match_rules(open_, mined), "url-verdicts").withColumnRenamed("url", "of_url")
    out = rows.withColumn("listed", list_rule(F.col("host"), F.col("path"), rules or RULES)).join(small_or_shuffled(matched), F.col("url") == F.col("of_url"), "left")
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "said", F.lit("allow")).alias("verdict"))
