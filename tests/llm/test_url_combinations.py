"""Association rules of urls of any length."""

import random

from mentionforge.llm.url_rules import SPAN, judge_urls, mine_rules, url_tokens

from test_codes_sources_urls import plain_rules


def mined(spark, labelled, **bounds):
    found = mine_rules(spark.createDataFrame(labelled, "url string, bad boolean").repartition(3), **bounds).collect()
    return {(tuple(x.tokens), x.verdict == "block"): round(x.confidence, 9) for x in found}


def test_combinations_of_long_urls_by_brute_force(spark):
    """With a span of two all rules of three and more tokens were left out."""
    r = random.Random(8)
    labelled = []
    for _ in range(400):
        own = [w for w in ("buy", "win", "now", "free", "x") if r.random() < 0.6]
        labelled.append(("http://" + r.choice(["a", "b"]) + ".org/" + "/".join(own), {"buy", "win", "now"} <= set(own) or r.random() < 0.1))
    for least, confidence in ((8, 0.8), (30, 0.9), (2, 1.0)):
        rules = {k: round(v, 9) for k, v in plain_rules(labelled, 0.001, least, confidence).items()}
        assert max(len(t) for t, _ in rules) > 2
        assert mined(spark, labelled, least=least, confidence=confidence, span=2) == rules == mined(spark, labelled, least=least, confidence=confidence)


def test_tokens_far_apart_make_a_rule(spark):
    """Only both the first and the last of 40 pieces make a url bad."""
    middle = "/".join("abcdefghijklmnopqrstuvwxyz"[i % 26] + str(i) for i in range(38))
    urls = [f"http://h.example.com/{a}/{middle}/{b}" for a in ("casino", "fine") for b in ("win", "news")]
    labelled = [(u, "casino" in u and "win" in u) for u in urls for _ in range(30)]
    frame = spark.createDataFrame(labelled, "url string, bad boolean")
    assert len(frame.select(url_tokens(frame["url"])).first()[0]) > 4 * SPAN
    assert mined(spark, labelled) == {(("p=casino", "p=win"), True): 1.0, (("p=fine",), False): 1.0, (("p=news",), False): 1.0}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(labelled)], "page_id long, bad boolean")
    got = {x.page_id: x.verdict for x in judge_urls(pages, labels).collect()}
    assert got == {i: "block" if bad else "allow" for i, (_, bad) in enumerate(labelled)}
