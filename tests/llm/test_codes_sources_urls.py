"""Vector codes, source divergence and URL filters against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from mentionforge.llm import divergence, vector_codes
from mentionforge.llm.divergence import source_divergence
from mentionforge.llm.url_rules import RULES, judge_urls, match_rules, mine_rules, url_tokens
from mentionforge.llm.vector_codes import encode_vectors, nearest


def plain_codes(rows, entries, rounds, parts=4):
    good = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(good[0][1]) // parts
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in good:
            for p, x in enumerate(cut(v)):
                held[p][near(x, books[p])[1]].append(x)
        books = [[[sum(c) // len(c) for c in zip(*held[p][j], strict=True)] if held[p][j] else e for j, e in enumerate(books[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], Counter()
    for i, v, label in good:
        hits = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{j:02x}" for _, j in hits), sum(d for d, _ in hits), label))
        sums[label] += out[-1][2]
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("entries,labels,nodes", [(256, 100_000, 256), (5, 0, 2)])
def test_vector_codes_by_brute_force(spark, monkeypatch, entries, labels, nodes):
    monkeypatch.setattr(vector_codes, "NODES", nodes)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-3, 3, 12) / 7], int(i % 5)) for i in range(120)]
    rows += [(500 + i, rows[9][1], 1) for i in range(60)] + [(9, rows[9][1], 4), (None, rows[3][1], None), (700, rows[4][1], None)]  # copies, null ids and labels
    bad = [(801, None, 1), (802, [1.0] * 11 + [None], 1), (803, [float("nan")] * 12, 2), (804, [float("-inf")] + [0.0] * 11, None)]
    emb = spark.createDataFrame([(i, v, label, "x", 7) for i, v, label in rows + bad], "vec_id long, embedding array<double>, label int, code string, v int").repartition(5)
    got = sorted((tuple(x) for x in encode_vectors(emb, entries=entries, rounds=4, labels=labels).collect()), key=repr)
    assert got == plain_codes(rows, entries, 4)


def test_vector_codes_of_edge_cases(spark):
    shape = "vec_id long, embedding array<float>, label int"
    make = lambda *rows: spark.createDataFrame(list(rows), shape)
    assert encode_vectors(make()).count() == 0
    assert encode_vectors(make((1, None, 1))).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    one = encode_vectors(make((1, [], 1), (2, [], None))).collect()
    assert [(x.vec_id, x.code, x.error, x.label_error) for x in one] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError):
            encode_vectors(make(*rows))
    with pytest.raises(Exception, match="too large"):
        encode_vectors(make((1, [3e38] * 4, 1)))


def test_nearest_walks_shared_prefixes(monkeypatch):
    r = np.random.default_rng(0)
    for nodes in (1, 3, 256):
        monkeypatch.setattr(vector_codes, "NODES", nodes)
        rows = np.unique(r.integers(-2, 2, (300, 5)), axis=0)
        entries = r.integers(-2, 3, (7, 5))
        far = ((rows[:, None] - entries) ** 2).sum(axis=2)
        index, distance = nearest(rows, entries)
        assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    large = np.array([[-(2**28), 2**28], [2**28, -(2**28)]])
    assert nearest(large, large[::-1].copy())[1].tolist() == [0, 0]
    assert nearest(large, large[:1])[1].tolist() == [0, 2**59]


def plain_divergence(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for text, lang, source in rows]
    by_lang, out = defaultdict(lambda: defaultdict(Counter)), []
    seen = defaultdict(Counter)
    for lang, source, terms in docs:
        by_lang[lang][source].update(terms)
        seen[lang].update(set(terms))
    for lang, sources in by_lang.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = chance(sum(sources.values(), Counter()))
        p = {s: chance(c) for s, c in sources.items()}
        for s, c in sources.items():
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, items, n in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:n])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence_by_brute_force(spark, monkeypatch, small):
    if small:  # every bound is met
        for name, value in {"BLOCK_DOCS": 3, "BLOCK_BYTES": 60, "HELD": 10, "CELLS": 20, "BUCKET": 7, "SOURCES": 2}.items():
            monkeypatch.setattr(divergence, name, value)
    r = random.Random(2)
    words = ["Foo", "foo", "foo,", "foo-bar", "bar.", "(Baz)", "été", "ÉTÉ", "a1b", "42", "...", "日本", "x\x00y", "foo-foo"] + ["w" + chr(97 + i) for i in range(20)]
    rows = [(" ".join(r.choice(words) for _ in range(r.choice([0, 3, 30]))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "Z", None])) for _ in range(150)]
    rows += [("foo " * 70_000, "en", "hot"), ("a," * 5000, "en", "a"), (None, "xx", "only"), (None, "yy", "p"), ("", "yy", "q"), ("1 2", "yy", "r"), *[rows[0]] * 40]
    docs = spark.createDataFrame([(*x, "z", 1) for x in rows], "text string, lang string, source string, term string, block int").repartition(4)
    got = sorted(tuple(x) for x in source_divergence(docs, 12, 5).collect())
    assert got == plain_divergence(rows, 12, 5)
    assert source_divergence(docs.limit(0)).count() == 0


def plain_tokens(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", url or "")
    host, path, rest = (m[1].lower(), m[2].lower(), m[3].lower()) if m else ("", "", "")
    query = re.match(r"\?([^#]*)", rest)
    found = ["h=" + x for x in host.split(".") if x] + ["p=" + x for x in re.split(r"[/._-]+", path) if x]
    return list(dict.fromkeys(found + ["q=" + x.split("=")[0] for x in (query[1].split("&") if query else []) if x.split("=")[0]]))


def plain_rules(labelled, support, least, confidence):
    tokens = [(set(plain_tokens(u)), bad) for u, bad in labelled]
    every = Counter(c for t, _ in tokens for n in range(1, len(t) + 1) for c in combinations(sorted(t), n))
    rules = {}
    for says in (True, False):
        own = Counter(c for t, bad in tokens if bad == says for n in range(1, len(t) + 1) for c in combinations(sorted(t), n))
        rules |= {(c, says): n / every[c] for c, n in own.items() if n >= max(least, support * len(tokens)) and n / every[c] >= confidence}
    return {k: v for k, v in rules.items() if not any(rules.get((tuple(x for x in k[0] if x != t), k[1]), 0) >= v for t in k[0])}


def plain_verdicts(pages, rules):
    out = []
    for i, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        if rule is None:
            has = set(plain_tokens(url))
            said = [(c, not bad) for (t, bad), c in rules.items() if set(t) <= has]
            verdict = "block" if said and not max(said)[1] else "allow"
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=repr)


def test_url_filters_by_brute_force(spark):
    r = random.Random(4)
    pages = []
    for i in range(300):
        host = r.choice(["casino-win", "www.Pills", "blog.fine", "m.news", "other"]) + "." + r.choice(["example.com", "example.net", "example.org"])
        path = r.choice(["", "/", "/en/", "/de/", "/fr/"]) + r.choice(["", "buy", "a/b.html", str(i)])
        pages.append((i, r.choice(["http://", "https://"]) + host + path + r.choice(["", "?page=2&Ref=x", "#top", "?#", "?=1"])))
    # the labels call pills bad, and everything that sells
    bad = {i: "Pills" in u or "buy" in u for i, u in pages if r.random() < 0.7}
    odd = [(901, None), (902, ""), (903, "no scheme/de/"), (904, "://net/x"), (905, "http://NET/"), (906, "http://net"), (907, "x://Ü.Example.COM/de/?://b.net/"), (None, "http://a.org/fr/1"), (908, "http://" + "a." * 3000 + "x/" + "b/" * 3000), (3, pages[3][1]), (909, "http://exämple.com/\n/de/")]
    frame = spark.createDataFrame([(*x, "h", "v", True) for x in pages + odd], "page_id long, url string, host string, verdict string, bad boolean").repartition(3)
    labels = [(i, b) for i, b in bad.items()] + [(2000, True), (None, True), (5, None)]
    marked = spark.createDataFrame(labels, "page_id long, bad boolean")
    labelled = [(u, bad[i]) for i, u in [*pages, (3, pages[3][1])] if i in bad]
    for least, confidence in ((8, 0.8), (20, 1.0)):
        rules = plain_rules(labelled, 0.001, least, confidence)
        assert any(says for _, says in rules)
        mined = mine_rules(spark.createDataFrame(labelled, "url string, bad boolean"), least=least, confidence=confidence)
        assert {(tuple(x.tokens), x.verdict == "block"): round(x.confidence, 9) for x in mined.collect()} == {k: round(v, 9) for k, v in rules.items()}
        got = sorted((tuple(x) for x in judge_urls(frame, marked, least=least, confidence=confidence).collect()), key=repr)
        assert got == plain_verdicts(pages + odd, rules)
    nothing = judge_urls(frame, marked.limit(0))
    assert {x.verdict for x in nothing.where("rule is null").collect()} == {"allow"}
    assert judge_urls(frame.limit(0), marked).count() == 0


def test_long_urls_are_mined_in_stretches(spark):
    url = "http://long.example.com/" + "/".join("abcdefghijklmnopqrstuvwxy"[i % 25] + str(i) for i in range(60))
    labelled = spark.createDataFrame([(url, True)] * 30 + [("http://other.example.com/x", False)] * 30, "url string, bad boolean")
    assert labelled.select(url_tokens(labelled["url"])).first()[0] == plain_tokens(url)
    rules = mine_rules(labelled)
    assert {x.verdict for x in rules.collect()} == {"block", "allow"} and all(len(x.tokens) == 1 for x in rules.collect())
    assert [x.said for x in match_rules(spark.createDataFrame([("http://z/y0/A0",)], "url string"), rules).collect()] == ["block"]


def test_source_names_that_json_escapes(spark):
    """Names with quotes, backslashes, tabs and line ends come back as they were."""
    names = ['s"\\', "a\tb\nc", "é", ""]
    docs = spark.createDataFrame([(f"w{i} shared words", "x", names[i % 4]) for i in range(12)], "text string, lang string, source string")
    got = {r.source for r in source_divergence(docs, min_docs=2).collect()}
    assert got == set(names)
