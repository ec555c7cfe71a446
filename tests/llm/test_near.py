import random
import re

import numpy as np
import pytest

from mentionforge.llm import arrays as A
from mentionforge.llm import near_dedup
from mentionforge.llm.components import components
from mentionforge.llm.near_dedup import estimate, group_near_duplicates, keep_one_of_each, registers


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if i != j and a and b and 100 * len(a & b) >= 85 * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return sorted((i, len(s), comp[i], comp[i] == i) for i, s in sets)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abCDefé") for _ in range(r.randint(1, 6)))
    rows = [(1000 + i, " ".join(word() for _ in range(r.choice([0, 1, 3, 5, 8, 40, 120])))) for i in range(40)]
    for g in range(8):
        base = [word() for _ in range(r.choice([12, 60, 200, 400]))]
        for k in range(10):
            near = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                near[r.randrange(len(near))] = word()
            rows.append((g * 10 + k, r.choice([" ", "\n", "  "]).join(near)))
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, rows[0][1]), (2005, "x " * 500), (2006, "X " * 400)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(0, 2048), (1, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n int").repartition(4)
    assert sorted(tuple(x) for x in group_near_duplicates(docs).collect()) == brute(rows)


def test_nulls_repeats_and_empty(spark):
    t = "one two three four five six"
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (3, t), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, group_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)], key=str)
    assert sorted(map(tuple, keep_one_of_each(docs).collect()), key=str) == sorted([(None, t), (3, t), (9, None)], key=str)
    assert group_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {51: 50}


def test_estimate_follows_jaccard():
    r = np.random.default_rng(1)
    for n in (30, 600):
        off = []
        for _ in range(60):
            h = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * A.U(2))
            a, b = h[: int(n * 0.93)], np.sort(h[int(n * 0.07) :])
            true = len(np.intersect1d(a, b)) / n
            x = registers([a, b])
            off.append(estimate(x[:1], x[1:], np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(off)) < 0.05
