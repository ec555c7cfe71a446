import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from mentionforge.llm import repeats
from mentionforge.llm import arrays as A
from mentionforge.llm.substring_dedup import count_windows, dedup_substrings
from mentionforge.llm.suffix_dedup import adjacent_prefixes, dedup_suffixes, kept_documents, suffix_array

DOCS = "doc_id long, text string, n_removed string, th string"


def corpus(seed=0):
    """Copies, near copies, a shared passage, repetition inside a text, nulls, empties, a repeated row."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(r.randint(1, 120))) for i in range(30)]
    rows += [(100 + i, prose(10) + "\n" + passage + "\t " + prose(20)) for i in range(8)]
    base = prose(150).split(" ")
    for i in range(12):
        near = list(base)
        near[r.randrange(150)] = word()
        rows.append((200 + i, " ".join(near)))
    rows += [(300, rows[0][1]), (301, "For " * 300), (302, "For " * 120), (303, None), (304, ""), (305, " \n "), (None, prose(50)), (306, prose(90))]
    rows += [rows[-1], (307, None)]
    return [(i, t, "x", "y") for i, t in rows]


def spans_brute(rows, units, width):
    seen = collections.Counter()
    for _, t, *_ in rows:
        u = units(t)
        seen.update(tuple(u[i : i + width]) for i in range(len(u) - width + 1))
    out = []
    for i, t, *_ in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            if seen[tuple(u[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, u, gone))
    return out


def words_of(t):
    return (t or "").encode().split()


def bytes_of(t):
    return (t or "").encode()


def brute_words(rows, width):
    return sorted((-1 if i is None else i, len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for i, u, g in spans_brute(rows, words_of, width))


def brute_bytes(rows, width):
    out = []
    for i, u, g in spans_brute(rows, bytes_of, width):
        runs = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        out.append((-1 if i is None else i, len(u), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in df.collect())


@pytest.mark.parametrize("hot,task", [(256, 1 << 16), (3, 1 << 16), (0, 40)])
def test_both_match_brute_force(spark, monkeypatch, hot, task):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HOT_TASK", task)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert rows_of(dedup_substrings(docs)) == brute_words(rows, 35)
    assert rows_of(dedup_suffixes(docs, 120, 24)) == brute_bytes(rows, 120)


@pytest.mark.parametrize("by_words", [False, True])
def test_windows_under_one_fingerprint_are_told_apart(by_words):
    """Every window gets the same fingerprint; only equal texts count."""
    unit = repeats.Unit(3, 2, by_words)
    bodies = [b"a b c d e", b"x b c d y", b"q q q q"] if by_words else [b"abcde", b"xbcdy", b"qqqq"]
    rows = []
    for k, body in enumerate(bodies):
        n = 2 if k == 2 else 3
        rows.append((1, 0, k, n, np.zeros(n, np.uint64).tobytes(), np.arange(n, dtype=np.int32).tobytes(), 0, body))
    got = pd.concat(repeats.sort_windows(unit)(iter([pd.DataFrame(rows, columns=repeats.PRINTS)])))
    assert {r.rhash: r.runs for r in got.itertuples()} == {0: [{"a": 1, "b": 1}], 1: [{"a": 1, "b": 1}], 2: [{"a": 0, "b": 1}]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert dedup_substrings(docs).count() == 0
    assert dedup_suffixes(docs).count() == 0


def test_pipeline_form_cuts_text(spark):
    p = "".join(chr(97 + random.Random(5).randrange(26)) for _ in range(20)) * 30
    docs = spark.createDataFrame([(1, "aé " + p, 603), (2, p + " bé", 603), (3, None, None), (4, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in kept_documents(docs).collect()}
    assert got == {1: ("aé ", 3), 2: (" bé", 3), 3: (None, None), 4: ("clean", 5)}


def test_suffix_array_is_sorted():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 31, 100):
        for k in (1, 2, 5):
            s = [r.randint(1, k) for _ in range(n)]
            assert list(suffix_array(np.array(s, np.int64))) == sorted(range(n), key=lambda i: s[i:])


def test_methods_alone():
    bodies = [b"a b c d", b"x b c d y", b"q q q q"]
    assert list(count_windows(3)(bodies, [2, 3, 2])) == [False, True, False, True, False, True, True]
    bodies = [b"abcd", b"xbcdy", b"qqqq"]
    assert list(adjacent_prefixes(3)(bodies, [2, 3, 2])) == [False, True, False, True, False, True, True]


def test_equal_windows_share_minimisers():
    r = random.Random(3)
    passage = [r.randrange(50) for _ in range(40)]
    for _ in range(20):
        texts = [[r.randrange(50) for _ in range(r.randint(0, 60))] + passage + [r.randrange(50) for _ in range(r.randint(0, 60))] for _ in range(2)]
        met = []
        for t in texts:
            values = A.mix(np.array(t, dtype=A.U) + A.U(9))
            runs = A.minimiser_runs(values, np.array([0, len(t)]), 35, 8)
            at = next(i for i in range(len(t)) if t[i : i + 40] == passage)
            met.append([runs["anchor"][np.flatnonzero(runs["start"] <= at + k)[-1]] for k in range(6)])
        assert met[0] == met[1]
