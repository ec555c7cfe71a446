import hashlib
import random
import re
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mentionforge.llm import bpe
from mentionforge.llm.bpe import WordBpe, bpe_digests, decode_documents, encode_documents
from mentionforge.llm.licenses import evaluate, postfix, scan_licenses

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n ", "Hello  World's ÄÖ <|endoftext|> x\x01y 日本語 12 ΑΣ É é \x1c a\x1db", "a" * 3000, "<|startoftext|><|endoftext|>",
    "it's we'll DON'T 'S", "x　y​z", "Hello  World's", "Hello  World's",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_padding()
    t.no_truncation()
    return t


def noise(seed, n, letters, longest):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(n)]


def test_bpe_is_the_librarys(spark, library):
    texts = TEXTS + noise(1, 60, "thean ingéß日!'1", 300)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in bpe_digests(docs, WORD_BPE).collect()}
    for i, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))), t
    assert bpe_digests(docs.limit(0), WORD_BPE).count() == 0


def test_stream_needs_no_more_than_its_lookahead(monkeypatch, library):
    monkeypatch.setattr(bpe, "CHUNK", 3)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 0)
    b = WordBpe(WORD_BPE)
    assert 0 < b.lookahead < 2000
    for t in noise(2, 20, "theanigs", 3000) + ["ab" * 2000, "aab" * 900]:
        assert list(b.encode(t)) == library.encode(t, add_special_tokens=False).ids


def test_runs_without_space_are_encoded_in_parts(monkeypatch, library):
    """Sections of a few characters: cuts fall beside marks, contractions, numbers, specials and spaces of all kinds."""
    monkeypatch.setattr(bpe, "SECTION", 4)
    b = WordBpe(WORD_BPE)
    for t in noise(5, 300, "ab'srveldtmΣéİ12!\u0301\u0327\u1161\u1100각日\u00a0\x1c \t", 90) + ["<|endoftext|>" + "x'll" * 30, "the 'd've house " * 9]:
        want = library.encode(t, add_special_tokens=False).ids
        assert list(b.encode(t)) == want, t
        n, of_ids, of_text = bpe.digest(b, t, bpe.Kept(b))
        assert n == len(want) and of_ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert of_text == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_memory_does_not_grow_with_a_word(monkeypatch):
    """One word of three times the length takes no more memory beside the text itself."""
    monkeypatch.setattr(bpe, "SECTION", 2048)
    b = WordBpe(WORD_BPE)
    peaks = []
    for n in (60_000, 180_000):
        text = ("thean" * n)[:n]
        tracemalloc.start()
        bpe.digest(b, text, bpe.Kept(b))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]


def test_lookahead_by_brute_force():
    """With a small list, cutting the text anywhere leaves all tokens beyond the lookahead alone."""
    r = random.Random(4)
    b = WordBpe(WORD_BPE)
    for _ in range(30):
        made, merges = ["a", "b", "c"], []
        while len(merges) < 8:
            m = (r.choice(made), r.choice(made))
            if m not in merges and len(m[0] + m[1]) < 7:
                merges.append(m)
                made.append(m[0] + m[1])
        b.ranks = {m: i for i, m in enumerate(merges)}
        reach = WordBpe.sufficient_lookahead(merges)
        for _ in range(20):
            text = [r.choice("abc") for _ in range(40)]
            whole = b.merged(list(text))
            for cut in range(1, 40):
                used = 0
                for x, y in zip(b.merged(text[:cut]), whole, strict=False):
                    used += len(x)
                    if used > cut - reach:
                        break
                    assert x == y


def test_decode_is_incremental(spark):
    docs = spark.createDataFrame([(1, "Größe  日本 <|endoftext|> it's"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in decode_documents(encode_documents(docs, WORD_BPE), WORD_BPE).collect()}
    assert back == {1: "größe 日本 <|endoftext|>it 's ", 2: ""}


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_matches_brute_force(spark):
    r = random.Random(7)
    parts = ["CC-BY", "cc", "by", "General", "Public", "License", "all rights", "reserved.", "é", "\n", "İ", "cc.by", "x9", "—"]
    texts = [None, "", "cc by cc by cc by", "all rights RESERVED"] + [r.choice(" -").join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    for row in scan_licenses(docs).collect():
        assert tuple(row)[1:6] == brute_base(texts[row.doc_id])
        assert 0 <= row.score <= 1 and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
    assert scan_licenses(docs.limit(0)).count() == 0


def test_license_expressions(spark):
    assert postfix("MIT OR GPL-2.0-only AND (BSD-3-Clause OR ISC)") == ["mit", "gpl-2.0-only", "bsd-3-clause", "isc", "or", "and", "or"]
    assert postfix("MIT and") == ["mit"] and postfix("") == [] and postfix(") or") == []
    assert postfix("(MIT OR\n * ISC) AND\nZlib") == ["mit", "isc", "or"] and postfix("MIT\nOR ISC") == ["mit"]
    assert evaluate(postfix("GPL-2.0-only WITH Classpath-exception-2.0")) == ({"gpl-2.0-only"}, 0.4)
    assert evaluate(postfix("(MIT OR GPL-3.0) AND MPL-2.0")) == ({"mit", "gpl-3.0", "mpl-2.0"}, 0.6)
    text = "# SPDX-License-Identifier: (MIT OR\n#   Apache-2.0)\nLicensed under the GNU General Public License."
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "apache-2.0,gpl,mit" and row.base_labels == "gpl" and row.expressions == "mit apache-2.0 or" and row.freedom == 1.0
