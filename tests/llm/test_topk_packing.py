import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mentionforge.llm import packing, topk
from mentionforge.llm.packing import Index, pack_documents
from mentionforge.llm.topk import top_k

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("block,bins", [(1024, 1024), (2, 3)])
def test_top_k_by_brute_force(spark, monkeypatch, block, bins):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "BINS", bins)
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [1.0, float("nan"), 1.0, 1.0]), (303, [float("inf")] * 4)]
    rows += [(None, [1.0] * 4), (400, [1.0, 2.0]), (401, [2.0, 2.0]), (500, [1e9, 1e9, -1e9, 3.0]), (3, rows[3][1])]
    emb = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(5)
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_k(emb, emb.where("vec_id % 100 = 0"), 6).collect()}
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:6]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert top_k(emb.limit(0), emb.limit(0)).count() == 0


@pytest.mark.parametrize("k", [2, 10, 40])
def test_top_k_of_dense_scores(spark, k):
    """Scores whose range is far over BINS, with the best within a BINS of each other; queries that settle at different passes."""
    r = np.random.default_rng(1)
    rows = [(i, [float(x), 1.0]) for i, x in enumerate([5000, 4999, 0, *r.integers(0, 9_000_000, 200), *r.integers(8_999_000, 9_000_000, 60)])]
    asked = [(1000, [1.0, 0.0]), (1001, [-1.0, 0.0]), (1002, [0.0, 1.0]), (1003, [7.0, 3.0])]
    schema = "vec_id long, embedding array<double>"
    got = defaultdict(list)
    for part in (rows[:3], rows):
        for x in top_k(spark.createDataFrame(part, schema).repartition(3), spark.createDataFrame(asked, schema), k, 1).orderBy("query_id", "rank").collect():
            got[len(part), x.query_id].append((-x.score, x.vec_id))
        for q, v in asked:
            assert got[len(part), q] == sorted((-int(v[0] * w[0] + v[1] * w[1]), i) for i, w in part)[:k]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(n))


def test_every_id_lies_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    r = random.Random(1)
    rows = [(i, prose(r, r.choice([0, 1, 20, 200, 1500]))) for i in range(70)] + [(100, None), (101, ""), (102, "a<|endoftext|>b  \n\x85x"), (103, "日本語 текст"), (None, "no id"), (104, "For " * 5000)]
    rows.append((105, rows[3][1]))
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    pieces = pack_documents(docs, BYTE_BPE, partitions=3).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert pack_documents(docs.limit(0), BYTE_BPE).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "abc def"), (1, "abc def")], "doc_id long, text string")
    assert sum(p.length for p in pack_documents(docs, BYTE_BPE).collect()) == 2 * len(packing.encode("abc def", BYTE_BPE))


def test_windows_gather_neighbours():
    r = random.Random(4)
    topics = [[r.randrange(40_000) for _ in range(30)] for _ in range(4)]
    documents = [np.array([r.choice(topics[k % 4]) for _ in range(200)], np.uint32) for k in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in documents]), minlength=50_000)
    index = Index(documents, df, 40, 200.0)
    for k in range(40):
        best = np.argsort(-index.scores(k))[:10]
        assert {int(b) % 4 for b in best} == {k % 4}
    brute = []
    for d in documents:
        s = 0.0
        for t in set(documents[0].tolist()):
            tf = int((d == t).sum())
            if tf:
                s += np.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 200))
        brute.append(s)
    assert np.allclose(index.scores(0), brute)


def test_related_documents_with_distant_ids_share_a_window(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    r = random.Random(5)
    common = [prose(r, 1) for _ in range(150)]
    topics = [[prose(r, 1) + prose(r, 1) + "q" + str(k) for _ in range(12)] for k in range(60)]
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.6 else r.choice(topics[i % 60]) for _ in range(50))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    windows = defaultdict(set)
    for p in pack_documents(docs, BYTE_BPE, partitions=2).collect():
        windows[p.doc_id].add(p.sequence_id)
    met = [bool(windows[a] & windows[a + 60 * k]) for a in range(60) for k in (1, 2, 3)]
    assert sum(met) > 0.5 * len(met), sum(met) / len(met)


def test_encoding_is_the_librarys():
    library = Tokenizer.from_file(BYTE_BPE)
    r = random.Random(9)
    texts = ["".join(r.choice(["a", "bc", "É", "é", " ", " ", "\n", "\t", ".", "'s", "12", "\xa0", "<|endoftext|>", "ß", "日", "\x1c", "\x85", "x" * 70]) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, "", " a", "a ", "a\n", "a\nb c", "a b\n\nc", "it's a\nb's"]:
        ids = packing.encode(t, BYTE_BPE)
        assert list(ids) == list(packing.unpacked(packing.packed(ids))) == [*library.encode(t, add_special_tokens=False).ids, 0], t


def test_fast_ids_are_the_librarys_for_every_character_it_takes():
    single, runs, library = packing.encoders(BYTE_BPE)
    taken = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not packing.OTHER_SCRIPTS.search(chr(c))]
    assert len(taken) > 700
    texts = [t for c in taken for t in (c, f"a{c}b", f" {c} {c}1", f"a {c}", f"{c} 'll", f"'{c}s  {c}{c}", f"{c} \n{c}\t")]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert runs.encode_to_numpy(t, allowed_special="all").tolist() == e.ids, t
        if not packing.two_spaces(t):
            assert single.encode_to_numpy(t, allowed_special="all").tolist() == e.ids, t


def test_long_white_space_is_encoded(spark):
    """Runs that the faster library can't split, and long runs of everything else, equal to the defining library, through Spark."""
    library = Tokenizer.from_file(BYTE_BPE)
    n = 2_000_000
    texts = [" " * n, "\n" * n, "a" + " " * n + "b  c", "\n" * n + "x", " \n\t" * (n // 3) + "end", "x" + " " * 10_001, "7" * n, "ab" * n, "-=" * (n // 10), "it's" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = docs.mapInArrow(packing.tokenise(BYTE_BPE), "doc_id long, doc_tokens long, ids binary, n_documents long").where("n_documents is null").collect()
    for x in rows:
        want = library.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert packing.unpacked(x.ids).tolist() == [*want, packing.SEPARATOR], x.doc_id
    assert pack_documents(docs.where("doc_id in (1, 3)"), BYTE_BPE).agg({"length": "sum"}).first()[0] == sum(x.doc_tokens for x in rows if x.doc_id in (1, 3))
