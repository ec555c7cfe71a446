import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from mentionforge.llm import language, toxicity
from mentionforge.llm.language import Pieces, forward, identify_languages, keep_known_languages
from mentionforge.llm.toxicity import CharModel, disguised, keep_clean, restore, score_toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {
    "en": "the house with that there which would about people think write number water other sound place little".split(),
    "de": "das haus mit nicht einer werden können über sprechen schreiben zahl wasser andere klein straße größe".split(),
}


def text_in(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def out_of(i, parts, k):
    return zlib.crc32(str(i).encode()) % parts == k


def test_forward_sums_all_segmentations():
    v = Pieces(PIECES)
    r = np.random.default_rng(0)
    p = np.vstack([r.random((v.unknown + 1, 2)) / 100, np.zeros((1, 2))])
    index = {t: k for k, t in enumerate(v.texts)}

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(word) + 1):
            k = index.get(word[:n], v.unknown if n == 1 else None)
            if k is not None:
                total = total + p[k] * brute(word[n:])
        return total

    for word in ("▁house", "▁größe", "▁日本", "▁the", "▁stritch"):
        codes = np.array([[ord(c) for c in word]], np.uint64)
        assert np.allclose(np.exp(forward(v, codes, p))[0], brute(word))
        one = np.zeros((v.unknown + 1, 1))
        language.expected(v, codes, p[:, :1], np.ones((1, 1)), one)
        # every segmentation covers the word once
        lengths = np.array([len(t) for t in v.texts] + [1])
        assert np.isclose((one[:, 0] * lengths).sum(), len(word))


@pytest.mark.parametrize("n", [31, 32, 33, 70, 900])
def test_long_words_are_summed_whole(monkeypatch, n):
    """Words beyond the rescaling and the block, against plain sums over places in logarithms."""
    monkeypatch.setattr(language, "BLOCK", 64)
    v = Pieces(PIECES)
    r = np.random.default_rng(n)
    p = np.vstack([r.random((v.unknown + 1, 2)) * 10.0 ** -r.integers(1, 7, (v.unknown + 1, 1)), np.zeros((1, 2))])
    index = {t: k for k, t in enumerate(v.texts)}
    letters = random.Random(n)
    words = ["▁" + "".join(letters.choice("thewaterhousestraßegröße日本人語") for _ in range(n - 1)) for _ in range(3)]
    codes = np.array([[ord(c) for c in w] for w in words], np.uint64)
    got, one = forward(v, codes, p), np.zeros((v.unknown + 1, 2))
    weight = np.array([[1.0, 0], [2, 0], [0, 3]])
    language.expected(v, codes, p[:, :1], weight, one)
    want = np.zeros_like(one)
    for w, word in enumerate(words):
        pieces = [[(k, i) for k in range(1, min(v.longest, n - s) + 1) if (i := index.get(word[s : s + k], v.unknown if k == 1 else None)) is not None] for s in range(n)]
        for g in range(2):
            a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            a[0] = b[n] = 0
            for s in range(n):
                for k, i in pieces[s]:
                    a[s + k] = np.logaddexp(a[s + k], a[s] + np.log(p[i, g]))
            assert np.isclose(got[w, g], a[n])
            if g == 0:
                for s in range(n - 1, -1, -1):
                    b[s] = np.logaddexp.reduce([b[s + k] + np.log(p[i, 0]) for k, i in pieces[s]])
                for s in range(n):
                    for k, i in pieces[s]:
                        want[i] += weight[w] * np.exp(a[s] + np.log(p[i, 0]) + b[s + k] - a[n])
    assert np.allclose(one, want)


@pytest.mark.parametrize("least", [1e-13, 1e-15, 1e-20])
def test_chances_of_very_large_training_texts(least):
    """Words of 10,000 letters that a language hasn't seen: finite, and equal to sums in logarithms."""
    v = Pieces(PIECES)
    p = np.full((v.unknown + 2, 2), least)
    p[:, 1] = 1e-3
    p[-2] = 1e-7
    p[-1] = 0
    index = {t: k for k, t in enumerate(v.texts)}
    r = random.Random(7)
    for n in (49, 10_000):
        word = "▁" + "".join(r.choice("thewaterkanaかなqzx") for _ in range(n - 1))
        got = forward(v, np.array([[ord(c) for c in word]], np.uint64), p)[0]
        for g in range(2):
            a = np.full(n + v.longest + 1, -np.inf)
            a[0] = 0
            for s in range(n):
                for k in range(1, min(v.longest, n - s) + 1):
                    i = index.get(word[s : s + k], v.unknown if k == 1 else None)
                    if i is not None:
                        a[s + k] = np.logaddexp(a[s + k], a[s] + np.log(p[i, g]))
            assert np.isfinite(got[g]) and np.isclose(got[g], a[n])


def test_scores_stay_finite_when_counts_are_large(spark):
    """A language with 10 ** 13 counted pieces and one with few: words of letters that neither has seen."""
    v = Pieces(PIECES)
    counts = np.zeros((v.unknown + 1, 2))
    counts[:500] = 2e10, 3.0
    p = counts + language.SMOOTHING
    p /= p.sum(axis=0)
    p[-1] = np.maximum(p[-1] / 1000, language.LEAST)
    texts = ["z" * 48, "か" * 5000, "zzyzx " * 100, "q" * 20_000, "", "the water"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.mapInArrow(language.classify(PIECES, ["en", "xx"], p, ["text"]), "text string, lang_pred string, score double").collect()
    assert all(0 <= x.score <= 1 for x in got) and all(x.lang_pred == "und" if not x.text else x.lang_pred in ("en", "xx") and x.score >= 0.5 for x in got)


def test_language_of_held_out_rows(spark):
    r = random.Random(1)
    rows = [(i, text_in(r, lang := r.choice(["en", "de"]), r.randint(3, 60)), lang) for i in range(300)]
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !", "en"), (1003, "日本語" * 40, None), (None, text_in(r, "de", 30), "de"), (1004, "the house " * 3000, "en")]
    extra.append(extra[-1])
    docs = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in rows + extra], "doc_id long, text string, lang string, score double").repartition(4)
    got = identify_languages(docs, PIECES).collect()
    assert len(got) == len(rows) + len(extra)
    by = {x.doc_id: x for x in got}
    assert all(x.held_out == (x.doc_id is not None and out_of(x.doc_id, 3, 1)) and 0 <= x.score <= 1 for x in got)
    held = [(i, g) for i, _, g in rows if out_of(i, 3, 1)]
    assert np.mean([by[i].lang_pred == g for i, g in held]) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "de" and by[1004].lang_pred == "en"
    kept = keep_known_languages(docs.withColumnRenamed("score", "s"), PIECES)
    assert kept.columns == ["doc_id", "text", "lang", "s"] and not {1000, 1001, 1002} & {x.doc_id for x in kept.collect()}
    assert identify_languages(docs.limit(0), PIECES).count() == 0


@pytest.fixture(scope="module")
def model():
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    text = f"\n\n{' '.join(['stupid idiot loser fool place other water there about', 'stupid loser idiot'] * 50)}\n\n"
    k = [toxicity.CLASS_OF.get(c, toxicity.EDGE) for c in text]
    for a, b, c in zip(k, k[1:], k[2:], strict=False):
        counts[(a * toxicity.CLASSES + b) * toxicity.CLASSES + c] += 1
    return CharModel(counts)


@pytest.mark.parametrize("seen,word", [("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("l o s e r", "loser"), ("stuuupid", "stupid"), ("$tup1d", "stupid"), ("l0ser", "loser"), ("$7up!d", "stupid")])
def test_disguises_are_undone(model, seen, word):
    assert seen in disguised(seen) + [m[0] for m in toxicity.APART_LETTERS.finditer(f"the {seen} there")]
    assert restore(seen, model) == word


@pytest.fixture(scope="module")
def prose_model():
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    text = " ".join(["you are a stupid idiot and a loser", "an idiot and an asshole", "you bitch you ass", "the other water there about a place"] * 50)
    k = [toxicity.CLASS_OF.get(c, toxicity.EDGE) for c in f"\n\n{text}\n\n"]
    for a, b, c in zip(k, k[1:], k[2:], strict=False):
        counts[(a * toxicity.CLASSES + b) * toxicity.CLASSES + c] += 1
    return CharModel(counts)


@pytest.mark.parametrize(
    "seen,words",
    [
        ("y o u a r e a s t u p i d i d i o t a n d a l o s e r", "stupid idiot loser"),
        ("y o u  a r e  a  s t u p i d  i d i o t  a n d  a  l o s e r", "stupid idiot loser"),
        (" ".join("youareastupididiotandaloser" * 20), "stupid idiot loser"),
        ("a n i d i o t", "idiot"),
        ("st up id", "stupid"),
        ("asshol3", "asshole"),
        ("a$$", "ass"),
        ("a55", "ass"),
        ("@$$", "ass"),
        ("@$$h0le", "asshole"),
        ("8!7(h", "bitch"),
        ("1d!07", "idiot"),
        ("!d!07", "idiot"),
        ("idi07", "idiot"),
        ("8itch", "bitch"),
        ("iddiot", "idiot"),
        ("stuupiid", "stupid"),
        ("1d10t" + "_stup1d" * 12, "idiot stupid"),
    ],
)
def test_every_form_of_disguise_is_decoded(prose_model, seen, words):
    assert set(words.split()) <= toxicity.Restorer(prose_model).words(f"the {seen} there")


def test_viterbi_is_the_best_path(model):
    def paths(span, a, b, last):
        if not span:
            yield float(model.log_p[a, b, toxicity.EDGE]), ""
            return
        for letter, chance in toxicity.options(span[0], last, bool(toxicity.SPELT.fullmatch(whole))):
            if not letter:
                for s, t in paths(span[1:], a, b, last):
                    yield s + chance, t
            else:
                k = toxicity.EDGE if letter == " " else toxicity.CLASS_OF.get(letter, toxicity.OTHER)
                for s, t in paths(span[1:], b, k, letter):
                    yield s + chance + float(model.log_p[a, b, k]), letter + t

    for whole in ("1d10t", "st.u-pp1d", "a--b1"):
        assert restore(whole, model) == max(paths(whole, toxicity.EDGE, toxicity.EDGE, ""))[1]


def test_toxicity_of_held_out_rows(spark):
    r = random.Random(3)
    bad = ["stupid", "idiot", "loser"]
    rows, labels = [], []
    for i in range(600):
        words = text_in(r, "en", r.randint(5, 60)).split()
        toxic = int(r.random() < 0.3)
        if toxic:
            word = r.choice(bad)
            disguised = r.random() < 0.3 and out_of(i, 5, 0)
            words.insert(r.randrange(len(words)), word.replace("i", "1").replace("o", "0") if disguised else word)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    extra = [(900, None), (901, ""), (None, "the idiot"), (902, rows[0][1]), (902, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows + extra], "doc_id long, text string, score string, toxic int").repartition(4)
    given = spark.createDataFrame([*labels, (0, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, given).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    by = {x.doc_id: x for x in got}
    held = [(i, t) for i, t in labels if out_of(i, 5, 0)]
    assert all(by[i].held_out for i, _ in held) and by[None].held_out is False
    assert np.mean([by[i].predicted == t for i, t in held]) > 0.95
    assert by[900].predicted == by[901].predicted == 0 and by[None].predicted == 1
    clean = keep_clean(docs, given)
    assert clean.columns == docs.columns and clean.count() == sum(x.score < 0.5 for x in got)
    assert score_toxicity(docs.limit(0), given).count() == 0
    assert {x.predicted for x in score_toxicity(docs, given.limit(0)).collect()} == {0}
