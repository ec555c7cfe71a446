"""Similar texts meet by several rare letters at once, and nothing is lost."""

import difflib
import random

import pytest

from mentionforge.functions.text import common_letters
from mentionforge.operators import candidates as C

ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("short", [48, 9])
def test_all_alike_pairs_are_found(spark, monkeypatch, short):
    monkeypatch.setattr(C, "SHORT", short)
    r = random.Random(short)
    made = lambda n: "".join(r.choice("abcd01#é") for _ in range(n))
    ys = sorted({made(r.randint(1, 14)) for _ in range(60)} | {f"supplier#{k:09d}" for k in range(25)} | {""})
    xs = sorted({y[:2] + y[3:] for y in ys} | {made(r.randint(1, 14)) for _ in range(20)})
    a, b = spark.createDataFrame([(t,) for t in xs], "x string"), spark.createDataFrame([(t,) for t in ys], "y string")
    for least, above in ((0.9, None), (0.6, 0.9)):
        want = {(x, y) for x in xs for y in ys if x and y and least <= ratio(x, y) < (above or 2)}
        got = C.alike(a, b, "x", "y", least, above).collect()
        assert len(got) == len(want) and {(p.x, p.y) for p in got} == want


def test_few_pairs_meet_among_numbered_names(spark):
    """Names that differ in their numbers alone share most letters; by one rare letter about every fourth pair met."""
    names = spark.range(3000).selectExpr("concat('supplier#', lpad(cast(id as string), 9, '0')) as y")
    asked = names.selectExpr("concat(substring(y, 1, 2), substring(y, 4)) as x")
    met = C._share_letters(asked, names, "x", "y", 0.9).distinct().count()
    assert met < 3000 * 3000 / 10


def test_numbered_names_meet_in_order(spark):
    """Rare letters meet in the order of the text: by letters alone, numbers of equal digits all met."""
    names = spark.range(3000).selectExpr("concat('supplier#', lpad(cast(id as string), 9, '0')) as y")
    asked = names.selectExpr("concat(substring(y, 1, 2), substring(y, 4)) as x")
    met = C._share_letters(asked, names, "x", "y", 0.9).distinct().count()
    assert met < 3000 * 3000 / 25


def test_common_letters(spark):
    r = random.Random(2)
    made = lambda: "".join(r.choice("ab\0é") for _ in range(r.choice([0, 1, 5, 63])))
    a, b = [made() for _ in range(100)], [made() for _ in range(100)]

    def plain(s, t):
        row = [0] * (len(t) + 1)
        for c in s:
            new = [0]
            for j, e in enumerate(t):
                new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    assert list(common_letters(a, b)) == [plain(s, t) for s, t in zip(a, b, strict=True)]


def test_texts_of_far_shapes_do_not_meet(spark):
    """What their letters have in common leaves more to digits than there are."""
    names = spark.range(2000).selectExpr("concat('cust-', cast(id + 10000 as string)) as y")
    asked = spark.range(2000).selectExpr("concat('unknown-', cast(id + 10000 as string)) as x")
    assert C._share_letters(asked, names, "x", "y", 0.45 / 0.7).count() == 0


@pytest.mark.parametrize("shapes", [1000, 3])
def test_texts_meet_by_digits(spark, monkeypatch, shapes):
    """Numbers that have enough digits in common meet, few others do, whether shapes are compared each with each or meet by letters."""
    monkeypatch.setattr(C, "SHAPES", shapes)
    r = random.Random(shapes)
    names = sorted({f"{kind}{r.randrange(10 ** r.randint(1, 6)):0{width}d}" for kind, width in (("cust-", 1), ("customer#", 9), ("sup-", 1), ("7-a", 1)) for _ in range(40)})
    asked = sorted({n[:2] + n[3:] for n in names[::3]} | {"123456", "000000", "é1", "unknown-4711"})
    a, b = spark.createDataFrame([(t,) for t in asked], "x string"), spark.createDataFrame([(t,) for t in names], "y string")
    for least in (0.57, 0.9):
        met = {tuple(p) for p in C._share_letters(a, b, "x", "y", least).distinct().collect()}
        assert {(s, t) for s in asked for t in names if ratio(s, t) >= least} <= met
    assert len(met) < len(asked) * len(names) / 10


def test_texts_without_a_partner_are_left_out(spark):
    names = spark.createDataFrame([("cust-123",), ("cust-124",), ("large rod",)], "n string")
    long = "a text of more letters than 20"
    asked = spark.createDataFrame([("unknown-123", 0.64), ("unknown-123", 0.57), ("cut-129", 0.64), (long, 0.64)], "m string, least double")
    got = C._with_partners(asked, names, "m", "n", C.F.col("least"), 0.57).collect()
    assert sorted((r.m, r._most) for r in got) == sorted([("cut-129", 2), (long, 3)])
