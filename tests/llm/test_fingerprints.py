import hashlib
import random

import numpy as np
import pytest

from mentionforge.llm.fingerprints import edit_distances, edited, fingerprint, fingerprint_documents, likeness


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last if x == y else 1 + min(row[j + 1], row[j])
    return row[-1]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(n))


def test_edit_distance_by_brute_force():
    r = random.Random(1)
    a = ["".join(r.choice("ABCab") for _ in range(r.randint(0, 64))) for _ in range(200)]
    b = ["".join(r.choice("ABCab") for _ in range(r.randint(0, 64))) for _ in range(200)]
    assert list(edit_distances(a, b)) == [indel(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("buckets", [1, 5])
def test_neighbours_by_brute_force(spark, buckets):
    r = random.Random(2)
    rows = [(i * 3, prose(r, r.randint(0, 300))) for i in range(40)] + [(200, None), (201, ""), (202, "x"), (None, "null id"), (203, "日本語" * 50), (0, "again")]
    rows += [rows[4], (500, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fingerprint string, bucket int").repartition(4)
    got = sorted(fingerprint_documents(docs, buckets).collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.fingerprint, x.near_next))
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = edited(t, n)
        f, fe, fn = (fingerprint(x.encode()) for x in (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fe, likeness([f], [fe])[0], likeness([f], [fn])[0]))
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[3], x[6]))
    assert [tuple(x) for x in got] == want
    assert fingerprint_documents(docs.limit(0)).count() == 0


def test_likeness_tells_edits_from_strangers():
    r = random.Random(3)
    texts = [prose(r, r.randint(200, 2000)) for _ in range(60)]
    own = [fingerprint(t.encode()) for t in texts]
    near = likeness(own, [fingerprint(edited(t, n).encode()) for t, n in zip(texts, texts[1:] + texts[:1], strict=True)])
    far = likeness(own, own[1:] + own[:1])
    assert np.median(near) > 0.45 and np.quantile(far, 0.95) < 0.35 and likeness(own, own).min() == 1
    small = likeness(own, [fingerprint(t.replace("a", "b", 3).encode()) for t in texts])
    assert np.median(small) > 0.85
