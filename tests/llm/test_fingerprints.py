"""Fingerprints against plain Python: the definition of an anchor, strings, order of documents, edits, likeness."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglossa.llm import fingerprints as fp


def prose(r, n):
    words = ["".join(r.choices("abcdefgé漢😀", k=r.randint(2, 9))) for _ in range(400)]
    return " ".join(r.choices(words, k=n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base = [prose(r, r.randint(40, 300)) for _ in range(20)]
    return [None, "", "x", "short text", "a" * 500, "ab" * 900 + base[0], *base, base[3], base[3], base[4][:300] + base[5], prose(r, 60_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(7 * i - 30, t, "f", "h") for i, t in enumerate(texts)]
    rows += [(None, "no id " * 20, "f", "h"), (None, None, "f", "h"), rows[8], rows[8], rows[8], (5, "same id, other text " * 9, "f", "h"), (5, "same id " * 30, "f", "h")]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, hash string").repartition(3).cache()


def plain_anchors(text, k=fp.K, inner=fp.INNER):
    """Places of the closed syncmers, an anchor equal to the one before left out."""
    points = np.array([ord(c) for c in text], np.uint64)
    h = fp._windows(points, inner).tolist() if len(text) >= inner else []
    out, last = [], None
    for i in range(len(text) - k + 1):
        w = h[i : i + k - inner + 1]
        if w.index(min(w)) in (0, len(w) - 1):
            if text[i : i + k] != last:
                out.append(i)
            last = text[i : i + k]
    return out or [0] * bool(text)


def plain_chain(a, b):
    """Longest common subsequence of two lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_anchors(texts, monkeypatch):
    texts = [t or "" for t in texts]
    found = fp.anchors(texts)
    for j, t in enumerate(texts):
        one = found.rows(j, j + 1)
        assert one.places.tolist() == plain_anchors(t), j
        for a, b in zip(one.places[:50], one.hashes[:50]):
            assert int(b) == int(fp.anchors([t[a : a + fp.K]]).hashes[0]) or len(t) < 2 * fp.K
    monkeypatch.setattr(fp, "STEP", 97)  # blocks of one text overlap by an anchor
    again = fp.anchors(texts)
    assert (again.hashes == found.hashes).all() and (again.places == found.places).all() and (again.offsets == found.offsets).all()
    # every stretch of k-mers holds an anchor
    assert max(np.diff(found.rows(len(texts) - 1, len(texts)).places)) <= fp.K - fp.INNER + 1


def test_strings(texts):
    found = fp.anchors([t or "" for t in texts])
    back = fp.parsed(found.strings())
    assert (back.hashes == found.hashes).all() and (back.places == found.places).all() and (back.offsets == found.offsets).all()
    assert found.strings()[1] == "" and fp.parsed([]).offsets.tolist() == [0]


def test_likeness(texts):
    r = random.Random(9)
    base = [t for t in texts if t and len(t) < 5000]
    pairs = [(a, b) for a in base for b in r.sample(base, 3)]
    pairs += [(a, a[200:] + a[:200]) for a in base] + [(a, a[:250] + "!" + a[250:]) for a in base] + [("", ""), ("", "x")]
    left, right = (fp.anchors(list(x)) for x in zip(*pairs))
    for j, got in enumerate(fp.likeness(left, right)):
        a, b = (x.rows(j, j + 1).hashes.tolist() for x in (left, right))
        most = 2 * plain_chain(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert got <= most + 1e-12
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert got == most


def test_compared(docs):
    rows = sorted(docs.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0))
    found = fp.compare_edited(docs).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.text or "")
    single = [i for i, t in by_id.items() if len(t) == 1 and i is not None]
    after = {a: by_id[b] for a, b in zip([*by_id], [*by_id][1:] + [*by_id][:1])}
    for r in found:
        if r.doc_id in single:
            edits = [fp.edited_text(by_id[r.doc_id][0], t) for t in after[r.doc_id]]
            assert r.edited in edits and r.n_chars == len(by_id[r.doc_id][0])
            assert [r.fingerprint, r.edited_fingerprint] == fp.anchors([by_id[r.doc_id][0], r.edited]).strings()
            near = fp.likeness(fp.parsed([r.fingerprint]), fp.parsed([r.edited_fingerprint]))[0]
            assert near == r.near_edited and 0 <= r.near_next <= 1
            if r.n_chars > 1000 and r.edited != by_id[r.doc_id][0]:
                assert 0.3 < r.near_edited < 0.75
    # of repeated rows all but the last are followed by themselves
    assert sorted(r.near_next == 1 for r in found if r.doc_id == rows_of(docs, 3)) == [False, True, True, True]
    digest = {r.edited_sha256 for r in fp.edited_digest(docs).collect()}
    assert digest == {hashlib.sha256(r.edited.encode()).hexdigest() for r in found}


def rows_of(docs, times):
    """The id of the row that is repeated."""
    return docs.groupBy("doc_id", "text").count().filter(F.col("count") > times).first().doc_id


def test_order_of_lots(docs, spark):
    """Any number of lots gives the same rows, each with its ghost behind it."""
    few, many = (sorted(fp.compare_edited(docs, lot_bytes=b).collect(), key=str) for b in (1 << 30, 1500))
    assert few == many
    one = spark.createDataFrame([(4, "alone " * 30)], "doc_id long, text string")
    assert fp.compare_edited(one).first().near_next == 1 and not fp.compare_edited(one.limit(0)).count()
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprint_documents(docs).collect()}
    assert all(prints[r.doc_id] == r.fingerprint for r in few if r.doc_id not in (None, 5))
    alike = fp.compare_fingerprints(fp.edited_digest(docs), "fingerprint", "edited_fingerprint", "again")
    assert all(r.again == r.near_edited for r in alike.collect())
