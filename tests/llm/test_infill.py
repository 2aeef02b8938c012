"""Fill-in-middle against a plain version and SQL: markers, nulls, empty and long texts, other units."""

import hashlib

import duckdb
import pytest
import regex

from polyglossa.llm import infill

TEXTS = [None, "", "x", "a<P>b", "<S>", "<<M>", "ends with <", "é́ 🤦🏼‍♂️ \x00\r\n z", "two words", "two words", *(f"text {k} of some length\nand lines" for k in range(150)), "long é " * 40_000]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(i, text):
    text = text or ""
    h = [int(digest(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, digest(text), digest(text)
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(text), form, a, b - a, digest(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), digest(text)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 9 else i, t, "h", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[20]], "doc_id long, text string, form string, n int").repartition(3)


def test_digests(docs):
    found = infill.fill_digest(docs).collect()
    wanted = [(r.doc_id, *plain_version(r.doc_id, r.text)) for r in docs.collect()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert not infill.fill_digest(docs.limit(0)).count()


def test_sql(spark, docs):
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    wanted = duckdb.sql(infill.SQL).fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in infill.fill_digest(docs).collect())


def test_blocks_and_units(docs):
    whole, blocks = (infill.fill_documents(docs, block=b).collect() for b in (1 << 20, 7))
    assert sorted(map(str, whole)) == sorted(map(str, blocks))
    words = {r.doc_id: r for r in infill.fill_documents(docs, unit=r"\s*\S+\s*").collect()}
    assert words[8].n == 2 and words[1].n == 0 and words[2].n == 1
    moved = [r for i, r in words.items() if i is not None and r.form != "plain"]
    for r in moved:
        ends = [0, *(m.end() for m in regex.finditer(r"\s*\S+\s*", TEXTS[r.doc_id]))]
        assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= set(ends) and r.n == len(ends) - 1
    assert moved


def test_not_covered():
    assert infill.rearrange(regex.compile("(a)*"), "ab", (1, 2, 3, 4), 90, 20, None) == (None, "plain", None, None, "ab")
    assert infill.rearrange(regex.compile("(ab)*"), "ababab", (5, 2, 3, 40), 90, 20, None) == (3, "psm", 2, 2, "<P>ab<S>ab<M>ab")
