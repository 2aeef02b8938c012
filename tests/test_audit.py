"""Audits by the keys that count: case, outer blanks, null and blank; the report against the single audits and in one scan."""

import pytest

from polyglossa.operators import audit

ROWS = [
    (1, "Go", "Madigar", "x", "y", "t", "s", None), (2, "go ", "madigar ", "X", "Y", "t ", "s", "Plural"), (3, "Come", "MADIGAR", "x", None, "", None, "manual check, plural"),
    (4, "a\x7fb", "", "x", "", None, "", "auto-split"), (5, None, " ", "x", None, None, "", None), (6, "one", "a b c d e f g", "<B>", "two  blanks", "t", "s", None), (7, "�", "\t", "&amp;", "z", "t", "s", None),
]


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame(ROWS, "id long, english string, tagabawa string, filipino string, cebuano string, topic string, source string, notes string").repartition(3)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_keys(book):
    assert rows(audit.audit_dups(book), "groups", "extra_rows") == [(1, 1)]
    assert rows(audit.audit_polysemy(book), "source", "n_variants", "variants") == [("madigar", 2, "come|go")]
    assert dict(rows(audit.audit_field_dups(book), "lang", "extra_rows")) == {"english": 1, "tagabawa": 4, "filipino": 4, "cebuano": 3}
    cells = book.selectExpr("english AS text").union(book.selectExpr("filipino")).union(book.selectExpr("cebuano"))
    assert rows(audit.audit_unicode(cells), *audit.ISSUES) == [(1, 1, 2, 1)]
    assert rows(audit.audit_unicode_rows(book), "id", "lang", "issues") == [(4, "english", "control"), (6, "cebuano", "double_space"), (6, "filipino", "html"), (7, "english", "replacement"), (7, "filipino", "html")]
    assert ("notes", "plural_note", 2) in rows(audit.audit_sources(book), "kind", "value", "n") and ("topic", "t", 4) in rows(audit.audit_sources(book), "kind", "value", "n")


def test_leaks(book):
    left, right = book.filter("id IN (1, 4, 6)"), book.filter("id IN (2, 5)")
    assert rows(audit.audit_cross_leak(left, right, "english"), "n_left", "n_shared", "n_left_only", "subset") == [(3, 1, 2, False)]
    assert rows(audit.audit_left_only(left, right, "english"), "key") == [("a\x7fb",), ("one",)]
    assert rows(audit.audit_cross_leak(left.limit(0), right, "english"), "n_left", "subset") == [(0, True)]


def test_report(book):
    found = {(r.section, r.metric): r.n for r in audit.audit_report(book, "id > 5").collect()}
    assert found["counts", "total"] == 7 and found["counts", "complete"] + found["counts", "missing_any"] == 7 and found["counts", "flagged"] == 2
    assert found["same_row", "groups"] == 1 and found["same_row", "extra_rows"] == 1 and found["same_tagabawa", "extra_rows"] == 4 and found["polysemy", "groups"] == 1
    assert found["unicode", "control"] == 1 and found["unicode", "html"] == 2 and found["alignment", "outliers"] == 1
    assert found["notes", "plural_note"] == 2 and found["coverage", "cebuano"] + found["coverage", "missing_cebuano"] == 7
    assert sum(n for (s, m), n in found.items() if s == "types") == 28
    assert not audit.audit_report(book.limit(0), "id > 5").count()


def test_one_scan(spark, tmp_path, book):
    book.write.parquet(str(tmp_path / "book"))
    plan = audit.audit_report(spark.read.parquet(str(tmp_path / "book")), "id > 5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
