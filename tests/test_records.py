"""OCR lines with boxes, inventories, split records, reports and reviewers' actions on hand-made rows, empty tables too."""

import pytest

from polyglossa.operators import audit, layout, pages, pairs, review


def test_line_boxes(spark):
    schema = "doc_id long, block int, par int, line int, i int, word string, left int, top int, width int, height int, conf string"
    rows = [
        (1, 1, 1, 1, 1, "world ", 50, 12, 30, 10, "91.25"), (1, 1, 1, 1, 0, "Hello", 10, 10, 30, 12, "90"), (1, 1, 1, 1, 2, " ", 0, 0, 900, 900, "99"), (1, 1, 1, 1, 3, "lost", 0, 0, 900, 900, "-1"),
        (1, 1, 1, 1, 4, "lost", 0, 0, 900, 900, "x"), (1, 1, 1, 1, 5, "lost", 0, 0, 900, 900, None), (1, 1, 2, 1, 0, "apart", 0, 0, 2, 2, "250"), (1, 2, 1, 1, 0, "none", 0, 0, 2, 2, "-1"), (2, 1, 1, 1, 0, None, 0, 0, 2, 2, "5"),
    ]
    words = spark.createDataFrame(rows, schema).coalesce(1)
    got = sorted(tuple(r) for r in layout.ocr_line_boxes(words, dpi=144).collect())
    assert got == [(1, 1, 1, 1, "Hello world", 2, 5.0, 5.0, 40.0, 11.0, 0.9063), (1, 1, 2, 1, "apart", 1, 0.0, 0.0, 1.0, 1.0, 1.0)]
    assert not layout.ocr_line_boxes(words.limit(0)).count()


def test_document_summary(spark):
    sheets = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, page int")
    blocks = spark.createDataFrame([(1, "0.9"), (1, "0.59"), (1, "x"), (1, None), (2, None), (4, "0.1"), (3, "0.60004")], "doc_id long, confidence string")
    got = sorted(tuple(r) for r in layout.ocr_document_summary(sheets, blocks).collect())
    assert got == [(1, 0.745, 0.59, 1, 2, True, 2), (2, None, None, 0, 0, False, 1), (3, 0.6, 0.6, 0, 1, False, 1)]
    assert not layout.ocr_document_summary(sheets.limit(0), blocks).count()


def test_inventory(spark):
    sheets = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page int")
    schema = "doc_id long, page int, type string, rows int, columns int, cells int, items int"
    blocks = spark.createDataFrame([(1, 0, "table", 2, 3, 6, 9), (1, 0, "table", None, 1, None, None), (1, 0, "drawing", 7, 7, 7, 4), (1, 0, "text", None, None, None, None), (1, 0, "other", 1, 1, 1, 1), (1, 0, None, 1, 1, 1, 1)], schema)
    got = [r.asDict() for r in pages.page_inventory(sheets, blocks).orderBy("page").collect()]
    assert got[0] == {"doc_id": 1, "page": 0, "n_text": 1, "n_image": 0, "n_table": 2, "n_drawing": 1, "n_rows": 2, "n_columns": 4, "n_cells": 6, "n_items": 4}
    assert set(list(got[1].values())[2:]) == {0}


def test_checked_split(spark):
    rows = spark.createDataFrame([(f"r{i}",) for i in range(500)], "record_id string")
    split = pairs.checked_split(rows, seed=7, ratios=(60, 20, 20))
    (record,) = pairs.split_record(split, "record_id", "rows", 7, (60, 20, 20)).collect()
    assert (record.method, record.seed, record.leakage_safe, record.ratio_train, record.n_total, record.overlap) == ("rows", 7, False, 0.6, 500, 0)
    assert abs(record.n_train - 300) < 50 and record.n_train + record.n_dev + record.n_test == 500
    for bad in (rows.union(rows.limit(1)), spark.createDataFrame([(None,)], "record_id string")):
        with pytest.raises(ValueError, match="unique"):
            pairs.checked_split(bad)
    with pytest.raises(ValueError, match="test"):
        pairs.checked_split(rows, ratios=(90, 10, 0))
    (none,) = pairs.split_record(pairs.checked_split(rows.limit(0)), "record_id", "rows").collect()
    assert (none.n_train, none.n_total, none.overlap) == (0, 0, 0)


def test_training_report(spark):
    cols = "id long, english string, tagabawa string, filipino string, cebuano string, notes string, verified boolean"
    rows = spark.createDataFrame([
        (1, "a", "bë", "c", "d", "Manual check", True), (2, "a", " bë ", "c", "d", None, None), (3, "x", None, "�", " ", "auto-split from", False), (4, "q\x07", "r", "[UNKNOWN_FOR_REVIEW]", "s", "", False),
    ], cols)
    schema = "row_id long, source_lang string, target_lang string, source_text string, target_text string, split string"
    records = spark.createDataFrame([(1, "english", "cebuano", "a", "d", "train"), (2, "english", "cebuano", "A ", "d", "test"), (4, "english", "filipino", "q", "x UNKNOWN_FOR_REVIEW", None)], schema)
    got = {(r.section, r.metric): r.n for r in pairs.training_report(rows, records).collect()}
    assert got == {
        ("rows", "total"): 4, ("rows", "usable"): 2, ("rows", "skipped"): 2, ("rows", "repeated"): 1, ("missing", "english"): 0, ("missing", "tagabawa"): 1, ("missing", "filipino"): 0, ("missing", "cebuano"): 1,
        ("characters", "replacement"): 1, ("characters", "control"): 1, ("characters", "tagabawa_diacritics"): 2, ("review", "verified"): 1, ("review", "unverified"): 3, ("review", "marked"): 1,
        ("review", "auto_split"): 1, ("review", "unknown_records"): 1, ("directions", "english->cebuano"): 2, ("directions", "english->filipino"): 1, ("splits", "train"): 1, ("splits", "test"): 1,
        ("splits", "unsplit"): 1, ("splits", "leaking_pairs"): 1, ("split_rows", "train"): 1, ("split_rows", "test"): 1, ("split_rows", "unsplit"): 1,
    }
    none = {(r.section, r.metric): r.n for r in pairs.training_report(rows.limit(0), records.limit(0)).collect()}
    assert none[("rows", "total")] == 0 and none[("splits", "leaking_pairs")] == 0 and set(none.values()) == {0}


def test_actions_and_filters(spark):
    schema = "n int, kind string, action string, status string, needs_review boolean, verified boolean, approved boolean"
    rows = [(1, "phrase", "verify", None, True, False, False), (2, "segment", "clear", None, True, False, False), (3, "term", "approve", None, False, False, False), (4, "ocr_result", "accept", "pending_review", False, False, False), (5, "ocr_result", "reopen", "accepted", False, False, False), (6, "term", "verify", None, True, False, False), (7, None, None, "x", True, True, True), (8, "phrase", "mark", None, False, True, False)]
    got = {r.n: (r.status, r.needs_review, r.verified, r.approved) for r in review.apply_actions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, False, True, False), 2: (None, False, False, False), 3: (None, False, False, True), 4: ("accepted", False, False, False), 5: ("pending_review", False, False, False), 6: (None, True, False, False), 7: ("x", True, True, True), 8: (None, True, True, False)}
    results = spark.createDataFrame([(1, 0.59, None), (1, 0.1, []), (2, 0.6, ["w"]), (3, None, None), (4, 0.9, [])], "job long, confidence double, warnings array<string>")
    assert sorted(tuple(r) for r in review.ocr_filters(results).collect()) == [(1, True, False), (2, False, True)]


def test_history(spark):
    schema = "job long, owner long, filename string, upload string, status string, created int, is_deleted boolean"
    jobs = spark.createDataFrame([(1, 1, "A.pdf", None, "failed", 5, False), (2, 1, None, "a.PDF", "completed", 6, False), (3, 2, "a.pdf", "x", "completed", 5, False), (4, 1, "a.pdf", None, "completed", 9, True), (5, 2, "b%.txt", None, "queued", 5, False)], schema)
    ids = lambda *a: [r.job for r in review.owned_history(jobs, *a).collect()]
    assert ids(None) == [2, 5, 3, 1] and ids(1) == [2, 1] and ids(None, " A.P") == [2, 3, 1] and ids(2, "", " Completed") == [3] and ids(None, "", "gone") == [2, 5, 3, 1] and ids(None, "%") == [5]


def test_topics(spark):
    book = spark.createDataFrame([("b ",), ("b",), ("a",), ("c",), ("c",), (None,), (" ",)], "topic string")
    assert [tuple(r) for r in audit.top_topics(book, 2).orderBy("nth").collect()] == [(1, "b", 2), (2, "c", 2)] and not audit.top_topics(book.limit(0)).count()
