"""Shared steps at size: rows dealt evenly, texts read once, words put together before the shuffle."""

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyglossa.operators import layout, retention, skew, tm


def test_rows_of_few_files_are_dealt(spark):
    rows = spark.range(0, 25_000, 1, 1)
    assert skew.evenly(rows).rdd.getNumPartitions() == 4
    assert skew.evenly(rows, 5_000).rdd.getNumPartitions() == 5
    assert skew.evenly(rows.limit(0)).rdd.getNumPartitions() == 1


def test_forms_of_a_text(spark):
    rows = spark.createDataFrame([(1, " Ñandú! "), (2, "plain"), (3, None), (4, "?!"), (5, "Ab-c")], "id long, t string").coalesce(1)
    found = {(r.id, r.nth, r.variant) for r in tm._variants(rows, "t").collect()}
    assert found == {(1, 0, "ñandú!"), (1, 1, "ñandú"), (1, 2, "nandu"), (2, 0, "plain"), (4, 0, "?!"), (5, 0, "ab-c")}


@pytest.mark.parametrize("n", [1, 3])
def test_grams_are_counted_in_the_task(spark, n):
    said = [("x", "aba aba"), ("x", ""), ("y", "\U0001f600\U0001f600 b"), ("y", None), ("x", "ab"), ("z", "a\n\tb")]
    counts = retention._gram_counts(spark.createDataFrame(said, "lang string, text string"), n)
    want = Counter((lang, t[k : k + n]) for lang, s in said for t in [" " + " ".join((s or "").replace("\n", " ").replace("\t", " ").split(" ")).replace("  ", " ") + " "] for k in range(len(t) - n + 1))
    assert {(r.lang, r.gram): r.c for r in counts.collect()} == dict(want)
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_put_together_before_the_shuffle(spark):
    words = [(1, 0, i, w, 10 * i, 5, 50) for i, w in enumerate("one two three four".split())]
    words += [(1, 1, 2, "c", 0, 1, 10), (1, 1, 0, "a", 3, 1, 20), (1, 1, 1, "b\0b", 9, 4, 30), (1, 1, 0, "A", 1, 1, 40), (2, 0, 0, "x", None, 1, 5), (2, 0, 1, "y", 7, 1, 7), (2, 1, 0, "z", 1, 1, -1)]
    rows = spark.createDataFrame(words, "doc_id long, line int, i int, word string, left int, width int, conf int").coalesce(1)
    kept = rows.filter("conf >= 0").withColumn("right", F.col("left") + F.col("width"))
    assert layout._stretches(kept.filter("doc_id = 1 and line = 0"), ["doc_id", "line"], ["left"], ["right"]).count() == 1
    got = {(r.doc_id, r.line): (r.text, r.x0, r.x1, r.n_words, r.confidence) for r in layout.ocr_lines(rows).collect()}
    assert got == {
        (1, 0): ("one two three four", 0, 35, 4, 0.5), (1, 1): ("A a b\0b c", 0, 13, 4, 0.25), (2, 0): ("x y", 7, 8, 2, 0.06),
    }


def test_forms_of_a_text_share_its_bucket(spark):
    points = spark.createDataFrame(pd.DataFrame({"c": [chr(k) for k in range(1, 0x20000) if not 0xD800 <= k < 0xE000]})).repartition(4)
    texts = points.select(F.explode(F.array("c", F.concat(F.lit("a"), "c", F.lit("-É "), "c"))).alias("t"))
    own = tm._bucketed(texts, "t").select("t", F.col("_bucket").alias("own"))
    # as a text, the form is lowered and stripped: forms that this changes are last ones, which no raw text equals
    again = tm._bucketed(tm._variants(texts, "t").filter("variant = lower(trim(variant))").select("t", "variant"), "variant")
    assert again.count() > 100_000 and own.join(again, "t").filter(~F.col("own").eqNullSafe(F.col("_bucket"))).isEmpty()


def _lookups(spark):
    langs = ("english", "filipino", "cebuano")
    texts = ["Été", "ete!", "été", "ETE", "...", "..", "a b", "A  b?", "a b", "x\u037a y", "x  z", "plain", None, " ", "no target", "only fil"]
    memory = [(f"{k:02}" if t != "a b" else "90", t, None if t == "no target" else f"T:{t}", None if t in ("no target", "only fil") else f"C:{t}") for k, t in enumerate(texts)]
    asked = [(t, s, g) for t in ("été", "ete", "ÉTÉ?", "Ete", "...", "....", "a  b", " A b ", "x  y", "x\u037a z", "PLAIN!", "absent", "no target", "Only fil.", "", None) for s in ("english", "fr", None) for g in (*langs, "other", None)]
    queries = spark.createDataFrame([(k, *a) for k, a in enumerate(asked + 40 * [("a b!", "english", "cebuano")])], "id int, text string, src_lang string, tgt_lang string")
    return queries, spark.createDataFrame(memory, "row_pos string, english string, filipino string, cebuano string"), langs


@pytest.mark.parametrize("heavy", [None, [], "all"])
def test_lookup_without_an_index(spark, heavy):
    queries, memory, langs = _lookups(spark)
    frequent = [r[0] for r in queries.select(F.xxhash64("text")).distinct().collect()] if heavy == "all" else heavy
    for sources in (("english",), None):
        want = tm.tm_lookup(queries, tm.tm_index(memory.dropDuplicates(["row_pos"]), langs, sources))
        got = tm.memory_lookup(queries, memory.union(memory), langs, sources, frequent)
        assert got.schema == want.schema and got.count() == want.count() and got.exceptAll(want).isEmpty()
        assert want.filter("method = 'normalized_phrase'").count() > 5


def test_lookup_shuffles_each_text_once(spark):
    queries, memory, langs = _lookups(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = tm.memory_lookup(queries, memory, langs, ("english",), [])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2, plan
