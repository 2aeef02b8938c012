"""The cascade on hand-made cases, its two ways for small and large models, documents, phrases, and joins with a hot key."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from polyglossa.operators import language, retention, skew, tm

KEYS = ["doc_id", "line_no"]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def models(spark):
    said = [("en", "the cat sat on the mat with the other things " * 20), ("fr", "le chat est dans la maison avec les autres choses " * 20), ("de", None)]
    profiles = retention.train_profiles(spark.createDataFrame(said, "lang string, text string")).cache()
    vocab = spark.createDataFrame([("gato",), ("negro",), (None,), ("gato",)], "token string")
    return {"vocab": vocab, "profiles": profiles, "dictionary": "es"}


@pytest.fixture(scope="module")
def lines(spark):
    texts = ["gato negro", "gato the cat", "the other cat", "la maison", None, " ​ ", "1234 ??", "gato negro uno dos tres", "x" * 3000 + " le chat", "漢字 the"]
    return spark.createDataFrame([(1 + i // 4, i, t, "kept") for i, t in enumerate(texts)], "doc_id long, line_no int, text string, own2 string").repartition(3)


def test_cascade(lines, models):
    got = {r.line_no: (r.found, r.confidence, r.method, r.alternatives) for r in language.detect(lines, KEYS, **models).collect()}
    assert got[0] == ("es", 1.0, "dictionary", "") and got[1] == ("es", 0.5, "dictionary", "")
    assert got[7] == ("es", pytest.approx(0.6), "dictionary", "")
    assert got[2][::2] == ("en", "statistical") and got[2][1] > 0.9 and got[3][::2] == ("fr", "statistical")
    assert got[2][3].split("|")[0].startswith(("fr:", "de:"))
    assert all(got[k] == ("en", 0.0, "fallback", "") for k in (4, 5, 6))
    assert {got[9][0], got[8][2]} == {"en", "statistical"}


def test_large_models_give_the_same(lines, models, monkeypatch):
    small = rows(language.detect(lines, KEYS, **models), *KEYS, "found", "confidence", "method", "alternatives", "own2")
    assert small == rows(language.detect(lines, KEYS, **models, most_tokens=0, most_grams=0), *KEYS, "found", "confidence", "method", "alternatives", "own2")
    monkeypatch.setattr(language, "STEP", 7)
    assert small == rows(language.detect(lines, KEYS, **models), *KEYS, "found", "confidence", "method", "alternatives", "own2")
    only = rows(language.detect(lines, KEYS, **models, supported=("fr",)), "line_no", "found", "confidence", "method")
    assert (2, "en", 0.3, "fallback") in only and any(r[1] == "fr" for r in only)


def test_no_models(spark, lines, models):
    none = {"vocab": models["vocab"].limit(0), "profiles": models["profiles"].limit(0), "dictionary": "es"}
    assert {r[1:] for r in rows(language.detect(lines, KEYS, **none), "line_no", "found", "confidence", "method")} == {("en", 0.0, "fallback")}
    assert not language.detect(lines.limit(0), KEYS, **models).count()


def test_votes(spark):
    votes = spark.createDataFrame([(1, 0, "fr", 0.9), (1, 1, "en", 0.9), (2, 0, "fr", 0.3), (3, 0, "de", 1.0), (3, 1, "de", 1.0), (3, 2, "fr", 0.4)], "doc_id long, line_no int, found string, confidence double")
    got = rows(language.doc_language(votes), "doc_id", "language", "confidence", "mixed", "distribution")
    assert got == [(1, "fr", 0.5, True, "fr:1|en:1"), (2, "en", 0.0, True, ""), (3, "de", 1.0, False, "de:2")]
    assert language.doc_language(votes.limit(0)).count() == 0


def test_first_pages_only(spark, models):
    """Later pages don't vote; a language by hand needs no line; a document without lines has the fallback."""
    pages = [(1, p, 10 * p + k, "la maison est dans la maison" if p < 3 else "the other cat and the mat") for p in range(9) for k in range(2)]
    lines = spark.createDataFrame([*pages, (2, 0, 0, "the cat")], "doc_id long, page int, line_no int, text string")
    docs = spark.createDataFrame([(1, None), (2, "de"), (3, None)], "doc_id long, manual string")
    got = rows(language.auto_source(docs, lines, partial(language.detect, keys=KEYS, **models)), "doc_id", "language", "confidence", "mixed", "distribution", "chosen")
    assert got == [(1, "fr", 1.0, False, "fr:6", "auto"), (2, "de", 1.0, False, "", "manual"), (3, "en", 0.0, False, "", "auto")]


def test_phrases(spark, models):
    memory = spark.createDataFrame([(1, "The other cat", "isa pa", None)], "row_pos int, english string, filipino string, cebuano string")
    index = tm.tm_index(memory, ("english", "filipino", "cebuano"), ("english",))
    asked = [(1, " the other​ cat!", "auto", "filipino"), (2, "the other cat", "french", "filipino"), (3, "la maison", "auto", "filipino"), (4, None, "auto", "cebuano"), (5, "The Other Cat", "english", "filipino")]
    phrases = spark.createDataFrame(asked, "id int, text string, src_lang string, tgt_lang string")
    got = {r.id: r for r in language.quick_translate(phrases, ["id"], partial(language.detect, keys=["id"], **models), index).collect()}
    assert got[1].translated.lower() == "isa pa" and got[1].source_language == "english" and got[1].method == "normalized_phrase" and got[1].detection_confidence > 0.9
    assert got[2].detection_confidence is None and got[2].needs_review and got[2].source_language == "french"
    assert got[3].needs_review and got[3].detection_confidence > 0.9 and got[4].translated == "" and got[4].detection_confidence == 0
    assert got[5].method == "exact_phrase" and got[5].detection_confidence is None


def test_hot_key_is_spread(spark):
    """Half of all rows share a key: without spreading they meet in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        n = 20_000
        left = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"))
        right = spark.createDataFrame([("hot", 1), (None, 2), ("11", 3)], "k string, v int")
        assert len(skew.heavy_keys(left, "k")) == 2  # and the null
        joined = skew.spread_join(left, right, ["k"])
        assert rows(joined, "id", "k", "v") == rows(left.join(right, "k", "left"), "id", "k", "v")
        sizes = [r[0] for r in joined.filter("v = 1").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 4 and max(sizes) < 0.5 * n / 2, sizes
        assert rows(skew.spread_join(left, right, ["k"], "inner"), "id", "v") == rows(left.join(right, "k"), "id", "v")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
