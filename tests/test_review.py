"""Hand-made cases of votes, alternatives, statistics of predictions, pages and folded states."""

from pyspark.sql import functions as F

from polyglossa.operators import review


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_alternatives_keep_order_and_skip_blanks(spark):
    book = spark.createDataFrame([(3, "A ", "x"), (1, "a", "y"), (2, "a", " "), (4, "a", "x"), (5, "b", None)], "id long, text string, target string")
    assert rows(review.tm_alternatives(book), "variant", "target", "nth") == [("a", "x", 2)]


def test_mt_stats(spark):
    made = spark.createDataFrame([("s", "r", "r"), ("s", "r", "s"), ("s", "r", None), ("s", "r", "s ")], "source string, reference string, prediction string")
    assert rows(review.mt_stats(made), "n", "exact", "empty", "copied", "mean_chars", "repeated") == [(4, 0.25, 0.25, 0.5, 0.75, 0.5)]
    assert rows(review.mt_stats(made.limit(0)), "n", "exact", "repeated") == [(0, 0.0, 0.0)]


def test_pages_stay_between_first_and_last(spark):
    own = spark.range(1, 8).select(F.lit(1).alias("job"), F.col("id").cast("int").alias("segment_index"))
    assert rows(review.segment_page(own, 9, 3), "segment_index", "page") == [(7, 3)]
    assert rows(review.segment_page(own, -1, 3), "segment_index") == [(1,), (2,), (3,)]


def test_final_state_stays(spark):
    seen = spark.createDataFrame([(1, "done", 1, 1), (1, "failed", 2, 2), (2, "run", 1, 3), (2, "wait", 1, 4)], "job long, status string, ts int, event_id long")
    assert rows(review.fold_status(seen, "done"), "job", "status") == [(1, "done"), (2, "wait")]


def test_best_mode_ignores_null_rates(spark):
    rates = spark.createDataFrame([(3, 0.2), (3, None), (4, 0.1), (6, None)], "mode int, cer double")
    assert rows(review.mode_compare(rates), "mode", "mean_cer", "best") == [(3, 0.2, False), (4, 0.1, True), (6, None, False)]
