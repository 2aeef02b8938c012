"""Imports, recoveries and rules on hand-made cases, and counts taken as rows pass."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from polyglossa.operators import jobs, pairs, progress, tm

TEXT = "english string, tagabawa string, filipino string, cebuano string, topic string, source string, notes string"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_merge(spark):
    """The first of a new key creates, the last gives the values; a known key is updated; a key that two entries have fails; blank rows are skipped."""
    old = spark.createDataFrame([("a", "", "", None, "t", "s", "old", False), ("b", "", "", "", "t", "s", "one", False), ("b", "", "", "", "t", "s", "two", False), ("z", "", "", "", "t", "s", "", True)], TEXT + ", needs_review boolean")
    batch = [(1, "n", "", "", "", "t1", "", ""), (2, "a", None, "", "", "t2", "", "first"), (3, " n ", "", "", "", "t3", None, "Double check"), (4, "b", "", "", "", "t", "s", "x"), (5, " ", None, "", "", "t", "s", "x"), (6, "a", "", "", "", "t6", "own", None), (7, "b", "", "", "", "t", "s", "y")]
    batch = spark.createDataFrame(batch, "row int, " + TEXT).repartition(3)
    seen = Observation()
    got = rows(progress.merge_progress(pairs.phrasebook_merge(old, batch), seen), "english", "topic", "source", "notes", "needs_review", "outcome", "n")
    assert got == sorted([
        ("a", "t6", "own", "", False, "updated", 2), ("b", "t", "s", "one", False, "kept", 0), ("b", "t", "s", "two", False, "kept", 0), ("z", "t", "s", "", True, "kept", 0),
        ("n", "t3", "phrasebook", "Double check", True, "created", 2), ("b", "t", "s", "x", False, "failed", 1), ("b", "t", "s", "y", False, "failed", 1),
    ], key=repr)
    assert seen.get == {"rows": 7, "kept": 3, "created": 1, "updated": 1, "failed": 2}
    plain = rows(pairs.phrasebook_merge(old, batch, update=False), "outcome")
    assert plain == [("created",)] * 6 + [("kept",)] * 4
    assert rows(pairs.phrasebook_merge(old.limit(0), batch.limit(0)), "outcome") == []


def test_recovery(spark):
    made = [(1, "queued", "2020-01-01 00:00:00", False), (2, "processing", "2020-01-01 00:45:00", False), (3, "processing", "2020-01-01 00:46:00", False), (4, "queued", "2020-01-01 00:00:00", True), (5, "failed", "2020-01-01 00:00:00", False)]
    df = spark.createDataFrame(made, "job int, status string, updated string, is_deleted boolean").withColumn("updated", F.col("updated").cast("timestamp_ntz")).withColumn("owner", F.lit(9))
    now = "2020-01-01 01:00:00"
    assert rows(jobs.recovery_events(df, now, retry_queued=True), "job", "actor", "message", "previous_status") == [
        (1, 9, "retry stale translation job after 15 minute(s).", "queued"), (2, 9, "fail stale translation job after 15 minute(s).", "processing")
    ]
    after = {r.job: r for r in jobs.recovered_jobs(df, now, retry_queued=True).collect()}
    assert [after[k].status for k in range(1, 6)] == ["retrying", "failed", "processing", "queued", "failed"]
    assert after[1].progress == 0 and after[1].finished is None and str(after[2].finished) == now and after[3].message is None and str(after[3].updated) == "2020-01-01 00:46:00"
    assert {r.status for r in jobs.recovered_jobs(df, now).collect() if r.job == 1} == {"failed"}


def test_rules(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, None, "x"), (1, None, "x")], "job int, page int, kind string")
    b = spark.createDataFrame([("en", "en"), ("en", "fr"), ("en", None)], "src string, tgt string")
    got = rows(jobs.violations([(a, {"page": ("job", "page"), "whole": ("job", "page", "kind"), "kind": ("kind",)}, {}), (b, {}, {"differ": "src <> tgt"})]), "rule", "key", "n")
    assert got == [("differ", "src <> tgt", 1), ("kind", "x", 3), ("page", "1\x1f1", 2)]


def test_progress(spark, tmp_path):
    """Rows found, missed and rejected, from one action of a batch and from all triggers of a stream."""
    memory = spark.createDataFrame([(1, "hello", "kumusta", None)], "row_pos int, english string, filipino string, cebuano string")
    index = tm.tm_index(memory, ("english", "filipino", "cebuano"), ("english",))
    asked = spark.createDataFrame([("Hello", "english"), ("hello", "english"), ("what", "english"), ("x", "filipino")], "text string, src_lang string").withColumn("tgt_lang", F.lit("filipino"))
    seen = Observation()
    progress.lookup_progress(tm.tm_lookup(asked, index), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 4, "found": 2, "missed": 1, "identity": 1}
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    listener = progress.Progress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        told = progress.watched(stream, "asked", rejected=F.length("text") < 2)
        told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals["asked"] == {"rows": 4, "rejected": 1}
