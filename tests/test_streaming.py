"""Streams over files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from polyglossa.operators import retention, review
from polyglossa.operators.tm import tm_index, tm_lookup
from polyglossa.sources import views
from polyglossa.streaming import events

SF = "/root/testdata/sf0.001"


def _stream(spark, df, path, files=1):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.parquet(out)


@pytest.fixture
def log(spark):
    rows = views.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", "ts", "user_id", "event_type", F.concat_ws(":", "event_type", "user_id").alias("message"))


def test_windows(spark, log, tmp_path):
    got = _run(events.windowed_counts(_stream(spark, log, tmp_path / "in"), "1 day", delay="1 hour"), tmp_path)
    closed = {(r["start"], r["event_type"]): r["n"] for r in got.collect()}
    want = {(r["s"], r["event_type"]): r["n"] for r in log.groupBy(F.window("ts", "1 day")["start"].alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert closed and all(want[k] == n for k, n in closed.items())


def test_repeated_delivery(spark, log, tmp_path):
    twice = log.union(log).select("event_id", "ts", "user_id", "event_type", F.lit("m").alias("message"))
    got = _run(events.event_dedup_stream(_stream(spark, twice, tmp_path / "in"), "60 days", keys=("event_id",)), tmp_path)
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in log.select("event_id").collect())


def test_translation(spark, tmp_path):
    lines, index = views.queries(spark, SF), tm_index(views.memory(spark, SF), ("english", "filipino", "cebuano"), ("english",)).cache()
    events.translate_stream(_stream(spark, lines, tmp_path / "in", 2), index, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = tm_lookup(lines, index)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_sessions_and_slides(spark, log, tmp_path):
    for k, (size, slide, gap) in enumerate((("1 day", "6 hours", None), ("1 day", None, "3 hours"))):
        span = F.session_window("ts", gap) if gap else F.window("ts", size, slide)
        want = {(r["s"], r["e"], r["event_type"]): r["n"] for r in log.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("s"), F.col("w.end").alias("e"), "event_type", "n").collect()}
        got = _run(events.windowed_counts(_stream(spark, log, tmp_path / f"in{k}"), size, slide, gap), tmp_path / f"run{k}").collect()
        assert got and all(want[r["start"], r["end"], r["event_type"]] == r["n"] for r in got)


@pytest.fixture
def rocks(spark):
    spark.conf.set(*events.ROCKSDB)
    yield
    spark.conf.unset(events.ROCKSDB[0])


def test_quota(spark, tmp_path, rocks):
    """Five admitted, a sixth within an hour of the fifth refused, one an hour after it admitted; over several files, against the batch form."""
    rows = [(1, k, 60.0 * k) for k in range(5)] + [(1, 5, 500.0), (1, 6, 240.0 + 3_599), (1, 7, 240.0 + 3_600), (2, 8, 10.0)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, seconds double")
    batch = {r.event_id: r.admitted for r in retention.upload_quota(df).collect()}
    assert batch == {**{k: True for k in range(5)}, 5: False, 6: False, 7: True, 8: True}
    stamped = df.select("user_id", "event_id", (F.col("seconds") + 1e6).cast("timestamp").alias("ts"))
    got = _run(events.upload_quota_stream(_stream(spark, stamped.coalesce(1), tmp_path / "in")), tmp_path)
    assert {r.event_id: r.admitted for r in got.collect()} == batch
    assert not retention.upload_quota(df.limit(0)).count()


def test_stale_alerts(spark, tmp_path, rocks):
    """A job that goes quiet is told once; a finished one and one with a late old update are not told wrongly."""
    first = [("a", "processing", 0), ("b", "processing", 0), ("b", "completed", 60), ("c", "queued", 0)]
    later = [("c", "processing", 1_200), ("c", "queued", 30), ("d", "completed", 7_200)]
    path = tmp_path / "in"
    for rows in (first, later, [("e", "completed", 9_000)]):
        spark.createDataFrame(rows, "job string, status string, s long").select("job", "status", (F.col("s") + 1_000_000).cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema("job string, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path))
    got = _run(events.stale_alerts(stream, 15, ("queued", "processing")), tmp_path)
    assert sorted((r.job, r.status) for r in got.collect()) == [("a", "processing"), ("c", "processing")]


def test_alerts_after_restart(spark, tmp_path, rocks):
    """Each batch in a query of its own over one checkpoint: timers go on, repeated and late updates tell nothing twice, a new one arms again."""
    path, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    batches = [
        [("a", "queued", 0), ("a", "queued", 0), ("b", "queued", 0)],
        [("b", "processing", 600), ("x", "completed", 600)],
        [("x", "completed", 1_600)],  # watermark 1,000: a is stale since 900
        [("a", "queued", 1_500), ("a", "queued", 200), ("x", "completed", 2_600)],  # a comes again, and late; b is stale since 1,500
        [("x", "completed", 9_000)],
        [("x", "completed", 9_001)],
    ]
    for rows in batches:
        made = spark.createDataFrame(rows, "job string, status string, s long").select("job", "status", (F.col("s") + 1_000_000).cast("timestamp").alias("ts"))
        made.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("job string, status string, ts timestamp").parquet(path)
        alerts = events.stale_alerts(stream, 15, ("queued", "processing"))
        alerts.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((r.job, r.status, int(r.last.timestamp()) - 1_000_000) for r in spark.read.parquet(out).collect())
    assert got == [("a", "queued", 0), ("a", "queued", 1_500), ("b", "processing", 600)]


def test_folded_states(spark, log, tmp_path):
    updates = log.select(F.col("user_id").cast("string").alias("job"), F.col("event_type").alias("status"), "ts", "event_id")
    twice = events.fold_job_state(_stream(spark, updates, tmp_path / "in", 2), "purchase").writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).start()
    twice.awaitTermination()
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, review.fold_status(updates, "purchase").collect()))


def test_ingest(spark, tmp_path):
    rows = [("1", "a", "b"), ("", "a", "b"), ("2", " ", "b"), ("3", "a", None), ("4", "a", "a "), ("5", "a", "\ufffd"), (None, None, None)]
    df = spark.createDataFrame(rows, "record_id string, source_text string, target_text string")
    events.ingest_stream(_stream(spark, df, tmp_path / "in"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ckpt")).awaitTermination()
    assert [r.record_id for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["1"]
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["blank source", "blank target", "copy", "no id", "no id", "replacement character"]
