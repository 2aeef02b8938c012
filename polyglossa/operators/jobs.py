"""Job, segment and event reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


ACTIVE = ("queued", "processing", "retrying")


def _mean(c: str):
    """Mean of values that are not null, of four places each, so that it does not hang on their order; an aggregate."""
    return F.try_divide(F.sum(F.round(F.col(c) * 10000).cast("long")), F.count(c)) / 10000.0


def quality_summary(segments: DataFrame) -> DataFrame:
    """job, n_segments, n_review, confidence (mean, null without any), confidence_pct, has_review. segments: job, needs_review, confidence."""
    sums = segments.groupBy("job").agg(F.count("*").alias("n_segments"), F.count_if("needs_review").alias("n_review"), _mean("confidence").alias("confidence"))
    return sums.select("*", F.round(100 * F.col("confidence")).cast("int").alias("confidence_pct"), (F.col("n_review") > 0).alias("has_review"))


def recent_jobs(jobs: DataFrame, n: int = 5, active: tuple[str, ...] = ACTIVE) -> DataFrame:
    """owner, job, nth, is_active_job: the n latest jobs of each owner, and which of them is the latest active one. jobs: owner, job, created, status."""
    latest = Window.partitionBy("owner").orderBy(F.desc("created"), F.desc("job"))
    shown = jobs.withColumn("nth", F.row_number().over(latest)).filter(F.col("nth") <= n)
    first = F.min(F.when(F.col("status").isin(*active), F.col("nth"))).over(Window.partitionBy("owner"))
    return shown.select("owner", "job", "nth", F.col("nth").eqNullSafe(first).alias("is_active_job"))


def active_limit(jobs: DataFrame, active: tuple[str, ...], limit: int = 2) -> DataFrame:
    """Owners with at least `limit` jobs in one of the active statuses. jobs: owner, status."""
    return jobs.filter(F.col("status").isin(*active)).groupBy("owner").agg(F.count("*").alias("active")).filter(F.col("active") >= limit)


def event_summary(events: DataFrame) -> DataFrame:
    """Events by level, type and day."""
    level = F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level")
    return events.groupBy(level, "event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


def _before(as_of: str, minutes: int):
    return F.timestamp_add("MINUTE", F.lit(-minutes), F.lit(as_of).cast("timestamp_ntz"))


def job_health(jobs: DataFrame, as_of: str, minutes: int = 15) -> DataFrame:
    """Active jobs by status and those without an update for the given minutes. jobs: status, updated."""
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ACTIVE), F.count_if(F.col("status").isin(*ACTIVE) & (F.col("updated") <= _before(as_of, minutes))).alias("stale"))


def _is_stale(as_of: str, minutes: int):
    return F.col("status").isin(*ACTIVE) & ~F.col("is_deleted") & (F.col("updated") <= _before(as_of, max(1, minutes)))


def stale_jobs(jobs: DataFrame, as_of: str, minutes: int = 15, retry_queued: bool = False) -> DataFrame:
    """job, owner, status, action for active jobs, not deleted, without an update for the given minutes."""
    retry = F.lit(retry_queued) & F.col("status").isin("queued", "retrying")
    return jobs.filter(_is_stale(as_of, minutes)).select("job", "owner", "status", F.when(retry, "retry").otherwise("fail").alias("action"))


#: What a recovery writes.
RECOVERY_EVENT = "translation_job_stale_recovery"
ABANDONED = "Translation job was abandoned before completion and was marked failed by stale-job recovery."
RETRIED = "This job was abandoned and has been queued for retry."


def recovery_events(jobs: DataFrame, as_of: str, minutes: int = 15, retry_queued: bool = False, dry_run: bool = False) -> DataFrame:
    """job, actor, level, event_type, message, action, previous_status: one warning for each stale job; a dry run says so."""
    message = F.concat(F.lit("Dry run: would " if dry_run else ""), "action", F.lit(f" stale translation job after {max(1, minutes)} minute(s)."))
    return stale_jobs(jobs, as_of, minutes, retry_queued).select(
        "job", F.col("owner").alias("actor"), F.lit("warning").alias("level"), F.lit(RECOVERY_EVENT).alias("event_type"), message.alias("message"), "action", F.col("status").alias("previous_status")
    )


def recovered_jobs(jobs: DataFrame, as_of: str, minutes: int = 15, retry_queued: bool = False) -> DataFrame:
    """job, owner, status, updated, is_deleted, message, progress, finished of all jobs after a recovery: stale ones retried or failed, others as they were.

    One pass, no join: whether a job is stale stands in its row.
    """
    stale = _is_stale(as_of, minutes)
    retry = stale & F.lit(retry_queued) & F.col("status").isin("queued", "retrying")
    now = F.lit(as_of).cast("timestamp_ntz")
    return jobs.select(
        "job", "owner", F.when(retry, "retrying").when(stale, "failed").otherwise(F.col("status")).alias("status"), F.when(stale, now).otherwise(F.col("updated").cast("timestamp_ntz")).alias("updated"),
        "is_deleted", F.when(retry, RETRIED).when(stale, ABANDONED).alias("message"), F.when(retry, 0).alias("progress"), F.when(stale & ~retry, now).alias("finished"),
    )


def taking_longer(jobs: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """Active jobs made at least the given minutes ago."""
    return jobs.filter(F.col("status").isin(*ACTIVE) & (F.col("created") <= _before(as_of, minutes))).select("job", "owner")


def job_dashboard(jobs: DataFrame, segments: DataFrame, pages: DataFrame, ocr: DataFrame, outputs: DataFrame) -> DataFrame:
    """job, status, n_segments, n_review, min_confidence, mean_confidence, ocr_confidence, n_pages, n_outputs of every job.

    Each child table is summed by job before the join, so that none multiplies another. segments: job, needs_review, confidence; pages:
    job, page; ocr: job, confidence; outputs: job.
    """
    none, out = F.lit(0).cast("long"), jobs.select("job", "status")
    children = (
        segments.groupBy("job").agg(F.count("*").alias("n_segments"), F.count_if("needs_review").alias("n_review"), F.min("confidence").alias("min_confidence"), _mean("confidence").alias("mean_confidence")),
        ocr.groupBy("job").agg(_mean("confidence").alias("ocr_confidence")),
        pages.groupBy("job").agg(F.count_distinct("page").alias("n_pages")),
        outputs.groupBy("job").agg(F.count("*").alias("n_outputs")),
    )
    for child in children:
        out = out.join(child, "job", "left")
    return out.select(*(F.coalesce(c, none).alias(c) if c.startswith("n_") else c for c in out.columns))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with n: the violations of a uniqueness rule."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def event_windows(events: DataFrame) -> DataFrame:
    """Events of each type by hour."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def event_sessions(events: DataFrame, gap_s: int = 3600) -> DataFrame:
    """user_id, session, n: a user's events with no longer gap between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.coalesce(F.timestamp_diff("SECOND", F.lag("ts").over(order), F.col("ts")) > gap_s, F.lit(True))
    numbered = events.withColumn("apart", apart.cast("int")).withColumn("session", F.sum("apart").over(order))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"))


def violations(tables: list[tuple[DataFrame, dict[str, tuple[str, ...]], dict[str, str]]]) -> DataFrame:
    """rule, key, n: values that stand more than once though a rule says they are unique, and rows that break a check.

    tables: (rows, unique, checks): unique names columns by rule, checks a condition that must hold. Each table is read once, whatever
    the number of its rules; nulls make no duplicate and break no check, as in a database.
    """
    found = []
    for rows, unique, checks in tables:
        text = lambda c: F.col(c).cast("string")
        marks = [F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)), F.struct(F.lit(rule).alias("rule"), F.concat_ws("\x1f", *map(text, columns)).alias("key"), F.lit(1).alias("most"))) for rule, columns in unique.items()]
        marks += [F.when(~F.expr(check), F.struct(F.lit(rule).alias("rule"), F.lit(check).alias("key"), F.lit(0).alias("most"))) for rule, check in checks.items()]
        # outer, as Spark infers filters from other generators, which compute the marks once more each
        found.append(rows.select(F.inline_outer(F.array_compact(F.array(*marks)))).filter("rule is not null"))
    each = reduce(DataFrame.union, found).groupBy("key", "rule", "most").agg(F.count("*").alias("n"))
    return each.filter(F.col("n") > F.col("most")).select("rule", "key", "n")
