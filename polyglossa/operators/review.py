"""Reviewed translations, language votes, comparisons of outputs, and job histories. Null texts read as empty ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglossa.functions.text import display_text


def tm_alternatives(rows: DataFrame) -> DataFrame:
    """variant, target, nth: the targets of a key after its first, in the order of their rows. rows: id, text, target."""
    key = F.lower(F.trim("text")).alias("variant")
    once = rows.filter(F.coalesce(F.trim("target"), F.lit("")) != "").groupBy(key, "target").agg(F.min("id").alias("id"))
    order = Window.partitionBy("variant").orderBy("id", "target")
    return once.withColumn("nth", F.row_number().over(order)).filter("nth > 1").select("variant", "target", "nth")


def page_lines(lines: DataFrame, page: int = 0, size: int = 20) -> DataFrame:
    """Lines of one page; taken before the lookup, so that no other line is looked up."""
    return lines.filter((F.col("line_no") >= page * size) & (F.col("line_no") < (page + 1) * size))


def bilingual_page(found: DataFrame) -> DataFrame:
    """doc_id, line_no, source, display, raw, needs_review. found: what tm_lookup gives for the lines of a page."""
    return found.select("doc_id", "line_no", F.col("text").alias("source"), display_text(F.col("text"), F.col("translated"), F.col("method")).alias("display"), F.col("translated").alias("raw"), "needs_review")


def roll_up_blocks(found: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, block, text, method ('mixed' if lines differ), confidence (null without one), needs_review, warning (the first) of blocks of `size` lines."""
    shown = display_text(F.col("text"), F.col("translated"), F.col("method"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", shown.alias("shown")))), lambda x: x["shown"]), "\n")
    made = found.groupBy("doc_id", F.floor(F.col("line_no") / size).alias("block")).agg(
        joined.alias("text"), F.min("method").alias("lo"), F.max("method").alias("hi"), F.round(F.avg("confidence"), 4).alias("confidence"),
        F.max("needs_review").alias("needs_review"), F.min(F.when(F.col("warning").isNotNull(), F.struct("line_no", "warning")))["warning"].alias("warning"),
    )
    return made.select("doc_id", "block", "text", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("method"), "confidence", "needs_review", "warning")


def mt_stats(rows: DataFrame) -> DataFrame:
    """n, exact, empty, copied, mean_chars, repeated of predictions, all 0 without rows. rows: source, reference, prediction."""
    t = rows.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("source", "reference", "prediction")))
    each = t.groupBy("prediction").agg(
        F.count("*").alias("c"), F.count_if(F.col("prediction") == F.col("reference")).alias("exact"), F.count_if(F.col("prediction") == F.col("source")).alias("copied")
    )
    sums = each.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum("exact").alias("exact"), F.sum(F.when(F.col("prediction") == "", F.col("c")).otherwise(0)).alias("empty"),
        F.sum("copied").alias("copied"), F.sum(F.length("prediction") * F.col("c")).alias("mean_chars"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("repeated"),
    )
    return sums.select("n", *(F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0)).alias(c) for c in ("exact", "empty", "copied", "mean_chars", "repeated")))


def mode_compare(rates: DataFrame) -> DataFrame:
    """mode, mean_cer (of rates to six places, nulls left out), best. rates: mode, cer."""
    mean = rates.groupBy("mode").agg((F.sum(F.round(F.col("cer") * 1000000).cast("long")) / F.count("cer") / 1000000.0).alias("mean_cer"))
    least = F.min(F.when(F.col("mean_cer").isNotNull(), F.struct("mean_cer", "mode"))).over(Window.partitionBy(F.lit(1)))  # a row for each mode
    return mean.withColumn("least", least).select("mode", "mean_cer", F.col("mode").eqNullSafe(F.col("least.mode")).alias("best"))


def job_history(jobs: DataFrame, part: str, statuses: tuple[str, ...]) -> DataFrame:
    """Jobs that are not deleted, whose file name holds `part` in either case, newest first for each owner."""
    found = jobs.filter(~F.col("is_deleted") & F.lower("filename").contains(part.lower()) & F.col("status").isin(*statuses))
    nth = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created"), F.desc("job")))
    return found.select("owner", nth.alias("nth"), "job", "filename", "status")


def segment_page(segments: DataFrame, page: int, size: int = 25) -> DataFrame:
    """job, segment_index, page: one page of each job's segments, the number kept between 1 and the last. segments: job, segment_index from 1."""
    last = segments.groupBy("job").agg(F.ceil(F.max("segment_index") / size).alias("last"))
    shown = F.least(F.greatest(F.lit(page), F.lit(1)), F.col("last"))
    own = F.floor((F.col("segment_index") - 1) / size) + 1
    return segments.join(last, "job").filter(own == shown).select("job", "segment_index", own.alias("page"))


def job_state(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """job, can_preview, can_download, is_processing, has_failed, finished, progress (100 when completed, never below 0). jobs: job, status, progress; outputs: jobs that have one."""
    made = outputs.select("job").distinct().withColumn("made", F.lit(True))
    s = F.col("status")
    return jobs.select("job", "status", "progress").join(made, "job", "left").select(
        "job", (s == "completed").alias("can_preview"), ((s == "completed") & F.coalesce("made", F.lit(False))).alias("can_download"),
        s.isin("queued", "processing", "retrying").alias("is_processing"), (s == "failed").alias("has_failed"), (s == "completed").alias("finished"),
        F.when(s == "completed", 100).otherwise(F.greatest(F.coalesce(F.col("progress").try_cast("int"), F.lit(0)), F.lit(0))).alias("progress"),
    )


def low_ocr(lines: DataFrame, low: float = 0.60) -> DataFrame:
    """Documents with any line under the confidence."""
    return lines.filter(F.col("confidence") < low).select("doc_id").distinct()


def job_ocr(lines: DataFrame, low: float = 0.60) -> DataFrame:
    """doc_id, n, mean_confidence (of four places), warnings: the numbers of low lines, joined in order."""
    warned = F.sort_array(F.collect_list(F.when(F.col("confidence") < low, F.col("line"))))
    sums = lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("confidence") * 10000).cast("long")).alias("total"), warned.alias("warned"))
    return sums.select("doc_id", "n", (F.col("total") / F.col("n") / 10000.0).alias("mean_confidence"), F.array_join(F.transform("warned", lambda x: x.cast("string")), ",").alias("warnings"))


def review_update(rows: DataFrame, action: Column) -> DataFrame:
    """doc_id, verified, needs_review after the action: verify (also clears the review), request, clear, or none."""
    verified = F.col("verified") | F.coalesce(action == "verify", F.lit(False))
    review = F.when(action == "request", True).when(action.isin("verify", "clear"), False).otherwise(F.col("needs_review"))
    return rows.select("doc_id", verified.alias("verified"), review.alias("needs_review"))


def event_dedup(new: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """The first new event (by event_id) of each key that no existing event has."""
    first = new.groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    return first.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def fold_status(events: DataFrame, final: str) -> DataFrame:
    """job, status, n: each job's latest status, but the final one is never overwritten. events: job, status, ts, event_id."""
    made = events.groupBy("job").agg(F.max(F.struct("ts", "event_id", "status")).alias("last"), F.coalesce(F.max(F.col("status") == final), F.lit(False)).alias("done"), F.count("*").alias("n"))
    return made.select("job", F.when(F.col("done"), final).otherwise(F.col("last.status")).alias("status"), "n")


def apply_actions(rows: DataFrame) -> DataFrame:
    """rows after a reviewer's action: the new table, in one pass and without a join.

    rows: kind (ocr_result, segment, phrase, term), action (null for none), status, needs_review, verified, approved, and any others. OCR results are
    accepted or sent back to pending; segments and phrases are marked for review, segments cleared of it; verifying a phrase clears its review;
    terms are approved. An action of another kind changes nothing.
    """
    does = lambda kind, action: F.coalesce((F.col("kind") == kind) & (F.col("action") == action), F.lit(False))
    asked, cleared = does("segment", "mark") | does("phrase", "mark"), does("segment", "clear") | does("phrase", "verify")
    return rows.withColumns({
        "status": F.when(does("ocr_result", "accept"), "accepted").when(does("ocr_result", "reopen"), "pending_review").otherwise(F.col("status")),
        "needs_review": F.when(asked, True).when(cleared, False).otherwise(F.col("needs_review")),
        "verified": F.col("verified") | does("phrase", "verify"), "approved": F.col("approved") | does("term", "approve"),
    }).drop("action")


def ocr_filters(results: DataFrame, low: float = 0.60) -> DataFrame:
    """job, is_low, has_warnings: jobs that either filter of OCR quality shows, once each. results: job, confidence, warnings (array; null or empty for none)."""
    made = results.groupBy("job").agg(F.coalesce(F.max(F.col("confidence") < low), F.lit(False)).alias("is_low"), F.coalesce(F.max(F.size("warnings") > 0), F.lit(False)).alias("has_warnings"))
    return made.filter("is_low or has_warnings")


def owned_history(jobs: DataFrame, owner: int | None, part: str = "", status: str = "", valid: tuple[str, ...] = ("queued", "processing", "retrying", "completed", "failed")) -> DataFrame:
    """job, owner, filename, upload, status, created of jobs that are not deleted, newest first.

    owner: whose jobs; None for a superuser, who sees all. part: held by the job's file name or its upload's, in either case, outer blanks
    left out. status: taken in either case, and only if it is a valid one. jobs: job, owner, filename, upload (null if none), status, created, is_deleted.
    """
    part, status = part.strip().lower(), status.strip().lower()
    named = reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(part), F.lit(False)) for c in ("filename", "upload")))
    found = jobs.filter(~F.col("is_deleted"))
    for wanted, rule in ((owner is not None, F.col("owner") == owner), (part, named), (status in valid, F.col("status") == status)):
        found = found.filter(rule) if wanted else found
    return found.select("job", "owner", "filename", "upload", "status", "created").orderBy(F.desc("created"), F.desc("job"))
