"""Registered queries of reviewed translations, language votes, comparisons and job histories, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyglossa.functions.text import INVISIBLE
from polyglossa.operators import layout, review, tm
from polyglossa.plans import reports
from polyglossa.plans.sql import BOOK, LOOKUP, PAIRS
from polyglossa.sources import views

#: Place of a segment in its job: line items have no key of their own.
PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def tm_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.tm_alternatives(views.phrasebook(spark, sf_dir).select("id", F.col("tagabawa").alias("text"), F.col("english").alias("target")))


def _found(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    return tm.memory_lookup(asked, views.memory(spark, sf_dir, once=False), ("english", "filipino", "cebuano"), ("english",))


def bilingual_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.bilingual_page(_found(spark, sf_dir, review.page_lines(views.queries(spark, sf_dir))))


def translated_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.roll_up_blocks(_found(spark, sf_dir, views.queries(spark, sf_dir)).withColumn("warning", F.when(F.col("needs_review"), F.concat_ws(" ", F.lit("line"), "line_no"))))


def mt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flawed copies of pairs as predictions, the pairs themselves as references."""
    rows = views.pairs(spark, sf_dir).withColumn("nth", F.substring_index("record_id", "-", -1)).withColumn("turn", F.expr("substr(record_id, 1, length(record_id) - 2)"))
    made = rows.filter("nth = '1'").select("turn", F.col("source_text").alias("source"), F.col("target_text").alias("prediction"))
    return review.mt_stats(made.join(rows.filter("nth = '0'").select("turn", F.col("target_text").alias("reference")), "turn"))


def mode_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit(3), F.lit(4), F.lit(6)), (F.col("id") % 3 + 1).cast("int"))
    return review.mode_compare(views.phrasebook(spark, sf_dir).select(mode.alias("mode"), layout.cer(F.col("english"), F.col("filipino")).alias("cer")))


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), "c_name")
    jobs = views.jobs(spark, sf_dir).join(names, "owner").withColumn("filename", F.concat_ws("_", "c_name", "job"))
    return review.job_history(jobs, "R#", ("completed", "failed"))


def segment_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*PLACE))
    return review.segment_page(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), place.alias("segment_index")), 2, 3)


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.job_state(views.jobs(spark, sf_dir).withColumn("progress", (F.col("job") % 120 - 20).cast("int")), views.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("job")))


def low_ocr_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.low_ocr(reports.ocr_lines(spark, sf_dir))


def job_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.job_ocr(reports.ocr_lines(spark, sf_dir))


def review_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verified"), (F.col("toxic") == 1).alias("needs_review"))
    kind = F.col("doc_id") % 4
    return review.review_update(rows, F.when(kind == 0, "verify").when(kind == 1, "request").when(kind == 2, "clear"))


def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the second half of the month against those of the first, by user, type and hour of the day."""
    events = views.table(spark, sf_dir, "events").withColumn("message", F.date_format("ts", "HH"))
    late = F.dayofmonth("ts") > 15
    return review.event_dedup(events.filter(late), events.filter(~late), "user_id", "event_type", "message")


def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by hour of the day as jobs; a purchase is final."""
    events = views.table(spark, sf_dir, "events")
    return review.fold_status(events.select(F.concat_ws("-", "user_id", F.date_format("ts", "HH")).alias("job"), F.col("event_type").alias("status"), "ts", "event_id"), "purchase")


QUERIES = {
    f.__name__: f
    for f in (
        tm_alternatives, bilingual_page, translated_layout, mt_stats, mode_compare, job_history,
        segment_page, job_state, low_ocr_jobs, job_ocr, review_update, event_dedup, job_fold,
    )
}

ORACLE_SQL = {
    "tm_alternatives": f"WITH {BOOK}, o AS (SELECT lower(trim(tagabawa)) AS variant, english AS target, min(id) AS id FROM book WHERE trim(english) <> '' GROUP BY 1, 2) SELECT variant, target, nth FROM (SELECT *, (row_number() OVER (PARTITION BY variant ORDER BY id, target))::INT AS nth FROM o) WHERE nth > 1",
    "bilingual_page": f"{LOOKUP} SELECT doc_id, line_no, text AS source, CASE WHEN needs_review THEN translate(text, '{INVISIBLE}', '') ELSE translate(translated, '{INVISIBLE}', '') END AS display, translated AS raw, needs_review FROM found WHERE line_no < 20",
    "translated_layout": f"{LOOKUP} SELECT doc_id, line_no // 5 AS block, string_agg(CASE WHEN needs_review THEN translate(text, '{INVISIBLE}', '') ELSE translate(translated, '{INVISIBLE}', '') END, chr(10) ORDER BY line_no) AS text, CASE WHEN min(method) = max(method) THEN min(method) ELSE 'mixed' END AS method, round(avg(confidence), 4) AS confidence, bool_or(needs_review) AS needs_review, min_by('line ' || line_no, line_no) FILTER (WHERE needs_review) AS warning FROM found GROUP BY 1, 2",
    "mt_stats": f"""WITH {PAIRS}, k AS (SELECT *, right(record_id, 1) AS nth, left(record_id, -2) AS turn FROM pairs), t AS (SELECT trim(p.source_text) AS source, trim(p.target_text) AS prediction, trim(r.target_text) AS reference FROM k p JOIN k r ON p.turn = r.turn AND p.nth = '1' AND r.nth = '0'),
      c AS (SELECT *, count(*) OVER (PARTITION BY prediction) AS c FROM t), f AS (SELECT count(*) AS n, count(*) FILTER (WHERE prediction = reference) AS e, count(*) FILTER (WHERE prediction = '') AS m, count(*) FILTER (WHERE prediction = source) AS s, coalesce(sum(length(prediction)), 0)::BIGINT AS l, count(*) FILTER (WHERE c > 1) AS r FROM c)
      SELECT n, coalesce(e / nullif(n, 0), 0.0)::DOUBLE AS exact, coalesce(m / nullif(n, 0), 0.0)::DOUBLE AS empty, coalesce(s / nullif(n, 0), 0.0)::DOUBLE AS copied, coalesce(l / nullif(n, 0), 0.0)::DOUBLE AS mean_chars, coalesce(r / nullif(n, 0), 0.0)::DOUBLE AS repeated FROM f""",
    "mode_compare": f"WITH {BOOK}, t AS (SELECT ([3, 4, 6])[id % 3 + 1] AS mode, replace(english, ' ', '') AS r, replace(filipino, ' ', '') AS h FROM book), m AS (SELECT mode, sum(round(least(1.0::DOUBLE, levenshtein(r, h) / length(r)) * 1000000)::BIGINT)::BIGINT / count(*) / 1000000.0::DOUBLE AS mean_cer FROM t GROUP BY 1) SELECT mode, mean_cer, row_number() OVER (ORDER BY mean_cer, mode) = 1 AS best FROM m",
    "job_history": f"WITH {reports.JOBS}, h AS (SELECT owner, job, c_name || '_' || job AS filename, status, created FROM jobs JOIN customer ON owner = c_custkey WHERE NOT is_deleted AND status IN ('completed', 'failed')) SELECT owner, (row_number() OVER (PARTITION BY owner ORDER BY created DESC, job DESC))::INT AS nth, job, filename, status FROM h WHERE lower(filename) LIKE '%r#%'",
    "segment_page": f"WITH s AS (SELECT l_orderkey AS job, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}))::INT AS segment_index FROM lineitem), l AS (SELECT *, (max(segment_index) OVER (PARTITION BY job) + 2) // 3 AS last FROM s) SELECT job, segment_index, ((segment_index - 1) // 3 + 1)::BIGINT AS page FROM l WHERE (segment_index - 1) // 3 + 1 = least(2, last)",
    "job_state": f"WITH {reports.JOBS} SELECT job, status = 'completed' AND job IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') AS can_download, status = 'completed' AS can_preview, CASE WHEN status = 'completed' THEN 100 ELSE greatest((job % 120 - 20)::INT, 0) END AS progress, status IN ('queued', 'processing', 'retrying') AS is_processing, status = 'failed' AS has_failed, status = 'completed' AS finished FROM jobs",
    "low_ocr_jobs": f"WITH {reports.OCR} SELECT DISTINCT doc_id FROM ocr WHERE confidence < 0.6",
    "job_ocr": f"WITH {reports.OCR} SELECT doc_id, count(*) AS n, sum(round(confidence * 10000)::BIGINT)::BIGINT / count(*) / 10000.0::DOUBLE AS mean_confidence, coalesce(string_agg(CASE WHEN confidence < 0.6 THEN line::VARCHAR END, ',' ORDER BY line), '') AS warnings FROM ocr GROUP BY 1",
    "review_update": "SELECT doc_id, quality = 1 OR doc_id % 4 = 0 AS verified, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE toxic = 1 END AS needs_review FROM labels",
    "event_dedup": "WITH e AS (SELECT user_id, event_type, strftime(ts, '%H') AS message, event_id, day(ts) > 15 AS late FROM events), k AS (SELECT user_id, event_type, message, min(event_id) FILTER (WHERE late) AS event_id, bool_or(NOT late) AS known FROM e GROUP BY 1, 2, 3) SELECT user_id, event_type, message, event_id FROM k WHERE NOT known",
    "job_fold": "SELECT user_id || '-' || strftime(ts, '%H') AS job, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE arg_max(event_type, (ts, event_id)) END AS status, count(*) AS n FROM events GROUP BY 1",
}
