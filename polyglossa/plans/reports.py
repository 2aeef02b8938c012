"""Registered queries of layout, language, error rates, jobs and events, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.operators import jobs, layout
from polyglossa.plans.sql import BOOK, LINES
from polyglossa.sources import views

AS_OF = "1998-07-01 00:30:00"


def lang_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lang_vocab(views.table(spark, sf_dir, "documents"))


def dict_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dict_langid(views.table(spark, sf_dir, "documents"), lang_vocab(spark, sf_dir).filter("lang = 'fr'"))


def txt_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.txt_layout(views.lines(spark, sf_dir))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ocr_lines(views.ocr_words(spark, sf_dir))


def ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ocr_summary(ocr_lines(spark, sf_dir))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(views.layout_blocks(spark, sf_dir))


def two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.two_column(views.layout_blocks(spark, sf_dir))


def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_routing(views.layout_blocks(spark, sf_dir))


def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.phrasebook(spark, sf_dir).select("id", layout.cer(F.col("english"), F.col("filipino")).alias("cer"))
    return rated.withColumn("verdict", layout.pass_fail(F.col("cer")))


def job_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_health(views.jobs(spark, sf_dir), AS_OF)


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stale_jobs(views.jobs(spark, sf_dir), AS_OF, retry_queued=True).drop("owner")


def recovery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recovery_events(views.jobs(spark, sf_dir), AS_OF, retry_queued=True, dry_run=True)


def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recovered_jobs(views.jobs(spark, sf_dir), AS_OF, retry_queued=True)


#: Rules on line items as segments, pages, results and outputs of jobs, on parts as terms, and on suppliers as pairs of languages.
RULES = {
    "lineitem": ({
        "segment": ("l_orderkey", "l_linenumber"), "page": ("l_orderkey", "l_suppkey"), "ocr_result": ("l_orderkey", "l_returnflag", "l_linestatus"), "output": ("l_orderkey", "l_shipdate", "l_tax"),
    }, {}),
    "part": ({"term": ("p_brand", "p_type", "p_size")}, {}),
    "supplier": ({"language_pair": ("s_nationkey", "source")}, {"different_languages": "s_nationkey <> source"}),
}


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: views.table(spark, sf_dir, name) for name in RULES}
    tables["supplier"] = tables["supplier"].withColumn("source", F.col("s_suppkey") % 25)
    return jobs.violations([(tables[name], *rules) for name, rules in RULES.items()])


def taking_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.taking_longer(views.jobs(spark, sf_dir), AS_OF)


def job_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "lineitem")
    segments = part.select(F.col("l_orderkey").alias("job"), (F.col("l_returnflag") == "R").alias("needs_review"), F.when(F.col("l_returnflag") != "N", 1 - F.col("l_discount")).alias("confidence"))
    job = F.col("l_orderkey").alias("job")
    pages, outputs = part.select(job, (F.col("l_suppkey") % 3).alias("page")), part.filter("l_returnflag = 'A'").select(job)
    ocr = part.filter("l_linestatus = 'O'").select(job, (1 - F.col("l_tax")).alias("confidence"))
    return jobs.job_dashboard(views.jobs(spark, sf_dir), segments, pages, ocr, outputs)


def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.repeated_keys(views.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.event_windows(views.table(spark, sf_dir, "events"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.event_sessions(views.table(spark, sf_dir, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        lang_vocab, dict_langid, txt_layout, ocr_lines, ocr_summary, reading_order, two_column, page_routing, cer,
        job_health, stale_jobs, recovery_events, recovered_jobs, taking_longer, job_dashboard, constraint_checks, constraint_violations, event_windows, event_sessions,
    )
}

TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
VOCAB = f"vocab AS (SELECT DISTINCT lang, unnest({TOKENS}) AS token FROM documents)"
OCR = f"""{LINES}, words AS (SELECT doc_id, line_no AS line, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM lines),
  rated AS (SELECT *, (length(word) * 37 + i * 11) % 112 - 10 AS conf FROM words WHERE trim(word) <> ''),
  ocr AS (SELECT doc_id, line, string_agg(word, ' ' ORDER BY i) AS text, min(i * 30) AS x0, max(i * 30 + length(word) * 5) AS x1, count(*) AS n_words, sum(conf)::DOUBLE / count(*) / 100.0::DOUBLE AS confidence FROM rated WHERE conf >= 0 GROUP BY 1, 2)"""
_BLOCKS = f"""{LINES}, blocks AS (SELECT doc_id, line_no // 20 AS page, line_no AS block_no, text, CASE WHEN (doc_id + line_no) % 7 < 4 THEN 72 ELSE 350 END AS x0,
  100 + 30 * (line_no % 20) - CASE WHEN (doc_id * 7 + line_no) % 23 = 0 THEN 40 ELSE 0 END AS y0 FROM lines)"""
JOBS = """jobs AS (SELECT o_orderkey AS job, o_custkey AS owner, o_orderdate AS created, o_orderdate + to_minutes(o_orderkey % 60) AS updated, o_orderkey % 11 = 0 AS is_deleted,
  CASE WHEN o_orderkey % 17 = 0 THEN 'retrying' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'processing' END AS status FROM orders)"""
_ACTIVE = "status IN ('queued', 'processing', 'retrying')"
_STALE = f"({_ACTIVE} AND NOT is_deleted AND updated <= TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE)"
_SUPPLIERS = "(SELECT *, s_suppkey % 25 AS source FROM supplier)"

ORACLE_SQL = {
    "lang_vocab": f"WITH {VOCAB} SELECT * FROM vocab",
    "dict_langid": f"""WITH {VOCAB}, own AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents), s AS (SELECT d.doc_id, count(own.token) AS n_tokens, count(v.token) AS n_known
      FROM documents d LEFT JOIN own ON d.doc_id = own.doc_id LEFT JOIN (SELECT token FROM vocab WHERE lang = 'fr') v ON own.token = v.token GROUP BY 1), r AS (SELECT *, coalesce(n_known / nullif(n_tokens, 0), 0.0) AS ratio FROM s)
      SELECT doc_id, n_tokens, n_known, ratio > 0.3 AS matched, least(ratio * 1.5, 1.0)::DOUBLE AS confidence FROM r""",
    "txt_layout": f"WITH {LINES}, h AS (SELECT doc_id, line_no, least(greatest(16 + length(trim(text)) // 4, 24), 120) AS height FROM lines), y AS (SELECT *, (72 + coalesce(sum(height + 12) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS y0 FROM h) SELECT doc_id, line_no, y0, y0 + height AS y1 FROM y",
    "ocr_lines": f"WITH {OCR} SELECT * FROM ocr",
    "ocr_summary": f"WITH {OCR} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE confidence < 0.6) AS n_low, min(confidence) AS min_confidence, count(*) FILTER (WHERE confidence < 0.6) > 0 AS warning FROM ocr GROUP BY 1",
    "reading_order": f"WITH {_BLOCKS}, u AS (SELECT doc_id, page, y0 < lag(y0) OVER (PARTITION BY doc_id, page ORDER BY block_no) - 5 AS up FROM blocks) SELECT doc_id, page, count(*) FILTER (WHERE up) AS inversions FROM u GROUP BY 1, 2",
    "two_column": f"WITH {_BLOCKS}, c AS (SELECT doc_id, page, count(*) FILTER (WHERE x0 + 190 <= 0.45 * 612) AS n_left, count(*) FILTER (WHERE x0 >= 0.55 * 612) AS n_right FROM blocks GROUP BY 1, 2) SELECT *, n_left > 0 AND n_right > 0 AS two_column FROM c",
    "page_routing": f"WITH {_BLOCKS}, c AS (SELECT doc_id, page, sum(length(translate(text, ' ' || chr(10) || chr(9), '')))::BIGINT AS n_chars FROM blocks GROUP BY 1, 2) SELECT *, CASE WHEN n_chars >= 50 THEN 'digital' ELSE 'ocr' END AS route FROM c",
    "cer": f"WITH {BOOK}, t AS (SELECT id, replace(english, ' ', '') AS r, replace(filipino, ' ', '') AS h FROM book), c AS (SELECT id, least(1.0::DOUBLE, levenshtein(r, h) / length(r)) AS cer FROM t) SELECT id, cer, CASE WHEN cer < 0.1 THEN 'pass' ELSE 'fail' END AS verdict FROM c",
    "job_health": f"WITH {JOBS} SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'retrying') AS retrying, count(*) FILTER (WHERE {_ACTIVE} AND updated <= TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE) AS stale FROM jobs",
    "stale_jobs": f"WITH {JOBS} SELECT job, status, CASE WHEN status = 'processing' THEN 'fail' ELSE 'retry' END AS action FROM jobs WHERE {_ACTIVE} AND NOT is_deleted AND updated <= TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE",
    "taking_longer": f"WITH {JOBS} SELECT job, owner FROM jobs WHERE {_ACTIVE} AND created <= TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE",
    "job_dashboard": f"""WITH {JOBS}, s AS (SELECT l_orderkey AS job, count(*) AS n_segments, count(*) FILTER (WHERE l_returnflag = 'R') AS n_review, min(CASE WHEN l_returnflag <> 'N' THEN 1 - l_discount END) AS min_confidence,
      sum(round((1 - l_discount) * 10000)::BIGINT) FILTER (WHERE l_returnflag <> 'N') / count(*) FILTER (WHERE l_returnflag <> 'N') / 10000.0::DOUBLE AS mean_confidence,
      sum(round((1 - l_tax) * 10000)::BIGINT) FILTER (WHERE l_linestatus = 'O') / count(*) FILTER (WHERE l_linestatus = 'O') / 10000.0::DOUBLE AS ocr_confidence, count(DISTINCT l_suppkey % 3) AS n_pages, count(*) FILTER (WHERE l_returnflag = 'A') AS n_outputs FROM lineitem GROUP BY 1)
      SELECT job, status, coalesce(n_segments, 0) AS n_segments, coalesce(n_review, 0) AS n_review, min_confidence, mean_confidence, ocr_confidence, coalesce(n_pages, 0) AS n_pages, coalesce(n_outputs, 0) AS n_outputs FROM jobs LEFT JOIN s USING (job)""",
    "recovery_events": f"""WITH {JOBS}, s AS (SELECT job, owner AS actor, status AS previous_status, CASE WHEN status = 'processing' THEN 'fail' ELSE 'retry' END AS action FROM jobs WHERE {_STALE})
      SELECT job, actor, 'warning' AS level, '{jobs.RECOVERY_EVENT}' AS event_type, 'Dry run: would ' || action || ' stale translation job after 15 minute(s).' AS message, action, previous_status FROM s""",
    "recovered_jobs": f"""WITH {JOBS}, s AS (SELECT *, {_STALE} AS stale FROM jobs) SELECT job, owner, CASE WHEN NOT stale THEN status WHEN status = 'processing' THEN 'failed' ELSE 'retrying' END AS status,
      (CASE WHEN stale THEN TIMESTAMP '{AS_OF}' ELSE updated END)::TIMESTAMP AS updated, is_deleted, CASE WHEN stale AND status = 'processing' THEN '{jobs.ABANDONED}' WHEN stale THEN '{jobs.RETRIED}' END AS message,
      CASE WHEN stale AND status <> 'processing' THEN 0 END AS progress, CASE WHEN stale AND status = 'processing' THEN TIMESTAMP '{AS_OF}' END AS finished FROM s""",
    "constraint_violations": " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, concat_ws(chr(31), {', '.join(f'{c}::VARCHAR' for c in columns)}) AS key, count(*) AS n FROM {_SUPPLIERS if name == 'supplier' else name} GROUP BY {', '.join(columns)} HAVING count(*) > 1"
        for name, (unique, _) in RULES.items() for rule, columns in unique.items()
    ) + f" UNION ALL SELECT 'different_languages', 's_nationkey <> source', count(*) FROM {_SUPPLIERS} WHERE s_nationkey = source HAVING count(*) > 0",
    "constraint_checks": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_sessions": "WITH a AS (SELECT user_id, ts, event_id, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 > 3600, true) AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(apart::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM a) SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2",
}
