"""The registered queries of the corpus operators and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.operators import audit, jobs, tm
from polyglossa.operators.skew import evenly
from polyglossa.plans import language, pages, pairs, records, reports, retention, review
from polyglossa.plans.sql import AUDITED, BOOK, CLASS, LINES, LOOKUP, SIZES, forms
from polyglossa.sources import views


def tm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review._found(spark, sf_dir, views.queries(spark, sf_dir)).drop("text")


def tm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of rows with the same texts only the first is expanded, in tasks of even numbers of rows
    book = views.phrasebook(spark, sf_dir).groupBy(*audit.LANGS).agg(F.min("id").alias("row_pos"))
    return tm.tm_index(evenly(book), audit.LANGS)


def tm_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tm.tm_index(views.memory(spark, sf_dir), ("english", "filipino", "cebuano"), ("english",))
    return tm.tm_coverage(views.queries(spark, sf_dir), index)


def record_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.line_classes(views.lines(spark, sf_dir))


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_counts(views.phrasebook(spark, sf_dir))


def audit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_types(views.phrasebook(spark, sf_dir))


def audit_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_dups(views.audit_book(spark, sf_dir))


def audit_polysemy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_polysemy(views.audit_book(spark, sf_dir))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem")
    return jobs.quality_summary(rows.select(F.col("l_orderkey").alias("job"), (F.col("l_returnflag") == "R").alias("needs_review"), F.when(F.col("l_returnflag") != "N", 1 - F.col("l_discount")).alias("confidence")))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent_jobs(_jobs(spark, sf_dir), active=("O", "P"))


def active_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.active_limit(_jobs(spark, sf_dir), ("O", "P"))


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.event_summary(views.table(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (tm_lookup, tm_index, tm_coverage, record_class, audit_counts, audit_types, audit_dups, audit_polysemy, quality_summary, recent_jobs, active_limit, event_summary)}

_CLEAR = pairs._CLEAR

ORACLE_SQL = {
    "tm_lookup": f"{LOOKUP} SELECT * EXCLUDE (text) FROM found",
    "tm_index": f"WITH {BOOK}, s AS (SELECT id, src_lang, text, english, tagabawa, filipino, cebuano FROM book, LATERAL (VALUES ('english', english), ('tagabawa', tagabawa), ('filipino', filipino), ('cebuano', cebuano)) AS v(src_lang, text)) SELECT src_lang, t.tgt_lang, variant, min(id) AS row_pos, min_by(t.target, id) AS target FROM {forms('s', 'id, src_lang, english, tagabawa, filipino, cebuano')} m, LATERAL (VALUES ('english', english), ('tagabawa', tagabawa), ('filipino', filipino), ('cebuano', cebuano)) AS t(tgt_lang, target) WHERE src_lang <> t.tgt_lang AND trim(t.target) <> '' GROUP BY 1, 2, 3",
    "tm_coverage": f"{LOOKUP} SELECT src_lang, tgt_lang, method, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY src_lang, tgt_lang) AS share FROM found GROUP BY 1, 2, 3",
    "record_class": f"WITH {LINES} SELECT lang, {CLASS} AS record_class, count(*) AS n FROM (SELECT lang, {SIZES} FROM lines) GROUP BY 1, 2",
    "audit_counts": f"WITH {BOOK} SELECT count(*) AS total, count(*) FILTER (WHERE cebuano <> '') AS complete, count(*) FILTER (WHERE cebuano = '') AS missing_any FROM book",
    "audit_types": f"WITH {BOOK}, long AS (SELECT lang, text FROM book, LATERAL (VALUES ('english', english), ('tagabawa', tagabawa), ('filipino', filipino), ('cebuano', cebuano)) AS v(lang, text)) SELECT lang, {CLASS} AS record_class, count(*) AS n FROM (SELECT lang, {SIZES} FROM long) GROUP BY 1, 2",
    "audit_dups": f"WITH {AUDITED}, g AS (SELECT count(*) AS n FROM audited GROUP BY {', '.join(_CLEAR.format(c) for c in audit.LANGS)} HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM g",
    "audit_polysemy": f"""WITH {AUDITED}, k AS (SELECT DISTINCT {_CLEAR.format('tagabawa')} AS source, {_CLEAR.format('english')} AS ref FROM audited)
      SELECT source, count(*)::INT AS n_variants, string_agg(ref, '|' ORDER BY ref) AS variants FROM k WHERE source <> '' GROUP BY 1 HAVING count(*) > 1""",
    "quality_summary": """WITH s AS (SELECT l_orderkey AS job, count(*) AS n_segments, count(*) FILTER (WHERE l_returnflag = 'R') AS n_review, sum(round((1 - l_discount) * 10000)::BIGINT) FILTER (WHERE l_returnflag <> 'N') / count(*) FILTER (WHERE l_returnflag <> 'N') / 10000.0::DOUBLE AS confidence
      FROM lineitem GROUP BY 1) SELECT *, round(100 * confidence)::INT AS confidence_pct, n_review > 0 AS has_review FROM s""",
    "recent_jobs": """WITH r AS (SELECT o_custkey AS owner, o_orderkey AS job, o_orderstatus, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))::INT AS nth FROM orders), s AS (SELECT * FROM r WHERE nth <= 5)
      SELECT owner, job, nth, coalesce(nth = min(nth) FILTER (WHERE o_orderstatus IN ('O', 'P')) OVER (PARTITION BY owner), false) AS is_active_job FROM s""",
    "active_limit": "SELECT o_custkey AS owner, count(*) AS active FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) >= 2",
    "event_summary": "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2, 3",
}

for _part in (pairs, language, reports, review, pages, retention, records):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
