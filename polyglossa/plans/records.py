"""Registered queries of OCR lines with boxes, inventories, split records, reports, reviewers' actions and fallbacks, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.operators import audit, layout, pages, pairs, review, tm
from polyglossa.plans import reports
from polyglossa.plans.pages import _BLOCKS
from polyglossa.plans.pairs import _key, _plain
from polyglossa.plans.review import _found
from polyglossa.plans.sql import AUDITED, BOOK, LINES, LOOKUP, PAIRS, directed, split_sql
from polyglossa.sources import views

#: A reviewer's action by doc_id, some of them of another kind of row.
ACTIONS = ("accept", "reopen", "mark", "clear", "verify", "approve", "")
KINDS = ("ocr_result", "segment", "phrase", "term")


def ocr_line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 144 dots per inch in blocks of five lines, some with a confidence that is no number."""
    line, i = F.col("line"), F.col("i")
    conf = F.when(i % 13 == 12, "n/a").otherwise(F.col("conf").cast("string"))
    words = views.ocr_words(spark, sf_dir).withColumns({
        "block": F.floor(line / 5), "par": F.floor(line % 5 / 2), "top": 20 * line + i % 3, "height": 10 + i % 2, "conf": conf,
    })
    return layout.ocr_line_boxes(words, dpi=144)


def ocr_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.page_blocks(spark, sf_dir).select("doc_id", F.when(F.col("block_no") % 7 == 3, "bad").otherwise(F.col("confidence").cast("string")).alias("confidence"))
    return layout.ocr_document_summary(views.pages_of(spark, sf_dir), rated)


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("block_no"), F.length("text")
    blocks = views.page_blocks(spark, sf_dir).select(
        "doc_id", "page", "type", (n % 4 + 1).alias("rows"), (size % 5).alias("columns"), ((n % 4 + 1) * (size % 5)).alias("cells"), F.when(n % 2 == 1, size % 7).alias("items")
    )
    return pages.page_inventory(views.pages_of(spark, sf_dir), blocks)


def split_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pairs.checked_split(views.pairs(spark, sf_dir).select("record_id"))
    return pairs.split_record(split, "record_id", "experimental_row_split")


def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrasebook with some texts marked for review, some with diacritics, some blank and some repeated."""
    n, book = F.col("id"), views.audit_book(spark, sf_dir)
    marked = book.withColumns({
        "cebuano": F.when((n % 19 == 0) & (F.col("cebuano") != ""), F.concat(F.lit("[UNKNOWN_FOR_REVIEW] "), "cebuano")).otherwise(F.col("cebuano")),
        "tagabawa": F.when(n % 6 == 0, F.concat("tagabawa", F.lit("ë"))).otherwise(F.col("tagabawa")), "verified": n % 3 == 0,
    })
    records = pairs.hash_split(pairs.translation_pairs(marked), "row_id")
    return pairs.training_report(marked, records)


def apply_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, pick = F.col("doc_id"), lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    rows = views.table(spark, sf_dir, "labels").select(
        n.alias("doc_id"), pick(KINDS, n % 4).alias("kind"), F.nullif(pick(ACTIONS, n % 7), F.lit("")).alias("action"), F.when(n % 5 > 0, "pending_review").alias("status"),
        (F.col("toxic") == 1).alias("needs_review"), (F.col("quality") == 1).alias("verified"), (n % 11 == 0).alias("approved"),
    )
    return review.apply_actions(rows)


def ocr_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.ocr_lines(spark, sf_dir)
    warnings = F.when(F.col("line") % 29 == 3, F.array(F.lit("skewed"))).when(F.col("line") % 2 == 0, F.array().cast("array<string>"))
    return review.ocr_filters(found.select(F.col("doc_id").alias("job"), "confidence", warnings.alias("warnings")), 0.3)


def owned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), "c_name")
    job = F.col("job")
    rows = views.jobs(spark, sf_dir).join(names, "owner").withColumns({"filename": F.concat_ws("_", "c_name", job), "upload": F.when(job % 3 > 0, F.concat_ws("-", F.lit("Up"), job))})
    return review.owned_history(rows, None, " uP-1", "Completed ")


def top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_topics(views.audit_book(spark, sf_dir))


def _even_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands for a model: a translation for every text of even length, none for others."""
    for f in frames:
        yield f.assign(text=["F:" + t if len(t) % 2 == 0 else None for t in f["text"]])


def tm_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.with_fallback(_found(spark, sf_dir, views.queries(spark, sf_dir)), _even_texts, "english", "cebuano").drop("text")


QUERIES = {
    f.__name__: f
    for f in (ocr_line_boxes, ocr_document_summary, page_inventory, split_record, training_report, apply_actions, ocr_filters, owned_history, top_topics, tm_fallback)
}

_LANGS = audit.LANGS
_CLEAN = "regexp_replace(coalesce({0}, ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
_WHOLE = "concat_ws(' ', " + ", ".join(_CLEAN.format(c) for c in _LANGS) + ")"
_FIT = " AND ".join(f"trim(coalesce({c}, ''), E' \\t\\r\\n') <> '' AND coalesce({c}, '') NOT LIKE '%UNKNOWN_FOR_REVIEW]%'" for c in _LANGS)
_MARKED = f"""{AUDITED}, marked AS (SELECT * REPLACE (CASE WHEN id % 19 = 0 AND cebuano <> '' THEN '[UNKNOWN_FOR_REVIEW] ' || cebuano ELSE cebuano END AS cebuano, CASE WHEN id % 6 = 0 THEN tagabawa || 'ë' ELSE tagabawa END AS tagabawa), id % 3 = 0 AS verified FROM audited),
  records AS (SELECT *, {split_sql('row_id')} AS split FROM ({directed(_LANGS)}))"""
_FLAWS = {
    ("rows", "total"): "true", ("rows", "usable"): _FIT, ("rows", "skipped"): f"NOT ({_FIT})", **{("missing", c): f"{_CLEAN.format(c)} = ''" for c in _LANGS},
    ("characters", "replacement"): f"contains({_WHOLE}, chr(65533))", ("characters", "control"): f"regexp_matches(translate({_WHOLE}, chr(9) || chr(10) || chr(13), ''), '\\p{{C}}')",
    ("characters", "tagabawa_diacritics"): f"{_plain('tagabawa')} <> tagabawa", ("review", "verified"): "verified", ("review", "unverified"): "NOT verified",
    ("review", "marked"): "lower(coalesce(notes, '')) LIKE '%need to double check%' OR lower(coalesce(notes, '')) LIKE '%manual check%'", ("review", "auto_split"): "lower(coalesce(notes, '')) LIKE '%auto-split%'",
}

ORACLE_SQL = {
    "ocr_line_boxes": f"""WITH {LINES}, words AS (SELECT doc_id, line_no AS line, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM lines),
      rated AS (SELECT *, trim(word) AS w, (length(word) * 37 + i * 11) % 112 - 10 AS conf FROM words WHERE trim(word) <> '' AND i % 13 <> 12)
      SELECT doc_id, line // 5 AS block, line % 5 // 2 AS par, line, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n_words, min(i * 30) / 2 AS x0, min(20 * line + i % 3) / 2 AS y0, max(i * 30 + length(word) * 5) / 2 AS x1, max(20 * line + i % 3 + 10 + i % 2) / 2 AS y1,
        least(floor((20000 * sum(conf) + 100 * count(*)) / (200 * count(*))) / 10000.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM rated WHERE conf >= 0 GROUP BY ALL""",
    "ocr_document_summary": f"""WITH {_BLOCKS}, r AS (SELECT doc_id, count(*) AS n, sum(round(confidence * 10000)::BIGINT)::BIGINT AS t, min(confidence) AS least_c, count(*) FILTER (WHERE confidence < 0.6) AS n_low FROM blocks WHERE confidence IS NOT NULL AND block_no % 7 <> 3 GROUP BY 1),
      p AS (SELECT doc_id, count(*) AS n_pages FROM paged GROUP BY 1), s AS (SELECT *, floor((2 * t + n) / (2 * n)) / 10000.0::DOUBLE AS mean_confidence FROM p LEFT JOIN r USING (doc_id))
      SELECT doc_id, mean_confidence, round(least_c, 4) AS min_confidence, coalesce(n_low, 0) AS n_low, coalesce(n, 0) AS n_blocks, coalesce(mean_confidence < 0.6 OR n_low > 0, false) AS warning, n_pages FROM s""",
    "page_inventory": f"""WITH {_BLOCKS}, c AS (SELECT doc_id, page, {', '.join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in ('text', 'image', 'table', 'drawing'))}, sum(block_no % 4 + 1) FILTER (WHERE type = 'table') AS r, sum(length(text) % 5) FILTER (WHERE type = 'table') AS k,
        sum((block_no % 4 + 1) * (length(text) % 5)) FILTER (WHERE type = 'table') AS m, sum(length(text) % 7) FILTER (WHERE type = 'drawing' AND block_no % 2 = 1) AS d FROM blocks GROUP BY 1, 2)
      SELECT doc_id, page, {', '.join(f'coalesce(n_{t}, 0) AS n_{t}' for t in ('text', 'image', 'table', 'drawing'))}, coalesce(r, 0)::BIGINT AS n_rows, coalesce(k, 0)::BIGINT AS n_columns, coalesce(m, 0)::BIGINT AS n_cells, coalesce(d, 0)::BIGINT AS n_items FROM paged LEFT JOIN c USING (doc_id, page)""",
    "split_record": f"""WITH {PAIRS}, s AS (SELECT {split_sql('record_id')} AS split FROM pairs) SELECT 'experimental_row_split' AS method, 42 AS seed, false AS leakage_safe, 0.8::DOUBLE AS ratio_train, 0.1::DOUBLE AS ratio_dev, 0.1::DOUBLE AS ratio_test,
      {', '.join(f"count(*) FILTER (WHERE split = '{k}') AS n_{k}" for k in pairs.SPLITS)}, count(*) AS n_total, 0::BIGINT AS overlap FROM s""",
    "training_report": f"WITH {_MARKED}, " + "flaws AS (" + " UNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS metric, count(*) FILTER (WHERE {e}) AS n FROM marked" for (s, m), e in _FLAWS.items()) + f""")
      SELECT * FROM flaws UNION ALL SELECT 'rows', 'repeated', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_CLEAN.format(c) for c in _LANGS)} FROM marked)))::BIGINT FROM marked
      UNION ALL SELECT 'directions', source_lang || '->' || target_lang, count(*) FROM records GROUP BY 2 UNION ALL SELECT 'splits', split, count(*) FROM records GROUP BY 2
      UNION ALL SELECT 'split_rows', split, count(DISTINCT row_id) FROM records GROUP BY 2 UNION ALL SELECT 'review', 'unknown_records', count(*) FROM records WHERE source_text LIKE '%UNKNOWN_FOR_REVIEW%' OR target_text LIKE '%UNKNOWN_FOR_REVIEW%'
      UNION ALL SELECT 'splits', 'leaking_pairs', count(*) FROM (SELECT 1 FROM records GROUP BY source_lang, target_lang, {_key('source_text')}, {_key('target_text')} HAVING count(DISTINCT split) > 1)""",
    "apply_actions": f"""WITH r AS (SELECT *, ({list(KINDS)})[doc_id % 4 + 1] AS kind, ({list(ACTIONS)})[doc_id % 7 + 1] AS action, CASE WHEN doc_id % 5 > 0 THEN 'pending_review' END AS status FROM labels)
      SELECT doc_id, kind, CASE WHEN kind = 'ocr_result' AND action = 'accept' THEN 'accepted' WHEN kind = 'ocr_result' AND action = 'reopen' THEN 'pending_review' ELSE status END AS status,
        CASE WHEN action = 'mark' AND kind IN ('segment', 'phrase') THEN true WHEN kind || action IN ('segmentclear', 'phraseverify') THEN false ELSE toxic = 1 END AS needs_review,
        quality = 1 OR kind || action = 'phraseverify' AS verified, doc_id % 11 = 0 OR kind || action = 'termapprove' AS approved FROM r""",
    "ocr_filters": f"WITH {reports.OCR}, j AS (SELECT doc_id AS job, bool_or(confidence < 0.3) AS is_low, bool_or(line % 29 = 3) AS has_warnings FROM ocr GROUP BY 1) SELECT * FROM j WHERE is_low OR has_warnings",
    "owned_history": f"""WITH {reports.JOBS}, h AS (SELECT job, owner, c_name || '_' || job AS filename, CASE WHEN job % 3 > 0 THEN 'Up-' || job END AS upload, status, created FROM jobs JOIN customer ON owner = c_custkey WHERE NOT is_deleted AND status = 'completed')
      SELECT * FROM h WHERE lower(filename) LIKE '%up-1%' OR lower(upload) LIKE '%up-1%' ORDER BY created DESC, job DESC""",
    "top_topics": f"WITH {AUDITED}, c AS (SELECT trim(topic) AS topic, count(*) AS n FROM audited WHERE trim(topic) <> '' GROUP BY 1) SELECT (row_number() OVER (ORDER BY n DESC, topic))::INT AS nth, topic, n FROM c ORDER BY n DESC, topic LIMIT 10",
    "tm_fallback": f"""{LOOKUP}, f AS (SELECT *, needs_review AND src_lang = 'english' AND tgt_lang = 'cebuano' AND length(text) % 2 = 0 AS new FROM found)
      SELECT * EXCLUDE (text, new) REPLACE (CASE WHEN new THEN 'F:' || text ELSE translated END AS translated, CASE WHEN new THEN 'fallback' ELSE method END AS method, CASE WHEN NOT new THEN confidence END AS confidence), CASE WHEN new THEN '{tm.FALLBACK_WARNING}' END AS warning FROM f""",
}
