"""Registered queries of text expressions, audits and pairs, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.functions import text
from polyglossa.operators import audit, pairs
from polyglossa.plans.sql import AUDITED, BOOK, CLASS, DIRTY, LINES, MARKS, PAIRS, SIZES, SPACE, directed, flags_sql, split_sql
from polyglossa.sources import views


def clean_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dirty_cells(spark, sf_dir).select("doc_id", F.md5(text.clean_invisible(F.col("text"))).alias("cleaned"))


def normalize_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("doc_id", "line_no", F.md5(text.lookup_text(F.col("text"))).alias("key"))


def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("doc_id", "line_no", F.md5(text.strip_diacritics(F.col("text"))).alias("plain"))


def lookup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).groupBy(F.size(text.lookup_variants(F.col("text"))).alias("variants")).agg(F.count("*").alias("n"))


def normalize_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").groupBy(text.normalize_lang(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


def notes_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.phrasebook(spark, sf_dir).select("id", text.notes_flags(F.col("notes")).alias("f")).select("id", "f.*")


def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_coverage(views.audit_book(spark, sf_dir))


def audit_field_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_field_dups(views.audit_book(spark, sf_dir))


def audit_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_unicode(views.dirty_cells(spark, sf_dir))


def audit_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_diacritics(views.lines(spark, sf_dir))


def audit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_alignment(views.pairs(spark, sf_dir), "source_text", "target_text").select("record_id", "n_left", "n_right", "ratio")


def audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_sources(views.audit_book(spark, sf_dir))


def _two_books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Samples and the rest of the book, and the field they are compared by."""
    book = views.audit_book(spark, sf_dir)
    sample = F.coalesce(F.col("source"), F.lit("")) == "phrase_sample"
    return book.filter(sample), book.filter(~sample), "tagabawa"


def audit_cross_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_cross_leak(*_two_books(spark, sf_dir))


def audit_left_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_left_only(*_two_books(spark, sf_dir))


def audit_unicode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_unicode_rows(views.audit_book(spark, sf_dir))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_report(views.audit_book(spark, sf_dir), "id % 6 = 0")


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_rows(views.phrasebook(spark, sf_dir))


def audit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_quality(views.phrasebook(spark, sf_dir))


def validate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.validate_pairs(views.pairs(spark, sf_dir))


def clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.clean_pairs(views.pairs(spark, sf_dir))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrasebook with some texts marked for review."""
    marked = F.when((F.col("id") % 19 == 0) & (F.col("cebuano") != ""), F.concat(F.lit("[UNKNOWN_FOR_REVIEW] "), "cebuano")).otherwise(F.col("cebuano"))
    return views.phrasebook(spark, sf_dir).withColumn("cebuano", marked)


def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.translation_pairs(_marked(spark, sf_dir))


def leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.leakage_groups(views.phrasebook(spark, sf_dir))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.hash_split(leakage_groups(spark, sf_dir), "group_id")


def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by place in the book and brand besides those of equal texts: some hold many rows."""
    book = views.phrasebook(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, F.substring("tagabawa", 1, 8)).otherwise(F.floor(F.col("id") / (F.col("id") % 4 + 1)).cast("string")).alias("group_id"))
    return pairs.balanced_split(book, "group_id")


def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.hash_split(views.pairs(spark, sf_dir).select("record_id"), "record_id")


def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.hash_split(views.pairs(spark, sf_dir).select("record_id", "conv_id"), "conv_id")


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.split_manifest(row_split(spark, sf_dir))


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.split_leakage(pairs.hash_split(translation_pairs(spark, sf_dir), "record_id"))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.split_overlap(pairs.hash_split(translation_pairs(spark, sf_dir), "record_id"), "row_id")


def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.model_records(clean_pairs(spark, sf_dir), "translate: ")


def phrasebook_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = views.phrasebook(spark, sf_dir)
    return pairs.phrasebook_upsert(book.filter("source = 'phrasebook'").filter("id % 3 <> 0"), book)


def phrasebook_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the book with a few entries twice; the batch is the whole book, each row of every fifth once more with other notes."""
    book = views.phrasebook(spark, sf_dir)
    old = book.filter("source = 'phrasebook' AND id % 3 <> 0").withColumn("needs_review", F.lit(False))
    old = old.union(old.filter("id % 50 = 1").withColumn("notes", F.lit("twice")))
    batch = book.withColumn("row", F.col("id") * 2).unionByName(book.filter("id % 5 = 0").withColumn("row", F.col("id") * 2 + 1).withColumn("notes", F.lit("Manual check again")))
    return pairs.phrasebook_merge(old, batch)


def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.export_report(_marked(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        clean_invisible, normalize_lookup, strip_diacritics, lookup_variants, normalize_lang, notes_flags, audit_coverage, audit_field_dups, audit_unicode,
        audit_diacritics, audit_alignment, audit_sources, audit_cross_leak, audit_left_only, audit_unicode_rows, audit_report, audit_rows, audit_quality, validate_pairs, clean_pairs, translation_pairs,
        leakage_groups, group_split, balanced_split, row_split, source_split, split_manifest, split_leakage, split_overlap, model_records, phrasebook_upsert, phrasebook_merge, export_report,
    )
}

_RAW = f"lower(regexp_replace(translate(text, '{text.INVISIBLE}', ''), '^{SPACE}|{SPACE}$', '', 'g'))"
_NORM = rf"trim(regexp_replace(regexp_replace({_RAW}, '[^\p{{L}}\p{{N}}_ \t\r\n-]', '', 'g'), '{SPACE}', ' ', 'g'), ' ')"


def _plain(c: str) -> str:
    return rf"regexp_replace(translate({c}, '{text.MARKED}', '{text.PLAIN}'), '\p{{Mn}}', '', 'g')"


def _key(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{SPACE}', ' ', 'g'))"


_LANGS = audit.LANGS
_CELLS = "cells AS (SELECT lang, text FROM book, LATERAL (VALUES " + ", ".join(f"('{c}', {c})" for c in _LANGS) + ") AS v(lang, text))"
_USABLE = "trim(source_text) <> '' AND trim(target_text) <> '' AND trim(source_text) <> trim(target_text)"
_CLEAN = f"clean AS (SELECT * FROM pairs WHERE {_USABLE} QUALIFY row_number() OVER (PARTITION BY source_text, target_text ORDER BY record_id) = 1)"
_DIRECTED = f"WITH {BOOK}, {MARKS}, directed AS ({directed(_LANGS)})"
_EDGES = " UNION ALL ".join(f"SELECT id, '{a}-{b}' AS kind, {_key(a)} AS x, {_key(b)} AS y FROM book WHERE trim({a}) <> '' AND trim({b}) <> ''" for i, a in enumerate(_LANGS) for b in _LANGS[i + 1 :])
_GROUPS = f"""WITH RECURSIVE {BOOK}, keys AS ({_EDGES}), star AS (SELECT DISTINCT id AS u, min(id) OVER (PARTITION BY kind, x, y) AS v FROM keys),
  e AS (SELECT u, v FROM star WHERE u <> v UNION SELECT v, u FROM star WHERE u <> v),
  reach(id, g) AS (SELECT id, id FROM book UNION SELECT reach.id, e.v FROM reach JOIN e ON reach.g = e.u),
  groups AS (SELECT id, min(g) AS group_id FROM reach GROUP BY id)"""
_KEYS4 = ", ".join(_LANGS)
_HAD, _SAME = ", ".join(f"h.{c}" for c in _LANGS), " AND ".join(f"h.{c} = l.{c}" for c in _LANGS)

_CLEAR = "lower(trim(coalesce({0}, ''), E' \\t\\r\\n'))"
_ACELLS = "acells AS (SELECT id, lang, coalesce(text, '') AS text FROM audited, LATERAL (VALUES " + ", ".join(f"('{c}', {c})" for c in _LANGS) + ") AS v(lang, text))"
_ISSUE = {
    "replacement": "contains(text, chr(65533))", "control": r"regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')", "html": "regexp_matches(lower(text), '<[a-z]|&[a-z]+;')", "double_space": "contains(text, '  ')",
}
_BOOKS = f"""a AS (SELECT DISTINCT {_CLEAR.format('tagabawa')} AS key FROM audited WHERE source = 'phrase_sample' AND {_CLEAR.format('tagabawa')} <> ''),
  b AS (SELECT DISTINCT {_CLEAR.format('tagabawa')} AS key FROM audited WHERE coalesce(source, '') <> 'phrase_sample' AND {_CLEAR.format('tagabawa')} <> '')"""
_NOTES = " UNION ALL ".join(f"SELECT '{k}' AS value, count(*) AS n FROM audited WHERE lower(coalesce(notes, '')) LIKE '%{w}%' HAVING count(*) > 0" for k, w in audit.NOTE_KINDS.items())
_WHOLE = " AND ".join(f"{_CLEAR.format(c)} <> ''" for c in _LANGS)
_WORDS = "len(list_filter(regexp_split_to_array(coalesce({0}, ''), '" + SPACE + "'), lambda w: w <> ''))"


def _same(name: str, keys: str) -> str:
    return f"""SELECT '{name}' AS section, unnest(['groups', 'extra_rows']) AS metric, unnest([count(*), sum(n - 1)::BIGINT]) AS n FROM (SELECT count(*) AS n FROM audited GROUP BY {keys} HAVING count(*) > 1) HAVING count(*) > 0"""


_REPORT = f"""WITH {AUDITED}, {_ACELLS} SELECT 'counts' AS section, 'total' AS metric, count(*) AS n FROM audited UNION ALL SELECT 'counts', 'complete', count(*) FROM audited WHERE {_WHOLE} UNION ALL SELECT 'counts', 'missing_any', count(*) FROM audited WHERE NOT ({_WHOLE})
  UNION ALL SELECT 'counts', 'flagged', count(*) FROM audited WHERE id % 6 = 0
  UNION ALL SELECT 'coverage', CASE WHEN trim(text) = '' THEN 'missing_' ELSE '' END || lang, count(*) FROM acells GROUP BY 2
  UNION ALL SELECT 'types', lang || '_' || {CLASS}, count(*) FROM (SELECT lang, {SIZES} FROM acells) GROUP BY 2
  UNION ALL {" UNION ALL ".join(f"SELECT 'unicode', '{k}', count(*) FROM acells WHERE {e} HAVING count(*) > 0" for k, e in _ISSUE.items())}
  UNION ALL {_same('same_row', ', '.join(_CLEAR.format(c) for c in _LANGS))} UNION ALL {_same('same_english', _CLEAR.format('english'))} UNION ALL {_same('same_tagabawa', _CLEAR.format('tagabawa'))}
  UNION ALL SELECT 'polysemy', 'groups', count(*) FROM (SELECT 1 FROM audited WHERE {_CLEAR.format('tagabawa')} <> '' GROUP BY {_CLEAR.format('tagabawa')} HAVING count(DISTINCT {_CLEAR.format('english')}) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'alignment', 'outliers', count(*) FROM (SELECT {_WORDS.format('tagabawa')} AS x, {_WORDS.format('english')} AS y FROM audited) WHERE x > 0 AND y > 0 AND (x / y > 5 OR x / y < 0.2) HAVING count(*) > 0
  UNION ALL SELECT 'sources', coalesce(source, ''), count(*) FROM audited GROUP BY 2 UNION ALL SELECT 'topics', trim(topic), count(*) FROM audited GROUP BY 2 UNION ALL SELECT 'notes', value, n FROM ({_NOTES})"""

ORACLE_SQL = {
    "audit_coverage": f"WITH {AUDITED}, {_ACELLS} SELECT lang, count(*) FILTER (WHERE trim(text) <> '') AS present, count(*) FILTER (WHERE trim(text) = '') AS missing FROM acells GROUP BY 1",
    "audit_field_dups": f"WITH {AUDITED}, {_ACELLS} SELECT lang, sum(n - 1)::BIGINT AS extra_rows FROM (SELECT lang, count(*) AS n FROM acells GROUP BY lang, {_CLEAR.format('text')}) GROUP BY 1",
    "audit_unicode": f"WITH {DIRTY} SELECT {', '.join(f'count(*) FILTER (WHERE {e}) AS {k}' for k, e in _ISSUE.items())} FROM dirty",
    "audit_unicode_rows": f"WITH {AUDITED}, {_ACELLS}, i AS (SELECT id, lang, concat_ws('|', {', '.join(f"CASE WHEN {e} THEN '{k}' END" for k, e in _ISSUE.items())}) AS issues FROM acells) SELECT * FROM i WHERE issues <> ''",
    "audit_sources": f"WITH {AUDITED} SELECT 'source' AS kind, coalesce(source, '') AS value, count(*) AS n FROM audited GROUP BY 2 UNION ALL SELECT 'topic', trim(topic), count(*) FROM audited GROUP BY 2 UNION ALL SELECT 'notes', value, n FROM ({_NOTES})",
    "audit_cross_leak": f"WITH {AUDITED}, {_BOOKS}, s AS (SELECT count(*) AS n_left, count(*) FILTER (WHERE key IN (SELECT key FROM b)) AS n_shared FROM a) SELECT n_left, n_shared, n_left - n_shared AS n_left_only, n_left = n_shared AS subset FROM s",
    "audit_left_only": f"WITH {AUDITED}, {_BOOKS} SELECT key FROM a WHERE key NOT IN (SELECT key FROM b)",
    "audit_report": _REPORT,
    "clean_invisible": f"WITH {DIRTY} SELECT doc_id, md5(translate(text, '{text.INVISIBLE}', '')) AS cleaned FROM dirty",
    "normalize_lookup": f"WITH {LINES} SELECT doc_id, line_no, md5({_NORM}) AS key FROM lines",
    "strip_diacritics": f"WITH {LINES} SELECT doc_id, line_no, md5({_plain('text')}) AS plain FROM lines",
    "lookup_variants": f"WITH {LINES} SELECT len(list_distinct(list_filter([{_RAW}, {_NORM}, {_plain(_NORM)}], lambda x: x <> '')))::INT AS variants, count(*) AS n FROM lines GROUP BY 1",
    "normalize_lang": "SELECT CASE lang WHEN 'en' THEN 'english' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY 1",
    "notes_flags": f"WITH {BOOK} SELECT id, {flags_sql('notes')} AS flags, (notes LIKE '%manual check%' OR notes LIKE '%double check%' OR notes LIKE '%review%') AS review_import, (notes LIKE '%need to double check%' OR notes LIKE '%manual check%') AS review_export FROM book",
    "audit_diacritics": f"WITH {LINES} SELECT lang, count(*) FILTER (WHERE {_plain('text')} <> text) AS marked, count(*) AS n FROM lines GROUP BY 1",
    "audit_alignment": f"WITH {PAIRS}, sized AS (SELECT record_id, len(list_filter(regexp_split_to_array(source_text, '{SPACE}'), lambda w: w <> ''))::INT AS n_left, len(list_filter(regexp_split_to_array(target_text, '{SPACE}'), lambda w: w <> ''))::INT AS n_right FROM pairs) SELECT record_id, n_left, n_right, round(n_left / n_right, 2) AS ratio FROM sized WHERE n_left > 0 AND n_right > 0 AND (n_left / n_right > 5 OR n_left / n_right < 0.2)",
    "audit_rows": f"WITH {BOOK}, sized AS (SELECT *, tagabawa AS text FROM book), classed AS (SELECT *, {SIZES} FROM sized) SELECT id, {CLASS} AS record_class, {flags_sql('notes')} AS flags, count(*) OVER (PARTITION BY lower(trim(english)), lower(trim(tagabawa)), lower(trim(filipino)), lower(trim(cebuano))) > 1 AS is_exact_dup, cebuano <> '' AS complete FROM classed",
    "audit_quality": f"WITH {BOOK} SELECT count(*) AS total, count(*) FILTER (WHERE notes LIKE '%auto-split%') AS auto_split, round(100.0 * count(*) FILTER (WHERE notes LIKE '%auto-split%') / count(*), 2)::DOUBLE AS auto_split_pct, count(*) FILTER (WHERE notes LIKE '%manual check%' OR notes LIKE '%double check%') AS review_import, count(*) FILTER (WHERE notes LIKE '%need to double check%' OR notes LIKE '%manual check%') AS review_export FROM book",
    "validate_pairs": f"""WITH {PAIRS}, p AS (SELECT record_id, trim(source_text) AS s, trim(target_text) AS t, count(*) OVER (PARTITION BY trim(source_text), trim(target_text)) AS n FROM pairs)
      SELECT 'rows' AS finding, count(*) AS n FROM p UNION ALL SELECT 'blank_source', count(*) FROM p WHERE s = '' UNION ALL SELECT 'blank_target', count(*) FROM p WHERE t = ''
      UNION ALL SELECT 'duplicate_pair_rows', count(*) FROM p WHERE n > 1 UNION ALL SELECT 'copy_through', count(*) FROM p WHERE s = t AND s <> ''
      UNION ALL SELECT 'replacement', count(*) FROM p WHERE contains(s || t, chr(65533)) UNION ALL SELECT 'usable', count(*) FROM p WHERE s <> '' AND t <> '' AND s <> t
      UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT record_id FROM p GROUP BY 1 HAVING count(*) > 1)""",
    "clean_pairs": f"WITH {PAIRS}, {_CLEAN} SELECT record_id, conv_id, source_text, target_text FROM clean",
    "translation_pairs": f"{_DIRECTED} SELECT * FROM directed",
    "leakage_groups": f"{_GROUPS} SELECT * FROM groups",
    "group_split": f"""{_GROUPS} SELECT id, group_id, {split_sql('group_id')} AS split FROM groups""",
    # one group after the other, so plainly the rule; ranks of a size are of the whole size
    "balanced_split": f"""WITH RECURSIVE {BOOK}, rows AS (SELECT id, CASE WHEN id % 3 = 0 THEN left(tagabawa, 8) ELSE floor(id / (id % 4 + 1))::BIGINT::VARCHAR END AS group_id FROM book),
      sizes AS (SELECT group_id, count(*) AS n, md5('42:' || group_id) AS key FROM rows GROUP BY 1), seq AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM sizes),
      t AS (SELECT round_even(count(*) * 0.8, 0)::BIGINT AS a, round_even(count(*) * 0.1, 0)::BIGINT AS b, count(*) AS total FROM rows),
      run(i, n, ca, cb, cc, split) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' UNION ALL
        SELECT i, n, ca + CASE WHEN split = 'train' THEN n ELSE 0 END, cb + CASE WHEN split = 'dev' THEN n ELSE 0 END, cc + CASE WHEN split = 'test' THEN n ELSE 0 END, split FROM (
          SELECT seq.i, seq.n, ca, cb, cc, CASE WHEN (a - ca) * 10000000 - ca >= greatest((b - cb) * 10000000 - cb, (total - a - b - cc) * 10000000 - cc) THEN 'train'
            WHEN (b - cb) * 10000000 - cb >= (total - a - b - cc) * 10000000 - cc THEN 'dev' ELSE 'test' END AS split FROM run JOIN seq ON seq.i = run.i + 1, t)),
      ends AS (SELECT n, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'dev') AS dev FROM run WHERE i > 0 GROUP BY 1),
      named AS (SELECT group_id, CASE WHEN r <= train THEN 'train' WHEN r <= train + dev THEN 'dev' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY key, group_id) AS r FROM sizes) JOIN ends USING (n))
      SELECT id, group_id, split FROM rows JOIN named USING (group_id)""",
    "row_split": f"WITH {PAIRS} SELECT record_id, {split_sql('record_id')} AS split FROM pairs",
    "source_split": f"WITH {PAIRS} SELECT record_id, conv_id, {split_sql('conv_id')} AS split FROM pairs",
    "split_manifest": f"WITH {PAIRS}, s AS (SELECT {split_sql('record_id')} AS split, count(*) AS n FROM pairs GROUP BY 1) SELECT split, n, round(n / sum(n) OVER (), 4)::DOUBLE AS ratio FROM s",
    "split_leakage": f"{_DIRECTED} SELECT source_lang, target_lang, {_key('source_text')} AS source_key, {_key('target_text')} AS target_key, array_to_string(list_sort(list(DISTINCT {split_sql('record_id')})), '|') AS splits FROM directed GROUP BY ALL HAVING count(DISTINCT {split_sql('record_id')}) > 1",
    "split_overlap": f"{_DIRECTED} SELECT row_id, count(DISTINCT {split_sql('record_id')}) AS n_splits FROM directed GROUP BY 1 HAVING count(DISTINCT {split_sql('record_id')}) > 1",
    "model_records": f"WITH {PAIRS}, {_CLEAN} SELECT record_id, 'translate: ' || source_text AS source_text, target_text FROM clean",
    "phrasebook_upsert": f"""WITH {BOOK}, old AS (SELECT {_KEYS4}, count(*) AS n_old FROM book WHERE source = 'phrasebook' AND id % 3 <> 0 GROUP BY ALL), new AS (SELECT {_KEYS4}, count(*) AS n_new FROM book GROUP BY ALL),
      j AS (SELECT n_new, coalesce(n_old, 0) AS n_old FROM new LEFT JOIN old USING ({_KEYS4}))
      SELECT 'created' AS outcome, count(*) FILTER (WHERE n_old = 0) AS n FROM j UNION ALL SELECT 'failed', coalesce(sum(n_new) FILTER (WHERE n_old > 1), 0)::BIGINT FROM j
      UNION ALL SELECT 'updated', coalesce(sum(n_new - (n_old = 0)::INT) FILTER (WHERE n_old <= 1), 0)::BIGINT FROM j""",
    "phrasebook_merge": f"""WITH {BOOK}, old AS (SELECT *, false AS needs_review FROM book WHERE source = 'phrasebook' AND id % 3 <> 0), twice AS (SELECT * FROM old UNION ALL SELECT * REPLACE ('twice' AS notes) FROM old WHERE id % 50 = 1),
      had AS (SELECT *, count(*) OVER (PARTITION BY {_KEYS4}) AS n_old FROM twice), batch AS (SELECT *, id * 2 AS row FROM book UNION ALL SELECT * REPLACE ('Manual check again' AS notes), id * 2 + 1 FROM book WHERE id % 5 = 0),
      put AS (SELECT *, notes ILIKE '%manual check%' OR notes ILIKE '%double check%' OR notes ILIKE '%review%' AS needs_review, row_number() OVER (PARTITION BY {_KEYS4} ORDER BY row DESC) AS back, count(*) OVER (PARTITION BY {_KEYS4}) AS n FROM batch),
      last AS (SELECT * FROM put WHERE back = 1), known AS (SELECT DISTINCT {_KEYS4}, n_old FROM had)
      SELECT {_HAD}, h.topic, h.source, h.notes, h.needs_review, 'kept' AS outcome, 0::BIGINT AS n FROM had h WHERE n_old > 1 OR NOT EXISTS (SELECT 1 FROM last l WHERE {_SAME})
      UNION ALL SELECT {_HAD}, l.topic, l.source, l.notes, l.needs_review, 'updated', l.n FROM had h JOIN last l ON {_SAME} WHERE n_old = 1
      UNION ALL SELECT {_KEYS4}, topic, source, notes, needs_review, 'created', n FROM last l WHERE NOT EXISTS (SELECT 1 FROM known h WHERE {_SAME})
      UNION ALL SELECT {_KEYS4}, topic, source, notes, needs_review, 'failed', 1 FROM put l WHERE EXISTS (SELECT 1 FROM known h WHERE n_old > 1 AND {_SAME})""",
    "export_report": f"{_DIRECTED}, {_CELLS} SELECT 'missing_' || lang AS metric, count(*) FILTER (WHERE trim(text) = '') AS n FROM cells GROUP BY 1 UNION ALL SELECT 'pairs_' || source_lang || '_' || target_lang, count(*) FROM directed GROUP BY 1 UNION ALL SELECT 'rows', count(*) FROM book",
}
