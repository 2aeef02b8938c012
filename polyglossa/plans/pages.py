"""Registered queries of metrics, pages and boxes, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.functions import text
from polyglossa.operators import layout, metrics, pages
from polyglossa.plans.sql import BOOK, LINES
from polyglossa.sources import views


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.phrasebook(spark, sf_dir).select("id", F.col("tagabawa").alias("source"), F.col("english").alias("ref"), F.col("filipino").alias("hyp"))


def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select("id", metrics.wer(F.col("ref"), F.col("hyp")).alias("wer"))


def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_bleu(_predicted(spark, sf_dir))


def corpus_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_chrf(_predicted(spark, sf_dir))


def sentence_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sentence_chrf(_predicted(spark, sf_dir))


def prediction_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir)
    return metrics.prediction_review(rows.select("id", "hyp"), rows.select("id", "source", "ref"))


def display_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with translations that are blank, marked or of a method that has none, by place."""
    k = (F.col("doc_id") + F.col("line_no")) % 6
    target = F.when(k == 0, " ​").when(k == 1, "x Byt5_Unavailable").when(k == 2, "[UNKNOWN_FOR_REVIEW]").otherwise(F.concat(F.lit("T⁠:"), "text"))
    method = F.when(k == 3, " Untranslated").otherwise("exact_phrase")
    stage = F.when(k == 4, "untranslated_needs_review")
    return views.lines(spark, sf_dir).select("doc_id", "line_no", F.md5(text.display_text(F.col("text"), target, method, stage)).alias("shown"), text.is_fallback(target, method, stage).alias("fallback"))


def color_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = ((F.col("p_partkey") * 7919) % 16777216).cast("int")
    rgb = text.color_rgb(packed)
    triple = text.color_triple(F.array(*((F.col("p_size") * k / F.when(F.col("p_size") % 2 == 0, 1).otherwise(500)).cast("double") for k in (1, 5, 9))))
    return views.table(spark, sf_dir, "part").select("p_partkey", *(rgb[k].alias(c) for k, c in enumerate("rgb")), *(triple[k].alias(f"{c}3") for k, c in enumerate("rgb")))


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).groupBy("lang", text.line_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.ocr_lines(views.ocr_words(spark, sf_dir))
    return pages.ocr_blocks(lines.withColumn("y0", 20 * F.col("line")).withColumn("y1", 20 * F.col("line") + 12))


def rotate_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = F.element_at(F.array(*map(F.lit, (0, 90, 180, 270))), (F.col("block_no") % 4 + 1).cast("int"))
    box = pages.rotate_bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), degrees, F.lit(612), F.lit(792))
    return views.page_blocks(spark, sf_dir).select("doc_id", "block_no", box.alias("b")).select("doc_id", "block_no", "b.*")


def clip_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = (F.col("block_no") % 9) * 40.0
    box = F.array(F.col("x1") + shift, F.col("y0") - shift, F.col("x0") + shift, F.col("y1") - 300.0)
    clipped = pages.clip_bbox(box, F.lit(612.0), F.lit(792.0), 2.0)
    return views.page_blocks(spark, sf_dir).select("doc_id", "block_no", clipped.alias("b")).select("doc_id", "block_no", "b.*")


def text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("block_no") % 5
    said = F.when(F.col("doc_id") % 4 == 0, F.when(n == 0, " Centre").when(n == 1, "END").otherwise(""))
    left = F.when(n % 3 == 2, 40.0).otherwise(10.0)
    placed = pages.text_alignment(F.col("x0") + n * 12.0, F.col("x1") - 40.0, F.col("x0") - left, F.when(n < 4, F.col("x1") - 40.0 + n * 12), said)
    return views.page_blocks(spark, sf_dir).select("doc_id", "block_no", placed.alias("alignment"))


def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.blank_pages(views.pages_of(spark, sf_dir), views.page_blocks(spark, sf_dir))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.substring(F.regexp_replace("text", "[^ -~]", ""), 1, 60)
    return pages.page_text(views.page_blocks(spark, sf_dir)).select("doc_id", "page", ref.alias("ref"), F.translate(ref, "e", "o").alias("hyp"))


def page_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_qa(views.pages_of(spark, sf_dir), views.page_blocks(spark, sf_dir), _truth(spark, sf_dir).filter("page < 2"))


def document_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.document_qa(page_qa(spark, sf_dir))


def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "image", "pdf", "txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = views.table(spark, sf_dir, "documents").select("doc_id", kinds.alias("file_type"))
    blocks = views.page_blocks(spark, sf_dir)
    size = F.col("block_no") % 6
    spans = blocks.filter("type = 'text'").select("doc_id", (F.col("x1") - F.col("x0")).alias("w"), F.lit(24).alias("h"), size.alias("size"), "text")
    chars = blocks.withColumn("c", F.when(F.col("doc_id") % 2 == 0, F.length("text")).otherwise(F.lit(1))).groupBy("doc_id", "page").agg(F.sum("c").alias("n_chars"))
    return pages.doc_type(chars, spans, files)


def extraction_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extraction_method(layout.page_routing(views.layout_blocks(spark, sf_dir)))


def layout_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") * 3 + F.col("page")) % 7
    width = F.when(k == 0, "wide").when(k == 1, "-1").when(k == 2, None).otherwise("612")
    height = F.when(k == 3, "0").when(k == 4, " ").otherwise("792.5")
    return pages.layout_validate(views.pages_of(spark, sf_dir).select("doc_id", "page", width.alias("width"), height.alias("height")))


def untranslated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.untranslated_pages(views.pages_of(spark, sf_dir), views.page_blocks(spark, sf_dir))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = views.pages_of(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_source"))
    return pages.page_coverage(source, views.page_blocks(spark, sf_dir))


def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.col("block_no") % 3 == 0
    blocks = views.page_blocks(spark, sf_dir).withColumn("line_x0", F.when(inner, F.col("x0") + 5)).withColumn("line_y0", F.when(inner, F.col("y0") + 1))
    return pages.layout_segments(blocks).withColumn("text", F.md5("text"))


def structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("block_no"), text.normalize_lang(F.col("lang")).alias("found"))
    return pages.structure_blocks(views.page_blocks(spark, sf_dir), found).withColumn("text", F.md5("text"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_text(views.page_blocks(spark, sf_dir))


def page_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = views.page_blocks(spark, sf_dir).select("doc_id", "page", F.col("block_no").alias("nth"), "confidence")
    return pages.page_ocr(blocks, blocks.withColumn("confidence", 1 - F.col("confidence")))


def block_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.block_inventory(views.page_blocks(spark, sf_dir))


def doc_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_pages = views.pages_of(spark, sf_dir).select("doc_id", F.col("page").cast("long").alias("nth"), F.col("issue").alias("warning"))
    of_blocks = views.page_blocks(spark, sf_dir).filter("confidence < 0.1").select("doc_id", F.col("block_no").cast("long").alias("nth"), F.concat(F.lit("low confidence on page "), F.col("page")).alias("warning"))
    return pages.doc_warnings(of_pages, of_blocks)


def paginate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paginate_paragraphs(views.lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("position"), "text"))


QUERIES = {
    f.__name__: f
    for f in (
        wer, corpus_bleu, corpus_chrf, sentence_chrf, prediction_review, display_translation, color_rgb, line_kinds, ocr_blocks, rotate_bbox, clip_bbox, text_alignment,
        blank_pages, page_qa, document_qa, doc_type, extraction_method, layout_validate, untranslated_pages, page_coverage, layout_segments, structure_blocks,
        page_text, page_ocr, block_inventory, doc_warnings, paginate_paragraphs,
    )
}

def _mean(c: str) -> str:
    return f"floor((2 * sum(round({c} * 10000)::BIGINT)::BIGINT + count({c})) / nullif(2 * count({c}), 0)) / 10000.0::DOUBLE"


_PRED = f"{BOOK}, pred AS (SELECT id, tagabawa AS source, english AS ref, filipino AS hyp FROM book)"
_RATE = "CASE WHEN len({r}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, levenshtein(list_aggregate(list_transform({r}, lambda w: chr(32 + list_position({k}, w)::INT)), 'string_agg', ''), coalesce(list_aggregate(list_transform({h}, lambda w: chr(32 + list_position({k}, w)::INT)), 'string_agg', ''), '')) / len({r})) END"
_WORDS = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
_13A = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || {c} || ' ', '([{{-~\[-` -&(-+:-@/])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda w: w <> '')"
_CHARS = """grams AS (SELECT id, n, substr(t, i, n) AS gram, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r
    FROM (SELECT id, side, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT id, 'h' AS side, regexp_replace(hyp, '\\s+', '', 'g') AS t FROM pred UNION ALL SELECT id, 'r', regexp_replace(ref, '\\s+', '', 'g') FROM pred), (VALUES (1), (2), (3), (4), (5), (6)) AS v(n)) GROUP BY 1, 2, 3)"""
_SENTENCE = f"""{_CHARS}, per AS (SELECT id, n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM grams GROUP BY 1, 2),
  mean AS (SELECT id, coalesce(sum(m / h) FILTER (WHERE h > 0 AND r > 0) / count(*) FILTER (WHERE h > 0 AND r > 0), 0) AS p, coalesce(sum(m / r) FILTER (WHERE h > 0 AND r > 0) / count(*) FILTER (WHERE h > 0 AND r > 0), 0) AS q FROM per GROUP BY 1),
  scored AS (SELECT id, round(CASE WHEN p + q > 0 THEN 100 * (5 * p * q / (4 * p + q)) ELSE 0.0 END, 2)::DOUBLE AS chrf FROM mean)"""
_BLOCKS = f"""{LINES}, blocks AS (SELECT doc_id, line_no // 20 AS page, line_no AS block_no, text, CASE line_no % 19 WHEN 5 THEN 'table' WHEN 11 THEN 'drawing' WHEN 17 THEN 'image' ELSE 'text' END AS type,
  CASE WHEN (doc_id + line_no) % 7 < 4 THEN 72 ELSE 350 END AS x0, x0 + 190 AS x1, 100 + 30 * (line_no % 20) - CASE WHEN (doc_id * 7 + line_no) % 23 = 0 THEN 40 ELSE 0 END AS y0, y0 + 24 AS y1,
  CASE WHEN doc_id % 3 > 0 THEN ((length(text) * 7 + line_no) % 101) / 100.0::DOUBLE END AS confidence FROM lines),
  paged AS (SELECT doc_id, unnest(range((len(string_split(text, chr(10))) - 1) // 20 + 2)) AS page FROM documents),
  sheets AS (SELECT doc_id, page, CASE (doc_id + page) % 4 WHEN 0 THEN 'error: no engine' WHEN 1 THEN 'low quality scan' END AS issue FROM paged)"""
_TEXT = "regexp_replace(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(8288), ''), '[ \\t\\r\\n]+', '', 'g') <> ''"
_QA = f"""{_BLOCKS}, own AS (SELECT doc_id, page, substr(regexp_replace(string_agg(text, chr(10) ORDER BY block_no), '[^ -~]', '', 'g'), 1, 60) AS ref FROM blocks WHERE type = 'text' AND page < 2 GROUP BY 1, 2),
  worded AS (SELECT *, {_WORDS.format(c="ref")} AS r, {_WORDS.format(c="translate(ref, 'e', 'o')")} AS h, list_distinct(r || h) AS k, replace(ref, ' ', '') AS rc FROM own),
  rates AS (SELECT doc_id, page, round(CASE WHEN rc = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, levenshtein(rc, translate(rc, 'e', 'o')) / length(rc)) END, 4) AS cer, round({_RATE.format(r='r', h='h', k='k')}, 4) AS wer FROM worded),
  ups AS (SELECT *, y0 < lag(y0) OVER (PARTITION BY doc_id, page ORDER BY block_no) - 5 AS up FROM blocks WHERE type = 'text'),
  sums AS (SELECT doc_id, page, sum(length(text))::BIGINT AS n_chars, count(*) AS n_blocks, count(*) FILTER (WHERE up) AS inversions, count(confidence) AS n_scanned, {_mean('confidence')} AS confidence FROM ups GROUP BY 1, 2),
  qa AS (SELECT doc_id, page, coalesce(n_chars, 0) AS n_chars, coalesce(n_blocks, 0) AS n_blocks, coalesce(inversions, 0) AS inversions, confidence, cer, wer, CASE WHEN coalesce(n_scanned, 0) > 0 THEN 'ocr_image' ELSE 'direct_pdf_text' END AS method, issue AS warning,
    CASE WHEN cer IS NULL THEN 'skip' WHEN cer < 0.1 THEN 'pass' ELSE 'fail' END AS verdict FROM sheets LEFT JOIN sums USING (doc_id, page) LEFT JOIN rates USING (doc_id, page))"""


ORACLE_SQL = {
    "wer": f"WITH {_PRED}, w AS (SELECT id, {_WORDS.format(c='ref')} AS r, {_WORDS.format(c='hyp')} AS h, list_distinct(r || h) AS k FROM pred) SELECT id, {_RATE.format(r='r', h='h', k='k')} AS wer FROM w",
    "corpus_bleu": f"""WITH {_PRED}, toks AS (SELECT id, 'h' AS side, {_13A.format(c='hyp')} AS t FROM pred UNION ALL SELECT id, 'r', {_13A.format(c='ref')} FROM pred),
      g AS (SELECT id, n, array_to_string(t[i : i + n - 1], ' ') AS gram, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r FROM (SELECT id, side, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM toks, (VALUES (1), (2), (3), (4)) AS v(n)) GROUP BY 1, 2, 3),
      s AS (SELECT v.n, coalesce(sum(least(h, r)), 0) AS m, coalesce(sum(h), 0) AS h, coalesce(sum(r), 0) AS r FROM (VALUES (1), (2), (3), (4)) AS v(n) LEFT JOIN g ON v.n = g.n GROUP BY 1),
      z AS (SELECT *, sum((m = 0)::INT) OVER (ORDER BY n) AS halves FROM s), a AS (SELECT sum(ln(CASE WHEN m > 0 THEN m::DOUBLE ELSE pow(0.5, halves) END / nullif(h, 0))) AS logs, max(CASE WHEN n = 1 THEN m END) AS m1, max(CASE WHEN n = 1 THEN h END) AS h1, max(CASE WHEN n = 1 THEN r END) AS r1, min(h) AS least_h FROM z)
      SELECT round(CASE WHEN m1 > 0 AND least_h > 0 THEN 100 * exp(logs / 4 + CASE WHEN h1 < r1 THEN 1 - r1 / h1 ELSE 0 END) ELSE 0 END, 4)::DOUBLE AS bleu, h1::BIGINT AS n_hyp, r1::BIGINT AS n_ref FROM a""",
    "corpus_chrf": f"""WITH {_PRED}, {_CHARS}, per AS (SELECT n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM grams GROUP BY 1), mean AS (SELECT sum(m / h) / count(*) AS p, sum(m / r) / count(*) AS q FROM per WHERE h > 0 AND r > 0)
      SELECT round(coalesce(100 * (5 * p * q / (4 * p + q)), 0), 4)::DOUBLE AS chrf FROM mean""",
    "sentence_chrf": f"WITH {_PRED}, {_SENTENCE} SELECT id, coalesce(chrf, 0.0)::DOUBLE AS chrf FROM pred LEFT JOIN scored USING (id)",
    "prediction_review": f"WITH {_PRED}, {_SENTENCE} SELECT id, source, ref AS reference, hyp AS prediction, trim(hyp) = trim(ref) AS exact_match, coalesce(chrf, 0.0)::DOUBLE AS chrf, 'needs_review' AS review_status FROM pred LEFT JOIN scored USING (id)",
    "display_translation": f"WITH {LINES} SELECT doc_id, line_no, md5(translate(CASE WHEN (doc_id + line_no) % 6 < 5 THEN text ELSE 'T:' || text END, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(8288), '')) AS shown, (doc_id + line_no) % 6 < 5 AS fallback FROM lines",
    "color_rgb": "WITH p AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS c, p_size / CASE WHEN p_size % 2 = 0 THEN 1 ELSE 500 END AS s, CASE WHEN s * 9 > 1 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM part) SELECT p_partkey, "
    + ", ".join(f"round(((c >> {b}) & 255) / 255.0::DOUBLE, 4) AS {n}" for b, n in ((16, "r"), (8, "g"), (0, "b")))
    + ", " + ", ".join(f"round(least(greatest(p_size * {m} / CASE WHEN p_size % 2 = 0 THEN 1 ELSE 500 END / k, 0), 1), 4)::DOUBLE AS {n}3" for m, n in ((1, "r"), (5, "g"), (9, "b"))) + " FROM (SELECT p.*, p_size FROM p JOIN part USING (p_partkey))",
    "line_kinds": f"WITH {LINES} SELECT lang, CASE WHEN regexp_matches(trim(text), '^[0-9•*-]') THEN 'list_item' ELSE 'text' END AS kind, count(*) AS n FROM lines GROUP BY 1, 2",
    "ocr_blocks": f"""WITH {LINES}, words AS (SELECT doc_id, line_no AS line, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM lines), rated AS (SELECT *, (length(word) * 37 + i * 11) % 112 - 10 AS conf FROM words WHERE trim(word) <> ''),
      o AS (SELECT doc_id, line, min(i * 30) AS x0, max(i * 30 + length(word) * 5) AS x1, sum(conf)::DOUBLE / count(*) / 100.0::DOUBLE AS confidence FROM rated WHERE conf >= 0 GROUP BY 1, 2),
      b AS (SELECT doc_id, line // 5 AS block, min(line) AS first, count(*) AS n_lines, min(x0) AS x0, min(20 * line) AS y0, max(x1) AS x1, max(20 * line + 12) AS y1, {_mean('confidence')} AS confidence FROM o GROUP BY 1, 2)
      SELECT doc_id, block, (row_number() OVER (PARTITION BY doc_id ORDER BY first))::INT AS "order", n_lines, x0, y0, x1, y1, confidence FROM b""",
    "rotate_bbox": f"""WITH {_BLOCKS} SELECT doc_id, block_no, CASE block_no % 4 WHEN 0 THEN x0 WHEN 1 THEN y0 WHEN 2 THEN 612 - x1 ELSE 612 - y1 END AS x0, CASE block_no % 4 WHEN 0 THEN y0 WHEN 1 THEN 792 - x1 WHEN 2 THEN 792 - y1 ELSE x0 END AS y0,
      CASE block_no % 4 WHEN 0 THEN x1 WHEN 1 THEN y1 WHEN 2 THEN 612 - x0 ELSE 612 - y0 END AS x1, CASE block_no % 4 WHEN 0 THEN y1 WHEN 1 THEN 792 - x0 WHEN 2 THEN 792 - y0 ELSE x1 END AS y1 FROM blocks""",
    "clip_bbox": f"""WITH {_BLOCKS}, s AS (SELECT doc_id, block_no, (block_no % 9) * 40.0::DOUBLE AS s, x0, x1, y0, y1 FROM blocks), c AS (SELECT doc_id, block_no, least(greatest(x0 + s - 2, 0), 612) AS a, least(greatest(least(y0 - s, y1 - 300) - 2, 0), 792) AS b,
      least(greatest(x1 + s + 2, 0), 612) AS c, least(greatest(greatest(y0 - s, y1 - 300) + 2, 0), 792) AS d FROM s) SELECT doc_id, block_no, CASE WHEN c > a AND d > b THEN a END AS x0, CASE WHEN c > a AND d > b THEN b END AS y0, CASE WHEN c > a AND d > b THEN c END AS x1, CASE WHEN c > a AND d > b THEN d END AS y1 FROM c""",
    "text_alignment": f"""WITH {_BLOCKS}, l AS (SELECT doc_id, block_no, block_no % 5 AS n, x0 + (block_no % 5) * 12 AS a, x1 - 40 AS b, x0 - CASE WHEN (block_no % 5) % 3 = 2 THEN 40 ELSE 10 END AS p, CASE WHEN block_no % 5 < 4 THEN x1 - 40 + (block_no % 5) * 12 END AS q FROM blocks)
      SELECT doc_id, block_no, CASE WHEN doc_id % 4 = 0 AND n = 0 THEN 'center' WHEN doc_id % 4 = 0 AND n = 1 THEN 'right' WHEN NOT coalesce(q - p > b - a + 4, false) THEN 'left' WHEN abs(b - q) <= greatest(6.0, (q - p) * 0.08) THEN 'right' WHEN abs((a + b) / 2 - (p + q) / 2) <= greatest(6.0, (q - p) * 0.08) THEN 'center' ELSE 'left' END AS alignment FROM l""",
    "blank_pages": f"WITH {_BLOCKS} SELECT doc_id, page FROM paged ANTI JOIN (SELECT doc_id, page FROM blocks WHERE type = 'text') b USING (doc_id, page)",
    "page_qa": f"WITH {_QA} SELECT * FROM qa",
    "document_qa": f"WITH {_QA} SELECT doc_id, count(*) AS n_pages, {_mean('confidence')} AS confidence, {_mean('cer')} AS cer, {_mean('wer')} AS wer, round(count(*) FILTER (WHERE n_chars = 0) / count(*), 4) AS empty_rate, count(*) FILTER (WHERE warning LIKE 'error%') AS failed_pages, sum(inversions)::BIGINT AS inversions FROM qa GROUP BY 1",
    "doc_type": f"""WITH {_BLOCKS}, m AS (SELECT doc_id, avg(n) AS mean FROM (SELECT doc_id, page, sum(CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE 1 END) AS n FROM blocks GROUP BY 1, 2) GROUP BY 1), v AS (SELECT DISTINCT doc_id FROM blocks WHERE type = 'text' AND block_no % 6 >= 3)
      SELECT d.doc_id, CASE WHEN d.doc_id % 5 IN (1, 4) THEN 'digital' WHEN d.doc_id % 5 = 2 THEN 'scanned' WHEN mean >= 50 THEN 'digital' WHEN mean > 0 AND v.doc_id IS NOT NULL THEN 'digital' ELSE 'scanned' END AS kind FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN v ON d.doc_id = v.doc_id""",
    "extraction_method": f"""WITH {_BLOCKS}, r AS (SELECT doc_id, page, CASE WHEN sum(length(translate(text, ' ' || chr(10) || chr(9), ''))) >= 50 THEN 'digital' ELSE 'ocr' END AS route FROM blocks GROUP BY 1, 2)
      SELECT doc_id, CASE WHEN count(DISTINCT route) = 2 THEN 'hybrid' WHEN min(route) = 'ocr' THEN 'ocr_image' ELSE 'direct_pdf_text' END AS method, string_agg(page || '=' || route, ',' ORDER BY page) AS pages FROM r GROUP BY 1""",
    "layout_validate": f"""WITH {_BLOCKS}, k AS (SELECT doc_id, page, (doc_id * 3 + page) % 7 AS k FROM paged) SELECT doc_id, page, CASE k WHEN 0 THEN 'wide' WHEN 1 THEN '-1' WHEN 2 THEN NULL ELSE '612' END AS width, CASE k WHEN 3 THEN '0' WHEN 4 THEN ' ' ELSE '792.5' END AS height,
      CASE k WHEN 0 THEN 'invalid width' WHEN 1 THEN 'non-positive width' WHEN 3 THEN 'non-positive height' WHEN 4 THEN 'invalid height' END AS reason FROM k""",
    "untranslated_pages": f"WITH {_BLOCKS} SELECT doc_id, page, issue FROM sheets ANTI JOIN (SELECT doc_id, page FROM blocks WHERE type = 'text' AND {_TEXT}) b USING (doc_id, page) WHERE issue IS NOT NULL",
    "page_coverage": f"WITH {_BLOCKS}, s AS (SELECT doc_id, count(*) AS n_source FROM paged GROUP BY 1), l AS (SELECT doc_id, count(DISTINCT page) AS n_layout, count(*) FILTER (WHERE type = 'text' AND {_TEXT}) AS n_text FROM blocks GROUP BY 1) SELECT doc_id, n_source, coalesce(n_layout, 0) AS n_layout, CASE WHEN coalesce(n_text, 0) = 0 THEN 'no_text' WHEN n_source <> n_layout THEN 'missing_pages' ELSE 'ok' END AS outcome FROM s LEFT JOIN l USING (doc_id)",
    "layout_segments": f"WITH {_BLOCKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, block_no) - 1)::INT AS segment, page, CASE WHEN regexp_matches(trim(text), '^[0-9•*-]') THEN 'list_item' ELSE 'text' END AS kind, x0 + CASE WHEN block_no % 3 = 0 THEN 5 ELSE 0 END AS x0, y0 + CASE WHEN block_no % 3 = 0 THEN 1 ELSE 0 END AS y0, md5(trim(text)) AS text FROM blocks WHERE type = 'text' AND {_TEXT}",
    "structure_blocks": f"""WITH {_BLOCKS}, n AS (SELECT b.*, 'p' || (page + 1) || '_b' || row_number() OVER (PARTITION BY b.doc_id, b.page ORDER BY b.block_no) AS block_id, lang FROM blocks b JOIN lines l ON b.doc_id = l.doc_id AND b.block_no = l.line_no)
      SELECT doc_id, block_id, page, type, CASE WHEN type = 'text' THEN md5(trim(text)) END AS text, CASE WHEN type = 'text' THEN CASE lang WHEN 'en' THEN 'english' ELSE lang END END AS language, CASE WHEN type = 'text' THEN confidence END AS confidence FROM n WHERE type <> 'text' OR {_TEXT}""",
    "page_text": f"WITH {_BLOCKS} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks WHERE type = 'text' AND {_TEXT} GROUP BY 1, 2",
    "page_ocr": f"""WITH {_BLOCKS}, b AS (SELECT doc_id, page, block_no AS nth, confidence FROM blocks WHERE confidence IS NOT NULL UNION ALL SELECT doc_id, page, block_no, 1 - confidence FROM blocks WHERE confidence IS NOT NULL),
      c AS (SELECT doc_id, page, {_mean('confidence')} AS confidence FROM b GROUP BY 1, 2), w AS (SELECT doc_id, page, string_agg('low ' || nth, '|' ORDER BY nth) AS warnings FROM (SELECT DISTINCT doc_id, page, nth FROM b WHERE confidence < 0.6) GROUP BY 1, 2)
      SELECT doc_id, page, confidence, CASE WHEN warnings IS NULL THEN 'accepted' ELSE 'pending_review' END AS status, coalesce(warnings, '') AS warnings FROM c LEFT JOIN w USING (doc_id, page)""",
    "block_inventory": f"WITH {_BLOCKS} SELECT doc_id, page, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in ("text", "image", "table", "drawing")) + ", sum(CASE WHEN type = 'table' THEN len(regexp_split_to_array(text, '[ \\t]+')) ELSE 0 END)::BIGINT AS n_cells FROM blocks GROUP BY 1, 2",
    "doc_warnings": f"""WITH {_BLOCKS}, w AS (SELECT doc_id, 0 AS part, page AS nth, issue AS warning FROM sheets WHERE issue IS NOT NULL UNION ALL SELECT doc_id, 1, block_no, 'low confidence on page ' || page FROM blocks WHERE confidence < 0.1),
      f AS (SELECT doc_id, warning, min({{'part': part, 'nth': nth}}) AS place FROM w GROUP BY 1, 2) SELECT doc_id, string_agg(warning, '|' ORDER BY place, warning) AS warnings FROM f GROUP BY 1""",
    "paginate_paragraphs": f"WITH {LINES}, n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS nth FROM lines WHERE {_TEXT}) SELECT doc_id, nth, (nth // 32)::BIGINT AS page, 72 + 20 * (nth % 32) AS y0, 92 + 20 * (nth % 32) AS y1 FROM n",
}
