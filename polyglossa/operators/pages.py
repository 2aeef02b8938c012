"""Pages, blocks and boxes: geometry, page and document quality, routing, checks and rows of structures.

Blocks: doc_id, page, block_no, type, x0, y0, x1, y1, text, confidence (null if not scanned); pages: doc_id, page, width, height. Null texts read as
empty ones, empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglossa.functions.text import line_kind, stripped
from polyglossa.operators.layout import cer, pass_fail
from polyglossa.operators.metrics import wer


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _mean4(c: str) -> Column:
    """Mean to four places, halves up, in whole numbers, so that no order of rows matters; null without a value."""
    n = F.count(c)
    return F.floor(F.try_divide(2 * F.sum(F.round(F.col(c) * 10000).cast("long")) + n, 2 * n)) / 10000.0


def rotate_bbox(x0: Column, y0: Column, x1: Column, y1: Column, degrees: Column, width: Column, height: Column) -> Column:
    """The box in the frame of the page as it was (width, height), before it was turned by `degrees` clockwise to be read."""
    return (
        F.when(degrees == 180, _box(width - x1, height - y1, width - x0, height - y0)).when(degrees == 90, _box(y0, height - x1, y1, height - x0))
        .when(degrees == 270, _box(width - y1, x0, width - y0, x1)).otherwise(_box(x0, y0, x1, y1))
    )


def clip_bbox(box: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """Corners of an array of four numbers in order, padded, inside the page; null if nothing is left or there are not four."""
    lo = lambda i, most: F.least(F.greatest(F.least(box[i], box[i + 2]) - padding, F.lit(0.0)), most)
    hi = lambda i, most: F.least(F.greatest(F.greatest(box[i], box[i + 2]) + padding, F.lit(0.0)), most)
    made = _box(lo(0, width), lo(1, height), hi(0, width), hi(1, height))
    whole = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull())
    return F.when(whole & (hi(0, width) > lo(0, width)) & (hi(1, height) > lo(1, height)), made)


def text_alignment(x0: Column, x1: Column, block_x0: Column, block_x1: Column, explicit: Column | None = None) -> Column:
    """left, center or right: what the line says, else where it stands in its block."""
    wide, slack = block_x1 - block_x0, F.greatest(F.lit(6.0), (block_x1 - block_x0) * 0.08)
    free = F.coalesce(wide > x1 - x0 + 4, F.lit(False))
    placed = (
        F.when(~free, "left").when(F.abs(x1 - block_x1) <= slack, "right")
        .when(F.abs((x0 + x1) / 2 - (block_x0 + block_x1) / 2) <= slack, "center").otherwise("left")
    )
    if explicit is None:
        return placed
    said = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    return F.when(said.isin("center", "middle", "centre"), "center").when(said.isin("right", "end"), "right").otherwise(placed)


def ocr_blocks(lines: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, block, order (of first lines), n_lines, x0, y0, x1, y1, confidence (mean of lines, four places). lines: doc_id, line, x0, y0, x1, y1, confidence."""
    made = lines.groupBy("doc_id", F.floor(F.col("line") / size).alias("block")).agg(
        F.min("line").alias("first"), F.count("*").alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        _mean4("confidence").alias("confidence"),
    )
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return made.select("doc_id", "block", order.alias("order"), "n_lines", "x0", "y0", "x1", "y1", "confidence")


def _text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter("type = 'text'")


def blank_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page of pages without a text block that has a whole box."""
    whole = _text_blocks(blocks).filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    return pages.select("doc_id", "page").join(whole.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def page_qa(pages: DataFrame, blocks: DataFrame, truth: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """doc_id, page, n_chars, n_blocks, confidence, cer, wer, inversions, method, warning, verdict of every page.

    pages: doc_id, page and an issue (null if none); truth: doc_id, page, ref, hyp (pages without truth have no rates).
    """
    before = F.lag("y0").over(Window.partitionBy("doc_id", "page").orderBy("block_no"))
    sums = _text_blocks(blocks).withColumn("up", F.coalesce(F.col("y0") < before - tolerance, F.lit(False))).groupBy("doc_id", "page").agg(
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.count("*").alias("n_blocks"), F.count_if("up").alias("inversions"), F.count("confidence").alias("n_scanned"),
        _mean4("confidence").alias("confidence"),
    )
    rates = truth.select("doc_id", "page", F.round(cer(F.col("ref"), F.col("hyp")), 4).alias("cer"), F.round(wer(F.col("ref"), F.col("hyp")), 4).alias("wer"))
    none = F.lit(0).cast("long")
    return pages.join(sums, ["doc_id", "page"], "left").join(rates, ["doc_id", "page"], "left").select(
        "doc_id", "page", *(F.coalesce(c, none).alias(c) for c in ("n_chars", "n_blocks", "inversions")), "confidence", "cer", "wer",
        F.when(F.coalesce("n_scanned", none) > 0, "ocr_image").otherwise("direct_pdf_text").alias("method"), F.col("issue").alias("warning"), pass_fail(F.col("cer")).alias("verdict"),
    )


def document_qa(quality: DataFrame) -> DataFrame:
    """doc_id, n_pages, confidence, cer, wer (means of pages that have them), empty_rate, failed_pages, inversions. quality: what page_qa gives."""
    return quality.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), *(_mean4(c).alias(c) for c in ("confidence", "cer", "wer")),
        F.round(F.count_if(F.col("n_chars") == 0) / F.count("*"), 4).alias("empty_rate"), F.count_if(F.col("warning").startswith("error")).alias("failed_pages"), F.sum("inversions").alias("inversions"),
    )


def doc_type(pages: DataFrame, spans: DataFrame, file_type: DataFrame, min_chars: int = 50) -> DataFrame:
    """doc_id, kind: digital or scanned, by file type, mean characters of a page, or any visible span.

    pages: doc_id, n_chars; spans: doc_id, w, h, size, text; file_type: doc_id, file_type.
    """
    means = pages.groupBy("doc_id").agg((F.sum("n_chars") / F.greatest(F.count("*"), F.lit(1))).alias("mean"))
    seen = spans.filter((F.col("w") > 1) & (F.col("h") > 1) & (F.col("size") >= 3) & (stripped(F.col("text")) != "")).select("doc_id").distinct().withColumn("visible", F.lit(True))
    kind = F.when(F.col("file_type").isin("docx", "txt"), "digital").when(F.col("file_type") == "image", "scanned").when(F.col("mean") >= min_chars, "digital").when((F.col("mean") > 0) & F.coalesce("visible", F.lit(False)), "digital").otherwise("scanned")
    return file_type.join(means, "doc_id", "left").join(seen, "doc_id", "left").select("doc_id", kind.alias("kind"))


def extraction_method(routed: DataFrame) -> DataFrame:
    """doc_id, method (hybrid if pages differ), pages (`page=route` in order). routed: doc_id, page, route (digital or ocr)."""
    each = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "route"))), lambda x: F.concat_ws("=", x["page"], x["route"])), ",")
    made = routed.groupBy("doc_id").agg(F.count_if(F.col("route") == "ocr").alias("scanned"), F.count_if(F.col("route") == "digital").alias("digital"), each.alias("pages"))
    method = F.when((F.col("scanned") > 0) & (F.col("digital") > 0), "hybrid").when(F.col("scanned") > 0, "ocr_image").otherwise("direct_pdf_text")
    return made.select("doc_id", method.alias("method"), "pages")


def layout_validate(pages: DataFrame) -> DataFrame:
    """pages with `reason`: why a width or height (text or number) cannot be used; null if it can or is absent."""
    reason = F.lit(None).cast("string")
    for c in ("height", "width"):
        value = F.col(c).cast("string").try_cast("double")
        reason = F.when(F.col(c).isNotNull() & value.isNull(), f"invalid {c}").when(value <= 0, f"non-positive {c}").otherwise(reason)
    return pages.withColumn("reason", reason)


def untranslated_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, issue of pages that have an issue and no text to translate. pages: doc_id, page, issue."""
    some = _text_blocks(blocks).filter(stripped(F.col("text")) != "").select("doc_id", "page").distinct()
    return pages.filter("issue is not null").join(some, ["doc_id", "page"], "left_anti").select("doc_id", "page", "issue")


def page_coverage(source: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, n_source, n_layout, outcome: ok, missing_pages or no_text. source: doc_id, n_source."""
    text = (F.col("type") == "text") & (stripped(F.col("text")) != "")
    sums = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("n_layout"), F.count_if(text).alias("n_text"))
    none = F.lit(0).cast("long")
    outcome = F.when(F.coalesce("n_text", none) == 0, "no_text").when(F.col("n_source") != F.coalesce("n_layout", none), "missing_pages").otherwise("ok")
    return source.join(sums, "doc_id", "left").select("doc_id", "n_source", F.coalesce("n_layout", none).alias("n_layout"), outcome.alias("outcome"))


def layout_segments(blocks: DataFrame) -> DataFrame:
    """doc_id, segment (from 0 in page and block order), page, kind, x0, y0, text of text blocks with text; a line without a box has its block's."""
    kept = _text_blocks(blocks).filter(stripped(F.col("text")) != "")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block_no")) - 1
    return kept.select("doc_id", nth.alias("segment"), "page", line_kind(F.col("text")).alias("kind"), *(F.coalesce(f"line_{c}", c).alias(c) for c in ("x0", "y0")), F.trim("text").alias("text"))


def structure_blocks(blocks: DataFrame, languages: DataFrame) -> DataFrame:
    """doc_id, block_id (`p1_b2`), page, type, text, language, confidence (of scanned blocks). Blank text blocks go but count. languages: doc_id, block_no, found."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block_no"))
    named = blocks.withColumn("block_id", F.concat(F.lit("p"), F.col("page") + 1, F.lit("_b"), nth))
    kept = named.filter((F.col("type") != "text") | (stripped(F.col("text")) != "")).join(languages, ["doc_id", "block_no"], "left")
    text = F.col("type") == "text"
    return kept.select("doc_id", "block_id", "page", "type", F.when(text, F.trim("text")).alias("text"), F.when(text, F.col("found")).alias("language"), F.when(text, F.col("confidence")).alias("confidence"))


def page_text(blocks: DataFrame) -> DataFrame:
    """doc_id, page, text: the lines that are not blank, in order."""
    kept = _text_blocks(blocks).filter(stripped(F.col("text")) != "")
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def page_ocr(blocks: DataFrame, lines: DataFrame, low: float = 0.60) -> DataFrame:
    """doc_id, page, confidence (mean over blocks and lines), status, warnings (distinct, in order). blocks and lines: doc_id, page, nth, confidence."""
    both = blocks.select("doc_id", "page", "nth", "confidence").unionByName(lines.select("doc_id", "page", "nth", "confidence")).filter("confidence is not null")
    warned = F.when(F.col("confidence") < low, F.struct("nth", F.concat(F.lit("low "), F.col("nth")).alias("warning")))
    made = both.groupBy("doc_id", "page").agg(_mean4("confidence").alias("confidence"), F.transform(F.array_sort(F.collect_set(warned)), lambda x: x["warning"]).alias("w"))
    return made.select("doc_id", "page", "confidence", F.when(F.size("w") > 0, "pending_review").otherwise("accepted").alias("status"), F.array_join("w", "|").alias("warnings"))


def block_inventory(blocks: DataFrame, types: tuple[str, ...] = ("text", "image", "table", "drawing")) -> DataFrame:
    """doc_id, page and the number of blocks of each type, cells of tables (rows of text by bars) among them."""
    cells = F.sum(F.when(F.col("type") == "table", F.size(F.split(F.coalesce("text", F.lit("")), r"[ \t]+"))).otherwise(0)).alias("n_cells")
    return blocks.groupBy("doc_id", "page").agg(*(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types), cells)


def doc_warnings(*tables: DataFrame) -> DataFrame:
    """doc_id, warnings: those of all tables in order, each once, joined by bars. tables: doc_id, nth, warning; earlier tables come first."""
    parts = (t.select("doc_id", F.lit(k).alias("part"), "nth", "warning") for k, t in enumerate(tables))
    every = reduce(DataFrame.unionByName, parts).filter("warning is not null")
    first = every.groupBy("doc_id", "warning").agg(F.min(F.struct("part", "nth")).alias("at"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]), "|").alias("warnings"))


def paginate_paragraphs(paragraphs: DataFrame, per_page: int = 32) -> DataFrame:
    """doc_id, nth (from 0, of those that are not blank), page, y0, y1: paragraphs of 20 points below each other. paragraphs: doc_id, position, text."""
    kept = paragraphs.filter(stripped(F.col("text")) != "")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    placed = kept.select("doc_id", nth.alias("nth"))
    y0 = 72 + 20 * (F.col("nth") % per_page)
    return placed.select("doc_id", "nth", F.floor(F.col("nth") / per_page).alias("page"), y0.alias("y0"), (y0 + 20).alias("y1"))


def page_inventory(pages: DataFrame, blocks: DataFrame, types: tuple[str, ...] = ("text", "image", "table", "drawing")) -> DataFrame:
    """doc_id, page, blocks of each type, n_rows, n_columns, n_cells of tables and n_items of drawings, of every page; 0 on pages without blocks.

    pages: doc_id, page; blocks: doc_id, page, type, rows, columns, cells (of tables), items (of drawings). Nulls count as 0, blocks of other types as none.
    """
    parts = {"n_rows": ("table", "rows"), "n_columns": ("table", "columns"), "n_cells": ("table", "cells"), "n_items": ("drawing", "items")}
    sums = blocks.groupBy("doc_id", "page").agg(
        *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types), *(F.sum(F.when(F.col("type") == t, F.col(c))).cast("long").alias(name) for name, (t, c) in parts.items())
    )
    names = [*(f"n_{t}" for t in types), *parts]
    return pages.select("doc_id", "page").join(sums, ["doc_id", "page"], "left").select("doc_id", "page", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names))
