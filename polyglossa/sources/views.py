"""Views over the driver's tables that feed the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.functions.text import normalize_lang, strip_diacritics
from polyglossa.operators.skew import evenly

#: Notes of phrasebook rows.
NOTES = ("", "auto-split from slash values", "manual check", "need to double check", "plural")
#: Unwanted pieces of text.
DIRT = ("", "\u200b", "\ufffd", "\u0007", "<b>", "&amp;", "  x", " Zo\u00eb", ".")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Non-blank lines of documents (the table's, or docs: doc_id, text, lang): doc_id, line_no (from 0), text, lang."""
    split = (table(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "lang", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "text"))
    return split.filter(F.btrim("text", F.lit(" \t\r\n")) != "").select("doc_id", "line_no", "text", "lang")


def memory(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """A translation memory of English: all benchmark lines and all lines of English documents, once each or as they come; row_pos orders them. Some have no second target."""
    marks = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("english")).filter(F.regexp_replace("english", r"[ \t\r\n]+", "") != "")
    own = lines(spark, sf_dir).filter("lang = 'en'").select(F.col("text").alias("english"))
    rows = marks.union(own)
    return (rows.distinct() if once else rows).select(
        F.unhex(F.md5("english")).alias("row_pos"), "english", F.concat(F.lit("T:"), "english").alias("filipino"),
        F.when(F.length("english") % 3 == 0, "").otherwise(F.concat(F.lit("C:"), "english")).alias("cebuano"),
    )


def queries(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All lines (of the table's documents, or of docs) with a disturbance by place (none, outer blanks, marks at the end, no diacritics), their language and the one asked for."""
    k, n = (F.col("doc_id") + F.col("line_no")) % 4, F.col("line_no") % 5
    text = F.when(k == 1, F.concat(F.lit("  "), "text", F.lit(" "))).when(k == 2, F.concat("text", F.lit("!!"))).when(k == 3, strip_diacritics(F.col("text"))).otherwise(F.col("text"))
    return lines(spark, sf_dir, docs).select(
        "doc_id", "line_no", text.alias("text"), normalize_lang(F.col("lang")).alias("src_lang"),
        F.when(n == 4, "english").when(n % 2 == 1, "cebuano").otherwise("filipino").alias("tgt_lang"),
    )


def phrasebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parts, whose few files are dealt over as many tasks as their rows ask for: pairs, variants and n-grams are made of each."""
    k = (F.col("p_size") % 10).cast("string")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_name", "p_brand")
    return evenly(part).select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 13 == 0, "").otherwise(F.col("p_type")).alias("topic"),
        F.concat_ws(" ", "p_name", k).alias("english"), F.concat_ws(" ", "p_brand", k).alias("tagabawa"),
        F.concat_ws(" ", "p_type", "p_name", k).alias("filipino"),
        F.when(F.col("p_size") == 7, "").otherwise(F.concat_ws(" ", "p_brand", "p_name", k)).alias("cebuano"),
        F.when(F.col("p_size") % 10 == 0, "phrase_sample").otherwise("phrasebook").alias("source"),
        F.element_at(F.array(*map(F.lit, NOTES)), (F.col("p_size") % 5 + 1).cast("int")).alias("notes"),
    )


def audit_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrasebook, and rows of it once more as an audit meets them: other case, outer blanks, null for blank, other meanings, odd characters."""
    book, n = phrasebook(spark, sf_dir), F.col("id")
    again = book.filter("id % 4 = 0").select(
        (n + 10_000_000).alias("id"), F.concat(F.lit(" "), "topic", F.lit(" ")).alias("topic"), F.when(n % 3 == 0, F.concat("english", F.lit(" <b>too"))).otherwise(F.upper("english")).alias("english"),
        F.concat(F.lower("tagabawa"), F.lit("\t")).alias("tagabawa"), F.when(n % 5 == 0, F.concat("filipino", F.lit("\x7f\ufffd"))).otherwise(F.col("filipino")).alias("filipino"),
        F.when(F.col("cebuano") != "", F.upper("cebuano")).alias("cebuano"), F.when(n % 7 > 0, F.col("source")).alias("source"), F.upper("notes").alias("notes"),
    )
    return book.union(again)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant's next: record_id, conv_id, source_text, target_text.

    Some conversations add a flawed copy: a repeated pair, a blank target, a copied source or a replacement character.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source_text"))
    given = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    kind = F.col("conv_id") % 7
    both = asked.join(given, ["conv_id", "turn"]).withColumn("nth", F.explode(F.when(kind < 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    flawed = F.when(kind == 0, F.col("answer")).when(kind == 1, "").when(kind == 2, F.col("source_text")).otherwise(F.concat("answer", F.lit("\ufffd")))
    return both.select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn", "nth").alias("record_id"), "conv_id", "source_text",
        F.when(F.col("nth") == 0, F.col("answer")).otherwise(flawed).alias("target_text"),
    )


def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents with an unwanted piece added by doc_id: doc_id, text."""
    pieces = F.array(*map(F.lit, DIRT))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.element_at(pieces, (F.col("doc_id") % len(DIRT) + 1).cast("int"))).alias("text"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines as an OCR engine gives them: doc_id, line, i, word, left, width, conf."""
    split = lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("line"), F.posexplode_outer(F.split("text", " ")).alias("i", "word"))
    return split.select("*", (F.col("i") * 30).alias("left"), (F.length("word") * 5).alias("width"), ((F.length("word") * 37 + F.col("i") * 11) % 112 - 10).alias("conf"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines placed on pages of 20: doc_id, page, block_no, x0, x1, y0, width, text."""
    n, d = F.col("line_no"), F.col("doc_id")
    x0 = F.when((d + n) % 7 < 4, 72).otherwise(350)
    y0 = 100 + 30 * (n % 20) - F.when((d * 7 + n) % 23 == 0, 40).otherwise(0)
    return lines(spark, sf_dir).select("doc_id", F.floor(n / 20).alias("page"), n.alias("block_no"), x0.alias("x0"), (x0 + 190).alias("x1"), y0.alias("y0"), F.lit(612).alias("width"), "text")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with types, boxes and, for two documents of three, a confidence: doc_id, page, block_no, type, x0, y0, x1, y1, text, confidence."""
    n = F.col("block_no")
    kind = F.when(n % 19 == 5, "table").when(n % 19 == 11, "drawing").when(n % 19 == 17, "image").otherwise("text")
    sure = F.when(F.col("doc_id") % 3 > 0, ((F.length("text") * 7 + n) % 101) / 100.0)
    return layout_blocks(spark, sf_dir).select("doc_id", "page", "block_no", kind.alias("type"), "x0", "y0", "x1", (F.col("y0") + 24).alias("y1"), "text", sure.alias("confidence"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 20 lines, blank ones too, and an empty one at the end: doc_id, page, issue."""
    last = F.floor((F.size(F.split("text", "\n")) - 1) / 20) + 1
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("page"))
    k = (F.col("doc_id") + F.col("page")) % 4
    return pages.withColumn("issue", F.when(k == 0, "error: no engine").when(k == 1, "low quality scan"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, owner, status, created, updated, is_deleted."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(k % 17 == 0, "retrying").when((s == "F") & (k % 3 == 0), "failed").when(s == "F", "completed").when(s == "O", "queued").otherwise("processing")
    return table(spark, sf_dir, "orders").select(
        k.alias("job"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderdate").alias("created"),
        F.timestamp_add("MINUTE", (k % 60).cast("int"), F.col("o_orderdate")).alias("updated"), (k % 11 == 0).alias("is_deleted"),
    )
