"""Layout and OCR tables, language identification by vocabulary, error rates. Null texts read as empty ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def lang_vocab(df: DataFrame, key: str = "lang") -> DataFrame:
    """Distinct lower-case tokens of each language. df: key, text."""
    return df.select(key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()


def dict_langid(df: DataFrame, vocab: DataFrame, threshold: float = 0.30, boost: float = 1.5) -> DataFrame:
    """doc_id, n_tokens, n_known, matched, confidence by the share of a document's distinct tokens that vocab (token) has."""
    own = df.select("doc_id", F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()
    known = own.join(vocab.select("token").distinct().withColumn("known", F.lit(1)), "token", "left")
    sums = known.groupBy("doc_id").agg(F.count("token").alias("n_tokens"), F.count("known").alias("n_known"))
    ratio = F.coalesce(F.try_divide("n_known", "n_tokens"), F.lit(0.0))
    return sums.select("doc_id", "n_tokens", "n_known", (ratio > threshold).alias("matched"), F.least(ratio * boost, F.lit(1.0)).alias("confidence"))


def txt_layout(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, y0, y1: lines of a text one below the other. lines: doc_id, line_no, text (not blank)."""
    height = F.least(F.greatest(16 + F.floor(F.length(F.trim("text")) / 4), F.lit(24)), F.lit(120))
    above = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("height", height).withColumn("y0", 72 + F.coalesce(F.sum(F.col("height") + 12).over(above), F.lit(0)))
    return placed.select("doc_id", "line_no", "y0", (F.col("y0") + F.col("height")).alias("y1"))


def _stretches(words: DataFrame, keys: list[str], least: list[str], most: list[str]) -> DataFrame:
    """Words that follow each other in a line (keys) put together before they are shuffled: keys, i (of the first), joined (by NUL), n, least, most, conf (their sum).

    A stretch ends where i does not go up by one; every word is one of its own where a value is null or a word holds NUL.
    """
    kind = dict(words.dtypes)
    total = "double" if kind["conf"] in ("float", "double") else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)
            if not any(b.column(c).null_count for c in ("i", *least, *most, "conf")) and not pc.any(pc.match_substring(b.column("word"), "\0")).as_py():
                new[1:] = np.diff(b.column("i").to_numpy()) != 1
                for k in keys:
                    differ = pc.fill_null(pc.not_equal(b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)), True)
                    new[1:] |= differ.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)

            def of(c: str, f: np.ufunc) -> pa.Array:
                if len(at) == b.num_rows:
                    return b.column(c)
                return pa.array(f.reduceat(b.column(c).to_numpy(), at))

            first = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(k).take(first) for k in keys), b.column("i").take(first), pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, b.num_rows].astype(np.int32)), b.column("word")), "\0"),
                    pa.array(np.diff(np.r_[at, b.num_rows]).astype(np.int64)), *(of(c, np.minimum) for c in least), *(of(c, np.maximum) for c in most),
                    of("conf", np.add).cast(pa.float64() if total == "double" else pa.int64()),
                ],
                [*keys, "i", "joined", "n", *least, *most, "conf"],
            )

    same = [*keys, "i"]
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in same), "joined string", "n long", *(f"`{c}` {kind[c]}" for c in (*least, *most)), f"conf {total}"])
    return words.select(*same, "word", *least, *most, "conf").mapInArrow(run, schema)


def _in_order() -> Column:
    """The text of a line's stretches, by i and word; an aggregate."""
    each = F.transform(F.collect_list(F.struct("i", "n", "joined")), lambda s: F.transform(F.when(s["n"] == 1, F.array(s["joined"])).otherwise(F.split(s["joined"], "\0")), lambda w, k: F.struct((s["i"] + k).alias("i"), w.alias("word"))))
    return F.array_join(F.transform(F.sort_array(F.flatten(each)), lambda x: x["word"]), " ")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words to lines: doc_id, line, text, x0, x1, n_words, confidence. Blank words and those with a negative confidence go."""
    kept = words.filter((F.trim("word") != "") & (F.col("conf") >= 0)).withColumn("right", F.col("left") + F.col("width"))
    made = _stretches(kept, ["doc_id", "line"], ["left"], ["right"]).groupBy("doc_id", "line").agg(
        _in_order().alias("text"), F.min("left").alias("x0"), F.max("right").alias("x1"), F.sum("n").alias("n_words"), F.sum("conf").alias("conf"),
    )
    return made.select("doc_id", "line", "text", "x0", "x1", "n_words", (F.col("conf") / F.col("n_words") / 100.0).alias("confidence"))


def ocr_summary(lines: DataFrame, low: float = 0.60) -> DataFrame:
    """doc_id, n_lines, n_low, min_confidence, warning."""
    sums = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("confidence") < low).alias("n_low"), F.min("confidence").alias("min_confidence"))
    return sums.withColumn("warning", F.col("n_low") > 0)


def reading_order(blocks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """doc_id, page, inversions: blocks that start above the one before them."""
    before = F.lag("y0").over(Window.partitionBy("doc_id", "page").orderBy("block_no"))
    return blocks.withColumn("up", F.coalesce(F.col("y0") < before - tolerance, F.lit(False))).groupBy("doc_id", "page").agg(F.count_if("up").alias("inversions"))


def two_column(blocks: DataFrame, frac: float = 0.45) -> DataFrame:
    """doc_id, page, n_left, n_right, two_column."""
    counts = blocks.groupBy("doc_id", "page").agg(F.count_if(F.col("x1") <= frac * F.col("width")).alias("n_left"), F.count_if(F.col("x0") >= (1 - frac) * F.col("width")).alias("n_right"))
    return counts.withColumn("two_column", (F.col("n_left") > 0) & (F.col("n_right") > 0))


def page_routing(blocks: DataFrame, min_chars: int = 50) -> DataFrame:
    """doc_id, page, n_chars (without white space), route."""
    chars = blocks.groupBy("doc_id", "page").agg(F.sum(F.length(F.translate(F.coalesce("text", F.lit("")), " \n\t", ""))).alias("n_chars"))
    return chars.withColumn("route", F.when(F.col("n_chars") >= min_chars, "digital").otherwise("ocr"))


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate without spaces: 0 for an empty reference, 1 at most."""
    r, h = (F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")) for c in (ref, hyp))
    return F.when(F.length(r) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.levenshtein(r, h), F.length(r))))


def pass_fail(rate: Column, threshold: float = 0.10) -> Column:
    return F.when(rate.isNull(), "skip").when(rate < threshold, "pass").otherwise("fail")


def ocr_line_boxes(words: DataFrame, dpi: int = 72) -> DataFrame:
    """doc_id, block, par, line, text, n_words, x0, y0, x1, y1 (in points), confidence (mean, 0 to 1, four places, halves up).

    words: doc_id, block, par, line, i (order), word, left, top, width, height in pixels, conf in per cent, as number or text. Blank words go, and
    those whose conf is negative, null or no number; a line without any other has no row.
    """
    conf = F.col("conf").cast("string").try_cast("double")
    kept = words.withColumns({"word": F.trim("word"), "conf": F.round(10000 * conf).cast("long")}).filter((F.col("word") != "") & (F.col("conf") >= 0))
    kept = kept.withColumns({"right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height")})
    n, total, scale = F.sum("n"), F.sum("conf"), 72.0 / dpi
    mean = F.floor((2 * total + 100 * n) / (200 * n)) / 10000.0
    place = ["doc_id", "block", "par", "line"]
    return _stretches(kept, place, ["left", "top"], ["right", "bottom"]).groupBy(*place).agg(
        _in_order().alias("text"), n.alias("n_words"),
        (F.min("left") * scale).alias("x0"), (F.min("top") * scale).alias("y0"), (F.max("right") * scale).alias("x1"), (F.max("bottom") * scale).alias("y1"),
        F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )


def ocr_document_summary(pages: DataFrame, blocks: DataFrame, low: float = 0.60) -> DataFrame:
    """doc_id, mean_confidence, min_confidence (four places, null without any), n_low, n_blocks, warning, n_pages of every document with a page.

    Only blocks with a confidence that is a number count; the warning is given if the mean or any of them is low. pages: doc_id, page; blocks: doc_id, confidence.
    """
    rated = blocks.select("doc_id", F.col("confidence").cast("string").try_cast("double").alias("c")).filter("c is not null")
    n = F.count("*")
    mean = F.floor(F.try_divide(2 * F.sum(F.round(F.col("c") * 10000).cast("long")) + n, 2 * n)) / 10000.0
    sums = rated.groupBy("doc_id").agg(mean.alias("mean_confidence"), F.round(F.min("c"), 4).alias("min_confidence"), F.count_if(F.col("c") < low).alias("n_low"), n.alias("n_blocks"))
    counts, none = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages")), F.lit(0).cast("long")
    warning = F.coalesce((F.col("mean_confidence") < low) | (F.col("n_low") > 0), F.lit(False))
    return counts.join(sums, "doc_id", "left").select("doc_id", "mean_confidence", "min_confidence", *(F.coalesce(c, none).alias(c) for c in ("n_low", "n_blocks")), warning.alias("warning"), "n_pages")
