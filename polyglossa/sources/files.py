"""Files in and out: phrasebooks as JSON and CSV, pairs, JSON lines, splits, reports, structures, uploaded documents.

Missing paths are errors of the reader. All text columns are strings as written: no value is taken for a null or a number.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyglossa.functions.text import canonical_header, engine_label, method_label

LANGS = ("english", "tagabawa", "filipino", "cebuano")
#: Keys of a JSON object that may hold the rows, in order; columns of a phrasebook beside its languages.
ROW_KEYS, META = ("rows", "entries", "data", "phrases"), ("id", "record_id", "topic", "source", "notes")
def _page_1252() -> dict[str, str]:
    """Latin-1 characters of 0x80 to 0x9F and what Windows' code page 1252 has in their place, where it has any."""
    pairs = ((chr(b), bytes([b]).decode("cp1252", errors="ignore")) for b in range(0x80, 0xA0))
    return dict(pairs)


PAGE_1252 = _page_1252()
#: File types by extension, and what a DOCX archive must hold.
FILE_TYPES = {"pdf": "pdf", "docx": "docx", "txt": "txt", "jpg": "image", "jpeg": "image", "png": "image"}
DOCX_MEMBERS = {"[Content_Types].xml", "word/document.xml"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _clean(c: str) -> Column:
    return F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))


def normalize_rows(df: DataFrame, langs: tuple[str, ...] = LANGS) -> DataFrame:
    """`<language>_source` for each language from any column that names it, the canonical one first; rows without any language go. Other columns stay."""
    named = {c: canonical_header(c) for c in df.columns}
    out = {}
    for lang in langs:
        target = f"{lang}_source"
        sources = sorted((c for c, n in named.items() if n == target), key=lambda c: (c.lower() != target, df.columns.index(c)))
        out[target] = F.coalesce(*map(_clean, sources), F.lit("")) if sources else F.lit("")
    rest = [F.col(f"`{c}`") for c, n in named.items() if n not in out]
    some = F.array(*(F.col(c) for c in out))
    return df.select(*rest, *(v.alias(k) for k, v in out.items())).filter(F.exists(some, lambda x: x != ""))


def read_phrasebook_json(spark: SparkSession, path: str, langs: tuple[str, ...] = LANGS) -> DataFrame:
    """Rows of a list of objects, or of an object's first key among ROW_KEYS whose rows name a language; normalized."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    names = lambda columns: any(canonical_header(c) in {f"{x}_source" for x in langs} for c in columns)
    if not names(df.columns):
        for key in ROW_KEYS:
            kind = df.schema[key].dataType if key in df.columns else None
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and names(kind.elementType.names):
                df = df.select(F.inline(key))
                break
        else:
            return spark.createDataFrame([], T.StructType([T.StructField(f"{x}_source", T.StringType()) for x in langs]))
    return normalize_rows(df, langs)


def read_phrasebook_csv(spark: SparkSession, path: str, langs: tuple[str, ...] = LANGS) -> DataFrame:
    """Normalized rows with the columns of META that the file has; empty if no header names a language."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.select(*(F.col(f"`{c}`").alias(c.replace("\ufeff", "").strip()) for c in df.columns))
    kept = [c for c in df.columns if canonical_header(c) or c.strip().lower() in META]
    made = normalize_rows(df.select(*(F.col(f"`{c}`") for c in kept)), langs)
    return made.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lower()) for c in made.columns))


def union_corpora(primary: DataFrame, secondary: DataFrame, source: str = "text_corpus", role: str = "secondary") -> DataFrame:
    """Both corpora with dataset_role and row_pos; rows of the first come before all of the second. Either: row_pos (long, its own order) and any columns."""
    second = secondary.withColumn("source", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(source)) if "source" in secondary.columns else F.lit(source))
    both = primary.withColumn("dataset_role", F.lit("primary")).unionByName(second.withColumn("dataset_role", F.lit(role)), allowMissingColumns=True)
    return both.withColumn("row_pos", F.struct((F.col("dataset_role") != "primary").cast("int").alias("corpus"), F.col("row_pos").alias("row")))


def decoded(content: Column) -> Column:
    """Text of bytes as UTF-8 without its mark, else as code page 1252, else as Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    undefined = "[" + "".join(f"\\x{{{ord(k):x}}}" for k, v in PAGE_1252.items() if not v) + "]"
    known = {k: v for k, v in PAGE_1252.items() if v}
    legacy = F.when(latin.rlike(undefined), latin).otherwise(F.translate(latin, "".join(known), "".join(known.values())))
    return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(legacy), "^\ufeff", "")


def ingest_legacy_csv(spark: SparkSession, path: str, langs: tuple[str, ...] = LANGS, source: str = "phrasebook") -> DataFrame:
    """id (from 1 in file order), topic, languages, source, notes of CSV files in any of three encodings; rows with nothing in any of them go."""
    columns = ["topic", *langs, "source", "notes"]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, text in zip(f["path"], f["text"]):
                rows = csv.reader(io.StringIO(text, newline=""))
                header = [(canonical_header(h) or h.strip().lower()).removesuffix("_source") for h in next(rows, [])]
                made = [[path, nth, *(dict(zip(header, r)).get(c, "").strip() for c in columns)] for nth, r in enumerate(rows)]
                yield pd.DataFrame(made, columns=["path", "nth", *columns])

    texts = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))
    rows = texts.mapInPandas(parse, "path string, nth long, " + ", ".join(f"{c} string" for c in columns))
    some = F.exists(F.array("topic", *langs, "notes"), lambda x: x != "")
    ids = F.row_number().over(Window.partitionBy("path").orderBy("nth"))
    filled = F.when(F.col("source") == "", source).otherwise(F.col("source"))
    return rows.filter(some).select("path", ids.alias("id"), "topic", *langs, filled.alias("source"), "notes")


def load_pair_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """All columns as text, nothing taken for a null; a missing column is an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.replace("\ufeff", "")) for c in df.columns))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines go."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")


def export_splits(df: DataFrame, path: str, fmt: str = "json", split_col: str = "split") -> None:
    """All rows under `all`, and each split in its own folder under `splits`."""
    options = {"header": True, "escape": '"'} if fmt == "csv" else {"ignoreNullFields": False}
    df.write.format(fmt).options(**options).save(f"{path}/all")
    df.write.format(fmt).options(**options).partitionBy(split_col).save(f"{path}/splits")


def write_report(df: DataFrame, path: str, fmt: str = "json", most: int = 100) -> str | None:
    """A report as JSON or CSV in one file; with fmt 'md' the table's text of at most `most` rows, which the caller keeps where it likes."""
    if fmt != "md":
        df.coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)
        return None
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def validate_files(files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """path, file_type, ok, reason, sha256 of binaryFile rows (path, length, content): type, size, first bytes, members of archives, encoding."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held = []
            for content in f["content"]:
                try:
                    held.append(DOCX_MEMBERS <= set(zipfile.ZipFile(io.BytesIO(content)).namelist()))
                except (zipfile.BadZipFile, ValueError):
                    held.append(False)
            yield pd.DataFrame({"zip_path": f["path"], "whole": held})

    kinds = F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv))
    typed = files.withColumn("file_type", F.element_at(kinds, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))))
    zips = typed.filter("file_type = 'docx' and length <= " + str(most_bytes)).select("path", "content").mapInPandas(members, "zip_path string, whole boolean")
    head = lambda n: F.hex(F.substring("content", 1, n))
    wrong = (
        F.when(F.col("file_type").isNull(), "unsupported type").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large")
        .when((F.col("file_type") == "pdf") & (head(5) != "255044462D"), "not a PDF").when((F.col("file_type") == "docx") & ~F.coalesce("whole", F.lit(False)), "not a DOCX")
        .when((F.col("file_type") == "txt") & ~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
        .when((F.col("file_type") == "image") & (head(3) != "FFD8FF") & (head(8) != "89504E470D0A1A0A"), "not an image")
    )
    return typed.join(zips, F.col("path") == F.col("zip_path"), "left").select("path", "file_type", wrong.isNull().alias("ok"), wrong.alias("reason"), F.sha2("content", 256).alias("sha256"))


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """path, position, text, heading of every paragraph of DOCX archives (path, content); files that are none give no rows."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                rows = []
                for nth, p in enumerate(root.iter(f"{_W}p")):
                    style = p.find(f"{_W}pPr/{_W}pStyle")
                    heading = style is not None and bool(re.match("heading", style.get(f"{_W}val", ""), re.IGNORECASE))
                    rows.append((path, nth, "".join(t.text or "" for t in p.iter(f"{_W}t")), heading))
                yield pd.DataFrame(rows, columns=["path", "position", "text", "heading"])

    return files.select("path", "content").mapInPandas(read, "path string, position long, text string, heading boolean")


#: Schema of a job's structure.
STRUCTURE = (
    "extraction_method string, warnings array<string>, pages array<struct<page_number: long, width: double, height: double, blocks: array<struct<type: string, confidence: double, "
    "lines: array<struct<source_text: string, translated_text: string, translation_method: string, translation_confidence: double>>>>>>"
)


def flatten_structure(structures: DataFrame) -> dict[str, DataFrame]:
    """pages, ocr and segments of structures (job, structure as JSON text); segments are numbered from 1 in page, block and line order, blank source lines go."""
    parsed = structures.select("job", F.from_json("structure", STRUCTURE).alias("s"))
    pages = parsed.select("job", method_label(F.col("s.extraction_method")).alias("method"), F.posexplode("s.pages").alias("page_pos", "p"))
    number = F.coalesce("p.page_number", F.col("page_pos") + 1)
    blocks = pages.select("job", "method", number.alias("page"), "page_pos", F.posexplode_outer("p.blocks").alias("block_pos", "b"))
    lines = blocks.select("job", "page", "page_pos", "block_pos", F.posexplode("b.lines").alias("line_pos", "l")).filter(F.trim(F.coalesce("l.source_text", F.lit(""))) != "")
    nth = F.row_number().over(Window.partitionBy("job").orderBy("page_pos", "block_pos", "line_pos"))
    ocr = blocks.groupBy("job", "page").agg(F.count("b").alias("n_blocks"), F.round(F.avg("b.confidence"), 4).alias("confidence"), F.first(engine_label(F.col("method"))).alias("engine"))
    return {
        "pages": pages.select("job", number.alias("page"), "p.width", "p.height", F.size(F.coalesce("p.blocks", F.array())).alias("n_blocks")),
        "ocr": ocr,
        "segments": lines.select("job", nth.alias("segment_index"), "page", F.trim("l.source_text").alias("source"), F.coalesce("l.translated_text", F.lit("")).alias("translated"), F.col("l.translation_method").alias("method"), F.col("l.translation_confidence").alias("confidence")),
    }
