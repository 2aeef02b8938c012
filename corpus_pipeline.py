"""A corpus pipeline of five stages over `documents`: quality rules, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, with every column of a row carried along whatever its name or type.
Nulls: rows with a null doc_id are kept like others; null text fails the quality rules. Empty tables pass through as empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.llm import jaccard, packing, quality, repeats, secrets
from polyglossa.llm.common import discard, keep, read_table, scratch
from polyglossa.session import ship_package


def _carried(docs: DataFrame) -> DataFrame:
    """The whole row beside its text, for operators that hand an id through."""
    ship_package(docs.sparkSession)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")


def _with_text(found: DataFrame, text: str, docs: DataFrame) -> DataFrame:
    """The columns of docs, their text replaced; n_chars follows the text."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*(new.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail."""
    return _with_text(quality.judge_documents(_carried(docs), id_col="row", with_text=True).filter("kept"), "cleaned", docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest doc_id, null last; of several of these, any one. Rows without words link with nothing and stay."""
    ship_package(spark)
    number = "row" + "_" * max(map(len, docs.columns))  # longer than any column's name
    rows = keep(spark, docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = jaccard.join_documents(rows, id_col=number).select(F.col("doc_id").alias("n"), "component_id")
    ids = rows.select(F.col(number).alias("n"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    kept = found.join(ids, "n").groupBy("component_id").agg(first).select(F.col("first.n").alias(number))
    return rows.join(kept, number, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that also start elsewhere."""
    return _with_text(repeats.strip_documents(_carried(docs), id_col="row", with_text=True), "kept", docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by [SECRET]."""
    return _with_text(secrets.scan_documents(_carried(docs), id_col="row", with_text=True), "masked", docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: BPE ids and line rules are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; scratch tables of a stage go once its result is written, and so do the rows of the stage before."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as made:
            found = keep(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # tables that the operator has removed already are no error
        discard(spark, *(x for x in made if x is not found), *([docs] if name != STAGES[0][0] else []))
        docs = found
    return docs
