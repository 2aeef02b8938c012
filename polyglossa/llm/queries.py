"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, crosstoken, fingerprints, infill, jaccard, licences, neighbours, packing, quality, repeats, secrets, sharding, toxicity
from .common import read_table

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read_table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(read_table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(read_table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(read_table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip_documents(read_table(spark, sf_dir, "documents"))


def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_digest(read_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_digest(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_secrets, op2_jaccard, op3_neighbours, op4_bpe, op5_sharding, op6_packing, op7_toxicity, op8_quality, op9_licences, op10_repeats, op11_syncmers, op12_alignment, op13_infill)
}
ORACLE_SQL: dict[str, str] = {"op13_infill": infill.SQL}
