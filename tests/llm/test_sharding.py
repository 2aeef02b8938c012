"""Balance of shards: repeated rows, null ids, equal texts, one large text."""

import pytest
from pyspark.sql import functions as F

from polyglossa.llm import sharding


def check(rows, n):
    assert len(rows) == n
    sizes = [0] * 16
    for r in rows:
        sizes[r.shard] += r.size
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    return sizes


@pytest.mark.parametrize("ids", ["same", "null", "own"])
def test_equal_rows(spark, ids):
    """1,600 rows of one text fill all shards alike."""
    i = {"same": F.lit(7).cast("long"), "null": F.lit(None).cast("long"), "own": F.col("id")}[ids]
    rows = spark.range(1600).select(i.alias("doc_id"), F.lit("the same text " * 5).alias("text"), F.lit(1).alias("size")).repartition(5)
    sizes = check(sharding.shard_documents(rows).collect(), 1600)
    assert max(sizes) - min(sizes) <= 2 * 71, sizes


def test_mixed(spark):
    """A third of the rows are one row; the rest are texts of many lengths, some repeated."""
    n = 6000
    text = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int"))).otherwise(None)
    doc_id = F.when(F.col("id") % 3 == 0, -5).when(F.col("id") % 3 == 1, F.col("id") - 900)
    rows = spark.range(n).select(doc_id.cast("long").alias("doc_id"), text.alias("text")).repartition(7)
    sizes = check(sharding.shard_documents(rows).collect(), n)
    assert max(sizes) - min(sizes) <= 2 * 193 + 0.004 * sum(sizes) / 16, sizes
    assert not sharding.shard_documents(rows.limit(0)).count()


def test_one_large_text(spark):
    rows = spark.createDataFrame([(1, "x" * 100_000), (2, None), *((k, f"short {k}") for k in range(3, 400))], "doc_id long, text string")
    sizes = sorted(check(sharding.shard_documents(rows).collect(), 399))
    assert sizes[-1] >= 100_001
