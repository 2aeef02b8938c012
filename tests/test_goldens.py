"""Hand-made cases: rates, chains of links, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from polyglossa.functions import text
from polyglossa.operators import layout, pairs


def test_cer(spark):
    rows = spark.createDataFrame([("cat", "bat"), ("abc", "xyz"), ("", "x"), (None, None)], "r string, h string")
    got = [x[0] for x in rows.coalesce(1).select(layout.cer(F.col("r"), F.col("h"))).collect()]
    assert got == [pytest.approx(1 / 3), 1.0, 0.0, 0.0]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(201, 200)], "u long, v long")
    got = {r["id"]: r["group_id"] for r in pairs.connected(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {201: 200}


def test_no_links(spark):
    empty = spark.createDataFrame([], "id long, english string, tagabawa string, filipino string, cebuano string")
    assert pairs.leakage_groups(empty).collect() == []
    row = spark.createDataFrame([(5, "a", None, "", None)], empty.schema)
    assert [tuple(r) for r in pairs.leakage_groups(row).collect()] == [(5, 5)]


def test_letters(spark):
    row = spark.createDataFrame([("Ñandú é ḍ",)], "t string")
    assert row.select(text.strip_diacritics(F.col("t"))).first()[0] == "Nandu e d"
