"""Lookups shuffle about as many bytes as the texts hold, not several times as many."""

import pytest
from pyspark.sql import functions as F

from polyglossa.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _written(spark):
    """Bytes of shuffle files that the application has written so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList
    return sum(s.shuffleWriteBytes() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())))


@pytest.mark.parametrize("name", ["tm_lookup", "translate_auto", "tm_fallback", "translated_layout", "bilingual_page"])
def test_texts_are_shuffled_once(spark, name):
    texts = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = _written(spark)
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        assert 0 < _written(spark) - before < 2.5 * texts, (_written(spark) - before) / texts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
