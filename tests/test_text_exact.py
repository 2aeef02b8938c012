"""Exact removal of diacritics against unicodedata."""

import sys
import unicodedata

from pyspark.sql import functions as F

from polyglossa.functions import text


def plain(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_every_code_point(spark):
    """Every assigned code point, alone and in texts of marks in odd order; null and empty texts stay."""
    points = [chr(k) for k in range(1, sys.maxunicode + 1) if unicodedata.category(chr(k)) not in ("Cn", "Cs", "Co")]
    long = ["".join(points[i : i + 500]) for i in range(0, len(points), 500)]
    odd = ["a\u0323\u0307\u0301b", "q\u0307\u0323", "\ufb03\uff21\u00c5\ud55c", "", None]
    texts = points + long + odd
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    found = {r.i: r.p for r in rows.select("i", text.strip_diacritics(F.col("t"), exact=True).alias("p")).collect()}
    assert [i for i, t in enumerate(texts) if found[i] != (None if t is None else plain(t))] == []
    assert not rows.limit(0).select(text.strip_diacritics(F.col("t"), exact=True)).count()
