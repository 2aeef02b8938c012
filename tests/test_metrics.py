"""Error rates and overlaps against plain versions; no limit on different words, no exchange of n-grams."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from polyglossa.operators import metrics


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 90))] for _ in range(2))
        assert metrics.edit_distance(a, b) == plain_distance(a, b)


def test_many_words(spark):
    """60,002 different words: the rate is exact, and there is one."""
    words = [f"w{k}" for k in range(60_000)]
    other = [*words[:100], "new", *words[101:59_000], "two"]
    rows = spark.createDataFrame([(" ".join(words), " ".join(other)), (None, "x"), ("a b", None)], "r string, h string")
    began = time.time()
    assert [x[0] for x in rows.select(metrics.wer(F.col("r"), F.col("h"))).collect()] == [1001 / 60_000, 0.0, 1.0]
    assert time.time() - began < 60


def test_overlaps():
    r = random.Random(7)
    for _ in range(100):
        h, f = ("".join(r.choices("abc漢", k=r.randint(0, 30))) for _ in range(2))
        for x, y in ((h, f), (list(h), list(f))):
            want = []
            for n in range(1, 5):
                a, b = (Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1)) for t in (x, y))
                want += [(a & b).total(), a.total(), b.total()]
            assert metrics.overlaps(x, y, 4) == want


def test_no_exchange_of_grams(spark):
    rows = spark.range(50).select("id", F.lit("the cat sat").alias("hyp"), F.concat(F.lit("the cat "), "id").alias("ref")).repartition(4)
    plan = metrics.sentence_chrf(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the one of the rows themselves
    for made in (metrics.corpus_bleu, metrics.corpus_chrf):
        assert "Generate" not in made(rows)._jdf.queryExecution().executedPlan().toString()
