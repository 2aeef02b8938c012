"""Training pairs and balanced splits on hand-made cases: review marks, odd ids, greedy assignment, large groups."""

import random
from collections import Counter

from pyspark.sql import functions as F

from polyglossa.operators import pairs


def greedy(histogram, targets):
    counts, out = [0] * 3, {}
    for size, n in sorted(histogram.items(), reverse=True):
        out[size] = [0] * 3
        for _ in range(n):
            k = max(range(3), key=lambda i: (targets[i] - counts[i], -counts[i], -i))
            counts[k] += size
            out[size][k] += 1
    return out


def test_largest_first_is_the_greedy():
    r = random.Random(2)
    for _ in range(400):
        histogram = {r.randint(1, 30): r.randint(1, 60) for _ in range(r.randint(1, 6))}
        targets = pairs.split_targets(sum(s * n for s, n in histogram.items()))
        assert pairs.largest_first(histogram, targets) == greedy(histogram, targets)
    assert pairs.largest_first({}, [0, 0, 0]) == {}
    many = pairs.largest_first({1: 10**12}, pairs.split_targets(10**12))  # no work by group
    assert many == {1: [8 * 10**11, 10**11, 10**11]}


def test_balanced(spark):
    """One group holds a third of the rows, a null group some more; no group is cut, and every split is near its target."""
    n = 3000
    group = F.when(F.col("id") < n // 3, "hot").when(F.col("id") % 50 == 0, None).otherwise((F.col("id") / (F.col("id") % 5 + 1)).cast("int").cast("string"))
    rows = spark.range(n).select("id", group.alias("group_id"), F.lit("x").alias("part"))
    found = pairs.balanced_split(rows, "group_id").collect()
    assert len(found) == n and set(found[0].asDict()) == {"id", "group_id", "part", "split"}
    of = {}
    for r in found:
        assert of.setdefault(r.group_id, r.split) == r.split
    sizes, got = Counter(r.group_id for r in found), Counter(r.split for r in found)
    rest = max(v for k, v in sizes.items() if k != "hot")
    for name, target in zip(pairs.SPLITS, pairs.split_targets(n)):
        assert abs(got[name] - target) <= rest
    assert not pairs.balanced_split(rows.limit(0), "group_id").count()


def test_training_pairs(spark):
    rows = [("1", " hi ", "x", "[UNKNOWN_FOR_REVIEW] y"), ("a b/7", "go", None, "ok"), ("12345", "  ", "m", "n")]
    book = spark.createDataFrame(rows, "id string, english string, tagabawa string, cebuano string").withColumns({c: F.lit(v) for c, v in (("topic", " t "), ("source", ""), ("notes", None))})
    found = {r.record_id: r for r in pairs.translation_pairs(book, ("english", "tagabawa", "cebuano")).collect()}
    assert sorted(found) == ["bgs-ceb-12345", "bgs-eng-0001", "ceb-bgs-12345", "ceb-eng-a-b-7", "eng-bgs-0001", "eng-ceb-a-b-7"]
    r = found["eng-bgs-0001"]
    assert (r.source_text, r.topic, r.domain, r.notes) == ("hi", "t", "phrasebook", "")
