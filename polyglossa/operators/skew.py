"""Joins whose left side may hold one key in a large share of its rows.

A frequent-items sketch of the keys' hashes, built in one pass, names the heavy keys. Only their rows are dealt over `salts` parts, and
only their right rows are repeated for each part. Any outcome of the sketch gives the same rows: it decides where they meet, not whether.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys the sketch tracks; each with more than about 3.5 / TRACKED of all rows is in it.
TRACKED = 1 << 12
#: Rows that a task gets of a table whose rows expand.
ROWS = 10_000


def evenly(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df dealt over tasks of `rows` rows at most: as many tasks as the table asks for, however few files it comes in."""
    n = df.count()
    spare = min(df.sparkSession.sparkContext.defaultParallelism, n // 1_000)
    return df.repartition(max(1, math.ceil(n / rows), spare))


def heavy_keys(df: DataFrame, *keys: str, share: float = 0.002, most: int = 256) -> list[int]:
    """Hashes of at most `most` keys that hold about `share` of the rows or more each."""
    items = F.expr(f"approx_top_k(key, {most}, {TRACKED})")
    row = df.select(F.xxhash64(*keys).alias("key")).agg(items.alias("items"), F.count("*").alias("n")).first()
    return [i["item"] for i in row["items"] or [] if i["count"] >= share * row["n"]]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int | None = None, heavy: list[int] | None = None) -> DataFrame:
    """left.join(right, keys, how), for how = left or inner; null keys meet nothing. salts: parts of a heavy key, by default eight for each task of a shuffle, which evens out."""
    heavy = heavy_keys(left, *keys) if heavy is None else heavy
    if not heavy:
        return left.join(right, keys, how)
    n = salts or 8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.xxhash64(*keys).isin(heavy)
    part = F.when(hot, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")).otherwise(0)
    dealt = left.withColumn("_part", part)
    repeated = right.withColumn("_part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")
