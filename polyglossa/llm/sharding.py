"""Sharding by histogram sort: equal bytes per shard, DataFrame functions only.

Rows are ordered by (hash of the text, doc_id, number in the table), so equal texts lie side by side. Each round counts the exact bytes below 2**12 probe
keys inside the bracket of every splitter still open and narrows the brackets, until each splitter meets the tolerance; the rows are
then exchanged once. A group of equal texts is kept whole where a bracket edge lies within the tolerance; a larger one (a hot
text) is cut by doc_id, rows that are equal altogether by number. Each round hands the driver at most 2**12 counts per open bracket.

Nulls: a null text has size 1 and no bytes, crc 0; a null doc_id sorts as the smallest. Identical rows (same doc_id and text) are
dealt over shards like others. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Probes per open bracket and round: 2**BITS.
BITS = 12


#: Parts of a key, 63 bits each.
PARTS = ("high", "low", "number")


def _below(edges: list[tuple[int, ...]]):
    """Number of splitters at or below the row's key."""
    out = F.lit(0)
    for edge in edges:
        reached = F.col(PARTS[-1]) >= edge[-1]
        for part, value in zip(PARTS[-2::-1], edge[-2::-1]):
            reached = (F.col(part) > value) | ((F.col(part) == value) & reached)
        out = out + F.when(reached, 1).otherwise(0)
    return out.cast("int")


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """Keys where shards 1, 2, ... begin. rows: high, low, number (longs from 0 up), size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    mask, key_bits = (1 << 63) - 1, 63 * len(PARTS)
    # a bracket: (level, prefix, bytes below it, its bytes), level bits of the key fixed so far
    open_ = {k: (0, 0, 0, total) for k in range(len(targets))}
    done: dict[int, int] = {}
    while open_:
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (level, prefix, _, _) in open_.items():
            groups.setdefault((level, prefix), []).append(k)
        level = min(g[0] for g in groups)
        now = [p for l, p in groups if l == level]
        whole, rest = divmod(level, 63)
        step = min(BITS, 63 - rest)
        inside = rows
        for j in range(whole):
            inside = inside.filter(F.col(PARTS[j]).isin([(p >> (level - 63 * (j + 1))) & mask for p in now]))
        if rest:
            inside = inside.filter(F.shiftright(PARTS[whole], 63 - rest).isin([p & ((1 << rest) - 1) for p in now]))
        counted = inside.groupBy(*PARTS[:whole], F.shiftright(PARTS[whole], 63 - rest - step).alias("bin")).agg(F.sum("size").alias("bytes")).collect()
        table: dict[int, dict[int, int]] = {}
        for r in counted:
            full = 0
            for part in PARTS[:whole]:
                full = full << 63 | r[part]
            full = full << (rest + step) | r["bin"]
            table.setdefault(full >> step, {})[full] = r["bytes"]
        for prefix in now:
            bins = sorted(table.get(prefix, {}).items())
            for k in groups[(level, prefix)]:
                _, _, below, _ = open_.pop(k)
                for full, size in bins:
                    if below + size > targets[k]:
                        break
                    below += size
                else:  # all bytes lie below: the splitter is the end of the bracket
                    done[k] = (prefix + 1) << (key_bits - level)
                    continue
                bits = level + step
                near = min((targets[k] - below, full), (below + size - targets[k], full + 1))
                if near[0] <= slack or bits == key_bits:
                    done[k] = near[1] << (key_bits - bits)
                else:
                    open_[k] = (bits, full, below, size)
    # a splitter past the last key has no rows above it
    return sorted(tuple(key >> (63 * j) & mask for j in range(len(PARTS) - 1, -1, -1)) for key in done.values() if key >> key_bits == 0)


def shard_documents(df: DataFrame, shards: int = 16, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in the shard), grown_shard (null under this law).

    tolerance: of a shard's even share, for a cut beside a whole group; a closer cut is made where no group's edge is that near.
    slot_rows: rows numbered by one task.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    keyed = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND((1 << 63) - 1).alias("high"),
        F.coalesce(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63))), F.lit(-(1 << 63))).alias("flipped"),
    )
    # 63 bits of the id order rows of one text; ids apart by sign only are rare and then share a key
    keyed = keyed.select("doc_id", "size", "text_crc32", "high", F.col("flipped").bitwiseAND((1 << 63) - 1).alias("low"))
    rows = keep(spark, keyed.withColumn("number", F.monotonically_increasing_id()), "keys")
    edges = splitters(rows.select(*PARTS, "size"), shards, tolerance)
    # numbering: small even lots inside each shard, by the number stored with a row, then the lots' sizes added up
    lots = max(1, -(-rows.count() // (shards * slot_rows)))
    placed = rows.select("doc_id", "size", "text_crc32", _below(edges).alias("shard"), (F.col("number") % lots).cast("int").alias("lot"))
    sizes = placed.groupBy("shard", "lot").agg(F.count("*").alias("n"))
    base = sizes.select("shard", "lot", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("number", number).join(base, ["shard", "lot"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
