"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into full pieces and one rest each; only the rests need packing. Their lengths are counted into a histogram of
at most `most` bins, the only thing the driver sees. Lengths are placed longest first, each into the pattern with the most room
among those it fits, and the counts of the patterns are updated; ranks of equal lengths then name the sequence of each piece.

Null text counts as empty: one piece that holds the closing id. Null and repeated doc_ids are packed like any other.
An empty table gives an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import keep


def patterns(histogram: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """(lengths, count) of packing patterns: each length goes to the shortest packs first, a pattern's packs at a time."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    order: list[int] = []  # rooms in use, ascending

    def put(lengths: list[int], count: int) -> None:
        left = most - sum(lengths)
        if left not in room:
            room[left] = []
            bisect.insort(order, left)
        room[left].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        n, made = histogram[length], []
        while n and order and order[-1] >= length:
            lengths, count = room[order[-1]].pop()
            if not room[order[-1]]:
                del room[order.pop()]
            used = min(n, count)
            if used < count:
                put(lengths, count - used)
            made.append(([*lengths, length], used))
            n -= used
        if n:
            # a fresh pack takes this length as often as it fits, so that equal rests share packs
            fits = most // length
            full, rest = divmod(n, fits)
            made += [([length] * fits, full)] * (full > 0) + [([length] * rest, 1)] * (rest > 0)
        for m in made:
            put(*m)
    return [m for left in order for m in room[left]]


def slots(found: list[tuple[list[int], int]], first: int) -> dict[int, np.ndarray]:
    """Per length the rank ranges of its slots: columns rank, sequence, offset, each range going on to the next rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    for lengths, count in found:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, first, offset))
            ranks[length] = rank + count
            offset += length
        first += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack_documents(df: DataFrame, path: str, most: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    pieces = keep(spark, bpe.encode_pieces(df, path, most, end_id, id_col, text_col), "pieces")
    # the rank of a piece among those of its length: its number in its part of the table, after those of the parts before
    counts = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = keep(spark, counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(most, 0)
    table = slots(patterns(histogram, most), full)
    table[most] = np.array([[0, 0, 0]], np.int64)
    shared = spark.sparkContext.broadcast(table)

    def place(batches):
        for b in batches:
            lengths, ranks = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            rows = np.argsort(lengths, kind="stable")
            for group in np.split(rows, np.flatnonzero(np.diff(lengths[rows])) + 1) if len(rows) else ():
                t = shared.value[int(lengths[group[0]])]
                hit = np.searchsorted(t[:, 0], ranks[group], "right") - 1
                sequence[group] = t[hit, 1] + ranks[group] - t[hit, 0]
                offset[group] = t[hit, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(df.dtypes)[id_col]
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
