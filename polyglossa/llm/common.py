"""Helpers shared by the operators of this subpackage: scratch tables, Arrow text access, hashing.

Hashes are 64 bits wide and computed the same way on every machine (no process seed).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; bounds the temporaries of a task.
STEP_BYTES = 1 << 20

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of each local application that names none.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs on this machine alone (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that are kept inside, so that a caller who has stored its result can remove them."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each ends, not when the driver happens to collect its garbage.

    A frame made inside should not be run twice: its second run would have to shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def keep(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and its shuffle files go."""
    path = f"{scratch_dir(spark)}/polyglossa-{name}-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def discard(spark: SparkSession, *kept: DataFrame) -> None:
    """Remove scratch tables that no later step reads."""
    for df in kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer text stands alone."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def raw_texts(column: pa.Array, most: int = 12 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of steps of about `most` bytes; null is empty."""
    at, held, size = 0, [], 0
    for row, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_py() or b""
        held.append(text)
        size += len(text)
        if size >= most:
            yield at, held
            at, held, size = row + 1, [], 0
    if held:
        yield at, held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
                row = np.full(size, U64(base))
                row[0] = 1
                _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of byte values times base**position over i..j-1."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte string starts..ends, equal wherever it stands."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^ \\t-\\r]+ of texts: (hash, start, end, words per text); positions are in `data`.

    Texts longer than a step are hashed piece by piece, cut at white space.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    view = data[base:end]
    space = _SPACE[view]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    last = word.copy()
    last[:-1] &= space[1:]
    inner = offsets[1:-1] - base
    inner = inner[(inner > 0) & (inner < len(view))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP_BYTES, "right")))
        piece = view[starts[at] : ends[to - 1]]
        sums = prefix_sums(_LOWER[piece] if lower else piece)
        hashes[at:to] = span_hashes(sums, starts[at:to] - starts[at], ends[at:to] - starts[at])
        at = to
    counts = np.diff(np.searchsorted(starts, offsets - base))
    return hashes, starts + base, ends + base, counts


def windows_of(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n words inside a text, and the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            out = out * U64(0xA0761D6478BD642F) + hashes[k : len(hashes) - n + 1 + k]
    left = np.repeat(np.cumsum(counts), counts)[: len(out)] - np.arange(len(out))
    at = np.flatnonzero(left >= n)
    return mix(out[at]), at


def bitmap(spark: SparkSession, keys: DataFrame, bits: int) -> np.ndarray:
    """Membership bits of a column of longs, 2**bits of them: a filter of fixed size.

    A set bit may belong to another key, so callers join exactly afterwards; the driver gets at most 2**bits / 8 bytes.
    """
    key = F.col(keys.columns[0]).bitwiseAND((1 << bits) - 1)
    rows = (
        keys.select(F.shiftright(key, 15).cast("int").alias("block"), key.bitwiseAND(32767).alias("bit"))
        .groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(bytes(r["map"]), np.uint8)
        out[r["block"] * 4096 : r["block"] * 4096 + len(piece)] = piece
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """keys: 64-bit words; true where the bit is set."""
    k = keys & U64(len(bits) * 8 - 1)
    return (bits[k >> U64(3)] >> (k & U64(7)).astype(np.uint8)) & 1 == 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
