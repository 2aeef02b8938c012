"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash of its inner substrings of `inner` points stands at its first or last place (of
ties the first place counts). Whether it is one depends on its own points alone, so a passage has the same anchors in every text, at the
same distances, and any k - inner + 1 neighbouring k-mers hold one. A fingerprint is the row of anchors: eight base64 characters each,
for 40 bits of hash and the distance from the anchor before (255 with hash 0 only bridges a longer distance). An anchor equal to
the one before it is left out: runs and short periods give one. A text too short for an anchor is one anchor itself.

Likeness of two fingerprints: anchors in common that stand in the same order in both (the longest such chain, the n-th of equal anchors
paired with the n-th), twice their number over the number of all; 1 for two empty fingerprints.

The next document comes by ascending id; rows of one id (null first) by hash of the text, then by place in the table. Rows are dealt to
lots of neighbouring keys, and the first row of a lot also goes to the lot before, so no lot waits for another; equal rows are
spread by their place. The table is read three times and has to give its rows in the same places each time, as a stored one does.

Nulls: a null text is the empty text with an empty fingerprint. Empty tables give no rows; a single row is its own next. Texts of any
length are hashed in blocks. Other columns are not read. Ids are whole numbers.
"""

from __future__ import annotations

import base64
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix

#: Points of an anchor and of its inner substrings.
K, INNER = 32, 8
#: Code points hashed at once.
STEP = 1 << 18
HASH_BITS = 40
_LOW = U64((1 << HASH_BITS) - 1)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring points."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * U64(0xA0761D6478BD642F) + (b ^ (b >> U64(29))) * U64(0xE7037ED1A0B428DB)

    with np.errstate(over="ignore"):
        out, width = x * U64(0x9E3779B97F4A7C15) + U64(1), 1
        while 2 * width <= n:
            out, width = joined(out[:-width], out[width:]), 2 * width
        if width < n:
            out = joined(out[: len(out) - (n - width)], out[n - width :])
    return mix(out)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every n neighbours."""
    width = 1
    while 2 * width <= n:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def _closed(points: np.ndarray, k: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the closed syncmers of one row of points."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h, w = _windows(points.astype(U64), inner), k - inner
    least = _least(h, w)  # of the w places from each
    n = len(points) - k + 1
    at = np.flatnonzero((h[:n] <= least[1 : n + 1]) | (h[w : w + n] < least[:n]))
    out = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for off in [*range(0, w, inner), w]:
            out = mix(out * U64(0xD6E8FEB86659FD93) + h[at + off])
    return at, np.maximum(out & _LOW, U64(1))


class Anchors:
    """Anchors of a list of texts: hashes and positions one text after the other, and where each text begins."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> None:
        self.hashes, self.places, self.offsets = hashes, places, offsets

    def rows(self, a: int, b: int) -> Anchors:
        o = self.offsets[a : b + 1]
        return Anchors(self.hashes[o[0] : o[-1]], self.places[o[0] : o[-1]], o - o[0])

    def after(self, other: Anchors) -> Anchors:
        """The texts of other, then these."""
        return Anchors(np.r_[other.hashes, self.hashes], np.r_[other.places, self.places], np.r_[other.offsets, self.offsets[1:] + other.offsets[-1]])

    def strings(self) -> list[str]:
        gaps = np.diff(self.places, prepend=0)
        first = self.offsets[:-1][np.diff(self.offsets) > 0]
        gaps[first] = self.places[first]
        fill = gaps // 255
        size = fill + 1
        ends = np.cumsum(size)
        packed = np.full(int(ends[-1]) if len(ends) else 0, 255, U64)
        packed[ends - 1] = self.hashes << U64(8) | (gaps % 255).astype(U64)
        raw = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
        cut = 6 * np.r_[0, ends][self.offsets]
        return [base64.b64encode(raw[a:b]).decode() for a, b in zip(cut, cut[1:])]


def anchors(texts: list[str], k: int = K, inner: int = INNER) -> Anchors:
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pieces: list[tuple[int, int, str]] = []  # text, place in it, points
    size = 0

    def hash_pieces() -> None:
        points = np.frombuffer("".join(p[2] for p in pieces).encode("utf-32-le"), np.uint32)
        at, hashes = _closed(points, k, inner)
        ends = np.cumsum([len(p[2]) for p in pieces], dtype=np.int64)
        piece = np.searchsorted(ends, at, "right")
        inside = at + k <= ends[piece]
        at, hashes, piece = at[inside], hashes[inside], piece[inside]
        row, base = (np.array([p[j] for p in pieces], np.int64) for j in (0, 1))
        found.append((row[piece], at - np.r_[0, ends][piece] + base[piece], hashes))

    for row, text in enumerate(texts):
        for a in range(0, max(1, len(text) - k + 1), STEP):
            pieces.append((row, a, text[a : a + STEP + k - 1]))
            size += len(pieces[-1][2])
            if size >= STEP:
                hash_pieces()
                pieces, size = [], 0
    if pieces:
        hash_pieces()
    rows, places, hashes = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
    fresh = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])][: len(rows)]
    rows, places, hashes = rows[fresh], places[fresh], hashes[fresh]
    short = [r for r in np.flatnonzero(np.bincount(rows, minlength=len(texts)) == 0) if texts[r]]
    if short:
        whole = np.array([max(1, xxhash.xxh64_intdigest(texts[r].encode()) & int(_LOW)) for r in short], U64)
        rows, places, hashes = np.r_[rows, short], np.r_[places, np.zeros(len(short), np.int64)], np.r_[hashes, whole]
        order = np.argsort(rows, kind="stable")
        rows, places, hashes = rows[order], places[order], hashes[order]
    return Anchors(hashes.astype(U64), places.astype(np.int64), np.searchsorted(rows, np.arange(len(texts) + 1)))


def parsed(fingerprints: list[str]) -> Anchors:
    """The anchors that strings were made of."""
    raw = np.frombuffer(base64.b64decode("".join(f or "" for f in fingerprints)), np.uint8).reshape(-1, 6).astype(U64)
    hashes = np.zeros(len(raw), U64)
    for j in range(5):
        hashes = hashes << U64(8) | raw[:, j]
    ends = np.cumsum([len(f or "") // 8 for f in fingerprints], dtype=np.int64)
    places = np.cumsum(raw[:, 5].astype(np.int64))
    base = np.r_[0, places][np.r_[0, ends]]
    row = np.searchsorted(ends, np.arange(len(raw)), "right")
    real = hashes > 0
    return Anchors(hashes[real], (places - base[row])[real], np.searchsorted(row[real], np.arange(len(fingerprints) + 1)))


def _chain(places: list[int]) -> int:
    """Length of the longest rising chain."""
    tails: list[int] = []
    for p in places:
        at = bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails)


def likeness(a: Anchors, b: Anchors) -> np.ndarray:
    """Of the n-th text of a and the n-th of b."""
    n = len(a.offsets) - 1
    keys, where = [], []
    for x in (a, b):
        row = np.repeat(np.arange(n), np.diff(x.offsets))
        key = row.astype(U64) << U64(HASH_BITS) | x.hashes
        order = np.argsort(key, kind="stable")
        keys.append(key[order])
        where.append((order, row))
    # the n-th of equal anchors meets the n-th
    union, number = np.unique(np.concatenate(keys), return_inverse=True)
    parts = np.split(number, [len(keys[0])])
    nth = [np.arange(len(p)) - np.searchsorted(p, p) for p in parts]
    most = 1 + max((int(x.max()) for x in nth if len(x)), default=0)
    _, ia, ib = np.intersect1d(parts[0] * most + nth[0], parts[1] * most + nth[1], assume_unique=True, return_indices=True)
    ia, ib = where[0][0][ia], where[1][0][ib]
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    row = where[0][1][ia]
    common = np.bincount(row, minlength=n)
    falls = np.unique(row[1:][(row[1:] == row[:-1]) & (ib[1:] < ib[:-1])])
    cut = np.searchsorted(row, np.r_[falls, falls + 1]).reshape(2, -1)
    for r, start, end in zip(falls, *cut):
        common[r] = _chain(ib[start:end].tolist())
    total = np.diff(a.offsets) + np.diff(b.offsets)
    return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)


def fingerprint_documents(df: DataFrame, k: int = K, inner: int = INNER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint; no shuffle."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            made = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(anchors(texts, k, inner).strings(), pa.string())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_chars", "fingerprint"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, n_chars long, fingerprint string")


def compare_fingerprints(df: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """df with the likeness of two columns of fingerprints; a null one is empty."""
    pair = [F.col(f"`{left}`").alias("a"), F.col(f"`{right}`").alias("b")]

    def run(batches):
        for b in batches:
            found = likeness(*(parsed(b.column(c).to_pylist()) for c in (1, 2)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["kept", "found"])

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("kept"), *pair)
    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(run, f"kept {kind}, found double").select("kept.*", F.col("found").alias(name))


def _order(ids: pa.Array, hashes: pa.Array, places: pa.Array) -> np.ndarray:
    """Keys whose bytes sort as (id, nulls first; hash; place)."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    flip = U64(1 << 63)
    columns = [(~none).astype(U64), np.where(none, U64(0), ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64) ^ flip)]
    columns += [hashes.to_numpy(zero_copy_only=False).view(U64) ^ flip, places.to_numpy(zero_copy_only=False).view(U64)]
    return np.ascontiguousarray(np.stack(columns, 1).astype(">u8")).view("S32").reshape(-1)


def beside_next(df: DataFrame, lot_bytes: int = 32 << 20) -> DataFrame:
    """lot, ghost, id, text: each lot sorted by key, and after its last row the first of the next lot once more, as a ghost.

    lot_bytes: of text in a lot on average. The first keys of the lots (32 bytes each) pass through the driver.
    """
    spark = df.sparkSession
    sized = df.select(F.octet_length("text").alias("size")).agg(F.sum("size"), F.count("*")).first()
    lots = max(1, min(sized[1], max(2 * spark.sparkContext.defaultParallelism, -(-(sized[0] or 0) // lot_bytes))))
    keyed = df.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("place"))
    ranged = keyed.select("id", "hash", "place").repartitionByRange(lots, "id", "hash", "place")
    least = F.min(F.struct("id", "hash", "place")).alias("first")
    rows = ranged.groupBy(F.spark_partition_id().alias("part")).agg(least).select("first.*").collect()
    firsts = np.sort(_order(*(pa.array([r[j] for r in rows], pa.int64()) for j in range(3)))) if rows else np.zeros(0, "S32")
    shared = spark.sparkContext.broadcast(firsts)

    def deal(batches):
        firsts = shared.value
        for b in batches:
            key = _order(b.column("id"), b.column("hash"), b.column("place"))
            lot = np.searchsorted(firsts, key, "right") - 1
            again = np.flatnonzero(firsts[lot] == key)
            for rows, lots, ghost in ((None, lot, False), (again, (lot[again] - 1) % len(firsts), True)):
                out = b if rows is None else b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lots, pa.int32()), pa.array(np.full(len(lots), ghost)), *out.columns], ["lot", "ghost", *b.schema.names])

    dealt = keyed.mapInArrow(deal, "lot int, ghost boolean, id long, text string, hash long, place long")
    return dealt.repartitionById(max(1, len(firsts)), F.col("lot")).sortWithinPartitions("lot", "ghost", "id", "hash", "place").select("lot", "ghost", "id", "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the points gives way to the first points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(df: DataFrame, k: int = K, inner: int = INNER, lot_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next: each text against its edited form and the next one."""

    def run(batches):
        held: list[tuple[int, int, str, bool]] = []  # lot, id, text, ghost
        known: Anchors | None = None  # of the first of them
        size = 0

        def compared():
            nonlocal known
            texts = [h[2] for h in held]
            marks = anchors(texts, k, inner) if known is None else anchors(texts[1:], k, inner).after(known)
            pairs = [j for j in range(len(held) - 1) if not held[j][3]]
            known = marks.rows(len(held) - 1, len(held))
            if not pairs:
                return None
            assert all(held[j][0] == held[j + 1][0] for j in pairs), "the table gave other rows when read again"
            edited = [edited_text(texts[j], texts[j + 1]) for j in pairs]
            of = anchors(edited, k, inner)
            prints, changed = marks.strings(), of.strings()
            # runs of pairs between ghosts are slices of the anchors
            near, after = np.zeros(len(pairs)), np.zeros(len(pairs))
            cut = [0, *(i for i in range(1, len(pairs)) if pairs[i] != pairs[i - 1] + 1), len(pairs)]
            for a, b in zip(cut, cut[1:]):
                own = marks.rows(pairs[a], pairs[b - 1] + 1)
                near[a:b] = likeness(own, of.rows(a, b))
                after[a:b] = likeness(own, marks.rows(pairs[a] + 1, pairs[b - 1] + 2))
            columns = ([held[j][1] for j in pairs], [len(texts[j]) for j in pairs], edited, [prints[j] for j in pairs], changed)
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays([*made, pa.array(near), pa.array(after)], ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for lot, ghost, i, text in zip(*(c.to_pylist() for c in b.columns)):
                held.append((lot, i, text or "", ghost))
                size += len(held[-1][2])
                if size >= 4 * STEP:
                    if (out := compared()) is not None:
                        yield out
                    held, size = held[-1:], 0
        if len(held) > 1 and (out := compared()) is not None:
            yield out

    rows = beside_next(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lot_bytes)
    found = rows.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn("doc_id", F.col("doc_id").cast(dict(df.dtypes)[id_col]))


def edited_digest(df: DataFrame) -> DataFrame:
    """compare_edited with a digest in place of the edited text."""
    found = compare_edited(df)
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
