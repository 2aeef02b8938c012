"""Alignment of two tokenizers, with corpus counts of linked ids by minimal perfect hashing.

A text, a space before it, is encoded by A (byte-level BPE of the tokenizers library) and B (sentencepiece BPE with byte fallback, which
adds that space itself). Byte offsets where tokens of both end cut the tokens into groups; every A token of a group is linked with
every B token of it. The count of an id pair is the number of documents that hold it linked.

Both tokenizers split before a single space between two characters that are no white space (A by its pattern; B has no piece with a
space after another character, which is checked), and both end a token there. So a text is cut into such chunks, each distinct chunk
is encoded and aligned once by a task, and a document adds up its chunks. A task forgets its chunks beyond `most_chunks` characters,
100 more counted for each.

1. The first pass aligns all documents; a task adds up its pairs' documents and writes them as partial counts.
2. The distinct pairs are dealt by hash into slices of about `slice_pairs`; each slice builds a minimal perfect hash (levels of bits: a
   key stays at the first level where no other key of the slice shares its place, its index is the number of bits set before).
3. Partial counts, dealt by slice and salt, fill dense vectors at the hash of their pair, which are summed by slice as a tree, fan-in
   `fan`. A slice's row holds the bits, the pairs in the order of their hash, the counts, and whether each is its A id's highest.
4. The second pass aligns again and looks pairs up: slice, hash, the pair verified, its count.

Slices are broadcast for the second pass in groups of at most `group_pairs` pairs (some 18 bytes each); more pairs take more passes,
whose sums are added by row. Highest counts by A id are at most one row for each id of A's vocabulary.

Nulls: texts null or empty, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty digest.
Repeated rows count as documents each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import U64, keep, mix

#: Where both tokenizers split whatever stands around.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space besides the space and the line end.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: What a chunk costs besides its characters, in characters.
ENTRY = 100
#: Level beyond which the keys left (a few by chance) are kept as they are.
LEVELS = 40


#: Chunks encoded as one text; such a text splits at its chunks again.
TOGETHER = 512
#: Longest text encoded by ranks, and the pattern of byte-level tokenizers, a fixed value.
RANKED = 20_000
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links of a group beyond which they are counted by distinct ids.
WIDE = 4096


class Aligner:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B has pieces with a space inside; chunks would not be exact")
        if len(self.bytes_a) > 1 << 16:
            raise ValueError("ids of A have to fit in 16 bits")
        self.quick = self._by_ranks(path_a)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = [[f"{i}{end}" for i in range(most)] for end in (",", "|", ";", "\n")]

    def _by_ranks(self, path: str) -> tiktoken.Encoding | None:
        """The same encoding by ranks, which is faster: where A only splits by the byte-level pattern and merges in the order of its ids."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in told["model"]["merges"]]
        ids = [told["model"]["vocab"].get(t, -1) for t in made]
        plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or ids != sorted(ids) or sorted(ids) != list(range(256, 256 + len(ids))) or told["model"].get("ignore_merges"):
            return None
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a)}, special_tokens={})

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        """By ranks where no chunk is long (its pattern goes back over long runs of white space)."""
        if self.quick is None or max(map(len, texts), default=0) > RANKED:
            return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return self.quick.encode_ordinary_batch(texts, num_threads=1)

    def chunks(self, text: str) -> list[str]:
        """Cut by the pattern; where no space stands beside other white space and there is no mark of our own, every space is a cut."""
        whole = " " + text
        if whole[-1] == " " or "\0" in text or "  " in whole or " \n" in whole or "\n " in whole or any(c in text for c in _RARE):
            return _CUT.split(whole)
        return (" " + text.replace(" ", "\0 ")).split("\0")

    def encoded(self, groups: list[list[str]]) -> Iterator[tuple[list[str], list[int] | None, list[int]]]:
        """(chunks, ids of A, ids of B) of neighbouring chunks; ids of A null for a chunk that is not given back byte for byte."""
        texts, apart = ["".join(g) for g in groups], []
        for g, t, ids, b in zip(groups, texts, self.ids_a(texts), self.b.encode([t[1:] for t in texts], num_threads=1)):
            raw = t.encode()
            if b"".join([self.bytes_a[i] for i in ids]) == raw == b"".join([self.bytes_b[i] for i in b]):
                yield g, ids, b
            elif len(g) == 1:
                yield g, None, []
            else:
                apart += [[c] for c in g]
        if apart:
            yield from self.encoded(apart)

    def align(self, chunks: list[str], text: bool) -> Iterator[Aligned]:
        # a chunk whose only outer white space is its first space splits from such neighbours; others are encoded alone
        plain = [c for c in chunks if len(c.strip()) + 1 == len(c) > 1]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        if len(plain) < len(chunks):
            groups += [[c] for c in set(chunks).difference(plain)]
        good, bad = [], []
        for found in self.encoded(groups):
            (bad if found[1] is None else good).append(found)
        if good:
            yield self._aligned([c for g, _, _ in good for c in g], *(np.concatenate([np.array(x[k], np.int64) for x in good]) for k in (1, 2)), text)
        if bad:
            none = np.zeros(len(bad), np.int64)
            yield Aligned([g[0] for g, _, _ in bad], np.stack([none - 1, none, none], 1), none, none[:0], none[:0], [""] * len(bad))

    def _aligned(self, chunks: list[str], a: np.ndarray, b: np.ndarray, text: bool) -> Aligned:
        ends = np.cumsum(np.array(list(map(len, map(str.encode, chunks))), np.int64))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        common = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]  # both end at the last byte
        chunk, group_a, group_b = np.searchsorted(ends, common), np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        wide = np.flatnonzero(n_a * n_b > WIDE)
        owner, place = _spread(np.where(n_a * n_b > WIDE, 0, n_a * n_b))
        keys = [chunk[owner] << 48 | a[first_a[owner] + place // n_b[owner]] << 32 | b[first_b[owner] + place % n_b[owner]]]
        times = [np.ones(len(owner), np.int64)]
        for g in wide:
            (x, m), (y, n) = (np.unique(ids[f[g] : f[g] + k[g]], return_counts=True) for ids, f, k in ((a, first_a, n_a), (b, first_b, n_b)))
            keys.append((chunk[g] << 48 | x[:, None] << 32 | y).reshape(-1))
            times.append((m[:, None] * n).reshape(-1))
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, np.concatenate(times))
        numbers = np.stack([np.bincount(c, minlength=len(chunks)) for c in (chunk[group_a], chunk[group_b], chunk)], 1)
        return Aligned(chunks, numbers, np.bincount(key >> 48, minlength=len(chunks)), key & ((1 << 48) - 1), total, self._strings(a, b, chunk, group_a, group_b) if text else [])

    def _strings(self, a: np.ndarray, b: np.ndarray, chunk: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """The groups of each chunk: A's ids, then B's, of one group after the other."""
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        last_chunk = np.diff(chunk, append=-1) != 0
        end = np.r_[np.where(last_a, 1, 0), np.where(last_b, np.where(last_chunk[group_b], 3, 2), 0)]
        order = np.lexsort((np.r_[np.zeros(len(a), bool), np.ones(len(b), bool)], np.r_[group_a, group_b]))
        return "".join([self.written[e][i] for e, i in zip(end[order].tolist(), np.r_[a, b][order].tolist())]).split("\n")[:-1]


class Aligned(NamedTuple):
    """Chunks: n_a, n_b, n_groups of each (-1 where bytes differ), number of its distinct pairs, the pairs and their links, groups as text."""

    chunks: list[str]
    numbers: np.ndarray
    n_pairs: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    strings: list[str]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


class Grown:
    """An array that rows are added to."""

    def __init__(self, *shape: int) -> None:
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            held = np.zeros((max(2 * len(self.held), self.n + len(rows)), *self.held.shape[1:]), np.int64)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    def __call__(self) -> np.ndarray:
        return self.held[: self.n]


class Chunks:
    """What a task knows of the chunks met: token and group numbers, pairs (a << 32 | b) and their links."""

    def __init__(self, aligner: Aligner, text: bool) -> None:
        self.aligner, self.text, self.size = aligner, text, 0
        self.number: dict[str, int] = {}
        self.strings: list[str] = []
        self.numbers, self.n_pairs, self.pairs, self.times = Grown(3), Grown(), Grown(), Grown()

    def meet(self, texts: list[list[str]]) -> None:
        new = list(set().union(*texts).difference(self.number))
        for at in range(0, len(new), 1 << 14):
            for found in self.aligner.align(new[at : at + (1 << 14)], self.text):
                self.number.update(zip(found.chunks, range(len(self.number), len(self.number) + len(found.chunks))))
                self.size += sum(map(len, found.chunks)) + ENTRY * len(found.chunks)
                self.strings += found.strings
                for grown, more in zip((self.numbers, self.n_pairs, self.pairs, self.times), found[1:5]):
                    grown.add(more)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in it) of the members of groups of given sizes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def aligned_steps(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], text: bool, most_chunks: int, step: int = 1 << 20) -> Iterator[tuple]:
    """(batch, first row, texts' chunk numbers joined, where each text begins, chunks) of some megabytes of text; texts without tokens have none.

    The chunks object is another one after the task has forgotten; numbers are valid for the one that comes along.
    """
    aligner = loaded(*paths)
    known = Chunks(aligner, text)
    for b in batches:
        column, at = b.column(1), 0
        while at < len(column):
            held, size = [], 0
            while at + len(held) < len(column) and size < step:
                value = column[at + len(held)].as_py() or ""
                size += len(value)
                held.append(aligner.chunks(value) if value else [])
            if known.size > most_chunks:
                known = Chunks(aligner, text)
            known.meet(held)
            counts = np.array([len(t) for t in held], np.int64)
            numbers = np.fromiter(map(known.number.__getitem__, chain.from_iterable(held)), np.int64, int(counts.sum()))
            doc = np.repeat(np.arange(len(held)), counts)
            bad = np.bincount(doc[known.numbers()[numbers, 0] < 0], minlength=len(held)) > 0
            yield b, at, numbers[~bad[doc]], np.r_[0, np.cumsum(np.where(bad, 0, counts))], known
            at += len(held)


def partial_counts(df: DataFrame, paths: tuple[str, str], most_chunks: int, most_pairs: int) -> DataFrame:
    """pair, n: documents of one task that hold the pair; a task with over most_pairs of them writes what it has and starts anew."""

    def run(batches):
        held: dict[int, int] = {}
        for _, _, numbers, begins, known in aligned_steps(batches, paths, False, most_chunks):
            doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            if not len(numbers):
                continue
            # a chunk once for each document, then its pairs once for each
            n, first = known.n_pairs(), np.cumsum(known.n_pairs()) - known.n_pairs()
            one = np.unique(doc * len(n) + numbers)
            doc, chunk = one // len(n), one % len(n)
            owner, place = _spread(n[chunk])
            pairs, member = np.unique(known.pairs()[first[chunk][owner] + place], return_inverse=True)
            once = np.unique(doc[owner] * len(pairs) + member) % max(1, len(pairs))
            for pair, n in zip(pairs.tolist(), np.bincount(once, minlength=len(pairs)).tolist()):
                held[pair] = held.get(pair, 0) + n
            if len(held) > most_pairs:
                yield _pairs_out(held)
                held = {}
        yield _pairs_out(held)

    return df.select(F.lit(0).alias("k"), F.col("text")).mapInArrow(run, "pair long, n long")


def _pairs_out(held: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["pair", "n"])


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by levels of bits: {'sizes': words of each level, 'words', 'rest'}."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.words, self.rest = sizes, words, rest
        self.first = np.r_[0, np.cumsum(sizes)]
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]

    @staticmethod
    def _places(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(keys.view(U64) + U64(level + 1) * U64(0x9E3779B97F4A7C15)) % U64(words * 64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            n = -(-len(left) // 64)
            place = cls._places(left, len(sizes), n)
            alone = np.bincount(place.astype(np.int64), minlength=n * 64) == 1
            words.append(np.packbits(alone, bitorder="little").view(U64))
            sizes.append(n)
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, U64), np.sort(left))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key outside the set -1 or any index."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, n in enumerate(self.sizes):
            place = self._places(keys[open_], level, int(n))
            word, bit = self.first[level] + (place >> U64(6)).astype(np.int64), place & U64(63)
            hit = (self.words[word] >> bit) & U64(1) == 1
            below = self.words[word] & ((U64(1) << bit) - U64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == keys[open_], self.before[-1] + at, -1)
        return out

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.tobytes(), self.words.tobytes(), self.rest.tobytes()

    @classmethod
    def read(cls, sizes: bytes, words: bytes, rest: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(words, U64), np.frombuffer(rest, np.int64))


_SLICE = "slice int, sizes binary, words binary, rest binary, pairs binary"


def slice_of(pairs: np.ndarray, slices: int) -> np.ndarray:
    return (mix(pairs.view(U64) ^ U64(0xD6E8FEB86659FD93)) % U64(slices)).astype(np.int32)


def _with_slice(pairs: DataFrame, slices: int) -> DataFrame:
    def run(batches):
        for b in batches:
            of = slice_of(b.column(0).to_numpy(zero_copy_only=False), slices)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of)], [*b.schema.names, "slice"])

    return pairs.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in pairs.dtypes) + ", slice int")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of each key (the first n_keys columns), from batches in which rows of one key lie side by side."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        columns = np.stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(n_keys)])
        cut = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cut, cut[1:]):
            now = tuple(columns[:, start].tolist())
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(b.slice(start, end - start))
    if held:
        yield key, held


def perfect_slices(pairs: DataFrame, slices: int) -> DataFrame:
    """pairs: distinct longs, and slice. One row for each slice that has pairs."""

    def run(batches):
        for (number,), held in _runs((b.select([1, 0]) for b in batches), 1):
            keys = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
            found = PerfectHash.of(keys)
            ordered = np.empty_like(keys)
            ordered[found(keys)] = keys
            yield pa.RecordBatch.from_pylist([dict(zip(("slice", "sizes", "words", "rest", "pairs"), (number, *found.parts(), ordered.tobytes())))], pa.schema([("slice", pa.int32()), *((n, pa.binary()) for n in ("sizes", "words", "rest", "pairs"))]))

    return pairs.select("pair", "slice").repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(run, _SLICE)


def dense_counts(partial: DataFrame, hashes: DataFrame, slices: int, salts: int, fan: int) -> DataFrame:
    """hashes with `counts`: long for each pair in the order of its hash.

    partial: pair, n, slice. Each (slice, salt) fills a vector; vectors meet fan at a time until one is left for each slice.
    """

    def fill(batches):
        for (number, salt), held in _runs(batches, 2):
            table, rows = held[0], held
            bits = [table.column(c)[0].as_py() for c in (5, 6, 7, 8)]
            found, pairs = PerfectHash.read(*bits[:3]), np.frombuffer(bits[3], np.int64)
            out = np.zeros(len(pairs), np.int64)
            for b in rows:
                real = b.filter(b.column(3).is_valid())
                keys, n = (real.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
                at = found(keys)
                assert (pairs[at] == keys).all(), "a partial count has no slot"
                np.add.at(out, at, n)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["slice", "salt", "counts"])

    def add(batches):
        for (number, salt), held in _runs(batches, 2):
            total = reduce(np.add, (np.frombuffer(v.as_py(), np.int64) for b in held for v in b.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "salt", "counts"])

    key = ["slice", "salt"]
    # the slice's hash goes to each salt that has rows for it, in front of them
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("pair", "n", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    each = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("int"))
    binary = ("sizes", "words", "rest", "pairs")
    rows = salted.select(*key, F.lit(1).alias("later"), "pair", "n", *(F.lit(None).cast("binary").alias(c) for c in binary))
    rows = rows.union(each.select(*key, F.lit(0).alias("later"), F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n"), *binary))
    vectors = rows.repartition(slices * salts, *key).sortWithinPartitions(*key, "later").mapInArrow(fill, "slice int, salt int, counts binary")
    while salts > 1:
        salts = -(-salts // fan)
        vectors = vectors.withColumn("salt", F.floor(F.col("salt") / fan).cast("int")).repartition(slices * salts, *key).sortWithinPartitions(*key)
        vectors = vectors.mapInArrow(add, "slice int, salt int, counts binary")
    return hashes.join(vectors.select("slice", "counts"), "slice")


def marked_best(counted: DataFrame) -> DataFrame:
    """counted with `best`, a byte for each pair: whether its count is its A id's highest in all slices."""

    def highest(batches):
        for b in batches:
            for pairs, counts in zip(b.column(0), b.column(1)):
                a = np.frombuffer(pairs.as_py(), np.int64) >> 32
                ids, place = np.unique(a, return_inverse=True)
                top = np.zeros(len(ids), np.int64)
                np.maximum.at(top, place, np.frombuffer(counts.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], ["a", "top"])

    # at most one row for each id of A
    rows = counted.select("pairs", "counts").mapInArrow(highest, "a long, top long").groupBy("a").agg(F.max("top").alias("top")).collect()
    tops = np.zeros(max((r.a for r in rows), default=0) + 1, np.int64)
    for r in rows:
        tops[r.a] = r.top
    shared = counted.sparkSession.sparkContext.broadcast(tops)

    def mark(batches):
        for b in batches:
            best = [(shared.value[np.frombuffer(p.as_py(), np.int64) >> 32] == np.frombuffer(c.as_py(), np.int64)).tobytes() for p, c in zip(b.column("pairs"), b.column("counts"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.binary())], [*b.schema.names, "best"])

    return counted.mapInArrow(mark, f"{_SLICE}, counts binary, best binary")


class Lookup:
    """Counts of some of the slices."""

    def __init__(self, rows: list, slices: int) -> None:
        self.slices = slices
        self.of = {r.slice: (PerfectHash.read(bytes(r.sizes), bytes(r.words), bytes(r.rest)), *(np.frombuffer(bytes(x), t) for x, t in ((r.pairs, np.int64), (r.counts, np.int64), (r.best, bool)))) for r in rows}

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, highest for its A id) of each pair; 0 of pairs that are in none of these slices."""
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        number = slice_of(pairs, self.slices)
        order = np.argsort(number, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else ():
            if (known := self.of.get(int(number[rows[0]]))) is None:
                continue
            found, keys, n, top = known
            at = found(pairs[rows])
            real = (at >= 0) & (keys[at] == pairs[rows])
            counts[rows[real]], best[rows[real]] = n[at[real]], top[at[real]]
        return counts, best


def looked_up(df: DataFrame, paths: tuple[str, str], group: list, slices: int, first: bool, most_chunks: int, with_groups: bool) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups), as far as the slices of this group go."""
    shared = df.sparkSession.sparkContext.broadcast(group)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def run(batches):
        lookup, known, sums = None, None, np.zeros((0, 6), np.int64)
        for b, at, numbers, begins, chunks in aligned_steps(batches, paths, first, most_chunks):
            lookup = lookup or Lookup(shared.value, slices)
            if chunks is not known:
                known, sums = chunks, np.zeros((0, 6), np.int64)
            if len(sums) < len(known.number):  # chunks met since
                sizes, seen = known.n_pairs()[len(sums) :], int(known.n_pairs()[: len(sums)].sum())
                owner, _ = _spread(sizes)
                times, (counts, best) = known.times()[seen:], lookup(known.pairs()[seen:])
                more = np.zeros((len(sizes), 6), np.int64)
                more[:, :3] = known.numbers()[len(sums) :]
                for j, value in enumerate((times, times * best, times * counts), 3):
                    np.add.at(more[:, j], owner, value)
                sums = np.concatenate([sums, more])
            total = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(sums[numbers], 0)])
            out = total[begins[1:]] - total[begins[:-1]]
            columns = [pa.array(c) for c in out.T]
            if first:
                strings = [";".join([known.strings[c] for c in numbers[i:j]]) for i, j in zip(begins, begins[1:])]
                columns.append(pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings], pa.string()))
                if with_groups:
                    columns.append(pa.array(strings, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(out)), *columns], ["doc_id", *names, *["groups_sha256"] * first, *["groups"] * (first and with_groups)])

    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", groups_sha256 string" * first + ", groups string" * (first and with_groups))


def align_documents(
    df: DataFrame, path_a: str, path_b: str, slice_pairs: int = 1 << 17, least_slices: int = 16, group_pairs: int = 1 << 21, salt_rows: int = 1 << 21, fan: int = 8,
    most_pairs: int = 1 << 20, most_chunks: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with_groups adds the groups `a1,a2|b1;a3|b2,b3`.

    slice_pairs: distinct pairs of a slice, of which there are least_slices or more. group_pairs: of a broadcast. salt_rows: partial counts that fill one vector. most_pairs and
    most_chunks: pairs, and characters of chunks, that a task holds.
    """
    spark = df.sparkSession
    paths = (path_a, path_b)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    partial = keep(spark, partial_counts(docs, paths, most_chunks, most_pairs), "partial")
    pairs = keep(spark, partial.select("pair").distinct(), "pairs")
    slices = max(least_slices, -(-pairs.count() // slice_pairs))
    hashes = keep(spark, perfect_slices(_with_slice(pairs, slices), slices), "hashes")
    salts = max(1, -(-partial.count() // (slices * salt_rows)))
    counted = keep(spark, dense_counts(_with_slice(partial, slices), hashes, slices, salts, fan), "counted")
    table = keep(spark, marked_best(counted), "counts")
    sizes = sorted((r.slice, r.n) for r in table.select("slice", (F.octet_length("counts") / 8).cast("long").alias("n")).collect())
    groups: list[list[int]] = [[]]
    room = group_pairs
    for number, n in sizes:
        if n > room and groups[-1]:
            groups.append([])
            room = group_pairs
        groups[-1].append(number)
        room -= n

    def passed(k: int, rows: DataFrame) -> DataFrame:
        group = table.filter(F.col("slice").isin(groups[k])).collect()
        return looked_up(rows, paths, group, slices, k == 0, most_chunks, with_groups)

    if len(groups) == 1:
        return passed(0, docs)
    # one row's sums of all groups meet by its place in the table
    place = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("place")).alias("doc_id"), "text")
    found = keep(spark, passed(0, place), "sums")
    more = reduce(DataFrame.union, (keep(spark, passed(k, place), "sums").select(F.col("doc_id.place").alias("place"), "n_best", "count_sum") for k in range(1, len(groups))))
    added = more.groupBy("place").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    both = found.withColumn("place", F.col("doc_id.place")).join(added, "place")
    sums = {"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum"), "doc_id": F.col("doc_id.doc_id")}
    return both.select(*(sums.get(c, F.col(c)).alias(c) for c in found.columns))
