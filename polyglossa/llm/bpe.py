"""BPE encoding and decoding by a pair occurrence index.

Texts are cut at ASCII white space into chunks (no token spans white space) and the distinct chunks of a step of text into words. The
distinct words that a task has not met yet are encoded together: every adjacent symbol pair is mapped to all its positions in the
batch, active ranks are applied in ascending order, and each merge updates only the lists of the pairs it touches. The ids of a
text are then the joined ids of its chunks. The vocabulary file is a parameter and each task reads it through Spark's file distribution.

Nulls count as the empty text (0 ids). A null doc_id stays null. Repeated rows give repeated rows. Other columns are not read.
Text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import text_buffers, text_steps

#: Distinct words that a worker remembers; the store starts anew beyond it.
REMEMBERED = 500_000
#: Bytes of text that are encoded at a time.
TEXT_STEP = 12 << 20

OTHER, LETTER, DIGIT, FOREIGN = 0, 1, 2, 3
#: Ends of English contractions, which the word-end vocabularies cut off as words.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _classes() -> np.ndarray:
    """Class of each byte in lower-cased text of ASCII and U+00C0..U+017F, whose letters NFC keeps; other bytes are FOREIGN."""
    kinds = np.full(256, FOREIGN, np.uint8)
    kinds[:128] = OTHER
    kinds[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
    kinds[48:58] = DIGIT
    return kinds


CLASSES = _classes()
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Code points of two bytes that are no letters, or whose lower case is no single letter: left to the library.
UNEVEN = np.array([0xD7, 0xF7, 0x130])
LATIN_LOWER = np.array([ord(chr(c).lower()) if c not in UNEVEN else c for c in range(0x180)])


def ragged(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat, one after the other, and their offsets in the result."""
    offsets = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=offsets[1:])
    at = np.repeat(first - offsets[:-1], count)
    at += np.arange(len(at))
    return flat[at], offsets


def binary_array(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Vocabulary:
    """Ranks, ids and special tokens of a tokenizers JSON file with word ends; other kinds of files are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        if not self.end or spec.get("decoder") or not plain:
            raise ValueError(f"{path}: only byte-level files with word ends, no decoder and plain special tokens are read")
        self.ids: dict[str, int] = spec["model"]["vocab"]
        names = {i: s for s, i in self.ids.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        ranks = {(self.ids[a], self.ids[b]): self.ids[a + b] for a, b in merges}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: s for s, i in self.special.items()}
        # the longest special token that starts at a place wins
        self.cut = "|".join(re.escape(s) for s in sorted(self.special, key=lambda s: (-len(s), s)))
        letters = byte_letters()
        self.bytes = {x: b for b, x in enumerate(letters)}
        self.plain = np.array([self.ids[x] for x in letters])
        self.final = np.array([self.ids[x + self.end] for x in letters])
        self.left, self.right, self.new = (np.array(c, np.int64) for c in zip(*((a, b, n) for (a, b), n in ranks.items())))
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.rules = Tokenizer.from_file(path)
        # what an id becomes in each form: its four bytes, its decimal digits, its name
        size = max(names) + 1
        table = [[str(i).encode() + b" " for i in range(size)], [names.get(i, "").encode() + b" " for i in range(size)]]
        self.forms = [(np.frombuffer(b"".join(t), np.uint8), np.r_[0, np.cumsum([len(x) for x in t])]) for t in table]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def foreign_words(self, chunk: bytes) -> list[bytes]:
        """Words of a chunk beyond Latin letters: the library normalizes and cuts it, by its version of Unicode."""
        return [bytes(map(self.bytes.get, w)) for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(chunk.decode()))]

    def words(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all chunks in order, in lower case, and how many each chunk has."""
        data, offsets = text_buffers(chunks)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        low, kind = ASCII_LOWER[data], CLASSES[data]
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
        code = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
        kind[lead[np.isin(code, UNEVEN)]] = FOREIGN
        lower = LATIN_LOWER[code]
        low[lead], low[lead + 1] = 0xC0 | lower >> 6, 0x80 | lower & 0x3F
        foreign = np.r_[0, np.cumsum(kind == FOREIGN)]
        foreign = foreign[offsets[1:]] > foreign[offsets[:-1]]
        # a word starts with a chunk, at a change of class, and at each digit
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts[offsets] = True
        mark = np.flatnonzero((data == 39) & starts[:-1])
        ends = offsets[np.searchsorted(offsets, mark, "right")]
        padded = np.r_[low, np.zeros(2, np.uint8)]
        for tail in CONTRACTIONS:
            hit = mark + len(tail) < ends
            for k, letter in enumerate(tail):
                hit &= padded[mark + 1 + k] == letter
            starts[mark[hit] + 1] = False
            starts[mark[hit] + 1 + len(tail)] = True
        at = np.flatnonzero(starts[:-1])
        own = np.searchsorted(offsets, at, "right") - 1
        counts = np.bincount(own, minlength=len(chunks))
        found = binary_array(np.r_[at, len(data)], low)
        odd = np.flatnonzero(foreign)
        if not len(odd):
            return found, counts
        mine = [self.foreign_words(c) for c in chunks.take(pa.array(odd)).cast(pa.binary()).to_pylist()]
        found = pa.concat_arrays([found, pa.array([w for m in mine for w in m], pa.large_binary())])
        first = np.cumsum(counts) - counts
        counts[odd] = [len(m) for m in mine]
        first[odd] = len(at) + np.cumsum(counts[odd]) - counts[odd]
        return found.take(pa.array(ragged(np.arange(len(found)), first, counts)[0])), counts


def merge_batch(words: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Apply the merges to all words (bytes, none empty) at once: their ids and how many each has.

    Symbols of all words lie in one array with links to their neighbours; where[rank] lists the left positions of a pair.
    Positions that a merge has changed since are recognised when their list is read.
    """
    data, offsets = text_buffers(words)
    data, ends = data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
    lengths = np.diff(offsets)
    symbol = v.plain[data]
    symbol[ends - 1] = v.final[data[ends - 1]]
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[ends - lengths] = -1, -1
    where: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(left: np.ndarray) -> None:
        """Add the pairs that start at these positions to the index."""
        ranks = v.ranks_of(symbol[left], symbol[after[left]])
        hit = ranks >= 0
        ranks, left = ranks[hit], left[hit]
        if not len(left):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, left = ranks[order], left[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(left)]
        for x, y in zip(cuts, cuts[1:]):
            rank = int(ranks[x])
            if rank not in where:
                where[rank] = []
                heapq.heappush(active, rank)
            where[rank].append(left[x:y])

    if n:
        note(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = where.pop(rank)
        i = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = v.left[rank], v.right[rank]
        j = after[i]
        i = i[(symbol[i] == a) & (j >= 0) & (symbol[j] == b)]
        if a == b and len(i):  # runs of one symbol: leftmost first, no overlap
            taken, i = -1, np.unique(i)
            chosen = []
            for x in i.tolist():
                if x != taken:
                    chosen.append(x)
                    taken = after[x]
            i = np.array(chosen, np.int64)
        elif len(lists) > 1:
            i = np.sort(i)
            i = i[np.r_[True, i[1:] != i[:-1]]] if len(i) else i
        if not len(i):
            continue
        j = after[i]
        k = after[j]
        symbol[i], symbol[j], after[i] = v.new[rank], -1, k
        inner = k >= 0
        before[k[inner]] = i[inner]
        h = before[i]
        # a merged symbol whose neighbour was merged too is named by both; the index may hold a place twice
        note(np.concatenate((h[h >= 0], i[inner])))
    live = symbol >= 0
    counts = np.add.reduceat(live, ends - lengths) if n else np.zeros(0, np.int64)
    return symbol[live], counts


class Encoder:
    """Encodes texts step by step; keeps the ids of the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.counts = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the store."""
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, self.words)
        if len(self.words) + known.null_count > REMEMBERED:
            self.forget()
            known = pc.index_in(coded.dictionary, self.words)
        places, fresh = known.fill_null(-1).to_numpy().astype(np.int64), known.is_null()
        if known.null_count:
            added = coded.dictionary.filter(fresh)
            ids, counts = merge_batch(added, self.v)
            places[fresh.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(added))
            self.words = pa.concat_arrays([self.words, added])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return places[coded.indices.to_numpy()]

    def steps(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(first row, rows, text ends in chunks, chunk ids, chunk id offsets, the step's chunks as places of these) of each step."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets = text_buffers(column)
        for a, b in text_steps(offsets, TEXT_STEP):
            texts = column.slice(a, b - a)
            special = bool(self.v.cut) and pc.any(pc.match_substring_regex(texts, self.v.cut)).as_py()
            if special:
                texts = pc.replace_substring_regex(texts, f"({self.v.cut})", r" \1 ")
            split = pc.ascii_split_whitespace(texts)
            chunks = split.flatten().dictionary_encode()
            words, counts = self.v.words(chunks.dictionary)
            if special:  # a chunk that is a special token has one word, which stands for it
                names = chunks.dictionary.to_pylist()
                which = [k for k, c in enumerate(names) if c in self.v.special]
                first = np.cumsum(counts) - counts
                kept = counts.copy()
                kept[which] = 0
                words, counts = words.take(pa.array(ragged(np.arange(len(words)), first, kept)[0])), kept
            places = self.learn(words)
            own = np.cumsum(self.counts) - self.counts
            ids, ends = ragged(self.ids, own[places], self.counts[places])
            at = ends[np.r_[0, np.cumsum(counts)]]
            if special:
                ids = np.insert(ids, at[which], [self.v.special[names[k]] for k in which])
                grown = np.diff(at)
                grown[which] = 1
                at = np.r_[0, np.cumsum(grown)]
            ends = split.offsets.to_numpy()
            yield a, b - a, ends - ends[0], ids, at, chunks.indices


def joined(ids: np.ndarray, at: np.ndarray, which: pa.Array, table=None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chunks `which` one after the other, in the form of the table (none: four bytes an id), and their offsets."""
    if table is None:
        form = binary_array(4 * at, ids.astype("<u4").view(np.uint8))
    else:
        flat, first = table
        data, ends = ragged(flat, first[ids], first[ids + 1] - first[ids])
        form = binary_array(ends[at], data)
    return text_buffers(form.take(which))


def ship(df: DataFrame, path: str) -> str:
    """Give the vocabulary file to all executors; returns its name there."""
    context = df.sparkSession.sparkContext
    name = path.rsplit("/", 1)[-1]
    if not any(str(f).rsplit("/", 1)[-1] == name for f in context.listFiles):
        context.addFile(path)
    return name


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(name: str) -> Encoder:
    """Kept from task to task in a Python worker, with the words it knows."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(Vocabulary(SparkFiles.get(name)))
    return _ENCODERS[name]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each row: (id, ids array<int>, decoded string)."""
    name = ship(df, path)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        encoder = encoder_for(name)
        for b in batches:
            for at, rows, ends, ids, places, which in encoder.steps(b.column(1)):
                data, offsets = joined(ids, places, which)
                names, to = joined(ids, places, which, encoder.v.forms[1])
                found = pa.ListArray.from_arrays(pa.array((offsets[ends] // 4).astype(np.int32)), pa.array(data.view("<u4").astype(np.int32)))
                names = names.tobytes()
                decoded = [names[x : max(x, y - 1)].decode() for x, y in zip(to[ends[:-1]].tolist(), to[ends[1:]].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + rows], found, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def encode_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, SHA-256 of the ids in decimal and of the decoded text.

    The file names no decoder, so decoding joins the tokens' names by a space, special tokens included.
    """
    name = ship(df, path)
    kind = dict(df.dtypes)[id_col]

    def digests(data, offsets, ends):
        view = memoryview(data)
        return pa.array([hashlib.sha256(view[x : max(x, y - 1)]).hexdigest() for x, y in zip(offsets[ends[:-1]].tolist(), offsets[ends[1:]].tolist())], pa.string())

    def run(batches):
        encoder = encoder_for(name)
        for b in batches:
            for at, rows, ends, ids, places, which in encoder.steps(b.column(1)):
                total = np.r_[0, np.cumsum(np.diff(places)[which.to_numpy()])]
                found = (digests(*joined(ids, places, which, form), ends) for form in encoder.v.forms)
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + rows], pa.array(np.diff(total[ends])), *found], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_pieces(df: DataFrame, path: str, most: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each row plus end_id, cut every `most` ids: doc_id, start, length, ids_crc32, doc_tokens, part, nth.

    nth counts the earlier pieces of that length in the task `part`; written to a table, both stay as they are.
    """
    name = ship(df, path)
    kind = dict(df.dtypes)[id_col]
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = encoder_for(name)
        part, met = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for b in batches:
            for at, rows, ends, ids, places, which in encoder.steps(b.column(1)):
                data, offsets = joined(ids, places, which)
                view, edges = memoryview(data), offsets[ends]
                total = np.diff(edges) // 4 + 1
                pieces = -(-total // most)
                row = np.repeat(np.arange(rows), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
                length = np.minimum(most, total[row] - start)
                sums = []
                for x, y, end in zip((edges[row] + 4 * start).tolist(), length.tolist(), edges[row + 1].tolist()):
                    crc = zlib.crc32(view[x : min(end, x + 4 * y)])
                    sums.append(crc if x + 4 * y <= end else zlib.crc32(last, crc))
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                first = np.searchsorted(sorted_, sorted_)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - first + met[sorted_]
                met += np.bincount(length, minlength=most + 1)
                columns = (start, length, np.array(sums, np.int64), total[row], np.full(len(row), part), nth)
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + rows].take(pa.array(row)), *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")
