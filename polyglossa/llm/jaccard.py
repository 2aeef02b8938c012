"""Exact n-gram Jaccard join by set-relation skipping.

A document's set is its distinct five-word shingles (64-bit hashes). Documents with equal sets are one node, named by 64 bits of a hash
and by 128 where those collide. Shingles are ordered from rare to frequent by a sketch that counts all documents and whose size
follows the input, then by hash; any order gives the same links. Each node is listed under the shingles of its prefix with its
size and its position there.

Index level: a list is ordered by size and position. Of two size blocks, only the heads up to the positions that leave room
for enough overlap are paired; the rest of a block, and blocks of other sizes, are skipped. A list that the sketch finds long is
dealt over several tasks, by other parts in every turn; in the last turn, nodes outside the list's most frequent component visit all of its parts.
In long lists, sets are first told apart by parity bits of their shingles: sets that differ in fewer places than bits differ do not exist.

Answer level: nodes are first compared with the leader of a list, and overlaps are kept. Members of a component found so far reach
each other, so later turns compare only nodes of different components; and a node's answer for x is derived from those of the leader l
that it links with, where o(x, l) plus or minus the difference of the two sets decides. No pair that could join two components is
left out, so the components are those of all links.

Null, empty and wordless texts have no shingles and link with nothing; their component is their own doc_id. Rows with a null
doc_id take part, and a component's id is the smallest one that is not null (null if there is none). Repeated rows share a node. Other columns are not
read. Long texts give long lists of shingles, all of which count.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bitmap, brief_shuffles, discard, in_bitmap, keep, mix, signed, text_buffers, text_steps, windows_of, words_of
from .graph import components, joined

#: Bits of the sketch (at least, at most): one counter for about 64 shingles of the input, dealt in blocks of BLOCK counters. Beyond
#: the most it tells tokens apart that are more frequent than the mean of a counter; their lists are the long ones.
SKETCH_BITS, BLOCK = (16, 24), 4096
#: Nodes of one list that a task gets at a time.
LIST = 2_000
#: Nodes of a list that is not cut into blocks.
SHORT = 32
#: Most rounds of neighbours before all open pairs are compared; in the last of them, the nearest by parity in long lists.
TURNS = 3
#: Most parity bits of a set; it has two to four for each shingle, 64 at least. Of sets with far more shingles than this, they tell fewer apart.
PARITY = 4_096
#: Neighbours of a node in a list, in the first turn and later.
NEAR = (4, 16)


def shingle_sets(column: pa.Array, n: int):
    """(row, sorted distinct shingle hashes, node, check) of each row that has words; node and check name the set."""
    data, offsets = text_buffers(column)
    for a, b in text_steps(offsets):
        hashes, _, _, counts = words_of(data, offsets[a : b + 1], lower=True)
        found, at = windows_of(hashes, counts, n)
        ends = np.cumsum(counts)
        cuts = np.searchsorted(at, np.r_[0, ends])
        for k in range(b - a):
            own = found[cuts[k] : cuts[k + 1]]
            if not len(own):
                if not counts[k]:
                    continue
                w = hashes[ends[k] - counts[k] : ends[k]]
                with np.errstate(over="ignore"):  # fewer words than n: one shingle of all of them
                    x = U64(counts[k])
                    for h in w:
                        x = x * U64(0xE7037ED1A0B428DB) + h
                own = mix(np.array([x], U64))
            own = np.sort(own)
            if len(own) > 1:
                own = own[np.r_[True, own[1:] != own[:-1]]]
            with np.errstate(over="ignore"):
                sums = np.array([mix(own ^ U64(0x1D8E4E27C47D124F)).sum(dtype=U64), (own * U64(0xD1342543DE82EF95) ^ (own >> U64(29))).sum(dtype=U64)])
                node, check = mix(sums + U64(len(own))).tolist()
            yield a + k, own, node, check


def _needed(a, b):
    """Least overlap of linked sets of these sizes: 9 * overlap >= 4 * (a + b)."""
    return -(-4 * (a + b) // 9)


def _prefix(n):
    """Tokens of a set of n that a partner of at most its size must share one of; and of at least its size."""
    return n - _needed(n, -(-4 * n // 5)) + 1, n - _needed(n, n) + 1


def _may_link(size_a, pos_a, size_b, pos_b):
    """Whether sets whose first common token stands at these positions can link."""
    swap = size_a > size_b
    s, ps = np.where(swap, size_b, size_a), np.where(swap, pos_b, pos_a)
    l, pl = np.where(swap, size_a, size_b), np.where(swap, pos_a, pos_b)
    return (5 * s >= 4 * l) & (ps < _prefix(s)[1]) & (pl < _prefix(l)[0]) & (np.minimum(s - ps, l - pl) >= _needed(s, l))


def _parity(own: np.ndarray) -> bytes:
    """For each value of the low bits of a hash, whether an odd number of shingles has it; bits that differ stand for as many shingles that differ."""
    bits = min(PARITY, max(64, 1 << (2 * len(own) - 1).bit_length()))
    return np.packbits((np.bincount((own & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _folded(parity: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity words as they are with fewer bits."""
    while parity.shape[1] > width:
        half = parity.shape[1] // 2
        parity = parity[:, :half] ^ parity[:, half:]
    return parity


def _packed(counts: np.ndarray) -> bytes:
    """A block of counters, mostly small or none: a task's blocks take the room of its shingles, however many counters the input has."""
    return zlib.compress((counts.astype(np.uint8) if counts.max() < 256 else counts.astype(np.int32)).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, np.uint8 if len(raw) == BLOCK else np.int32)


def _profile(df: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows of documents (doc_id, n, node, check, parity), and rows of each task's sketch (block, counts)."""

    def run(batches):
        sketch, seen = np.zeros(1 << bits, np.int32), set()
        names = ["doc_id", "n", "node", "check", "parity", "block", "counts"]
        kind = None
        for b in batches:
            sizes, nodes, held, parity = np.zeros(len(b), np.int64), np.zeros((2, len(b)), U64), [], [None] * len(b)
            kind = b.column(0).type
            for row, own, node, check in shingle_sets(b.column(1), n):
                sizes[row], nodes[0, row], nodes[1, row] = len(own), node, check
                if (node, check) not in seen:
                    seen.add((node, check))
                    held.append(own)
                    parity[row] = _parity(own)  # once for a node of a task
            if held:
                sketch += np.bincount((np.concatenate(held) >> U64(64 - bits)).astype(np.int64), minlength=len(sketch)).astype(np.int32)
            none = pa.nulls(len(b), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), *(pa.array(signed(x)) for x in nodes), pa.array(parity, pa.binary()), none, pa.nulls(len(b), pa.binary())], names)
        if kind is not None:
            parts = sketch.reshape(-1, BLOCK)
            used = np.flatnonzero(parts.any(1))
            zero = pa.array(np.zeros(len(used), np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), kind), zero, zero, zero, pa.nulls(len(used), pa.binary()), pa.array(used.astype(np.int32)), pa.array([_packed(parts[k]) for k in used], pa.binary())], names)

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n long, node long, check long, parity binary, block int, counts binary")


def _frequencies(profile: DataFrame, bits: int) -> np.ndarray:
    """The class of each counter of the summed sketch, four for each power of two; one byte each."""

    def add(batches):
        last, total = None, None

        def done():
            level = np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "counts"])

        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1)):
                if block != last:
                    if last is not None:
                        yield done()
                    last, total = block, np.zeros(BLOCK, np.int64)
                total += _unpacked(counts.as_buffer())
        if last is not None:
            yield done()

    parts = profile.filter("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.mapInArrow(add, "block int, counts binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return out


def _named(node: int, check: int, collided: frozenset[int]) -> int:
    return node ^ check if node in collided else node


def _postings(df: DataFrame, n: int, bits: int, classes, floor: float, collided: frozenset[int]) -> DataFrame:
    """token, parts, place (size << 32 | position), node for the prefix of each node, once in a task; parts: of a long list."""

    def run(batches):
        seen, rank = set(), classes.value
        likely = np.exp2((np.arange(256) + 1) / 4) - 1
        parts = np.where(likely > LIST + 4 * floor, np.ceil(likely / LIST), 1).astype(np.int64)
        names = ["token", "parts", "place", "node"]
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]

            def flush():
                cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

            held = 0
            for _, own, node, check in shingle_sets(b.column(1), n):
                if (node, check) in seen:
                    continue
                seen.add((node, check))
                size = len(own)
                take = _prefix(size)[0]
                # hashes are sorted already, so a stable sort by class orders by (class, hash)
                level = rank[(own >> U64(64 - bits)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:take]
                out[0].append(signed(own[order]))
                out[1].append(parts[level[order]])
                out[2].append((size << 32) + np.arange(take))
                out[3].append(np.full(take, _named(node, check, collided), U64).view(np.int64))
                held += take
                if held > 500_000:
                    yield flush()
                    held = 0
            yield flush()

    return df.mapInArrow(run, "token long, parts long, place long, node long")


def _dealt(postings: DataFrame, turn: int, *columns: str) -> DataFrame:
    """list, parts, place, node and more columns, each list (or part of a long one, other parts in every turn) together."""
    part = F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("parts"))
    name = F.when(F.col("parts") > 1, F.xxhash64("token", part)).otherwise(F.col("token")).alias("list")
    return postings.select(name, *columns).repartition("list").sortWithinPartitions("list")


def _lists(batches):
    """Whole posting lists: arrays of the columns, sorted by the first, of many lists at a time."""
    rest = None
    for b in batches:
        now = np.stack([c.to_numpy() for c in b.columns])
        if rest is not None:
            now = np.concatenate([rest, now], 1)
        if not now.shape[1]:
            continue
        cut = int(np.searchsorted(now[0], now[0, -1]))
        rest = now[:, cut:]
        if cut:
            yield now[:, :cut]
    if rest is not None and rest.shape[1]:
        yield rest


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.concatenate(a), np.concatenate(b)
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (_unique_pairs(a, b) if a else (np.zeros(0, np.int64),) * 2)], ["a", "b"])


def _shared(postings: DataFrame) -> DataFrame:
    """kind 0: postings of tokens of two nodes or more; kind 1: (leader, node) pairs to compare (in columns place, node)."""
    names = ["kind", "token", "parts", "place", "node"]

    def run(batches):
        for token, list_, parts, place, node in (now[[1, 0, 2, 3, 4]] for now in _lists(batches)):
            order = np.lexsort((node, list_))
            token, list_, parts, place, node = token[order], list_[order], parts[order], place[order], node[order]
            new = np.ones(len(list_), bool)
            new[1:] = (list_[1:] != list_[:-1]) | (node[1:] != node[:-1])
            token, list_, parts, place, node = token[new], list_[new], parts[new], place[new], node[new]
            same = list_[1:] == list_[:-1]
            shared = np.r_[same, False] | np.r_[False, same] | (parts > 1)
            token, list_, parts, place, node = token[shared], list_[shared], parts[shared], place[shared], node[shared]
            if not len(token):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(token), np.int32)), *map(pa.array, (token, parts, place, node))], names)
            heads, members = [], []
            while len(list_):
                # the leader is the smallest node of a list, so that lists of one group agree on it
                first = np.r_[True, list_[1:] != list_[:-1]]
                head = np.flatnonzero(first)[np.cumsum(first) - 1]
                ok = ~first & _may_link(place[head] >> 32, place[head] & 0xFFFFFFFF, place >> 32, place & 0xFFFFFFFF)
                heads.append(node[head[ok]])
                members.append(node[ok])
                left = ~first & ~ok
                list_, place, node = list_[left], place[left], node[left]
            a, b = _unique_pairs(heads, members)
            if len(a):
                zero = pa.array(np.zeros(len(a), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), zero, zero, pa.array(a), pa.array(b)], names)

    return _dealt(postings, 0, "token", "parts", "place", "node").mapInArrow(run, "kind int, token long, parts long, place long, node long")


def _several(key: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows of lists that hold more than one label."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    differ = np.maximum.reduceat(label, first) != np.minimum.reduceat(label, first)
    return np.repeat(differ, np.diff(np.r_[first, len(key)]))


def _beside(lists: DataFrame, turn: int) -> DataFrame:
    """(a, b) to compare: nodes with different labels that stand near each other in a list, ordered by hash and, in the first turn, by place; then also each with the list's leader."""

    def run(batches):
        for now in _lists(batches):
            key, place, node, label = now[:, _several(now[0], now[3])]
            if not len(key):
                continue
            a, b = [], []
            with np.errstate(over="ignore"):
                chance = signed(mix(node.view(U64) ^ mix(key.view(U64) + U64(turn))))
            for by, most in ((chance, NEAR[turn > 0]), *([(place, 1)] if turn == 0 else [])):
                order = np.lexsort((by, key))
                k, p, n, l = key[order], place[order], node[order], label[order]
                for d in range(1, min(most, len(k) - 1) + 1):
                    ok = (k[d:] == k[:-d]) & (l[d:] != l[:-d])
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    at = at[_may_link(p[at + d] >> 32, p[at + d] & 0xFFFFFFFF, p[at] >> 32, p[at] & 0xFFFFFFFF)]
                    a.append(n[at + d])
                    b.append(n[at])
            if turn == 0:
                order = np.lexsort((node, key))
                key, place, node, label = key[order], place[order], node[order], label[order]
                first = np.r_[True, key[1:] != key[:-1]]
                head = np.flatnonzero(first)[np.cumsum(first) - 1]
                ok = (label != label[head]) & _may_link(place[head] >> 32, place[head] & 0xFFFFFFFF, place >> 32, place & 0xFFFFFFFF)
                a.append(node[head[ok]])
                b.append(node[ok])
            yield _pair_batch(a, b)

    return _dealt(lists, turn, "place", "node", "label").mapInArrow(run, "a long, b long").distinct()


def _blocks(size: np.ndarray, pos: np.ndarray, label: np.ndarray, guest: np.ndarray, parity: list[bytes]):
    """Pairs (rows, rows, bits that differ) of one list, sorted by size and position, that may link and differ in label; of two guests or of none only if at home."""
    edge = np.r_[np.flatnonzero(np.r_[True, size[1:] != size[:-1]]), len(size)]
    sizes = size[edge[:-1]]
    words = [np.frombuffer(b"".join(parity[i:j]), U64).reshape(j - i, -1) for i, j in zip(edge[:-1], edge[1:])]
    for i, s in enumerate(sizes.tolist()):
        for j in range(i, int(np.searchsorted(sizes, 5 * s // 4, "right"))):
            # heads of the blocks up to the positions that leave room for the overlap; what stands behind is skipped
            l, least = int(sizes[j]), _needed(s, int(sizes[j]))
            x = slice(edge[i], edge[i] + np.searchsorted(pos[edge[i] : edge[i + 1]], min(s - least + 1, _prefix(s)[1])))
            z = slice(edge[j], edge[j] + np.searchsorted(pos[edge[j] : edge[j + 1]], min(l - least + 1, _prefix(l)[0])))
            if x.stop == x.start or z.stop == z.start:
                continue
            left, right = words[i], _folded(words[j], words[i].shape[1])
            step = max(1, (1 << 20) // right.size)
            for at in range(x.start, x.stop, step):
                rows = slice(at, min(at + step, x.stop))
                ok = (label[rows, None] != label[None, z]) & ~(guest[rows, None] & guest[None, z])
                p, q = np.nonzero(ok)
                if len(p):
                    p, q = p + at, q + z.start
                    apart = np.bitwise_count(left[p - edge[i]] ^ right[q - edge[j]]).sum(1, dtype=np.int64)
                    near = np.flatnonzero(apart <= s + l - 2 * least)
                    yield p[near], q[near], apart[near]


def _tables(batches):
    """Whole lists as Arrow tables, sorted by their first column, of one list or several at a time."""
    rest = None
    for b in batches:
        now = pa.Table.from_batches([b])
        if rest is not None:
            now = pa.concat_tables([rest, now]).combine_chunks()
        if not now.num_rows:
            continue
        key = now.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        rest = now.slice(cut)
        if cut:
            yield now.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def _across(lists: DataFrame, parity: DataFrame, nearest: bool) -> DataFrame:
    """(a, b) to compare: nodes of one list with different labels, all that may link, or of a long list's nodes each one's nearest by parity.

    lists: token, parts, place, node, label; parity: node, parity, repeated for copies.
    """
    counts = lists.groupBy("token", "label").agg(F.count("*").alias("n"))
    mode = counts.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("mode"), F.count("*").alias("labels"), F.sum("n").alias("all")).filter("labels > 1").select("token", "mode", "all")
    open_ = lists.join(mode.filter(F.col("all") > SHORT) if nearest else mode, "token")
    part = F.pmod(F.xxhash64(F.lit(-1), "node"), F.col("parts"))
    home = open_.select("token", part.alias("part"), "place", "node", "label", F.lit(0).cast("long").alias("guest"), "all")
    # a long list: nodes outside its most frequent component go to the other parts as well
    visits = open_.filter("parts > 1 and label <> mode").select("token", part.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "place", "node", "label", "all")
    both = home if nearest else home.unionByName(visits.filter("own <> part").select("token", "part", "place", "node", "label", F.lit(1).cast("long").alias("guest"), "all"))
    dealt = both.select(F.xxhash64("token", "part").alias("list"), "place", "node", "label", "guest", "all")
    long_ = dealt.filter(F.col("all") > SHORT).drop("all")
    held = parity.join(open_.filter(F.col("all") > SHORT).select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("parity").alias("parity"))
    long_ = long_.join(held, "node").select("list", "place", "node", "label", "guest", "parity").repartition("list").sortWithinPartitions("list")

    def wide(batches):
        for now in _tables(batches):
            whole = np.stack([now.column(c).to_numpy() for c in range(5)])
            some = np.flatnonzero(_several(whole[0], whole[3]))
            some = some[np.lexsort((whole[1, some], whole[0, some]))]
            key, place, node, label, guest = whole[:, some]
            bits = now.column(5).take(pa.array(some)).to_pylist()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
            a, b, held = [], [], 0
            for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                least, best = np.full(z - x, 1 << 40), np.full(z - x, -1)
                for p, q, apart in _blocks(place[x:z] >> 32, place[x:z] & 0xFFFFFFFF, label[x:z], guest[x:z] > 0, bits[x:z]):
                    if nearest:
                        for one, other in ((p, q), (q, p)):
                            order = np.lexsort((apart, one))
                            order = order[np.r_[True, one[order][1:] != one[order][:-1]]] if len(order) else order
                            better = order[apart[order] < least[one[order]]]
                            least[one[better]], best[one[better]] = apart[better], other[better]
                        continue
                    a.append(node[x:z][p])
                    b.append(node[x:z][q])
                    held += len(p)
                    if held > 1_000_000:
                        yield _pair_batch(a, b)
                        a, b, held = [], [], 0
                if nearest:
                    at = np.flatnonzero(best >= 0)
                    a.append(node[x:z][at])
                    b.append(node[x:z][best[at]])
            yield _pair_batch(a, b)

    def short(batches):
        for now in _lists(batches):
            k, p, n, l = now[:, _several(now[0], now[3])]
            a, b = [], []
            for d in range(1, min(SHORT, len(k))):
                at = np.flatnonzero((k[d:] == k[:-d]) & (l[d:] != l[:-d]))
                at = at[_may_link(p[at + d] >> 32, p[at + d] & 0xFFFFFFFF, p[at] >> 32, p[at] & 0xFFFFFFFF)]
                a.append(n[at + d])
                b.append(n[at])
            yield _pair_batch(a, b)

    pairs = long_.mapInArrow(wide, "a long, b long")
    if not nearest:  # pair by pair at each distance; lists that are dealt over parts only by the sketch's error stay whole
        few = open_.filter(F.col("all") <= SHORT).select(F.col("token").alias("list"), "place", "node", "label").repartition("list").sortWithinPartitions("list")
        pairs = pairs.union(few.mapInArrow(short, "a long, b long"))
    return pairs.filter("a <> b").distinct()


def _filter_bits(n: int) -> int:
    """Bits of a membership filter for n keys: 16 for each, within 8 kB and 128 MB."""
    return max(16, min(30, math.ceil(math.log2(16 * max(n, 1)))))


def _compared(df: DataFrame, n: int, pairs: DataFrame, collided: frozenset[int]) -> DataFrame:
    """a, b, o (overlap), m, n (sizes) of pairs (a, b), a stored table, compared on their whole sets, which are read from the texts again."""
    spark = df.sparkSession
    nodes = keep(spark, pairs.select("a").union(pairs.select("b")).distinct(), "nodes")
    wanted = spark.sparkContext.broadcast(bitmap(spark, nodes, _filter_bits(nodes.count())))
    discard(spark, nodes)

    def table(nodes, sets):
        flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(signed(np.array(nodes, U64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "own"])

    def run(batches):
        seen, filter_ = set(), wanted.value
        for b in batches:
            nodes, sets, held = [], [], 0
            for _, own, node, check in shingle_sets(b.column(1), n):
                if (node, check) in seen:
                    continue
                seen.add((node, check))
                name = _named(node, check, collided)
                if in_bitmap(filter_, np.array([name], U64))[0]:
                    nodes.append(name)
                    sets.append(own)
                    held += len(own)
                if held > 500_000:
                    yield table(nodes, sets)
                    nodes, sets, held = [], [], 0
            yield table(nodes, sets)

    sets = df.mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), F.size("x").alias("m"), F.size("y").alias("n"))


def _linked(o: Column, m: Column, n: Column) -> Column:
    return 9 * o >= 4 * (m + n)


def _derived(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """a, b, verdict of pairs whose answer follows from those of a leader: true or false; null if the pair must be compared.

    For a node x that links with leader l: o(x, y) lies between o(l, y) - |l - x| and o(l, y) + |x - l|.
    """
    both = answers.union(answers.select("b", "a", "o", "n", "m"))
    # of the sets that a node links with, the most similar one
    leader = both.filter(_linked(F.col("o"), F.col("m"), F.col("n"))).groupBy(F.col("b").alias("x")).agg(F.min_by(F.struct(F.col("a").alias("l"), (F.col("n") - F.col("o")).alias("more"), (F.col("m") - F.col("o")).alias("less"), F.col("n").alias("size")), F.struct(F.col("m") + F.col("n") - 2 * F.col("o"), "a")).alias("led"))
    leader = leader.select("x", "led.*")
    either = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("a", "b", F.col("b").alias("x"), F.col("a").alias("y")))
    known = either.join(leader, "x").join(both.select(F.col("a").alias("l"), F.col("b").alias("y"), "o", F.col("n").alias("other")), ["l", "y"])
    least, most = F.col("o") - F.col("less"), F.col("o") + F.col("more")
    verdict = F.when(_linked(least, F.col("size"), F.col("other")), True).when(~_linked(most, F.col("size"), F.col("other")), False)
    told = known.groupBy("a", "b").agg(F.max(verdict).alias("verdict"))
    return pairs.join(told, ["a", "b"], "left")


def join_documents(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of documents that link at a Jaccard similarity of 0.8 or more."""
    with brief_shuffles(df.sparkSession):
        own, named = _named_nodes(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words)
    return (
        own.join(named, (F.col("node") == F.col("named")) & (F.col("n") > 0), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _named_nodes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n, node), and the component_id of each node (named)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(SKETCH_BITS[0], min(SKETCH_BITS[1], math.ceil(math.log2(size / 400 + 1))))
    profile = keep(spark, _profile(docs, words, bits), "profile")
    own = profile.filter("block is null").select("doc_id", "n", "node", "check", "parity")
    # sets that share 64 bits but not the next 64: next to none, whatever the input
    twins = own.filter("n > 0").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x <> y").select("node").collect()
    collided = frozenset(r["node"] & 0xFFFFFFFFFFFFFFFF for r in twins)
    name = F.when(F.col("node").isin([r["node"] for r in twins]), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node")) if twins else F.col("node")
    own = own.select("doc_id", "n", name.alias("node"), "parity")
    classes = spark.sparkContext.broadcast(_frequencies(profile, bits))
    floor = (own.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    shared = keep(spark, _shared(_postings(docs, words, bits, classes, floor, collided)), "shared")
    postings = shared.filter("kind = 0").drop("kind")
    # a node meets its smallest leader first; its other leaders only while they are in another component
    near = keep(spark, shared.filter("kind = 1").groupBy(F.col("node").alias("b")).agg(F.min("place").alias("a")).select("a", "b"), "near")
    answers = [keep(spark, _compared(docs, words, near, collided), "answers")]
    scratch = [shared, near, answers[0]]
    links = answers[0].filter(_linked(F.col("o"), F.col("m"), F.col("n"))).select("a", "b")
    total = links.count()
    found = components(links)
    # components that are left apart: first neighbours in a list, a linear number of pairs, for as long as they link many nodes;
    # then every pair still open
    turn = 0
    parity = own.filter("parity is not null").select("node", "parity")
    while turn >= 0:
        lists = postings.join(found, "node", "left").select("token", "parts", "place", "node", F.coalesce("component", "node").alias("label"))
        every = answers[0]
        for x in answers[1:]:
            every = every.union(x)
        # each pair once, however many lists it stands in, before it is looked up
        pairs = keep(spark, _beside(lists, turn) if turn < TURNS - 1 else _across(lists, parity, turn < TURNS), "pairs")
        fresh = keep(spark, pairs.join(every.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
        open_ = keep(spark, _derived(fresh, every), "open")
        discard(spark, pairs, fresh)
        answers.append(keep(spark, _compared(docs, words, open_.filter("verdict is null").select("a", "b"), collided), "answers"))
        more = answers[-1].filter(_linked(F.col("o"), F.col("m"), F.col("n"))).select("a", "b").union(open_.filter("verdict").select("a", "b"))
        scratch += [open_, answers[-1]]
        gained, turn = more.count(), -1 if turn == TURNS else turn + 1
        total += gained
        if gained:
            found = joined(found, more)
        if 0 < turn < TURNS and gained * 50 < total:
            turn = TURNS
    nodes = own.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c"))
    ids = nodes.groupBy("c").agg(F.min("least").alias("component_id"))
    named = nodes.join(ids, "c").select(F.col("node").alias("named"), "component_id")
    named = keep(spark, named, "named")
    discard(spark, *scratch)
    return own, named
