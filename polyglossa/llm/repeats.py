"""Suffix-array dedup: remove every byte of a string of `length` bytes that also starts elsewhere.

Anchors make the work local. Of each run of grams as long as a window, the grams with the least hash are anchors, so equal
windows hold equal anchors at equal places. Anchors that occur once are dropped; the others keep their context, the bytes of all windows
that hold them. Contexts that are equal as a whole are repeats already. The others meet by anchor: a Burrows-Wheeler
transform of the contexts, with a mark at the anchor, is extended backward from the interval of the mark, one symbol of left context
at a time and all intervals breadth first. After l steps the members of an interval share l symbols to the left, in the order of their
right contexts; neighbours there that share `length` - l symbols to the right share a window. Intervals of one member are
dropped, and extension stops where a window would leave the anchor. An interval with more members than a task takes is cut before it
is extended: windows with at most so many steps to the left share the bytes right of the mark that all of them hold, the others those left of it,
so each half is dealt by these bytes, and again where it is still too large, until members share a whole window.

Texts are UTF-8 bytes, null counts as empty, texts shorter than `length` hold no window. Texts that occur twice are removed whole.
Rows with equal texts get equal results, whatever their doc_id (null too). Other columns are not read. Long texts are read in
overlapping pieces, whole.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, U64, bitmap, in_bitmap, keep, mix, prefix_sums, signed, span_hashes, text_buffers, text_steps

#: Bytes of a gram; contexts that one step of a task extends; most contexts of an interval that is not cut.
GRAM, STEP_CONTEXTS, MOST = 32, 20_000, 40_000
#: Fewest and most bits of a filter (64 MB); between them it has 16 for each key. A fuller one lets more through, and joins decide.
FILTER = (20, 29)


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of `width` values."""
    size, a = 1, x
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(x) - width + 1], a[width - size :][: len(x) - width + 1])


def _pieces(column: pa.Array, length: int):
    """(bytes, text starts, text ends, core start, core end, first row) of steps; a long text comes in overlapping pieces."""
    data, offsets = text_buffers(column)
    for a, b in text_steps(offsets):
        x, z = int(offsets[a]), int(offsets[b])
        for core in range(x, max(z, x + 1), STEP_BYTES * 2):
            lo, hi = max(x, core - 2 * length), min(z, core + STEP_BYTES * 2 + 2 * length)
            yield data[lo:hi], offsets[a:b] - lo, offsets[a + 1 : b + 1] - lo, core - lo, min(z, core + STEP_BYTES * 2) - lo, a


def _anchors(view: np.ndarray, starts: np.ndarray, ends: np.ndarray, core: tuple[int, int], length: int):
    """(place, gram hash, row in the step, hash sums) of the anchors in the core of a piece."""
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(view) < length:
        return none, none.view(U64), none, None
    sums = prefix_sums(view)
    at = np.arange(len(view) - GRAM + 1)
    grams = span_hashes(sums, at, at + GRAM)
    row = np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)
    fits = (at + GRAM <= ends[row]) & (at >= starts[row]) & ((ends - starts)[row] >= length)
    top = np.uint32(0xFFFFFFFF)
    key = np.minimum((grams >> U64(32)).astype(np.uint32), top - np.uint32(1))
    key[~fits] = top
    least = _sliding(np.minimum, key, width)
    pad = np.zeros(width - 1, np.uint32)
    chosen = np.flatnonzero((_sliding(np.maximum, np.concatenate([pad, least, pad]), width) == key) & fits)
    chosen = chosen[(chosen >= core[0]) & (chosen < core[1])]
    return chosen, grams[chosen], row[chosen], sums


def _marks(df: DataFrame, length: int) -> DataFrame:
    """Anchors with their counts, one row for each in a batch."""

    def run(batches):
        for b in batches:
            found = [_anchors(v, s, e, (c, d), length)[1] for v, s, e, c, d, _ in _pieces(b.column(0), length)]
            anchor, n = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(n)], ["anchor", "n"])

    return df.select("text").mapInArrow(run, "anchor long, n long")


def _contexts(df: DataFrame, length: int, wanted) -> DataFrame:
    """h, h2, lo, size, place, anchor, ctx, bytes: the context of each anchor that may repeat. bytes is null where the task gave them before."""

    def run(batches):
        bits, texts, given = wanted.value, set(), set()
        for b in batches:
            hashes, second = b.column(1).to_numpy(), b.column(2).to_numpy()
            fresh = np.zeros(len(b), bool)
            for k, h in enumerate(zip(hashes.tolist(), second.tolist())):
                if h not in texts:
                    texts.add(h)
                    fresh[k] = True
            cols, held = [[] for _ in range(8)], 0

            def flush():
                types = [pa.int64()] * 7 + [pa.binary()]
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if k < 7 and c else c, t) for k, (c, t) in enumerate(zip(cols, types))], ["h", "h2", "lo", "size", "place", "anchor", "ctx", "bytes"])
                for c in cols:
                    c.clear()
                return out

            for view, starts, ends, c, d, first in _pieces(b.column(0), length):
                at, gram, row, sums = _anchors(view, starts, ends, (c, d), length)
                use = in_bitmap(bits, gram) & fresh[first + row] if len(at) else np.zeros(0, bool)
                if not use.any():
                    continue
                at, gram, row = at[use], gram[use], row[use]
                lo, hi = np.maximum(starts[row], at + GRAM - length), np.minimum(ends[row], at + length)
                lo, hi = np.maximum(lo, 0), np.minimum(hi, len(view))
                ctx = span_hashes(sums, lo, hi) ^ mix((at - lo).astype(U64) + U64(1))
                raw = view.tobytes()
                blobs = []
                for key, x, y in zip((gram ^ ctx).tolist(), lo.tolist(), hi.tolist()):
                    blobs.append(None if key in given else raw[x:y])
                    given.add(key)
                for col, x in zip(cols, (hashes[first + row], second[first + row], lo - starts[row], hi - lo, at - lo, signed(gram), signed(ctx))):
                    col.append(x)
                cols[7] += blobs
                held += len(blobs)
                if held > 20_000:
                    yield flush()
                    held = 0
            yield flush()

    return df.select("text", "h", "h2").mapInArrow(run, "h long, h2 long, lo long, size long, place long, anchor long, ctx long, bytes binary")


def extend(group: np.ndarray, contexts: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest and most steps to the left at which each context's window recurs in its group; -1 where none does.

    group: one number per context, ascending; place: of the anchor in each context.
    """
    m, most = len(contexts), length - GRAM
    lens = np.fromiter(map(len, contexts), np.int64, m)
    right = np.frombuffer(b"".join(c[p : p + length].ljust(length, b"\0") for c, p in zip(contexts, place.tolist())), np.uint8).reshape(m, length)
    left = np.frombuffer(b"".join(c[:p].rjust(most, b"\0") for c, p in zip(contexts, place.tolist())), np.uint8).reshape(m, most)
    room = np.minimum(lens - place, length)
    # the suffixes that start at the mark, in order: by group, then by right context
    order = np.lexsort((np.ascontiguousarray(right).view(f"S{length}").ravel(), group))
    right, left, room, place_ = right[order], left[order], room[order], place[order]
    gid = group[order]
    # common prefix with the suffix before, and its range minima in a sparse table
    differ = right[1:] != right[:-1]
    lcp = np.r_[0, np.where(differ.any(1), differ.argmax(1), length)].astype(np.int16)
    table = [lcp]
    while 2 << (len(table) - 1) <= m:
        t = table[-1]
        half = 1 << (len(table) - 1)
        table.append(np.minimum(t[:-half], t[half:]))
    logs = np.zeros(m + 1, np.int64)
    if m > 1:
        logs[2:] = np.floor(np.log2(np.arange(2, m + 1))).astype(np.int64)

    def shared(p, q):
        """Common prefix of the suffixes at p < q: least value in p+1..q."""
        k = logs[q - p]
        out = np.empty(len(p), np.int16)
        for level in np.unique(k):
            s = k == level
            out[s] = np.minimum(table[level][p[s] + 1], table[level][q[s] - (1 << level) + 1])
        return out

    few, many = np.full(m, -1), np.full(m, -1)
    rows, interval = np.arange(m), gid
    for step in range(most + 1):
        if step:
            has = place_[rows] >= step
            rows, interval = rows[has], interval[has]
            # backward extension: members split by the symbol to their left and keep their order
            symbol = left[rows, most - step].astype(np.int64)
            by = np.argsort(interval * 256 + symbol, kind="stable")
            rows, key = rows[by], (interval * 256 + symbol)[by]
            interval = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else key
        same = interval[1:] == interval[:-1]
        alone = ~(np.r_[same, False] | np.r_[False, same]) if len(rows) else np.zeros(0, bool)
        rows, interval = rows[~alone], interval[~alone]
        if not len(rows):
            break
        able = room[rows] >= length - step
        r, i = rows[able], interval[able]
        if len(r) > 1:
            pair = i[1:] == i[:-1]
            p, q = r[:-1][pair], r[1:][pair]
            ok = shared(p, q) >= length - step
            hit = np.unique(np.concatenate([p[ok], q[ok]]))
            few[hit] = np.where(few[hit] < 0, step, few[hit])
            many[hit] = step
    out = np.empty((2, m), np.int64)
    out[0, order], out[1, order] = few, many
    return out[0], out[1]


def _matched(contexts: DataFrame, length: int) -> DataFrame:
    """anchor, ctx, s, e: the bytes of a context that lie in recurring windows. contexts: interval, anchor, ctx, place, bytes."""

    def solve(held):
        t = pa.Table.from_batches(held).combine_chunks()
        interval, anchor, ctx, place = (t.column(k).to_numpy() for k in range(4))
        order = np.lexsort((ctx, anchor, interval))
        key = np.stack([interval, anchor, ctx])[:, order]
        order = order[np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]]
        interval, anchor, ctx, place = interval[order], anchor[order], ctx[order], place[order]
        group = np.cumsum(np.r_[0, interval[1:] != interval[:-1]])
        few, many = extend(group, t.column(4).take(pa.array(order)).to_pylist(), place, length)
        hit = few >= 0
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (anchor, ctx, place - many, place - few + length)], ["anchor", "ctx", "s", "e"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            interval = b.column(0).to_numpy()
            cut = int(np.searchsorted(interval, interval[-1]))
            if n + cut >= STEP_CONTEXTS and (cut or held[-1].column(0)[-1].as_py() != interval[0]):
                yield solve([*held, b.slice(0, cut)])
                held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += len(b)
        if held:
            yield solve(held)

    contexts = contexts.select("interval", "anchor", "ctx", "place", "bytes")
    return contexts.repartition("interval").sortWithinPartitions("interval").mapInArrow(run, "anchor long, ctx long, s long, e long")


def _cut(spark, contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Intervals of at most MOST contexts that hold every pair with a common window, and anchor, ctx, s, e of those done without extension.

    contexts: anchor, ctx, place, bytes, each once. A range few..many of steps to the left is halved at a time, eight times at most;
    a context goes to the halves in which it has a window. A range of one step leaves contexts that share its window.
    """
    reach = length - GRAM
    shares = F.xxhash64("anchor", "few", "many", F.substring("bytes", F.col("place").cast("int") - F.col("few") + 1, F.col("few") + length - F.col("many")))
    large, small, done = contexts.withColumn("few", F.lit(0)).withColumn("many", F.lit(reach)), [], []
    for _ in range(reach.bit_length()):
        middle = F.expr("cast((few + many) div 2 as int)")
        halves = F.array(F.struct("few", middle.alias("many")), F.struct((middle + 1).alias("few"), "many"))
        split = large.withColumn("half", F.explode(halves)).select("anchor", "ctx", "place", "bytes", "half.few", "half.many")
        # the steps at which the context has a window
        split = split.filter(F.greatest("few", length - (F.length("bytes") - F.col("place"))) <= F.least("many", "place"))
        split = keep(spark, split.withColumn("interval", shares), "intervals")
        sizes = split.groupBy("interval", "anchor").agg(F.count("*").alias("n")).filter("n > 1")
        split = split.join(keep(spark, sizes, "sizes"), ["interval", "anchor"])
        whole = F.col("few") == F.col("many")
        done.append(split.filter(whole).select("anchor", "ctx", (F.col("place") - F.col("few")).alias("s"), (F.col("place") - F.col("few") + length).alias("e")))
        small.append(split.filter(~whole & (F.col("n") <= MOST)).select("interval", "anchor", "ctx", "place", "bytes"))
        large = split.filter(~whole & (F.col("n") > MOST)).select("anchor", "ctx", "place", "bytes", "few", "many")
        if large.isEmpty():
            break
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, done)


def _filter(spark, keys: DataFrame) -> np.ndarray:
    """Membership bits of a column of longs, sized by their number."""
    return bitmap(spark, keys, min(max((16 * keys.count()).bit_length(), FILTER[0]), FILTER[1]))


def strip_documents(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds `kept`, the bytes that stay, as text (cut characters dropped)."""
    spark = df.sparkSession
    whole = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole).alias("h2"))
    copied = docs.select("h", "h2", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).filter(F.col("n") >= length).groupBy("h", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h", "h2")
    copied = keep(spark, copied, "copied")
    repeated = keep(spark, _marks(docs, length).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "anchors")
    wanted = spark.sparkContext.broadcast(_filter(spark, repeated))
    found = keep(spark, _contexts(docs, length, wanted), "contexts")
    places = found.select("anchor", "ctx", "h", "h2", "lo", "size").distinct()
    classes = keep(spark, places.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min("size").alias("size")), "classes")
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    anchors = keep(spark, anchors, "mixed")
    blobs = found.filter("bytes is not null").select("anchor", "ctx", "place", "bytes")
    usual = blobs.join(anchors.filter(F.col("m") <= MOST), "anchor", "left_semi").withColumn("interval", F.col("anchor"))
    whole = classes.filter((F.col("n") > 1) & (F.col("size") >= length)).select("anchor", "ctx", F.lit(0).cast("long").alias("s"), F.col("size").alias("e"))
    hot = anchors.filter(F.col("m") > MOST)
    if not hot.isEmpty():
        small, done = _cut(spark, blobs.join(hot, "anchor", "left_semi").dropDuplicates(["anchor", "ctx"]), length)
        usual, whole = usual.unionByName(small), whole.unionByName(done)
    cuts = _matched(usual, length).unionByName(whole)
    spans = places.join(cuts, ["anchor", "ctx"]).select("h", "h2", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))
    spans = spans.groupBy("h", "h2").agg(F.collect_set(F.struct("s", "e")).alias("spans")).join(copied, ["h", "h2"], "left_anti")
    spans = keep(spark, spans, "spans")
    touched = spark.sparkContext.broadcast(_filter(spark, spans.select("h").union(copied.select("h"))))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, h long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    names = ["doc_id", "h", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def untouched(batches):
        """Final rows where nothing is removed, except for the text's hash; the text itself only where it is needed again."""
        for b in batches:
            hot_ = in_bitmap(touched.value, b.column(2).to_numpy().view(U64)) if len(b) else np.zeros(0, bool)
            raw = b.column(1).cast(pa.binary()).to_pylist()
            digest = [None if t else hashlib.sha256(x or b"").hexdigest() for x, t in zip(raw, hot_)]
            text = b.column(1) if with_text else pa.array([x if t else None for x, t in zip(raw, hot_)], pa.binary()).cast(pa.string())
            n = pa.array([len(x or b"") for x in raw], pa.int64())
            zero = pa.array(np.zeros(len(b), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), n, zero, zero, pa.array(digest, pa.string()), text], names)

    def cut(batches):
        for b in batches:
            rows = [[] for _ in range(4)]
            for text, sp, all_ in zip(b.column(7), b.column(8).to_pylist(), b.column(9).to_pylist()):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for x in [{"s": 0, "e": len(raw)}] if all_ else sorted(sp or [], key=lambda x: x["s"]):
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                edges = [0, *(p for m in merged for p in m), len(raw)]
                left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                for col, v in zip(rows, (len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if text.is_valid else None)):
                    col.append(v)
            text = pa.array(rows[3], pa.string()) if with_text else pa.nulls(len(b), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), text], names)

    first = keep(spark, docs.mapInArrow(untouched, schema), "rows")
    done = first.filter("kept_sha256 is not null")
    again = first.filter("kept_sha256 is null").join(spans, ["h", "h2"], "left").join(copied.withColumn("copied", F.lit(True)), ["h", "h2"], "left").select(*names, "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    out = done.unionByName(again.mapInArrow(cut, schema))
    return out.select(*(c for c in names if c not in ("h", "h2", "text")), *([F.col("text").alias("kept")] if with_text else []))
