"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives each vector a long hash string (signs of random projections); a tree's strings are kept as sorted arrays, cut
by their first bits into parts that executors hold. A query descends in each tree to its longest matching prefixes; the level is
then lowered in all trees together until they hold enough candidates, a row counted in each tree that holds it, which are compared exactly. Enough is
what a sample of at most `probes` queries needs: their true neighbours are found by brute force, and candidates are as many as bring
`recall` of these into the pools (`least`, `share` of all rows and k + 1 for each tree at the least). Where a query's own parts hold too few, it goes to the parts beside them as well, level
by level; at level 0 it meets all rows, in the first tree.

Largest inner product becomes smallest angle by one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm. Rows with equal
vectors are one point that keeps its k + 1 smallest ids, all that an answer can use, so a hot vector costs one comparison.
Parts with more rows than `part_rows` are dealt over several tasks, and their queries go to each of these.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Shorter vectors count as filled up
with zeros. Repeated rows with equal id and vector count once; an id with several vectors is as many rows, and a query of that id has
the nearest rows of any of them. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Bits of a hash string.
BITS = 32
#: Most bits that cut a tree into parts; bounds the table of their sizes on the driver. Rows of a part, on average, until then.
MOST_CUTS, PART = 8, 4_096


def _planes(trees: int, dim: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((trees * BITS, dim + 1))


def _codes(x: np.ndarray, extra: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One code per row and tree; the first projection gives the highest bit."""
    signs = (x @ planes[:, :-1].T + extra[:, None] * planes[:, -1]) >= 0
    return signs.reshape(len(x), len(planes) // BITS, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _groups(batches, key_columns: int):
    """Rows of a sorted partition, one table for each value of the first columns."""
    held, last = [], None
    for b in batches:
        if not len(b):
            continue
        keys = np.stack([b.column(k).to_numpy() for k in range(key_columns)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), len(b)]
        for x, y in zip(cuts, cuts[1:]):
            key = tuple(keys[:, x])
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _enough(points: DataFrame, totals: DataFrame, names: list[str], k: int, recall: float, probes: int, top: float, planes: np.ndarray) -> int:
    """The fewest candidates whose levels hold the `recall` of the true neighbours of a sample of queries.

    The sample is the queries with the least hashes, at most `probes`; each task compares its rows with them and gives the k nearest of each.
    """
    dim, trees = planes.shape[1] - 1, len(planes) // BITS
    sample = points.filter("asked").orderBy(F.xxhash64("p"), "p").limit(probes).select("p", "v").collect()
    own, x = np.array([r["p"] for r in sample]), np.array([r["v"] for r in sample])
    asked = _codes(x, np.zeros(len(x)), planes)

    def brute(batches):
        best, who = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64)
        depth = np.zeros((len(x), k), np.int64)
        for b in batches:
            for at in range(0, len(b), 1024):
                c = b.slice(at, 1024)
                y, p = _matrix(c.column("v"), dim), c.column("p").to_numpy()
                codes = _codes(y, np.sqrt(np.maximum(0, top - (y * y).sum(1))), planes)
                scores = np.where(own[:, None] == p, -np.inf, x @ y.T)
                near = np.argpartition(-scores, min(k, len(p)) - 1, 1)[:, :k]
                apart = np.frexp((codes[near] ^ asked[:, None]).min(2).astype(np.float64))[1]
                merged = [np.concatenate([a, z], 1) for a, z in ((best, np.take_along_axis(scores, near, 1)), (who, p[near]), (depth, BITS - apart))]
                first = np.argsort(-merged[0], 1, kind="stable")[:, :k]
                best, who, depth = (np.take_along_axis(m, first, 1) for m in merged)
        q, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(best[q, j]), pa.array(who[q, j]), pa.array(depth[q, j])], ["p", "score", "c", "depth"])

    found = points.select("p", "v").mapInArrow(brute, "p long, score double, c long, depth long")
    nth = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "c"))
    found = found.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("p").agg(F.collect_list("depth").alias("depths"))
    found = {r["p"]: np.array(r["depths"]) for r in found.collect()}
    held = {r["p"]: np.array(r[1:]) for r in totals.join(F.broadcast(points.sparkSession.createDataFrame([(int(p),) for p in own], "p long")), "p").select("p", *names).collect()}
    if not found:
        return 0
    sizes = np.array([held[p] for p in found])
    hits = np.array([(d[:, None] >= np.arange(BITS + 1)).sum(0) for d in found.values()])
    steps, (low, high) = np.unique(sizes), (0, len(np.unique(sizes)) - 1)
    while low < high:
        middle = (low + high) // 2
        level = (sizes >= steps[middle]).sum(1) - 1
        if hits[np.arange(len(hits)), level.clip(0)].sum() >= recall * hits[:, 0].sum():
            high = middle
        else:
            low = middle + 1
    return int(steps[low])


def nearest(df: DataFrame, k: int = 20, every: int = 20, trees: int = 26, recall: float = 0.95, probes: int = 256, share: float = 0.0, least: int = 4_000, part_rows: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    schema = "query_id long, rank int, vec_id long, score double"
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return spark.createDataFrame([], schema)
    # equal vectors share a point; -0.0 + 0.0 is 0.0
    filled = F.concat(F.transform("v", lambda x: x + 0.0), F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    rows = rows.withColumn("v", filled).withColumn("point", F.xxhash64("v")).withColumn("check", F.xxhash64(F.lit(7), "v"))
    rows = keep(spark, rows.dropDuplicates(["id", "point", "check"]), "vectors")
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("point", "check").orderBy("id"))).filter(F.col("nth") <= k + 1)
    asked = rows.filter(F.col("id") % every == 0)
    points = few.groupBy("point", "check").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "nth").alias("v"))
    points = points.join(asked.select("point", "check").distinct().withColumn("asked", F.lit(True)), ["point", "check"], "left")
    points = keep(spark, points.select(F.col("ids")[0].alias("p"), "ids", "v", F.coalesce("asked", F.lit(False)).alias("asked")), "points")
    n, top = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    # the bits that cut the parts
    cuts = max(0, min(int(np.log2(max(1, n / PART))), MOST_CUTS))

    def post(batches, first: int, with_vectors: bool):
        planes = _planes(trees, dim)
        names = ["tree", "part", "role", "code", "p", *(["v"] if with_vectors else [])]
        for b in batches:
            for at in range(0, len(b), 1024):
                c = b.slice(at, 1024)
                x, p = _matrix(c.column("v"), dim), c.column("p").to_numpy()
                extra = np.sqrt(np.maximum(0, top - (x * x).sum(1)))
                asked = np.flatnonzero(c.column("asked").to_numpy(zero_copy_only=False))
                for role, which in ((0, np.arange(len(p))), (1, asked)):
                    codes = _codes(x[which], extra[which] * (role == 0), planes)
                    take = np.tile(which, trees)
                    tree, code = np.repeat(np.arange(trees), len(which)), codes.T.ravel()
                    cols = [pa.array(tree), pa.array(code >> (BITS - first)), pa.array(np.full(len(take), role)), pa.array(code), pa.array(p[take])]
                    yield pa.RecordBatch.from_arrays(cols + ([c.column("v").take(pa.array(take))] if with_vectors else []), names)

    plain = "tree long, part long, role long, code long, p long"
    sizes = points.select("p", "v", "asked").mapInArrow(lambda b: post(b, cuts, False), plain).filter("role = 0").groupBy("tree", "part").agg(F.count("*").alias("n"))
    held = np.zeros((trees, 1 << cuts), np.int64)
    for r in sizes.collect():
        held[r["tree"], r["part"]] = r["n"]
    names = [f"n{depth}" for depth in range(BITS + 1)]

    def shallow(batches):
        """What a query's trees hold at the levels above the parts."""
        planes, each = _planes(trees, dim), np.arange(trees)
        for b in batches:
            for at in range(0, len(b), 1024):
                c = b.slice(at, 1024)
                x = _matrix(c.column("v"), dim)
                codes = _codes(x, np.zeros(len(x)), planes)
                under = [held.reshape(trees, 1 << depth, -1).sum(2)[each, codes >> (BITS - depth)].sum(1) for depth in range(cuts)]
                yield pa.RecordBatch.from_arrays([c.column("p"), *map(pa.array, under)], ["p", *names[:cuts]])

    def dealt(posted: DataFrame, first: int, extra: list[str]) -> DataFrame:
        """Postings by (tree, part, lot), each together and sorted."""
        parts = held.reshape(trees, 1 << first, -1).sum(2)
        lots = [(t, part, int(-(-parts[t, part] // part_rows))) for t, part in np.argwhere(parts > part_rows).tolist()]
        # at most trees * 2 ** MOST_CUTS rows
        posted = posted.join(F.broadcast(spark.createDataFrame(lots, "tree long, part long, lots long")), ["tree", "part"], "left").withColumn("lots", F.coalesce("lots", F.lit(1).cast("long")))
        posted = posted.withColumn("lot", F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("p"), F.col("lots")))).otherwise(F.sequence(F.lit(0).cast("long"), (F.col("lots") - 1).cast("long"))))
        posted = posted.select("tree", "part", F.explode("lot").alias("lot"), "role", "code", "p", *extra)
        return posted.repartition("tree", "part", "lot").sortWithinPartitions("tree", "part", "lot", "role", "code")

    def spans(data: np.ndarray, queries: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The run of the sorted codes that share `level` bits with each query."""
        low = queries >> (BITS - level) << (BITS - level)
        return np.searchsorted(data, low), np.searchsorted(data, low + (1 << (BITS - level)))

    def descend(batches):
        for _, t in _groups(batches, 3):
            role, code, p = (t.column(c).to_numpy() for c in ("role", "code", "p"))
            data, queries = code[role == 0], code[role == 1]
            if len(queries):
                counts = np.stack([np.subtract(*spans(data, queries, level)[::-1]) for level in range(cuts, BITS + 1)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(p[role == 1]), *(pa.array(c) for c in counts.T)], ["p", *names[cuts:]])

    posted = points.select("p", "v", "asked").mapInArrow(lambda b: post(b, cuts, False), plain)
    counted = dealt(posted, cuts, []).mapInArrow(descend, "p long, " + ", ".join(f"{c} long" for c in names[cuts:]))
    totals = counted.groupBy("p").agg(*(F.sum(c).alias(c) for c in names[cuts:]))
    if cuts:
        above = points.filter("asked").select("p", "v").mapInArrow(shallow, "p long, " + ", ".join(f"{c} long" for c in names[:cuts]))
        totals = totals.join(above, "p")
    totals = keep(spark, totals.select("p", *names), "levels")
    if totals.isEmpty():
        return spark.createDataFrame([], schema)
    wanted = max(least, int(share * n), trees * (k + 1), _enough(points, totals, names, k, recall, probes, top, _planes(trees, dim)))
    # so few bits that all trees together hold enough there on average
    first = max(0, min(int(np.log2(max(1, trees * n / wanted))) - 1, cuts))
    level = F.lit(0)
    for depth, name in enumerate(names):
        level = F.when(F.col(name) >= wanted, depth).otherwise(level)
    levels = totals.select("p", level.cast("long").alias("level"))

    def compare(batches):
        for _, t in _groups(batches, 3):
            role, code, p, lv = (t.column(c).to_numpy(zero_copy_only=False) for c in ("role", "code", "p", "level"))
            x = _matrix(t.column("v").combine_chunks(), dim)
            d = np.flatnonzero(role == 0)
            data, found = code[d], []
            for at in np.array_split(np.flatnonzero(role == 1), max(1, int((role == 1).sum()) // 64)):
                if not len(at) or not len(d):
                    continue
                lo, hi = np.array([spans(data, code[q : q + 1], int(lv[q])) for q in at])[:, :, 0].T
                a, z = int(lo.min()), int(hi.max())
                scores = x[at] @ x[d[a:z]].T
                for i, q in enumerate(at):
                    s = scores[i, lo[i] - a : hi[i] - a]
                    if len(s) > k + 1:
                        edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        best = np.flatnonzero(s >= edge)
                        best = best[np.lexsort((p[d[lo[i] + best]], -s[best]))[: k + 1]]
                    else:
                        best = np.arange(len(s))
                    found.append((np.full(len(best), p[q]), p[d[lo[i] + best]], s[best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["q", "c", "score"])

    posted = points.select("p", "v", "asked").mapInArrow(lambda b: post(b, first, True), plain + ", v array<double>")
    posted = posted.join(levels, "p", "left").select("tree", "part", "role", "code", "p", "v", F.coalesce("level", F.lit(0)).alias("level"))
    # above the parts' level a query goes to all parts of its branch; all trees hold the same rows at level 0, so one is enough there
    posted = posted.filter("role = 0 or level > 0 or tree = 0").withColumn("width", F.expr(f"if(role = 0 or level >= {first}, 1L, shiftleft(1L, cast({first} - level as int)))"))
    posted = posted.withColumn("start", F.expr("part - part % width")).withColumn("part", F.explode(F.expr("sequence(start, start + width - 1)"))).drop("start", "width")
    pairs = dealt(posted, first, ["v", "level"]).mapInArrow(compare, "q long, c long, score double").groupBy("q", "c").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = pairs.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k + 1)
    ids = best.join(points.select(F.col("p").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1).select("q", "score", "vec_id")
    # a query's point is named by its smallest id
    smallest = few.filter("nth = 1").select("point", "check", F.col("id").alias("q"))
    named = asked.join(smallest, ["point", "check"]).select("q", F.col("id").alias("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        named.join(ids, "q").filter(F.col("vec_id") != F.col("query_id"))
        .select("query_id", F.row_number().over(final).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    )
