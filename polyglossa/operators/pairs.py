"""Directed translation pairs: checks, cleaning, leakage groups and splits. Null texts read as empty ones."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglossa.functions.text import is_trainable, notes_flags, pair_text, record_id, strip_diacritics, stripped
from polyglossa.operators.audit import LANGS
from polyglossa.operators.skew import spread_join
from polyglossa.session import written


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def validate_pairs(df: DataFrame, id_col: str = "record_id", src: str = "source_text", tgt: str = "target_text") -> DataFrame:
    """finding, n: rows that fail each check, and usable rows. Pairs are counted once each, so repeated ones cost one row."""
    by_pair = df.groupBy(_text(src).alias("s"), _text(tgt).alias("t")).agg(F.count("*").alias("n"))
    s, t, n = F.col("s"), F.col("t"), F.col("n")
    checks = {
        "rows": F.lit(True), "blank_source": s == "", "blank_target": t == "", "duplicate_pair_rows": n > 1, "copy_through": (s == t) & (s != ""),
        "replacement": s.contains("�") | t.contains("�"), "usable": (s != "") & (t != "") & (s != t),
    }
    wide = by_pair.agg(*(F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(k) for k, c in checks.items()))
    ids = df.groupBy(id_col).agg(F.count("*").alias("k")).filter("k > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_ids").alias("finding"), "n")
    return wide.unpivot([], list(checks), "finding", "n").unionByName(ids)


def clean_pairs(df: DataFrame, pos_col: str = "record_id", src: str = "source_text", tgt: str = "target_text") -> DataFrame:
    """Rows with both sides, not copied, the first of each pair by pos_col."""
    first = Window.partitionBy(src, tgt).orderBy(pos_col)
    usable = df.filter((_text(src) != "") & (_text(tgt) != "") & (_text(src) != _text(tgt)))
    return usable.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def translation_pairs(df: DataFrame, langs=LANGS) -> DataFrame:
    """One row for each ordered pair of languages of a row whose texts are both fit for training: neither blank nor marked for review.

    df: id (of any type), topic, source, notes, a column for each language. Texts and labels lose their outer blanks; a row without a source is the phrasebook's.
    """
    sides = [F.struct(F.lit(s).alias("source_lang"), F.lit(t).alias("target_lang"), F.col(s).alias("source_text"), F.col(t).alias("target_text")) for s in langs for t in langs if s != t]
    label = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    made = df.select(
        F.col("id").alias("row_id"), label("topic").alias("topic"), F.coalesce(F.nullif(label("source"), F.lit("")), F.lit("phrasebook")).alias("domain"), label("notes").alias("notes"),
        F.explode(F.array(*sides)).alias("p"),
    )
    kept = made.select("row_id", "topic", "domain", "notes", "p.*").filter(is_trainable(F.col("source_text")) & is_trainable(F.col("target_text")))
    name = record_id(F.col("source_lang"), F.col("target_lang"), F.col("row_id"))
    return kept.select(name.alias("record_id"), "row_id", "topic", "domain", "notes", "source_lang", "target_lang", stripped(F.col("source_text")).alias("source_text"), stripped(F.col("target_text")).alias("target_text"))


def connected(edges: DataFrame) -> DataFrame:
    """id, group_id (smallest id reachable) of every id in edges (u > v), by alternating large and small stars.

    Rounds grow with the logarithm of the longest chain; every round joins on single rows per id, so a hub costs no group in memory.
    """
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
        seen = state


def leakage_groups(df: DataFrame, id_col: str = "id", langs=LANGS) -> DataFrame:
    """id, group_id: rows that share a pair of texts fit for training in any two languages, directly or through others, are one group."""
    keys = [F.when(is_trainable(F.col(a)) & is_trainable(F.col(b)), F.xxhash64(F.lit(f"{a}-{b}"), pair_text(F.col(a)), F.lit("\t"), pair_text(F.col(b)))) for a, b in combinations(langs, 2)]
    rows = df.select(F.col(id_col).alias("id"), F.explode_outer(F.array_compact(F.array(*keys))).alias("key")).filter("key is not null")
    heads = rows.groupBy("key").agg(F.min("id").alias("v"), F.count("*").alias("n")).filter("n > 1")
    edges = rows.join(heads, "key").filter("id > v").select(F.col("id").alias("u"), "v").distinct()
    found = connected(written(edges, "edges"))
    return df.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def split_of(key: Column, seed: int = 42, ratios=(80, 10, 10)) -> Column:
    """train, dev or test by a hash of seed and key: the same on any cluster, with no shuffle."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 6), 16, 10).cast("int") % sum(ratios)
    return F.when(bucket < ratios[0], "train").when(bucket < ratios[0] + ratios[1], "dev").otherwise("test")


def hash_split(df: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """Adds split; rows that share a key stay together."""
    return df.withColumn("split", split_of(F.col(key_col), seed))


SPLITS = ("train", "dev", "test")


def split_targets(rows: int, ratios=(80, 10, 10)) -> list[int]:
    """Rows of each split; the last gets what is left."""
    first = [round(rows * r / sum(ratios)) for r in ratios[:-1]]
    return [*first, rows - sum(first)]


def largest_first(histogram: dict[int, int], targets: list[int]) -> dict[int, list[int]]:
    """For each size of a group, how many groups of that size go to each split.

    The largest go first, each to the split that lacks most rows (ties: to the one with fewest rows, then the first). Groups of one
    size are dealt at once: those lacks that are passed on the way down to a common level, so the work follows the number of sizes.
    """
    counts, out = [0] * len(targets), {}
    for size, groups in sorted(histogram.items(), reverse=True):
        lack = [t - c for t, c in zip(targets, counts)]

        def above(level: int) -> list[int]:
            return [(x - level) // size + 1 if x >= level else 0 for x in lack]

        low, high = max(lack) - size * groups, max(lack)  # the highest level at which all groups find a place
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sum(above(mid)) >= groups else (low, mid - 1)
        dealt = above(low + 1)
        level = sorted((t, k) for k, t in enumerate(targets) if lack[k] >= low and (lack[k] - low) % size == 0)
        for _, k in level[: groups - sum(dealt)]:
            dealt[k] += 1
        out[size] = dealt
        counts = [c + size * n for c, n in zip(counts, dealt)]
    return out


def balanced_split(df: DataFrame, group_col: str, seed: int = 42, ratios=(80, 10, 10)) -> DataFrame:
    """Adds split: whole groups, the largest first, so that each split comes near its share of the rows.

    The driver sees the histogram of sizes only (at most the square root of twice the rows). Groups of a size are ranked by a seeded hash,
    in 4096 parts of a size whose numbers are added up. Rows with a null group are one group.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group_col).cast("string"), F.lit(""))))
    groups = df.groupBy(group_col).agg(F.count("*").alias("size")).withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    groups = written(groups, "groups")
    parts = groups.groupBy("size", "part").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    dealt = largest_first(histogram, split_targets(sum(s * n for s, n in histogram.items()), ratios))
    ends = df.sparkSession.createDataFrame([(s, *(sum(n[: k + 1]) for k in range(2))) for s, n in dealt.items()], "size long, train long, dev long")
    before = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.withColumn("base", F.coalesce(before, F.lit(0))).drop("n").join(ends, "size")
    rank = F.col("base") + F.row_number().over(Window.partitionBy("size", "part").orderBy("key", group_col))
    ranked = groups.join(bases, ["size", "part"]).withColumn("rank", rank)
    split = F.when(F.col("rank") <= F.col("train"), SPLITS[0]).when(F.col("rank") <= F.col("dev"), SPLITS[1]).otherwise(SPLITS[2])
    named = ranked.select(F.col(group_col).alias("_group"), split.alias("split"))
    return df.join(named, F.col(group_col).eqNullSafe(F.col("_group"))).drop("_group")


def split_leakage(pairs: DataFrame) -> DataFrame:
    """Pair keys that stand in more than one split."""
    keyed = pairs.select("source_lang", "target_lang", pair_text(F.col("source_text")).alias("source_key"), pair_text(F.col("target_text")).alias("target_key"), "split")
    per = keyed.groupBy("source_lang", "target_lang", "source_key", "target_key").agg(F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"))
    return per.filter(F.col("splits").contains("|"))


def split_overlap(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that stand in more than one split (of the three there are)."""
    return df.groupBy(id_col).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def split_manifest(df: DataFrame) -> DataFrame:
    """split, n, ratio."""
    total = F.sum("n").over(Window.partitionBy())
    return df.groupBy("split").agg(F.count("*").alias("n")).withColumn("ratio", F.round(F.col("n") / total, 4))


def model_records(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.select("record_id", F.concat(F.lit(prefix), "source_text").alias("source_text"), "target_text")


def phrasebook_upsert(existing: DataFrame, batch: DataFrame, langs=LANGS) -> DataFrame:
    """outcome, n of putting batch into existing by all texts: created, updated, or failed where several rows match.

    The first of a repeated new key is created, later ones update it; rows without any text are skipped.
    """
    some = reduce(lambda a, b: a | b, ((_text(c) != "") for c in langs))
    old = existing.groupBy(*langs).agg(F.count("*").alias("n_old"))
    new = batch.filter(some).groupBy(*langs).agg(F.count("*").alias("n_new"))
    both = new.join(old, list(langs), "left").withColumn("n_old", F.coalesce("n_old", F.lit(0)))
    created = F.when(F.col("n_old") == 0, 1).otherwise(0)
    failed = F.when(F.col("n_old") > 1, F.col("n_new")).otherwise(0)
    sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in (("created", created), ("failed", failed), ("updated", F.col("n_new") - created - failed))))
    return sums.unpivot([], ["created", "failed", "updated"], "outcome", "n")


def phrasebook_merge(existing: DataFrame, batch: DataFrame, update: bool = True, langs=LANGS) -> DataFrame:
    """The phrasebook after an import, and what failed: langs, topic, source, notes, needs_review, outcome, n.

    existing: langs, topic, source, notes, needs_review. batch: row (orders it), langs, topic, source, notes. Entries are told by all texts
    as they are, null as blank; rows without a text are skipped. With update the first row of a new key creates it and the last one gives
    its values; the last row of a known key updates it; rows whose key several entries have fail and stand apart. Without update every
    row is created. outcome: kept, created, updated, failed; n: batch rows that went into the entry (0 for kept).
    """
    columns = [*langs, "topic", "source", "notes", "needs_review"]
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    own = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("phrasebook")).alias("source")
    some = reduce(lambda a, b: a | b, ((_text(c) != "") for c in langs))
    rows = batch.filter(some).select("row", *map(text, langs), text("topic"), own, text("notes"), notes_flags(F.col("notes"))["review_import"].alias("needs_review"))
    old = existing.select(*map(text, langs), *columns[len(langs) :])
    if not update:
        return old.withColumns({"outcome": F.lit("kept"), "n": F.lit(0).cast("long")}).union(rows.select(*columns, F.lit("created"), F.lit(1).cast("long")))
    new = rows.groupBy(*langs).agg(F.max(F.struct("row", *columns[len(langs) :])).alias("last"), F.count("*").alias("n"))
    known = old.groupBy(*langs).agg(F.count("*").alias("n_old"))
    keyed = new.join(known, list(langs), "left").withColumn("n_old", F.coalesce("n_old", F.lit(0)))
    values = [F.col(f"last.{c}").alias(c) for c in columns[len(langs) :]]
    created = keyed.filter("n_old = 0").select(*langs, *values, F.lit("created").alias("outcome"), "n")
    # one row for each key on the right; entries of a key that many share are spread
    sure = keyed.filter("n_old = 1").select(*langs, "last", F.col("n").alias("_n"))
    met = spread_join(old, sure, list(langs))
    hit = F.col("_n").isNotNull()
    stay = met.select(*langs, *(F.when(hit, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in columns[len(langs) :]), F.when(hit, "updated").otherwise("kept").alias("outcome"), F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    failed = spread_join(rows, keyed.filter("n_old > 1").select(*langs, "n_old"), list(langs), "inner")
    return stay.union(created).union(failed.select(*columns, F.lit("failed"), F.lit(1).cast("long")))


def export_report(rows: DataFrame, langs=LANGS) -> DataFrame:
    """metric, n: rows, missing texts by language and directed pairs by direction."""
    missing = rows.unpivot([], list(langs), "lang", "text").groupBy(F.concat(F.lit("missing_"), "lang").alias("metric")).agg(F.count_if(_text("text") == "").alias("n"))
    made = translation_pairs(rows, langs).groupBy(F.concat(F.lit("pairs_"), "source_lang", F.lit("_"), "target_lang").alias("metric")).agg(F.count("*").alias("n"))
    return missing.unionByName(made).unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("metric"), "n"))


def checked_split(df: DataFrame, id_col: str = "record_id", seed: int = 42, ratios=(80, 10, 10)) -> DataFrame:
    """Adds split by a hash of the id. An error unless the last split has a share, ids are unique and none is null; an empty table stays empty."""
    if len(ratios) != len(SPLITS) or min(ratios) < 0 or ratios[-1] <= 0:
        raise ValueError("shares must not be negative and must leave some for the test split")
    twice = df.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if not twice.isEmpty():
        raise ValueError(f"{id_col} must be unique before splitting")
    return df.withColumn("split", split_of(F.col(id_col), seed, ratios))


def split_record(df: DataFrame, id_col: str, method: str, seed: int = 42, ratios=(80, 10, 10), leakage_safe: bool = False) -> DataFrame:
    """One row: method, seed, leakage_safe, ratio_ and n_ of each split, n_total, overlap (ids in more than one split)."""
    per = df.groupBy(id_col).agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS), (F.count_distinct("split") > 1).alias("both"))
    none = F.lit(0).cast("long")
    sums = per.agg(*(F.coalesce(F.sum(f"n_{s}"), none).alias(f"n_{s}") for s in SPLITS), F.count_if("both").alias("overlap"))
    total = sum((F.col(f"n_{s}") for s in SPLITS), none)
    return sums.select(
        F.lit(method).alias("method"), F.lit(seed).alias("seed"), F.lit(leakage_safe).alias("leakage_safe"), *(F.lit(r / sum(ratios)).alias(f"ratio_{s}") for s, r in zip(SPLITS, ratios)),
        *(f"n_{s}" for s in SPLITS), total.alias("n_total"), "overlap",
    )


def training_report(rows: DataFrame, records: DataFrame, langs=LANGS) -> DataFrame:
    """section, metric, n of an export: rows, texts and their flaws, reviews, directions, splits.

    rows: id, langs, notes, verified; records: row_id, source_lang, target_lang, source_text, target_text, split. Rows are read once for
    their flaws and once for repeated ones; records once by direction and split, once by row and once by pair. Metrics of value 0 stay, but for directions and splits.
    """
    text = {c: stripped(F.col(c)) for c in langs}
    whole = F.concat_ws(" ", *text.values())
    notes = F.lower(F.coalesce("notes", F.lit("")))
    flaws = {
        ("rows", "total"): F.lit(True), ("rows", "usable"): reduce(lambda a, b: a & b, (is_trainable(F.col(c)) for c in langs)), **{("missing", c): t == "" for c, t in text.items()},
        ("characters", "replacement"): whole.contains("�"), ("characters", "control"): F.translate(whole, "\t\n\r", "").rlike(r"\p{C}"),
        ("characters", "tagabawa_diacritics"): strip_diacritics(text["tagabawa"]) != text["tagabawa"],
        ("review", "verified"): F.coalesce(F.col("verified"), F.lit(False)), ("review", "marked"): notes.contains("need to double check") | notes.contains("manual check"), ("review", "auto_split"): notes.contains("auto-split"),
    }
    report = lambda df, *cols: df.select(*cols, F.col("n").cast("long").alias("n"))
    wide = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"{s}|{m}") for (s, m), c in flaws.items()))
    # what follows from two of them
    wide = wide.withColumns({"rows|skipped": F.col("rows|total") - F.col("rows|usable"), "review|unverified": F.col("rows|total") - F.col("review|verified")})
    tall = wide.unpivot([], list(wide.columns), "name", "n")
    out = [report(tall, F.split_part("name", F.lit("|"), F.lit(1)).alias("section"), F.split_part("name", F.lit("|"), F.lit(2)).alias("metric"))]
    same = rows.groupBy(*(t.alias(c) for c, t in text.items())).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    out.append(report(same, F.lit("rows").alias("section"), F.lit("repeated").alias("metric")))
    unknown = F.coalesce(F.col("source_text").contains("UNKNOWN_FOR_REVIEW") | F.col("target_text").contains("UNKNOWN_FOR_REVIEW"), F.lit(False))
    counted = records.groupBy(F.concat_ws("->", "source_lang", "target_lang").alias("direction"), F.coalesce("split", F.lit("unsplit")).alias("split")).agg(F.count("*").alias("n"), F.count_if(unknown).alias("unknown"))
    sides = F.array(*(F.struct(F.lit(s).alias("section"), F.col(c).alias("metric"), F.col("n").alias("n")) for s, c in (("directions", "direction"), ("splits", "split"))), F.struct(F.lit("review").alias("section"), F.lit("unknown_records").alias("metric"), F.col("unknown").alias("n")))
    out.append(report(counted.select(F.inline(sides)).groupBy("section", "metric").agg(F.sum("n").alias("n")), "section", "metric"))
    each = records.groupBy("row_id").agg(F.min("split").alias("split")).groupBy(F.coalesce("split", F.lit("unsplit")).alias("metric")).agg(F.count("*").alias("n"))
    out.append(report(each, F.lit("split_rows").alias("section"), "metric"))
    leaks = split_leakage(records).agg(F.count("*").alias("n"))
    return reduce(DataFrame.union, [*out, report(leaks, F.lit("splits").alias("section"), F.lit("leaking_pairs").alias("metric"))])
