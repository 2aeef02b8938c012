"""Plans that only name what could be removed, merges of segments and candidates, pages side by side, quotas, statistical languages. Nothing is ever deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglossa.functions.text import REVIEW_MARKERS, gram_codes, notes_ids, notes_value, stripped, to_count
from polyglossa.operators.jobs import _before
from polyglossa.session import written

#: Different n-grams that a task counts before it hands them on.
GRAMS = 1 << 20

#: Statuses whose files stay, and names that are no folder of a job.
PROTECTED, NO_NAMES = ("queued", "processing"), ("", ".", "..")


def purge_plan(jobs: DataFrame, root: str, as_of: str, days: int = 30) -> DataFrame:
    """job, path, safe: distinct paths of jobs that were deleted `days` before as_of; safe ones lie under root and never go up. jobs: job, status, is_deleted, deleted_at, paths."""
    old = jobs.filter(F.col("is_deleted") & ~F.col("status").isin(*PROTECTED) & (F.col("deleted_at") <= _before(as_of, days * 1440)))
    paths = old.select("job", F.explode(F.array_distinct("paths")).alias("path")).filter(F.coalesce(F.trim("path"), F.lit("")) != "")
    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return paths.select("job", "path", inside.alias("safe"))


def cleanup_plan(listing: DataFrame, active: DataFrame, as_of: str, max_age_s: int) -> DataFrame:
    """name, plan: skipped_active, unsafe, skipped_recent or removable. listing: name, modified; active: name."""
    known = active.select(F.col("name").cast("string").alias("name")).distinct().withColumn("active", F.lit(True))
    age = F.timestamp_diff("SECOND", F.col("modified"), F.lit(as_of).cast("timestamp_ntz"))
    unsafe = F.trim("name").isin(*NO_NAMES) | F.col("name").rlike(r"[/\\:]")
    plan = F.when(F.coalesce("active", F.lit(False)), "skipped_active").when(unsafe, "unsafe").when(age < max_age_s, "skipped_recent").otherwise("removable")
    return listing.join(known, "name", "left").select("name", "modified", plan.alias("plan"))


def declared_pages(metadata: Column, keys: tuple[str, ...] = ("page_count", "total_pages", "source_page_count", "pages_processed")) -> Column:
    """The largest of the page counters of a map of strings; 0 without any."""
    return F.greatest(*(to_count(F.element_at(metadata, k)) for k in keys))


def page_pairs(pages: DataFrame, segments: DataFrame, declared: DataFrame) -> DataFrame:
    """job, page, source, target: a page's text, else its segments' sources, beside its segments' translations, for pages of any table.

    pages: job, page, text; segments: job, page (1 if null), segment_index, source, translated; declared: job, n. Blank pieces are left out.
    """
    placed = segments.withColumn("page", F.coalesce("page", F.lit(1).cast("long")))

    def joined(c: str) -> Column:
        pieces = F.sort_array(F.collect_list(F.when(stripped(F.col(c)) != "", F.struct("segment_index", F.col(c).alias("t")))))
        return F.array_join(F.transform(pieces, lambda x: x["t"]), "\n")

    sums = placed.groupBy("job", "page").agg(joined("source").alias("sources"), joined("translated").alias("target"))
    numbers = declared.filter("n > 0").select("job", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("page"))
    every = pages.select("job", "page").union(sums.select("job", "page")).union(numbers).distinct()
    texts = pages.groupBy("job", "page").agg(F.min("text").alias("text"))
    out = every.join(texts, ["job", "page"], "left").join(sums, ["job", "page"], "left")
    source = F.coalesce(F.nullif(stripped(F.col("text")), F.lit("")), "sources", F.lit(""))
    return out.select("job", "page", source.alias("source"), F.coalesce("target", F.lit("")).alias("target"))


def segment_sync(old: DataFrame, new: DataFrame) -> DataFrame:
    """The segments after a run: jobs of the batch are replaced whole, others stay; neural translations have no confidence. Either: job, segment_index, method, confidence."""
    made = new.withColumn("confidence", F.when(~F.coalesce(F.col("method") == "neural", F.lit(False)), F.col("confidence")))
    return old.join(new.select("job").distinct(), "job", "left_anti").select(*new.columns).unionByName(made)


def gated_insert(existing: DataFrame, candidates: DataFrame, bucket: int = 100_000) -> DataFrame:
    """pos, outcome (unknown_marker, low_confidence, duplicate, missing_source or accepted), new_id of candidates.

    A candidate repeats one that is accepted before it, but none that is refused. Its source ids must be those of existing rows. New ids go on
    from the largest in order of pos. existing: id, english; candidates: pos (long, unique), english, tagabawa, notes.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    have = existing.select(key("english").alias("key")).distinct().withColumn("known", F.lit(True))
    ids = existing.select(F.col("id").cast("long").alias("source")).distinct().withColumn("there", F.lit(1))
    rows = candidates.select("pos", key("english").alias("key"), F.coalesce("tagabawa", F.lit("")).alias("tagabawa"), notes_value(F.col("notes"), "confidence").alias("confidence"), notes_ids(F.col("notes")).alias("ids"))
    missing = rows.select("pos", F.explode("ids").alias("source")).join(ids, "source", "left").groupBy("pos").agg(F.count_if(F.col("there").isNull()).alias("missing"))
    gated = rows.join(have, "key", "left").join(missing, "pos", "left")
    early = (
        F.when(F.col("tagabawa").contains(REVIEW_MARKERS[0]), "unknown_marker").when(F.lower(F.trim(F.coalesce("confidence", F.lit("")))) != "high", "low_confidence")
        .when(F.coalesce("known", F.lit(False)), "duplicate")
    )
    gated = gated.withColumn("early", early).withColumn("ok", F.col("early").isNull() & (F.coalesce("missing", F.lit(0)) == 0))
    first = gated.filter("ok").groupBy("key").agg(F.min("pos").alias("first"))
    outcome = F.coalesce("early", F.when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("ok"), "missing_source").otherwise("accepted"))
    told = gated.join(first, "key", "left").select("pos", outcome.alias("outcome"))
    # numbering in buckets of positions, so that no task sorts all rows
    taken = told.filter("outcome = 'accepted'").withColumn("bucket", F.floor(F.col("pos") / bucket))
    counts = taken.groupBy("bucket").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("pos"))
    most = existing.agg(F.coalesce(F.max(F.col("id").cast("long")), F.lit(0)).alias("most"))
    numbered = taken.join(base, "bucket").crossJoin(F.broadcast(most)).select(F.col("pos").alias("p"), (F.col("most") + F.col("base") + nth).alias("new_id"))  # one row
    return told.join(numbered, F.col("pos") == F.col("p"), "left").select("pos", "outcome", "new_id")


def admit(attempts: list[float], state: tuple[int, float], limit: int, gap_s: float) -> tuple[list[bool], tuple[int, float]]:
    """Which attempts (seconds, ascending) are admitted, and the state (count, expiry) after them. A refused one changes nothing."""
    count, until = state
    out = []
    for t in attempts:
        if t >= until:
            count = 0
        ok = count < limit
        if ok:
            count, until = count + 1, t + gap_s
        out.append(ok)
    return out, (count, until)


def upload_quota(attempts: DataFrame, limit: int = 5, gap_s: int = 3600) -> DataFrame:
    """user_id, event_id, seconds, admitted: at most `limit` admitted attempts with less than the gap between them. attempts: user_id, event_id, seconds.

    Rows are read in order, with one user's state at a time; a user of any number of attempts takes no more memory than another.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, (0, float("-inf"))
        for f in frames:
            flags: list[bool] = []
            for u, g in f.groupby("user_id", sort=False, dropna=False):
                if u != user:
                    user, state = u, (0, float("-inf"))
                ok, state = admit(g["seconds"].tolist(), state, limit, gap_s)
                flags += ok
            yield f.assign(admitted=flags)

    rows = attempts.filter("user_id is not null").select("user_id", "event_id", F.col("seconds").cast("double").alias("seconds"))
    kind = dict(rows.dtypes)
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "seconds", "event_id")
    return ordered.mapInPandas(run, f"user_id {kind['user_id']}, event_id {kind['event_id']}, seconds double, admitted boolean")


def _gram_counts(df: DataFrame, n: int) -> DataFrame:
    """lang, gram, c: how often each n-gram of code points stands in the texts of a language. Up to n = 3 a task counts its own texts, so that only counts are shuffled."""
    text = F.concat(F.lit(" "), F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n]+", " ")), F.lit(" ")).alias("text")
    if n > 3:
        grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # at every place, in one pass
        return df.select("lang", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    kind = dict(df.dtypes)["lang"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema = None

        def tables() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = summed(parts)
                points = np.stack([codes >> 21 * k & (1 << 21) - 1 for k in reversed(range(n))], 1).astype(np.uint32)
                whole = points.tobytes().decode("utf-32-le")
                grams = [whole[k : k + n] for k in range(0, len(whole), n)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), schema), pa.array(grams, pa.string()), pa.array(counts)], ["lang", "gram", "c"])
            held.clear()

        for b in batches:
            schema = b.schema.field(0).type
            by_lang: dict = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(t)
            for lang, texts in by_lang.items():
                for some in steps(texts):
                    held.setdefault(lang, []).append(np.unique(inner(some), return_counts=True))
                    if len(held[lang]) == 8:
                        held[lang] = [summed(held[lang])]
            if sum(len(c) for parts in held.values() for c, _ in parts) > GRAMS:
                yield from tables()
        yield from tables()

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([k for _, k in parts]), len(codes)).astype(np.int64)

    def inner(texts: list[str]) -> np.ndarray:
        """Codes of the n-grams of texts side by side, without those that reach into the next text."""
        codes = gram_codes("".join(texts), n)
        starts = np.cumsum([len(t) for t in texts])[:-1]
        across = (starts[:, None] - np.arange(1, n)).ravel()
        return np.delete(codes, np.unique(across[(across >= 0) & (across < len(codes))]))

    def steps(texts: list[str]) -> Iterator[list[str]]:
        """Texts of about a million code points together."""
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > 1 << 20:
                yield some
                some, size = [], 0
        if some:
            yield some

    counts = df.select("lang", text).mapInArrow(count, f"lang {kind}, gram string, c long")
    return counts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def train_profiles(df: DataFrame, n: int = 3) -> DataFrame:
    """lang, gram, logp (millionths): add-one log probabilities of character n-grams; gram null holds that of unseen ones. df: lang, text."""
    counts = written(_gram_counts(df.filter("lang is not null"), n), "grams")  # texts are read once
    sizes = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    kinds = counts.select("gram").distinct().agg(F.count("*").alias("kinds"))
    base = sizes.crossJoin(F.broadcast(kinds)).select("lang", (F.col("total") + F.col("kinds")).alias("base"))  # one row
    known = counts.join(F.broadcast(base), "lang").select("lang", "gram", ((F.col("c") + 1) / F.col("base")).alias("p"))  # as many as languages
    unseen = base.select("lang", F.lit(None).cast("string").alias("gram"), (1 / F.col("base")).alias("p"))
    return known.union(unseen).select("lang", "gram", F.round(F.ln("p") * 1000000).cast("long").alias("logp"))

