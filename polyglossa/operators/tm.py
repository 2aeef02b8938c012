"""Translation-memory lookup as an equi-join on lookup variants.

A memory has one column for each language and row_pos, which orders its rows. Null texts read as empty ones.

memory_lookup gives the rows of tm_lookup in tm_index without that index: all forms of a text share its last one, so a text and the rows of the
memory that may answer it meet by 128 bits of it (the bucket), and each is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglossa.functions.text import lookup_form, lookup_text, preserve_case, raw_lower, strip_diacritics, stripped
from polyglossa.operators.skew import heavy_keys, spread_join

#: Methods of found, missing and unchanged texts.
EXACT, NORMALIZED, UNKNOWN, IDENTITY = "exact_phrase", "normalized_phrase", "unknown_for_review", "identity"
FALLBACK_WARNING = "Machine translation; needs review."


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once."""
    return F.transform(F.array(c), f)[0]


def _forms(text: Column) -> Column:
    """Structs nth and variant: each form of the text, normalized step by step; null for a form like an earlier one."""
    # texts of one byte a character have no marks
    plain = lambda n: F.when(F.octet_length(n) == F.char_length(n), n).otherwise(strip_diacritics(n))
    form = lambda k, c: F.struct(F.lit(k).alias("nth"), c.alias("variant"))
    return _bound(raw_lower(text), lambda r: _bound(lookup_form(r), lambda n: _bound(plain(n), lambda p: F.array(
        form(0, r), form(1, F.when(n != r, n)), form(2, F.when((p != n) & (p != r), p))
    ))))


def _variants(df: DataFrame, text: str) -> DataFrame:
    """df with `nth` and `variant`: each form of the text once, normalized step by step."""
    # outer, as Spark infers filters from other generators, which compute the steps once more each
    return df.select(*df.columns, F.inline_outer(F.filter(_forms(F.col(text)), lambda x: x["variant"] != ""))).filter("variant is not null")


def _bucketed(df: DataFrame, text: str) -> DataFrame:
    """df with `_bucket`, which texts with a form in common share, and `_forms`: a hash of each form at its nth place, null for none."""
    def both(forms: Column) -> Column:
        form = lambda k: F.nullif(forms[k]["variant"], F.lit(""))
        # a mark may become a blank, so the last form is put in order once more; without a letter or digit the first one stands
        last = F.coalesce(lookup_form(form(2)), form(1), form(0))
        return F.struct(F.unhex(F.md5(last)).alias("_bucket"), F.array(*(F.when(form(k).isNotNull(), F.xxhash64(form(k))) for k in range(3))).alias("_forms"))

    return df.select(*df.columns, F.inline_outer(F.array(_bound(_forms(F.col(text)), both))))


def tm_index(memory: DataFrame, langs: tuple[str, ...], sources: tuple[str, ...] | None = None) -> DataFrame:
    """src_lang, tgt_lang, variant, row_pos, target: the first row of each variant with a target in that language, so that a join cannot fan out."""
    targets = F.filter(F.array(*(F.struct(F.lit(t).alias("tgt_lang"), F.col(t).alias("target")) for t in langs)), lambda x: F.trim(F.coalesce(x["target"], F.lit(""))) != "")
    texts = F.array(*(F.struct(F.lit(s).alias("src_lang"), F.col(s).alias("text")) for s in sources or langs))
    long = memory.select("row_pos", F.inline_outer(texts), targets.alias("targets"))
    pairs = _variants(long, "text").select("row_pos", "src_lang", "variant", F.inline_outer("targets")).filter("src_lang <> tgt_lang")
    # the variant first: sorts tell most rows apart by the first key
    best = pairs.groupBy("variant", "src_lang", "tgt_lang").agg(F.min(F.struct("row_pos", "target")).alias("best"))
    return best.select("src_lang", "tgt_lang", "variant", "best.row_pos", "best.target")


def _lookup(distinct: DataFrame, index: DataFrame) -> DataFrame:
    """text, src_lang, tgt_lang, nth, target of the texts that the index has."""
    probes = _variants(distinct, "text")
    keys = ["text", "src_lang", "tgt_lang"]
    best = probes.join(index, ["variant", "src_lang", "tgt_lang"]).groupBy(*keys).agg(F.min(F.struct("nth", "row_pos", "target")).alias("hit"))
    return best.select(*keys, "hit.nth", "hit.target")


def _answered(out: DataFrame, columns: list[str]) -> DataFrame:
    """columns of out with translated, method, confidence and needs_review. out: text, src_lang, tgt_lang, nth and target (null without a hit)."""
    original, out = F.col("_original"), out.withColumn("_original", stripped(F.col("text")))
    identity = (original != "") & F.col("src_lang").eqNullSafe(F.col("tgt_lang"))
    hit = F.col("target").isNotNull() & ~identity
    return out.select(
        *columns, F.when(hit, preserve_case(original, F.col("target"))).when(identity, F.col("text")).otherwise(original).alias("translated"),
        F.when(identity, IDENTITY).when(~hit, UNKNOWN).when(F.col("nth") == 0, EXACT).otherwise(NORMALIZED).alias("method"),
        F.when(hit | identity, 1.0).otherwise(0.0).alias("confidence"), (~(hit | identity)).alias("needs_review"),
    )


def tm_lookup(queries: DataFrame, index: DataFrame, unique: bool = False) -> DataFrame:
    """translated, method, confidence, needs_review beside the columns of queries (text, src_lang, tgt_lang and any ids).

    Empty texts are unknown, texts whose languages are the same stay as they are; neither is looked up. Distinct texts are looked up
    once; their results come back to all rows by a join in which frequent lines are spread (unique: no text occurs often).
    """
    empty = stripped(F.col("text")) == ""
    same = F.col("src_lang").eqNullSafe(F.col("tgt_lang"))
    asked = queries.filter(~empty & ~same).select("text", "src_lang", "tgt_lang").distinct()
    return _answered(spread_join(queries, _lookup(asked, index), ["text", "src_lang", "tgt_lang"], heavy=[] if unique else None), queries.columns)


def _entries(memory: DataFrame, langs: tuple[str, ...], sources: tuple[str, ...]) -> DataFrame:
    """_bucket, src_lang, _entries: the distinct rows of the memory (row_pos, forms, targets) whose texts share a bucket. The memory may hold rows more than once."""
    targets = F.array(*(F.struct(F.lit(t).alias("tgt_lang"), F.col(t).alias("target")) for t in langs))
    texts = F.array(*(F.struct(F.lit(s).alias("src_lang"), F.col(s).alias("_text")) for s in sources))
    long = memory.select("row_pos", targets.alias("targets"), F.inline_outer(texts)).filter(stripped(F.col("_text")) != "")
    fit = F.filter("targets", lambda x: (x["tgt_lang"] != F.col("src_lang")) & (F.trim(F.coalesce(x["target"], F.lit(""))) != ""))
    rows = _bucketed(long.select("row_pos", "src_lang", "_text", fit.alias("targets")), "_text").filter(F.size("targets") > 0)
    entry = F.struct("row_pos", F.array_compact("_forms").alias("forms"), "targets")
    return rows.groupBy("_bucket", "src_lang").agg(F.collect_set(entry).alias("_entries"))


def memory_lookup(queries: DataFrame, memory: DataFrame, langs: tuple[str, ...], sources: tuple[str, ...] | None = None, heavy: list[int] | None = None) -> DataFrame:
    """What tm_lookup(queries, tm_index(memory, langs, sources)) gives; rows of the memory may occur more than once.

    Texts that are looked up and the memory's rows are shuffled once each, by bucket; other rows stay where they are, as do those of frequent
    texts, whose few buckets are sent to them. heavy: hashes of the frequent texts, if they are known. The memory's texts that differ
    in marks alone are put together in one row.
    """
    sources, keys = sources or langs, ["_bucket", "src_lang"]
    asked = (stripped(F.col("text")) != "") & F.col("src_lang").isin(*sources) & F.col("tgt_lang").isin(*langs) & (F.col("src_lang") != F.col("tgt_lang"))
    asked = F.coalesce(asked, F.lit(False))
    heavy = heavy_keys(queries.filter(asked), "text") if heavy is None else heavy
    hot = F.xxhash64("text").isin(heavy) if heavy else F.lit(False)
    table = _entries(memory, langs, sources)
    met = [_bucketed(queries.filter(asked & ~hot), "text").join(table, keys, "left")]
    if heavy:
        often = _bucketed(queries.filter(asked & hot), "text")
        few = table.join(F.broadcast(often.select(*keys).distinct()), keys)  # a semi join would go below the grouping, which would run once more
        met.append(often.join(F.broadcast(few), keys, "left"))
    # of the rows that share a form with a text, the first of the first form
    nth = lambda e: F.coalesce(*(F.when(F.array_contains(e["forms"], F.col("_forms")[k]), k) for k in range(3)))
    target = lambda e: F.get(F.filter(e["targets"], lambda x: x["tgt_lang"] == F.col("tgt_lang"))["target"], F.lit(0))
    hits = F.transform("_entries", lambda e: F.struct(nth(e).alias("nth"), e["row_pos"].alias("row_pos"), target(e).alias("target")))
    best = F.array_min(F.filter(hits, lambda x: x["nth"].isNotNull() & x["target"].isNotNull()))
    found = [m.select(*queries.columns, best.alias("_hit")).select(*queries.columns, "_hit.nth", "_hit.target") for m in met]
    none = queries.filter(~asked).select("*", F.lit(None).cast("int").alias("nth"), F.lit(None).cast("string").alias("target"))
    return reduce(DataFrame.union, (_answered(x, queries.columns) for x in (*found, none)))


def with_fallback(found: DataFrame, translate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], src_lang: str, tgt_lang: str, method: str = "fallback") -> DataFrame:
    """found with `warning`; rows of one direction that need review go through `translate` (text to text), others stay.

    translate takes and yields frames with columns row and text; it is called once for a partition of distinct texts, so a model is loaded once.
    A text that it leaves out or gives null for keeps its row. Found ones have no confidence and need review.
    """
    mine = F.col("needs_review") & (F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang) & (stripped(F.col("text")) != "")
    texts = found.filter(mine).select(F.col("text").alias("row")).distinct().select("row", F.col("row").alias("text"))
    made = texts.mapInPandas(translate, "row string, text string").filter(F.col("text").isNotNull()).groupBy("row").agg(F.min("text").alias("made"))
    # only rows that went through it meet the results
    own = F.coalesce(mine, F.lit(False))
    met = found.filter(own).join(made, F.col("text") == F.col("row"), "left").drop("row")
    out = met.union(found.filter(~own).withColumn("made", F.lit(None).cast("string")))
    new = F.col("made").isNotNull()
    return out.select(
        *(c for c in found.columns if c not in ("translated", "method", "confidence", "needs_review")),
        F.coalesce("made", "translated").alias("translated"), F.when(new, method).otherwise(F.col("method")).alias("method"),
        F.when(~new, F.col("confidence")).alias("confidence"), (new | F.col("needs_review")).alias("needs_review"), F.when(new, FALLBACK_WARNING).alias("warning"),
    )


def tm_coverage(queries: DataFrame, index: DataFrame) -> DataFrame:
    """src_lang, tgt_lang, method, n, share (of the direction's rows). Rows are counted before distinct ones are looked up."""
    counted = queries.groupBy("text", "src_lang", "tgt_lang").agg(F.count("*").alias("rows"))
    counts = tm_lookup(counted, index, unique=True).groupBy("src_lang", "tgt_lang", "method").agg(F.sum("rows").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("src_lang", "tgt_lang")))


def _grams(c: Column, n: int = 3) -> Column:
    text = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def tm_suggest(queries: DataFrame, memory: DataFrame, similarity: int = 82) -> DataFrame:
    """key, suggestion, score: the most similar memory text (100 * (1 - distance / longer length)) of each distinct lookup text at `similarity` or more.

    Never changes a lookup. Exact: a text of length n within distance k keeps some of its rarest 3k + 1 trigrams, and only lengths
    within k are compared; trigrams are ordered from rare to frequent, so lists of frequent ones are not read.
    queries: text; memory: text, target.
    """
    key = lookup_text(F.col("text"))
    mine = queries.select(key.alias("key")).filter("key <> ''").distinct()
    theirs = memory.groupBy(key.alias("other")).agg(F.min("target").alias("suggestion")).filter("other <> ''")
    slack = F.floor(F.greatest(F.col("size"), F.lit(1)) * (100 - similarity) / similarity).cast("int")
    both = mine.select("key", F.lit(0).alias("side")).union(theirs.select("other", F.lit(1)))
    grams = both.select("key", "side", F.length("key").alias("size"), F.explode(_grams(F.col("key"))).alias("gram"))
    rare = grams.groupBy("gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("side", "key").orderBy("n", "gram")
    kept = grams.join(rare, "gram").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 3 * slack + 1)
    a, b = (kept.filter(F.col("side") == s) for s in (0, 1))
    pairs = a.select("gram", "key", "size").join(b.select("gram", F.col("key").alias("other"), F.col("size").alias("size_b")), "gram").filter(F.abs(F.col("size") - F.col("size_b")) <= slack)
    scored = pairs.select("key", "other").distinct().withColumn("score", F.round(100 * (1 - F.levenshtein("key", "other") / F.greatest(F.length("key"), F.length("other"))), 2))
    best = scored.filter(F.col("score") >= similarity).join(theirs, "other").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("less"), "other", "suggestion")).alias("best"))
    return best.select("key", "best.suggestion", (-F.col("best.less")).alias("score"))
