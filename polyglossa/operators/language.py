"""Source languages found by themselves: a cascade of dictionary, character n-grams and fallback, for blocks, documents and phrases.

Both steps are done inside the row, as long as the vocabulary and the profile are small enough to be sent to every task; larger ones
are met by a join in which frequent tokens and n-grams are spread. A block that one step decides is not given to the next.
Null texts read as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyglossa.functions.text import clean_invisible, gram_codes, normalize_lang, stripped
from polyglossa.operators.layout import tokens
from polyglossa.operators.skew import spread_join
from polyglossa.operators.tm import tm_lookup

#: Tokens of a vocabulary, and n-grams of a profile, that are sent to every task.
MOST_TOKENS, MOST_GRAMS = 1 << 20, 1 << 20
#: Code points of text scored at once.
STEP = 1 << 19


def _with_column(df: DataFrame, name: str, kind: T.DataType, made: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """df with a column that `made` computes from whole batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, made(b)], [*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def known_tokens(df: DataFrame, keys: list[str], vocab: DataFrame, own: str = "own", most: int = MOST_TOKENS) -> DataFrame:
    """df with n_known: how many tokens of the array `own` (distinct ones) the vocabulary (token) has. keys: name a row."""
    known = vocab.select("token").filter("token is not null").distinct()
    words = known.limit(most + 1).toArrow().column(0)
    if len(words) <= most:
        shared = df.sparkSession.sparkContext.broadcast(words.combine_chunks())

        def count(b: pa.RecordBatch) -> pa.Array:
            lists = b.column(own)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            hits = np.r_[0, np.cumsum(pc.is_in(lists.flatten(), value_set=shared.value).to_numpy(zero_copy_only=False))]
            ends = np.cumsum(sizes)
            return pa.array((hits[ends] - hits[ends - sizes]).astype(np.int64))

        return _with_column(df, "n_known", T.LongType(), count)
    asked = df.select(*keys, F.explode(own).alias("token"))
    counts = spread_join(asked, known, ["token"], "inner").groupBy(*keys).agg(F.count("*").alias("n_known"))
    return df.join(counts, keys, "left").withColumn("n_known", F.coalesce("n_known", F.lit(0)))


def gram_text(c: Column) -> Column:
    """Lower case, one blank for each stretch of white space, a blank on both sides: what n-grams are taken from."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n]+", " ")), F.lit(" "))


def gram_sums(df: DataFrame, keys: list[str], profiles: DataFrame, ask: str = "ask", n: int = 3, most: int = MOST_GRAMS) -> tuple[DataFrame, list[str]]:
    """df with sums, and the languages they belong to: log probabilities (millionths) of the text `ask` in each language; null where ask is.

    profiles: lang, gram, logp as train_profiles gives them. keys: name a row.
    """
    unseen = {r.lang: r.logp for r in profiles.filter("gram is null").select("lang", "logp").collect()}  # one row for each language
    langs = sorted(unseen)
    kind = T.ArrayType(T.LongType())
    if not langs:
        return df.withColumn("sums", F.lit(None).cast(kind)), langs
    gain = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col("logp") - unseen[x])), F.lit(0)).alias(f"g{k}") for k, x in enumerate(langs)]
    table = profiles.filter("gram is not null").groupBy("gram").agg(*gain)
    rows = table.limit(most + 1).toArrow() if n <= 3 else None
    if rows is not None and rows.num_rows <= most:
        codes = gram_codes("".join(rows.column(0).to_pylist()), n)[::n]
        order = np.argsort(codes)
        gains = np.stack([rows.column(1 + k).to_numpy() for k in range(len(langs))], 1)[order]
        shared = df.sparkSession.sparkContext.broadcast((codes[order], np.r_[gains, np.zeros((1, len(langs)), np.int64)]))
        least = np.array([unseen[x] for x in langs], np.int64)

        def score(b: pa.RecordBatch) -> pa.Array:
            known, gains = shared.value
            texts = b.column(ask).to_pylist()
            out = np.zeros((len(texts), len(langs)), np.int64)
            for row, text in enumerate(texts):
                for at in range(0, max(0, len(text or "") - n + 1), STEP):
                    codes = gram_codes(text[at : at + STEP + n - 1], n)
                    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    place[known[place] != codes] = len(known)
                    out[row] += gains[place].sum(0) + len(codes) * least
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), len(langs)).cast(pa.list_(pa.int64()))
            return pc.if_else(b.column(ask).is_valid(), lists, pa.scalar(None, lists.type))

        return _with_column(df, "sums", kind, score), langs
    grams = F.regexp_extract_all(F.col(ask), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    own = df.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("c"))
    met = spread_join(own, table, ["gram"])
    sums = met.groupBy(*keys).agg(F.array(*(F.sum(F.col("c") * (F.coalesce(f"g{k}", F.lit(0)) + unseen[x])) for k, x in enumerate(langs))).alias("sums"))
    # a text without an n-gram has sums of 0
    return df.join(sums, keys, "left").withColumn("sums", F.when(F.col(ask).isNotNull(), F.coalesce("sums", F.array(*[F.lit(0).cast("long")] * len(langs))))), langs


def ranked(sums: Column, langs: list[str]) -> Column:
    """Structs of less (score below zero first) and lang, likeliest first, ties by name."""
    return F.array_sort(F.array(*(F.struct((-sums[k]).alias("less"), F.lit(x).alias("lang")) for k, x in enumerate(langs))))


def ngram_langid(df: DataFrame, profiles: DataFrame, keys: list[str], n: int = 3, top: int = 3, most: int = MOST_GRAMS) -> DataFrame:
    """keys, lang, rank, score of the `top` languages of each text with a character. df: keys, text; profiles: what train_profiles gives."""
    asked = df.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(*keys, gram_text(F.col("text")).alias("ask"))
    scored, langs = gram_sums(asked, keys, profiles, "ask", n, most)
    if not langs:
        return scored.select(*keys, F.lit("").alias("lang"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("score")).limit(0)
    each = scored.select(*keys, F.posexplode(F.slice(ranked(F.col("sums"), langs), 1, top)).alias("nth", "best"))
    return each.select(*keys, "best.lang", (F.col("nth") + 1).alias("rank"), (-F.col("best.less")).alias("score"))


def detect(
    df: DataFrame, keys: list[str], vocab: DataFrame, profiles: DataFrame, dictionary: str, fallback: str = "en", threshold: float = 0.30, boost: float = 1.5,
    supported: tuple[str, ...] | None = None, n: int = 3, most_tokens: int = MOST_TOKENS, most_grams: int = MOST_GRAMS,
) -> DataFrame:
    """df with found, confidence, method and alternatives of `text`.

    dictionary: over `threshold` of the distinct tokens are in vocab (token), the words of that language. statistical: the likeliest
    profile, its share of the likelihood as confidence (four places); the next two stand in alternatives as lang:ten-thousandths. fallback:
    blank texts and texts without a letter (confidence 0), and languages that are not supported (0.3).
    """
    text = stripped(F.col("text"))
    rows = known_tokens(df.withColumn("own", F.array_distinct(tokens(text))), keys, vocab, "own", most_tokens)
    ratio = F.coalesce(F.try_divide("n_known", F.size("own")), F.lit(0.0))
    rated = rows.withColumn("ratio", ratio).drop("own", "n_known")
    sure = F.col("ratio") > threshold
    scored, langs = gram_sums(rated.withColumn("ask", F.when(~sure & text.rlike(r"\p{L}"), gram_text(text))), keys, profiles, "ask", n, most_grams)
    if not langs:
        return scored.select(
            *df.columns, F.when(sure, dictionary).otherwise(fallback).alias("found"), F.when(sure, F.least(F.col("ratio") * boost, F.lit(1.0))).otherwise(0.0).alias("confidence"),
            F.when(sure, "dictionary").otherwise("fallback").alias("method"), F.lit("").alias("alternatives"),
        )
    named = scored.withColumn("order", F.when(F.col("sums").isNotNull(), ranked(F.col("sums"), langs)))
    first = F.col("order")[0]["less"]
    total = reduce(lambda a, b: a + b, (F.exp((first - F.col("order")[k]["less"]) / 1000000.0) for k in range(len(langs))))
    named = named.withColumn("total", total)
    share = lambda k: F.round(F.exp((first - F.col("order")[k]["less"]) / 1000000.0) / F.col("total"), 4)
    allowed = F.lit(True) if supported is None else F.col("order")[0]["lang"].isin(*supported)
    asked = F.col("order").isNotNull()
    others = [
        F.when(F.lit(True) if supported is None else F.col("order")[k]["lang"].isin(*supported), F.concat(F.col("order")[k]["lang"], F.lit(":"), F.round(share(k) * 10000).cast("int")))
        for k in range(1, min(3, len(langs)))
    ]
    return named.select(
        *df.columns,
        F.when(sure, dictionary).when(asked & allowed, F.col("order")[0]["lang"]).otherwise(fallback).alias("found"),
        F.when(sure, F.least(F.col("ratio") * boost, F.lit(1.0))).when(asked & allowed, share(0)).when(asked, 0.3).otherwise(0.0).alias("confidence"),
        F.when(sure, "dictionary").when(asked & allowed, "statistical").otherwise("fallback").alias("method"),
        F.when(~sure & asked & allowed, F.concat_ws("|", *others)).otherwise("").alias("alternatives"),
    )


def doc_language(votes: DataFrame, sure: float = 0.5, share: float = 0.20, fallback: str = "en") -> DataFrame:
    """doc_id, language, confidence, mixed, distribution: the most frequent language of sure lines, ties to the first seen.

    distribution: lang:count of sure lines, in that order. Without a sure line: the fallback with 0, mixed. votes: doc_id, line_no, found, confidence.
    """
    sure_one = F.col("confidence") >= sure
    counts = votes.groupBy("doc_id", "found").agg(F.count_if(sure_one).alias("n"), F.min(F.when(sure_one, F.col("line_no"))).alias("seen"))
    order = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("less"), "seen", "found"))))  # one for each language
    tops = counts.groupBy("doc_id").agg(order.alias("order"), F.sum("n").alias("total"))
    large = F.size(F.filter("order", lambda x: -x["less"] / F.col("total") > share))
    first = F.get("order", F.lit(0))
    return tops.select(
        "doc_id", F.when(F.col("total") > 0, first["found"]).otherwise(fallback).alias("language"), F.coalesce(F.try_divide(-first["less"], "total"), F.lit(0.0)).alias("confidence"),
        ((F.col("total") == 0) | (large > 1)).alias("mixed"), F.array_join(F.transform("order", lambda x: F.concat(x["found"], F.lit(":"), -x["less"])), "|").alias("distribution"),
    )


def auto_source(docs: DataFrame, lines: DataFrame, found: Callable[[DataFrame], DataFrame], pages: int = 3, fallback: str = "en") -> DataFrame:
    """doc_id, language, confidence, mixed, distribution, chosen: the vote of the lines of the first pages.

    docs: doc_id, manual (null: automatic; a language given by hand has confidence 1). lines: doc_id, page (from 0), line_no, text, not
    blank; those of later pages are not looked at, those of documents with a language by hand have no vote and may be left out: texts are
    not shuffled to find them. found: `detect` with its models. A document without a line has the fallback with 0, not mixed.
    """
    auto = docs.filter("manual is null").select("doc_id")
    asked = lines.filter(F.col("page") < pages)
    votes = doc_language(found(asked).select("doc_id", "line_no", "found", "confidence"), fallback=fallback).join(auto, "doc_id", "left_semi")
    by_hand = F.col("manual").isNotNull()
    return docs.join(votes, "doc_id", "left").select(
        "doc_id", F.coalesce("manual", "language", F.lit(fallback)).alias("language"), F.when(by_hand, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce("mixed", F.lit(False)).alias("mixed"), F.coalesce("distribution", F.lit("")).alias("distribution"), F.when(by_hand, "manual").otherwise("auto").alias("chosen"),
    )


def translate_auto(docs: DataFrame, sources: DataFrame, asked: Callable[[DataFrame], DataFrame], lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lookup of all lines in the language of their document, which comes to the documents before they are split: each text is shuffled once for it.

    docs: doc_id, text; sources: what auto_source gives; asked: the lines to look up of documents with `lang`; lookup: tm_lookup or memory_lookup with its memory.
    """
    return lookup(asked(docs.select("doc_id", "text").join(sources.select("doc_id", F.col("language").alias("lang")), "doc_id")))


def quick_translate(phrases: DataFrame, keys: list[str], found: Callable[[DataFrame], DataFrame], index: DataFrame) -> DataFrame:
    """keys, original, translated, source_language, target_language, detection_confidence, method, confidence, needs_review of phrases.

    phrases: keys, text, src_lang ('auto': found by itself; otherwise as given, without a detection), tgt_lang. found: `detect` with its models.
    """
    clean = phrases.select(*keys, clean_invisible(F.col("text")).alias("text"), "src_lang", "tgt_lang")
    auto = F.col("src_lang") == "auto"
    seen = found(clean.withColumn("whole", F.col("text")).withColumn("text", F.when(auto, F.col("text"))))
    asked = seen.select(
        *keys, F.col("whole").alias("text"), normalize_lang(F.when(auto, F.col("found")).otherwise(F.col("src_lang"))).alias("src_lang"), "tgt_lang",
        F.when(auto, F.col("confidence")).alias("detection_confidence"),
    )
    return tm_lookup(asked, index).select(
        *keys, F.col("text").alias("original"), "translated", F.col("src_lang").alias("source_language"), F.col("tgt_lang").alias("target_language"),
        "detection_confidence", "method", "confidence", "needs_review",
    )
