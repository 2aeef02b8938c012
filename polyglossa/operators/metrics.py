"""Error rates and overlap scores of predictions. Null texts read as empty ones; empty tables give the scores of no text, 0."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def _bits(places: list[int]) -> int:
    """A number with these bits set, made from bytes so that its cost is its length."""
    out = bytearray(places[-1] // 8 + 1)
    for k in places:
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edits between two lists, by bit vectors as long as a: one step for each member of b, whatever the number of different ones."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    places: dict = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    at = {x: _bits(ks) for x, ks in places.items()}
    whole, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    more, less = whole, 0  # where a column rises and falls
    for y in b:
        same = at.get(y, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | ~(across | more) & whole, more & across
        distance += bool(up & last) - bool(down & last)
        up, down, met = (up << 1 | 1) & whole, down << 1 & whole, same | less
        more, less = down | ~(met | up) & whole, up & met
    return distance


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(*((x, y) if len(x) <= len(y) else (y, x))) for x, y in zip(a, b)], dtype="int64")


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate: 0 for an empty reference, 1 at most."""
    r, h = _words(ref), _words(hyp)
    edits = F.pandas_udf(_distances, "long")(r, h)
    return F.when(F.size(r) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(edits, F.size(r))))


def mean_confidence(c: Column) -> Column:
    """Mean of those that are not null, to four places; an aggregate."""
    return F.round(F.avg(c), 4)


def tokens_13a(c: Column) -> Column:
    """Words as the mteval-v13a rules cut them: marks apart, but for full stops and commas inside numbers."""
    t = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    for pattern, new in (
        (r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
    ):
        t = F.regexp_replace(t, pattern, new)
    return _words(t)


def _unspaced(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def overlaps(hyp: Sequence, ref: Sequence, orders: int) -> list[int]:
    """For n from 1 to orders: n-grams in common (each as often as the rarer side has it), of hyp, of ref. hyp, ref: strings or lists of words."""
    out: list[int] = []
    for n in range(1, orders + 1):
        h, r = (Counter(x[k : k + n] for k in range(len(x) - n + 1)) if isinstance(x, str) else Counter(zip(*(x[k:] for k in range(n)))) for x in (hyp, ref))
        out += [sum(min(c, r[g]) for g, c in h.items() if g in r), h.total(), r.total()]
    return out


def _overlaps(hyp: Column, ref: Column, orders: int) -> Column:
    """`overlaps` of every row, counted inside the row: no n-gram is shuffled."""

    def count(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([overlaps(h, r, orders) for h, r in zip(hyp, ref)])

    return F.pandas_udf(count, "array<long>")(hyp, ref)


def corpus_bleu(rows: DataFrame, orders: int = 4) -> DataFrame:
    """bleu (0 to 100, four places), n_hyp and n_ref (words) of all rows together. rows: id, hyp, ref.

    Orders without a match are smoothed as by `exp`: each halves the match counted for it.
    """
    each = rows.select(_overlaps(tokens_13a(F.col("hyp")), tokens_13a(F.col("ref")), orders).alias("o"))
    zero = F.lit(0)
    sums = each.agg(*(F.coalesce(F.sum(F.col("o")[k]), zero).alias(f"o{k}") for k in range(3 * orders)))
    m, h = ([F.col(f"o{3 * n + c}") for n in range(orders)] for c in (0, 1))
    r = F.col("o2")
    logs, halves = F.lit(0.0), zero
    for k in range(orders):
        halves = halves + (m[k] == 0).cast("int")
        logs = logs + F.ln(F.try_divide(F.when(m[k] > 0, m[k].cast("double")).otherwise(F.pow(F.lit(0.5), halves)), h[k]))
    brevity = F.when(h[0] < r, 1 - r / h[0]).otherwise(0.0)
    score = F.when((m[0] > 0) & (h[orders - 1] > 0), 100 * F.exp(logs / orders + brevity)).otherwise(0.0)
    return sums.select(F.round(score, 4).alias("bleu"), h[0].alias("n_hyp"), r.alias("n_ref"))


def _chrf(o: list[Column], beta: int) -> Column:
    """F score of the mean precision and recall over the orders that both sides have. o: matched, of hyp, of ref of each order."""
    p, r, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for m, h, f in zip(o[::3], o[1::3], o[2::3]):
        both = (h > 0) & (f > 0)
        p, r, n = p + F.when(both, m / h).otherwise(0.0), r + F.when(both, m / f).otherwise(0.0), n + both.cast("int")
    p, r = (F.coalesce(F.try_divide(x, n), F.lit(0.0)) for x in (p, r))
    return 100 * F.coalesce(F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r), F.lit(0.0))


def corpus_chrf(rows: DataFrame, orders: int = 6, beta: int = 2) -> DataFrame:
    """chrf (0 to 100, four places) of all rows together. rows: id, hyp, ref."""
    each = rows.select(_overlaps(_unspaced(F.col("hyp")), _unspaced(F.col("ref")), orders).alias("o"))
    sums = each.agg(*(F.coalesce(F.sum(F.col("o")[k]), F.lit(0)).alias(f"o{k}") for k in range(3 * orders)))
    return sums.select(F.round(_chrf([F.col(f"o{k}") for k in range(3 * orders)], beta), 4).alias("chrf"))


def sentence_chrf(rows: DataFrame, orders: int = 6, beta: int = 2) -> DataFrame:
    """id, chrf (two places) of each row. rows: id, hyp, ref."""
    each = rows.select("id", _overlaps(_unspaced(F.col("hyp")), _unspaced(F.col("ref")), orders).alias("o"))
    return each.select("id", F.round(_chrf([F.col("o")[k] for k in range(3 * orders)], beta), 2).alias("chrf"))


def prediction_review(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """id, source, reference, prediction, exact_match, chrf, review_status of every reference; a missing prediction is empty. predictions: id, hyp; truth: id, source, ref."""
    both = truth.join(predictions, "id", "left").select("id", "source", "ref", F.coalesce("hyp", F.lit("")).alias("hyp"))
    return both.join(sentence_chrf(both.select("id", "hyp", "ref")), "id").select(
        "id", "source", F.col("ref").alias("reference"), F.col("hyp").alias("prediction"), (F.trim("hyp") == F.trim(F.coalesce("ref", F.lit("")))).alias("exact_match"),
        "chrf", F.lit("needs_review").alias("review_status"),
    )


