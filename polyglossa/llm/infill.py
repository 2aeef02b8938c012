"""Fill-in-middle transformation: repeated-capture matching.

A text is a row of units, by default code points. One fullmatch of (unit)* keeps the capture of every repetition, so ends(1) gives the
number of units and the code point where each one ends; two of these ends are the cuts. Texts of code points beyond `block` are matched
block by block, which is exact for them (every code point ends a unit) and bounds the captures held, some 110 bytes each.

Cuts and form follow from four numbers of the sha256 of `seed:id`, so a row always turns out the same. `restored` rebuilds the text
from output and form alone: texts that hold a marker stay plain, so the first of each marker is the one set here.

Nulls: a null text is the empty text; a null id stands as no digits. Empty texts, texts with a marker, and texts that units do not cover
(n null) stay plain. Repeated rows give equal rows. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point.
POINT = r"(?s:.)"


def unit_ends(pattern: regex.Pattern, text: str, block: int | None) -> list[int] | np.ndarray | None:
    """End of each repetition of the pattern's first group over the whole text; null if it does not match."""
    if block is None or len(text) <= block:
        found = pattern.fullmatch(text)
        return None if found is None else found.ends(1)
    return np.concatenate([np.array(pattern.fullmatch(text, at, min(at + block, len(text))).ends(1), np.int64) for at in range(0, len(text), block)])


def rearrange(pattern: regex.Pattern, text: str, h: tuple[int, int, int, int], plain: int, spm: int, block: int | None) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    ends = unit_ends(pattern, text, block)
    n = None if ends is None else len(ends)
    if not text or ends is None or h[2] % 100 >= plain or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: Column, form: Column) -> Column:
    """The text, from what `fill_documents` made of it and the form."""
    first, second = (F.when(form == "psm", a).otherwise(b) for a, b in ((F.lit(SUFFIX), F.lit(PREFIX)), (F.lit(PREFIX), F.lit(SUFFIX))))
    # psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle
    cut, end = F.position(first, output), F.position(F.lit(MIDDLE), output)
    left = F.substring(output, F.length(second) + 1, cut - F.length(second) - 1)
    right = F.substring(output, cut + F.length(first), end - cut - F.length(first))
    middle = F.substring(output, end + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


def fill_documents(df: DataFrame, unit: str = POINT, seed: int = 1, plain: int = 90, spm: int = 20, block: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output.

    unit: a pattern without groups of its own. plain: rows whose third number modulo 100 is at least this stay plain; spm: of the
    others, those whose fourth is below this get the suffix first. block: code points matched at once, for units of one code point.
    """
    kind = dict(df.dtypes)[id_col]
    pattern = regex.compile(f"({unit})*")
    step = block if unit == POINT else None
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches):
        for b in batches:
            numbers = list(zip(*(b.column(k).to_pylist() for k in range(2, 6))))
            for at, texts in raw_texts(b.column(1)):
                rows = [rearrange(pattern, t.decode(), numbers[at + k], plain, spm, step) for k, t in enumerate(texts)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    chosen = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *numbers)
    return chosen.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def fill_digest(df: DataFrame) -> DataFrame:
    """The transformation with digests in place of texts: output_sha256, restored_sha256."""
    made = fill_documents(df)
    digests = (F.sha2(text, 256).alias(name) for text, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: The same rows, cut by position.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '{PREFIX}' || substr(t, 1, a) || '{SUFFIX}' || substr(t, b + 1) || '{MIDDLE}' || substr(t, a + 1, b - a)
        ELSE '{SUFFIX}' || substr(t, b + 1) || '{PREFIX}' || substr(t, 1, a) || '{MIDDLE}' || substr(t, a + 1, b - a) END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM f
"""
