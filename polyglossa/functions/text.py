"""Text expressions: Column in, Column out; nulls read as the empty text."""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are not shown.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060"


def _marked_letters() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters that decompose to one plain character, and those characters."""
    blocks = chain(range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000))
    plain = {chr(k): "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c)) for k in blocks}
    found = {k: v for k, v in plain.items() if len(v) == 1 and v != k}
    return "".join(found), "".join(found.values())


MARKED, PLAIN = _marked_letters()


def gram_codes(text: str, n: int) -> np.ndarray:
    """A number for each n-gram, n up to 3: 21 bits a code point."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.zeros(max(0, len(points) - n + 1), np.int64)
    for k in range(n):
        out = out << 21 | points[k : k + len(out)]
    return out


def clean_invisible(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), INVISIBLE, "")


def stripped(c: Column) -> Column:
    """Without characters that are not shown and outer white space."""
    return F.btrim(clean_invisible(c), F.lit(" \t\r\n"))


def raw_lower(c: Column) -> Column:
    return F.lower(stripped(c))


def lookup_form(raw: Column) -> Column:
    """Text of raw_lower without punctuation, white space collapsed."""
    kept = F.regexp_replace(raw, r"[^\p{L}\p{N}_ \t\r\n-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[ \t\r\n]+", " "), "^ +| +$", "")


def _decomposed(texts: pd.Series) -> pd.Series:
    """Texts in compatibility decomposition without combining characters: each distinct character of the batch is decomposed once."""
    known = {ord(x): "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y)) for x in set().union(*texts.dropna())}
    return texts.map(lambda t: t.translate(known), na_action="ignore")


def strip_diacritics(c: Column, exact: bool = False) -> Column:
    """Letters without their marks, composed or combining.

    By a table of letters with one plain character, inside the JVM; exact decomposes every character (ligatures, full-width forms, syllables), in Arrow batches.
    """
    if exact:
        return F.pandas_udf(_decomposed, "string")(c)
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), r"\p{Mn}", "")


def lookup_text(c: Column) -> Column:
    """Lower case without punctuation, white space collapsed."""
    return lookup_form(raw_lower(c))


def lookup_variants(c: Column) -> Column:
    """Ordered distinct variants: raw, normalized, normalized without diacritics."""
    return F.array_distinct(F.filter(F.array(raw_lower(c), lookup_text(c), strip_diacritics(lookup_text(c))), lambda x: x != ""))


def record_id(source: Column, target: Column, row_id: Column) -> Column:
    """`bgs-eng-0001`: codes of the languages and the id in four digits at least; another id with its odd characters as hyphens."""
    codes = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    text = F.trim(row_id.cast("string"))
    slug = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    name = F.when(text.rlike("^[0-9]+$"), F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))).otherwise(slug)
    return F.concat_ws("-", F.coalesce(F.element_at(codes, source), source), F.coalesce(F.element_at(codes, target), target), name)


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")


def record_class(c: Column) -> Column:
    n = F.size(words(c))
    sentences = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"[ \t\r\n]+", "") != ""))
    return (
        F.when(n == 0, "empty").when(n == 1, "single_word").when(n <= 6, "short_phrase").when(n > 50, "paragraph")
        .when(sentences > 1, "multi_sentence").when(n <= 15, "short_sentence").otherwise("long_sentence")
    )


def preserve_case(source: Column, target: Column) -> Column:
    head = F.substring(source, 1, 1)
    return F.when((head == F.upper(head)) & (head != F.lower(head)), F.concat(F.upper(F.substring(target, 1, 1)), F.substr(target, F.lit(2)))).otherwise(target)


#: Spellings of language names (by alias key) and the codes of the languages.
ALIASES = {
    "bagobo": "tagabawa", "tagabawa": "tagabawa", "bagobo tagabawa": "tagabawa", "bagobo-tagabawa": "tagabawa", "bgs": "tagabawa", "english": "english", "en": "english", "eng": "english",
    "filipino": "filipino", "tagalog": "filipino", "fil": "filipino", "tgl": "filipino", "cebuano": "cebuano", "ceb": "cebuano", "bisaya": "cebuano", "visayan": "cebuano",
}
CODES = {"tagabawa": "bgs", "english": "eng", "filipino": "fil", "cebuano": "ceb"}
#: Marks of a missing translation in a text, and methods whose lines show the source instead.
REVIEW_MARKERS = ("[UNKNOWN_FOR_REVIEW]", "UNKNOWN_FOR_REVIEW", "byt5_unavailable", "untranslated_needs_review")
SOURCE_METHODS = ("unknown_for_review", "untranslated_needs_review", "byt5_unavailable", "untranslated")
#: Headers of columns besides the languages' own names.
HEADERS = {
    "tagalog text": "filipino_source", "tagalog source": "filipino_source",
    "bagobo text": "tagabawa_source", "bagobo source": "tagabawa_source", "bagobo tagabawa text": "tagabawa_source",
    "english text": "english_source", "english source": "english_source", "cebuano text": "cebuano_source", "cebuano source": "cebuano_source",
}
#: Engines by extraction method; others are text extraction.
ENGINES = {"direct_pdf_text": "pymupdf_text", "docx_text": "python-docx", "plain_text": "plain_text", "ocr_image": "tesseract"}


def alias_key(c: Column) -> Column:
    """Lower case, underscores as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(clean_invisible(c), "_", " ")), r"[ \t\r\n]+", " "))


def normalize_lang(c: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The language's name for any of its spellings; an unknown one passes through as its key."""
    names = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.element_at(names, alias_key(c)), alias_key(c))


def canonical_header(header: str | None, aliases: dict[str, str] = ALIASES) -> str | None:
    """`<language>_source` for any header that names a language; on the driver, for schemas."""
    key = " ".join("".join(c for c in header or "" if c not in INVISIBLE).lower().split())
    languages = set(aliases.values())
    if key.endswith("_source") and key.removesuffix("_source") in languages:
        return key
    key = " ".join(key.replace("_", " ").split())
    return HEADERS.get(key) or (f"{aliases[key]}_source" if key in aliases else None)


def pair_text(c: Column) -> Column:
    """One side of a pair key: lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\r\n]+", " "))


def notes_flags(notes: Column) -> Column:
    """Struct of flags (joined by |), review_import and review_export: two rules, both in use."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    names = ("auto-split", "manual check", "double check", "plural", "singular")
    flags = F.concat_ws("|", *(F.when(low.contains(n), n) for n in names))
    loose = low.contains("manual check") | low.contains("double check") | low.contains("review")
    strict = low.contains("need to double check") | low.contains("manual check")
    return F.struct(flags.alias("flags"), loose.alias("review_import"), strict.alias("review_export"))


def is_trainable(c: Column) -> Column:
    """Neither blank nor marked for review."""
    text = F.coalesce(c, F.lit(""))
    return (F.regexp_replace(text, r"[ \t\r\n]+", "") != "") & ~text.contains(REVIEW_MARKERS[0])


def notes_value(notes: Column, key: str) -> Column:
    """The value of `key:value` among the parts of notes that bars separate; null without one."""
    return F.nullif(F.regexp_extract(notes, rf"(?:^|\|)\s*{key}:([^|]*)", 1), F.lit(""))


def notes_ids(notes: Column) -> Column:
    """The numbers of `source_ids:1,2`; parts that are no numbers go."""
    parts = F.split(F.coalesce(notes_value(notes, "source_ids"), F.lit("")), r"\s*,\s*")
    return F.transform(F.filter(parts, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))


def line_kind(c: Column) -> Column:
    """'list_item' if the text starts with a digit or a bullet, else 'text'."""
    return F.when(F.coalesce(F.trim(c), F.lit("")).rlike("^[0-9\u2022*-]"), "list_item").otherwise("text")


def to_float(c: Column) -> Column:
    """A number, null for what is none."""
    return c.cast("string").try_cast("double")


def to_count(c: Column) -> Column:
    """A whole number of at least 0; 0 for what is none."""
    return F.greatest(F.coalesce(c.cast("string").try_cast("long"), F.lit(0)), F.lit(0))


def engine_label(method: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ENGINES.items() for x in kv)), method), F.lit("text_extraction"))


def method_label(method: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(method), F.lit("")), F.lit("text_extraction"))


def _shown(c: Column) -> Column:
    return F.lower(F.trim(clean_invisible(c)))


def is_fallback(target: Column, method: Column, stage: Column | None = None) -> Column:
    """Whether the source must be shown: a blank or marked target, or a method or stage that has none."""
    # the target is put in small letters once for all marks
    marked = F.exists(F.array(_shown(target)), lambda t: reduce(lambda a, b: a | b, (t.contains(m.lower()) for m in REVIEW_MARKERS), t == ""))
    for c in (method, stage):
        if c is not None:
            marked = marked | _shown(c).isin(*SOURCE_METHODS)
    return marked


def display_text(source: Column, target: Column, method: Column, stage: Column | None = None) -> Column:
    return F.when(is_fallback(target, method, stage), clean_invisible(source)).otherwise(clean_invisible(target))


def color_triple(c: Column) -> Column:
    """Red, green and blue in 0..1 of three numbers, which count to 255 if any is over 1; null for another number of them."""
    scale = F.when(F.exists(c, lambda v: v > 1), 255.0).otherwise(1.0)
    return F.when(F.size(c) == 3, F.transform(c, lambda v: F.round(F.least(F.greatest(v / scale, F.lit(0.0)), F.lit(1.0)), 4)))


def color_rgb(packed: Column) -> Column:
    """Red, green and blue in 0..1 of a packed colour."""
    return F.transform(F.array(F.shiftright(packed, 16), F.shiftright(packed, 8), packed), lambda v: F.round(v.bitwiseAND(255) / 255.0, 4))
