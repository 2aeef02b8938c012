"""Corpus audit aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyglossa.functions.text import notes_flags, record_class, strip_diacritics, words

LANGS = ("english", "tagabawa", "filipino", "cebuano")


def _bare(c: str):
    """Without outer white space; null is blank."""
    return F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(" \t\r\n"))


def _key(c: str):
    """What duplicates are told by: neither case nor outer white space counts, and null is blank."""
    return F.lower(_bare(c))


def _blank(c: str):
    return _bare(c) == ""


def audit_counts(df: DataFrame, langs=LANGS) -> DataFrame:
    """Rows, rows with all languages, rows that miss any. Null counts as missing."""
    missing = F.lit(False)
    for c in langs:
        missing = missing | _blank(c)
    return df.agg(F.count("*").alias("total"), F.count_if(~missing).alias("complete"), F.count_if(missing).alias("missing_any"))


def audit_types(df: DataFrame, langs=LANGS) -> DataFrame:
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("lang"), F.col(c).alias("text")) for c in langs))).alias("x")).select("x.*")
    return long.groupBy("lang", record_class(F.col("text")).alias("record_class")).agg(F.count("*").alias("n"))


def audit_dups(df: DataFrame, langs=LANGS) -> DataFrame:
    """Groups of rows with the same texts in all languages, and their rows beyond the first."""
    groups = df.groupBy(*(_key(c).alias(c) for c in langs)).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def audit_polysemy(df: DataFrame, key: str = "tagabawa", ref: str = "english") -> DataFrame:
    """source, n_variants, variants of keys with several references, blank ones included; variants are sorted and joined by bars."""
    sets = df.filter(~_blank(key)).groupBy(_key(key).alias("source")).agg(F.sort_array(F.collect_set(_key(ref))).alias("v"))
    return sets.filter(F.size("v") > 1).select("source", F.size("v").alias("n_variants"), F.array_join("v", "|").alias("variants"))


def line_classes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("lang", record_class(F.col("text")).alias("record_class")).agg(F.count("*").alias("n"))


def audit_coverage(df: DataFrame, langs=LANGS) -> DataFrame:
    """Cells with and without text of each language, in one pass."""
    cells = df.unpivot([], list(langs), "lang", "text")
    return cells.groupBy("lang").agg(F.count_if(~_blank("text")).alias("present"), F.count_if(_blank("text")).alias("missing"))


def audit_field_dups(df: DataFrame, langs=LANGS) -> DataFrame:
    """Rows beyond the first of each text, by language; blank texts are one text, too."""
    cells = df.unpivot([], list(langs), "lang", "text")
    return cells.groupBy("lang", _key("text").alias("key")).agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum(F.col("n") - 1).alias("extra_rows"))


def unicode_issues(c):
    """Struct of flags: a replacement character, a control character, a piece of HTML, a double space."""
    c = F.coalesce(c, F.lit(""))
    return F.struct(
        c.contains("\ufffd").alias("replacement"), c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]").alias("control"),
        F.lower(c).rlike("<[a-z]|&[a-z]+;").alias("html"), c.contains("  ").alias("double_space"),
    )


ISSUES = ("replacement", "control", "html", "double_space")


def audit_unicode(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Cells with each issue."""
    found = df.select(unicode_issues(F.col(text_col)).alias("i"))
    return found.agg(*(F.count_if(F.col(f"i.{k}")).alias(k) for k in ISSUES))


def audit_unicode_rows(df: DataFrame, langs=LANGS) -> DataFrame:
    """id, lang, issues: the cells that have any, with their names joined by bars."""
    cells = df.unpivot(["id"], list(langs), "lang", "text").select("id", "lang", unicode_issues(F.col("text")).alias("i"))
    named = cells.select("id", "lang", F.concat_ws("|", *(F.when(F.col(f"i.{k}"), k) for k in ISSUES)).alias("issues"))
    return named.filter("issues <> ''")


def audit_diacritics(df: DataFrame, key: str = "lang", text_col: str = "text") -> DataFrame:
    return df.groupBy(key).agg(F.count_if(strip_diacritics(F.col(text_col)) != F.col(text_col)).alias("marked"), F.count("*").alias("n"))


def audit_alignment(df: DataFrame, left: str, right: str, most: float = 5.0) -> DataFrame:
    """Rows whose sides differ in words by more than the given ratio; both sides hold text."""
    a, b = F.size(words(F.col(left))), F.size(words(F.col(right)))
    sized = df.select("*", a.alias("n_left"), b.alias("n_right")).filter("n_left > 0 AND n_right > 0")
    ratio = F.try_divide("n_left", "n_right")
    return sized.withColumn("ratio", F.round(ratio, 2)).filter((ratio > most) | (ratio < 1 / most))


#: Categories of notes and the words they are told by.
NOTE_KINDS = {"auto_split_from_slash": "auto-split", "manual_check_slash": "manual check", "needs_double_check": "double check", "plural_note": "plural", "singular_note": "singular"}


def audit_sources(df: DataFrame) -> DataFrame:
    """kind, value, n: rows of each source and topic, and of each category of notes (a note may be in several)."""
    notes = F.lower(F.coalesce("notes", F.lit("")))
    pairs = [F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("source", F.coalesce("source", F.lit(""))), ("topic", _bare("topic")))]
    pairs += [F.when(notes.contains(word), F.struct(F.lit("notes").alias("kind"), F.lit(name).alias("value"))) for name, word in NOTE_KINDS.items()]
    return df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def audit_cross_leak(left: DataFrame, right: DataFrame, field: str) -> DataFrame:
    """Distinct texts of left's field, how many of them right has too, how many only left has, and whether right has all. Blank texts do not count."""
    a, b = (x.filter(~_blank(field)).select(_key(field).alias("key")).distinct() for x in (left, right))
    both = a.join(b.withColumn("there", F.lit(1)), "key", "left").agg(F.count("*").alias("n_left"), F.count("there").alias("n_shared"))
    return both.select("n_left", "n_shared", (F.col("n_left") - F.col("n_shared")).alias("n_left_only"), (F.col("n_left") == F.col("n_shared")).alias("subset"))


def audit_left_only(left: DataFrame, right: DataFrame, field: str) -> DataFrame:
    """key: texts of left's field that right does not have."""
    a, b = (x.filter(~_blank(field)).select(_key(field).alias("key")).distinct() for x in (left, right))
    return a.join(b, "key", "left_anti")


def audit_report(df: DataFrame, flagged: str, langs=LANGS, key: str = "tagabawa", ref: str = "english", most: float = 5.0) -> DataFrame:
    """section, metric, n: the whole audit from one scan of df (id, a column for each language, topic, source, notes).

    Every row gives its marks (kind, a, b); they are counted by all three, then by kind and a, then by metric, so that no
    aggregate reads the table again and a frequent mark is added up before it is shuffled. flagged: a condition counted as `flagged`.
    """
    mark = lambda kind, a, b="": F.struct(F.lit(kind).alias("kind"), (F.lit(a) if isinstance(a, str) else a).alias("a"), (F.lit(b) if isinstance(b, str) else b).alias("b"))
    whole = reduce(lambda x, y: x & y, (~_blank(c) for c in langs))
    marks = [mark("counts", "total"), F.when(whole, mark("counts", "complete")).otherwise(mark("counts", "missing_any")), F.when(F.expr(flagged), mark("counts", "flagged"))]
    for c in langs:
        issues = unicode_issues(F.col(c))
        marks += [F.when(~_blank(c), mark("coverage", c)).otherwise(mark("coverage", f"missing_{c}")), mark("types", F.concat(F.lit(f"{c}_"), record_class(F.col(c))))]
        marks += [F.when(issues[k], mark("unicode", k)) for k in ISSUES]
    marks += [mark("same_row", F.concat_ws("\x1f", *(_key(c) for c in langs))), mark(f"same_{ref}", _key(ref)), mark(f"same_{key}", _key(key)), F.when(~_blank(key), mark("polysemy", _key(key), _key(ref)))]
    n_key, n_ref = F.size(words(F.col(key))), F.size(words(F.col(ref)))
    ratio = F.try_divide(n_key, n_ref)
    marks += [F.when((n_key > 0) & (n_ref > 0) & ((ratio > most) | (ratio < 1 / most)), mark("alignment", "outliers"))]
    notes = F.lower(F.coalesce("notes", F.lit("")))
    marks += [mark("sources", F.coalesce("source", F.lit(""))), mark("topics", _bare("topic")), *(F.when(notes.contains(w), mark("notes", k)) for k, w in NOTE_KINDS.items())]
    each = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.kind", "m.a", "m.b").agg(F.count("*").alias("n"))
    keys = each.groupBy("kind", "a").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    same = F.col("kind").startswith("same_")
    told = F.when(same & (F.col("n") > 1), F.array(F.struct(F.lit("groups").alias("metric"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("extra_rows").alias("metric"), (F.col("n") - 1).alias("n"))))
    told = told.when((F.col("kind") == "polysemy") & (F.col("kinds") > 1), F.array(F.struct(F.lit("groups").alias("metric"), F.lit(1).cast("long").alias("n"))))
    told = told.when(~same & (F.col("kind") != "polysemy"), F.array(F.struct(F.col("a").alias("metric"), F.col("n").alias("n"))))
    return keys.select(F.col("kind").alias("section"), F.explode(told).alias("t")).groupBy("section", "t.metric").agg(F.sum("t.n").alias("n"))


def audit_rows(df: DataFrame, langs=LANGS, key: str = "tagabawa") -> DataFrame:
    """id, record_class, flags, is_exact_dup, complete of every row."""
    same = Window.partitionBy(*(_key(c) for c in langs))
    complete = F.lit(True)
    for c in langs:
        complete = complete & ~_blank(c)
    return df.select(
        "id", record_class(F.col(key)).alias("record_class"), notes_flags(F.col("notes"))["flags"].alias("flags"),
        (F.count("*").over(same) > 1).alias("is_exact_dup"), complete.alias("complete"),
    )


def audit_quality(df: DataFrame) -> DataFrame:
    """Rows, rows cut automatically and their share in per cent, rows to review by either rule."""
    flags = df.select(notes_flags(F.col("notes")).alias("f")).select("f.*")
    auto = F.count_if(F.col("flags").contains("auto-split"))
    return flags.agg(
        F.count("*").alias("total"), auto.alias("auto_split"), F.round(100 * auto / F.count("*"), 2).alias("auto_split_pct"),
        F.count_if("review_import").alias("review_import"), F.count_if("review_export").alias("review_export"),
    )


def top_topics(book: DataFrame, n: int = 10) -> DataFrame:
    """nth, topic, n: the n most frequent topics, outer blanks left out, ties by name. Counted first, so that few rows are sorted."""
    counts = book.groupBy(F.trim(F.coalesce("topic", F.lit(""))).alias("topic")).agg(F.count("*").alias("n")).filter("topic <> ''")
    shown = counts.orderBy(F.desc("n"), "topic").limit(n)
    return shown.select(F.row_number().over(Window.orderBy(F.desc("n"), "topic")).alias("nth"), "topic", "n")
