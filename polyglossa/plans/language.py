"""Registered queries of languages found by themselves, with their SQL for DuckDB.

Spanish stands for the language that only a dictionary knows; profiles of the others are trained on all their documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglossa.functions.text import INVISIBLE
from polyglossa.operators import language, retention, tm
from polyglossa.operators.skew import heavy_keys
from polyglossa.plans import reports
from polyglossa.plans.sql import LINES, QUERIES as LINE_QUERIES, SPACE, lookup
from polyglossa.sources import views

DICTIONARY = "es"
#: Lines of a page.
PAGE = 20


def _detect(spark: SparkSession, sf_dir: str, keys: list[str]):
    docs = views.table(spark, sf_dir, "documents").select("lang", "text")
    vocab = reports.lang_vocab(spark, sf_dir).filter(F.col("lang") == DICTIONARY)
    profiles = retention.train_profiles(docs.filter(F.col("lang") != DICTIONARY))
    return partial(language.detect, keys=keys, vocab=vocab, profiles=profiles, dictionary=DICTIONARY)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.tm_index(views.memory(spark, sf_dir), ("english", "filipino", "cebuano"), ("english",))


def ngram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = retention.train_profiles(views.table(spark, sf_dir, "documents").select("lang", "text"))
    return language.ngram_langid(views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), profiles, ["conv_id", "turn"])


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, ["doc_id", "line_no"])(views.lines(spark, sf_dir)).select("doc_id", "line_no", "found", "confidence", "method", "alternatives")


def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.doc_language(detect_language(spark, sf_dir))


def auto_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of five has its language given by hand."""
    docs = views.table(spark, sf_dir, "documents").withColumn("manual", F.when(F.col("doc_id") % 5 == 0, F.col("lang")))
    lines = views.lines(spark, sf_dir, docs.filter("manual is null")).withColumn("page", F.floor(F.col("line_no") / PAGE))
    return language.auto_source(docs.select("doc_id", "manual"), lines, _detect(spark, sf_dir, ["doc_id", "line_no"]))


def translate_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    often = heavy_keys(views.queries(spark, sf_dir), "text")
    asked = partial(views.queries, spark, sf_dir)
    lookup = partial(tm.memory_lookup, memory=views.memory(spark, sf_dir, once=False), langs=("english", "filipino", "cebuano"), sources=("english",), heavy=often)
    return language.translate_auto(views.table(spark, sf_dir, "documents"), auto_source(spark, sf_dir), asked, lookup).drop("text")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of benchmark items and of conversations: kind, id, line_no, text, src_lang (auto, or given for every fourth line), tgt_lang."""
    marks = views.table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").cast("long").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    said = views.table(spark, sf_dir, "conversations")
    said = said.select("role", (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    k = (F.col("id") + F.col("line_no")) % 4
    return marks.union(said).select(
        "kind", "id", "line_no", F.when(k == 1, F.concat(F.lit("  "), "text", F.lit("​"))).when(k == 2, F.concat("text", F.lit("?!"))).otherwise(F.col("text")).alias("text"),
        F.when(k == 3, "english").otherwise("auto").alias("src_lang"), F.when(F.col("id") % 2 == 0, "filipino").otherwise("cebuano").alias("tgt_lang"),
    )


def quick_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["kind", "id", "line_no"]
    return language.quick_translate(phrases(spark, sf_dir), keys, _detect(spark, sf_dir, keys), _index(spark, sf_dir))


QUERIES = {f.__name__: f for f in (ngram_langid, detect_language, doc_language, auto_source, translate_auto, quick_translate)}

_GRAM = "(SELECT {k}, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2])) AS gram FROM (SELECT {k}, string_split(' ' || lower(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) || ' ', '') AS l FROM {f}))"
_BARE = f"regexp_replace(translate(text, '{INVISIBLE}', ''), '^{SPACE}|{SPACE}$', '', 'g')"


def _profiles(where: str) -> str:
    """p: logp of each gram in each language; u: of an unseen one."""
    return f"""g AS (SELECT lang, gram, count(*) AS c FROM {_GRAM.format(k='lang', f=f'documents{where}')} GROUP BY 1, 2), b AS (SELECT lang, sum(c) + (SELECT count(DISTINCT gram) FROM g) AS base FROM g GROUP BY 1),
  p AS (SELECT lang, gram, round(ln((c + 1) / base) * 1000000)::BIGINT AS logp FROM g JOIN b USING (lang)), u AS (SELECT lang, round(ln(1 / base) * 1000000)::BIGINT AS least FROM b)"""


def _scores(keys: str, rows: str) -> str:
    """scored: keys, lang, score, r of the table `rows` (keys, text)."""
    same = " AND ".join(f"z.{k} = h.{k}" for k in keys.split(", "))
    own = ", ".join(f"z.{k}" for k in keys.split(", "))
    return f"""o AS (SELECT {keys}, gram, count(*) AS c FROM {_GRAM.format(k=keys, f=rows)} GROUP BY ALL), z AS (SELECT {keys}, sum(c) AS size FROM o GROUP BY ALL),
  h AS (SELECT {keys}, p.lang, sum(c * (logp - least)) AS gain FROM o JOIN p USING (gram) JOIN u ON p.lang = u.lang GROUP BY ALL),
  k AS (SELECT {own}, u.lang, (size * least + coalesce(gain, 0))::BIGINT AS score FROM z CROSS JOIN u LEFT JOIN h ON {same} AND u.lang = h.lang),
  scored AS (SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, lang))::INT AS r FROM k)"""


def _votes(keys: str, rows: str) -> str:
    """votes: keys, found, confidence, method, alternatives of the table `rows` (keys, text; null texts are blank)."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    mine = ", ".join(f"a.{k}" for k in keys.split(", "))
    return rf"""{reports.VOCAB}, bare AS (SELECT {keys}, coalesce({_BARE}, '') AS text FROM {rows}), own AS (SELECT *, {reports.TOKENS} AS own FROM bare),
  hits AS (SELECT {keys}, count(*) AS n FROM (SELECT {keys}, unnest(own) AS token FROM own) JOIN vocab USING (token) WHERE lang = '{DICTIONARY}' GROUP BY ALL),
  rated AS (SELECT {mine}, text, coalesce(n / nullif(len(own), 0), 0.0)::DOUBLE AS ratio FROM own a LEFT JOIN hits b ON {same}),
  ask AS (SELECT * FROM rated WHERE ratio <= 0.3 AND regexp_matches(text, '\p{{L}}')), {_profiles(f" WHERE lang <> '{DICTIONARY}'")}, {_scores(keys, 'ask')},
  e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY {keys})) / 1000000.0::DOUBLE) AS odds FROM scored), f AS (SELECT *, round(odds / sum(odds) OVER (PARTITION BY {keys}), 4) AS share FROM e),
  best AS (SELECT {keys}, max(CASE WHEN r = 1 THEN lang END) AS lang, max(CASE WHEN r = 1 THEN share END) AS share, coalesce(string_agg(lang || ':' || round(share * 10000)::INT, '|' ORDER BY r) FILTER (WHERE r IN (2, 3)), '') AS others FROM f GROUP BY ALL),
  votes AS (SELECT {mine}, CASE WHEN ratio > 0.3 THEN '{DICTIONARY}' ELSE coalesce(lang, 'en') END AS found, CASE WHEN ratio > 0.3 THEN least(ratio * 1.5::DOUBLE, 1.0::DOUBLE) ELSE coalesce(share, 0.0)::DOUBLE END AS confidence,
    CASE WHEN ratio > 0.3 THEN 'dictionary' WHEN lang IS NOT NULL THEN 'statistical' ELSE 'fallback' END AS method, coalesce(others, '') AS alternatives FROM rated a LEFT JOIN best b ON {same})"""


_NAMED = """c AS (SELECT doc_id, found, count(*) AS n, min(line_no) AS seen FROM votes WHERE confidence >= 0.5 GROUP BY 1, 2),
  s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS r FROM c),
  d AS (SELECT doc_id, max(CASE WHEN r = 1 THEN found END) AS top, max(CASE WHEN r = 1 THEN n / total END) AS confidence, count(*) FILTER (WHERE n / total > 0.2) > 1 AS mixed, string_agg(found || ':' || n, '|' ORDER BY r) AS distribution FROM s GROUP BY 1),
  named AS (SELECT a.doc_id, coalesce(top, 'en') AS language, coalesce(confidence, 0.0)::DOUBLE AS confidence, coalesce(mixed, true) AS mixed, coalesce(distribution, '') AS distribution FROM (SELECT DISTINCT doc_id FROM votes) a LEFT JOIN d ON a.doc_id = d.doc_id)"""
_AUTO = f"""{LINES}, head AS (SELECT doc_id, line_no, text FROM lines WHERE line_no < {3 * PAGE} AND doc_id % 5 > 0), {_votes('doc_id, line_no', 'head')}, {_NAMED},
  auto AS (SELECT a.doc_id, CASE WHEN a.doc_id % 5 = 0 THEN lang ELSE coalesce(language, 'en') END AS language, CASE WHEN a.doc_id % 5 = 0 THEN 1.0 ELSE coalesce(confidence, 0.0) END::DOUBLE AS confidence,
    coalesce(mixed, false) AS mixed, coalesce(distribution, '') AS distribution, CASE WHEN a.doc_id % 5 = 0 THEN 'manual' ELSE 'auto' END AS chosen FROM documents a LEFT JOIN named n ON a.doc_id = n.doc_id)"""
_KEYS = "kind, id, line_no"
_PHRASES = f"""split AS (SELECT kind, id, unnest(l) AS text, generate_subscripts(l, 1)::INT - 1 AS line_no FROM (SELECT 'item' AS kind, item_id::BIGINT AS id, string_split(text, chr(10)) AS l FROM benchmark
    UNION ALL SELECT role, (conv_id * 1000 + turn)::BIGINT, string_split(text, chr(10)) FROM conversations)),
  phrases AS (SELECT kind, id, line_no, translate(CASE (id + line_no) % 4 WHEN 1 THEN '  ' || text || chr(8203) WHEN 2 THEN text || '?!' ELSE text END, '{INVISIBLE}', '') AS text, (id + line_no) % 4 <> 3 AS auto,
    CASE WHEN id % 2 = 0 THEN 'filipino' ELSE 'cebuano' END AS tgt_lang FROM split), heard AS (SELECT kind, id, line_no, CASE WHEN auto THEN text END AS text FROM phrases)"""
_ENGLISH = "CASE {0} WHEN 'en' THEN 'english' ELSE {0} END"
_PLACED = LINE_QUERIES.replace("queries AS (", "placed AS (", 1)

ORACLE_SQL = {
    "ngram_langid": f"WITH {_profiles('')}, said AS (SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> ''), {_scores('conv_id, turn', 'said')} SELECT conv_id, turn, lang, r AS rank, score FROM scored WHERE r <= 3",
    "detect_language": f"WITH {LINES}, {_votes('doc_id, line_no', 'lines')} SELECT * FROM votes",
    "doc_language": f"WITH {LINES}, {_votes('doc_id, line_no', 'lines')}, {_NAMED} SELECT * FROM named",
    "auto_source": f"WITH {_AUTO} SELECT * FROM auto",
    "translate_auto": f"""WITH {_AUTO}, {_PLACED}, {lookup(f"queries AS (SELECT q.doc_id, line_no, text, {_ENGLISH.format('language')} AS src_lang, tgt_lang FROM placed q JOIN auto a ON q.doc_id = a.doc_id)", 'doc_id, line_no')}
      SELECT * EXCLUDE (text) FROM found""",
    "quick_translate": f"""WITH {LINES}, {_PHRASES}, {_votes(_KEYS, 'heard')}, {lookup(f'''queries AS (SELECT a.kind, a.id, a.line_no, text, CASE WHEN auto THEN {_ENGLISH.format('found')} ELSE 'english' END AS src_lang, tgt_lang,
      CASE WHEN auto THEN confidence END AS detection_confidence FROM phrases a JOIN votes b ON a.kind = b.kind AND a.id = b.id AND a.line_no = b.line_no)''', f'{_KEYS}, detection_confidence')}
      SELECT {_KEYS}, text AS original, translated, src_lang AS source_language, tgt_lang AS target_language, detection_confidence, method, confidence, needs_review FROM found""",
}
