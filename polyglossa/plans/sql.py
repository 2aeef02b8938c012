"""Pieces of DuckDB SQL that several queries share: the views and the expressions on them."""

from __future__ import annotations

from polyglossa.functions.text import CODES, INVISIBLE, MARKED, PLAIN
from polyglossa.sources.views import DIRT, NOTES

SPACE = r"[ \t\r\n]+"
LINES = f"""lines AS (SELECT doc_id, i - 1 AS line_no, l AS text, lang FROM (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_replace(l, '{SPACE}', '', 'g') <> '')"""
CLASS = """CASE WHEN n = 0 THEN 'empty' WHEN n = 1 THEN 'single_word' WHEN n <= 6 THEN 'short_phrase' WHEN n > 50 THEN 'paragraph'
  WHEN s > 1 THEN 'multi_sentence' WHEN n <= 15 THEN 'short_sentence' ELSE 'long_sentence' END"""
SIZES = f"""len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda w: w <> '')) AS n,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '')) AS s"""


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


BOOK = f"""book AS (SELECT p_partkey AS id, CASE WHEN p_size % 13 = 0 THEN '' ELSE p_type END AS topic, p_name || ' ' || (p_size % 10) AS english, p_brand || ' ' || (p_size % 10) AS tagabawa,
  p_type || ' ' || p_name || ' ' || (p_size % 10) AS filipino, CASE WHEN p_size = 7 THEN '' ELSE p_brand || ' ' || p_name || ' ' || (p_size % 10) END AS cebuano,
  CASE WHEN p_size % 10 = 0 THEN 'phrase_sample' ELSE 'phrasebook' END AS source, ({_list(NOTES)})[p_size % 5 + 1] AS notes FROM part)"""
AUDITED = f"""{BOOK}, audited AS (SELECT id, topic, english, tagabawa, filipino, cebuano, source, notes FROM book UNION ALL SELECT id + 10000000, ' ' || topic || ' ', CASE WHEN id % 3 = 0 THEN english || ' <b>too' ELSE upper(english) END,
  lower(tagabawa) || chr(9), CASE WHEN id % 5 = 0 THEN filipino || chr(127) || chr(65533) ELSE filipino END, CASE WHEN cebuano <> '' THEN upper(cebuano) END, CASE WHEN id % 7 > 0 THEN source END, upper(notes) FROM book WHERE id % 4 = 0)"""
DIRTY = f"dirty AS (SELECT doc_id, text || ({_list(DIRT)})[doc_id % {len(DIRT)} + 1] AS text FROM documents)"
PAIRS = """turns AS (SELECT u.conv_id, u.turn, u.text AS source_text, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
  pairs AS (SELECT 'c-' || conv_id || '-' || turn || '-0' AS record_id, conv_id, source_text, answer AS target_text FROM turns UNION ALL
    SELECT 'c-' || conv_id || '-' || turn || '-1', conv_id, source_text, CASE conv_id % 7 WHEN 0 THEN answer WHEN 1 THEN '' WHEN 2 THEN source_text ELSE answer || chr(65533) END FROM turns WHERE conv_id % 7 < 4)"""


#: The phrasebook with some texts marked for review.
MARKS = "marked AS (SELECT * REPLACE (CASE WHEN id % 19 = 0 AND cebuano <> '' THEN '[UNKNOWN_FOR_REVIEW] ' || cebuano ELSE cebuano END AS cebuano) FROM book)"


def directed(langs: tuple[str, ...]) -> str:
    fit = "trim({0}) <> '' AND {0} NOT LIKE '%UNKNOWN_FOR_REVIEW%'"
    return " UNION ALL ".join(
        f"""SELECT format('{CODES[s]}-{CODES[t]}-{{:04d}}', id) AS record_id, id AS row_id, trim(topic) AS topic, source AS domain, trim(notes) AS notes, '{s}' AS source_lang, '{t}' AS target_lang,
          trim({s}) AS source_text, trim({t}) AS target_text FROM marked WHERE {fit.format(s)} AND {fit.format(t)}"""
        for s in langs for t in langs if s != t
    )


def flags_sql(c: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} LIKE '%{n}%' THEN '{n}' END" for n in ("auto-split", "manual check", "double check", "plural", "singular")) + ")"


def split_sql(key: str) -> str:
    bucket = f"CAST('0x' || substr(md5('42:' || {key}), 1, 6) AS INT) % 100"
    return f"CASE WHEN {bucket} < 80 THEN 'train' WHEN {bucket} < 90 THEN 'dev' ELSE 'test' END"


_RAW = f"lower(regexp_replace(translate(text, '{INVISIBLE}', ''), '^{SPACE}|{SPACE}$', '', 'g'))"
_NORM = rf"trim(regexp_replace(regexp_replace({_RAW}, '[^\p{{L}}\p{{N}}_ \t\r\n-]', '', 'g'), '{SPACE}', ' ', 'g'), ' ')"
_PLAIN = rf"regexp_replace(translate({{}}, '{MARKED}', '{PLAIN}'), '\p{{{{Mn}}}}', '', 'g')"


def forms(rows: str, keys: str) -> str:
    """Rows (with a column text) once for each distinct form of the text: keys, nth, variant."""
    return f"""(SELECT {keys}, min(nth) AS nth, variant FROM (SELECT {keys}, unnest([0, 1, 2]) AS nth, unnest([raw, norm, {_PLAIN.format('norm')}]) AS variant
      FROM (SELECT *, {_RAW} AS raw, {_NORM} AS norm FROM {rows})) WHERE variant <> '' GROUP BY {keys}, variant)"""


MEMORY = f"""memory AS (SELECT text, md5(text) AS row_pos, 'T:' || text AS filipino, CASE WHEN length(text) % 3 = 0 THEN '' ELSE 'C:' || text END AS cebuano FROM (
    SELECT DISTINCT text FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark UNION ALL SELECT text FROM lines WHERE lang = 'en') WHERE regexp_replace(text, '{SPACE}', '', 'g') <> '')),
  tmv AS (SELECT t.tgt_lang, variant, min_by(t.target, row_pos) AS target, min(row_pos) AS row_pos FROM {forms('memory', 'row_pos, filipino, cebuano')} m, LATERAL (VALUES ('filipino', filipino), ('cebuano', cebuano)) AS t(tgt_lang, target) WHERE trim(t.target) <> '' GROUP BY 1, 2)"""
QUERIES = f"""queries AS (SELECT doc_id, line_no, CASE (doc_id + line_no) % 4 WHEN 1 THEN '  ' || text || ' ' WHEN 2 THEN text || '!!' WHEN 3 THEN {_PLAIN.format('text')} ELSE text END AS text,
    CASE lang WHEN 'en' THEN 'english' ELSE lang END AS src_lang, CASE line_no % 5 WHEN 4 THEN 'english' WHEN 1 THEN 'cebuano' WHEN 3 THEN 'cebuano' ELSE 'filipino' END AS tgt_lang FROM lines)"""


def lookup(queries: str, keys: str) -> str:
    """Tables up to `found`: what tm_lookup gives for the table `queries` (keys, text, src_lang, tgt_lang) of English texts in the memory."""
    return f"""{queries},
  {MEMORY},
  asked AS (SELECT DISTINCT text, tgt_lang FROM queries WHERE src_lang = 'english' AND tgt_lang <> 'english'),
  ranked AS (SELECT p.text, p.tgt_lang, nth, target, row_number() OVER (PARTITION BY p.text, p.tgt_lang ORDER BY nth, row_pos) AS r FROM {forms('asked', 'text, tgt_lang')} p JOIN tmv USING (tgt_lang, variant)),
  found AS (SELECT {keys}, q.text, src_lang, q.tgt_lang, CASE WHEN src_lang = q.tgt_lang THEN q.text ELSE coalesce(target, regexp_replace(translate(q.text, '{INVISIBLE}', ''), '^{SPACE}|{SPACE}$', '', 'g')) END AS translated,
    CASE WHEN src_lang = q.tgt_lang THEN 'identity' WHEN target IS NULL THEN 'unknown_for_review' WHEN nth = 0 THEN 'exact_phrase' ELSE 'normalized_phrase' END AS method,
    CASE WHEN target IS NULL AND src_lang <> q.tgt_lang THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, target IS NULL AND src_lang <> q.tgt_lang AS needs_review
    FROM queries q LEFT JOIN (SELECT * FROM ranked WHERE r = 1) b ON q.text = b.text AND q.tgt_lang = b.tgt_lang AND src_lang = 'english')"""


LOOKUP = f"WITH {LINES}, {lookup(QUERIES, 'doc_id, line_no')}"
