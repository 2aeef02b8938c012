"""Registered queries of plans, merges, quotas, statistical languages and file round trips, with their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyglossa.operators import pairs, retention
from polyglossa.plans import reports
from polyglossa.plans.review import PLACE
from polyglossa.plans.sql import BOOK, LINES, PAIRS, split_sql
from polyglossa.session import scratch_dir
from polyglossa.sources import files, views

AS_OF = reports.AS_OF


def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("job")
    own = F.concat(F.lit("/data/jobs/"), k)
    paths = F.array(F.concat(own, F.lit("/in.pdf")), F.when(k % 4 == 0, F.concat(own, F.lit("/../x"))).otherwise(F.lit("")), F.concat(own, F.lit("/in.pdf")), F.concat(F.lit("/srv/"), k), own)
    jobs = views.jobs(spark, sf_dir).withColumn("deleted_at", F.timestamp_add("DAY", F.lit(1), F.col("created"))).withColumn("paths", paths)
    return retention.purge_plan(jobs, "/data/jobs", AS_OF)


def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("job")
    name = F.when(k % 9 == 0, "..").when(k % 9 == 1, F.concat(F.lit("a:"), k)).when(k % 9 == 2, F.concat(F.lit("x/"), k)).otherwise(k.cast("string"))
    jobs = views.jobs(spark, sf_dir)
    active = jobs.filter(F.col("status").isin("queued", "processing", "retrying")).select(k.cast("string").alias("name"))
    return retention.cleanup_plan(jobs.select(name.alias("name"), F.col("updated").alias("modified")), active, AS_OF, 86_400 * 365)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*PLACE))
    return views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job"), place.alias("segment_index"), F.when(F.col("l_returnflag") != "N", 1 - F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_linestatus") == "O", "neural").otherwise("exact_phrase").alias("method"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("nth"),
    )


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("segment_index")
    page = F.when(i % 5 > 0, F.floor(i / 4) + 1)
    rows = _segments(spark, sf_dir).select("job", page.alias("page"), "segment_index", F.concat(F.lit("S"), "part").alias("source"), F.when(F.col("nth") % 3 == 0, " ").otherwise(F.concat(F.lit("T"), "part")).alias("translated"))
    orders = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    texts = orders.filter(k % 3 == 0).select(k.alias("job"), F.lit(1).cast("long").alias("page"), F.when(k % 2 == 0, " ").otherwise(F.col("o_orderpriority")).alias("text"))
    counters = F.create_map(F.lit("page_count"), (F.col("o_custkey") % 4).cast("string"), F.lit("total_pages"), F.lit("x"), F.lit("pages_processed"), (k % 3).cast("string"))
    return retention.page_pairs(texts, rows, orders.select(k.alias("job"), retention.declared_pages(counters).alias("n")))


def segment_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select("job", "segment_index", "method", "confidence")
    return retention.segment_sync(rows.withColumn("run", F.lit(1)), rows.filter("job % 3 = 0 and segment_index < 4").withColumn("run", F.lit(2)))


def gated_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    notes = F.concat(F.lit("phrase_sample|source_ids:"), k, F.lit(", "), k * 2 % 2500, F.lit(",x|confidence:"), F.when(k % 4 == 0, "low").otherwise(" High"))
    rows = views.table(spark, sf_dir, "part").select(k.alias("pos"), F.concat_ws(" ", "p_name", k % 20).alias("english"), F.when(k % 7 == 0, "x [UNKNOWN_FOR_REVIEW]").otherwise(F.col("p_brand")).alias("tagabawa"), notes.alias("notes"))
    return retention.gated_insert(views.phrasebook(spark, sf_dir), rows)


def upload_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts, with a day's gap."""
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return retention.upload_quota(views.table(spark, sf_dir, "events").select("user_id", "event_id", seconds.alias("seconds")), 3, 86_400)


def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = views.phrasebook(spark, sf_dir)
    return files.normalize_rows(book.select("id", "notes", F.col("english").alias("English Text"), F.when(F.col("id") % 2 == 0, F.col("english")).otherwise(" ").alias("english_source"), F.col("tagabawa").alias("BGS"), F.col("cebuano").alias("bisaya")))


def union_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_pos"), F.col("text").alias("english"))
    both = files.union_corpora(views.phrasebook(spark, sf_dir).withColumnRenamed("id", "row_pos"), marks)
    return both.groupBy("dataset_role", "source", F.col("row_pos.corpus").alias("corpus")).agg(F.count("*").alias("n"), F.min("row_pos.row").alias("first"), F.count("tagabawa").alias("n_tagabawa"))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(views.pairs(spark, sf_dir).select("record_id", "source_text", "target_text"), path)
    return files.read_jsonl(spark, path, "record_id string, source_text string, target_text string")


def export_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/splits-{uuid.uuid4().hex}"
    files.export_splits(pairs.hash_split(views.pairs(spark, sf_dir), "record_id"), path)
    schema = "record_id string, conv_id long, source_text string, target_text string, split string"
    whole = spark.read.schema(schema).json(f"{path}/all").select(F.lit("all").alias("part"), "record_id")
    each = spark.read.schema(schema).json(f"{path}/splits").select(F.col("split").alias("part"), "record_id")
    return whole.union(each).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_ids"))


def flatten_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as structures of pages of 20 with blocks of 5; the segments of each."""
    line = F.struct("line_no", F.when(F.col("line_no") % 7 == 0, " ").otherwise(F.col("text")).alias("source_text"), F.concat(F.lit("T:"), "text").alias("translated_text"), F.lit("m").alias("translation_method"), F.lit(0.5).alias("translation_confidence"))
    lines = views.lines(spark, sf_dir).groupBy("doc_id", F.floor(F.col("line_no") / 20).alias("page"), F.floor(F.col("line_no") / 5).alias("block")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    blocks = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("block", F.lit("text").alias("type"), "lines"))).alias("blocks"))
    pages = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", (F.col("page") + 1).alias("page_number"), "blocks"))).alias("pages"))
    made = files.flatten_structure(pages.select(F.col("doc_id").alias("job"), F.to_json(F.struct(F.lit("ocr_image").alias("extraction_method"), "pages")).alias("structure")))
    return made["segments"].withColumn("source", F.md5("source")).withColumn("translated", F.md5("translated"))


QUERIES = {
    f.__name__: f
    for f in (purge_plan, cleanup_plan, page_pairs, segment_sync, gated_insert, upload_quota, normalize_rows, union_corpora, jsonl_roundtrip, export_splits, flatten_structure)
}

_SEG = f"""seg AS (SELECT l_orderkey AS job, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}))::INT AS segment_index, CASE WHEN l_returnflag <> 'N' THEN 1 - l_discount END AS confidence,
  CASE WHEN l_linestatus = 'O' THEN 'neural' ELSE 'exact_phrase' END AS method, l_partkey AS part, l_linenumber AS nth FROM lineitem)"""

ORACLE_SQL = {
    "purge_plan": f"""WITH {reports.JOBS}, p AS (SELECT job, unnest(['/data/jobs/' || job || '/in.pdf', CASE WHEN job % 4 = 0 THEN '/data/jobs/' || job || '/../x' END, '/srv/' || job, '/data/jobs/' || job]) AS path FROM jobs
      WHERE is_deleted AND status NOT IN ('queued', 'processing') AND created + INTERVAL 1 DAY <= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) SELECT job, path, path LIKE '/data/jobs/%' AND path NOT LIKE '%/../%' AS safe FROM p WHERE path IS NOT NULL""",
    "cleanup_plan": f"""WITH {reports.JOBS}, l AS (SELECT CASE job % 9 WHEN 0 THEN '..' WHEN 1 THEN 'a:' || job WHEN 2 THEN 'x/' || job ELSE job::VARCHAR END AS name, updated AS modified, job, status FROM jobs)
      SELECT name, modified, CASE WHEN name IN (SELECT job::VARCHAR FROM jobs WHERE status IN ('queued', 'processing', 'retrying')) THEN 'skipped_active' WHEN job % 9 < 3 THEN 'unsafe' WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(modified) < 86400 * 365 THEN 'skipped_recent' ELSE 'removable' END AS plan FROM l""",
    "page_pairs": f"""WITH {_SEG}, s AS (SELECT job, CASE WHEN segment_index % 5 > 0 THEN segment_index // 4 + 1 ELSE 1 END AS page, string_agg('S' || part, chr(10) ORDER BY segment_index) AS sources, coalesce(string_agg('T' || part, chr(10) ORDER BY segment_index) FILTER (WHERE nth % 3 > 0), '') AS target FROM seg GROUP BY 1, 2),
      t AS (SELECT o_orderkey AS job, 1 AS page, CASE WHEN o_orderkey % 2 = 1 THEN trim(o_orderpriority) END AS text FROM orders WHERE o_orderkey % 3 = 0), d AS (SELECT o_orderkey AS job, unnest(range(1, greatest(o_custkey % 4, o_orderkey % 3) + 1)) AS page FROM orders),
      e AS (SELECT job, page FROM t UNION SELECT job, page FROM s UNION SELECT job, page FROM d)
      SELECT job, page::BIGINT AS page, coalesce(text, sources, '') AS source, coalesce(target, '') AS target FROM e LEFT JOIN (SELECT job, page, min(text) AS text FROM t GROUP BY 1, 2) t USING (job, page) LEFT JOIN s USING (job, page)""",
    "segment_sync": f"WITH {_SEG} SELECT job, segment_index, method, CASE WHEN job % 3 = 0 AND method = 'neural' THEN NULL ELSE confidence END AS confidence, CASE WHEN job % 3 = 0 THEN 2 ELSE 1 END AS run FROM seg WHERE job % 3 <> 0 OR segment_index < 4",
    "gated_insert": f"""WITH {BOOK}, c AS (SELECT p_partkey AS pos, lower(trim(p_name || ' ' || p_partkey % 20)) AS key, p_partkey % 7 = 0 AS unknown, p_partkey % 4 = 0 AS low, lower(trim(p_name || ' ' || p_partkey % 20)) IN (SELECT lower(trim(english)) FROM book) AS known, p_partkey * 2 % 2500 IN (SELECT id FROM book) AS ok FROM part),
      f AS (SELECT *, min(pos) FILTER (WHERE ok AND NOT unknown AND NOT low AND NOT known) OVER (PARTITION BY key) AS first FROM c),
      o AS (SELECT pos, CASE WHEN unknown THEN 'unknown_marker' WHEN low THEN 'low_confidence' WHEN known OR pos > first THEN 'duplicate' WHEN NOT ok THEN 'missing_source' ELSE 'accepted' END AS outcome FROM f)
      SELECT pos, outcome, CASE WHEN outcome = 'accepted' THEN (SELECT max(id) FROM book) + row_number() OVER (PARTITION BY outcome ORDER BY pos) END AS new_id FROM o""",
    "upload_quota": """WITH RECURSIVE e AS (SELECT user_id, event_id, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000)::DOUBLE AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000, event_id) AS k FROM events WHERE user_id IS NOT NULL),
      q AS (SELECT user_id, event_id, seconds, k, true AS admitted, 1 AS n, seconds + 86400 AS until FROM e WHERE k = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.seconds, e.k, e.seconds >= q.until OR q.n < 3, CASE WHEN e.seconds >= q.until THEN 1 WHEN q.n < 3 THEN q.n + 1 ELSE q.n END, CASE WHEN e.seconds >= q.until OR q.n < 3 THEN e.seconds + 86400 ELSE q.until END FROM q JOIN e ON e.user_id = q.user_id AND e.k = q.k + 1)
      SELECT user_id, event_id, seconds, admitted FROM q""",
    "normalize_rows": f"WITH {BOOK} SELECT id, notes, trim(english) AS english_source, trim(tagabawa) AS tagabawa_source, '' AS filipino_source, trim(cebuano) AS cebuano_source FROM book WHERE trim(english) <> '' OR trim(tagabawa) <> '' OR trim(cebuano) <> ''",
    "union_corpora": f"WITH {BOOK} SELECT 'primary' AS dataset_role, source, 0 AS corpus, count(*) AS n, min(id) AS first, count(tagabawa) AS n_tagabawa FROM book GROUP BY 1, 2, 3 UNION ALL SELECT 'secondary', 'text_corpus', 1, count(*), min(item_id), 0 FROM benchmark",
    "jsonl_roundtrip": f"WITH {PAIRS} SELECT record_id, source_text, target_text FROM pairs",
    "export_splits": f"WITH {PAIRS}, s AS (SELECT record_id, {split_sql('record_id')} AS split FROM pairs) SELECT 'all' AS part, count(*) AS n, count(DISTINCT record_id) AS n_ids FROM s UNION ALL SELECT split, count(*), count(DISTINCT record_id) FROM s GROUP BY 1",
    "flatten_structure": f"WITH {LINES} SELECT doc_id AS job, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS segment_index, line_no // 20 + 1 AS page, md5(trim(text)) AS source, md5('T:' || text) AS translated, 'm' AS method, 0.5::DOUBLE AS confidence FROM lines WHERE line_no % 7 <> 0",
}
