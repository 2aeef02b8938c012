"""Files in and out, text expressions and lookups on hand-made cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from polyglossa.functions import text
from polyglossa.operators import metrics, pages, pairs, tm
from polyglossa.sources import files


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"meta": 1, "rows": [{"x": 1}], "data": r}, lambda r: {"entries": r}])
def test_phrasebook_json(spark, tmp_path, wrap):
    rows = [{"English": " hello ", "bgs": "madigár", "note": 1}, {"English": "", "bgs": " "}, {"English": None, "Tagalog": "x"}]
    (tmp_path / "p.json").write_text(json.dumps(wrap(rows)), encoding="utf-8")
    got = files.read_phrasebook_json(spark, str(tmp_path / "p.json")).collect()
    assert sorted((r.english_source, r.tagabawa_source) for r in got if r.english_source) == [("hello", "madigár")]
    assert len(got) == (2 if "Tagalog" in rows[2] else 1)


def test_phrasebook_json_without_rows(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"rows": [{"x": 1}]}')
    assert files.read_phrasebook_json(spark, str(tmp_path / "p.json")).count() == 0


def test_phrasebook_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('\ufeffid,Topic,English Text,BGS,junk\n1,t,"a ""q"", b",x,j\n2,,,,j\n3,u, c ,,j\n', encoding="utf-8")
    got = files.read_phrasebook_csv(spark, str(tmp_path / "p.csv"))
    assert [(r.id, r.english_source, r.tagabawa_source) for r in got.orderBy("id").collect()] == [("1", 'a "q", b', "x"), ("3", "c", "")] and "junk" not in got.columns
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    assert files.read_phrasebook_csv(spark, str(tmp_path / "q.csv")).count() == 0


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp1252", "latin-1"])
def test_legacy_csv(spark, tmp_path, encoding):
    mark = "\x81" if encoding == "latin-1" else ""
    (tmp_path / "p.csv").write_bytes(f'topic,tagabawa,english,notes\nt,ñam{mark},"two\nlines",n\n,,,\n,é,,\n'.encode(encoding))
    got = files.ingest_legacy_csv(spark, str(tmp_path / "p.csv")).orderBy("id").collect()
    assert [(r.id, r.tagabawa, r.english, r.source) for r in got] == [(1, "ñam" + mark, "two\nlines", "phrasebook"), (2, "é", "", "phrasebook")]


def test_pair_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("\ufeffrecord_id,bagobo_text\n001,NA\n2,\n", encoding="utf-8")
    assert sorted(map(tuple, files.load_pair_csv(spark, str(tmp_path / "p.csv"), ("record_id",)).collect())) == [("001", "NA"), ("2", "")]
    with pytest.raises(ValueError):
        files.load_pair_csv(spark, str(tmp_path / "p.csv"), ("english_text",))
    with pytest.raises(Exception):
        files.load_pair_csv(spark, str(tmp_path / "none.csv"), ())


def test_jsonl_and_report(spark, tmp_path):
    df = spark.createDataFrame([("1", "é|x", None)], "record_id string, source_text string, target_text string")
    files.write_jsonl(df, str(tmp_path / "j"))
    (tmp_path / "j" / "part-x.json").write_text("\n  \n")
    assert files.read_jsonl(spark, str(tmp_path / "j"), "record_id string, source_text string, target_text string").collect() == df.collect()
    assert files.write_report(df, "", "md").splitlines()[-1] == "| 1 | é\\|x |  |"
    files.write_report(df, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["source_text"] == "é|x"


def _docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    held = {"a.pdf": b"%PDF-1.4", "b.PDF": b"x", "c.docx": _docx(("Heading1", "Title"), ("Normal", ""), ("Normal", "Text")), "d.docx": b"PKx", "e.txt": "é".encode(), "f.txt": b"\xff\xfe", "g.png": b"\x89PNG\r\n\x1a\n", "h.exe": b"MZ", "j.jpg": b"no"}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    df = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r.reason for r in files.validate_files(df).collect()}
    assert got == {"a.pdf": None, "b.PDF": "not a PDF", "c.docx": None, "d.docx": "not a DOCX", "e.txt": None, "f.txt": "not UTF-8", "g.png": None, "h.exe": "unsupported type", "j.jpg": "not an image"}
    assert [(r.position, r.text, r.heading) for r in files.docx_paragraphs(df).orderBy("position").collect()] == [(0, "Title", True), (1, "", False), (2, "Text", False)]


def test_headers():
    got = [text.canonical_header(h) for h in ("English", " tagalog_text", "Bagobo-Tagabawa", "bagobo tagabawa text", "english_source", "visayan", "filipino text", "notes", None)]
    assert got == ["english_source", "filipino_source", "tagabawa_source", "tagabawa_source", "english_source", "cebuano_source", None, None, None]


def test_expressions(spark):
    df = spark.createDataFrame([("5", "x|confidence: High|source_ids:1, 2,y", "007"), ("a b/c", None, "-3"), (None, "confidence:low", "x")], "id string, notes string, n string").coalesce(1)
    got = df.select(text.record_id(F.lit("tagabawa"), F.lit("english"), F.col("id")).alias("r"), text.notes_value(F.col("notes"), "confidence").alias("c"), text.notes_ids(F.col("notes")).alias("i"), text.to_count(F.col("n")).alias("n"), text.to_float(F.col("n")).alias("f"), text.engine_label(F.col("id")).alias("e")).collect()
    assert [r.r for r in got][:2] == ["bgs-eng-0005", "bgs-eng-a-b-c"] and [(r.c or "").strip() for r in got] == ["High", "", "low"]
    assert [r.i for r in got] == [[1, 2], [], []] and [(r.n, r.f) for r in got] == [(7, 7.0), (0, -3.0), (0, None)] and got[0].e == "text_extraction"
    rows = spark.createDataFrame([(" ",), ("a [UNKNOWN_FOR_REVIEW]",), (None,), ("b",)], "t string").coalesce(1)
    assert [r[0] for r in rows.select(text.is_trainable(F.col("t"))).collect()] == [False, False, False, True]


def test_rates(spark):
    rows = spark.createDataFrame([("hello world", "hello there"), ("", "x"), (None, None), ("a b", "c d e f")], "r string, h string").coalesce(1)
    assert [r[0] for r in rows.select(metrics.wer(F.col("r"), F.col("h"))).collect()] == [0.5, 0.0, 0.0, 1.0]
    same = spark.createDataFrame([(1, "the cat sat on the mat.", "the cat sat on the mat."), (2, None, "")], "id long, hyp string, ref string")
    assert metrics.corpus_bleu(same).first()["bleu"] == 100.0 and metrics.corpus_chrf(same).first()["chrf"] == 100.0
    assert metrics.corpus_bleu(same.limit(0)).first()["bleu"] == 0.0 and metrics.corpus_chrf(same.limit(0)).first()["chrf"] == 0.0
    assert [r.chrf for r in metrics.sentence_chrf(same).orderBy("id").collect()] == [100.0, 0.0]


def test_lookup_directions(spark):
    memory = spark.createDataFrame([(1, "Good morning", "Madigár", ""), (2, "good morning!", "B", "C"), (3, None, "D", "E")], "row_pos long, english string, tagabawa string, cebuano string")
    index = tm.tm_index(memory, ("english", "tagabawa", "cebuano"))
    asked = [("GOOD MORNING", "english", "tagabawa"), ("good morning?", "english", "cebuano"), ("madigar", "tagabawa", "english"), ("d", "tagabawa", "english"), (" x ", "english", "english"), (" ", "english", "tagabawa"), (None, "a", "a"), ("good morning sir", "english", "tagabawa")]
    found = tm.tm_lookup(spark.createDataFrame(asked, "text string, src_lang string, tgt_lang string"), index)
    got = {(r.text, r.tgt_lang): (r.translated, r.method, r.confidence, r.needs_review) for r in found.collect()}
    assert got == {
        ("GOOD MORNING", "tagabawa"): ("Madigár", "exact_phrase", 1.0, False), ("good morning?", "cebuano"): ("C", "normalized_phrase", 1.0, False), ("madigar", "english"): ("Good morning", "exact_phrase", 1.0, False),
        ("d", "english"): ("d", "unknown_for_review", 0.0, True), (" x ", "english"): (" x ", "identity", 1.0, False), (" ", "tagabawa"): ("", "unknown_for_review", 0.0, True), (None, "a"): ("", "unknown_for_review", 0.0, True),
        ("good morning sir", "tagabawa"): ("good morning sir", "unknown_for_review", 0.0, True),
    }

    def translate(frames):
        for f in frames:
            yield f.assign(text=[None if "d" == t else t.upper() for t in f["text"]])

    back = {r.text: (r.translated, r.method, r.confidence, r.needs_review, r.warning) for r in tm.with_fallback(found, translate, "tagabawa", "english").collect()}
    assert back["d"] == ("d", "unknown_for_review", 0.0, True, None)
    more = {r.text: (r.translated, r.method, r.confidence, r.needs_review) for r in tm.with_fallback(found, translate, "english", "tagabawa").collect()}
    assert more["good morning sir"] == ("GOOD MORNING SIR", "fallback", None, True) and more["GOOD MORNING"][0] == "Madigár"


def test_suggestions(spark):
    memory = spark.createDataFrame([("good morning everyone", "A"), ("where is the market", "B")], "text string, target string")
    asked = spark.createDataFrame([("Good mornin everyone",), ("where is the marketplace now",), ("x",), (None,)], "text string")
    assert [(r.key, r.suggestion) for r in tm.tm_suggest(asked, memory).collect()] == [("good mornin everyone", "A")]


def test_boxes(spark):
    row = spark.range(1)
    box = lambda *v: F.array(*(F.lit(x) for x in v))
    clip = row.select(pages.clip_bbox(box(50.0, 60.0, 10.0, 900.0), F.lit(100.0), F.lit(200.0), 1.0).alias("a"), pages.clip_bbox(box(5.0, 5.0, 5.0), F.lit(9.0), F.lit(9.0)).alias("b"), pages.clip_bbox(box(200.0, 1.0, 300.0, 2.0), F.lit(100.0), F.lit(100.0)).alias("c")).first()
    assert tuple(clip.a) == (9.0, 59.0, 51.0, 200.0) and clip.b is None and clip.c is None


def test_splits_of_nothing(spark):
    assert pairs.hash_split(spark.createDataFrame([], "record_id string"), "record_id").count() == 0
