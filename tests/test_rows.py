from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from rowloom.functions import lexicon as lx
from rowloom.functions import text as tx
from rowloom.operators import groups as gr
from rowloom.operators import profile as pf
from rowloom.operators import rows as rw
from rowloom.operators import summary as sm
from rowloom.plans import apply as ap
from rowloom.plans.planner import Options
from rowloom.sources import docx, profiles

SCHEMA = "doc_id long, idx int, row_number int, source_text string, target_text string"


def grouped(spark, pairs):
    rows = spark.createDataFrame([(1, i, i + 1, s, t) for i, (s, t) in enumerate(pairs)], SCHEMA)
    return gr.sentence_groups(rw.kinds(rows))


def of(spark, pairs):
    return [(r.kind, r.n_rows) for r in gr.group_table(grouped(spark, pairs)).orderBy("group_id").collect()]


def test_headers_subtitles_and_blanks(spark):
    pairs = [("YOUR LANGUAGE:", ""), ("Walking up the old stone road", "وقتی از راه سنگی"), ("above the harbour.", "بالای بندر می‌روید"), ("", None)]
    assert of(spark, pairs) == [("skip", 1), ("subtitle", 2), ("blank", 1)]


def test_sources_and_missing_targets_part_groups(spark):
    assert of(spark, [("A plain line opens", "شروع"), ("(Harbour Daily)", "(روزنامه)"), ("It goes on.", "ادامه")]) == [("subtitle", 1), ("meta", 1), ("subtitle", 1)]
    assert of(spark, [("Nobody was left in the hall.", "هیچ‌کس"), ("L12-40", "")]) == [("subtitle", 1), ("locked", 1)]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("She may leave", "date"), ("dismay2", "normal"), ("1999", "date"), ("x1999", "normal"), ("NEWS", "source"), ("ALL THE GREAT NEWS TODAY", "title"), ("Daily news now", "title"), ("www.x.org", "source"), (None, "normal")],
)
def test_row_types(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.row_type(F.col("t"))).first()[0] == kind
    from rowloom.plans.planner import row_type

    assert row_type(text) == kind


def test_limits_from_quantiles(spark):
    rows = [("normal", c, w) for c, w in zip([28, 31, 35, 42, 47, 49], [5, 6, 7, 8, 9, 10], strict=True)]
    lines = spark.createDataFrame(rows, "row_type string, chars int, words int")
    r = pf.limits(pf.line_statistics(lines, [], ["row_type"]), ["row_type"]).where("row_type is null").first()
    assert (r.preferred_char_min, r.preferred_char_target, r.preferred_char_max, r.soft_char_max, r.hard_char_max, r.preferred_word_max) == (32, 39, 48, 49, 51, 10)


def test_repeat_metrics(spark):
    runs = spark.createDataFrame([(1, False)] * 70 + [(2, False)] * 30, "run_length long, title_date boolean")
    r = pf.repeat_metrics(runs).first()
    assert r.rate_2 == 0.3 and not r.allow_triple


def test_learned_counts_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    g = gr.sentence_groups(rw.kinds(rw.rows_of_documents(docs)))
    table = {r.row_type: r.line_count for r in pf.line_statistics(pf.lines(g), [], ["row_type"]).collect()}
    assert table.pop(None) == sum(table.values())
    runs = pf.runs(g)
    assert runs.agg(F.sum("run_length")).first()[0] == pf.lines(g).count()


def test_plans_keep_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 20")
    g = gr.sentence_groups(rw.kinds(rw.rows_of_documents(docs, True)))
    planned = ap.plan_groups(g, Options()).cache()
    assert planned.where(F.size("rows") != F.col("n_rows")).count() == 0
    assert planned.select(F.sum("n_rows")).first()[0] == g.where("kind = 'subtitle'").count()
    assert ap.flattened(g, planned).count() == g.count()


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def word_file(rows):
    def cell(text, gray=False):
        mark = '<w:rPr><w:highlight w:val="lightGray"/></w:rPr>' if gray else "<w:rPr><w:b/></w:rPr>"
        return f"<w:tc><w:tcPr/><w:p><w:pPr/><w:r>{mark}<w:t>{text}</w:t></w:r></w:p></w:tc>"

    body = "".join("<w:tr>" + "".join(cell(c, c == "gray") for c in r) + "</w:tr>" for r in rows)
    xml = f'<w:document xmlns:w="{W}"><w:body><w:tbl><w:tr>{cell("a")}</w:tr></w:tbl><w:tbl>{body}</w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(docx.PART, xml)
        z.writestr("other.txt", "kept")
    return out.getvalue()


def test_word_files_round_trip(spark, tmp_path):
    rows = [("0", "One  two", "یک"), ("merged", "row"), ("1", "gray", "دو")]
    (tmp_path / "A.DOCX").write_bytes(word_file(rows))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    files = docx.list_files(spark, str(tmp_path))
    found = docx.scan(files).orderBy("path", "idx").collect()
    good = [r for r in found if r.error is None]
    assert [(r.idx, r.row_number, r.source_text, r.target_text, r.has_gray) for r in good] == [(0, 1, "One two", "یک", False), (1, 3, "gray", "دو", True)]
    assert len(found) == 3
    new = docx.rewritten(files, spark.createDataFrame([(good[0].path, 3, " سه")], "path string, row_number int, new_text string"))
    content = bytes(new.first().content)
    assert [r["target_text"] for r in docx.parse(content)] == ["یک", "سه"]
    data = zipfile.ZipFile(io.BytesIO(content))
    assert data.read("other.txt") == b"kept" and b"preserve" in data.read(docx.PART) and b"lightGray" not in data.read(docx.PART).split(b"preserve")[1]


def test_files_and_reports_are_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.docx", "b.docx"):
        (tmp_path / "in" / name).write_bytes(word_file([("0", "One", "یک"), ("1", "two.", "دو")]))
    files = docx.list_files(spark, str(tmp_path / "in"))
    texts = docx.scan(files).select("path", "row_number", F.lit("نو").alias("new_text"))
    for _ in range(2):  # a task may run again
        done = docx.write_files(docx.rewritten(files, texts), str(tmp_path / "out")).collect()
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["a.docx", "b.docx"] and all(r["size"] > 0 for r in done)
    assert [r["target_text"] for r in docx.parse((tmp_path / "out" / "a.docx").read_bytes())] == ["نو", "نو"]
    g = grouped(spark, [("One", "یک"), ("two.", "دو")])
    sm.write_reports(sm.report_rows(ap.plan_groups(g, Options()), g), str(tmp_path / "reports"))
    report = spark.read.json(str(tmp_path / "reports")).first()
    assert report.rowRange == "1-2" and report.originalRows == ["یک", "دو"] and report.doc_id == 1


def test_files_of_a_corpus(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    named = spark.createDataFrame([("b",), ("b",), ("gone",)], "path string")
    assert [r.path for r in docx.corpus_files(found, named).collect()] == ["b"]
    assert docx.corpus_files(found, named.limit(0)).count() == 3


def test_nobody_to_ask(spark):
    g = grouped(spark, [("One", "یک"), ("two.", "دو")])
    out = ap.review_groups(g, None, Options())
    asked = ap.review_groups(g, spark.createDataFrame([], "doc_id long, row_range string, ordinal int, decision struct<selected:int>").limit(0), Options())
    assert set(out.columns) == set(asked.columns) and not out.first().attempted and out.first().rows


def test_heads_and_freshness(spark):
    assert spark.range(1).select(F.size(tx.head(F.sequence(F.lit(1), F.lit(30)), lx.SHOWN_FLAGGED))).first()[0] == 20
    files = spark.createDataFrame([("a", 5), ("b", 9)], "path string, modificationTime long")
    assert profiles.is_fresh(files, 9) and not profiles.is_fresh(files, 8) and profiles.is_fresh(files.limit(0), 0)


def test_profiles_are_stored_and_read(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    g = gr.sentence_groups(rw.kinds(rw.rows_of_documents(docs)))
    learned = pf.style_profile(g)
    profiles.write_profile(learned, str(tmp_path / "p"))
    back = profiles.read_profiles(spark, str(tmp_path / "p"))
    r = back.first()
    assert r.profileId == "default" and r.constraints.overall.lineCount > 0 and set(r.repeat.rates) == {"1", "2", "3", "4"}
    assert profiles.learning_summary(back).first().enabled
    files = spark.createDataFrame([("/x/NWN 1.docx",), ("b.docx",)], "path string")
    assert profiles.routed(files, back).where("profile is null").count() == 0
    assert profiles.options_of(learned.first()).limits_of("normal")["hard_char_max"] >= 45


def test_dropped_files_are_planned(spark, tmp_path):
    from rowloom.streaming import filedrop

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(word_file([("0", "One", "یک"), ("1", "two.", "دو")]))
    q = filedrop.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_profile_of_nothing(spark):
    from rowloom.operators import profile as pf

    kind = "doc_id long, group_id int, idx int, row_type string, kind string, target_text string"
    none = pf.style_profile(spark.createDataFrame([], kind)).first()
    assert none["overall"] is None and none["by_row_type"] == {} and none["dataset_item_count"] == 0 and not none["allow_triple"]
    locked = [(1, 1, 0, "normal", "locked", ""), (1, 2, 1, "normal", "subtitle", None), (2, 1, 0, "title", "subtitle", "a b"), (2, 1, 1, "date", "subtitle", "a  b")]
    few = pf.style_profile(spark.createDataFrame(locked, kind)).first()
    assert (few["dataset_item_count"], few["subtitle_group_count"], few["subtitle_row_count"]) == (2, 2, 3)
    assert sorted(few["by_row_type"]) == ["date", "title"] and few["overall"]["line_count"] == 2
    assert (few["runs_1"], few["runs_2"], few["observed_pairs"], few["merge_rate"]) == (0, 1, 1, 1.0)


def test_review_counters_of_unknown_flags(spark, tmp_path):
    """A document whose only sentence is its third group: nothing is known of edits to it, and its SQL counts null."""
    import duckdb

    from rowloom.queries import ORACLES, QUERIES

    cue = "a b c d e f: "
    docs = [(1, cue * 2 + "she went to the harbour."), (2, "one two three four five six. " * 3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["review_counters"](spark, str(tmp_path))
    want = con.execute(ORACLES["review_counters"])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert want and want[0][names.index("edited_groups")] is None
    assert [tuple(r) for r in found.select(*names).collect()] == want
