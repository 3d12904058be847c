from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import quality
from rowloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    df, names = quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in df.where(names["kept"]).collect()}
    kept = [(d, t) for d, t in rows if d in {r.doc_id for r in good.collect()}]
    one = corpus_pipeline.near_dedup(spark, good, SF).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute.groups(kept)})
    kept = [(r.doc_id, r.text) for r in one.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontaminated(spark, one, SF).cache()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in brute.contamination(kept, items) if not r[5])
    mixed = corpus_pipeline.mix_sources(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and mixed.exceptAll(clean).intersect(mixed).exceptAll(mixed.distinct()).count() == 0
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    out = corpus_pipeline.byte_shards(spark, mixed, SF)
    assert out.count() == mixed.count()


def test_run(spark):
    a, b = (corpus_pipeline.run(spark, SF) for _ in range(2))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and corpus_pipeline.ORACLE_SQL is None


ODD = ["out_id", "out_key", "gone_key", "id", "key", "text_key", "clean_key", "clean_gone", "simhash_key", "simhash_gone_id", "mix_n", "mix_id", "mix_key", "mix_place",
       "range_part", "range_part_rows", "rank", "before", "size", "q_kept", "q_stays", "fp", "root", "window", "a.b", "n", "u", "v", "words", "shard", "first_id"]


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(ODD):
        docs = docs.withColumn(c, F.lit(i if i % 2 else f"x{i}"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], i % 2, 0) for i, r in enumerate(rows[:40])] + ([(None, 1, 0), (2, None, None)] if rows else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "a benchmark item " * 9), (None, None), (2, "")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, None, None), (None, "http://a.net/x", "<p>"), (2, "", "")] if rows else []
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("a.b", F.lit(1)).write.parquet(f"{folder}/pages.parquet")


def test_odd_tables(spark, tmp_path):
    rows = [(i, " ".join(f"word{(i * 31 + j * 7) % 900}" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(None, rows[3][1], None, None, None), (None, None, None, None, None), (5, rows[7][1], "en", "s1", 1), rows[9], rows[9], rows[9]]
    rows += [(70, "", "en", "s0", 0), (71, " \n", "en", None, 2), (72, "a benchmark item " * 12 + rows[0][1], "en", "s0", 9), (73, "long " + " ".join(f"w{j}" for j in range(30000)), "en", "s2", 9)]
    odd_tables(spark, tmp_path, rows)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out
    assert docs.count() > 60 and docs.where("doc_id in (70, 71, 72)").count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 60
    for name, query in QUERIES.items():
        assert query(spark, sf).count() == (3 if name.startswith("op6") else len(rows)), name


def test_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_query_columns(spark):
    out = QUERIES["op5_byte_shards"](spark, SF)
    assert dict(out.dtypes)["grown_shard"] == "int" and out.where(F.col("grown_shard").isNotNull()).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
