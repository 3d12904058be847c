"""Ordered rows of two-language documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import lexicon as lx
from rowloom.functions import text as tx

WORDS_PER_ROW = 6
REPEAT_EVERY = 7
# A stand-in alphabet that turns Latin test text into the target script.
LATIN_LETTERS, TARGET_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ابپتثجچحخدذرزسشصضطظعغفقکگل"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores by ``key`` if its scan has fewer parts than there are cores: a small file is one part,
    and all work up to the first shuffle would be one task's. A large table's scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): each document's text in stretches of WORDS_PER_ROW words."""

    def cut_up(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(WORDS_PER_ROW)))
        return F.transform(starts, lambda at: F.array_join(F.slice(w, at, WORDS_PER_ROW), " "))

    words = F.array_remove(F.split(tx.normalized(F.col("text")), " "), "")
    return spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", tx.let(words, cut_up).alias("lines"))


def source_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, source_text): the rows of ``rows_of_documents`` without their targets, and so without a join."""
    # the outer generator keeps the optimizer from cutting up each text once more to see whether it is empty
    rows = _lines(docs).select("doc_id", F.posexplode_outer("lines").alias("idx", "source_text"))
    return rows.where("idx is not null")


def rows_of_documents(docs: DataFrame, target_script: bool = False) -> DataFrame:
    """(doc_id, idx, row_number, source_text, target_text) from ``documents``: row k of a document is its next six
    words, and its target is a row of the document after it, so that targets repeat in runs and can be missing.

    Documents are joined whole, before they're cut to rows: one shuffle of the texts on the document's id."""
    cut = _lines(docs)
    after = cut.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lines").alias("targets"))
    target = F.col("target")
    if target_script:
        target = F.translate(F.lower(target), LATIN_LETTERS, TARGET_LETTERS)

    def paired(line: Column, idx: Column) -> Column:
        at = idx - F.when(idx % REPEAT_EVERY == 1, 1).otherwise(0)
        return F.struct(line.alias("source_text"), F.coalesce(F.get("targets", at), F.lit("")).alias("target"))

    both = cut.join(after, "doc_id", "left").select("doc_id", F.transform("lines", paired).alias("pairs"))
    rows = both.select("doc_id", F.posexplode_outer("pairs").alias("idx", "pair")).where("idx is not null")
    return rows.select("doc_id", "idx", "pair.*").select("doc_id", "idx", (F.col("idx") + 1).alias("row_number"), "source_text", target.alias("target_text"))


def row_kind(idx: Column, start: Column, source: Column, target: Column) -> Column:
    """skip before the first subtitle row, then blank, locked, meta or subtitle; of normalized texts."""
    return (
        F.when(idx < start, "skip")
        .when((source == "") & (target == ""), "blank")
        .when(target == "", "locked")
        .when(tx.is_header(source, True) | tx.is_cue(source, True), "locked")
        .when(tx.is_meta(source, True), "meta")
        .otherwise("subtitle")
    )


def kinds(rows: DataFrame, doc: str = "doc_id", script: str = lx.TARGET_SCRIPT) -> DataFrame:
    """``rows`` with ``row_type``, ``kind`` and ``ends`` (whether the source ends a sentence).

    A document's subtitles start at its first row with target script and a source, or at its first row if there is
    none."""
    s, t = F.col("clean_source"), F.col("clean_target")
    clean = rows.withColumns({"clean_source": tx.normalized(F.col("source_text")), "clean_target": tx.normalized(F.col("target_text"))})
    begins = t.rlike(script) & (s != "")
    start = F.coalesce(F.min(F.when(begins, F.col("idx"))).over(Window.partitionBy(doc)), F.lit(0))
    return clean.withColumn("start_idx", start).select(
        *[F.col(c) for c in rows.columns],
        tx.row_type(s, True).alias("row_type"),
        row_kind(F.col("idx"), F.col("start_idx"), s, t).alias("kind"),
        tx.ends_sentence(s, True).alias("ends"),
    )
