"""Sentence groups: runs of subtitle rows up to the end of a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import text as tx


def by_document():
    return Window.partitionBy("doc_id").orderBy("idx")


def sentence_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (with kinds) and ``group_id``, 1, 2, ... in each document. Every row that isn't a subtitle is a group of
    its own; a subtitle group ends after a row whose source ends a sentence."""
    before = F.lag("kind").over(by_document())
    new = before.isNull() | (F.col("kind") != "subtitle") | (before != "subtitle") | F.lag("ends").over(by_document())
    return rows.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("group_id", F.sum("new").over(by_document()).cast("int")).drop("new")


def group_table(grouped: DataFrame) -> DataFrame:
    """A row for each group: (doc_id, group_id, kind, first_row, last_row, n_rows, row_range). Hashed as ``grouped`` is,
    so no shuffle is added."""
    return (
        grouped.groupBy("doc_id", "group_id")
        .agg(
            F.min("kind").alias("kind"),
            F.min("row_number").alias("first_row"),
            F.max("row_number").alias("last_row"),
            F.count("*").alias("n_rows"),
        )
        .withColumn("row_range", tx.row_range(F.col("first_row"), F.col("last_row")))
    )


def context(grouped: DataFrame) -> DataFrame:
    """(doc_id, group_id, previous_rows, next_rows): the last two rows of the group before a subtitle group and the
    first two of the group after it, where those are subtitle groups."""
    texts = grouped.groupBy("doc_id", "group_id").agg(
        F.min("kind").alias("kind"),
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "target_text"))), lambda x: x["target_text"]).alias("texts"),
    )
    order = Window.partitionBy("doc_id").orderBy("group_id")
    none = F.array().cast("array<string>")

    def near(column, kind):
        return F.coalesce(F.when(kind == "subtitle", column), none)

    tail = F.slice("texts", F.greatest(F.size("texts") - 1, F.lit(1)), 2)
    return (
        texts.withColumn("tail", tail)
        .withColumn("head", F.slice("texts", 1, 2))
        .select(
            "doc_id",
            "group_id",
            "kind",
            near(F.lag("tail").over(order), F.lag("kind").over(order)).alias("previous_rows"),
            near(F.lead("head").over(order), F.lead("kind").over(order)).alias("next_rows"),
        )
        .where("kind = 'subtitle'")
        .drop("kind")
    )
