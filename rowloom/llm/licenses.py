"""License scans by diagonal voting of word grams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import cut
from rowloom.llm.grams import gram_places, grams, words_around

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Phrases of common public licenses and notices, and the label that a span like them gets.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("epl", "made available under the terms of the eclipse public license 2 0"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]

GRAM = 3
#: Diagonals this near, with votes this near in the text, are one span: words were put in or left out.
SHIFT = 4
#: Share of a template's grams that a span needs.
MIN_SHARE = 0.6


def template_grams(spark: SparkSession, templates=tuple(TEMPLATES), base=tuple(BASE.items()), gram: int = GRAM) -> DataFrame:
    """(template, label, exact, n, of, tpos, size, h, text): every gram of every template, with its place.

    Templates shorter than ``gram`` words have one gram, all of their words. The table is fixed by the code."""
    rows = [(i, label, text, exact) for i, (label, text, exact) in enumerate([*((b, a, True) for a, b in base), *((a, b, False) for a, b in templates)])]
    df = spark.createDataFrame(rows, "template int, label string, text string, exact boolean")
    df = df.withColumn("words", F.split("text", " ")).withColumn("n", F.size("words"))
    parts = [
        df.where(F.least("n", F.lit(gram)) == s).select(
            "template", "label", "exact", "n", "words", F.lit(s).alias("size"), (F.col("n") - s + 1).alias("of"), F.posexplode(grams(F.col("words"), s)).alias("tpos", "h")
        )
        for s in sorted({min(gram, len(text.split())) for _, _, text, _ in rows})
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("text", F.array_join("words", " ")).drop("words")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (id, key, n_words), and for each distinct text the spans found in it:
    (key, template, label, exact, first, last, share), where first and last are words and share is the part of the
    template's words that the span has in order (1 for base phrases, which must stand whole)."""
    table = cut(template_grams(docs.sparkSession), "templates")
    wanted = table.select("h").distinct()
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())
    # broadcasts are of the templates' grams, a fixed table
    found = cut(gram_places(docs, id_col, text_col, F.broadcast(wanted), sizes), "found")
    rows = found.where("marks").select("id", "key", "n_words")
    votes = (
        found.where("h is not null")
        .select("key", "pos", "h", "size")
        .distinct()
        .join(F.broadcast(table.withColumnRenamed("size", "tsize")), "h")
        .where(F.col("size") == F.col("tsize"))
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
    )
    by_diagonal = votes.groupBy("key", "template", "label", "exact", "of", "size", "diagonal").agg(
        F.min("pos").alias("from"), F.max("pos").alias("to"), F.collect_set("tpos").alias("places")
    )
    base = (
        by_diagonal.where("exact")
        .where(F.size("places") == F.col("of"))
        .select("key", "template", "label", "exact", F.col("from").alias("first"), (F.col("to") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("share"))
    )
    # Neighbouring diagonals whose votes are near in the text are one alignment with words put in or left out.
    order = Window.partitionBy("key", "template").orderBy("from", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= SHIFT) & (
        F.col("from") - F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("size") + SHIFT
    )
    merged = (
        by_diagonal.where("not exact")
        .withColumn("new", F.when(near, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "template", "label", "exact", "of", "size", "span")
        .agg(F.min("from").alias("first"), F.max("to").alias("to"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("have"))
        .where(F.col("have") >= F.col("of") * MIN_SHARE)
        .select("key", "template", "label", "exact", "first", (F.col("to") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("share"))
    )
    return rows, _verified(docs, text_col, base.unionByName(merged), table)


@F.pandas_udf(T.DoubleType())
def _in_order(span: pd.Series, template: pd.Series) -> pd.Series:
    """The share of a template's words that a span has in order."""

    def share(a: list[str], b: list[str]) -> float:
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1] / len(b)

    return pd.Series([share(a.split(" "), b.split(" ")) for a, b in zip(span, template, strict=True)], dtype="float64")


def _verified(docs: DataFrame, text_col: str, found: DataFrame, table: DataFrame) -> DataFrame:
    """The spans whose words, read in the texts, are a template's: all of them for base phrases, else MIN_SHARE of them
    in order. ``share`` becomes that share."""
    spans = F.collect_set(F.struct("template", "first", "last"))
    by_text = cut(found.groupBy("key").agg(spans.alias("spans")), "candidates")

    def read(words: Column) -> Column:
        return F.transform(
            "spans",
            lambda s: F.struct(
                s["template"].alias("template"),
                s["first"].alias("first"),
                s["last"].alias("last"),
                F.array_join(F.slice(words, s["first"] + 1, s["last"] - s["first"] + 1), " ").alias("words"),
            ),
        )

    texts = table.groupBy("template", "label", "exact").agg(F.first("text").alias("text"))  # a row for each template
    read_spans = words_around(docs, text_col, by_text, read, "read").select("key", F.inline("read"))
    judged = read_spans.join(F.broadcast(texts), "template").withColumn("share", _in_order("words", "text"))
    same = F.when(F.col("exact"), F.col("words") == F.col("text")).otherwise(F.col("share") >= MIN_SHARE)
    return judged.where(same).select("key", "template", "label", "exact", "first", "last", "share")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    All rolling word grams of all texts are joined to the templates' grams; each match votes for a diagonal, the offset
    between text and template. A base phrase is a diagonal on which all of its grams are matched. For the other
    templates, neighbouring diagonals merge, and a span needs MIN_SHARE of the template's grams. Spans are then
    verified in the texts: base phrases word for word, others by the share of the template's words that they have in
    order. ``score`` is the best share of any span, 0 without one. Labels are distinct, sorted and comma-joined.

    Null and empty texts have no words. Texts are scanned whole; a text's spans are found once for all copies; null
    ids and repeated rows stay rows; an empty table gives an empty table; other columns are ignored."""
    rows, found = spans(docs, id_col, text_col)
    base_first, exact = F.when(F.col("exact"), F.col("first")), F.col("exact")
    by_text = cut(
        found.groupBy("key").agg(
            F.count_if(exact).alias("n_base"),
            F.min(base_first).alias("first_word"),
            F.max(base_first).alias("last_word"),
            F.sort_array(F.collect_set(F.when(exact, F.col("label")))).alias("base_labels"),
            F.sort_array(F.collect_set("label")).alias("labels"),
            F.max("share").alias("score"),
        ),
        "spans",
    ).withColumnRenamed("key", "span_key")
    return rows.join(by_text, F.col("key") == F.col("span_key"), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
