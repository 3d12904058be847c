"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import alnum_words, col, cut, fresh, shuffled, small, text_key, text_or_empty
from rowloom.llm.grams import gram_counts, gram_places, grams, words_around

WINDOW = 13
SHINGLE = 5
#: A document is contaminated if SHARE times its hit words reach its words.
SHARE = 20


def benchmark_windows(bench: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(window, n, items): the distinct windows of all items, with the ids (as strings) of the items that have them.

    An item of fewer words than ``window`` is one window; an item without words has none. Items with equal ids are
    one; null ids aren't listed, but their windows count."""
    items = bench.select(col(item_id).cast("string").alias("item"), alnum_words(text_or_empty(item_text)).alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    at = items.where(F.size("words") > 0).select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return (
        at.select("item", F.slice("words", F.col("at") + 1, window).alias("w"))
        .groupBy(F.array_join("w", " ").alias("window"))
        .agg(F.first(F.size("w")).alias("n"), F.collect_set("item").alias("items"))
    )


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (from, to) spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["to"] - F.greatest(s["from"], a["end"]), F.lit(0))).cast("bigint").alias("n"),
            F.greatest(a["end"], s["to"].cast("bigint")).alias("end"),
        ),
        lambda a: a["n"],
    )


def _matched(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (id, key, n_words), and for each text with an occurring window (key, n_hit, items)."""
    windows = cut(benchmark_windows(bench, item_id, item_text, window), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect()) or [shingle]
    shingles = None
    for s in sizes:  # at most `shingle` sizes; items of fewer words than a shingle are shingles themselves
        part = windows.where(F.least("n", F.lit(shingle)) == s).select(
            "window", "n", F.lit(s).alias("size"), F.posexplode(grams(F.split("window", " "), s)).alias("off", "h")
        )
        shingles = part if shingles is None else shingles.unionByName(part)
    shingles = cut(shingles, "shingles")
    wanted = cut(shingles.select("h").distinct(), "wanted")
    # Rarity over all documents. A window needs all of its shingles, so its prefix is one token: the rarest. A window
    # with a shingle that no document has can't occur at all.
    counts = gram_counts(docs, text_col, small(wanted), sizes)
    prefix = (
        small(shingles).join(shuffled(counts), "h")
        .groupBy("window", "n", "size")
        .agg(F.count("*").alias("had"), F.min(F.struct("times", "off", "h")).alias("rarest"))
        .where(F.col("had") == F.col("n") - F.col("size") + 1)
        .select("window", "n", F.col("size").alias("token_size"), "rarest.off", F.col("rarest.h").alias("h"))
    )
    prefix = cut(prefix, "prefix")
    tokens = cut(prefix.select("h").distinct(), "tokens")
    found = cut(gram_places(docs, id_col, text_col, small(tokens), sizes), "found")
    rows = found.where("marks").select("id", "key", "n_words")
    start = F.col("pos") - F.col("off")
    candidates = (
        found.where("h is not null")
        .join(small(prefix), "h")
        .where((F.col("size") == F.col("token_size")) & (start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .groupBy("key")
        .agg(F.collect_set(F.struct(start.alias("from"), F.col("n").alias("n"), F.col("window").alias("window"))).alias("candidates"))
    )

    def verified(words: Column) -> Column:
        same = F.filter("candidates", lambda c: F.array_join(F.slice(words, c["from"] + 1, c["n"]), " ") == c["window"])
        return F.transform(same, lambda c: F.struct(c["from"].alias("from"), (c["from"] + c["n"]).alias("to"), c["window"].alias("window")))

    hits = words_around(docs, text_col, cut(candidates, "candidates"), verified, "hits")
    places = cut(hits.select("key", F.inline("hits")), "places")
    spans = places.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))
    items = (
        places.select("key", "window")
        .distinct()
        .join(small(windows.select("window", "items")), "window")
        .select("key", F.explode_outer("items").alias("item"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return rows, spans.join(shuffled(items), "key").select("key", _covered(F.col("spans")).alias("n_hit"), "items")


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for each row of ``docs``.

    Words are ASCII letters and digits, A-Z lower-cased, and all that isn't ASCII. A window is ``window`` successive
    words of an item; a document's word is hit inside any occurrence of a window. ``items`` lists the ids of items
    with occurring windows, sorted as strings.

    A window, as a set of word shingles, must be contained whole: the prefix that a containment join has to index is
    its rarest shingle by the counts over all documents. Only these tokens are joined to the documents' shingles.
    Candidates share a token, must have room for the window around it, and are verified word for word over the
    window's length, in the texts that have candidates.

    Null and empty texts have no words; null ids are kept as rows; repeated rows give repeated rows; empty documents or
    benchmarks give no hits. A text's result is computed once for all copies. Other columns are ignored."""
    rows, hits = _matched(docs, bench, id_col, text_col, item_id, item_text, window, shingle)
    hits = cut(hits, "hits").withColumnRenamed("key", "hit_key")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.join(small(hits), F.col("key") == F.col("hit_key"), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with all columns of ``docs``."""
    rows, hits = _matched(docs, bench, id_col, text_col, item_id, item_text, WINDOW, SHINGLE)
    words = rows.groupBy("key").agg(F.min("n_words").alias("n_words"))
    gone, key = fresh(docs, "clean_gone"), fresh(docs, "clean_key")
    goes = cut(
        hits.join(shuffled(words), "key").where((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).select(F.col("key").alias(gone)),
        "contaminated",
    )
    return (
        docs.withColumn(key, text_key(text_or_empty(text_col)))
        .join(small(goes), F.col(key) == F.col(gone), "left_anti")
        .select(*[col(c) for c in docs.columns])
    )
