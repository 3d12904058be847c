"""Style profiles: what a corpus teaches about lines, repeats and title rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import text as tx


def by_group():
    return Window.partitionBy("doc_id", "group_id").orderBy("idx")


def lines(grouped: DataFrame) -> DataFrame:
    """Non-empty target lines of subtitle groups, with their characters and words."""
    line = tx.target_spacing(F.col("target_text"))
    return (
        grouped.where("kind = 'subtitle'")
        .select("doc_id", "group_id", "idx", "row_type", line.alias("line"))
        .where("line <> ''")
        .select("doc_id", "group_id", "idx", "row_type", "line", F.length("line").alias("chars"), F.size(F.split("line", " ")).alias("words"))
    )


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


QUANTILES = (0.25, 0.5, 0.9, 0.95)


def _statistics() -> list[Column]:
    chars, words = (F.percentile(c, F.array(*[F.lit(q) for q in QUANTILES])) for c in ("chars", "words"))
    return [F.count("chars").alias("line_count"), chars.alias("c"), words.alias("w"), F.max("chars").alias("char_max"), F.max("words").alias("word_max")]


def line_statistics(of_lines: DataFrame, *levels: list[str]) -> DataFrame:
    """Exact quantiles of characters and words for each of ``levels``, in one pass over grouping sets."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    sets = [[F.col(k) for k in level] for level in levels]
    return of_lines.groupingSets(sets, *keys).agg(*_statistics())


def limits(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """Line limits from quantiles."""

    def least(low: int, c: Column) -> Column:
        return F.greatest(F.lit(low), _half_up(c))

    c, w = F.col("c"), F.col("w")
    char_max, word_max = F.col("char_max").cast("double"), F.col("word_max").cast("double")
    return statistics.select(
        *keys,
        "line_count",
        least(8, c[0]).alias("preferred_char_min"),
        least(12, c[1]).alias("preferred_char_target"),
        least(24, c[2]).alias("preferred_char_max"),
        least(30, c[3]).alias("soft_char_max"),
        F.least(F.lit(60), least(45, F.greatest(c[3] + 2, char_max))).alias("hard_char_max"),
        least(2, w[1]).alias("preferred_word_target"),
        least(4, w[2]).alias("preferred_word_max"),
        F.least(F.lit(16), least(9, F.greatest(w[2] + 1, word_max))).alias("hard_word_max"),
        F.col("char_max").alias("observed_char_max"),
        F.col("word_max").alias("observed_word_max"),
    )


def _run_marks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``new``, 1 where a run starts; ``run``, its number in the group; ``pair``, a title before a date."""
    new = F.lag("line").over(by_group()).isNull() | (F.lag("line").over(by_group()) != F.col("line"))
    pair = (F.col("row_type") == "title") & (F.lead("row_type").over(by_group()) == "date")
    return (
        rows.withColumn("new", F.when(new, 1).otherwise(0))
        .withColumn("pair", F.coalesce(pair, F.lit(False)))
        .withColumn("run", F.sum("new").over(by_group()))
    )


def runs(grouped: DataFrame) -> DataFrame:
    """A row for each run of equal target lines in a subtitle group: where it starts, its length, and whether a title
    row followed by a date row starts it. Blank lines break runs and start none."""
    line = tx.target_spacing(F.col("target_text"))
    return (
        _run_marks(grouped.where("kind = 'subtitle'").withColumn("line", line))
        .groupBy("doc_id", "group_id", "run")
        .agg(F.min("idx").alias("idx"), F.count("*").alias("run_length"), F.min_by("pair", "idx").alias("title_date"), F.min("line").alias("line"))
        .where("line <> ''")
        .drop("line", "run")
    )


def repeat_metrics(of_runs: DataFrame, *keys: str) -> DataFrame:
    """Run histogram (4 stands for 4 and more), rates, and whether a line may stand three times."""
    return _rates(of_runs.groupBy(*keys).agg(*_run_counts(F.lit(True))), *keys)


def _run_counts(counted: Column) -> list[Column]:
    size, titled = F.least("run_length", F.lit(4)), counted & F.col("title_date")
    return [
        *[F.count_if(counted & (size == n)).alias(f"runs_{n}") for n in range(1, 5)],
        F.count_if(titled).alias("observed_pairs"),
        F.count_if(titled & (F.col("run_length") >= 2)).alias("merged_pairs"),
    ]


def _rates(table: DataFrame, *keys: str) -> DataFrame:
    total = sum((F.col(f"runs_{n}") for n in range(2, 5)), F.col("runs_1"))

    def rate(c: Column, of: Column) -> Column:
        return F.when(of == 0, 0.0).otherwise(c / of)

    return table.select(
        *keys,
        *[f"runs_{n}" for n in range(1, 5)],
        *[rate(F.col(f"runs_{n}"), total).alias(f"rate_{n}") for n in range(1, 5)],
        ((rate(F.col("runs_3"), total) >= 0.04) | (F.col("runs_4") > 0)).alias("allow_triple"),
        "observed_pairs",
        "merged_pairs",
        rate(F.col("merged_pairs"), F.col("observed_pairs")).alias("merge_rate"),
    )


def style_profile(grouped: DataFrame, profile_id: str = "default") -> DataFrame:
    """The profile of all of ``grouped`` as one row with nested limits, by row type and overall.

    All of it comes from one aggregation: rows know by windows whether they start a document, a group or a run, and how
    long the run is, so nothing distinct is counted and ``grouped`` is made once. Without rows the counts are 0, the
    overall limits null and those by type empty."""
    subtitle = F.col("kind") == "subtitle"
    line = F.when(subtitle, tx.target_spacing(F.col("target_text")))
    rows = _run_marks(grouped.select("doc_id", "group_id", "idx", "row_type", "kind", line.alias("line")))
    rows = rows.withColumn("place", F.row_number().over(by_group())).withColumn("run_length", F.count("*").over(Window.partitionBy("doc_id", "group_id", "run")))
    said = F.col("line") != ""
    table = (
        rows.withColumn("chars", F.when(said, F.length("line")))
        .withColumn("words", F.when(said, F.size(F.split("line", " "))))
        .withColumn("title_date", F.col("pair"))
        .groupingSets([[], [F.col("row_type")]], "row_type")
        .agg(
            *_statistics(),
            *_run_counts(said & (F.col("new") == 1)),
            F.count_if(subtitle & (F.col("place") == 1)).alias("subtitle_group_count"),
            F.count_if(subtitle).alias("subtitle_row_count"),
            F.count_if((F.col("group_id") == 1) & (F.col("place") == 1)).alias("dataset_item_count"),
        )
    )
    counts = ["subtitle_group_count", "subtitle_row_count", "dataset_item_count"]
    counted = [*[f"runs_{n}" for n in range(1, 5)], "observed_pairs", "merged_pairs", *counts]
    table = limits(table, ["row_type", *counted])
    names = [c for c in table.columns if c not in ("row_type", *counted)]
    overall, known = F.col("row_type").isNull(), F.col("line_count") > 0
    entries = F.collect_list(F.when(~overall & known, F.struct("row_type", F.struct(*names))))
    one = table.agg(
        F.max(F.when(overall & known, F.struct(*names))).alias("overall"),
        F.map_from_entries(F.sort_array(entries)).alias("by_row_type"),
        *[F.coalesce(F.max(F.when(overall, F.col(c))), F.lit(0)).cast("long").alias(c) for c in counted],
    )
    return _rates(one, "overall", "by_row_type", *counts).withColumn("profile_id", F.lit(profile_id))
