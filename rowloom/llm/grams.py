"""Joining the rolling word grams of all texts to a table of wanted grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import alnum_words, col, let, small, text_key, text_or_empty


def gram_hash(words: Column, at: Column, size: int) -> Column:
    """A 64-bit hash of ``size`` word hashes from place ``at``."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + j) for j in range(size)])


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(words: Column, size: int) -> Column:
    """Hashes of all grams of ``size`` words, in order; none where there are fewer words."""
    return F.when(
        F.size(words) >= size,
        let(hashed(words), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: gram_hash(h, i, size))),
    ).otherwise(F.array().cast("array<bigint>"))


def sized(words: str, sizes: list[int]) -> Column:
    """All grams of the given sizes, one size after the other; see ``place_of``."""
    return F.concat(*[grams(F.col(words), n) for n in sizes])


def place_of(at: Column, n: Column, sizes: list[int]) -> tuple[Column, Column]:
    """The size and the first word of the gram at place ``at`` of ``sized``, for a text of ``n`` words."""
    offset, bounds = F.lit(0), []
    for s in sizes:
        bounds.append((s, offset))
        offset = offset + F.greatest(n - (s - 1), F.lit(0))
    size, pos = F.lit(sizes[0]), at
    for s, start in bounds[1:]:
        size, pos = F.when(at >= start, F.lit(s)).otherwise(size), F.when(at >= start, at - start).otherwise(pos)
    return size, pos


def gram_places(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, key, n_words, pos, size, h, marks): a row for each place where a text has a gram of ``wanted``, and a row
    that ``marks`` for each row of ``docs`` (its h is null unless its first gram is wanted).

    ``wanted`` has a column ``h`` of gram hashes without repeats; give it a broadcast hint if it's counted to be
    small: the join then runs in the scan's own tasks, next to the unnested hashes, and only wanted ones go on.
    Otherwise ids, keys, places and hashes are shuffled, and no words."""
    text = text_or_empty(text_col)
    df = docs.select(col(id_col).alias("id"), text_key(text).alias("key"), alnum_words(text).alias("words"))
    df = df.select("id", "key", F.size("words").alias("n_words"), sized("words", sizes).alias("all"))
    rows = df.select("id", "key", "n_words", F.posexplode_outer("all").alias("at", "gram"))
    marks = F.col("at").isNull() | (F.col("at") == 0)
    hits = rows.join(wanted.select("h"), F.col("gram") == F.col("h"), "left").where(F.col("h").isNotNull() | marks)
    size, pos = place_of(F.col("at"), F.col("n_words"), sizes)
    return hits.select("id", "key", F.col("n_words").cast("bigint").alias("n_words"), pos.alias("pos"), size.alias("size"), "h", marks.alias("marks"))


def gram_counts(docs: DataFrame, text_col: str, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, times): how often the texts have each gram of ``wanted`` (of those that they have), counted in each task
    before the counts are shuffled."""
    df = docs.select(alnum_words(text_or_empty(text_col)).alias("words"))
    rows = df.select(F.explode(sized("words", sizes)).alias("gram"))
    return rows.join(wanted.select("h"), F.col("gram") == F.col("h")).groupBy("h").agg(F.count("*").alias("times"))


def words_around(docs: DataFrame, text_col: str, places: DataFrame, use: Callable[[Column], Column], name: str) -> DataFrame:
    """(key, ``name``): for each key of ``places`` (a row for each key), once, what ``use`` makes of its text's words;
    ``use`` may name columns of ``places``. If ``places`` is counted to be small, no text is moved."""
    text = text_or_empty(text_col)
    found = docs.select(text_key(text).alias("text_key"), text.alias("text")).join(small(places), F.col("text_key") == F.col("key"))
    made = found.select("key", let(alnum_words(F.col("text")), use).alias(name))
    return made.groupBy("key").agg(F.first(name).alias(name))  # copies of a text agree
