"""The planner's penalties as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import lexicon as lx
from rowloom.functions import text as tx


def boundary(a: Column, b: Column, profile: str = "default") -> Column:
    """How badly a sentence is broken between two lines in target spacing; 0 if either is empty."""
    words = F.split(a, " ")
    last, first = tx.comparable(F.element_at(words, -1)), tx.comparable(F.element_at(F.split(b, " "), 1))
    goes_on = first.isin(lx.CONTINUATIONS)
    n = F.size(words)
    comma = F.when(~tx.ends_with_comma(a, True), 0.0).when(goes_on, 6.0).when(n <= 2, 4.0).otherwise(1.25)

    def when(c: Column, points: float) -> Column:
        return F.when(c, points).otherwise(0.0)

    open_end = when(goes_on, 3.0) + when(first.isin(lx.RIGHT_FRAGMENTS), 5.0) + when(last.isin(lx.LEFT_FRAGMENTS), 4.0) + when(n <= 3, 3.0)
    total = comma + F.when(tx.is_terminal(a, True), 0.0).otherwise(open_end)
    return F.when((a == "") | (b == ""), 0.0).otherwise(total * lx.WEIGHTS.get(profile, lx.WEIGHTS["default"])["boundary"])


def learned(chars: Column, words: Column, limits: dict[str, Column]) -> Column:
    """How far a line is from what was learned."""

    def over(c: Column, by: float) -> Column:
        return F.greatest(c, F.lit(0)) * by

    return (
        over(limits["preferred_char_min"] - chars, 0.35)
        + over(chars - limits["preferred_char_max"], 0.8)
        + over(words - limits["preferred_word_max"], 0.9)
        + over(chars - limits["soft_char_max"], 1.25)
    )


def timing_single(length: Column, mean: Column) -> Column:
    """A row on its own should have a long source."""
    return F.when(length <= 0, 0.0).when(length < mean, (mean - length) * 0.15).otherwise((length - mean) * -0.08)


def timing_pair(pair_mean: Column, mean: Column) -> Column:
    """Rows that share a line should have short sources."""
    return F.when(pair_mean > mean, (pair_mean - mean) * 0.1).otherwise((mean - pair_mean) * -0.15)


def repeat_rate(strategy: Column, span: Column, rates: list[Column]) -> Column:
    """What the corpus's repeat rates say against a strategy; ``rates`` of runs of 1, 2, 3 and 4."""
    own = F.element_at(F.array(*rates), F.least(span, F.lit(4)))
    return (
        F.when(strategy != "repeat", F.when(rates[1] > rates[0], (rates[1] - rates[0]) * 1.25).otherwise(0.0))
        .when(rates[0] > own, (rates[0] - own) * 2.5)
        .otherwise(0.0)
    )


def title_date(strategy: Column, first: Column, second: Column, merge_rate: Column) -> Column:
    fits = (merge_rate > 0.2) & (first == "title") & (second == "date") & (strategy != "repeat")
    return F.when(fits, merge_rate * 3).otherwise(0.0)
