"""Quality rules: text statistics and a learned decision list over them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import barrier, col, cut, fresh, let, space_words, text_or_empty

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Labelled rows used for learning, at most; the rows with the smallest hashes of their ids are taken.
MAX_LABELLED = 20_000
GRID = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
MIN_COVER = 5
SEED = 11

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that are found twice or more in the array.

    Windows are compared by 64-bit hashes chained over 64-bit word hashes. Texts without a repeated hash, the most,
    end there. Else sorted hashes show the repeated ones: a few are looked up at each place, many are found by
    sorting places with their hashes. The starts in order show the words covered. Nearly linear in the length."""

    def covered(starts: Column) -> Column:  # a start covers a whole window, less what the one before it covers
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
            lambda a, s: F.struct((a["n"] + s + window - F.greatest(a["end"], s)).alias("n"), (s + window).alias("end")),
            lambda a: a["n"],
        )

    def by_pairs(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"]))
            | ((i < last) & (F.get(pairs, i + 1)["h"] == p["h"])),
        )
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    def starts_of(h: Column, again: Column) -> Column:
        places = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i.cast("bigint")))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i"))))
        return F.when(F.size(again) <= 16, F.array_compact(places)).otherwise(let(pairs, by_pairs))

    def repeats(h: Column) -> Column:
        again = let(
            F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)))
        )
        return let(again, lambda d: covered(starts_of(h, d)))

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(repeats(h))

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)])
        )

    found = let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: let(windows(w), of))
    return F.when(F.size(words) > window, found).otherwise(F.lit(0).cast("bigint"))


def _count(text: Column, of: str) -> Column:
    """Characters of ``text`` in the class ``of``."""
    return F.length(F.regexp_replace(text, f"[^{of}]+", "")).cast("bigint")


def add_stats(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base statistics and the learner's features, and the names of the added columns.

    Null texts count as empty. Names that ``docs`` has already are left alone: the added columns get other names."""
    text = text_or_empty(text_col)
    names = {s: fresh(docs, f"q_{s}") for s in [*STATS, "text", "words", "lines", "upper"]}
    c = {s: F.col(n) for s, n in names.items()}
    df = docs.withColumn(names["text"], text).withColumns(
        {
            names["words"]: space_words(c["text"]),
            names["lines"]: F.filter(F.split(c["text"], "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    df = df.withColumns(
        {
            names["n_words"]: F.size(c["words"]).cast("bigint"),
            names["word_chars"]: F.length(F.array_join(c["words"], "")).cast("bigint"),
            names["n_symbols"]: _count(c["text"], "#*$%&|<>"),
            names["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("bigint"),
            names["n_repeat_words"]: repeated_words(c["words"]),
            names["upper"]: _count(c["text"], "A-Z"),
            names["lines"]: F.size(c["lines"]).cast("bigint"),
        }
    )
    return df.drop(names["text"], names["words"]), {k: v for k, v in names.items() if k not in ("text", "words")}


def features(names: dict[str, str]) -> dict[str, Column]:
    """The numbers that rules put thresholds on: shares, so that they hold for texts of any length."""
    c = {k: F.col(v).cast("double") for k, v in names.items()}
    words, chars = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    return {
        "words": c["n_words"],
        "mean_word": c["word_chars"] / words,
        "symbols": c["n_symbols"] / chars,
        "dup_lines": c["n_dup_lines"] / F.greatest(c["lines"], F.lit(1.0)),
        "repeats": c["n_repeat_words"] / words,
        "upper": c["upper"] / chars,
        "line_words": c["n_words"] / F.greatest(c["lines"], F.lit(1.0)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, value: Column) -> Column:
        return value >= self.threshold if self.at_least else value < self.threshold


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions. ``bad`` and ``good``: labelled rows it met in the pruning part."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def holds(self, by: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, (c.holds(by[c.feature]) for c in self.conditions))


def verdict(rules: list[Rule], by: dict[str, Column]) -> Column:
    """The decision list as one conditional expression: the number of the first rule that holds (from 1), else 0."""
    out = F.lit(0)
    for n, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.holds(by), F.lit(n)).otherwise(out)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, names: list[str], bad: str = "bad", fold: str = "fold") -> list[Rule]:
    """Sequential covering over ``labelled``: columns ``names`` (double), ``bad`` (boolean), ``fold`` (0 grows, 1 prunes).

    Each rule grows by the condition with the highest information gain on the growing rows not yet covered, until it
    meets no good row, has MAX_CONDITIONS or gains nothing; it's cut back to the prefix that does best on the pruning
    rows, and kept if there MIN_PRECISION of what it meets is bad, over MIN_COVER rows at least. Covered rows go and
    the next rule grows; the first rule that isn't kept ends the list. Thresholds come from a grid of quantiles.
    Every step is one aggregate, of which a row for each feature and grid interval comes to the driver."""
    qs = [i / (GRID + 1) for i in range(1, GRID + 1)]
    found = labelled.agg(*[F.percentile(F.col(n), qs).alias(n) for n in names]).first()
    # Where many rows share a value, "more than it" is a threshold too.
    plateaus = {n: [a for a, b in zip(found[n] or [], (found[n] or [])[1:], strict=False) if a == b] for n in names}
    grid = {n: sorted({*(found[n] or []), *(math.nextafter(t, math.inf) for t in plateaus[n])}) for n in names}
    bins = labelled.select(
        F.col(bad).alias("is_bad"),
        F.col(fold).alias("in_fold"),
        *[
            reduce(lambda a, t, n=n: a + F.when(F.col(n) >= t, 1).otherwise(0), grid[n], F.lit(0)).alias(f"b_{n}")
            for n in names
        ],
    )
    bins = cut(bins, "labelled")

    def met(conditions) -> Column:  # a threshold's place in the grid stands for it
        out = F.lit(True)
        for name, at_least, place in conditions:
            out = out & ((F.col(f"b_{name}") > place) if at_least else (F.col(f"b_{name}") <= place))
        return out

    p, n = F.count_if("is_bad"), F.count_if(~F.col("is_bad"))
    left, rules = F.lit(True), []
    while len(rules) < MAX_RULES:
        conditions: list[tuple[str, bool, int]] = []
        while len(conditions) < MAX_CONDITIONS:
            table = (
                bins.where((F.col("in_fold") == 0) & left & met(conditions))
                .select("is_bad", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b_{k}").alias("b")) for k in names])).alias("x"))
                .groupBy("x.f", "x.b")
                .agg(p.alias("p"), n.alias("n"))
                .collect()
            )
            per = {k: [[0, 0] for _ in range(len(grid[k]) + 1)] for k in names}
            for r in table:
                per[r["f"]][r["b"]] = [r["p"], r["n"]]
            p0, n0 = (sum(x[i] for x in per[names[0]]) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for k in names:
                below = [0, 0]
                for place in range(len(grid[k])):
                    below = [below[i] + per[k][place][i] for i in (0, 1)]
                    for at_least, (a, b) in ((True, (p0 - below[0], n0 - below[1])), (False, below)):
                        if (g := _gain(a, b, p0, n0)) > best[0] + 1e-9:
                            best = (g, (k, at_least, place))
            if best[1] is None:
                break
            conditions.append(best[1])
        if not conditions:
            break
        counts = bins.where((F.col("in_fold") == 1) & left).agg(
            *[x for i in range(1, len(conditions) + 1) for x in (F.count_if(met(conditions[:i]) & F.col("is_bad")), F.count_if(met(conditions[:i]) & ~F.col("is_bad")))]
        ).first()
        scored = [
            ((b - g) / (b + g), -i, b, g) for i in range(1, len(conditions) + 1) if (b := counts[2 * i - 2]) + (g := counts[2 * i - 1])
        ]
        if not scored:
            break
        _, i, b, g = max(scored)
        if b < MIN_PRECISION * (b + g) or b + g < MIN_COVER:
            break
        conditions = conditions[:-i]
        rules.append(Rule(tuple(Condition(k, up, grid[k][place]) for k, up, place in conditions), b, g))
        left = left & ~met(conditions)
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> list[Rule]:
    """Learn rules from documents with a label (0: bad, other numbers: good; null labels and ids are ignored).

    Of more than ``max_labelled`` labels the ones with the smallest hashes of their ids are used, so the choice
    doesn't hang on any order. Without labels of both kinds there are no rules."""
    chosen = (
        labels.select(col(id_col).alias("label_id"), (col(label_col) == 0).alias("bad"))
        .where("label_id is not null and bad is not null")
        .groupBy("label_id")
        .agg(F.max("bad").alias("bad"))
        .orderBy(F.xxhash64(F.lit(SEED), "label_id"), "label_id")
        .limit(max_labelled)
    )
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("body")).join(
        F.broadcast(chosen), F.col("id") == F.col("label_id")  # max_labelled rows at most
    )
    stats, names = add_stats(texts, "body")
    by = features(names)
    fold = F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), "label_id"), F.lit(3)) == 0, 1).otherwise(0)
    labelled = cut(stats.select("bad", fold.alias("fold"), *[v.alias(k) for k, v in by.items()]), "statistics")
    return learn(labelled, list(by))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with statistics, ``base_failed``, ``rule`` (the first that holds, 0 for none) and ``kept``; and the
    names of these columns, which differ from all that ``docs`` has.

    An empty or null text has no words and fails the base rule. Rows are judged one by one: repeated rows, ties and
    null ids make no difference, and an empty table stays empty."""
    df, names = add_stats(docs, text_col)
    names |= {k: fresh(df, f"q_{k}") for k in ("base_failed", "rule", "kept")}
    df = df.withColumn(names["base_failed"], base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"])))
    df = df.withColumn(names["rule"], verdict(rules, features(names)))
    df = df.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["rule"]) == 0))
    return df, names


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the base rule and the learned list keep, with the columns they came with."""
    df, names = judge(docs, fit(docs, labels, id_col, text_col), text_col)
    stays = fresh(df, "q_stays")
    return barrier(df, F.col(names["kept"]), stays).where(F.col(stays)).select(*[col(c) for c in docs.columns])
