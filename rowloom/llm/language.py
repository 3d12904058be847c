"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import col, cut, small

#: Learned from, at most: so many labelled rows of each language, those with the smallest hashes of id and text among
#: the rows of at most SAMPLE_CHARS code points. A language that has longer rows only is learned from the same number
#: of them. Texts are learned whole.
DOCS_PER_LANGUAGE = 16
SAMPLE_CHARS = 4_000
#: Rows that all languages together are learned from, at most; with many languages each gets its share.
DOCS_IN_ALL = 512
#: Rows that are ranked for each that is wanted.
OVER = 16
SEED = 8
#: Code points of texts that are parsed side by side, and texts below which it's faster to go one by one.
CHUNK_CHARS = 4_000_000
FEW = 12
HELD_OUT = 2

_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point, whether it is a letter (Unicode category L: digits, fractions, Roman numerals aren't)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letters(text: str) -> np.ndarray:
    """The code points of a text in lower case, whole: letters, and a space for each stretch of anything else, also
    at either end. Empty if there's no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _is_letter()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    line = np.concatenate([[32], np.where(is_letter, points, 32), [32]]).astype(np.uint32)
    return line[np.concatenate([[True], (line[1:] != 32) | (line[:-1] != 32)])]


class SuffixAutomaton:
    """All substrings of a text, as states and transitions (Blumer et al., 1985)."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: str) -> int:
        """Phrases of the cross-parsing of ``text``: each is the longest match with the learned text, or one
        character that it doesn't have."""
        steps, state, count = self.next, 0, 0
        for c in text:
            to = steps[state].get(c)
            if to is None:
                if state:
                    count += 1
                to = steps[0].get(c)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state > 0)

    def table(self, classes: dict[str, int]) -> np.ndarray:
        """The same steps as one array: at state * size + class, four times the next state plus the phrases that
        end there. Class 0 is any character that the language doesn't have."""
        size = len(classes) + 1
        out = np.zeros((len(self.next), size), np.int32)
        out[0] = 1
        for c, to in self.next[0].items():
            out[0, classes[c]] = 4 * to
        out[1:] = out[0] + 1  # a phrase ends, and the next begins at the root
        for state, steps in enumerate(self.next[1:], 1):
            for c, to in steps.items():
                out[state, classes[c]] = 4 * to
        return out.ravel()


class Model:
    """An automaton for each language, over its learned texts, each whole and between spaces."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.classes, self.tables, self.sizes = [], [], []
        for k in self.languages:
            learned = "".join(chr(c) for t in samples[k] for c in letters(t).tolist())
            classes = {c: i for i, c in enumerate(sorted(set(learned)), 1)}
            of = np.zeros(0x110000, np.int32)
            for c, i in classes.items():
                of[ord(c)] = i
            self.classes.append(of)
            self.sizes.append(len(classes) + 1)
            self.tables.append(SuffixAutomaton(learned).table(classes))

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """The phrases of each text (not empty) by each language, a row for each language: the longest match with the
        learned text, over and over, to the end of the text. All texts go on by a character at a time."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        starts = np.cumsum(lengths) - lengths
        line = np.concatenate([texts[i] for i in order])
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        # texts that still go on after t characters
        going = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")
        together = int(np.searchsorted(-going, -FEW, side="right")) if len(lengths) > FEW else 0
        for k, (of, size, table) in enumerate(zip(self.classes, self.sizes, self.tables, strict=True)):
            kinds = of[line]
            state, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for t in range(together):
                n = going[t]
                step = table[state[:n] * size + kinds[starts[:n] + t]]
                count[:n] += step & 3
                state[:n] = step >> 2
            if together < len(going):
                plain = memoryview(table)
                for i in range(going[together]):
                    at, n = int(state[i]), int(count[i])
                    for c in kinds[starts[i] + together : starts[i] + lengths[i]].tolist():
                        step = plain[at * size + c]
                        n += step & 3
                        at = step >> 2
                    state[i], count[i] = at, n
            out[k, order] = count + (state > 0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text, the language that needs fewest phrases for each character, the first in order among equals,
        and a score: the runner-up's share of both. ``und`` and 0 for texts without letters or without any learned
        language."""
        out = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        lines = [letters(t) if t else np.zeros(0, np.uint32) for t in texts]
        some = [i for i, line in enumerate(lines) if len(line)]
        if not some:
            return out
        rates = self.counts([lines[i] for i in some]) / np.array([len(lines[i]) for i in some])
        best = rates.argmin(axis=0)
        if len(self.languages) == 1:
            score = np.ones(len(some))
        else:
            first, second = np.partition(rates, 1, axis=0)[:2]
            score = second / (first + second)
        for i, k, x in zip(some, best.tolist(), score.tolist(), strict=True):
            out[i] = (self.languages[k], x)
        return out


_models: dict[str, Model] = {}


def _model(samples: dict[str, list[str]], name: str) -> Model:
    """The worker's own model, built once."""
    if name not in _models:
        _models.clear()
        _models[name] = Model(samples)
    return _models[name]


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: CRC32 of its id as text, modulo 4, is 2 (never for a null id)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Labelled texts of each language, whole, by the bounds above. Equal rows count once."""
    rows = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("body")).where(
        F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.col("body").rlike(r"\p{L}")
    )
    kind = F.when(F.length("body") > SAMPLE_CHARS, 1).otherwise(0)
    ranked = rows.withColumn("rank", F.struct(kind.alias("long"), F.pmod(F.xxhash64(F.lit(SEED), "id", "body"), F.lit(1 << 60)).alias("hash")))
    # A language's smallest hashes are below a bound that its counts give: some OVER times the rows wanted are, so
    # that no language's rows meet in one task. Texts are left out.
    counts = rows.groupBy("lang").agg(F.count_if(kind == 0).alias("short"), F.count_if(kind == 1).alias("long"))

    def bound(n: str) -> Column:
        return F.least(F.lit(OVER * DOCS_PER_LANGUAGE) / F.greatest(F.col(n), F.lit(1)), F.lit(1.0)) * float(1 << 60)

    bounds = counts.select(
        F.col("lang").alias("of"), bound("short").alias("short_below"), F.when(F.col("short") < DOCS_PER_LANGUAGE, bound("long")).otherwise(-1.0).alias("long_below")
    )
    near = F.col("rank.hash") <= F.when(F.col("rank.long") == 0, F.col("short_below")).otherwise(F.col("long_below"))
    few = ranked.select("lang", "rank").join(small(cut(bounds, "bounds")), F.col("lang") == F.col("of")).where(near).select("lang", "rank").distinct()
    whole = Window.partitionBy("lang").orderBy("rank")
    chosen = cut(few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= DOCS_PER_LANGUAGE), "chosen")
    names = [r[0] for r in chosen.select("lang").distinct().collect()]
    each = max(1, min(DOCS_PER_LANGUAGE, DOCS_IN_ALL // max(1, len(names))))
    picked = chosen.where(F.col("n") <= each).select(F.col("lang").alias("of"), F.col("rank").alias("at"))
    # DOCS_PER_LANGUAGE rows for each language
    found = ranked.join(F.broadcast(picked), (F.col("lang") == F.col("of")) & (F.col("rank") == F.col("at")))
    texts = found.groupBy("lang", "rank").agg(F.first("body").alias("body")).orderBy("lang", "rank")
    out: dict[str, list[str]] = {}
    for r in texts.toLocalIterator():
        out.setdefault(r["lang"], []).append(r["body"])
    return out


def identify(docs: DataFrame, learned: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of ``docs``, from its text alone.

    ``learned`` has labelled texts by language (see ``samples``); its size is bounded by that function's parameters.
    Every whole text is parsed, from its first letter to its last, across words: a space stands for each stretch of
    what isn't a letter. Null texts, empty ones and those without letters are ``und`` with score 0, and so is
    everything if nothing was learned. Rows are independent, null and repeated ids stay; an empty table gives an empty
    table; other columns are ignored."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(learned)
    name = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id() if sent._jbroadcast else id(sent)}"
    light = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("body"))
    schema = T.StructType([light.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value, name)
        for batch in batches:
            found = [p for part in _chunks(batch.column("body").to_pylist()) for p in model.predict(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    return light.mapInArrow(run, schema).withColumnRenamed("id", id_col)
