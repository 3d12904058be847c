"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import col, cut, fresh, shuffled, small, text_key, text_or_empty
from rowloom.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BITS = 64
SEGMENTS = 2
#: Fingerprints that an entry of a segment table may have, for its members to be compared one by one.
DENSE = 64
#: Fingerprints that a task makes the probes of.
PRINTS_PER_TASK = 20_000
#: Rows up to which a table is broadcast here: each one passes through the driver, and a run has about two dozen.
BROADCAST_ROWS = 50_000
#: Shingle hashes whose bits are unpacked at a time: 64 bytes each.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: bit b is set if over half of its shingles' XXH64 have bit b.

    A-Z are lower-cased and words stand between ASCII white space (``bytes`` does both for ASCII alone). Fewer words
    than a shingle make one; a text without words has fingerprint 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)  # of one hash, every set bit is in more than half
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, len(starts)
    )
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a bigint column ``name`` (the fingerprint's 64 bits, as signed); a null text counts as empty."""
    schema = T.StructType([*[f for f in docs.schema if f.name != text_col], T.StructField(name, T.LongType())])
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            columns = [batch.column(c) for c in keep] + [pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, name])

    return docs.mapInArrow(run, schema)


def flipped(value: Column, bits: range) -> list[Column]:
    """``value`` with one bit changed, for each of ``bits``."""
    return [value.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in bits]


def segment(fingerprint: Column, number: int) -> Column:
    """The fingerprint with all bits but those of a segment cleared."""
    width = BITS // SEGMENTS
    mask = ((1 << width) - 1) << (number * width)
    return fingerprint.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask))


def _segments(prints: DataFrame, ball: Callable[[Column, range], Column]) -> DataFrame:
    """(u, segment, value): for each fingerprint and segment, the values that ``ball`` makes of it."""
    width = BITS // SEGMENTS

    def of(s: int) -> Column:
        values = ball(segment(F.col("u"), s), range(s * width, (s + 1) * width))
        return F.transform(values, lambda v: F.struct(F.lit(s).alias("segment"), v.alias("value")))

    table = prints.select("u", F.explode(F.concat(*[of(s) for s in range(SEGMENTS)])).alias("x"))
    return table.select("u", "x.segment", "x.value")


def _alone(value: Column, bits: range) -> Column:
    return F.array(value)


def _ball(value: Column, bits: range) -> Column:
    """All values at most one bit away."""
    return F.array(value, *flipped(value, bits))


def _half_ball(value: Column, bits: range) -> Column:
    """The value, and those with one bit more. Of two values one bit apart, one has the other in its half."""
    return F.concat(F.array(value), F.filter(F.array(*flipped(value, bits)), lambda x: F.bit_count(x) > F.bit_count(value)))


def _met(prints: DataFrame) -> DataFrame:
    """(u, v) of fingerprints that meet in the values at most one bit from each: all at distance 2 or less do, and a
    value has no more than the 65 around it. Each links to the one before it."""
    table = prints.select("u", F.explode(F.array("u", *flipped(F.col("u"), range(BITS)))).alias("value"))
    return table.select("u", F.lag("u").over(Window.partitionBy("value").orderBy("u")).alias("v")).where("v is not null")


def links(prints: DataFrame, name: str = "fp", dense: int = DENSE) -> DataFrame:
    """(u, v): links that connect every two of the distinct fingerprints in ``prints`` at distance 2 or less.

    Multi-index hashing: every fingerprint is entered in a table by each of its SEGMENTS segments. Of two at distance 2,
    one segment differs in one bit at most, so probing each segment's Hamming ball of radius 1 finds one in an entry
    of the other; as each probes, half of the ball will do. Complete distances of the matches are verified.

    An entry with more than ``dense`` fingerprints would compare them all with one another. Dense entries aren't
    probed. All fingerprints that have a segment in a dense entry, or one bit from it, instead look for each other by
    whole values: each is entered under the 65 values around it, and what meets there is verified. Both ways lose
    nothing, and none compares more than ``dense`` times 33 values with one."""
    own = prints.select(F.col(name).alias("u"))
    table = cut(_segments(own, _alone), "segments")
    n = table.count() // SEGMENTS
    own = own.repartition(max(1, n // PRINTS_PER_TASK), "u")  # a few bytes a row here, and 33 rows each from here on
    crowded = cut(table.groupBy("segment", "value").count().where(F.col("count") > dense).select("segment", "value"), "dense")
    apart = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    entries, probes = table.select(F.col("u").alias("v"), "segment", "value"), _segments(own, _half_ball)
    beside = None
    if not crowded.isEmpty():
        crowded = small(crowded, BROADCAST_ROWS)
        beside = _segments(own, _ball).join(crowded, ["segment", "value"], "left_semi").select("u").distinct()
        entries = entries.join(crowded, ["segment", "value"], "left_anti")
        # A fingerprint in a dense entry doesn't probe around it: what is near it there is beside a dense entry too.
        dealt = table.join(crowded, ["segment", "value"], "left_semi").groupBy("u").agg(F.expr("bit_or(shiftleft(1, segment))").alias("in"))
        probes = probes.join(small(cut(dealt.withColumnRenamed("u", "member"), "members"), BROADCAST_ROWS), F.col("u") == F.col("member"), "left").where(
            F.expr("coalesce(`in`, 0) & shiftleft(1, segment) = 0")
        )
    found = probes.join(shuffled(entries), ["segment", "value"]).where(apart)
    found = found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if beside is not None:
        found = found.unionByName(_met(beside).where(apart))
    return found.distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, fp, root, component_id) for each row."""
    body = text_or_empty(text_col)
    light = docs.select(col(id_col).alias("id"), text_key(body).alias("key"), body.alias("body"))
    rows = cut(add_fingerprint(light, "body", "fp"), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = components(links(distinct.select("fp")), rows=BROADCAST_ROWS).toDF("node", "other_root")
    labelled = cut(
        distinct.join(shuffled(roots), F.col("fp") == F.col("node"), "left").select(
            F.col("fp").alias("print"), "low", F.coalesce("other_root", "fp").alias("root")
        ),
        "roots",
    )
    # written first, so that the join on the root is a plain one, which adaptive execution can split
    lowest = cut(labelled.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    by_print = cut(labelled.join(small(lowest, BROADCAST_ROWS), "root").select("print", "root", "component_id"), "components")
    return rows.join(small(by_print, BROADCAST_ROWS), F.col("fp") == F.col("print")).drop("print")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id that links of near fingerprints reach, itself included.

    Rows of equal fingerprints are linked by it and enter as one. Texts without words share fingerprint 0. Null texts
    count as empty. A null id never is the smallest unless its component has no other id. Repeated rows and ids stay
    rows of their own. An empty table gives an empty table; other columns are ignored."""
    return _grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all columns of ``docs``: the one with the smallest id.

    Where that id has several texts in the group, the one with the smallest key stays; of repeated rows, any one. A
    row without an id stays only where its whole group has none. Names of columns may be any but with a backtick."""
    gone_id, gone_key = fresh(docs, "simhash_gone_id"), fresh(docs, "simhash_gone_key")
    rows = cut(_grouped(docs, id_col, text_col).select("root", "id", "key", F.col("id").eqNullSafe(F.col("component_id")).alias("low")), "grouped")
    # rows of a component's smallest id: one, but where ids repeat
    lows = rows.where("low").groupBy("root", "id", "key").agg(F.count("*").alias("n"))
    best = cut(lows.groupBy("root").agg(F.min(F.struct("key", "id", "n")).alias("best")).select("root", "best.*"), "best")
    gone_lows = lows.join(small(best.select(F.col("root").alias("best_root"), F.col("key").alias("best_key")), BROADCAST_ROWS), F.col("root") == F.col("best_root"))
    goes = rows.where("not low").select("id", "key").unionByName(
        gone_lows.where((F.col("key") != F.col("best_key")) | (F.col("n") > 1)).select("id", "key")
    )
    goes = cut(goes.distinct(), "goes").toDF(gone_id, gone_key)
    key = fresh(docs, "simhash_key")
    wide = docs.withColumn(key, text_key(text_or_empty(text_col)))
    same = col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    columns = [col(c) for c in docs.columns]
    out = wide.join(small(goes, BROADCAST_ROWS), same, "left_anti").select(*columns)
    repeated = cut(best.where("n > 1").select("id", "key"), "repeated").toDF(gone_id, gone_key)
    if repeated.isEmpty():
        return out
    one = wide.join(small(repeated, BROADCAST_ROWS), same, "left_semi").dropDuplicates([id_col, key]).select(*columns)
    return out.unionByName(one)
