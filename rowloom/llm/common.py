"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII whitespace, and everything in ASCII but letters and digits (Java regular expressions).
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows and bytes up to which a table may be broadcast; every broadcast in this package either has a bound by
#: construction or is counted against these numbers first.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: lambda bodies would otherwise evaluate it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def col(name: str) -> Column:
    """The column of that very name, which may have dots."""
    return F.col(f"`{name}`")


def text_or_empty(text: str) -> Column:
    return F.coalesce(col(text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for pure ASCII and is much faster than ``translate``."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def pieces(text: Column, between: str) -> Column:
    """The non-empty stretches of ``text`` between matches of ``between``."""
    return F.array_remove(F.split(text, between, -1), "")


def space_words(text: Column) -> Column:
    return pieces(text, SPACE)


def alnum_words(text: Column) -> Column:
    return pieces(ascii_lower(text), NOT_ALNUM)


def text_key(text: Column) -> Column:
    """A 128-bit key of a text: operators whose result depends on the text alone compute it once per key."""
    return F.unhex(F.md5(text))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a temporary folder is made, but only for a local master: on a cluster a folder of
    one machine would lose files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rowloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and what several later jobs
    read is computed once, to one and the same result. The folder goes when the driver's JVM ends, or with
    ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` returned and that nothing reads any more."""
    spark = df.sparkSession
    _file_system(spark, df._cut_path).delete(spark._jvm.org.apache.hadoop.fs.Path(df._cut_path), True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that an equality join with it shuffles both sides. Without one Spark goes by its own sizes, which
    it takes from files: after an explode they are far too low, and it broadcasts millions of rows through the driver."""
    return df.hint("merge")


def small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows and ``size`` bytes (as JSON, which
    is longer than Spark's own form of numbers and strings), else with the hint of ``shuffled``, for a join that adaptive
    execution may split where keys are skewed. Call it on the result of ``cut``."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    lengths = df.select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("n")).limit(rows + 1)
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else shuffled(df)


def barrier(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` as a column ``name`` that the optimizer takes as it stands: filters on it aren't rewritten
    as filters on ``value``, which would evaluate a costly expression again."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def running_sums(values: Column, block: int = 128) -> Column:
    """Exclusive running sums of an array of integers, in about n * block / 2 steps (not n squared)."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def of(v: Column) -> Column:
        n = F.size(v)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(block))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(starts, lambda s: total(F.slice(v, s, block)))
        before = F.aggregate(
            sums,
            F.struct(F.lit(0).cast("bigint").alias("t"), F.array().cast("array<bigint>").alias("a")),
            lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["a"], F.array(a["t"])).alias("a")),
            lambda a: a["a"],
        )
        return let(
            before,
            lambda b: F.transform(
                v,
                lambda _, i: F.get(b, (i / block).cast("int"))
                + total(F.slice(v, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))),
            ),
        )

    return let(values, of)
