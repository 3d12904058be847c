"""Sharding by bytes: global byte-size prefix sums, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import col, text_or_empty
from rowloom.llm.prefix import with_prefix

SHARDS = 40
ROW_BYTES = 16


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous shards of nearly equal bytes.

    Rows are ordered by id, then by CRC and size (null ids come first). Per-partition byte totals give every row the
    number of bytes before it; with T bytes in all, a row goes to the shard whose equal part of T holds the row's
    middle byte. So each shard is contiguous and differs from T / shards by at most one row's size. ``slot`` counts
    from 0 in each shard without gaps.

    A null text has no bytes and the CRC of the empty text. Rows that are equal in id, CRC and size are
    interchangeable. One row larger than T / shards may leave neighbouring shards empty. An empty table gives an
    empty table. Other columns are ignored, whatever their names; texts are read but not moved."""
    text = text_or_empty(text_col)
    light = docs.select(
        col(id_col),
        (F.octet_length(text).cast("bigint") + row_bytes).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).toDF("id", "size", "text_crc32")
    ranked = with_prefix(light, ["id", "text_crc32", "size"], {"size": "before"}, "rank")
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # in whole numbers, which hold up to 10**17 bytes
    middle = F.expr(f"(before * 2 + size) * {shards} div {max(1, 2 * total)}")
    placed = ranked.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
    )
