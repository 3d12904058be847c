"""Global ranks and running sums over ordered rows, from the totals of range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import cut, fresh


def with_prefix(df: DataFrame, order: list[str | Column], sums: dict[str, str], rank: str) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ... over all rows in the order of ``order``), and for each column named in ``sums`` a
    column of the name given there: the sum of its values over the rows before this one.

    Rows are dealt to ranges once and written with their partition's number, so that every later job sees the same
    partitions. A range is summed by itself; only the totals, one row for each partition, are summed in one place.
    Rows that tie in the whole order may change places, so order by all that matters. Keep wide columns out of
    ``df``: everything in it is moved."""
    part = fresh(df, "range_part")
    dealt = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()), "ranges"
    )
    totals = dealt.groupBy(part).agg(F.count("*").alias(f"{part}_rows"), *[F.sum(c).alias(f"{part}_{i}") for i, c in enumerate(sums)])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)

    def ahead(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_ahead")

    offsets = totals.select(part, ahead(f"{part}_rows"), *[ahead(f"{part}_{i}") for i in range(len(sums))])
    own = Window.partitionBy(part).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as the shuffle has partitions, whatever the size of the data
    out = dealt.join(F.broadcast(offsets), part).withColumn(rank, F.col(f"{part}_rows_ahead") + F.row_number().over(own) - 1)
    for i, (c, name) in enumerate(sums.items()):
        out = out.withColumn(name, F.col(f"{part}_{i}_ahead") + F.coalesce(F.sum(c).over(so_far), F.lit(0)))
    return out.drop(part, f"{part}_rows_ahead", *[f"{part}_{i}_ahead" for i in range(len(sums))])
