"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut, discard, small


def _to_smallest(near: DataFrame, rows: int | None) -> DataFrame:
    """near(u, v): the smallest of u and its neighbours, beside each (u, v). A hub's rows meet in a partial
    aggregate. Its result is written first, so that the join back is broadcast where that table is small, and
    otherwise a plain shuffled join whose hubs adaptive execution splits."""
    low = cut(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
    return near.join(small(low, rows), "u")


def components(edges: DataFrame, u: str = "u", v: str = "v", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges``, where root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each step writes its edges
    and deletes those of the step before, so lineage stays short and a lost executor costs one step. Links and labels
    never come to the driver, but for tables of up to ``rows`` (None: as many as ``small`` allows) that are broadcast.
    Nulls and loops are ignored; an empty table of edges gives an empty table."""
    now = cut(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), "edges"
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_to_smallest(both, rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        near = _to_smallest(large, rows)
        step = (
            near.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        before, now = now, cut(step, "edges")
        discard(before)
        discard(large)
        # Steps only lower the smaller ends: equal sums of hashes over equal counts mean that nothing moved.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
