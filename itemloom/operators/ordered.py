"""Rows in an order, handled in blocks side by side: numbers, neighbours and running values of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, parts_for


def numbered(rows: DataFrame, group: list[str], block: str, order: list[str], name: str = "n") -> DataFrame:
    """rows with numbers from 1 on, without gaps, in each group, by block and then by order. Blocks are counted and their
    counts summed, rows are numbered inside their block: only the counts of a group's blocks meet."""
    count = rows.groupBy(*group, block).agg(F.count("*").alias("_in"))
    w = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(*group, block, F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*group, block).orderBy(*order))
    return rows.withColumn("_nth", nth).join(count, [*group, block]).withColumn(name, F.col("_nth") + F.col("_before")).drop("_nth", "_before")


def numbered_ranges(rows: DataFrame, group: list[str], order: list[str], name: str, each: int = 20_000) -> DataFrame:
    """rows with numbers from 1 on in each group, by order, groups of any size: rows are dealt into sampled ranges of some each
    rows, sorted there and written with their place; a range's count of a group moves the ranges behind it on."""
    n = parts_for(rows.sparkSession, rows.count(), each)
    at = cut(rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_at", 33))
    count = at.groupBy(*group, "_part").agg(F.min("_at").alias("_least"), F.count("*").alias("_in"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("_before", F.coalesce(F.sum("_in").over(w), F.lit(0))).drop("_in")
    return at.join(count, [*group, "_part"]).withColumn(name, (F.col("_at") - F.col("_least") + F.col("_before") + 1).cast("int")).drop("_at", "_part", "_least", "_before")


def with_neighbours(rows: DataFrame, group: list[str], size: int, reach: int, n: str = "n") -> tuple[DataFrame, Window]:
    """(rows in blocks of size by their number n, a window over a block): rows within reach of a border are in the block
    behind it too, with _own false there. Windows that look at most reach rows away see what they would see in the whole
    group; drop the rows that are not _own afterwards."""
    at = lambda k: F.floor((F.col(n) - 1 + k) / size)
    out = rows.withColumn("_block", F.explode(F.array_distinct(F.array(at(0), at(-reach), at(reach)))))
    return out.withColumn("_own", F.col("_block") == at(0)), Window.partitionBy(*group, "_block").orderBy(n)


def running(rows: DataFrame, group: list[str], size: int, sums: dict[str, Column], most: dict[str, Column], n: str = "n") -> DataFrame:
    """rows with running sums and running maxima (null before the first) of a group, the own row included: each block has
    its total, totals of the blocks before are carried into it."""
    rows = rows.withColumn("_block", F.floor((F.col(n) - 1) / size))
    for k, c in {**sums, **most}.items():
        rows = rows.withColumn(f"_{k}", c)
    total = rows.groupBy(*group, "_block").agg(*[F.sum(f"_{k}").alias(f"_of_{k}") for k in sums], *[F.max(f"_{k}").alias(f"_of_{k}") for k in most])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*group, "_block", *[F.sum(f"_of_{k}").over(before).alias(f"_to_{k}") for k in sums], *[F.max(f"_of_{k}").over(before).alias(f"_to_{k}") for k in most])
    w = Window.partitionBy(*group, "_block").orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    for k in sums:
        rows = rows.withColumn(f"_{k}", F.sum(f"_{k}").over(w))
    for k in most:
        rows = rows.withColumn(f"_{k}", F.max(f"_{k}").over(w))
    rows = rows.join(total, [*group, "_block"])
    rows = rows.withColumns({k: F.coalesce(f"_{k}", F.lit(0)) + F.coalesce(f"_to_{k}", F.lit(0)) for k in sums} | {k: F.greatest(f"_{k}", f"_to_{k}") for k in most})
    return rows.drop("_block", *[f"_{k}" for k in {**sums, **most}], *[f"_to_{k}" for k in {**sums, **most}])
