"""Running sums and numbering over a whole table without a single task: blocks are summed first, and only the blocks' sums run in one window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import shared_dir

#: Consecutive ids of a block.
BLOCK = 4096


def exclusive_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of value over all rows of a smaller `order`, a distinct whole number. The one-task window runs over one row for each BLOCK ids."""
    held = df.withColumn("_block", F.expr(f"`{order}` div {BLOCK}"))
    sums = held.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_block").orderBy(order)) - F.col(value)
    return held.withColumn("_within", within).join(before, "_block").withColumn(out, F.col("_before") + F.col("_within")).drop("_block", "_within", "_before")


def number_by(df: DataFrame, order: str, out: str, start: int = 0) -> DataFrame:
    """Adds start, start + 1, ... in order of a distinct whole number."""
    return exclusive_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).withColumn(out, F.col(out) + start).drop("_one")


def sorted_number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds 0, 1, ... in order of any columns. The sorted rows are checkpointed once, as their partitions' sizes must not change between the uses of
    them; then the window runs over one row for each partition."""
    shared_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("_row", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn(out, F.col("_start") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_start")


def with_next(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Adds next_<c> for c in order and values: those of the row with the next larger `order`, a distinct whole number; null for the last. Windows run
    within blocks, and over one row for each block."""
    held = df.withColumn("_block", F.expr(f"`{order}` div {BLOCK}"))
    columns = [order, *values]
    firsts = held.groupBy("_block").agg(F.min_by(F.struct(*columns), order).alias("_head"))
    after = firsts.select("_block", F.lead("_head").over(Window.orderBy("_block")).alias("_head"))
    within = Window.partitionBy("_block").orderBy(order)
    inner = held.withColumn("_next", F.lead(F.struct(*columns)).over(within))
    both = inner.join(after, "_block").withColumn("_next", F.coalesce("_next", "_head"))
    return both.select(*df.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))
