"""Ranks over all rows of a table without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch

PART_ROWS = 1 << 16
MOST_PARTS = 20_000


def ranked(scratch: Scratch, df: DataFrame, order: list[Column], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of a written table with `place`, their rank from 0 in the order, and `part`, the range that holds them.

    Ranges of about `part_rows` rows (at most 20,000 ranges, beyond that longer ones) are cut
    by Spark's sampled splitters; a running number parts rows that tie, so that no key fills a
    range. Rows that agree in the whole order share their places in any order. A window ranks
    the rows of one range, and the ranges' counts, one row a range, are summed up before them.
    """
    n = df.count()
    parts = max(1, min(-(-n // part_rows), MOST_PARTS))
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col("_tie"))
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("part").orderBy(*order, "_tie")
    # At most MOST_PARTS rows are broadcast.
    return ranged.join(F.broadcast(starts), "part").withColumn("place", F.col("_start") + F.row_number().over(within) - 1).drop("_start", "_tie")


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of a written table of counts with the largest `n`: whole eighths of powers of two, at most `most` rows in all.

    A cut by levels, some hundred rows of counts, in place of a limit that sends the top of
    every task to the driver.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 8)
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["level"])
    total, least = 0, None
    for r in levels:
        total += r["rows"]
        if total > most:
            break
        least = r["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)
