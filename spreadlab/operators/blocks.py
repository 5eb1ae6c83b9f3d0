"""Ordered computations that do not put a whole series into one task.

A window over `partitionBy(location)` gives every location exactly one task, however
long its series is. Here a series is cut into blocks by a monotone key (calendar
span or value range). In-block work uses ordinary windows over (keys, block); what
crosses a block edge travels either as one summary row per block (`running`,
`previous`, `row_numbers`) or as replicated edge rows (`with_halo`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import col

DAY = 86400
BLK = "__blk"
KEY = "__key"

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def time_block(ts: str | Column, days: int = 90) -> Column:
    """Calendar-span block number."""
    return F.floor(F.unix_seconds(col(ts)) / F.lit(days * DAY)).cast("long")


def value_block(x: str | Column, per_unit: int = 8192) -> Column:
    """Value-range block number: monotone in x, finest near zero."""
    v = col(x)
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(float(per_unit))).cast("long")


def _order(order) -> list[Column]:
    return [col(o) for o in ([order] if isinstance(order, (str, Column)) else order)]


def _keyed(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Series key as one struct, so that null keys match in a plain equality join.

    A null-safe join on the columns would need another partitioning than the window and
    shuffle the rows twice.
    """
    return df.withColumn(KEY, F.struct(*keys)).withColumn(BLK, block)


def running(df: DataFrame, keys: list[str], order, block: Column,
            **outs: tuple[str, Column | str]) -> DataFrame:
    """Running sum / max / min / count from the start of each series up to the row.

    outs: name=(function, column).
    """
    d = _keyed(df, keys, block)
    by = [KEY, BLK]
    inner = Window.partitionBy(*by).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(KEY).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*by).agg(*[_AGG[fn](col(c)).alias(f"__t_{o}") for o, (fn, c) in outs.items()])
    carry = totals.select(*by, *[
        _AGG["sum" if fn == "count" else fn](f"__t_{o}").over(before).alias(f"__c_{o}") for o, (fn, _) in outs.items()])
    d = d.select("*", *[_AGG[fn](col(c)).over(inner).alias(f"__i_{o}") for o, (fn, c) in outs.items()])
    j = d.join(carry, by, "left")

    def merged(o, fn):
        i, c = F.col(f"__i_{o}"), F.col(f"__c_{o}")
        if fn in ("sum", "count"):
            return F.coalesce(c + i, i, c).alias(o)
        return (F.greatest(c, i) if fn == "max" else F.least(c, i)).alias(o)

    return j.select(*df.columns, *[merged(o, fn) for o, (fn, _) in outs.items()])


def row_numbers(df: DataFrame, keys: list[str], order, block: Column, out: str = "rn") -> DataFrame:
    """1-based position of each row inside its series."""
    return running(df, keys, order, block, **{out: ("count", F.lit(1))})


def previous(df: DataFrame, keys: list[str], order, block: Column, cols: dict[str, str]) -> DataFrame:
    """Value of the preceding row of the series: cols maps output name to column.

    Each block passes on one row (its last); an empty block simply has no summary.
    """
    d = _keyed(df, keys, block)
    by = [KEY, BLK]
    o = _order(order)
    inner = Window.partitionBy(*by).orderBy(*o)
    packed = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    last = d.groupBy(*by).agg(F.max_by(packed, F.struct(*o)).alias("__last"))
    carry = last.select(*by, F.lag("__last").over(Window.partitionBy(KEY).orderBy(BLK)).alias("__carry"))
    d = d.select("*", F.row_number().over(inner).alias("__pos"), F.lag(packed).over(inner).alias("__prev"))
    j = d.join(carry, by, "left")
    src = F.when(F.col("__pos") == 1, F.col("__carry")).otherwise(F.col("__prev"))
    return j.select(*df.columns, *[src[n].alias(n) for n in cols])


def with_halo(df: DataFrame, position: Column, width: int, back: int, ahead: int = 0) -> DataFrame:
    """Cut the position axis into blocks and copy edge rows into the neighbours, so a frame
    reaching at most `back` behind and `ahead` in front stays inside a block.

    Adds __blk and __own (true on the row's home block). Keep only __own afterwards.
    """
    home = F.floor(position / F.lit(width)).cast("long")
    first = F.floor((position - F.lit(ahead)) / F.lit(width)).cast("long")
    last = F.floor((position + F.lit(back)) / F.lit(width)).cast("long")
    return (
        df.withColumn("__home", home)
        .withColumn(BLK, F.explode(F.sequence(first, last)))
        .withColumn("__own", F.col(BLK) == F.col("__home"))
        .drop("__home")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("__own").drop(BLK, "__own")


def prefix_sum_and_low(df: DataFrame, keys: list[str], order, block: Column, amount: str, before: str, low: str) -> DataFrame:
    """Sum of the earlier rows of the series, and the lowest such sum seen up to the row."""
    d = _keyed(df, keys, block)
    by = [KEY, BLK]
    inner = Window.partitionBy(*by).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__b", F.sum(amount).over(inner) - F.col(amount)).withColumn("__m", F.min("__b").over(inner))
    tot = d.groupBy(*by).agg(F.sum(amount).alias("__t"), F.min("__b").alias("__low"))
    past = Window.partitionBy(KEY).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("__start", F.coalesce(F.sum("__t").over(past), F.lit(0))).withColumn(
        "__lows", F.min(F.col("__start") + F.col("__low")).over(past))
    return d.join(tot.select(*by, "__start", "__lows"), by).select(
        *df.columns, (F.col("__start") + F.col("__b")).alias(before),
        F.least(F.col("__lows"), F.col("__start") + F.col("__m")).alias(low))
