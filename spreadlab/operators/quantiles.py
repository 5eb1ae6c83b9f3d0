"""Exact percentiles and sorted positions without gathering a group in one task.

Rows collapse to distinct values first (map-side). Value blocks cut each group's value
axis; one summary row per block tells where the block starts in sorted order, and the
sort happens inside blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import col
from spreadlab.operators.blocks import BLK, KEY, value_block


def _distinct_values(df: DataFrame, keys: list[str], value, weight: str | None, per_unit: int) -> DataFrame:
    """Distinct non-null values per group with their counts, group key and value block."""
    v = col(value).cast("double")
    series = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(1)
    n = F.sum(weight) if weight else F.count("*")
    return (
        df.select(*keys, v.alias("value"), *([weight] if weight else [])).where("value is not null")
        .groupBy(*keys, "value").agg(n.alias("n"))
        .select(*keys, "value", "n", series.alias(KEY), value_block("value", per_unit).alias(BLK))
    )


def _blocks(counts: DataFrame) -> DataFrame:
    """One row per value block: positions [start, end) it covers and the group's total."""
    upto = Window.partitionBy(KEY).orderBy(BLK).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.groupBy(KEY, BLK).agg(F.sum("n").alias("__bn"))
        .withColumn("__end", F.sum("__bn").over(upto))
        .withColumn("__start", F.col("__end") - F.col("__bn"))
        .withColumn("total", F.sum("__bn").over(Window.partitionBy(KEY)))
    )


def _placed(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """0-based positions [pos_from, pos_to) of every distinct value of the given blocks."""
    inb = Window.partitionBy(KEY, BLK).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    j = counts.join(blocks.select(KEY, BLK, "__start", "total"), [KEY, BLK])
    return j.withColumn("pos_to", F.col("__start") + F.sum("n").over(inb)).withColumn("pos_from", F.col("pos_to") - F.col("n"))


def exact_quantiles(df: DataFrame, keys: list[str], value, probs: dict[str, float], weight: str | None = None,
                    interpolate: bool = True, per_unit: int = 8192) -> DataFrame:
    """One row per key with a column per probability; nulls are ignored.

    Linear interpolation between order statistics, or the lower one. `weight` names an
    integer multiplicity column.
    """
    counts = _distinct_values(df, keys, value, weight, per_unit)
    blocks = _blocks(counts)

    def lo(p: float) -> Column:
        return F.floor((F.col("total") - 1) * F.lit(float(p))).cast("long")

    def hi(p: float) -> Column:
        return F.ceil((F.col("total") - 1) * F.lit(float(p))).cast("long") if interpolate else lo(p)

    def holds(pos: Column, a: str, b: str) -> Column:
        return (pos >= F.col(a)) & (pos < F.col(b))

    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | holds(lo(p), "__start", "__end") | holds(hi(p), "__start", "__end")
    placed = _placed(counts, blocks.where(wanted))
    aggs, outs = [F.max("total").alias("total")], []
    for i, (name, p) in enumerate(probs.items()):
        aggs.append(F.max(F.when(holds(lo(p), "pos_from", "pos_to"), F.col("value"))).alias(f"__l{i}"))
        aggs.append(F.max(F.when(holds(hi(p), "pos_from", "pos_to"), F.col("value"))).alias(f"__h{i}"))
        frac = (F.col("total") - 1) * F.lit(float(p)) - lo(p)
        step = (F.col(f"__h{i}") - F.col(f"__l{i}")) * frac
        outs.append((F.col(f"__l{i}") + step if interpolate else F.col(f"__l{i}")).alias(name))
    return placed.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def with_quantiles(stats: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Attach quantile columns to a per-key statistics table (one row per key on both sides)."""
    q = quantiles.select(*[F.col(k).alias(f"__q_{k}") for k in keys],
                         *[c for c in quantiles.columns if c not in keys])
    on = [stats[k].eqNullSafe(q[f"__q_{k}"]) for k in keys]
    return stats.join(q, on, "left").drop(*[f"__q_{k}" for k in keys])


def order_positions(df: DataFrame, keys: list[str], value, per_unit: int = 8192, chunk: int = 65536) -> DataFrame:
    """One row per original row: value, 1-based position in the sorted group, group size.

    A value shared by very many rows is expanded in chunks that are dealt out to all tasks, so
    neither an array nor a task holds them all.
    """
    counts = _distinct_values(df, keys, value, None, per_unit)
    o = _placed(counts, _blocks(counts))
    o = o.withColumn("__c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))))
    o = o.repartition(*keys, "value", "__c")
    lo = F.col("pos_from") + F.col("__c").cast("long") * chunk + 1
    hi = F.least(F.col("pos_from") + (F.col("__c").cast("long") + 1) * chunk, F.col("pos_to"))
    return o.select(*keys, "value", "total", F.explode(F.sequence(lo, hi)).alias("position"))
