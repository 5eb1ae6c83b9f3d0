"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, n_words

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
BLOCK_DIGITS = 3


def hashed(*parts: Column) -> Column:
    """Lowercase hex digest of the parts and the seed, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: source_size, target and start offset, from rows (source, size).

    Sources in code point order, null last, take the weights in turn. The level of weight at
    which the targets add up to all sizes is found over the sources ordered by the level at
    which each reaches its cap: resharing the excess by weight ends at this level. One row
    per source goes through the ordering windows, never rows of documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    full = (F.col("source_size") * cap).cast("double")
    rising = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("full", full)
        .withColumn("reach", F.col("full") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("open_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.col("open_w"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(every))
    )
    unit = F.conv(F.substring(hashed(F.lit("offset"), F.coalesce("source", F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return levels.select(
        "source",
        "source_size",
        F.least(F.col("level") * F.col("w"), F.col("full")).alias("target"),
        unit.alias("offset"),
    )


def size_level(size: Column) -> Column:
    """Sizes in at most 1,024 ordered classes: binary digits and the four leading ones."""
    digits = F.length(F.bin(size))
    return digits * 16 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))").cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies.

    size is the number of words, a null or empty text has none. Every row of a source expects
    target / source_size copies. Rows are taken along size classes, in hash order within a
    class, so that every stretch of the sampling covers all sizes; the prefix sum of expected
    copies plus one offset per source is cut at integers and a row is emitted once for each
    integer it crosses: at most `cap` copies. Rows that tie share their positions in any
    order with the same result; rows without an id stand by their running number instead, in
    the order of the input's files. A source of size 0 has target 0 and takes nothing. Other
    columns are not read, whatever their names; an empty table gives no rows.

    The prefix sum of a source is a sum over size classes, over hash blocks of a class, and
    over rows of a block: no window ever holds a source, however many rows it has.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("_size"))
    sized = sized.withColumn("_level", size_level(F.col("_size"))).withColumn("_h", hashed(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))))
    sized = scratch.keep(sized.withColumn("_block", F.substring("_h", 1, BLOCK_DIGITS)), "sized")
    goal = scratch.keep(targets(sized.select("source", F.col("_size").alias("size")), weights, cap), "targets")

    source = (F.col("source").isNull(), F.coalesce("source", F.lit("")))
    sized = sized.withColumn("_null", source[0]).withColumn("_source", source[1])
    blocks = sized.groupBy("_null", "_source", "_level", "_block").agg(F.count("*").alias("_n"))
    level_sums = blocks.groupBy("_null", "_source", "_level").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("_null", "_source").orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    level_sums = level_sums.select("_null", "_source", "_level", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before_level"))
    within = Window.partitionBy("_null", "_source", "_level").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("_before_block", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(level_sums, ["_null", "_source", "_level"])
        .select("_null", "_source", "_level", "_block", (F.col("_before_block") + F.col("_before_level")).alias("_before"))
    )
    in_block = Window.partitionBy("_null", "_source", "_level", "_block").orderBy("_h", "_size", "doc_id")
    ranked = sized.join(blocks, ["_null", "_source", "_level", "_block"]).withColumn("_rank", F.col("_before") + F.row_number().over(in_block))
    goal = goal.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target", "offset")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(F.col("_rank") * rate + F.col("offset")) - F.floor((F.col("_rank") - 1) * rate + F.col("offset"))
    return ranked.join(goal, ["_null", "_source"]).select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * crossed).cast("long").alias("taken"),
        crossed.cast("int").alias("copies"),
    )


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The rows of docs, with their columns, repeated as often as the mix takes them.

    Rows that agree in id, source and size share the copies taken of them, in text order.
    Null texts have no words and are taken like other rows without; very long texts are rows
    like others. The columns of docs may have any names.
    """
    keys = ("_id", "_source", "_size")
    taken = mix(docs, id_col, text_col, source_col, **params).groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"))
    taken = taken.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size"))
    same = F.col("_id").eqNullSafe(F.col("m_id")) & F.col("_source").eqNullSafe(F.col("m_source")) & (F.col("_size") == F.col("m_size"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(f"_row.{text_col}")))
    joined = rows.join(taken, same).withColumn("_nth", nth)
    share = F.floor(F.col("_nth") * F.col("_copies") / F.col("_rows")) - F.floor((F.col("_nth") - 1) * F.col("_copies") / F.col("_rows"))
    return joined.withColumn("_share", share.cast("int")).where("_share > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_share")))).select("_row.*")
