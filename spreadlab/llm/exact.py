"""Exact dedup by content sort: range partitions of normalised texts, equal texts adjacent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch, without_blanks

PIECE_ROWS = 64
#: Groups of more rows are dealt out in pieces.
HOT_ROWS = 4096
#: Rows of a table of hot groups that is broadcast: some 30 MB.
BROADCAST_ROWS = 1 << 18
#: Characters of a normalised text that go into the sampled splitters.
HEAD = 64


def few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_rows: int = PIECE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without blanks; null counts as empty. Of equal texts the
    row with the most code points stays, then the smallest id, a null id last. Of rows that
    tie in everything one stays. Other columns are not read, whatever their names.

    Splitters sampled by Spark range-partition the normalised texts by their heads, and by a
    hash where heads agree, so that samples of whole texts never reach the driver. An external
    sort puts equal texts side by side, and the window compares neighbours in full. A group of
    more than hot_rows rows is dealt out by a running number in pieces of about piece_rows
    rows, whatever ids its rows have; the first row of each piece carries its text into a
    second comparison, so a hot group is pre-aggregated before it meets in one place. The
    tables of hot groups are counted, and broadcast only while they have few rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "content-sort")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("chars"), without_blanks(text).alias("norm"))
    counts = rows.groupBy(F.xxhash64("norm").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = scratch.keep(counts.select("h", F.ceil(F.col("n") / piece_rows).alias("pieces")), "hot")
    salted = (
        rows.withColumn("h", F.xxhash64("norm"))
        .withColumn("row", F.monotonically_increasing_id())
        .join(few(hot), "h", "left")
        .withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1))))
        .withColumn("head", F.substring("norm", 1, HEAD))
    )
    ranged = ("head", "h", "salt")
    group = Window.partitionBy(*ranged, "norm")
    ranked = group.orderBy(F.col("chars").desc(), F.col("id").asc_nulls_last())
    compared = (
        salted.repartitionByRange(*ranged)
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("keep", F.first(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("salt").alias("piece"))).over(ranked))
        .withColumn("n", F.count("*").over(group))
        .select(
            "id", "chars", "rank", "keep", "n",
            F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.when(F.col("pieces").isNotNull() & (F.col("rank") == 1), F.col("norm")).alias("piece_text"),
        )
    )
    compared = scratch.keep(compared, "compared")
    whole = (
        compared.where("piece_text is not null")
        .groupBy("piece_text")
        .agg(F.min("keep").alias("whole_keep"), F.sum("n").alias("whole_n"), F.first("sha").alias("sha"))
        .select("sha", "whole_keep", "whole_n")
    )
    whole = scratch.keep(whole, "whole")
    out = compared.drop("piece_text").join(few(whole), "sha", "left")
    keep = F.coalesce("whole_keep", "keep")
    return out.select(
        F.col("id").alias("doc_id"),
        keep["id"].alias("keep_id"),
        F.coalesce("whole_n", "n").cast("long").alias("group_size"),
        ((F.col("rank") == 1) & (F.col("keep") == keep)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("chars").alias("n_chars"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns; one of rows that tie in id and text."""
    kept = content_sort(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"), F.col("n_chars").alias("k_chars"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.length(text).cast("long").alias("_chars"), F.sha2(without_blanks(text).cast("binary"), 256).alias("_sha"))
    same = rows["_id"].eqNullSafe(kept["k_id"]) & (rows["_sha"] == kept["k_sha"]) & (rows["_chars"] == kept["k_chars"])
    one = Window.partitionBy("_sha", "_id", "_chars").orderBy(F.col(f"_row.{text_col}"))
    joined = rows.join(kept, same, "left_semi")
    return joined.withColumn("_one", F.row_number().over(one)).where("_one = 1").select("_row.*")
