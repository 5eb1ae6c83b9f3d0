"""Layers that replace the old one only when their checks pass, and sinks that touch what they change."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spreadlab.operators import clean
from spreadlab.sources.files import delete, exists, rename


class ChecksFailed(ValueError):
    """The staged layer was removed and the old one left as it was; `found` holds the offending counts."""

    def __init__(self, found: dict[str, int]):
        super().__init__(f"validation failed: {found}")
        self.found = found


def key_checks(columns: list[str]) -> dict[str, Column]:
    """Rows that lack a key column."""
    absent = F.lit(False)
    for c in columns:
        absent = absent | F.col(c).isNull()
    return {"keys_absent": F.count_if(absent)}


def domain_checks(column: str, prefixes: list[str] | None = None, members: list[str] | None = None) -> dict[str, Column]:
    """Rows whose value is outside the domain."""
    ok = F.lit(False)
    for p in prefixes or []:
        ok = ok | F.col(column).startswith(p)
    if members:
        ok = ok | F.col(column).isin(members)
    return {f"{column}_outside": F.count_if(~F.coalesce(ok, F.lit(False)))}


def land(rows: DataFrame, path: str, checks: dict[str, Column], transform: Callable[[DataFrame], DataFrame] = lambda d: d, complete_by: list[str] | None = None,
         partition_by: tuple[str, ...] = (), complete: bool = True, ts: str = "utc_ts") -> dict[str, int]:
    """Write transform(rows) to path if all checks of rows pass, in one scan of rows; returns the counts.

    The checks count offending rows while the job that writes reads them. The result goes to
    a staged folder beside path; gaps in time are looked for there, on the written hours. Only
    then the folders change places, by renaming, and the old one goes. If a check fails, or no
    row came, the staged folder goes and ChecksFailed is raised.
    """
    spark = rows.sparkSession
    seen = Observation(f"landing-{uuid.uuid4().hex}")
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    out = transform(rows.observe(seen, F.count("*").alias("n_rows"), *[c.alias(n) for n, c in checks.items()]))
    writer = out.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    # A plan that Spark knows to be empty observes nothing; an empty layer never lands.
    empty = spark.read.schema(out.schema).parquet(staged).isEmpty()
    found = {"n_rows": 0} if empty else {k: int(v or 0) for k, v in seen.get.items()}
    bad = {k: v for k, v in found.items() if k != "n_rows" and v}
    if not found["n_rows"]:
        bad["n_rows"] = 0
    elif complete:
        short = clean.completeness(spark.read.schema(out.schema).parquet(staged), complete_by, ts).agg(F.sum("n_short_interior")).first()[0] or 0
        found["short_days"] = int(short)
        bad |= {"short_days": int(short)} if short else {}
    if bad:
        delete(spark, staged)
        raise ChecksFailed(bad)
    if exists(spark, path):
        rename(spark, path, old)
    rename(spark, staged, path)
    if exists(spark, old):
        delete(spark, old)
    return found


def replace_dates(df: DataFrame, date_expr: Column, path: str, files_per_date: int = 4) -> None:
    """Write the dates that df holds under a directory each; other dates' directories are not touched."""
    dated = df.withColumn("extract_date", date_expr)
    dealt = dated.repartition("extract_date", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_date)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("extract_date").parquet(path)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in the order, with `n_removed`, the number of the others.

    An aggregate, so rows of one key combine before they travel; ties give the greatest row.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))
    return df.groupBy(*keys).agg(last.alias("__last"), (F.count("*") - 1).alias("n_removed")).select(*keys, "__last.row.*", "n_removed")


def merge_table(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both tables, the last of each key; later loads win ties by their order columns."""
    return keep_last(old.unionByName(new), keys, order).drop("n_removed")


def write_strategy(trades: DataFrame, summary: DataFrame, path: str) -> None:
    """Trades as header CSV and the summary as JSON lines under one folder."""
    trades.write.mode("overwrite").option("header", True).csv(f"{path}/trades")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_strategy(spark: SparkSession, trades_schema: str, summary_schema: str, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(trades_schema).csv(f"{path}/trades", header=True), spark.read.schema(summary_schema).json(f"{path}/summary")
