"""Tables over placed trades: hourly, weekly, cumulative, risk, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import kurtosis_of, skew_of
from spreadlab.operators.blocks import running, time_block
from spreadlab.operators.quantiles import exact_quantiles, with_quantiles
from spreadlab.session import join_measured

KEYS = ["strategy", "settlement_point"]


def hourly_trade_metrics(t: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    pnl, ret = F.col("pnl"), F.col("pnl") / F.col("position_size")
    sd = F.stddev_samp(ret)
    return t.groupBy(*keys, F.col("entry_hour").alias("hour")).agg(
        F.count("*").alias("total_trades"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("avg_pnl"),
        F.count_if(pnl > 0).alias("winning_trades"), F.count_if(pnl < 0).alias("losing_trades"),
        (100.0 * F.avg((pnl > 0).cast("int"))).alias("win_rate_pct"),
        (100.0 * F.avg(F.col("correct_prediction").cast("int"))).alias("prediction_accuracy_pct"),
        F.max(pnl).alias("max_win"), F.min(pnl).alias("max_loss"), F.stddev_samp(pnl).alias("pnl_std"), F.sum(pnl).alias("cumulative_pnl"),
        F.when((F.count("*") > 1) & (sd > 1e-12), F.avg(ret) / sd).otherwise(0.0).alias("sharpe_ratio"))


def week_end(ts: str | Column) -> Column:
    """Sunday that closes the calendar week."""
    return F.date_add(F.date_trunc("week", ts).cast("date"), 6)


def weekly_accuracy_by_hour(t: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Accuracy per hour and Sunday-ending week; weeks without trades appear with count 0."""
    by = [*keys, "entry_hour"]
    w = t.groupBy(*by, week_end("entry_time").alias("week_end")).agg(
        (100.0 * F.avg(F.col("correct_prediction").cast("int"))).alias("accuracy_pct"), F.count("*").alias("trade_count"))
    span = w.groupBy(*by).agg(F.min("week_end").alias("lo"), F.max("week_end").alias("hi"))
    weeks = span.select(*by, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAYS"))).alias("week_end"))
    return weeks.join(w, [*by, "week_end"], "left").na.fill(0, ["trade_count"])


def cumulative_pnl_by_hour(t: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    r = running(t, [*keys, "entry_hour"], "entry_time", time_block("entry_time", 365), cumulative_returns=("sum", "pnl"))
    return r.select(*keys, "entry_hour", "entry_time", "cumulative_returns", "pnl", "correct_prediction")


def weekly_pnl_by_hour(t: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return t.groupBy(*keys, "entry_hour", "week_num").agg(
        F.sum("pnl").alias("total_pnl"), F.count("*").alias("trade_count"), F.avg("pnl").alias("avg_pnl"))


def _fixed(c: str, digits: int) -> Column:
    """Text with fixed decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(F.col(c), digits))


def hour_summary(metrics: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Hourly metrics as display text."""
    return metrics.select(
        *keys, "hour", F.format_number("total_trades", 0).alias("total_trades_formatted"),
        F.concat(_fixed("win_rate_pct", 1), F.lit("%")).alias("win_rate_formatted"), F.concat(F.lit("$"), _fixed("avg_pnl", 2)).alias("avg_pnl_formatted"),
        F.concat(F.lit("$"), _fixed("total_pnl", 2)).alias("total_pnl_formatted"),
        F.concat(_fixed("prediction_accuracy_pct", 1), F.lit("%")).alias("prediction_accuracy_formatted"))


def ledger_consistency(t: DataFrame, expected: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One verdict row per expected series, those without trades included."""
    s = t.groupBy(*keys).agg(F.count("*").alias("n_trades"), F.avg(F.col("correct_prediction").cast("int")).alias("accuracy"), F.sum("pnl").alias("total_pnl"),
                             F.count_if(F.col("correct_prediction").isNull() | F.col("pnl").isNull() | F.col("entry_hour").isNull()).alias("n_missing"))
    j = expected.select(*keys).distinct().join(s, keys, "left").na.fill(0, ["n_trades", "n_missing"])
    boolean = dict(t.dtypes)["correct_prediction"] == "boolean"
    suspicious = (F.col("accuracy") > 0.9) & (F.col("total_pnl") < -100)
    return j.withColumns({"no_trades": F.col("n_trades") == 0, "not_boolean": F.lit(not boolean), "suspicious": F.coalesce(suspicious, F.lit(False))})


def hourly_risk(t: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Tail, range and shape of P&L per hour; profit factor is infinite without a loss."""
    by = [*keys, "entry_hour"]
    cut = exact_quantiles(t, by, "pnl", {"var_95": 0.05})
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    base = t.groupBy(*by).agg(
        F.min("pnl").alias("max_loss"), F.max("pnl").alias("max_gain"), F.stddev_samp("pnl").alias("volatility"), skew_of("pnl").alias("skewness"),
        kurtosis_of("pnl").alias("kurtosis"), F.when(loss > 0, gain / loss).otherwise(F.lit(float("inf"))).alias("profit_factor"))
    tail = join_measured(t, cut, by).where(F.col("pnl") <= F.col("var_95")).groupBy(*by).agg(F.avg("pnl").alias("cvar_95"))
    return with_quantiles(base, cut, by).join(tail, by, "left")


def trade_detail(tables: list[DataFrame], hour: int) -> DataFrame:
    from spreadlab.sources.tables import union_all

    return union_all(tables).where(F.col("entry_hour") == hour)


def comparison_text(perf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Performance rows as display text."""
    return perf.select(
        *keys, F.format_string("%+.2f", F.bround("total_return_pct", 2)).alias("total_return"), _fixed("win_rate_pct", 1).alias("win_rate"),
        F.format_number("total_trades", 0).alias("trades"), _fixed("sharpe_ratio", 3).alias("sharpe"),
        _fixed("max_drawdown_pct", 2).alias("max_drawdown"), F.format_number(F.bround("final_capital", 2), 2).alias("capital"))
