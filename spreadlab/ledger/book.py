"""Independent even-money bets and the running capital, as ordered expressions.

Stakes are one unit, so capital matters only through the gate capital >= 1 + 2c. A
failed gate places no bet and leaves capital alone, so it stays failed: a row is live
while the lowest capital before any row so far clears the gate. Cash is DECIMAL(18,6),
since the gate is often met exactly.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.blocks import prefix_sum_and_low, previous, running, time_block
from spreadlab.session import materialise

KEYS = ["strategy", "settlement_point"]
ORDER = ["utc_ts", "end_hour"]
CASH = "decimal(18,6)"


def cash(x: float):
    return F.lit(Decimal(str(x))).cast(CASH)


def bet_pnl(sig: DataFrame, cost: float = 0.05, always_long: bool = False) -> DataFrame:
    """Win or lose one unit less the round-trip cost; `always_long` books shorts as longs."""
    traded = F.col("direction") != "no_trade"
    side = F.when(traded, F.lit("long") if always_long else F.col("direction"))
    won = ((side == "long") & (F.col("actual_dart_slt") == 1)) | ((side == "short") & (F.col("actual_dart_slt") == 0))
    pnl = F.when(won, cash(1 - 2 * cost)).otherwise(cash(-1 - 2 * cost))
    return sig.withColumns({
        "bet_side": side, "position_size": F.when(traded, 1.0).otherwise(0.0),
        "correct_prediction": F.when(traded, won), "pnl": F.when(traded, pnl).otherwise(cash(0)).cast(CASH)})


def capital_ledger(bets: DataFrame, initial_capital: float = 10000.0, cost: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """Every row with its effective P&L, whether a bet was placed, and capital after it."""
    src = materialise(bets)
    gate = cash(1 + 2 * cost)
    k0 = cash(initial_capital)
    d = prefix_sum_and_low(src, keys, ORDER, time_block("utc_ts"), "pnl", "__before", "__low")
    live = (k0 + F.col("__low")) >= gate
    placed = live & (F.col("direction") != "no_trade")
    d = d.withColumn("placed", placed).withColumn("pnl", F.when(placed, F.col("pnl")).otherwise(cash(0)).cast(CASH)).drop("__before", "__low")
    r = running(d, keys, ORDER, time_block("utc_ts"), __sum=("sum", "pnl"))
    return r.withColumn("capital_after", (k0 + F.col("__sum")).cast(CASH)).drop("__sum")


def trades(ledger: DataFrame) -> DataFrame:
    return ledger.where("placed").select(
        *[k for k in KEYS if k in ledger.columns], F.col("utc_ts").alias("entry_time"), F.col("utc_ts").alias("exit_time"),
        F.col("end_hour").alias("entry_hour"), F.col("end_hour").alias("exit_hour"), F.col("bet_side").alias("direction"), "position_size",
        "actual_dart_slt", F.col("pnl").cast("double").alias("pnl"), "week_num", F.col("capital_after").cast("double").alias("capital_after"),
        "correct_prediction", F.lit(0.0).alias("trade_duration_hours"), F.col("predicted_dart_slt").alias("entry_prediction"),
        "predicted_prob_class_0", "predicted_prob_class_1", "prediction_confidence", "actual_dart_slt_raw")


def portfolio(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        *[k for k in KEYS if k in ledger.columns], "utc_ts", "end_hour", F.col("capital_after").cast("double").alias("portfolio_value"),
        "week_num", F.lit(False).alias("has_position"))


def sharpe_ratio(port: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean over sample deviation of row-to-row returns, annualised by the hours of a year."""
    p = previous(port, keys, ORDER, time_block("utc_ts"), {"__prev": "portfolio_value"})
    ret = F.when(F.col("__prev") != 0, F.col("portfolio_value") / F.col("__prev") - 1.0)
    agg = p.withColumn("__r", ret).groupBy(*keys).agg(F.count("__r").alias("n"), F.avg("__r").alias("m"), F.stddev_samp("__r").alias("s"))
    return agg.select(*keys, F.when((F.col("n") > 1) & (F.col("s") > 0), F.col("m") / F.col("s") * F.sqrt(F.lit(8760.0))).otherwise(0.0).alias("sharpe_ratio"))


def max_drawdown(port: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    r = running(port, keys, ORDER, time_block("utc_ts"), __top=("max", "portfolio_value"))
    return r.groupBy(*keys).agg((100.0 * F.min((F.col("portfolio_value") - F.col("__top")) / F.col("__top"))).alias("max_drawdown_pct"))


def performance(ledger: DataFrame, initial_capital: float = 10000.0, cost: float = 0.05, keys: list[str] = KEYS) -> DataFrame:
    """One row per series: trades, wins, P&L, return, costs, Sharpe, drawdown, final capital."""
    p = F.col("pnl").cast("double")
    n = F.count_if("placed")
    base = ledger.groupBy(*keys).agg(
        n.alias("total_trades"), F.count_if(F.col("placed") & (p > 0)).alias("winning_trades"),
        F.count_if(F.col("placed") & (p < 0)).alias("losing_trades"), F.sum("pnl").cast("double").alias("total_pnl"),
        F.avg(F.when(F.col("placed"), p)).alias("avg_trade_pnl"))
    base = base.withColumns({
        "win_rate_pct": F.when(F.col("total_trades") > 0, 100.0 * F.col("winning_trades") / F.col("total_trades")).otherwise(0.0),
        "total_return_pct": 100.0 * F.col("total_pnl") / initial_capital, "final_capital": initial_capital + F.col("total_pnl"),
        "avg_trade_pnl": F.coalesce("avg_trade_pnl", F.lit(0.0)), "total_transaction_costs": F.col("total_trades") * 2 * cost})
    port = portfolio(ledger)
    return base.join(sharpe_ratio(port, keys), keys, "left").join(max_drawdown(port, keys), keys, "left")
