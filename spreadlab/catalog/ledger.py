"""Queries over signals, the bet ledger and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadlab.catalog.explore import rounded
from spreadlab.catalog.oracle_parts import r6
from spreadlab.catalog.registry import query
from spreadlab.functions.columns import inverse_signed_log, rnd
from spreadlab.ledger import book, report, signals
from spreadlab.session import materialise
from spreadlab.sources.tables import union_all

COST, K0 = 0.05, 10000.0

THR = f"""thr AS (
    SELECT g.settlement_point, CAST(h AS INT) AS end_hour, coalesce(c.cut, g.med) AS threshold, coalesce(c.n, 0) AS total_predictions,
           (SELECT count(*) FROM pred p WHERE p.settlement_point = g.settlement_point AND p.end_hour = h AND p.prediction_confidence >= c.cut) AS n_above
    FROM (SELECT settlement_point, quantile_cont(prediction_confidence, 0.5) AS med FROM pred GROUP BY 1) g CROSS JOIN generate_series(1, 24) AS t(h)
    LEFT JOIN (SELECT settlement_point, end_hour, count(*) AS n, quantile_cont(prediction_confidence, 0.95) AS cut FROM pred GROUP BY 1, 2) c
      ON c.settlement_point = g.settlement_point AND c.end_hour = h)"""
SIG = THR + """,
    sig AS (SELECT p.*, 'naive' AS strategy, CASE WHEN predicted_dart_slt = 1 THEN 'long' ELSE 'short' END AS direction, CAST(1 AS DOUBLE) AS confidence FROM pred p
            UNION ALL SELECT p.*, 'sign_prob', CASE WHEN p.prediction_confidence >= t.threshold THEN CASE WHEN predicted_dart_slt = 1 THEN 'long' ELSE 'short' END ELSE 'no_trade' END,
                             p.prediction_confidence FROM pred p LEFT JOIN thr t ON t.settlement_point = p.settlement_point AND t.end_hour = p.end_hour)"""


def ledger_ctes(k0: float) -> str:
    """Sequential rule written with ordered sums; the gate uses exact decimals."""
    return SIG + f""",
    bets AS (SELECT *, direction <> 'no_trade' AS traded, CASE WHEN direction <> 'no_trade' THEN (direction = 'long') = (actual_dart_slt = 1) END AS correct_prediction,
                    CAST(CASE WHEN direction = 'no_trade' THEN 0 WHEN (direction = 'long') = (actual_dart_slt = 1) THEN 0.9 ELSE -1.1 END AS DECIMAL(18,6)) AS pnl0 FROM sig),
    cap0 AS (SELECT *, {k0}::DECIMAL(18,6) + sum(pnl0) OVER w - pnl0 AS raw_before FROM bets WINDOW w AS (PARTITION BY strategy, settlement_point ORDER BY utc_ts, end_hour ROWS UNBOUNDED PRECEDING)),
    cap1 AS (SELECT *, traded AND min(raw_before) OVER w >= 1.1 AS placed FROM cap0 WINDOW w AS (PARTITION BY strategy, settlement_point ORDER BY utc_ts, end_hour ROWS UNBOUNDED PRECEDING)),
    led AS (SELECT * EXCLUDE (pnl0, raw_before), CAST(CASE WHEN placed THEN pnl0 ELSE 0 END AS DECIMAL(18,6)) AS pnl,
                   {k0}::DECIMAL(18,6) + sum(CASE WHEN placed THEN pnl0 ELSE 0 END) OVER (PARTITION BY strategy, settlement_point ORDER BY utc_ts, end_hour ROWS UNBOUNDED PRECEDING) AS capital_after FROM cap1),
    trd AS (SELECT strategy, settlement_point, utc_ts AS entry_time, end_hour AS entry_hour, direction, CAST(1 AS DOUBLE) AS position_size, CAST(pnl AS DOUBLE) AS pnl, week_num, correct_prediction,
                   CAST(capital_after AS DOUBLE) AS capital_after FROM led WHERE placed)"""


LED, RUIN = ledger_ctes(K0), ledger_ctes(6.0)


def signal_rows(b):
    p = materialise(b.predictions)  # read by both strategies and by the thresholds
    thr = signals.hour_thresholds(p)
    naive = signals.naive_signal(p).withColumn("strategy", F.lit("naive"))
    sel = signals.sign_prob_signal(p, thr).drop("threshold").withColumn("strategy", F.lit("sign_prob"))
    return union_all([naive, sel])


def ledger_rows(b, k0=K0):
    return book.capital_ledger(book.bet_pnl(signal_rows(b), COST), k0, COST)


def kept_ledger(b):
    """Ledger written once, for reports that read it several times."""
    return materialise(ledger_rows(b))


def trade_rows(b, k0=K0):
    return book.trades(ledger_rows(b, k0))


@query("target_hours_filter", """
    SELECT settlement_point, 'naive_hours_7_8_18' AS strategy, CAST(count(*) AS BIGINT) AS n_rows FROM pred WHERE end_hour IN (7, 8, 18) GROUP BY 1""", "pred")
def target_hours_filter(b):
    hours = [18, 7, 8]
    return signals.target_hours(b.predictions, hours).groupBy("settlement_point").agg(F.count("*").alias("n_rows")).withColumn(
        "strategy", F.lit(signals.strategy_label("naive", hours)))


@query("naive_signal", "SELECT settlement_point, utc_ts, direction, confidence FROM sig WHERE strategy = 'naive'", "pred", SIG)
def naive_signal(b):
    return signals.naive_signal(b.predictions).select("settlement_point", "utc_ts", "direction", "confidence")


@query("confidence", "SELECT settlement_point, utc_ts, greatest(predicted_prob_class_0, predicted_prob_class_1) AS confidence FROM pred", "pred")
def confidence(b):
    p = b.predictions.drop("prediction_confidence")
    return p.select("settlement_point", "utc_ts", signals.confidence(p.columns).alias("confidence"))


@query("hour_thresholds", f"""
    SELECT settlement_point, end_hour, {r6('threshold')} AS threshold, CAST(total_predictions AS BIGINT) AS total_predictions, CAST(n_above AS BIGINT) AS n_above,
           {r6('CASE WHEN total_predictions > 0 THEN 100.0 * n_above / total_predictions ELSE 0 END')} AS pct_above FROM thr""", "pred", THR)
def hour_thresholds(b):
    return rounded(signals.hour_thresholds(b.predictions), ["threshold", "pct_above"])


@query("sign_prob_signal", "SELECT settlement_point, utc_ts, direction, confidence FROM sig WHERE strategy = 'sign_prob'", "pred", SIG)
def sign_prob_signal(b):
    p = b.predictions
    return signals.sign_prob_signal(p, signals.hour_thresholds(p)).select("settlement_point", "utc_ts", "direction", "confidence")


@query("bet_pnl", "SELECT strategy, settlement_point, utc_ts, direction, correct_prediction, CAST(pnl0 AS DOUBLE) AS pnl FROM bets", "pred", LED)
def bet_pnl(b):
    return book.bet_pnl(signal_rows(b), COST).select(
        "strategy", "settlement_point", "utc_ts", "direction", "correct_prediction", F.col("pnl").cast("double").alias("pnl"))


_LEDCOLS = "strategy, settlement_point, utc_ts, placed, CAST(pnl AS DOUBLE) AS pnl, CAST(capital_after AS DOUBLE) AS capital_after"


def _ledger_out(df):
    return df.select("strategy", "settlement_point", "utc_ts", "placed", F.col("pnl").cast("double").alias("pnl"), F.col("capital_after").cast("double").alias("capital_after"))


@query("capital_ledger", f"SELECT {_LEDCOLS} FROM led", "pred", LED)
def capital_ledger(b):
    return _ledger_out(ledger_rows(b))


@query("capital_ledger_ruin", f"SELECT {_LEDCOLS} FROM led", "pred", RUIN)
def capital_ledger_ruin(b):
    """Small starting capital, so the gate closes on some series."""
    return _ledger_out(ledger_rows(b, 6.0))


@query("signal_violations", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(direction NOT IN ('long', 'short', 'no_trade')) AS BIGINT) AS bad_direction,
           CAST(count_if(confidence < 0 OR confidence > 1) AS BIGINT) AS bad_confidence, CAST(0 AS BIGINT) AS bad_size,
           CAST(count_if(direction NOT IN ('long', 'short', 'no_trade') OR confidence < 0 OR confidence > 1) AS BIGINT) AS bad_rows, FALSE AS bad_setup,
           count_if(direction NOT IN ('long', 'short', 'no_trade') OR confidence < 0 OR confidence > 1) > 0.1 * count(*) AS failed FROM sig""", "pred", SIG)
def signal_violations(b):
    return signals.signal_violations(signal_rows(b), K0, COST)


_PERF = f"""perf AS (
    SELECT strategy, settlement_point, count_if(placed) AS total_trades, count_if(placed AND pnl > 0) AS winning_trades, count_if(placed AND pnl < 0) AS losing_trades,
           CAST(sum(pnl) AS DOUBLE) AS total_pnl, coalesce(avg(CASE WHEN placed THEN CAST(pnl AS DOUBLE) END), 0) AS avg_trade_pnl FROM led GROUP BY 1, 2),
    rets AS (SELECT strategy, settlement_point, v / lag(v) OVER w - 1 AS r, (v - max(v) OVER (PARTITION BY strategy, settlement_point ORDER BY utc_ts, end_hour ROWS UNBOUNDED PRECEDING)) / max(v) OVER (PARTITION BY strategy, settlement_point ORDER BY utc_ts, end_hour ROWS UNBOUNDED PRECEDING) AS dd
             FROM (SELECT *, CAST(capital_after AS DOUBLE) AS v FROM led) WINDOW w AS (PARTITION BY strategy, settlement_point ORDER BY utc_ts, end_hour)),
    risk AS (SELECT strategy, settlement_point, CASE WHEN count(r) > 1 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(8760.0) ELSE 0 END AS sharpe_ratio, 100 * min(dd) AS max_drawdown_pct FROM rets GROUP BY 1, 2),
    full_ AS (SELECT p.*, CASE WHEN total_trades > 0 THEN 100.0 * winning_trades / total_trades ELSE 0 END AS win_rate_pct, 100.0 * total_pnl / {K0} AS total_return_pct,
                     {K0} + total_pnl AS final_capital, total_trades * 2 * {COST} AS total_transaction_costs, sharpe_ratio, max_drawdown_pct FROM perf p JOIN risk USING (strategy, settlement_point))"""
_PNUM = ["total_pnl", "avg_trade_pnl", "win_rate_pct", "total_return_pct", "final_capital", "total_transaction_costs", "sharpe_ratio", "max_drawdown_pct"]
_PSQL = ("SELECT strategy, settlement_point, CAST(total_trades AS BIGINT) AS total_trades, CAST(winning_trades AS BIGINT) AS winning_trades, CAST(losing_trades AS BIGINT) AS losing_trades, "
         + ", ".join(f"{r6(c)} AS {c}" for c in _PNUM) + " FROM full_")


@query("strategy_performance", _PSQL, "pred", LED + ", " + _PERF)
def strategy_performance(b):
    return rounded(book.performance(kept_ledger(b), K0, COST), _PNUM)


@query("sharpe_ratio", f"SELECT strategy, settlement_point, {r6('sharpe_ratio')} AS sharpe_ratio FROM risk", "pred", LED + ", " + _PERF)
def sharpe_ratio(b):
    return rounded(book.sharpe_ratio(book.portfolio(ledger_rows(b))), ["sharpe_ratio"])


@query("max_drawdown", f"SELECT strategy, settlement_point, {r6('max_drawdown_pct')} AS max_drawdown_pct FROM risk", "pred", LED + ", " + _PERF)
def max_drawdown(b):
    return rounded(book.max_drawdown(book.portfolio(ledger_rows(b))), ["max_drawdown_pct"])


@query("strategy_comparison", """
    SELECT strategy, settlement_point, printf('%+.2f', round_even(total_return_pct, 2)) AS total_return, printf('%.1f', round_even(win_rate_pct, 1)) AS win_rate,
           format('{:,}', total_trades) AS trades, printf('%.3f', round_even(sharpe_ratio, 3)) AS sharpe, printf('%.2f', round_even(max_drawdown_pct, 2)) AS max_drawdown,
           replace(format('{:,.2f}', round_even(final_capital, 2)), ' ', '') AS capital FROM full_""", "pred", LED + ", " + _PERF)
def strategy_comparison(b):
    return report.comparison_text(book.performance(kept_ledger(b), K0, COST))


_HM = f"""hm AS (SELECT strategy, settlement_point, entry_hour AS hour, count(*) AS total_trades, sum(pnl) AS total_pnl, avg(pnl) AS avg_pnl, count_if(pnl > 0) AS winning_trades,
    count_if(pnl < 0) AS losing_trades, 100.0 * count_if(pnl > 0) / count(*) AS win_rate_pct, 100.0 * count_if(correct_prediction) / count(*) AS prediction_accuracy_pct, max(pnl) AS max_win,
    min(pnl) AS max_loss, stddev_samp(pnl) AS pnl_std, sum(pnl) AS cumulative_pnl, CASE WHEN count(*) > 1 AND stddev_samp(pnl) > 1e-12 THEN avg(pnl) / stddev_samp(pnl) ELSE 0 END AS sharpe_ratio
    FROM trd GROUP BY 1, 2, 3)"""
_HNUM = ["total_pnl", "avg_pnl", "win_rate_pct", "prediction_accuracy_pct", "max_win", "max_loss", "pnl_std", "cumulative_pnl", "sharpe_ratio"]


@query("hourly_trade_metrics", "SELECT strategy, settlement_point, CAST(hour AS INT) AS hour, CAST(total_trades AS BIGINT) AS total_trades, CAST(winning_trades AS BIGINT) AS winning_trades, CAST(losing_trades AS BIGINT) AS losing_trades, "
       + ", ".join(f"{r6(c)} AS {c}" for c in _HNUM) + " FROM hm", "pred", LED + ", " + _HM)
def hourly_trade_metrics(b):
    return rounded(report.hourly_trade_metrics(trade_rows(b)), _HNUM)


@query("weekly_accuracy_by_hour", f"""
    SELECT s.strategy, s.settlement_point, CAST(s.entry_hour AS INT) AS entry_hour, strftime(s.we, '%Y-%m-%d') AS week_end, {r6('w.acc')} AS accuracy_pct, CAST(coalesce(w.n, 0) AS BIGINT) AS trade_count
    FROM (SELECT strategy, settlement_point, entry_hour, unnest(generate_series(min(we), max(we), INTERVAL 7 DAY)) AS we FROM wk GROUP BY 1, 2, 3) s LEFT JOIN wk w
      ON w.strategy = s.strategy AND w.settlement_point = s.settlement_point AND w.entry_hour = s.entry_hour AND w.we = s.we""", "pred", LED + """,
    wk AS (SELECT strategy, settlement_point, entry_hour, CAST(date_trunc('week', entry_time) + INTERVAL 6 DAY AS TIMESTAMP) AS we, 100.0 * count_if(correct_prediction) / count(*) AS acc, count(*) AS n FROM trd GROUP BY 1, 2, 3, 4)""")
def weekly_accuracy_by_hour(b):
    return rounded(report.weekly_accuracy_by_hour(trade_rows(b)), ["accuracy_pct"]).withColumn("week_end", F.col("week_end").cast("string"))


@query("cumulative_pnl_by_hour", f"""
    SELECT strategy, settlement_point, CAST(entry_hour AS INT) AS entry_hour, entry_time, {r6('sum(pnl) OVER (PARTITION BY strategy, settlement_point, entry_hour ORDER BY entry_time)')} AS cumulative_returns, pnl, correct_prediction FROM trd""", "pred", LED)
def cumulative_pnl_by_hour(b):
    return rounded(report.cumulative_pnl_by_hour(trade_rows(b)), ["cumulative_returns"])


@query("weekly_pnl_by_hour", f"""
    SELECT strategy, settlement_point, CAST(entry_hour AS INT) AS entry_hour, CAST(week_num AS INT) AS week_num, {r6('sum(pnl)')} AS total_pnl, CAST(count(*) AS BIGINT) AS trade_count, {r6('avg(pnl)')} AS avg_pnl FROM trd GROUP BY 1, 2, 3, 4""", "pred", LED)
def weekly_pnl_by_hour(b):
    return rounded(report.weekly_pnl_by_hour(trade_rows(b)), ["total_pnl", "avg_pnl"])


@query("hour_summary_formatted", """
    SELECT strategy, settlement_point, CAST(hour AS INT) AS hour, format('{:,}', total_trades) AS total_trades_formatted, printf('%.1f%%', round_even(win_rate_pct, 1)) AS win_rate_formatted,
           printf('$%.2f', round_even(round(avg_pnl, 9), 2)) AS avg_pnl_formatted, printf('$%.2f', round_even(round(total_pnl, 9), 2)) AS total_pnl_formatted, printf('%.1f%%', round_even(prediction_accuracy_pct, 1)) AS prediction_accuracy_formatted FROM hm""", "pred", LED + ", " + _HM)
def hour_summary_formatted(b):
    m = rounded(report.hourly_trade_metrics(trade_rows(b)), ["avg_pnl", "total_pnl"], 9)
    return report.hour_summary(m)


@query("ledger_consistency", f"""
    SELECT s.strategy, s.settlement_point, CAST(count(t.pnl) AS BIGINT) AS n_trades, {r6('avg(CAST(t.correct_prediction AS INT))')} AS accuracy, {r6('sum(t.pnl)')} AS total_pnl, CAST(0 AS BIGINT) AS n_missing,
           count(t.pnl) = 0 AS no_trades, FALSE AS not_boolean, coalesce(avg(CAST(t.correct_prediction AS INT)) > 0.9 AND sum(t.pnl) < -100, FALSE) AS suspicious
    FROM (SELECT DISTINCT strategy, settlement_point FROM sig) s LEFT JOIN trd t ON t.strategy = s.strategy AND t.settlement_point = s.settlement_point GROUP BY 1, 2""", "pred", LED)
def ledger_consistency(b):
    led = kept_ledger(b)
    return rounded(report.ledger_consistency(book.trades(led), led), ["accuracy", "total_pnl"])


@query("hourly_risk", f"""
    SELECT t.strategy, t.settlement_point, CAST(t.entry_hour AS INT) AS entry_hour, {r6('any_value(q.v)')} AS var_95, {r6('avg(pnl) FILTER (pnl <= q.v)')} AS cvar_95, {r6('min(pnl)')} AS max_loss, {r6('max(pnl)')} AS max_gain,
           {r6('stddev_samp(pnl)')} AS volatility, {r6('CASE WHEN count(*) >= 3 THEN CASE WHEN stddev_pop(pnl) > 1e-12 THEN skewness(pnl) ELSE 0 END END', 5)} AS skewness,
           {r6('CASE WHEN count(*) >= 4 THEN CASE WHEN stddev_pop(pnl) > 1e-12 THEN kurtosis(pnl) ELSE 0 END END', 5)} AS kurtosis,
           CASE WHEN count_if(pnl < 0) > 0 THEN {r6('coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0)')} ELSE CAST('Infinity' AS DOUBLE) END AS profit_factor
    FROM trd t JOIN (SELECT strategy, settlement_point, entry_hour, quantile_cont(pnl, 0.05) AS v FROM trd GROUP BY 1, 2, 3) q
      ON q.strategy = t.strategy AND q.settlement_point = t.settlement_point AND q.entry_hour = t.entry_hour GROUP BY 1, 2, 3""", "pred", LED)
def hourly_risk(b):
    r = rounded(report.hourly_risk(book.trades(kept_ledger(b))), ["var_95", "cvar_95", "max_loss", "max_gain", "volatility"])
    r = rounded(r, ["skewness", "kurtosis"], 5)
    return r.withColumn("profit_factor", F.when(F.col("profit_factor") < 1e300, rnd("profit_factor")).otherwise(F.col("profit_factor")))


@query("trade_detail", "SELECT strategy, settlement_point, entry_time, direction, pnl, capital_after, correct_prediction FROM trd WHERE entry_hour = 17", "pred", LED)
def trade_detail(b):
    t = trade_rows(b)
    return report.trade_detail([t], 17).select("strategy", "settlement_point", "entry_time", "direction", "pnl", "capital_after", "correct_prediction")


@query("portfolio_values", "SELECT strategy, settlement_point, utc_ts, CAST(end_hour AS INT) AS end_hour, CAST(capital_after AS DOUBLE) AS portfolio_value, CAST(week_num AS INT) AS week_num, FALSE AS has_position FROM led", "pred", LED)
def portfolio_values(b):
    return book.portfolio(ledger_rows(b))


_INV = "sign({0}) * (exp(abs({0})) - 1)"


@query("model_output_prices", f"""
    SELECT settlement_point, utc_ts, {r6(_INV.format('actual_dart_slt_raw'))} AS actual_price, {r6(_INV.format('p'))} AS predicted_price,
           {r6(_INV.format('p') + ' - ' + _INV.format('actual_dart_slt_raw'))} AS price_error
    FROM (SELECT *, (predicted_prob_class_1 - 0.5) * 4 AS p FROM pred)""", "pred")
def model_output_prices(b):
    from spreadlab.learning.scoring import price_columns

    p = b.predictions.withColumn("predicted_raw", (F.col("predicted_prob_class_1") - 0.5) * 4)
    out = price_columns(p, "actual_dart_slt_raw", "predicted_raw")
    return rounded(out.select("settlement_point", "utc_ts", "actual_price", "predicted_price", "price_error"), ["actual_price", "predicted_price", "price_error"])
