"""SQL text shared by the oracle queries: the bindings of FIXTURES.md as CTEs."""

from __future__ import annotations

LOCAL = "timezone('America/Chicago', timezone('UTC', {0}))"


def slt(x: str) -> str:
    return f"(sign({x}) * ln(1 + abs({x})))"


def r6(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


_POINT = ("(CASE event_type WHEN 'error' THEN 'XX_' WHEN 'signup' THEN 'HB_' ELSE 'LZ_' END) || upper(event_type)")

# name -> (names it needs, body)
PARTS: dict[str, tuple[str, str]] = {
    "ev": ("", "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "raw_rt": ("ev", f"""
        SELECT CAST(ts AS DATE) AS deliveryDate, CAST(hour(ts) + 1 AS INT) AS deliveryHour, CAST(minute(ts) // 15 + 1 AS INT) AS deliveryInterval,
               {_POINT} AS settlementPoint, CASE WHEN event_type = 'signup' THEN 'HU' ELSE 'LZ' END AS settlementPointType,
               value AS settlementPointPrice, k >= 50 AS DSTFlag
        FROM ev"""),
    "raw_dam": ("ev", f"""
        SELECT CAST(ts AS DATE) AS deliveryDate, lpad(CAST(hour(ts) + 1 AS VARCHAR), 2, '0') || ':00' AS hourEnding,
               {_POINT} AS settlementPoint, avg(k) AS settlementPointPrice, FALSE AS DSTFlag
        FROM ev GROUP BY 1, 2, 3"""),
    "raw_lambda": ("ev", """
        SELECT CAST(ts AS DATE) AS deliveryDate, lpad(CAST(hour(ts) + 1 AS VARCHAR), 2, '0') || ':00' AS hourEnding,
               avg(k) AS systemLambda, FALSE AS DSTFlag
        FROM ev GROUP BY 1, 2"""),
    "raw_zones": ("", """
        SELECT l_shipdate AS postedDatetime, CAST(l_shipdate AS DATE) + CAST(l_linenumber % 4 AS INT) AS deliveryDate,
               lpad(CAST(l_orderkey % 24 + 1 AS VARCHAR), 2, '0') || ':00' AS hourEnding,
               l_quantity AS coast, l_extendedprice AS east, CASE WHEN l_discount > 0 THEN l_discount END AS north, l_tax AS west,
               CASE WHEN l_returnflag <> 'R' THEN l_linestatus = 'F' END AS inUseFlag, l_orderkey % 2 = 0 AS DSTFlag
        FROM lineitem"""),
    "local_hours": ("", """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS deliveryDate,
               lpad(CAST(o_orderkey % 24 + 1 AS VARCHAR), 2, '0') || ':00' AS hourEnding, o_orderkey % 2 = 0 AS DSTFlag
        FROM orders"""),
    "rt15": ("ev", f"""
        SELECT utc_ts, {LOCAL.format('utc_ts')} AS local_ts, location, 'LZ' AS location_type, price FROM (
            SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS utc_ts, 'LZ_' || upper(event_type) AS location, avg(value) AS price
            FROM ev GROUP BY 1, 2)"""),
    "rth": ("rt15", f"""
        SELECT date_trunc('hour', utc_ts) AS utc_ts, date_trunc('hour', local_ts) AS local_ts, location, location_type,
               {r6('avg(price)')} AS price_mean, {r6('stddev_samp(price)')} AS price_std,
               hour(date_trunc('hour', local_ts)) AS hour_local
        FROM rt15 GROUP BY 1, 2, 3, 4, 7"""),
    "damh": ("ev", f"""
        SELECT date_trunc('hour', ts) + INTERVAL 1 DAY AS utc_ts, 'LZ_' || upper(event_type) AS location, {r6('avg(k)')} AS price
        FROM ev GROUP BY 1, 2"""),
    "spread": ("rth damh", f"""
        SELECT *, {slt('dart')} AS dart_slt FROM (
            SELECT r.utc_ts, r.local_ts, r.location, r.location_type, r.price_mean AS rt_spp_price, r.price_std, r.hour_local,
                   d.price AS dam_spp_price, {r6('r.price_mean - d.price')} AS dart
            FROM rth r LEFT JOIN damh d ON r.utc_ts = d.utc_ts AND r.location = d.location)"""),
    "vint": ("ev", """
        SELECT ts AS posted_datetime,
               date_trunc('hour', ts) + to_days(CAST(user_id % 4 AS INT)) + to_hours(k % 24) AS utc_ts,
               event_type AS location, value, event_id FROM ev"""),
    "daily": ("", f"""
        SELECT o_orderdate AS utc_ts, o_orderpriority AS location, {r6('avg(o_totalprice)', 4)} AS price
        FROM orders GROUP BY 1, 2"""),
    "pred": ("spread", f"""
        SELECT utc_ts, local_ts, CAST(hour(utc_ts) + 1 AS INT) AS end_hour, location AS settlement_point,
               CAST(dart > 0 AS INT) AS actual_dart_slt, dart_slt AS actual_dart_slt_raw,
               CAST(p1 > 0.5 AS INT) AS predicted_dart_slt, {r6('1 - p1')} AS predicted_prob_class_0, p1 AS predicted_prob_class_1,
               greatest({r6('1 - p1')}, p1) AS prediction_confidence, CAST(week(utc_ts) AS INT) AS week_num
        FROM (SELECT *, {r6('greatest(least(dam_spp_price / 100, 1.0), 0.0)')} AS p1 FROM spread WHERE dart IS NOT NULL)"""),
    "feats": ("", f"""
        SELECT CAST(l_orderkey % 24 + 1 AS INT) AS end_hour, l_shipdate AS utc_ts, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
               l_extendedprice, p_retailprice, {slt('l_extendedprice')} AS y
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
}


def compose(uses: list[str], ctes: str, body: str) -> str:
    """WITH clause holding the needed parts in dependency order, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in PARTS[name][0].split():
            visit(dep)
        order.append(name)

    for u in uses:
        visit(u)
    blocks = [f"{n} AS ({PARTS[n][1].strip()})" for n in order]
    if ctes.strip():
        blocks.append(ctes.strip().rstrip(","))
    recursive = "RECURSIVE " if any(b.lstrip().startswith("lloyd AS") or ", lloyd AS" in b for b in blocks) else ""
    return (f"WITH {recursive}{', '.join(blocks)} " if blocks else "") + body.strip()
