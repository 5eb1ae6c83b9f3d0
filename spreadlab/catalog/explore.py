"""Queries over the exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadlab.catalog.features import ZONES, _LATEST
from spreadlab.catalog.oracle_models import lloyd_ctes
from spreadlab.catalog.oracle_parts import r6, slt
from spreadlab.catalog.registry import query
from spreadlab.functions.columns import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW, rnd, signed_log
from spreadlab.operators import calendar, cluster, correlate, describe as ds, encode, moving, spectrum, vintage

PT = ["location", "location_type"]
_W = "PARTITION BY location, location_type"
from spreadlab.session import join_measured


def rounded(df, cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


def cal(b):
    """Spread rows with the weekday and hour of the local clock."""
    s = b.spread
    return s.withColumns({"day_of_week": F.weekday("local_ts"), "end_of_hour": F.hour("local_ts") + 1, "is_weekend": F.weekday("local_ts") >= 5})


CAL = "cal AS (SELECT *, CAST(isodow(local_ts) - 1 AS INT) AS day_of_week, CAST(hour(local_ts) + 1 AS INT) AS end_of_hour, isodow(local_ts) >= 6 AS is_weekend FROM spread)"


def _horner(coefs, x):
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return f"{out}"


def ppf_sql(p: str) -> str:
    q, r = f"({p} - 0.5::DOUBLE)", f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    t = f"sqrt(-2.0::DOUBLE * ln(least({p}, 1 - {p})))"
    tail = f"{_horner(PPF_C, t)} / {_horner(PPF_D + (1.0,), t)}"
    return f"(CASE WHEN {p} < {PPF_LOW} THEN {tail} WHEN {p} > {1 - PPF_LOW} THEN -({tail}) ELSE {q} * {_horner(PPF_A, r)} / {_horner(PPF_B + (1.0,), r)} END)"


def qq_sql(src: str, keys: str, value: str) -> str:
    """Fit of sorted values on normal quantiles, grouped by keys."""
    m = ("(CASE WHEN rn = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN rn = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) "
         "ELSE (rn - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END)")
    return f"""SELECT {keys}, count(*) AS n, regr_slope(v, q) AS slope, regr_intercept(v, q) AS intercept, corr(v, q) AS r FROM (
        SELECT {keys}, v, {ppf_sql('m')} AS q FROM (SELECT *, {m} AS m FROM (
            SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {keys}) AS n
            FROM {src} WHERE {value} IS NOT NULL))) GROUP BY {keys}"""


DIST = ("CAST(count({v}) AS BIGINT) AS n, " + r6("avg({v})") + " AS mean, " + r6("stddev_pop({v})") + " AS std, " + r6("min({v})") + " AS min, "
        + r6("max({v})") + " AS max, " + ", ".join(r6(f"quantile_cont({{v}}, {p})") + f" AS {n}" for n, p in ds.DISTRIBUTION_PROBS.items()))
BOX = ("CAST(count({v}) AS BIGINT) AS n, " + r6("avg({v})") + " AS mean, " + r6("stddev_samp({v})") + " AS std, " + r6("min({v})") + " AS min, "
       + r6("max({v})") + " AS max, " + ", ".join(r6(f"quantile_cont({{v}}, {p})") + f" AS {n}" for n, p in ds.QUARTILES.items())
       + ", " + r6("quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)") + " AS iqr")
DIST8, BOX8 = DIST.replace(", 6) +", ", 8) +"), BOX.replace(", 6) +", ", 8) +")
_DCOLS = ["mean", "std", "min", "max", *ds.DISTRIBUTION_PROBS]
_BCOLS = ["mean", "std", "min", "max", *ds.QUARTILES, "iqr"]
_LONG = "long AS (SELECT location, location_type, utc_ts, 'dart' AS variant, dart AS value FROM spread UNION ALL SELECT location, location_type, utc_ts, 'dart_slt', dart_slt FROM spread)"
_SIGNED = "signed AS (SELECT location, location_type, utc_ts, CASE WHEN dart_slt > 0 THEN 'positive' ELSE 'negative' END AS sign, abs(dart_slt) AS value FROM spread WHERE dart_slt <> 0)"


def variants(b):
    return ds.long_form(b.spread, [*PT, "utc_ts"], {"dart": "dart", "dart_slt": "dart_slt"}, "variant")


def signed(b):
    return ds.split_by_sign(b.spread, [*PT, "utc_ts"], "dart_slt")


@query("spread_series", f"SELECT location, location_type, utc_ts, variant, {r6('value')} AS value FROM long WHERE value IS NOT NULL", "spread", _LONG)
def spread_series(b):
    return rounded(variants(b).where("value is not null"), ["value"])


@query("distribution_stats", f"SELECT location, location_type, variant, {DIST.format(v='value')} FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3", "spread", _LONG)
def distribution_stats(b):
    return rounded(ds.distribution_stats(variants(b), [*PT, "variant"]), _DCOLS)


@query("box_stats", f"SELECT location, location_type, variant, {BOX.format(v='value')} FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3", "spread", _LONG)
def box_stats(b):
    return rounded(ds.box_stats(variants(b), [*PT, "variant"]), _BCOLS)


_QQ = f"CAST(n AS BIGINT) AS n, {r6('slope')} AS slope, {r6('intercept')} AS intercept, {r6('r')} AS r, {r6('r * r')} AS r_squared"
_QQ8 = _QQ.replace(", 6) +", ", 8) +")
_QCOLS = ["slope", "intercept", "r", "r_squared"]


@query("qq_fit", f"SELECT location, location_type, variant, {_QQ} FROM ({qq_sql('long', 'location, location_type, variant', 'value')})", "spread", _LONG)
def qq_fit(b):
    return rounded(ds.qq_fit(variants(b), [*PT, "variant"]), _QCOLS)


@query("bimodal_stats", f"SELECT location, location_type, sign, {DIST.format(v='value')} FROM signed GROUP BY 1, 2, 3 HAVING count(*) >= 5", "spread", _SIGNED)
def bimodal_stats(b):
    return rounded(ds.distribution_stats(signed(b), [*PT, "sign"], min_rows=5), _DCOLS)


@query("ecdf_by_sign", f"""
    SELECT location, location_type, sign, {r6('value')} AS value, CAST(rn AS BIGINT) AS cum_count, {r6('rn / n')} AS cum_prob FROM (
        SELECT *, row_number() OVER (PARTITION BY location, location_type, sign ORDER BY value) AS rn,
               count(*) OVER (PARTITION BY location, location_type, sign) AS n FROM signed)""", "spread", _SIGNED)
def ecdf_by_sign(b):
    return rounded(ds.ecdf(signed(b), [*PT, "sign"]), ["value", "cum_prob"])


@query("ecdf_stats", f"""
    SELECT location, location_type, sign, CAST(count(*) AS BIGINT) AS n, {r6('min(value)')} AS min, {r6('max(value)')} AS max,
           {r6('count(*) / any_value(t.n_total)')} AS proportion, {', '.join(r6(f'quantile_cont(value, {p})') + f' AS {n}' for n, p in ds.QUARTILES.items())}
    FROM signed JOIN (SELECT location, location_type, count(dart_slt) AS n_total FROM spread GROUP BY 1, 2) t USING (location, location_type)
    GROUP BY 1, 2, 3 HAVING count(*) >= 5""", "spread", _SIGNED)
def ecdf_stats(b):
    totals = b.spread.groupBy(*PT).agg(F.count("dart_slt").alias("n_total"))
    return rounded(ds.ecdf_stats(signed(b), PT, totals), ["min", "max", "proportion", *ds.QUARTILES])


_SLOT = (f"{r6('avg(dart_slt) FILTER (dart_slt > 0)')} AS positive_mean, {r6('stddev_samp(dart_slt) FILTER (dart_slt > 0)')} AS positive_std, "
         f"CAST(count(*) FILTER (dart_slt > 0) AS BIGINT) AS positive_count, {r6('avg(-dart_slt) FILTER (dart_slt < 0)')} AS negative_mean_abs, "
         f"{r6('stddev_samp(-dart_slt) FILTER (dart_slt < 0)')} AS negative_std_abs, CAST(count(*) FILTER (dart_slt < 0) AS BIGINT) AS negative_count")
_SCOLS = ["positive_mean", "positive_std", "negative_mean_abs", "negative_std_abs"]


def _slot_sql(slot: str, lo: int, hi: int) -> str:
    return f"""SELECT p.location, p.location_type, p.{slot}, {_SLOT} FROM (
        SELECT DISTINCT location, location_type, CAST(s AS INT) AS {slot} FROM cal, generate_series({lo}, {hi}) AS g(s)) p
        LEFT JOIN cal c ON c.location = p.location AND c.location_type = p.location_type AND c.{slot} = p.{slot} GROUP BY 1, 2, 3"""


@query("stats_by_weekday", _slot_sql("day_of_week", 0, 6), "spread", CAL)
def stats_by_weekday(b):
    return rounded(ds.signed_slot_stats(cal(b), PT, "dart_slt", "day_of_week", list(range(7))), _SCOLS)


@query("stats_by_hour", _slot_sql("end_of_hour", 1, 24), "spread", CAL)
def stats_by_hour(b):
    return rounded(ds.signed_slot_stats(cal(b), PT, "dart_slt", "end_of_hour", list(range(1, 25))), _SCOLS)


@query("sign_heatmap", f"""
    SELECT location, location_type, end_of_hour, day_of_week, CAST(count(*) AS BIGINT) AS sample_count, CAST(count_if(dart_slt > 0) AS BIGINT) AS positive_count,
           CAST(count_if(NOT dart_slt > 0) AS BIGINT) AS negative_count, {r6('count_if(dart_slt > 0) / count(*)')} AS positivity_rate,
           {r6('count_if(NOT dart_slt > 0) / count(*)')} AS negative_rate FROM cal WHERE dart_slt IS NOT NULL GROUP BY 1, 2, 3, 4""", "spread", CAL)
def sign_heatmap(b):
    return rounded(ds.sign_heatmap(cal(b), PT), ["positivity_rate", "negative_rate"])


@query("sign_heatmap_pivot", "SELECT location, location_type, CAST(h AS INT) AS end_of_hour, " + ", ".join(
    r6(f"avg(CAST(dart_slt > 0 AS INT)) FILTER (day_of_week = {d} AND end_of_hour = h AND dart_slt IS NOT NULL)") + f" AS dow_{d}" for d in range(7))
    + " FROM cal, generate_series(1, 24) AS g(h) GROUP BY 1, 2, 3", "spread", CAL)
def sign_heatmap_pivot(b):
    return rounded(ds.heatmap_pivot(ds.sign_heatmap(cal(b), PT), PT, "positivity_rate"), [f"dow_{d}" for d in range(7)])


@query("spread_heatmap", f"""
    SELECT location, location_type, end_of_hour, day_of_week, {r6('avg(dart)', 8)} AS mean, CAST(count(*) AS BIGINT) AS n, {r6('stddev_samp(dart)')} AS std,
           min(dart) AS min, max(dart) AS max FROM cal WHERE dart IS NOT NULL GROUP BY 1, 2, 3, 4""", "spread", CAL)
def spread_heatmap(b):
    return rounded(rounded(ds.spread_heatmap(cal(b), PT), ["mean"], 8), ["std"])


_SER = """
    ser AS (SELECT {k}, utc_ts, value, CAST(row_number() OVER (PARTITION BY {k} ORDER BY utc_ts) - 1 AS BIGINT) AS idx,
                   count(*) OVER (PARTITION BY {k}) AS n, epoch(utc_ts) - epoch(lag(utc_ts) OVER (PARTITION BY {k} ORDER BY utc_ts)) AS dt FROM ({src})),
    att AS (SELECT {k}, any_value(n) AS n, quantile_cont(dt, 0.5) AS step FROM ser GROUP BY ALL HAVING any_value(n) >= {min_rows}),
    freqs AS (SELECT *, unnest(generate_series(0, n // 2 - 1)) AS bin FROM att),
    spec AS (SELECT {k}, bin, n, step, pow(sum(value * cos(2 * pi() * ((bin * idx) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((bin * idx) % n) / n)), 2) AS mag
             FROM freqs JOIN ser USING ({k}, n) GROUP BY ALL),
    psd AS (SELECT {k}, bin, n, step, bin * 86400.0 / step / n AS freq_per_day, mag / n * CASE WHEN bin > 0 THEN 2 ELSE 1 END AS power FROM spec)"""
_DART = "SELECT location, location_type, utc_ts, dart_slt AS value FROM spread WHERE dart_slt IS NOT NULL"
_PK = "location, location_type"


def _psd_sql(keys: str) -> str:
    return f"SELECT {keys}, CAST(bin AS BIGINT) AS bin, {r6('freq_per_day')} AS freq_per_day, {r6('power', 5)} AS power, CAST(n AS BIGINT) AS n_samples FROM psd"


def _psd(spec, keys):
    return rounded(rounded(spec.select(*keys, "bin", "freq_per_day", "power", "n_samples"), ["freq_per_day"]), ["power"], 5)


@query("power_spectrum", _psd_sql(_PK), "spread", _SER.format(k=_PK, src=_DART, min_rows=2))
def power_spectrum(b):
    return _psd(spectrum.power_spectrum(b.spread, "dart_slt"), PT)


@query("power_spectrum_by_sign", _psd_sql(_PK + ", sign"), "spread", _SIGNED + ", " + _SER.format(k=_PK + ", sign", src="SELECT * FROM signed", min_rows=24))
def power_spectrum_by_sign(b):
    keys = [*PT, "sign"]
    return _psd(spectrum.power_spectrum(spectrum.by_sign(b.spread, "dart_slt"), "value", keys, min_rows=24), keys)


@query("sign_spectrum", _psd_sql(_PK), "spread", _SER.format(k=_PK, src="SELECT location, location_type, utc_ts, sign(dart_slt) AS value FROM spread WHERE dart_slt <> 0", min_rows=2))
def sign_spectrum(b):
    return _psd(spectrum.power_spectrum(spectrum.sign_series(b.spread, "dart_slt"), "value"), PT)


@query("spectral_peaks", f"""
    SELECT location, location_type, CAST(bin AS BIGINT) AS bin, {r6('freq_per_day')} AS freq_per_day, {r6('24.0 / freq_per_day')} AS period_hours, {r6('db', 4)} AS power_db,
           CAST(row_number() OVER ({_W} ORDER BY bin) AS BIGINT) AS rank FROM (
        SELECT *, quantile_cont(db, 0.85) OVER ({_W}) AS cut, max(db) OVER ({_W} ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM (
            SELECT *, 10 * log10(power + 1e-12) AS db FROM psd WHERE bin > 0)) WHERE db > cut AND db >= top""", "spread", _SER.format(k=_PK, src=_DART, min_rows=2))
def spectral_peaks(b):
    p = spectrum.spectral_peaks(spectrum.power_spectrum(b.spread, "dart_slt"))
    return rounded(rounded(p.select(*PT, "bin", "freq_per_day", "period_hours", "power_db", "rank"), ["freq_per_day", "period_hours"]), ["power_db"], 4)


_SPG = _SER.format(k=_PK, src=_DART, min_rows=168) + """,
    seg AS (SELECT a.location, a.location_type, least(168, a.n // 4) AS len, a.n, a.step,
                   unnest(generate_series(0, (a.n - least(168, a.n // 4)) // (least(168, a.n // 4) - least(168, a.n // 4) // 2))) AS segment FROM att a),
    rows_ AS (SELECT g.location, g.location_type, g.segment, g.len, g.step, s.idx - g.segment * (g.len - g.len // 2) AS pos, s.value,
                     avg(s.value) OVER (PARTITION BY g.location, g.location_type, g.segment) AS mu
              FROM seg g JOIN ser s ON s.location = g.location AND s.location_type = g.location_type
                   AND s.idx >= g.segment * (g.len - g.len // 2) AND s.idx < g.segment * (g.len - g.len // 2) + g.len),
    win AS (SELECT *, (value - mu) * (0.5 - 0.5 * cos(2 * pi() * pos / len)) AS y, pow(0.5 - 0.5 * cos(2 * pi() * pos / len), 2) AS ww FROM rows_),
    dens AS (SELECT location, location_type, segment, b.bin, len, step, (pow(sum(y * cos(2 * pi() * ((b.bin * pos) % len) / len)), 2) + pow(sum(y * sin(2 * pi() * ((b.bin * pos) % len) / len)), 2))
                    * step / sum(ww) * CASE WHEN b.bin = 0 OR (len % 2 = 0 AND b.bin = len // 2) THEN 1 ELSE 2 END AS power
             FROM win JOIN (SELECT unnest(generate_series(0, 84)) AS bin) b ON b.bin <= len // 2 GROUP BY location, location_type, segment, b.bin, len, step)"""


@query("spectrogram", f"""
    SELECT location, location_type, CAST(segment AS BIGINT) AS segment, CAST(bin AS BIGINT) AS bin, {r6('bin * 86400.0 / step / len')} AS freq_per_day,
           {r6('CASE WHEN bin > 0 THEN 10 * log10(power + 1e-12) END', 4)} AS power_db FROM dens""", "spread", _SPG)
def spectrogram(b):
    s = spectrum.spectrogram(b.spread, "dart_slt")
    s = s.withColumn("power_db", F.when(F.col("bin") > 0, F.col("power_db")))
    return rounded(rounded(s, ["freq_per_day"]), ["power_db"], 4)


@query("spectrogram_stats", f"""
    SELECT location, location_type, CAST(max(segment) + 1 AS BIGINT) AS time_windows, CAST(max(bin) + 1 AS BIGINT) AS frequency_bins,
           {r6('max(bin * 86400.0 / step / len)')} AS max_frequency, {r6('avg(10 * log10(power + 1e-12))', 4)} AS mean_power_db,
           {r6('max(10 * log10(power + 1e-12))', 4)} AS max_power_db FROM dens GROUP BY 1, 2""", "spread", _SPG)
def spectrogram_stats(b):
    s = spectrum.spectrogram_stats(spectrum.spectrogram(b.spread, "dart_slt"))
    return rounded(rounded(s, ["max_frequency"]), ["mean_power_db", "max_power_db"], 4)


@query("moving_window_stats", f"""
    SELECT location, location_type, utc_ts, n, {r6('m')} AS rolling_mean, {r6('s')} AS rolling_std, {r6('sk', 5)} AS rolling_skew, {r6('ku', 5)} AS rolling_kurtosis, {r6('pos')} AS positive_pct FROM (
        SELECT location, location_type, utc_ts, CAST(count(*) OVER w AS BIGINT) AS n, avg(dart_slt) OVER w AS m, stddev_samp(dart_slt) OVER w AS s, skewness(dart_slt) OVER w AS sk,
               kurtosis(dart_slt) OVER w AS ku, 100.0 * avg(CAST(dart_slt > 0 AS INT)) OVER w AS pos
        FROM spread WHERE dart_slt IS NOT NULL
        WINDOW w AS ({_W} ORDER BY utc_ts RANGE BETWEEN INTERVAL '167 hours 59 minutes 59 seconds' PRECEDING AND CURRENT ROW)) WHERE n >= 24""", "spread")
def moving_window_stats(b):
    m = moving.moving_window_stats(b.spread)
    return rounded(rounded(m, ["rolling_mean", "rolling_std", "positive_pct"]), ["rolling_skew", "rolling_kurtosis"], 5)


@query("rolling_autocorr", f"""
    SELECT location, location_type, utc_ts, CAST(n AS BIGINT) AS n, CAST(n_pairs AS BIGINT) AS n_pairs, {r6('r', 5)} AS autocorr FROM (
        SELECT a.location, a.location_type, a.utc_ts, a.n, count(*) AS n_pairs, corr(p.value, p.y) AS r
        FROM (SELECT *, count(*) OVER w AS n, min(rn) OVER w AS f FROM sr
              WINDOW w AS ({_W} ORDER BY utc_ts RANGE BETWEEN INTERVAL '167 hours 59 minutes 59 seconds' PRECEDING AND CURRENT ROW)) a
        JOIN (SELECT *, lag(value, 24) OVER ({_W} ORDER BY utc_ts) AS y FROM sr) p
          ON p.location = a.location AND p.location_type = a.location_type AND p.rn <= a.rn AND p.rn >= a.f + 24
        WHERE a.n >= 48 GROUP BY 1, 2, 3, 4)""", "spread", f"sr AS (SELECT *, row_number() OVER ({_W} ORDER BY utc_ts) AS rn FROM ({_DART}))")
def rolling_autocorr(b):
    return rounded(moving.rolling_autocorr(b.spread), ["autocorr"], 5)


_SGN = f"""sg AS (SELECT *, CASE WHEN dart_slt > 0 THEN 'Positive' ELSE 'Negative' END AS state FROM cal WHERE dart_slt IS NOT NULL),
    tr AS (SELECT *, lag(state) OVER ({_W} ORDER BY utc_ts) AS from_state FROM sg)"""


@query("sign_transitions", f"""
    SELECT location, location_type, from_state, state AS to_state, CAST(count(*) AS BIGINT) AS n,
           {r6('count(*) / sum(count(*)) OVER (PARTITION BY location, location_type, from_state)')} AS probability
    FROM tr WHERE from_state IS NOT NULL GROUP BY 1, 2, 3, 4""", "spread", CAL + ", " + _SGN)
def sign_transitions(b):
    return rounded(moving.sign_transitions(b.spread), ["probability"])


_RUNS = CAL + ", " + _SGN + f""", runs AS (SELECT location, location_type, state, island, count(*) AS run_length FROM (
        SELECT *, sum(CASE WHEN from_state IS NULL OR from_state <> state THEN 1 ELSE 0 END) OVER ({_W} ORDER BY utc_ts) AS island FROM tr) GROUP BY 1, 2, 3, 4)"""


@query("sign_run_lengths", f"""
    SELECT location, location_type, state, CAST(count(*) AS BIGINT) AS n_runs, {r6('avg(run_length)')} AS mean_run_length, CAST(max(run_length) AS BIGINT) AS max_run_length
    FROM runs GROUP BY 1, 2, 3""", "spread", _RUNS)
def sign_run_lengths(b):
    return rounded(moving.run_length_stats(moving.sign_runs(b.spread)), ["mean_run_length"])


@query("sign_run_histogram", "SELECT location, location_type, state, CAST(run_length AS BIGINT) AS run_length, CAST(count(*) AS BIGINT) AS n_runs FROM runs GROUP BY 1, 2, 3, 4", "spread", _RUNS)
def sign_run_histogram(b):
    return moving.run_length_histogram(moving.sign_runs(b.spread))


@query("sign_changes_by_hour", """
    SELECT location, location_type, CAST(h AS INT) AS end_of_hour, CAST(count_if(end_of_hour = h AND from_state <> state) AS BIGINT) AS n_changes
    FROM tr, generate_series(1, 24) AS g(h) GROUP BY 1, 2, 3""", "spread", CAL + ", " + _SGN)
def sign_changes_by_hour(b):
    return moving.sign_changes_by(cal(b), "end_of_hour", list(range(1, 25)))


@query("sign_changes_by_weekday", """
    SELECT location, location_type, CAST(d AS INT) AS day_of_week, CAST(count_if(day_of_week = d AND from_state <> state) AS BIGINT) AS n_changes
    FROM tr, generate_series(0, 6) AS g(d) GROUP BY 1, 2, 3""", "spread", CAL + ", " + _SGN)
def sign_changes_by_weekday(b):
    return moving.sign_changes_by(cal(b), "day_of_week", list(range(7)))


def _kmeans_rows(points, centres, keys):
    t = cluster.cluster_table(points, centres, keys)
    inertia = cluster.inertia_table(t, keys)
    return inertia.join(cluster.silhouette(points, centres, keys), [*keys, "k"], "left")


_KI = lloyd_ctes("spread", "dart_slt", _PK, 10, 10) + f""",
    pair AS (SELECT a.location, a.location_type, a.k, a.rn, a.i, z.i AS j, sum(abs(a.v - z.v)) AS s, count(*) AS m
             FROM asg a JOIN asg z ON z.location = a.location AND z.location_type = a.location_type AND z.k = a.k WHERE a.k > 1 GROUP BY ALL),
    sil AS (SELECT location, location_type, k, avg(CASE WHEN own = 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM (
            SELECT location, location_type, k, rn, max(m) FILTER (i = j) AS own, max(s) FILTER (i = j) / nullif(max(m) FILTER (i = j) - 1, 0) AS a, min(s / m) FILTER (i <> j) AS b FROM pair GROUP BY ALL) GROUP BY 1, 2, 3)"""


@query("kmeans_inertia", f"""
    SELECT location, location_type, CAST(k AS INT) AS k, {r6('inertia')} AS inertia, CAST(n_clusters AS BIGINT) AS n_clusters, {r6('silhouette')} AS silhouette FROM (
        SELECT location, location_type, k, sum(sse) AS inertia, count(*) AS n_clusters FROM (
            SELECT a.location, a.location_type, a.k, a.i, sum((a.v - c.v) * (a.v - c.v)) AS sse FROM asg a JOIN ctr c ON c.location = a.location AND c.location_type = a.location_type AND c.k = a.k AND c.i = a.i GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
    LEFT JOIN sil USING (location, location_type, k)""", "spread", _KI)
def kmeans_inertia(b):
    points, centres = cluster.kmeans_values(b.spread, "dart_slt", PT)
    return rounded(_kmeans_rows(points, centres, PT), ["inertia", "silhouette"])


def elbow_sql(curve: str, last_k: int) -> str:
    """The k farthest from the chord of every point's curve of k = 1 .. last_k."""
    return f"""
    SELECT location, location_type, CAST(greatest(2, arg_max(k, [d, -k])) AS INT) AS elbow_k, {r6('max(d)')} AS distance FROM (
        SELECT *, abs((y1 - y0) * x - y + y0) / sqrt((y1 - y0) * (y1 - y0) + 1) AS d FROM (
            SELECT *, first(y) OVER ({_W} ORDER BY k) AS y0, last(y) OVER ({_W} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y1 FROM (
                SELECT location, location_type, k, (k - 1) / {last_k - 1}.0::DOUBLE AS x, (inertia - min(inertia) OVER ({_W})) / (max(inertia) OVER ({_W}) - min(inertia) OVER ({_W})) AS y FROM {curve})))
    GROUP BY 1, 2"""


@query("kmeans_elbow", elbow_sql("kcurve", 10), "spread", lloyd_ctes("spread", "dart_slt", _PK, 10, 10) + """,
    kcurve AS (SELECT a.location, a.location_type, a.k, sum((a.v - c.v) * (a.v - c.v)) AS inertia FROM asg a JOIN ctr c ON c.location = a.location AND c.location_type = a.location_type AND c.k = a.k AND c.i = a.i GROUP BY 1, 2, 3)""")
def kmeans_elbow(b):
    """Elbow of the inertia curve of the clustered spreads of every point."""
    points, centres = cluster.kmeans_values(b.spread, "dart_slt", PT)
    curve = cluster.inertia_table(cluster.cluster_table(points, centres, PT), PT)
    return rounded(cluster.elbow_point(curve.select(*PT, "k", "inertia")), ["distance"])


@query("kmeans_by_sign", f"""
    SELECT location, location_type, sign, CAST(k AS INT) AS k, CAST(i AS INT) AS cluster, {r6('centre')} AS centre, CAST(size AS BIGINT) AS size, {r6('sse')} AS sse,
           {r6('size / sum(size) OVER (PARTITION BY location, location_type, sign, k)')} AS proportion FROM (
        SELECT a.location, a.location_type, a.sign, a.k, a.i, any_value(c.v) AS centre, count(*) AS size, sum((a.v - c.v) * (a.v - c.v)) AS sse
        FROM asg a JOIN ctr c ON c.location = a.location AND c.location_type = a.location_type AND c.sign = a.sign AND c.k = a.k AND c.i = a.i GROUP BY 1, 2, 3, 4, 5)""", "spread",
       _SIGNED + ", " + lloyd_ctes("signed", "value", _PK + ", sign", 10, 5))
def kmeans_by_sign(b):
    keys = [*PT, "sign"]
    points, centres = cluster.kmeans_values(signed(b), "value", keys, rows_per_k=5)
    return rounded(cluster.cluster_table(points, centres, keys), ["centre", "sse", "proportion"])


_FEATS = ["l_quantity", "l_discount", "l_tax", "p_retailprice"]


_ZS = [f"{c}_z" for c in _FEATS]


def _scaled(b, noise=False):
    """(kind, z columns): the scaled features, and their noise twin as a kind beside them."""
    f = b.features_by_hour.select(*_FEATS, "l_orderkey", "l_linenumber").withColumn("__all", F.lit(1))
    real = encode.zscore(f, _FEATS, ["__all"]).select(F.lit("real").alias("kind"), *_ZS)
    if not noise:
        return real
    twin = encode.noise_twin(f, _FEATS, F.col("l_orderkey") * 8 + F.col("l_linenumber"), ["__all"])
    return real.unionByName(twin.select(F.lit("noise").alias("kind"), *[F.col(f"{c}_n01_z").alias(f"{c}_z") for c in _FEATS]))


# SQL takes too long over the rounds of whole tables: tests hold the clustering against plain loops.
@query("kmeans_multivariate")
def kmeans_multivariate(b):
    """Inertia, silhouette and cluster sizes of the scaled features for k up to 10."""
    t = cluster.kmeans_vectors(_scaled(b), _ZS, list(range(1, 11)))
    sizes = F.array_join(F.transform("sizes", lambda n: n.cast("string")), ",")
    return t.select("k", "n_rows", rnd("inertia", 3).alias("inertia"), rnd("silhouette", 5).alias("silhouette"), sizes.alias("sizes"))


@query("kmeans_real_vs_noise")
def kmeans_real_vs_noise(b):
    """The curve of the features beside that of their noise twin, with the elbow of both."""
    t = cluster.kmeans_vectors(_scaled(b, noise=True), _ZS, list(range(1, 7)), ["kind"])
    elbow = cluster.elbow_point(t.select("kind", F.col("k"), "inertia"), ["kind"])
    return t.join(F.broadcast(elbow), "kind").select("kind", "k", "n_rows", rnd("inertia", 3).alias("inertia"), rnd("silhouette", 5).alias("silhouette"), "elbow_k", rnd("distance").alias("distance"))


_CURVE = """rngs AS (SELECT location, location_type, min(dart_slt) AS lo, max(dart_slt) AS hi FROM spread WHERE dart_slt IS NOT NULL GROUP BY 1, 2),
    binned AS (SELECT s.location, s.location_type, CAST(k AS INT) AS k, least(CAST(floor((s.dart_slt - r.lo) / ((r.hi - r.lo) / k)) AS INT), k - 1) AS bin, s.dart_slt AS v
               FROM spread s JOIN rngs r USING (location, location_type), generate_series(1, 6) AS g(k) WHERE s.dart_slt IS NOT NULL),
    curve AS (SELECT location, location_type, k, sum(sse) AS inertia FROM (SELECT location, location_type, k, bin, var_pop(v) * count(*) AS sse FROM binned GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


@query("elbow_point", elbow_sql("curve", 6), "spread", _CURVE)
def elbow_point(b):
    """Elbow of the within-bin squares of 1..6 equal-width bins, a curve SQL can reproduce."""
    s = b.spread.where("dart_slt is not null")
    rng = s.groupBy(*PT).agg(F.min("dart_slt").alias("lo"), F.max("dart_slt").alias("hi"))
    j = join_measured(s, rng, PT).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, 7)])))
    bin_ = F.least(F.floor((F.col("dart_slt") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("k"))).cast("int"), F.col("k") - 1)
    sse = j.groupBy(*PT, "k", bin_.alias("bin")).agg((F.var_pop("dart_slt") * F.count("*")).alias("sse"))
    return rounded(cluster.elbow_point(sse.groupBy(*PT, "k").agg(F.sum("sse").alias("inertia"))), ["distance"])


@query("feature_relation_by_hour", f"""
    WITH c AS (SELECT end_hour, isodow(utc_ts) >= 6 AS we, l_quantity AS x, y, l_quantity - avg(l_quantity) OVER (PARTITION BY end_hour) AS u FROM feats),
    g AS (SELECT end_hour, count(*) AS n, count_if(NOT we) AS nwd, count_if(we) AS nwe, avg(y) AS my, stddev_samp(y) AS sy, avg(x) AS mx, stddev_samp(x) AS sx, corr(x, y) AS r,
                 covar_pop(u, u) AS uu, covar_pop(u, u * u) AS uw, covar_pop(u * u, u * u) AS ww, covar_pop(u, y) AS uy, covar_pop(u * u, y) AS wy, var_pop(y) AS yy FROM c GROUP BY 1)
    SELECT end_hour, CAST(n AS BIGINT) AS n_points, CAST(nwd AS BIGINT) AS n_weekday, CAST(nwe AS BIGINT) AS n_weekend, {r6('my')} AS mean_y, {r6('sy')} AS std_y, {r6('mx')} AS mean_x,
           {r6('sx')} AS std_x, {r6('r')} AS correlation, {r6('r * r')} AS r2_linear, {r6('(uy * uy * ww - 2 * uy * wy * uw + wy * wy * uu) / (uu * ww - uw * uw) / yy')} AS r2_quadratic
    FROM g WHERE n >= 5""".replace("\n    WITH c", "SELECT * FROM (WITH c", 1) + ")", "feats")
def feature_relation_by_hour(b):
    f = b.features_by_hour.withColumn("is_weekend", F.weekday("utc_ts") >= 5).withColumn("__all", F.lit(1))
    out = correlate.feature_relation(f, "l_quantity", "y", ["__all"], hour="end_hour").drop("__all")
    return rounded(out, ["mean_y", "std_y", "mean_x", "std_x", "correlation", "r2_linear", "r2_quadratic"])


_FL = {c: c for c in _FEATS}
_FLONG = "fl AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, end_hour, utc_ts, y, '{c}' AS feature, {c} AS value FROM feats" for c in _FEATS) + ")"
_FBOTH = _FLONG + ", fb AS (SELECT feature, 'raw' AS variant, value FROM fl UNION ALL SELECT feature, 'slt', " + slt("value") + " FROM fl)"


def feature_long(b, keys=("l_orderkey", "l_linenumber", "end_hour", "utc_ts", "y")):
    return ds.long_form(b.features_by_hour, list(keys), _FL)


def feature_both(b):
    long = feature_long(b, ("end_hour",)).select("feature", "value")
    return long.withColumn("slt", signed_log("value")).unpivot(["feature"], ["value", "slt"], "variant", "v").select(
        "feature", F.when(F.col("variant") == "value", "raw").otherwise("slt").alias("variant"), F.col("v").alias("value"))


@query("feature_target_pairs", f"SELECT l_orderkey, l_linenumber, end_hour, feature, value, {r6('y')} AS y FROM fl", "feats", _FLONG)
def feature_target_pairs(b):
    return rounded(feature_long(b).drop("utc_ts"), ["y"])


@query("feature_distribution_stats", f"SELECT feature, variant, {DIST8.format(v='value')} FROM fb GROUP BY 1, 2", "feats", _FBOTH)
def feature_distribution_stats(b):
    return rounded(ds.distribution_stats(feature_both(b), ["feature", "variant"]), _DCOLS, 8)


@query("feature_box_stats", f"SELECT feature, variant, {BOX8.format(v='value')} FROM fb GROUP BY 1, 2", "feats", _FBOTH)
def feature_box_stats(b):
    return rounded(ds.box_stats(feature_both(b), ["feature", "variant"]), _BCOLS, 8)


@query("feature_qq_fit", f"SELECT feature, variant, {_QQ8} FROM ({qq_sql('fb', 'feature, variant', 'value')})", "feats", _FBOTH)
def feature_qq_fit(b):
    return rounded(ds.qq_fit(feature_both(b), ["feature", "variant"]), _QCOLS, 8)


@query("feature_histogram", f"""
    SELECT feature, CAST(bin AS INT) AS bin, {r6('any_value(lo + bin * (hi - lo) / 20)')} AS bin_start, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT feature, lo, hi, least(floor((value - lo) / ((hi - lo) / 20)), 19) AS bin FROM fl JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM fl GROUP BY 1) USING (feature))
    GROUP BY 1, 2""", "feats", _FLONG)
def feature_histogram(b):
    return rounded(ds.histogram(feature_long(b), ["feature"], bins=20), ["bin_start"])


_ZD = """SELECT feature, value AS v FROM fl WHERE NOT (value = 0 AND feature = 'l_discount')"""


@query("feature_distribution_summary", f"""
    SELECT a.feature, CAST(a.n_rows AS BIGINT) AS n_rows, CAST(a.n_present AS BIGINT) AS n_present, CAST(a.n_zero AS BIGINT) AS n_zero, CAST(k.n_used AS BIGINT) AS n_used,
           {r6('k.mean')} AS mean, {r6('k.std')} AS std, {r6('q.r * q.r')} AS r_squared
    FROM (SELECT feature, count(*) AS n_rows, count(value) AS n_present, count_if(value = 0) AS n_zero FROM fl GROUP BY 1) a
    JOIN (SELECT feature, count(*) AS n_used, avg(v) AS mean, stddev_samp(v) AS std FROM kept GROUP BY 1) k USING (feature)
    JOIN ({qq_sql('kept', 'feature', 'v')}) q USING (feature)""", "feats", _FLONG + f", kept AS ({_ZD})")
def feature_distribution_summary(b):
    out = ds.distribution_summary(feature_long(b), ["feature"], ignore_zeros=F.col("feature") == "l_discount")
    return rounded(out, ["mean", "std", "r_squared"])


@query("threshold_to_zero", "SELECT event_id, value, CASE WHEN value >= 1.0 THEN value ELSE 0 END AS thresholded FROM ev", "ev")
def threshold_to_zero(b):
    return b.events.select("event_id", "value", ds.threshold_to_zero("value").alias("thresholded"))


_CC = [*_FEATS, "y"]
_CORR = "corrs AS (" + " UNION ALL ".join(
    f"SELECT end_hour, '{a}' AS a, '{c}' AS b, count(*) AS n, corr({a}, {c}) AS r FROM feats GROUP BY 1" for a in _CC for c in _CC if a != c) + ")"


@query("correlation_matrix", f"""
    SELECT end_hour, a, b, CAST(n AS BIGINT) AS n, {r6('r')} AS r FROM corrs UNION ALL
    SELECT end_hour, c, c, CAST(n AS BIGINT), 1.0 FROM (SELECT end_hour, count(*) AS n FROM feats GROUP BY 1), (SELECT unnest({_CC!r}) AS c)""", "feats", _CORR)
def correlation_matrix(b):
    return rounded(correlate.correlation_matrix(b.features_by_hour, ["end_hour"], _CC), ["r"])


@query("top_correlations", f"""
    SELECT end_hour, feature, {r6('r')} AS r, CAST(rank AS INT) AS rank FROM (
        SELECT end_hour, b AS feature, r, row_number() OVER (PARTITION BY end_hour ORDER BY abs(r) DESC, b) AS rank FROM corrs WHERE a = 'y') WHERE rank <= 3""", "feats", _CORR)
def top_correlations(b):
    c = correlate.correlation_matrix(b.features_by_hour, ["end_hour"], _CC)
    return rounded(correlate.top_correlations(c, ["end_hour"], "y", 3), ["r"])


_NAMED = {"l_quantity": "load_forecast_coast", "l_discount": "solar_far_west", "l_tax": "solar_center_east", "p_retailprice": "wind_generation_west"}
_BYCAT = [(k, cs, "abs(l_discount) + abs(l_tax) <> 0" if k == "solar_nonzero" else "TRUE") for k, cs in
          {"load": ["l_quantity"], "wind": ["p_retailprice"], "solar": ["l_discount", "l_tax"], "solar_nonzero": ["l_discount", "l_tax"]}.items()]


@query("correlation_by_category", " UNION ALL ".join(
    f"SELECT '{k}' AS category, end_hour, '{_NAMED.get(a, a)}' AS a, '{_NAMED.get(c, c)}' AS b, CAST(count(*) AS BIGINT) AS n, {r6('1.0' if a == c else f'corr({a}, {c})')} AS r FROM feats WHERE {cut} GROUP BY 2"
    for k, cs, cut in _BYCAT for a in [*cs, "y"] for c in [*cs, "y"]), "feats")
def correlation_by_category(b):
    """One matrix per feature category with the target, and the solar one over rows with sun."""
    f = b.features_by_hour.withColumnsRenamed(_NAMED)
    out = None
    for k in ("load", "wind", "solar", "solar_nonzero"):
        cols = correlate.category_columns(f.columns, k.removesuffix("_nonzero"))
        rows = correlate.nonzero_rows(f, cols) if k.endswith("_nonzero") else f
        m = correlate.correlation_matrix(rows, ["end_hour"], [*cols, "y"]).withColumn("category", F.lit(k))
        out = m if out is None else out.unionByName(m)
    return rounded(out, ["r"])


@query("correlation_nonzero", f"""
    SELECT end_hour, CAST(count(*) AS BIGINT) AS n, {r6('corr(l_discount, y)')} AS r FROM feats WHERE abs(l_discount) + abs(l_tax) <> 0 GROUP BY 1""", "feats")
def correlation_nonzero(b):
    """Category correlations on rows where at least one category column is not zero."""
    kept = correlate.nonzero_rows(b.features_by_hour, ["l_discount", "l_tax"])
    m = correlate.correlation_matrix(kept, ["end_hour"], ["l_discount", "y"]).where("a = 'l_discount' and b = 'y'")
    return rounded(m.select("end_hour", "n", "r"), ["r"])


_CD = ("CAST(count_if(dart_slt <= 0) AS BIGINT) AS n_negative, CAST(count_if(dart_slt > 0) AS BIGINT) AS n_positive, "
       + r6("100.0 * count_if(dart_slt > 0) / count(*)") + " AS pct_positive, "
       + r6("CASE WHEN count_if(dart_slt > 0) > 0 THEN count_if(dart_slt <= 0) / count_if(dart_slt > 0) END") + " AS scale_pos_weight")


@query("class_distribution", f"""
    SELECT location, yr, hr, mon, {_CD} FROM (SELECT location, dart_slt, CAST(year(utc_ts) AS INT) AS yr, CAST(hour(utc_ts) + 1 AS INT) AS hr, CAST(month(utc_ts) AS INT) AS mon FROM spread WHERE dart_slt IS NOT NULL)
    GROUP BY GROUPING SETS ((location), (location, yr), (location, hr), (location, mon), (hr), ())""", "spread")
def class_distribution(b):
    s = b.spread.where("dart_slt is not null").select(
        "location", "dart_slt", F.year("utc_ts").alias("yr"), (F.hour("utc_ts") + 1).alias("hr"), F.month("utc_ts").alias("mon"))
    L, Y, H, M = (F.col(c) for c in ("location", "yr", "hr", "mon"))
    g = s.groupingSets([[L], [L, Y], [L, H], [L, M], [H], []], L, Y, H, M).agg(
        F.count_if(F.col("dart_slt") <= 0).alias("n_negative"), F.count_if(F.col("dart_slt") > 0).alias("n_positive"))
    return g.withColumns({
        "pct_positive": rnd(100.0 * F.col("n_positive") / (F.col("n_positive") + F.col("n_negative"))),
        "scale_pos_weight": rnd(F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive")))})
