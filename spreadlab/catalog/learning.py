"""Queries over folds, models, metrics, bootstraps and importance tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadlab.catalog.explore import rounded
from spreadlab.catalog.features import _LATEST, ZONES, normal_sql, uniform_sql
from spreadlab.catalog.oracle_models import gauss_ctes, lasso_ctes, moments_cte, resample_ctes
from spreadlab.catalog.oracle_parts import r6
from spreadlab.catalog.registry import query
from spreadlab.functions.columns import rnd
from spreadlab.learning import bootstrap, folds, importance, linear, metrics, scoring, selection, targets, trees
from spreadlab.operators import describe, encode, vintage
from spreadlab.session import join_measured, written
from spreadlab.sources import tables

FEATS = ["l_quantity", "l_discount", "l_tax", "p_retailprice"]
START = "1996-01-01"


def row_id():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


ROWSQL = "l_orderkey * 8 + l_linenumber"


def feats(b):
    return b.features_by_hour


# --- folds and targets -------------------------------------------------------------------------


@query("year_split", """
    SELECT split, CAST(count(*) AS BIGINT) AS n_rows, min(utc_ts) AS first_ts, max(utc_ts) AS last_ts FROM (
        SELECT utc_ts, CASE year(utc_ts) WHEN 1998 THEN 'train' WHEN 1999 THEN 'validation' ELSE 'ignore' END AS split FROM daily) GROUP BY 1""", "daily")
def year_split(b):
    return folds.year_split(b.daily, 1998, 1999).groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min("utc_ts").alias("first_ts"), F.max("utc_ts").alias("last_ts"))


_WEEKS = f"""first_ AS (SELECT CAST(DATE '{START}' + CAST((7 - isodow(DATE '{START}')) AS INT) AS DATE) AS d0),
    wks AS (SELECT i AS week_num, CAST(d0 + CAST((i - 1) * 7 AS INT) AS DATE) AS sunday FROM first_, (SELECT unnest(generate_series(1, 2000)) AS i), (SELECT max(utc_ts) AS hi FROM daily)
            WHERE CAST(d0 + CAST((i - 1) * 7 + 6 AS INT) AS TIMESTAMP) <= hi)"""


@query("operational_weeks", """
    SELECT CAST(week_num AS INT) AS week_num, strftime(sunday, '%b %d') || ' - ' || strftime(sunday + 6, '%b %d, %Y') AS week_description, strftime(sunday - 1, '%Y-%m-%d') AS train_end_date,
           strftime(sunday, '%Y-%m-%d') AS val_start_date, strftime(sunday + 6, '%Y-%m-%d') AS val_end_date FROM wks""", "daily", _WEEKS)
def operational_weeks(b):
    w = folds.operational_weeks(b.daily, START)
    return w.withColumns({c: F.col(c).cast("string") for c in ("train_end_date", "val_start_date", "val_end_date")})


@query("walk_forward_folds", """
    SELECT CAST(week_num AS INT) AS week_num, CAST(count_if(utc_ts < sunday) AS BIGINT) AS n_train, CAST(count_if(utc_ts >= sunday AND utc_ts < sunday + 7) AS BIGINT) AS n_validation
    FROM wks, daily GROUP BY 1""", "daily", _WEEKS)
def walk_forward_folds(b):
    f = folds.assign_folds(b.daily, START)
    return folds.fold_sizes(f, folds.operational_weeks(b.daily, START)).select("week_num", "n_train", "n_validation")


@query("walk_forward_folds_midnight_cut", """
    SELECT CAST(week_num AS INT) AS week_num, CAST(count_if(utc_ts <= CAST(sunday AS TIMESTAMP) - INTERVAL 1 DAY) AS BIGINT) AS n_train,
           CAST(count_if(utc_ts >= sunday AND utc_ts < sunday + 7) AS BIGINT) AS n_validation
    FROM wks, vint2 GROUP BY 1""", "daily", _WEEKS + ", vint2 AS (SELECT utc_ts + to_hours(CAST(length(location) % 24 AS INT)) AS utc_ts FROM daily)")
def walk_forward_folds_midnight_cut(b):
    shifted = b.daily.withColumn("utc_ts", F.col("utc_ts") + F.make_dt_interval(hours=F.length("location") % 24))
    f = folds.assign_folds(shifted, START, midnight_cut=True)
    return folds.fold_sizes(f, folds.operational_weeks(b.daily, START)).select("week_num", "n_train", "n_validation")


@query("train_only_zscore", "SELECT location, utc_ts, " + r6("(price - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END") + """ AS price_z
    FROM daily JOIN (SELECT location, avg(price) AS m, stddev_samp(price) AS s FROM daily WHERE year(utc_ts) = 1998 GROUP BY 1) USING (location)""", "daily")
def train_only_zscore(b):
    z = targets.train_zscore(b.daily, ["price"], ["location"], F.year("utc_ts") == 1998)
    return z.select("location", "utc_ts", rnd("price_z").alias("price_z"))


@query("target_classes", """
    SELECT utc_ts, location, CAST(dart_slt > 0 AS INT) AS sign_only, CAST(abs(dart_slt) > 2 AS INT) AS beyond, CASE WHEN dart_slt < -2.5 THEN 0 WHEN dart_slt > 2.5 THEN 2 WHEN dart_slt IS NOT NULL THEN 1 END AS bimodal,
           CASE WHEN dart <= -12 THEN 0 WHEN dart <= -5 THEN 1 WHEN dart <= 5 THEN 2 WHEN dart <= 12 THEN 3 WHEN dart IS NOT NULL THEN 4 END AS manual,
           CASE WHEN dart IS NOT NULL THEN CAST(dart > -25 AS INT) + CAST(dart > 0 AS INT) + CAST(dart > 35 AS INT) END AS midpoints FROM spread""", "spread")
def target_classes(b):
    centres = F.array(F.lit(-10.0), F.lit(60.0), F.lit(10.0), F.lit(-40.0))
    return b.spread.select(
        "utc_ts", "location", targets.sign_class("dart_slt").alias("sign_only"), targets.threshold_class("dart_slt", 2.0).alias("beyond"),
        targets.bimodal_class("dart_slt", -2.5, 2.5).alias("bimodal"), targets.manual_class("dart", [-12, -5, 5, 12]).alias("manual"),
        targets.kmeans_class("dart", centres).alias("midpoints"))


_WEEKSPLIT = "CASE WHEN week_num <= 3 THEN 'train' ELSE 'validation' END"


@query("class_share", f"""
    SELECT split, cls, CAST(n AS BIGINT) AS n, {r6('n / sum(n) OVER (PARTITION BY split)')} AS share FROM (
        SELECT {_WEEKSPLIT} AS split, actual_dart_slt AS cls, count(*) AS n FROM pred GROUP BY 1, 2)""", "pred")
def class_share(b):
    p = b.predictions.withColumn("split", F.when(F.col("week_num") <= 3, "train").otherwise("validation"))
    return rounded(metrics.class_share(p, ["split"], "actual_dart_slt"), ["share"])


# --- linear models -----------------------------------------------------------------------------


def _fit_sql(xs, digits=5):
    parts = [f"SELECT end_hour, '{x}' AS feature, {r6(f'w{i}', digits)} AS coefficient, CAST(n AS BIGINT) AS n FROM fit" for i, x in enumerate(xs)]
    return " UNION ALL ".join(parts + [f"SELECT end_hour, '(intercept)', {r6('wi', digits)}, CAST(n AS BIGINT) FROM fit"])


@query("ols_per_hour", _fit_sql(FEATS), "feats", gauss_ctes(FEATS))
def ols_per_hour(b):
    return rounded(linear.fit_linear(feats(b), ["end_hour"], FEATS, "y").drop("alpha", "r2", "gap"), ["coefficient"], 5)


@query("ridge_per_hour", _fit_sql(FEATS), "feats", gauss_ctes(FEATS, 10.0))
def ridge_per_hour(b):
    return rounded(linear.fit_linear(feats(b), ["end_hour"], FEATS, "y", "ridge", [10.0]).drop("alpha", "r2", "gap"), ["coefficient"], 5)


ALPHAS = [0.001, 0.01, 0.1]
_LAS = moments_cte("g0", "feats", FEATS, "y", "end_hour") + ", gv AS (SELECT end_hour, var_pop(y) AS vy FROM feats GROUP BY 1), " + lasso_ctes(FEATS, ALPHAS, 8) + """,
    lr AS (SELECT las.*, (2 * ({}) - ({})) / vy AS r2 FROM las JOIN gv USING (end_hour))""".format(
    " + ".join(f"w{i} * c{i}_4" for i in range(4)), " + ".join(f"w{i} * w{j} * c{i}_{j}" for i in range(4) for j in range(4)))


@query("lasso_per_hour", " UNION ALL ".join(
    f"SELECT end_hour, alpha, '{n}' AS feature, {r6(w)} AS coefficient, CAST(n AS BIGINT) AS n, {r6('r2')} AS r2 FROM lr" for n, w in [*((f, f"w{i}") for i, f in enumerate(FEATS)), ("(intercept)", "wi")]), "feats", _LAS)
def lasso_per_hour(b):
    return rounded(linear.fit_linear(feats(b), ["end_hour"], FEATS, "y", "lasso", ALPHAS).drop("gap"), ["coefficient", "r2"])


_ZEROED = " + ".join(f"CAST(abs(w{i}) <= 1e-12 AS INT)" for i in range(4))


@query("lasso_sparsity", f"""
    SELECT end_hour, alpha, CAST(4 - ({_ZEROED}) AS BIGINT) AS n_selected, CAST({_ZEROED} AS BIGINT) AS n_zeroed, {r6(f'({_ZEROED}) / 4.0')} AS sparsity_ratio, {r6('r2')} AS r2 FROM lr""", "feats", _LAS)
def lasso_sparsity(b):
    c = linear.fit_linear(feats(b), ["end_hour"], FEATS, "y", "lasso", ALPHAS)
    return rounded(linear.sparsity(c, ["end_hour", "alpha"]), ["sparsity_ratio", "r2"])


_STAB = (resample_ctes("rw", "feats", "end_hour", ROWSQL, uniform_sql, 10, [*FEATS, "y"]) + ", "
         + moments_cte("g0", "rw", FEATS, "y", "end_hour, replicate", "w") + ", " + lasso_ctes(FEATS, [0.01], 8))


@query("selection_stability", " UNION ALL ".join(f"""
    SELECT end_hour, '{f}' AS feature, {r6(f'avg(CAST(abs(w{i}) > 1e-12 AS INT))')} AS frequency, CAST(count(*) AS BIGINT) AS n_replicates, avg(CAST(abs(w{i}) > 1e-12 AS INT)) > 0.5 AS stable FROM las GROUP BY 1""" for i, f in enumerate(FEATS)), "feats", _STAB)
def selection_stability(b):
    return rounded(linear.selection_stability(feats(b), ["end_hour"], FEATS, "y", row_id(), 0.01, 10), ["frequency"])


TRUTH = dict(zip(FEATS, [1.0, 2.0, 3.0, -1.0]))
_REC = "zf AS (SELECT *, " + " + ".join(f"{t} * z_{c}" for c, t in TRUTH.items()) + f" + 0.1 * {normal_sql(ROWSQL, 7)} AS synthetic FROM (SELECT *, " + ", ".join(
    f"({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w AS z_{c}" for c in FEATS) + " FROM feats WINDOW w AS (PARTITION BY end_hour))), " + gauss_ctes([f"z_{c}" for c in FEATS], src="zf", y="synthetic")


@query("coefficient_recovery", " UNION ALL ".join(f"""
    SELECT end_hour, '{c}_z' AS feature, {r6(f'w{i}', 4)} AS coefficient, CAST({t} AS DOUBLE) AS truth, abs(w{i} - {t}) < 0.05 AS recovered FROM fit""" for i, (c, t) in enumerate(TRUTH.items())), "feats", _REC)
def coefficient_recovery(b):
    """Known coefficients on the real feature rows plus small noise come back from the fit."""
    f = encode.zscore(feats(b), FEATS, ["end_hour"])
    y = 0.1 * encode.standard_normal(row_id(), 7)
    for c, t in TRUTH.items():
        y = y + t * F.col(f"{c}_z")
    fit = linear.fit_linear(f.withColumn("synthetic", y), ["end_hour"], [f"{c}_z" for c in FEATS], "synthetic")
    known = F.create_map(*[x for c, t in TRUTH.items() for x in (F.lit(f"{c}_z"), F.lit(t))])
    return fit.where(F.col("feature") != linear.INTERCEPT).select(
        "end_hour", "feature", rnd("coefficient", 4).alias("coefficient"), known[F.col("feature")].alias("truth")).withColumn(
        "recovered", F.abs(F.col("coefficient") - F.col("truth")) < 0.05)


_COLS = [*FEATS, "y"]
_SHIFT = dict(zip(_COLS, (25.0, 0.05, 0.04, 1500.0, 10.0)))
_OFF = lambda c: f"({c} - {_SHIFT[c]}::DOUBLE)"
_PAIRS = [(i, j) for i in range(4) for j in range(5)]
_PREDICT = lambda rows, fit: f"{fit}.wi + " + " + ".join(f"{fit}.w{i} * {rows}.{c}" for i, c in enumerate(FEATS))
_WFW = f"""first_ AS (SELECT CAST(DATE '{START}' + CAST((7 - isodow(DATE '{START}')) AS INT) AS DATE) AS d0),
    wk AS (SELECT f.*, CASE WHEN utc_ts >= d0 THEN (CAST(utc_ts AS DATE) - d0) // 7 + 1 END AS val_week,
                  CASE WHEN utc_ts >= d0 THEN (CAST(utc_ts AS DATE) - d0) // 7 + 2 ELSE 1 END AS first_train_week FROM feats f, first_),
    nw AS (SELECT (CAST(max(utc_ts) AS DATE) - 6 - any_value(d0)) // 7 + 1 AS k FROM feats, first_),
    inc AS (SELECT end_hour, first_train_week AS w, count(*) AS n, {", ".join(f"sum({_OFF(c)}) AS s{i}" for i, c in enumerate(_COLS))},
                   {", ".join(f"sum({_OFF(_COLS[i])} * {_OFF(_COLS[j])}) AS p{i}_{j}" for i, j in _PAIRS)} FROM wk GROUP BY 1, 2),
    sp AS (SELECT h.end_hour, w FROM (SELECT DISTINCT end_hour FROM feats) h, (SELECT unnest(generate_series(1, k)) AS w FROM nw)),
    cum AS (SELECT end_hour, w, sum(n) OVER o AS n, {", ".join(f"sum(s{i}) OVER o AS s{i}" for i in range(5))}, {", ".join(f"sum(p{i}_{j}) OVER o AS p{i}_{j}" for i, j in _PAIRS)}
            FROM sp LEFT JOIN inc USING (end_hour, w) WINDOW o AS (PARTITION BY end_hour ORDER BY w ROWS UNBOUNDED PRECEDING)),
    wm AS (SELECT end_hour, w, n, {", ".join(f"s{i} / n + {_SHIFT[c]}::DOUBLE AS m_{i}" for i, c in enumerate(_COLS))}, {", ".join(f"p{i}_{j} / n - s{i} / n * s{j} / n AS c{i}_{j}" for i, j in _PAIRS)} FROM cum WHERE n > 1),
    """ + gauss_ctes(FEATS, keys="end_hour, w", moments="wm", name="wf")


@query("walk_forward_predictions", f"""
    SELECT wk.end_hour, l_orderkey, l_linenumber, CAST(val_week AS INT) AS week_num, {r6(_PREDICT('wk', 'wf'), 5)} AS prediction
    FROM wk JOIN wf ON wf.end_hour = wk.end_hour AND wf.w = wk.val_week""", "feats", _WFW)
def walk_forward_predictions(b):
    f = feats(b)
    p = linear.walk_forward_linear(f, ["end_hour"], FEATS, "y", folds.operational_weeks(f, START), START)
    return rounded(p.select("end_hour", "l_orderkey", "l_linenumber", "week_num", "prediction"), ["prediction"], 5)


# --- boosted models ----------------------------------------------------------------------------
# SQL cannot grow trees: tests/test_trees.py holds fits, scores and tables against a plain version that tries every split.


def _labelled(b, label):
    return feats(b).withColumns({"label_": label, "split": F.when(F.year("utc_ts") < 2000, "train").otherwise("validation")})


def _expensive():
    return (F.col("l_extendedprice") > 40000).cast("int")


def _classifier(b):
    """Tuned classifiers of every hour, fitted on the training years, and all rows."""
    rows = _labelled(b, _expensive()).withColumn("weight_", F.when(F.col("label_") == 1, selection.TUNED_PRESET["scale_pos_weight"]).otherwise(1.0))
    spec = trees.Spec.of_preset(selection.TUNED_PRESET, objective="logistic")
    return rows, trees.fit(rows.where("split = 'train'"), ["end_hour"], FEATS, "label_", row_id(), spec, "weight_")


@query("gbt_regression")
def gbt_regression(b):
    """Boosted regression of every hour: R2 and errors on the training and the later years."""
    rows = _labelled(b, F.col("y"))
    spec = trees.Spec("squared", trees=100, depth=6, rate=0.1, subsample=0.8, columns=0.8)
    out = trees.fit(rows.where("split = 'train'"), ["end_hour"], FEATS, "label_", row_id(), spec).predict(rows)
    m = metrics.regression_metrics(out, ["end_hour", "split"], "label_", "prediction")
    return rounded(m.select("end_hour", "split", F.col("n").cast("long").alias("n"), "r2", "mae", "rmse"), ["r2", "mae", "rmse"])


def _class_scores(out, keys):
    m = metrics.classification_metrics(metrics.confusion(out.where("predicted_class is not null"), keys, "label_", "predicted_class"), keys)
    return rounded(m.select(*keys, "total_predictions", "accuracy", "precision", "recall", "f1"), ["accuracy", "precision", "recall", "f1"])


@query("gbt_classification")
def gbt_classification(b):
    """Accuracy, precision, recall and F1 of the tuned classifier per hour and split, with the share of the larger class."""
    rows, forest = _classifier(b)
    scores = _class_scores(forest.predict(rows), ["end_hour", "split"])
    share = rows.groupBy("end_hour", "split").agg(rnd(F.greatest(F.avg("label_"), 1 - F.avg("label_"))).alias("majority"))
    return scores.join(share, ["end_hour", "split"])


@query("gbt_multiclass")
def gbt_multiclass(b):
    """Softmax boosting of three price classes: scores per hour and split."""
    rows = _labelled(b, targets.manual_class("l_extendedprice", [20000.0, 40000.0]))
    spec = trees.Spec("softmax", classes=3, trees=20, depth=4, rate=0.3, subsample=0.8)
    forest = trees.fit(rows.where("split = 'train'"), ["end_hour"], FEATS, "label_", row_id(), spec)
    return _class_scores(forest.predict(rows), ["end_hour", "split"])


@query("score_predictions")
def score_predictions(b):
    """Every row through the classifier of its hour: class, both chances and the confidence beside the truth."""
    rows, forest = _classifier(b)
    out = forest.predict(rows).select("end_hour", "l_orderkey", "l_linenumber", "split", F.col("label_").alias("actual"), F.col("y").alias("actual_raw"), "predicted_class", "predicted_prob_class_0", "predicted_prob_class_1", "prediction_confidence")
    return rounded(out, ["actual_raw", "predicted_prob_class_0", "predicted_prob_class_1", "prediction_confidence"])


@query("model_complexity")
def model_complexity(b):
    """Trees, nodes, leaves, depth and split-gain importances of every hour's classifier."""
    _, forest = _classifier(b)
    nodes = forest.table(b.spark)
    imp = trees.importances(nodes, ["end_hour"], FEATS)
    wide = imp.groupBy("end_hour").pivot("feature", FEATS).agg(rnd(F.first("importance")))
    return trees.complexity(nodes, ["end_hour"]).join(wide.withColumnsRenamed({f: f"importance_{f}" for f in FEATS}), "end_hour").withColumn("complexity", rnd("complexity"))


@query("boosted_cross_hour")
def boosted_cross_hour(b):
    """Cross-hour tables on fitted classifiers, one row per (measure, name): top features, categories, stability, similarity, complexity."""
    _, forest = _classifier(b)
    nodes = written(forest.table(b.spark))
    named = F.create_map(*[x for c, n in NAMES.items() for x in (F.lit(c), F.lit(n))])
    imp = written(trees.importances(nodes, ["end_hour"], FEATS).withColumn("feature", named[F.col("feature")]))
    top, size = importance.ranked(imp, ["end_hour"], 3), trees.complexity(nodes, ["end_hour"])
    text = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    row = lambda d, measure, name, value: d.select(F.lit(measure).alias("measure"), name.alias("name"), rnd(value).alias("value"))
    trend = importance.complexity_trend(size)
    return tables.union_all([
        row(top, "top_rank", text("end_hour", "feature"), F.col("rank")),
        row(importance.importance_by_category(imp, ["end_hour"]), "category_importance", text("end_hour", "category"), F.col("importance")),
        row(importance.consistent_features(top), "consistency_score", text("feature"), F.col("consistency_score")),
        row(importance.hour_similarity(top), "hour_similarity", text("hour_a", "hour_b"), F.col("similarity")),
        row(importance.feature_stability(top), "feature_stability", text("feature"), F.col("stability")),
        row(importance.complexity_by_period(size), "period_complexity", text("period"), F.col("mean_complexity")),
        row(trend, "complexity_trend", F.lit("slope"), F.col("trend_slope")),
        row(trend, "complexity_trend", F.lit("most_complex_hour"), F.col("most_complex_hour")),
        row(trend, "complexity_trend", F.lit("least_complex_hour"), F.col("least_complex_hour")),
    ])


@query("boosted_noise_stability")
def boosted_noise_stability(b):
    """Agreement of the classifiers with themselves on training rows with 1, 5 and 10 percent noise."""
    rows, forest = _classifier(b)
    train = rows.where("split = 'train'")
    sd = train.groupBy("end_hour").agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in FEATS])
    keys, levels = ["end_hour", "l_orderkey", "l_linenumber"], [0.0, 0.01, 0.05, 0.1]
    # A row draws its noise once and is scored at all levels side by side, so that it is shuffled once and not once a level.
    noisy = join_measured(train.select(*keys, *FEATS), sd, ["end_hour"]).withColumns({f"draw_{c}": encode.standard_normal(row_id(), 40 + i) for i, c in enumerate(FEATS)})
    moved = lambda c, level: F.col(c) + F.lit(level) * F.coalesce(f"sd_{c}", F.lit(0.0)) * F.col(f"draw_{c}")
    out = forest.margins_of(noisy, {f"m{i}": [moved(c, level) for c in FEATS] for i, level in enumerate(levels)}).withColumns({f"s{i}": forest.chances(f"m{i}") for i in range(len(levels))})
    out = written(out.select(*keys, *[F.struct(F.lit(level).alias("level"), trees.likeliest(f"s{i}").alias("predicted_class"), F.get(f"s{i}", 1).alias("predicted_prob_class_1")).alias(f"at{i}") for i, level in enumerate(levels)]))
    base = out.select(*keys, F.col("at0.predicted_class").alias("c"), F.col("at0.predicted_prob_class_1").alias("p"))
    both = out.drop("at0").join(base, keys).select("end_hour", "c", "p", F.inline(F.array(*[f"at{i}" for i in range(1, len(levels))])))
    return both.groupBy("end_hour", "level").agg(
        rnd(F.avg((F.col("predicted_class") == F.col("c")).cast("int"))).alias("prediction_stability"), rnd(F.corr("predicted_prob_class_1", "p")).alias("probability_stability"))


@query("walk_forward_boosted")
def walk_forward_boosted(b):
    """Weekly boosted refits: every row of a week scored by its hour's model of that week, fitted on all earlier rows."""
    f = feats(b).withColumn("label_", _expensive())
    spec = trees.Spec("logistic", trees=6, depth=3, rate=0.3)
    out = trees.walk_forward(f, ["end_hour"], FEATS, "label_", row_id(), spec, START)
    return rounded(out.select("end_hour", "l_orderkey", "l_linenumber", "week_num", F.col("label_").alias("actual"), "predicted_class", "predicted_prob_class_1", "prediction_confidence"), ["predicted_prob_class_1", "prediction_confidence"])


_NS = gauss_ctes(FEATS) + ", cutoff AS (SELECT end_hour, avg(y) AS cut, " + ", ".join(f"stddev_samp({c}) AS sd_{c}" for c in FEATS) + f""" FROM feats GROUP BY 1),
    nz AS (SELECT f.end_hour, level, cut, wi + {' + '.join(f'w{i} * {c}' for i, c in enumerate(FEATS))} AS base,
                  wi + {' + '.join(f'w{i} * ({c} + level * sd_{c} * {normal_sql(ROWSQL, 40 + i)})' for i, c in enumerate(FEATS))} AS moved
           FROM feats f JOIN fit USING (end_hour) JOIN cutoff USING (end_hour), (SELECT unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS level))"""


@query("noise_stability", f"""
    SELECT end_hour, level, {r6('avg(CAST((base > cut) = (moved > cut) AS INT))', 5)} AS prediction_stability,
           {r6('corr(1 / (1 + exp(-(base - cut))), 1 / (1 + exp(-(moved - cut))))', 5)} AS probability_stability FROM nz GROUP BY 1, 2""", "feats", _NS)
def noise_stability(b):
    """Agreement of a linear sign rule with itself on perturbed rows, at 1, 5 and 10 percent noise."""
    f = feats(b)
    coefs = linear.fit_linear(f, ["end_hour"], FEATS, "y")
    cut = f.groupBy("end_hour").agg(F.avg("y").alias("cut"), *[F.stddev_samp(c).alias(f"sd_{c}") for c in FEATS])
    base = join_measured(linear.score_linear(f, coefs, ["end_hour"], FEATS, "base"), cut, ["end_hour"])
    noisy = base.withColumn("level", F.explode(F.array(F.lit(0.01), F.lit(0.05), F.lit(0.1))))
    for i, c in enumerate(FEATS):
        noisy = noisy.withColumn(c, F.col(c) + F.col("level") * F.col(f"sd_{c}") * encode.standard_normal(row_id(), 40 + i))
    noisy = linear.score_linear(noisy, coefs, ["end_hour"], FEATS, "moved")
    prob = lambda c: 1 / (1 + F.exp(-(F.col(c) - F.col("cut"))))
    same = ((F.col("base") > F.col("cut")) == (F.col("moved") > F.col("cut"))).cast("int")
    return noisy.groupBy("end_hour", "level").agg(
        rnd(F.avg(same), 5).alias("prediction_stability"), rnd(F.corr(prob("base"), prob("moved")), 5).alias("probability_stability"))


# --- metrics -----------------------------------------------------------------------------------

_RP = "rp AS (SELECT settlement_point, end_hour, utc_ts, actual_dart_slt_raw AS y, (predicted_prob_class_1 - 0.5) * 4 AS p, actual_dart_slt AS a, predicted_dart_slt AS c, week_num FROM pred)"


def reg_rows(b):
    return b.predictions.withColumn("p", (F.col("predicted_prob_class_1") - 0.5) * 4)


_RM = ["r2", "mae", "rmse", "mape", "smape"]


@query("regression_metrics", f"""
    SELECT settlement_point, end_hour, CAST(count(*) AS BIGINT) AS n, {r6('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2, {r6('avg(abs(y - p))')} AS mae, {r6('sqrt(avg((y - p) * (y - p)))')} AS rmse,
           {r6('avg(abs((y - p) / y) * 100) FILTER (abs(y) > 1)', 5)} AS mape, CAST(count_if(abs(y) > 1) AS BIGINT) AS mape_sample_count,
           {r6('avg(abs(y - p) / ((abs(y) + abs(p)) / 2) * 100) FILTER ((abs(y) + abs(p)) / 2 > 1)', 5)} AS smape, CAST(count_if((abs(y) + abs(p)) / 2 > 1) AS BIGINT) AS smape_sample_count
    FROM rp GROUP BY 1, 2""", "pred", _RP)
def regression_metrics(b):
    m = metrics.regression_metrics(reg_rows(b), ["settlement_point", "end_hour"], "actual_dart_slt_raw", "p")
    return rounded(rounded(m, ["r2", "mae", "rmse"]), ["mape", "smape"], 5)


@query("core_metrics", f"""
    SELECT settlement_point, {r6('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS validation_r2, {r6('avg(abs(y - p))')} AS validation_mae, {r6('sqrt(avg((y - p) * (y - p)))')} AS validation_rmse FROM rp GROUP BY 1""", "pred", _RP)
def core_metrics(b):
    """The three metrics that are kept with every model."""
    m = metrics.regression_metrics(reg_rows(b), ["settlement_point"], "actual_dart_slt_raw", "p")
    out = metrics.core(m, ["settlement_point"], "validation_")
    return rounded(out, [c for c in out.columns if c != "settlement_point"])


@query("directional_accuracy", f"""
    SELECT settlement_point, {r6('100.0 * avg(CAST(sign(dy) = sign(dp) AS INT))')} AS directional_accuracy, CAST(count(dy) AS BIGINT) AS directional_accuracy_sample_count,
           {r6('avg(abs(y - p)) / avg(abs(dy))')} AS mase FROM (
        SELECT *, y - lag(y) OVER w AS dy, p - lag(p) OVER w AS dp FROM rp WINDOW w AS (PARTITION BY settlement_point ORDER BY utc_ts)) GROUP BY 1""", "pred", _RP)
def directional_accuracy(b):
    m = metrics.directional_accuracy(reg_rows(b), ["settlement_point"], "actual_dart_slt_raw", "p", ["utc_ts"])
    return rounded(m, ["directional_accuracy", "mase"])


@query("spike_metrics", f"""
    SELECT settlement_point, {r6('CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END END')} AS spike_precision,
           {r6('CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END END')} AS spike_recall,
           {r6('CASE WHEN tp + fp + fn > 0 THEN CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END END')} AS spike_f1_score,
           CAST(tp + fn AS BIGINT) AS spike_count_true, CAST(tp + fp AS BIGINT) AS spike_count_pred
    FROM (SELECT settlement_point, count_if(y > cut AND p > cut) AS tp, count_if(y <= cut AND p > cut) AS fp, count_if(y > cut AND p <= cut) AS fn
          FROM rp JOIN (SELECT settlement_point, avg(y) + 2 * stddev_pop(y) AS cut FROM rp GROUP BY 1) USING (settlement_point) GROUP BY 1)""", "pred", _RP)
def spike_metrics(b):
    m = metrics.spike_metrics(reg_rows(b), ["settlement_point"], "actual_dart_slt_raw", "p")
    return rounded(m, ["spike_precision", "spike_recall", "spike_f1_score"])


_ROB = ["price_range_true", "price_mean_true", "price_std_true", "price_range_pred", "price_mean_pred", "price_std_pred", "finite_sample_rate"]


@query("robustness_metrics", f"""
    SELECT location, CAST(count(*) AS BIGINT) AS total_samples, CAST(count(dart) AS BIGINT) AS finite_samples, {r6('max(rt_spp_price) FILTER (dart IS NOT NULL) - min(rt_spp_price) FILTER (dart IS NOT NULL)')} AS price_range_true,
           {r6('avg(rt_spp_price) FILTER (dart IS NOT NULL)', 5)} AS price_mean_true, {r6('stddev_pop(rt_spp_price) FILTER (dart IS NOT NULL)')} AS price_std_true, {r6('max(dam_spp_price) - min(dam_spp_price)')} AS price_range_pred,
           {r6('avg(dam_spp_price)', 5)} AS price_mean_pred, {r6('stddev_pop(dam_spp_price)')} AS price_std_pred, {r6('count(dart) / count(*)')} AS finite_sample_rate FROM spread GROUP BY 1""", "spread")
def robustness_metrics(b):
    m = metrics.robustness_metrics(b.spread, ["location"], "rt_spp_price", "dam_spp_price")
    return rounded(rounded(m, [c for c in _ROB if "mean" not in c]), ["price_mean_true", "price_mean_pred"], 5)


_PC = """pc AS (SELECT settlement_point, cls, sum(support) AS support, sum(tp) AS tp, sum(called) AS called FROM (
        SELECT settlement_point, a AS cls, 1 AS support, CAST(a = c AS INT) AS tp, 0 AS called FROM rp UNION ALL SELECT settlement_point, c, 0, 0, 1 FROM rp) GROUP BY 1, 2),
    pcm AS (SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision_, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall_,
                   CASE WHEN called + support > 0 THEN 2.0 * tp / (called + support) ELSE 0 END AS f1_ FROM pc)"""
_CM = ["accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro"]


def _conf(b, keys=("settlement_point",)):
    return metrics.confusion(b.predictions, list(keys), "actual_dart_slt", "predicted_dart_slt")


@query("classification_metrics", f"""
    SELECT settlement_point, {r6('sum(tp) / sum(support)')} AS accuracy, {r6('sum(support * precision_) / sum(support)')} AS precision, {r6('sum(support * recall_) / sum(support)')} AS recall,
           {r6('sum(support * f1_) / sum(support)')} AS f1, {r6('avg(precision_)')} AS precision_macro, {r6('avg(recall_)')} AS recall_macro, {r6('avg(f1_)')} AS f1_macro,
           CAST(count(*) AS BIGINT) AS n_classes, CAST(sum(tp) AS BIGINT) AS correct_predictions, CAST(sum(support) AS BIGINT) AS total_predictions FROM pcm GROUP BY 1""", "pred", _RP + ", " + _PC)
def classification_metrics(b):
    return rounded(metrics.classification_metrics(_conf(b), ["settlement_point"]), _CM)


@query("per_class_metrics", f"""
    SELECT settlement_point, cls, CAST(support AS BIGINT) AS support, {r6('precision_')} AS precision, {r6('recall_')} AS recall, {r6('f1_')} AS f1 FROM pcm""", "pred", _RP + ", " + _PC)
def per_class_metrics(b):
    return rounded(metrics.per_class(_conf(b), ["settlement_point"]).select("settlement_point", "cls", "support", "precision", "recall", "f1"), ["precision", "recall", "f1"])


@query("confusion_matrix", f"""
    SELECT settlement_point, a AS actual, CAST(count_if(c = 0) AS BIGINT) AS pred_0, CAST(count_if(c = 1) AS BIGINT) AS pred_1, {r6('count_if(a = c) / count(*)')} AS class_accuracy FROM rp GROUP BY 1, 2""", "pred", _RP)
def confusion_matrix(b):
    return rounded(metrics.confusion_matrix(_conf(b), ["settlement_point"], [0, 1]), ["class_accuracy"])


_HRES = f"""hres AS (SELECT settlement_point, end_hour, avg(CAST(a = c AS INT)) FILTER (week_num <= 3) AS train_accuracy, avg(CAST(a = c AS INT)) FILTER (week_num > 3) AS validation_accuracy,
        2.0 * count_if(a = 1 AND c = 1 AND week_num > 3) / nullif(2 * count_if(a = 1 AND c = 1 AND week_num > 3) + count_if(a <> c AND week_num > 3), 0) AS validation_f1 FROM rp GROUP BY 1, 2)"""


def hour_results(b):
    p = b.predictions
    hit = (F.col("actual_dart_slt") == F.col("predicted_dart_slt")).cast("int")
    late = F.col("week_num") > 3
    tp = F.count_if(late & (F.col("actual_dart_slt") == 1) & (F.col("predicted_dart_slt") == 1))
    miss = F.count_if(late & (F.col("actual_dart_slt") != F.col("predicted_dart_slt")))
    den = 2 * tp + miss
    return p.groupBy("settlement_point", "end_hour").agg(
        F.avg(F.when(~late, hit)).alias("train_accuracy"), F.avg(F.when(late, hit)).alias("validation_accuracy"),
        F.when(den > 0, 2.0 * tp / F.when(den > 0, den)).alias("validation_f1"))


_HP = ["mean_accuracy", "std_accuracy", "mean_f1", "std_f1", "overfit_gap"]


@query("hourly_performance", f"""
    SELECT end_hour, {r6('ma')} AS mean_accuracy, {r6('sa')} AS std_accuracy, {r6('mf')} AS mean_f1, {r6('sf')} AS std_f1, {r6('gap')} AS overfit_gap, CAST(nb AS BIGINT) AS n_below_baseline,
           row_number() OVER (ORDER BY round(ma, 9) DESC, end_hour) <= 5 AS is_top, row_number() OVER (ORDER BY round(ma, 9), end_hour) <= 5 AS is_bottom FROM (
        SELECT end_hour, avg(validation_accuracy) AS ma, stddev_samp(validation_accuracy) AS sa, avg(validation_f1) AS mf, stddev_samp(validation_f1) AS sf,
               avg(train_accuracy - validation_accuracy) AS gap, count_if(validation_accuracy < 0.575) AS nb FROM hres GROUP BY 1)""", "pred", _RP + ", " + _HRES)
def hourly_performance(b):
    return rounded(metrics.hourly_performance(hour_results(b), 0.575), _HP)


@query("model_comparison_by_hour", f"""
    SELECT model, end_hour, CAST(count(*) AS BIGINT) AS n, {r6('1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*))')} AS r2, {r6('avg(abs(y - q))')} AS mae FROM (
        SELECT 'prob' AS model, end_hour, y, p AS q FROM rp UNION ALL SELECT 'zero', end_hour, y, 0.0 FROM rp) GROUP BY 1, 2""", "pred", _RP)
def model_comparison_by_hour(b):
    r = reg_rows(b)
    both = r.withColumn("model", F.lit("prob")).unionByName(r.withColumn("p", F.lit(0.0)).withColumn("model", F.lit("zero")))
    m = metrics.regression_metrics(both, ["model", "end_hour"], "actual_dart_slt_raw", "p")
    return rounded(m.select("model", "end_hour", "n", "r2", "mae"), ["r2", "mae"])


@query("representative_hours", """
    SELECT CAST(arg_max(end_hour, [round(ma, 9), -end_hour]) AS INT) AS best_hour, CAST(arg_min(end_hour, [round(ma, 9), end_hour]) AS INT) AS worst_hour,
           CAST(arg_max(end_hour, [round(ma, 9), -end_hour]) FILTER (pos = (n + 1) // 2) AS INT) AS median_hour FROM (
        SELECT *, row_number() OVER (ORDER BY round(ma, 9), end_hour) AS pos, count(*) OVER () AS n FROM (SELECT end_hour, avg(validation_accuracy) AS ma FROM hres GROUP BY 1))""", "pred", _RP + ", " + _HRES)
def representative_hours(b):
    h = metrics.hourly_performance(hour_results(b), 0.575).withColumn("mean_accuracy", F.round("mean_accuracy", 9))
    return metrics.representative_hours(h)


@query("model_error_histogram", f"""
    SELECT model, CAST(bin AS INT) AS bin, {r6('any_value(lo + bin * (hi - lo) / 20)')} AS bin_start, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT model, lo, hi, least(floor((e - lo) / ((hi - lo) / 20)), 19) AS bin FROM er JOIN (SELECT model, min(e) AS lo, max(e) AS hi FROM er GROUP BY 1) USING (model)) GROUP BY 1, 2""", "pred",
       _RP + ", er AS (SELECT 'prob' AS model, round(p - y, 9) AS e FROM rp UNION ALL SELECT 'zero', round(-y, 9) FROM rp)")
def model_error_histogram(b):
    r = reg_rows(b)
    err = r.select(F.lit("prob").alias("model"), F.round(F.col("p") - F.col("actual_dart_slt_raw"), 9).alias("value")).unionByName(
        r.select(F.lit("zero").alias("model"), F.round(-F.col("actual_dart_slt_raw"), 9).alias("value")))
    return rounded(describe.histogram(err, ["model"], bins=20), ["bin_start"])


@query("prediction_feature_series", f"""
    SELECT settlement_point, utc_ts, end_hour, 'load' AS category, feature, {r6('value')} AS value, {r6('p')} AS prediction FROM (
        SELECT p.settlement_point, p.utc_ts, p.end_hour, p.p, unnest([{', '.join(f"'load_forecast_{z}'" for z in ZONES)}]) AS feature, unnest([{', '.join(f'w.load_forecast_{z}' for z in ZONES)}]) AS value
        FROM rp p LEFT JOIN wide w ON w.utc_ts = p.utc_ts)""", "pred vint", _RP + ", " + _LATEST)
def prediction_feature_series(b):
    """Every series of a feature category beside the predictions, scaled names mapped to the base column."""
    wide = vintage.vintage_wide(b.forecast_vintage, "value", ZONES, "load_forecast_", tie="event_id")
    d = wide.withColumnsRenamed({f"load_forecast_{z}": f"load_forecast_{z}_z" for z in ZONES})
    p = reg_rows(b).select("settlement_point", "utc_ts", "end_hour", F.col("p").alias("prediction"))
    j = scoring.join_predictions(p, d, ["utc_ts"])
    return rounded(scoring.feature_series(j, ["settlement_point", "utc_ts", "end_hour", "prediction"]), ["value", "prediction"])


@query("coefficient_table", " UNION ALL ".join(f"""
    SELECT end_hour, alpha, '{f}' AS feature, {r6(f'w{i}')} AS coefficient, {r6(f'abs(w{i})')} AS abs_coefficient, abs(w{i}) <= 1e-12 AS is_zero FROM lr""" for i, f in enumerate(FEATS)), "feats", _LAS)
def coefficient_table(b):
    c = linear.fit_linear(feats(b), ["end_hour"], FEATS, "y", "lasso", ALPHAS)
    return rounded(linear.coefficient_table(c, ["end_hour", "alpha"]), ["coefficient", "abs_coefficient"])


@query("prediction_dataset_join", f"""
    SELECT p.settlement_point, p.utc_ts, p.end_hour, {r6('p.p')} AS p, s.rt_spp_price, s.dam_spp_price FROM rp p LEFT JOIN spread s ON s.location = p.settlement_point AND s.utc_ts = p.utc_ts""", "pred", _RP)
def prediction_dataset_join(b):
    d = b.spread.select(F.col("location").alias("settlement_point"), "utc_ts", "local_ts", "rt_spp_price", "dam_spp_price")
    p = reg_rows(b).select("settlement_point", "utc_ts", "local_ts", "end_hour", rnd("p").alias("p"))
    return scoring.join_predictions(p, d, ["settlement_point", "utc_ts", "local_ts"]).drop("local_ts")


@query("progressive_coverage", """
    SELECT week_num, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT end_hour) AS BIGINT) AS n_hours, min(utc_ts) AS first_ts, max(utc_ts) AS last_ts FROM pred GROUP BY 1""", "pred")
def progressive_coverage(b):
    return scoring.coverage(b.predictions, ["week_num"])


@query("progressive_results", f"""
    SELECT week_num, end_hour, {r6('avg(CAST(a = c AS INT))')} AS accuracy, CAST(count(*) AS BIGINT) AS total_predictions FROM rp GROUP BY 1, 2""", "pred", _RP)
def progressive_results(b):
    m = metrics.classification_metrics(_conf(b, ("week_num", "end_hour")), ["week_num", "end_hour"])
    return rounded(m.select("week_num", "end_hour", "accuracy", "total_predictions"), ["accuracy"])


# --- bootstrap ---------------------------------------------------------------------------------

_PKEY = "CAST(epoch(utc_ts) AS BIGINT) // 3600 * 16 + length(settlement_point)"
_BOOT = _RP + ", " + resample_ctes("bw", "rp", "settlement_point", _PKEY, uniform_sql, 10) + """,
    bpc AS (SELECT settlement_point, replicate, cls, sum(support) AS support, sum(tp) AS tp, sum(called) AS called FROM (
        SELECT settlement_point, replicate, a AS cls, w AS support, CASE WHEN a = c THEN w ELSE 0 END AS tp, 0 AS called FROM bw UNION ALL SELECT settlement_point, replicate, c, 0, 0, w FROM bw) GROUP BY 1, 2, 3),
    bm AS (SELECT settlement_point, replicate, sum(tp) / sum(support) AS accuracy, sum(CASE WHEN called > 0 THEN support * tp / called ELSE 0 END) / sum(support) AS precision_,
                  sum(CASE WHEN support > 0 THEN 1.0 * tp ELSE 0 END) / sum(support) AS recall_, sum(support * 2.0 * tp / (called + support)) / sum(support) AS f1_ FROM bpc GROUP BY 1, 2)"""


def boot_rows(b):
    key = F.floor(F.unix_seconds("utc_ts") / 3600).cast("long") * 16 + F.length("settlement_point")
    return bootstrap.bootstrap_classification(b.predictions, ["settlement_point"], "actual_dart_slt", "predicted_dart_slt", key, 10)


@query("bootstrap_classification", f"""
    SELECT settlement_point, CAST(replicate AS INT) AS replicate, {r6('accuracy')} AS accuracy, {r6('precision_')} AS precision, {r6('recall_')} AS recall, {r6('f1_')} AS f1 FROM bm""", "pred", _BOOT)
def bootstrap_classification(b):
    return rounded(boot_rows(b).select("settlement_point", "replicate", "accuracy", "precision", "recall", "f1"), ["accuracy", "precision", "recall", "f1"])


_BSUM = " UNION ALL ".join(f"SELECT settlement_point, '{m}' AS metric, avg({c}) AS m, stddev_pop({c}) AS sp, stddev_samp({c}) AS ss, count({c}) AS n, count(*) AS nn FROM bm GROUP BY 1" for m, c in
                           (("accuracy", "accuracy"), ("precision", "precision_"), ("recall", "recall_"), ("f1", "f1_")))


@query("bootstrap_summary", f"""
    SELECT settlement_point, metric, {r6('m')} AS mean, {r6('ss')} AS std, CAST(n AS BIGINT) AS count, CAST(nn - n AS BIGINT) AS nan_count, {r6('n / nn')} AS success_rate FROM ({_BSUM})""", "pred", _BOOT)
def bootstrap_summary(b):
    long = bootstrap.metric_long(boot_rows(b), ["settlement_point", "replicate"], ["accuracy", "precision", "recall", "f1"])
    return rounded(bootstrap.bootstrap_summary(long, ["settlement_point"]), ["mean", "std", "success_rate"])


@query("metrics_flat", "SELECT settlement_point, " + ", ".join(
    f"{r6(f'avg({c})')} AS bootstrap_{m}_mean, {r6(f'stddev_pop({c})')} AS bootstrap_{m}_std" for m, c in (("accuracy", "accuracy"), ("f1", "f1_"))) + " FROM bm GROUP BY 1", "pred", _BOOT)
def metrics_flat(b):
    long = bootstrap.metric_long(boot_rows(b), ["settlement_point", "replicate"], ["accuracy", "f1"])
    s = bootstrap.bootstrap_summary(long, ["settlement_point"], classification=True)
    out = bootstrap.flat_metrics(s, ["settlement_point"], ["accuracy", "f1"])
    return rounded(out, [c for c in out.columns if c.startswith("bootstrap_")])


@query("metrics_flat_classes", "SELECT settlement_point, " + ", ".join(
    f"{r6(f'avg({m}_)')} AS mean_per_class_{m}, {r6(f'min({m}_)')} AS min_per_class_{m}, {r6(f'max({m}_)')} AS max_per_class_{m}" for m in ("precision", "recall", "f1")) + " FROM pcm GROUP BY 1", "pred", _RP + ", " + _PC)
def metrics_flat_classes(b):
    out = bootstrap.flat_class_metrics(metrics.per_class(_conf(b), ["settlement_point"]), ["settlement_point"])
    return rounded(out, [c for c in out.columns if c != "settlement_point"])


@query("bootstrap_oob_metrics", f"""
    SELECT end_hour, CAST(replicate AS INT) AS replicate, CAST(count(*) AS BIGINT) AS n, {r6('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 5)} AS r2, {r6('avg(abs(y - p))')} AS mae FROM (
        SELECT o.end_hour, o.replicate, o.y, {_PREDICT('o', 'f')} AS p FROM ow o JOIN of f ON f.end_hour = o.end_hour AND f.replicate = o.replicate WHERE o.w = 0) GROUP BY 1, 2""", "feats",
       resample_ctes("ow", "feats", "end_hour", ROWSQL, uniform_sql, 5, _COLS) + ", " + gauss_ctes(FEATS, src="ow", keys="end_hour, replicate", weight="w", name="of"))
def bootstrap_oob_metrics(b):
    p = linear.bootstrap_oob(feats(b), ["end_hour"], FEATS, "y", row_id(), n=5)
    m = metrics.regression_metrics(p, ["end_hour", "replicate"], "actual", "prediction")
    return rounded(rounded(m.select("end_hour", "replicate", "n", "r2", "mae"), ["mae"]), ["r2"], 5)


@query("resampling_weights", """
    SELECT end_hour, CAST(replicate AS INT) AS replicate, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(w) AS BIGINT) AS n_draws, CAST(count_if(w = 0) AS BIGINT) AS n_left_out, CAST(max(w) AS BIGINT) AS most_draws
    FROM ow GROUP BY 1, 2""", "feats", resample_ctes("ow", "feats", "end_hour", ROWSQL, uniform_sql, 5))
def resampling_weights(b):
    """Every replicate draws as many rows as its group has."""
    r = linear.by_replicate(linear.resampled(feats(b).select("end_hour", "l_orderkey", "l_linenumber"), ["end_hour"], row_id(), 5))
    return r.groupBy("end_hour", "replicate").agg(
        F.count("*").alias("n_rows"), F.sum("weight").alias("n_draws"), F.count_if(~F.col("drawn")).alias("n_left_out"), F.max("weight").cast("long").alias("most_draws"))


# --- selection, grids and importance -----------------------------------------------------------

NAMES = {"l_quantity": "load_forecast_coast_slt", "l_discount": "wind_generation_STWPFWest_slt", "l_tax": "solar_STPPFFarWest_slt",
         "p_retailprice": "dart_slt_lag_24hr", "l_linenumber": "etf_dow_sin"}
_IMP = "imp AS (" + " UNION ALL ".join(
    f"SELECT CAST(year(utc_ts) AS INT) AS week_num, end_hour, '{n}' AS feature, round(abs(corr({c}, y)), 9) AS importance FROM feats GROUP BY 1, 2" for c, n in NAMES.items()) + ")"
_RK = _IMP + ", hi AS (SELECT end_hour, feature, round(avg(importance), 6) AS importance FROM imp GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY end_hour ORDER BY importance DESC, feature) - 1 AS rank FROM hi), top_ AS (SELECT * FROM rk WHERE rank < 10)"


def imp_rows(b):
    values = F.array(*[F.abs(F.corr(c, "y")) for c in NAMES])
    m = feats(b).groupBy(F.year("utc_ts").alias("week_num"), "end_hour").agg(values.alias("v"))
    return rounded(importance.importance_long(m, ["week_num", "end_hour"], list(NAMES.values()), "v"), ["importance"], 9)


def hour_imp(b):
    return imp_rows(b).groupBy("end_hour", "feature").agg(rnd(F.avg("importance")).alias("importance"))


def top_rows(b):
    return importance.ranked(hour_imp(b), ["end_hour"])


@query("feature_importance_long", "SELECT week_num, end_hour, feature, importance FROM imp", "feats", _IMP)
def feature_importance_long(b):
    return imp_rows(b)


@query("feature_summary", f"""
    SELECT feature, {r6('avg(importance)')} AS mean, {r6('stddev_samp(importance)')} AS std, CAST(count(importance) AS BIGINT) AS n, {r6('avg(abs(importance))')} AS abs_mean, {r6('max(abs(importance))')} AS abs_max,
           CAST(count_if(importance = 0) AS BIGINT) AS n_zero FROM imp GROUP BY 1""", "feats", _IMP)
def feature_summary(b):
    return importance.feature_summary(imp_rows(b))


_WFS = ["mean_importance", "max_importance", "min_importance", "std_importance", "pct_hours_used"]


@query("weekly_feature_summary", f"""
    SELECT week_num, feature, {r6('avg(importance)')} AS mean_importance, {r6('max(importance)')} AS max_importance, {r6('min(importance)')} AS min_importance, {r6('stddev_pop(importance)')} AS std_importance,
           CAST(count_if(importance > 0) AS BIGINT) AS hours_nonzero, CAST(count(*) AS BIGINT) AS hours_total, {r6('100.0 * count_if(importance > 0) / count(*)')} AS pct_hours_used FROM imp GROUP BY 1, 2""", "feats", _IMP)
def weekly_feature_summary(b):
    return rounded(importance.weekly_feature_summary(imp_rows(b)), _WFS)


@query("importance_top", "SELECT end_hour, feature, importance, CAST(rank AS INT) AS rank FROM top_", "feats", _RK)
def importance_top(b):
    return top_rows(b)


_CASE = "CASE WHEN feature LIKE '%dow%' THEN 'temporal' WHEN feature LIKE '%load%' THEN 'load_forecast' WHEN feature LIKE '%wind%' THEN 'wind_forecast' WHEN feature LIKE '%solar%' THEN 'solar_forecast' WHEN feature LIKE '%dart%' THEN 'dart_historical' ELSE 'other' END"


@query("importance_by_category", f"SELECT end_hour, {_CASE} AS category, {r6('sum(importance)')} AS importance, CAST(count(*) AS BIGINT) AS n_features FROM hi GROUP BY 1, 2", "feats", _RK)
def importance_by_category(b):
    return rounded(importance.importance_by_category(hour_imp(b), ["end_hour"]), ["importance"])


@query("consistent_features", f"""
    SELECT feature, {r6('avg(rank)')} AS average_rank, {r6('count(*) / any_value(h)')} AS frequency, {r6('count(*) / any_value(h) / (avg(rank) + 1)')} AS consistency_score
    FROM top_, (SELECT count(DISTINCT end_hour) AS h FROM top_) GROUP BY 1 HAVING count(*) >= any_value(h) * 0.5 ORDER BY 4 DESC, 1 LIMIT 10""", "feats", _RK)
def consistent_features(b):
    return rounded(importance.consistent_features(top_rows(b)), ["average_rank", "frequency", "consistency_score"])


@query("hour_similarity", f"""
    SELECT x.end_hour AS hour_a, z.end_hour AS hour_b, {r6('len(list_intersect(x.f, z.f)) / len(list_distinct(list_concat(x.f, z.f)))')} AS similarity
    FROM (SELECT end_hour, list(feature) AS f FROM top_ GROUP BY 1) x JOIN (SELECT end_hour, list(feature) AS f FROM top_ GROUP BY 1) z ON x.end_hour < z.end_hour""", "feats", _RK)
def hour_similarity(b):
    return rounded(importance.hour_similarity(top_rows(b)), ["similarity"])


@query("feature_stability", f"""
    SELECT feature, {r6('1 / (1 + var_pop(r))')} AS stability FROM (
        SELECT f.feature, h.end_hour, coalesce(t.rank, 10) AS r FROM (SELECT DISTINCT feature FROM top_) f CROSS JOIN (SELECT DISTINCT end_hour FROM top_) h LEFT JOIN top_ t ON t.feature = f.feature AND t.end_hour = h.end_hour) GROUP BY 1""", "feats", _RK)
def feature_stability(b):
    return rounded(importance.feature_stability(top_rows(b)), ["stability"])


@query("stability_score", f"""
    SELECT {r6('avg(1 / (1 + v))')} AS stability FROM (SELECT feature, var_pop(r) AS v FROM (
        SELECT f.feature, coalesce(t.rank, 10) AS r FROM (SELECT DISTINCT feature FROM top_) f CROSS JOIN (SELECT DISTINCT end_hour FROM top_) h LEFT JOIN top_ t ON t.feature = f.feature AND t.end_hour = h.end_hour) GROUP BY 1)""", "feats", _RK)
def stability_score(b):
    return importance.feature_stability(top_rows(b)).agg(rnd(F.avg("stability")).alias("stability"))


_CX = "cx AS (SELECT end_hour, round(sum(importance), 6) AS complexity FROM hi GROUP BY 1)"


def complexity(b):
    return hour_imp(b).groupBy("end_hour").agg(rnd(F.sum("importance")).alias("complexity"))


@query("complexity_trend", f"SELECT {r6('regr_slope(complexity, end_hour)', 8)} AS trend_slope, arg_max(end_hour, [complexity, -end_hour]) AS most_complex_hour, arg_min(end_hour, [complexity, end_hour]) AS least_complex_hour FROM cx", "feats", _RK + ", " + _CX)
def complexity_trend(b):
    return rounded(importance.complexity_trend(complexity(b)), ["trend_slope"], 8)


@query("complexity_by_period", f"""
    SELECT CASE WHEN end_hour BETWEEN 6 AND 10 THEN 'morning_hours' WHEN end_hour BETWEEN 11 AND 15 THEN 'midday_hours' WHEN end_hour BETWEEN 16 AND 20 THEN 'evening_hours' ELSE 'night_hours' END AS period,
           {r6('avg(complexity)', 8)} AS mean_complexity, {r6('stddev_pop(complexity)')} AS std_complexity, CAST(count(*) AS BIGINT) AS sample_count FROM cx GROUP BY 1""", "feats", _RK + ", " + _CX)
def complexity_by_period(b):
    return rounded(rounded(importance.complexity_by_period(complexity(b)), ["mean_complexity"], 8), ["std_complexity"])


@query("class_separation", " UNION ALL ".join(f"""
    SELECT end_hour, '{c}' AS feature, CAST(l_extendedprice > 40000 AS INT) AS cls, {r6(f'avg({c})', 7)} AS mean, {r6(f'stddev_samp({c})')} AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(count(*) AS BIGINT) AS n FROM feats GROUP BY 1, 3""" for c in FEATS), "feats")
def class_separation(b):
    f = feats(b).withColumn("cls_", (F.col("l_extendedprice") > 40000).cast("int"))
    return rounded(rounded(importance.class_separation(f, FEATS, "cls_", ["end_hour"]), ["mean"], 7), ["std"])


@query("selection_by_category", f"""
    SELECT end_hour, CASE WHEN feature LIKE '%lag!_%' ESCAPE '!' THEN 'lag_features' WHEN feature LIKE 'load%' THEN 'load_features' WHEN feature LIKE 'wind%' THEN 'wind_features' WHEN feature LIKE 'solar%' THEN 'solar_features' ELSE 'other' END AS category,
           CAST(count(*) AS BIGINT) AS n_selected FROM hi WHERE importance > 0.02 GROUP BY 1, 2""", "feats", _RK)
def selection_by_category(b):
    kept = hour_imp(b).withColumn("coefficient", F.when(F.col("importance") > 0.02, F.col("importance")).otherwise(0.0))
    return importance.selection_by_category(kept, ["end_hour"])


@query("importance_ranking", f"""
    SELECT week_num, feature, {r6('m', 8)} AS mean_abs_importance, CAST(row_number() OVER (PARTITION BY week_num ORDER BY m DESC, feature) AS INT) AS position FROM (
        SELECT week_num, feature, avg(abs(importance)) AS m FROM imp GROUP BY 1, 2)""", "feats", _IMP)
def importance_ranking(b):
    return rounded(importance.importance_ranking(imp_rows(b).withColumn("feature", F.concat("feature", F.lit("_z"))), ["week_num"]), ["mean_abs_importance"], 8)


GRID = [0.0001, 1.0, 100.0, 10000.0, 1000000.0]
_GRID = f"""al AS (SELECT unnest({GRID!r}::DOUBLE[]) AS alpha),
    tr AS MATERIALIZED (SELECT end_hour, l_orderkey, l_linenumber, {", ".join(_COLS)} FROM feats WHERE year(utc_ts) < 2000), va AS (SELECT end_hour, {", ".join(_COLS)} FROM feats WHERE year(utc_ts) >= 2000),
    {resample_ctes("ow", "tr", "end_hour", ROWSQL, uniform_sql, 5, _COLS)}, {moments_cte("bg", "ow", FEATS, "y", "end_hour, replicate", "w")}, ba AS (SELECT * FROM bg, al),
    {gauss_ctes(FEATS, "alpha", keys="end_hour, replicate, alpha", moments="ba", name="bf")},
    bo AS (SELECT end_hour, alpha, avg(r2) AS bootstrap_r2 FROM (
        SELECT end_hour, replicate, alpha, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM (
            SELECT o.end_hour, o.replicate, f.alpha, o.y, {_PREDICT("o", "f")} AS p FROM ow o JOIN bf f ON f.end_hour = o.end_hour AND f.replicate = o.replicate WHERE o.w = 0) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    {moments_cte("vg", "tr", FEATS, "y", "end_hour")}, vb AS (SELECT * FROM vg, al), {gauss_ctes(FEATS, "alpha", keys="end_hour, alpha", moments="vb", name="vf")},
    vo AS (SELECT end_hour, alpha, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS validation_r2 FROM (
        SELECT v.end_hour, f.alpha, v.y, {_PREDICT("v", "f")} AS p FROM va v JOIN vf f ON f.end_hour = v.end_hour) GROUP BY 1, 2),
    gh AS (SELECT end_hour, alpha, round(bootstrap_r2, 9) AS bootstrap_r2, round(validation_r2, 9) AS validation_r2 FROM bo JOIN vo USING (end_hour, alpha))"""
_GC = ["avg_bootstrap_r2", "std_bootstrap_r2", "avg_validation_r2", "std_validation_r2", "median_validation_r2"]

@query("alpha_grid_summary", f"""
    SELECT alpha, {r6('ab')} AS avg_bootstrap_r2, {r6('sb')} AS std_bootstrap_r2, {r6('av')} AS avg_validation_r2, {r6('sv')} AS std_validation_r2, CAST(n AS BIGINT) AS n_hours_trained, {r6('md')} AS median_validation_r2,
           alpha = arg_max(alpha, av) OVER () AS best_by_mean, alpha = arg_max(alpha, md) OVER () AS best_by_median FROM (
        SELECT alpha, avg(bootstrap_r2) AS ab, stddev_pop(bootstrap_r2) AS sb, avg(validation_r2) AS av, stddev_pop(validation_r2) AS sv, count(*) AS n, quantile_cont(validation_r2, 0.5) AS md FROM gh GROUP BY 1)""", "feats", _GRID)
def alpha_grid_summary(b):
    """Ridge at every alpha and hour: R2 of rows left out of bootstrap fits, and of the years after training."""
    f, xs = feats(b), FEATS
    train, later = f.where(F.year("utc_ts") < 2000), f.where(F.year("utc_ts") >= 2000)
    r2 = lambda d, keys: metrics.regression_metrics(d, keys, "actual", "prediction").select(*keys, "r2")
    boot = r2(linear.bootstrap_oob(train, ["end_hour"], xs, "y", row_id(), n=5, kind="ridge", alphas=GRID), ["end_hour", "replicate", "alpha"])
    boot = boot.groupBy("end_hour", "alpha").agg(F.round(F.avg("r2"), 9).alias("bootstrap_r2"))
    coefs = linear.fit_linear(train, ["end_hour"], xs, "y", "ridge", GRID)
    asked = later.select("end_hour", *xs, F.col("y").alias("actual"), F.explode(F.array(*map(F.lit, GRID))).alias("alpha"))
    held = r2(linear.score_linear(asked, coefs, ["end_hour", "alpha"], xs), ["end_hour", "alpha"]).select("end_hour", "alpha", F.round("r2", 9).alias("validation_r2"))
    return rounded(selection.alpha_grid_summary(boot.join(held, ["end_hour", "alpha"])), _GC)


_TRIALS = _GRID + f""", vt AS (SELECT end_hour, alpha, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS train_r2 FROM (
        SELECT v.end_hour, f.alpha, v.y, {_PREDICT("v", "f")} AS p FROM tr v JOIN vf f ON f.end_hour = v.end_hour) GROUP BY 1, 2),
    trials AS (SELECT end_hour, alpha, round(train_r2, 9) AS train_accuracy, round(validation_r2, 9) AS validation_accuracy FROM vt JOIN vo USING (end_hour, alpha))"""


@query("median_parameters", """
    SELECT quantile_cont(alpha, 0.5) AS alpha, quantile_cont(log_alpha, 0.5) AS log_alpha FROM (
        SELECT end_hour, arg_max(alpha, [round(validation_accuracy - 0.1 * greatest(0, train_accuracy - validation_accuracy - 0.1), 9), -alpha]) AS alpha,
               round(log10(arg_max(alpha, [round(validation_accuracy - 0.1 * greatest(0, train_accuracy - validation_accuracy - 0.1), 9), -alpha])), 6) AS log_alpha FROM trials GROUP BY 1)""", "feats", _TRIALS)
def median_parameters(b):
    """Median over hours of the penalty of the best ridge trial: R2 after the training years, less a penalty on a gap to R2 within them."""
    f = feats(b)
    train = f.where(F.year("utc_ts") < 2000)
    coefs = linear.fit_linear(train, ["end_hour"], FEATS, "y", "ridge", GRID)
    asked = f.withColumn("split", F.when(F.year("utc_ts") < 2000, "train").otherwise("validation")).withColumn("alpha", F.explode(F.array(*map(F.lit, GRID)))).withColumn("actual", F.col("y"))
    r2 = metrics.regression_metrics(linear.score_linear(asked, coefs, ["end_hour", "alpha"], FEATS), ["end_hour", "alpha", "split"], "actual", "prediction")
    of = lambda split: F.round(F.max(F.when(F.col("split") == split, F.col("r2"))), 9)
    trials = r2.groupBy("end_hour", "alpha").agg(of("train").alias("train_accuracy"), of("validation").alias("validation_accuracy"))
    scored = selection.tuning_score(trials).withColumn("score", F.round("score", 9)).withColumn("log_alpha", rnd(F.log10("alpha")))
    return selection.median_parameters(selection.best_trials(scored, ["end_hour"], "alpha"), ["alpha", "log_alpha"])


@query("tuning_score", f"""
    SELECT settlement_point, end_hour, {r6('train_accuracy - validation_accuracy')} AS overfit_gap, {r6('validation_accuracy - 0.1 * greatest(0, train_accuracy - validation_accuracy - 0.1)')} AS score FROM hres""", "pred", _RP + ", " + _HRES)
def tuning_score(b):
    s = selection.tuning_score(hour_results(b))
    return rounded(s.select("settlement_point", "end_hour", "overfit_gap", "score"), ["overfit_gap", "score"])
