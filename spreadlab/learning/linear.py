"""Linear models per group from co-moments: one pass over the rows, tiny solves per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.functions.columns import POISSON_ZERO, poisson_weight, uniform_hash
from spreadlab.learning.folds import assign_folds
from spreadlab.operators import blocks
from spreadlab.operators.correlate import co_moments
from spreadlab.session import join_measured, materialise, written

INTERCEPT = "(intercept)"
#: Draws of a resample that one task counts.
TASK_DRAWS = 1 << 21


def solve(cov: np.ndarray, cxy: np.ndarray, n: np.ndarray, kind: str, alpha: float) -> np.ndarray:
    """Coefficients of a batch of groups from population covariances (m, d, d) and (m, d).

    Ridge minimises |y-Xw|^2 + a|w|^2, lasso |y-Xw|^2/(2n) + a|w|_1; the intercept is free.
    """
    d = cxy.shape[1]
    if kind == "ols":
        return np.einsum("mij,mj->mi", np.linalg.pinv(cov, hermitian=True), cxy)
    if kind == "ridge":
        return np.linalg.solve(cov + np.eye(d) * (alpha / n)[:, None, None], cxy[..., None])[..., 0]
    return np.stack([lasso_at(cov[m], cxy[m], alpha) for m in range(len(cxy))]) if len(cxy) else np.zeros_like(cxy)


def lasso_at(cov: np.ndarray, cxy: np.ndarray, alpha: float) -> np.ndarray:
    """Lasso coefficients of one group by following the path from the largest penalty down to `alpha`.

    On the path the coefficients of the active features are linear in the penalty. A step ends
    where a feature's correlation with the rest reaches the penalty, where a coefficient
    reaches zero, or at alpha: no rounds and no tolerance to settle.
    """
    d = len(cxy)
    w, live = np.zeros(d), np.diag(cov) > 0
    penalty = float(np.abs(np.where(live, cxy, 0)).max(initial=0.0))
    active: list[int] = []
    banned = -1
    while penalty > alpha:
        rest = cxy - cov @ w
        if not active:
            active = [int(np.argmax(np.where(live, np.abs(rest), -1)))]
        signs = np.where([w[j] != 0 for j in active], np.sign(w[active]), np.sign(rest[active]))
        slope = np.linalg.pinv(cov[np.ix_(active, active)], hermitian=True) @ signs
        pull = cov[:, active] @ slope
        # Per unit of penalty: active coefficients move by slope, the other correlations fall by pull.
        step, event = penalty - alpha, None
        for j in range(d):
            if not live[j] or j in active:
                continue
            for sign in (1.0, -1.0):
                gain = 1 - sign * pull[j]
                if gain > 1e-12:
                    at = (penalty - sign * rest[j]) / gain
                    # A feature that has just left stands at the penalty and does not return there.
                    if (1e-9 if j == banned else -1e-9) * penalty <= at < step:
                        step, event = max(at, 0.0), ("in", j)
        for k, j in enumerate(active):
            if w[j] * slope[k] < 0 and -w[j] / slope[k] < step:
                step, event = -w[j] / slope[k], ("out", j)
        w[active] += step * slope
        penalty -= step
        banned = -1
        if event is None:
            break
        if event[0] == "in":
            active.append(event[1])
        else:
            active.remove(event[1])
            w[event[1]], banned = 0.0, event[1]
    return w


def duality_gap(cov: np.ndarray, cxy: np.ndarray, vy: float, w: np.ndarray, alpha: float) -> float:
    """Gap between the lasso objective |y-Xw|^2/(2n) + alpha |w|_1 and its dual at w: zero proves the solution."""
    rest = cxy - cov @ w
    squares = vy - 2 * w @ cxy + w @ cov @ w
    scale = min(1.0, alpha / max(float(np.abs(rest).max(initial=0.0)), 1e-300))
    dual = scale * (vy - w @ cxy) - scale * scale * squares / 2
    return float(squares / 2 + alpha * np.abs(w).sum() - dual)


def fit_linear(df: DataFrame, keys: list[str], features: list[str], target: str, kind: str = "ols", alphas: list[float] = [0.0]) -> DataFrame:
    """Coefficients per group and alpha: keys, alpha, feature, coefficient, n, r2 (training), gap. The intercept is a row.

    gap is the lasso's duality gap, which proves a solution where it is zero.
    """
    return coefficients(co_moments(df, keys, [*features, target]), keys, features, target, kind, alphas)


def coefficients(moments: DataFrame, keys: list[str], features: list[str], target: str, kind: str, alphas: list[float]) -> DataFrame:
    """Solve every group's normal equations. A group is one row of d means and d*d covariances, never data rows."""
    names = [*features, target]
    d = len(names)
    at = lambda c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)) - 1
    i, k = at("a"), at("b")
    cell = F.explode(F.array(F.struct((i * d + k).alias("p"), F.col("cov").alias("v")), F.struct((k * d + i).alias("p"), F.col("cov").alias("v"))))
    long = moments.select(*keys, "n", "a", "b", "mean_a", i.alias("__i"), cell.alias("c"))
    value = lambda arr: F.transform(F.array_sort(arr), lambda x: x["v"])
    rows = long.groupBy(*keys).agg(
        F.max("n").cast("long").alias("n"), value(F.collect_set("c")).alias("cov"),
        value(F.collect_set(F.when(F.col("a") == F.col("b"), F.struct(F.col("__i").alias("p"), F.col("mean_a").alias("v"))))).alias("means"))
    schema = T.StructType([moments.schema[k] for k in keys] + [
        T.StructField("alpha", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("r2", T.DoubleType()), T.StructField("gap", T.DoubleType()),
        T.StructField("w", T.ArrayType(T.DoubleType()))])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            cov = np.vstack(pdf["cov"].to_numpy()).reshape(-1, d, d)
            mean = np.vstack(pdf["means"].to_numpy())
            n = pdf["n"].to_numpy(dtype="float64")
            s, cxy, vy = cov[:, :-1, :-1], cov[:, :-1, -1], cov[:, -1, -1]
            for alpha in alphas:
                w = solve(s, cxy, n, kind, alpha)
                gain = 2 * np.einsum("mi,mi->m", w, cxy) - np.einsum("mi,mij,mj->m", w, s, w)
                icept = mean[:, -1] - np.einsum("mi,mi->m", w, mean[:, :-1])
                out = pdf[keys].copy()
                out["alpha"], out["n"] = float(alpha), pdf["n"]
                out["r2"] = np.divide(gain, vy, out=np.full_like(gain, np.nan), where=vy > 0)
                out["gap"] = [duality_gap(s[m], cxy[m], vy[m], w[m], alpha) if kind == "lasso" else np.nan for m in range(len(w))]
                out["w"] = list(np.hstack([w, icept[:, None]]))
                yield out[schema.names]

    labels = F.array(*[F.lit(f) for f in [*features, INTERCEPT]])
    return rows.mapInPandas(fit, schema).select(*keys, "alpha", "n", "r2", "gap", F.posexplode("w").alias("__p", "coefficient")).select(
        *keys, "alpha", labels[F.col("__p")].alias("feature"), "coefficient", "n", "r2", "gap")


def packed_coefficients(coefs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per model with a feature-to-coefficient map (one entry per feature)."""
    return coefs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("w"))


def score_linear(df: DataFrame, coefs: DataFrame, keys: list[str], features: list[str], out: str = "prediction") -> DataFrame:
    j = join_measured(df, packed_coefficients(coefs, keys), keys)
    total = F.col("w")[INTERCEPT]
    for f in features:
        total = total + F.col("w")[f] * F.col(f)
    return j.withColumn(out, total).drop("w")


def coefficient_table(coefs: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """Feature coefficients with their size and a zero flag."""
    size = F.abs("coefficient")
    return coefs.where(F.col("feature") != INTERCEPT).select(
        *keys, "feature", "coefficient", size.alias("abs_coefficient"), (size <= eps).alias("is_zero"))


def sparsity(coefs: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    c = coefs.where(F.col("feature") != INTERCEPT)
    kept = F.abs("coefficient") > eps
    return c.groupBy(*keys).agg(
        F.count_if(kept).alias("n_selected"), F.count_if(~kept).alias("n_zeroed"), F.avg((~kept).cast("double")).alias("sparsity_ratio"), F.max("r2").alias("r2"))


def replicates(df: DataFrame, row_id: Column, n: int, seed: int = 0) -> DataFrame:
    """Poisson(1) bootstrap copies: (replicate, weight, drawn) per row, from the row's own hash.

    Filter on `drawn` rather than on `weight`: a pushed-down filter repeats its expression,
    and `drawn` reads the hash once. Weighted sums need no filter at all.
    """
    r = df.withColumn("__id", row_id).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    r = r.withColumn("__u", uniform_hash("__id", F.col("replicate") + seed))
    return r.withColumn("weight", poisson_weight(F.col("__u"))).withColumn("drawn", F.col("__u") >= POISSON_ZERO).drop("__id", "__u")


def resampled(df: DataFrame, keys: list[str], row_id: Column, n: int, seed: int = 0, ties: list[str] = []) -> DataFrame:
    """Rows with `weights`: how often each of `n` replicates draws the row, exactly as many draws as the group has rows.

    The rows of a group are numbered by their ids, rows of one id by the columns `ties`. Every
    row makes one draw per replicate, a place in its group from its own hash, so a replicate
    is a draw with replacement of the whole group. Draws are counted by place before they meet
    their rows; the weights are written once for all later passes.
    """
    rows = df.withColumn("__rid", row_id)
    placed = blocks.row_numbers(rows, keys, ["__rid", *ties], F.shiftright(F.col("__rid").cast("long"), 16), "__place")
    size = rows.groupBy(*keys).agg(F.count("*").alias("__size"))
    placed = written(join_measured(placed, size, keys))
    draw = lambda r: F.floor(uniform_hash("__rid", r + seed) * F.col("__size")).cast("long") + 1
    # Places are dealt out to as many tasks as their number needs, and meet their rows there.
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-placed.count() * n // TASK_DRAWS))
    draws = placed.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw)).alias("r", "__place")).repartition(parts, *keys, "__place")
    hits = draws.groupBy(*keys, "__place").agg(*[F.count_if(F.col("r") == r).cast("int").alias(f"__w{r}") for r in range(n)])
    hits = hits.select(*keys, "__place", F.array(*[f"__w{r}" for r in range(n)]).alias("weights"))
    placed = placed.repartition(parts, *keys, "__place")
    none = F.array_repeat(F.lit(0), n)
    return written(placed.join(hits, [*keys, "__place"], "left").withColumn("weights", F.coalesce("weights", none)).drop("__place", "__size", "__rid"))


def by_replicate(weighed: DataFrame) -> DataFrame:
    """One row per row and replicate with its weight; drawn tells whether the replicate has it."""
    long = weighed.select("*", F.posexplode("weights").alias("replicate", "weight")).drop("weights")
    return long.withColumn("drawn", F.col("weight") > 0)


def weighted_moments(df: DataFrame, keys: list[str], columns: list[str], base: DataFrame, base_keys: list[str], weight: str = "weight") -> DataFrame:
    """Weighted population co-moments in the layout of co_moments, on values shifted by the mean of the uncopied rows."""
    shift = base.groupBy(*base_keys).agg(*[F.avg(c).alias(f"__s_{c}") for c in columns])
    j = join_measured(df, shift, base_keys)
    v = {c: F.col(c) - F.col(f"__s_{c}") for c in columns}
    w = F.col(weight).cast("double")
    pairs = [(i, k) for i in range(len(columns)) for k in range(i, len(columns))]
    agg = j.groupBy(*keys).agg(
        F.sum(w).alias("__w"), *[F.first(f"__s_{c}").alias(f"__s_{c}") for c in columns], *[F.sum(w * v[c]).alias(f"__m_{c}") for c in columns],
        *[F.sum(w * v[columns[i]] * v[columns[k]]).alias(f"__p_{i}_{k}") for i, k in pairs])
    mean = lambda c: F.col(f"__m_{c}") / F.col("__w")
    packed = F.array(*[F.struct(
        F.lit(columns[i]).alias("a"), F.lit(columns[k]).alias("b"), F.col("__w").cast("long").alias("n"),
        (mean(columns[i]) + F.col(f"__s_{columns[i]}")).alias("mean_a"), (mean(columns[k]) + F.col(f"__s_{columns[k]}")).alias("mean_b"),
        (F.col(f"__p_{i}_{k}") / F.col("__w") - mean(columns[i]) * mean(columns[k])).alias("cov")) for i, k in pairs])
    agg = agg.where("__w > 0")
    return agg.select(*keys, F.inline(packed))


def bootstrap_oob(df: DataFrame, keys: list[str], features: list[str], target: str, row_id: Column, n: int = 20, kind: str = "ols",
                  alphas: list[float] = [0.0], min_test: int = 5, seed: int = 0) -> DataFrame:
    """Refit per replicate and alpha and score the rows it did not draw: keys, replicate, alpha, actual, prediction.

    A replicate draws as many rows as its group has. One with fewer than `min_test` unused
    rows is tested on a random fifth (at least `min_test` rows) instead; only tiny groups get
    there.
    """
    by = [*keys, "replicate"]
    rows = df.select(*keys, *features, target, row_id.alias("__rid"))
    weighed = resampled(rows.withColumn("__id", F.col("__rid")), keys, F.col("__rid"), n, seed, [*features, target]).withColumnRenamed("__id", "__rid")
    r = by_replicate(weighed)
    coefs = coefficients(weighted_moments(r, by, [*features, target], rows, keys), by, features, target, kind, alphas)

    def scored(test: DataFrame) -> DataFrame:
        asked = test.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))) if len(alphas) > 1 else test.withColumn("alpha", F.lit(float(alphas[0])))
        return score_linear(asked, coefs, [*by, "alpha"], features).select(*by, "alpha", F.col(target).alias("actual"), "prediction")

    size = r.groupBy(*by).agg(F.count_if(~F.col("drawn")).alias("__oob"), F.count("*").alias("__n"))
    thin = materialise(size.where(F.col("__oob") < min_test))
    if thin.isEmpty():
        return scored(r.where(~F.col("drawn")))
    oob = r.where(~F.col("drawn")).join(thin, by, "left_anti")
    w = Window.partitionBy(*by).orderBy(uniform_hash("__rid", F.col("replicate") + 100003 + seed), "__rid")
    fallback = r.join(thin, by).withColumn("__rank", F.row_number().over(w)).where(
        F.col("__rank") <= F.greatest(F.lit(min_test), F.ceil(F.col("__n") * 0.2).cast("int")))
    return scored(oob.unionByName(fallback.select(*oob.columns)))


def selection_stability(df: DataFrame, keys: list[str], features: list[str], target: str, row_id: Column, alpha: float, n: int = 20, seed: int = 0,
                        eps: float = 1e-12) -> DataFrame:
    """How often the lasso keeps each feature over bootstrap replicates; stable above one half."""
    by = [*keys, "replicate"]
    r = by_replicate(resampled(df.select(*keys, *features, target, row_id.alias("__id")), keys, F.col("__id"), n, seed, [*features, target]))
    coefs = coefficients(weighted_moments(r, by, [*features, target], df, keys), by, features, target, "lasso", [alpha])
    freq = coefs.where(F.col("feature") != INTERCEPT).groupBy(*keys, "feature").agg(
        F.avg((F.abs("coefficient") > eps).cast("double")).alias("frequency"), F.count("*").alias("n_replicates"))
    return freq.withColumn("stable", F.col("frequency") > 0.5)


def walk_forward_linear(df: DataFrame, keys: list[str], features: list[str], target: str, weeks: DataFrame, start: str, ts: str = "utc_ts",
                        kind: str = "ols", alpha: float = 0.0, midnight_cut: bool = False) -> DataFrame:
    """Validation predictions of a model refitted every week on everything before it.

    Rows enter the sums of the first week that trains on them; running sums over the
    weeks give each week's training moments, so no row is read twice for two weeks.
    """
    cols = [*features, target]
    f = assign_folds(df.dropna(subset=cols), start, ts, midnight_cut)
    shift = f.groupBy(*keys).agg(*[F.avg(c).alias(f"__s_{c}") for c in cols])
    v = {c: F.col(c) - F.col(f"__s_{c}") for c in cols}
    pairs = [(i, k) for i in range(len(cols)) for k in range(i, len(cols))]
    sums = join_measured(f, shift, keys).groupBy(*keys, F.col("first_train_week").alias("week_num")).agg(
        F.count("*").alias("__n"), *[F.sum(v[c]).alias(f"__m_{c}") for c in cols], *[F.sum(v[cols[i]] * v[cols[k]]).alias(f"__p_{i}_{k}") for i, k in pairs])
    parts = ["__n", *[f"__m_{c}" for c in cols], *[f"__p_{i}_{k}" for i, k in pairs]]
    # One row per (group, week to predict) among the (group, week) sums: calendar-sized.
    val = f.where("val_week is not null").withColumn("week_num", F.col("val_week")).drop("val_week", "first_train_week").join(
        weeks.select("week_num"), "week_num", "left_semi")
    asked = val.select(*keys, "week_num").distinct().withColumn("__ask", F.lit(1))
    steps = sums.withColumn("__ask", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("week_num", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    cum = steps.select(*keys, "week_num", "__ask", *[F.sum(p).over(w).alias(p) for p in parts]).where("__ask = 1 and __n > 1").join(shift, keys)
    mean = lambda c: F.col(f"__m_{c}") / F.col("__n")
    packed = F.array(*[F.struct(
        F.lit(cols[i]).alias("a"), F.lit(cols[k]).alias("b"), F.col("__n").alias("n"), (mean(cols[i]) + F.col(f"__s_{cols[i]}")).alias("mean_a"),
        (mean(cols[k]) + F.col(f"__s_{cols[k]}")).alias("mean_b"), (F.col(f"__p_{i}_{k}") / F.col("__n") - mean(cols[i]) * mean(cols[k])).alias("cov")) for i, k in pairs])
    by = [*keys, "week_num"]
    coefs = coefficients(cum.select(*by, F.inline(packed)), by, features, target, kind, [alpha])
    return score_linear(val, coefs, by, features)
