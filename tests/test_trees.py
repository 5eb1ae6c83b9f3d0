"""Boosted trees against a plain version that grows one model at a time by trying every split."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlab.learning import trees
from spreadlab.learning.trees import Spec

FEATURES = ["fa", "fb", "fc"]


def table(seed, n=400, classes=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.randrange(9), rng.gauss(0, 3), rng.random()
        score = a + 2 * (b > 1) - 3 * c + rng.gauss(0, 0.5)
        rows.append((rng.choice([1, 2, 3]), k, a if k % 50 else None, b, c, score, min(classes - 1, max(0, int(score // 3))), rng.choice([1.0, 2.5]), "x"))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "end_hour int, id long, fa int, fb double, fc double, y double, cls int, weight double, m string").repartition(parts)


class Plain:
    """One model on lists of rows; a margin per class."""

    def __init__(self, rows, label, spec, number, models, weighted=True):
        self.spec = spec
        x = [[float(v) for v in r[2:5]] for r in rows]
        y = [float(r[label]) for r in rows]
        w = [r[7] if weighted else 1.0 for r in rows]
        self.edges = []
        for f in range(3):
            values = sorted(v[f] for v in x)
            self.edges.append(sorted({values[math.floor((len(values) - 1) * k / spec.bins)] for k in range(1, spec.bins)}))
        self.base = sum(a * b for a, b in zip(y, w)) / sum(w) if spec.objective == "squared" else 0.0
        self.trees = []
        margin = [[self.base] * spec.classes for _ in rows]
        for t in range(spec.trees):
            seen = trees.drawn(np.array([r[1] for r in rows], np.int64), spec, t)
            may = trees.allowed(models, 3, spec, t)[number]
            grown = []
            for k in range(spec.classes):
                g, h = zip(*(self.slopes(y[i], margin[i], k) for i in range(len(rows))))
                use = [i for i in range(len(rows)) if seen[i]]
                grown.append(self.grow(x, [a * b for a, b in zip(g, w)], [a * b for a, b in zip(h, w)], use, may, 0))
            self.trees.append(grown)
            margin = [[v + self.fall(grown[k], x[i]) for k, v in enumerate(margin[i])] for i in range(len(rows))]

    def slopes(self, y, margin, k):
        if self.spec.objective == "squared":
            return margin[0] - y, 1.0
        if self.spec.objective == "logistic":
            p = 1 / (1 + math.exp(-margin[0]))
            return p - y, p * (1 - p)
        total = sum(map(math.exp, margin))
        p = math.exp(margin[k]) / total
        return p - (y == k), 2 * p * (1 - p)

    def grow(self, x, g, h, rows, may, depth):
        s = self.spec
        shrunk = lambda v: math.copysign(max(abs(v) - s.l1, 0), v)
        score = lambda part: shrunk(sum(g[i] for i in part)) ** 2 / (sum(h[i] for i in part) + s.l2)
        best = None
        if depth < s.depth:
            for f in range(3):
                for cut in self.edges[f] if may[f] else []:
                    left = [i for i in rows if x[i][f] <= cut]
                    right = [i for i in rows if x[i][f] > cut]
                    if not left or not right or min(sum(h[i] for i in left), sum(h[i] for i in right)) < s.min_child:
                        continue
                    gain = 0.5 * (score(left) + score(right) - score(rows))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                        best = (gain, f, cut, left, right)
        if best is None:
            return -s.rate * shrunk(sum(g[i] for i in rows)) / (sum(h[i] for i in rows) + s.l2)
        _, f, cut, left, right = best
        return f, cut, self.grow(x, g, h, left, may, depth + 1), self.grow(x, g, h, right, may, depth + 1)

    def fall(self, node, x):
        while isinstance(node, tuple):
            f, cut, left, right = node
            node = left if x[f] <= cut else right
        return node

    def margins(self, x):
        return [self.base + sum(self.fall(t[k], x) for t in self.trees) for k in range(self.spec.classes)]


CASES = [
    (Spec("squared", trees=9, depth=2, rate=0.3, bins=16), 5),
    (Spec("squared", trees=4, depth=2, rate=0.5, bins=8, subsample=0.7, columns=0.7, l1=0.4, l2=2.0, min_child=5.0), 5),
    (Spec("logistic", trees=3, depth=3, rate=0.2, bins=16, subsample=0.8, columns=0.7, l1=1.0, l2=2.0, min_child=3.0), 6),
    (Spec("softmax", classes=3, trees=3, depth=2, rate=0.3, bins=8, subsample=0.9), 6),
]


@pytest.mark.parametrize(("spec", "label"), CASES)
def test_fit_equals_plain_boosting(spark, spec, label):
    rows = table(1, classes=max(2, spec.classes))
    df = frame(spark, rows)
    forest = trees.fit(df, ["end_hour"], FEATURES, df.columns[label], F.col("id"), spec, "weight")
    whole = [r for r in rows if r[2] is not None]
    assert forest.models == [(1,), (2,), (3,)]
    plain = {hour: Plain([r for r in whole if r[0] == hour], label, spec, k, 3) for k, hour in enumerate((1, 2, 3))}
    got = {r.id: r for r in forest.margins(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r[2] is None:
            assert got[r[1]].margin is None
        else:
            assert got[r[1]].margin == pytest.approx(plain[r[0]].margins([float(v) for v in r[2:5]]), abs=2e-5)


def test_predictions_follow_from_margins(spark):
    rows = table(2, 200, 3)
    df = frame(spark, rows)
    spec = Spec("softmax", classes=3, trees=5, depth=2, rate=0.4)
    forest = trees.fit(df.where("end_hour < 3"), ["end_hour"], FEATURES, "cls", F.col("id"), spec)
    out = forest.predict(df).join(forest.margins(df).select("id", "margin"), "id").collect()
    for r in out:
        if r.margin is None:
            assert r.end_hour == 3 or r.fa is None
            assert r.predicted_class is None and r.predicted_prob_class_2 is None and r.prediction_confidence is None
            continue
        e = [math.exp(v) for v in r.margin]
        p = [r.predicted_prob_class_0, r.predicted_prob_class_1, r.predicted_prob_class_2]
        assert p == pytest.approx([v / sum(e) for v in e]) and r.prediction_confidence == max(p) and r.predicted_class == p.index(max(p))


def test_fit_does_not_depend_on_partitions_and_carried_margins(spark, monkeypatch):
    rows = table(3, 300)
    spec = Spec("logistic", trees=4, depth=2, rate=0.3, subsample=0.8)
    tables = []
    for parts, pending in ((1, 8), (7, 2)):
        monkeypatch.setattr(trees, "PENDING", pending)
        df = frame(spark, rows, parts)
        tables.append(sorted(map(str, trees.fit(df, ["end_hour"], FEATURES, "cls", F.col("id"), spec).table(spark).collect())))
    assert tables[0] == tables[1]


def jobs_of(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark):
    df = frame(spark, table(7, 200))
    few, many = (jobs_of(spark, f"fit of {n} trees", lambda n=n: trees.fit(df, ["end_hour"], FEATURES, "y", F.col("id"), Spec("squared", trees=n, depth=3))) for n in (2, 12))
    assert few == many


@pytest.mark.parametrize(("spec", "label"), [CASES[1], CASES[3]])
def test_cells_grow_the_trees_of_level_jobs(spark, monkeypatch, spec, label):
    """All models in one task each, in several parts; the largest by levels; all by levels."""
    df = frame(spark, table(8, 300, max(2, spec.classes)))
    sizes = sorted(r["count"] for r in df.dropna(subset=FEATURES).groupBy("end_hour").count().collect())
    tables = []
    for changes in ({}, {"COUNTED": 20}, {"WHOLE_ROWS": sizes[1]}, {"WHOLE": 0}):
        with monkeypatch.context() as m:
            for name, value in changes.items():
                m.setattr(trees, name, value)
            tables.append(sorted(map(str, trees.fit(df, ["end_hour"], FEATURES, df.columns[label], F.col("id"), spec, "weight").table(spark).collect())))
    assert tables[0] and all(t == tables[0] for t in tables)


def test_cells_of_many_bins_and_parts():
    """More bins than a byte holds; cells of parts add up to those of all rows."""
    rng = np.random.default_rng(9)
    bins, y, w = rng.integers(0, 300, (2, 900)).astype(np.int16), rng.integers(0, 2, 900).astype(float), rng.choice([1.0, 2.5], 900)
    bins[:, 450:] = bins[:, :450]
    ids, first = np.arange(900) % 400, np.zeros(900, np.int32)
    for spec in (Spec("squared", trees=3, subsample=0.6), Spec("logistic", trees=3, subsample=0.6), Spec("logistic")):
        of = lambda at: trees.cells_of(spec, bins[:, at], y[at], w[at], ids[at], first[at], 2.0**-20, 0.5)
        one, other = of(slice(None)), trees.Cells.joined([of(slice(0, None, 2)), of(slice(1, None, 2))])
        assert len(one.y) < 900 and all(np.array_equal(a, b) for a, b in zip(vars(one).values(), vars(other).values()) if a is not None)
        assert one.seen.shape == (1 if spec.subsample == 1 else 3, len(one.y))
        assert one.seen.sum(axis=1).tolist() == [int(trees.drawn(ids, spec, t).sum()) for t in range(len(one.seen))]


@pytest.mark.parametrize("spec", [Spec("logistic", trees=2, depth=2), Spec("squared", trees=3, depth=2, subsample=0.7, columns=0.5)])
def test_weeks_from_cells_are_those_of_level_jobs(spark, monkeypatch, spec):
    rng = np.random.default_rng(5)
    start = dt.datetime(2025, 1, 1)
    rows = [(i % 9 // 8, i, start + dt.timedelta(hours=2 * i), float(x), float(rng.integers(0, 3)), int(x + 2 * rng.normal() > 3)) for i, x in enumerate(rng.integers(0, 6, size=500))]
    df = spark.createDataFrame(rows, "end_hour int, id long, utc_ts timestamp, x double, z double, y int")
    tables = []
    for changes in ({}, {"WHOLE": 0}):
        with monkeypatch.context() as m:
            for name, value in changes.items():
                m.setattr(trees, name, value)
            tables.append(sorted(map(str, trees.walk_forward(df, ["end_hour"], ["x", "z"], "y", F.col("id"), spec, "2025-01-01").collect())))
    assert tables[0] and all(t == tables[0] for t in tables)


def test_three_ways_to_score_agree(spark, monkeypatch):
    rows = table(10, 250, 3)
    df = frame(spark, rows)
    forest = trees.fit(df.where("end_hour < 3"), ["end_hour"], FEATURES, "cls", F.col("id"), Spec("softmax", classes=3, trees=4, depth=3, bins=8))
    far = df.withColumns({"fb": F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 7 == 1, float("inf")).when(F.col("id") % 7 == 2, -1e9).otherwise(F.col("fb") * 3)})
    scores = []
    for changes in ({}, {"LATTICE": 0}, {"LATTICE": 0, "WALKED": 0}):
        for name, value in changes.items():
            monkeypatch.setattr(trees, name, value)
        scores.append({r.id: r.margin for r in forest.margins(far).collect()})
    assert len(scores[0]) == 250 and any(v is None for v in scores[0].values()) and any(v is not None for v in scores[0].values())
    for other in scores[1:]:
        assert {k: v is None for k, v in other.items()} == {k: v is None for k, v in scores[0].items()}
        assert all(v is None or v == pytest.approx(other[k]) for k, v in scores[0].items())


def test_versions_of_a_row_are_scored_side_by_side(spark):
    df = frame(spark, table(11, 120))
    forest = trees.fit(df, ["end_hour"], FEATURES, "cls", F.col("id"), Spec("logistic", trees=2, depth=2))
    moved = {f"m{i}": [F.col(f) + i for f in FEATURES] for i in (0, 1, 5)}
    out = {r.id: r for r in forest.margins_of(df, moved).collect()}
    for i in (0, 1, 5):
        alone = forest.margins(df.withColumns({f: F.col(f) + i for f in FEATURES})).collect()
        assert len(alone) == len(out) and all(r.margin == out[r.id][f"m{i}"] for r in alone)


def test_table_importances_and_complexity(spark):
    df = frame(spark, table(4))
    spec = Spec("squared", trees=3, depth=3)
    forest = trees.fit(df, ["end_hour"], FEATURES, "y", F.col("id"), spec)
    nodes = forest.table(spark).cache()
    rows = nodes.collect()
    by = {(r.end_hour, r.tree, r["class"], r.node): r for r in rows}
    for r in rows:
        if r.feature is not None:
            left, right = (by[(r.end_hour, r.tree, r["class"], c)] for c in (r.left, r.right))
            assert r.n_rows == left.n_rows + right.n_rows and r.cover == pytest.approx(left.cover + right.cover) and r.value is None and r.gain > 0
        else:
            assert r.left is None and r.value is not None
    gain, total = Counter(), Counter()
    for r in rows:
        gain[r.end_hour, r.feature] += r.gain
        total[r.end_hour] += r.gain
    imp = trees.importances(nodes, ["end_hour"], FEATURES).collect()
    assert len(imp) == 9 and all(r.importance == pytest.approx(gain[r.end_hour, r.feature] / total[r.end_hour]) for r in imp)
    for r in trees.complexity(nodes, ["end_hour"]).collect():
        own = [x for x in rows if x.end_hour == r.end_hour]
        assert (r.n_trees, r.nodes, r.leaves) == (3, len(own), sum(x.feature is None for x in own)) and r.leaves * 2 - r.n_trees == r.nodes and r.depth == 3


def test_table_keeps_leaves_without_arrow(spark):
    """Leaves have no children: their nulls must not turn the column of whole numbers into fractions."""
    df = frame(spark, table(6, 120))
    forest = trees.fit(df, ["end_hour"], FEATURES, "cls", F.col("id"), Spec("logistic", trees=1, depth=1, min_child=0.1))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        rows = forest.table(spark).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert any(r.left == 2 and r.right == 3 for r in rows) and any(r.left is None and r.value is not None for r in rows)


def test_every_row_is_scored(spark):
    rows = [(1 + i % 3, i, float(i % 7), int(i % 7 > 3)) for i in range(90)] + [(30, 90, 1.0, 0)]
    df = spark.createDataFrame(rows, "end_hour int, id long, x double, y int")
    forest = trees.fit(df.where("end_hour <= 2"), ["end_hour"], ["x"], "y", F.col("id"), Spec("logistic", trees=2, depth=2))
    out = forest.predict(df)
    assert out.count() == 91 and out.where("predicted_class is null").count() == 31
    assert out.where("predicted_class is not null AND predicted_class != y").count() == 0
    assert {(r.end_hour, r.n_rows) for r in forest.skipped(df).collect()} == {(3, 30), (30, 1)}


def test_walk_forward_equals_a_fit_per_week(spark):
    """Few distinct values, so that the bins of all rows are those of each week's rows."""
    rng = np.random.default_rng(4)
    start = dt.datetime(2025, 1, 1)
    rows = [(1 + i % 2, i, start + dt.timedelta(hours=2 * i), float(x), int(x + 2 * rng.normal() > 3)) for i, x in enumerate(rng.integers(0, 6, size=330))]
    df = spark.createDataFrame(rows, "end_hour int, id long, utc_ts timestamp, x double, y int")
    spec = Spec("logistic", trees=2, depth=2, subsample=0.8)
    out = trees.walk_forward(df, ["end_hour"], ["x"], "y", F.col("id"), spec, "2025-01-01").collect()
    sundays = [start + dt.timedelta(days=4 + 7 * w) for w in range(4)]
    assert {r.week_num for r in out} == {1, 2, 3} and len(out) == 3 * 84
    for w in (1, 3):
        forest = trees.fit(df.where(F.col("utc_ts") < sundays[w - 1]), ["end_hour"], ["x"], "y", F.col("id"), spec)
        alone = {r.id: r.predicted_prob_class_1 for r in forest.predict(df.where((F.col("utc_ts") >= sundays[w - 1]) & (F.col("utc_ts") < sundays[w]))).collect()}
        assert {r.id: r.predicted_prob_class_1 for r in out if r.week_num == w} == pytest.approx(alone)


def test_constant_labels_and_no_rows(spark):
    df = frame(spark, [(1, k, k, 1.0, 2.0, 5.0, 0, 1.0, "x") for k in range(20)])
    forest = trees.fit(df, ["end_hour"], FEATURES, "y", F.col("id"), Spec("squared", trees=3, depth=2))
    assert all(r.margin == pytest.approx([5.0]) for r in forest.margins(df).collect())
    assert trees.fit(df.limit(0), ["end_hour"], FEATURES, "y", F.col("id"), Spec("squared")).models == []


def test_preset_names():
    from spreadlab.learning.selection import TUNED_PRESET

    spec = Spec.of_preset(TUNED_PRESET, objective="logistic")
    assert (spec.trees, spec.depth, spec.l1, spec.l2, spec.min_child) == (72, 5, 1, 2, 3)
