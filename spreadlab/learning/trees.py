"""Boosted trees of many models at once, from rows that are binned once.

Rows of a model in the same bins have the same margin in every tree, so their gradients add up to
counts: a task counts the rows that each tree sees by (bins, label, weight), and one task grows all
trees of a model from these cells, whose number the bins bound whatever the rows. A model whose
cells are more than a task may hold goes level by level: a level of all such models is one
aggregation over blocks of their rows that Spark keeps; it sums gradients and hessians by (model,
class, node, feature, bin) in every task and adds the tasks' sums by model. Gradients are
whole numbers of a fixed quantum, so sums are exact and a fit does not depend on how rows are
dealt out, nor on the way that a model goes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadlab.learning.folds import assign_folds, operational_weeks
from spreadlab.learning.scoring import classified
from spreadlab.operators.quantiles import exact_quantiles
from spreadlab.session import checkpoint_dir, join_measured, written

#: Trees that are walked again for every level before the margins are written anew.
PENDING = 8
#: Bits of the largest gradient: 10^11 rows of it still add up in a long.
QUANTUM_BITS = 25
#: Models that one fit may hold; their trees and edges come to the driver.
MOST_MODELS = 1 << 14
#: Binned rows of a task, at most and, while there are fewer tasks than cores, at least.
PART_ROWS = 1 << 20
LEAST_ROWS = 1 << 14
#: Rows that a task counts, and rows that it bins at once.
COUNTED, BINNED = 1 << 21, 1 << 18
#: Rows and bytes of the cells of a model that one task fits; up to these rows sums of whole quanta are exact in doubles.
WHOLE_ROWS, WHOLE = 1 << 27, 1 << 28
#: Bytes of trees that go to every task for scoring, or of the margins of all bins, and models of which a task finds the bins.
WALKED, LATTICE, LOOKED_UP = 1 << 26, 1 << 27, 1 << 8
#: Times that margins are carried before the blocks are written.
LINEAGE = 16


@dataclass(frozen=True)
class Spec:
    """Parameters of a fit; objective is squared, logistic or softmax (then with `classes`)."""

    objective: str = "squared"
    classes: int = 1
    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    bins: int = 32
    subsample: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    min_child: float = 1.0
    seed: int = 42

    @staticmethod
    def of_preset(preset: dict, **more) -> Spec:
        """From the names that parameter sets of boosted models use; the weight of positive rows is a column of the rows."""
        return Spec(trees=preset["n_estimators"], depth=preset["max_depth"], rate=preset["learning_rate"], subsample=preset["subsample"], columns=preset["colsample_bytree"],
                    l1=preset["reg_alpha"], l2=preset["reg_lambda"], min_child=preset["min_child_weight"], **more)


def bin_edges(df: DataFrame, keys: list[str], features: list[str], bins: int) -> DataFrame:
    """(keys, f, edges): per model and feature number the distinct order statistics that part its rows into at most `bins` bins."""
    probs = {f"q{k}": k / bins for k in range(1, bins)}
    long = df.select(*keys, F.posexplode(F.array(*features)).alias("f", "value"))
    q = exact_quantiles(long, [*keys, "f"], "value", probs, interpolate=False)
    return q.select(*keys, "f", F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def drawn(ids: np.ndarray, spec: Spec, tree: int) -> np.ndarray:
    """Rows that a tree sees, by their id: the same on every run."""
    if spec.subsample >= 1:
        return np.ones(len(ids), bool)
    seed = np.uint64((spec.seed * 1_000_003 + tree) & 0xFFFFFFFF)
    return mixed(ids.view(np.uint64) + mixed(np.array([seed], np.uint64))) < np.uint64(int(spec.subsample * 2**64))


def allowed(models: int, n_features: int, spec: Spec, tree: int) -> np.ndarray:
    """(models, features): the features that a tree of each model may split on."""
    some = max(1, int(spec.columns * n_features))
    cells = np.arange(models * n_features, dtype=np.uint64) + np.uint64(((spec.seed + 7) * 1_000_003 + tree) & 0xFFFFFFFF) * np.uint64(1 << 24)
    order = np.argsort(mixed(cells).reshape(models, n_features), axis=1, kind="stable")
    out = np.zeros((models, n_features), bool)
    np.put_along_axis(out, order[:, :some], True, axis=1)
    return out


#: What a tree knows of its nodes.
TREE = ["feature", "cut", "value", "gain", "cover", "count"]


class Tree:
    """One tree for every model and class, nodes as in a heap from 1: feature (-1 at leaves), cut bin, value."""

    def __init__(self, models: int, classes: int, depth: int):
        shape = (models, classes, 2 << depth)
        self.depth = depth
        self.feature, self.cut, self.value = np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape)
        self.gain, self.cover, self.count = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int64)

    def __getstate__(self) -> dict:
        """What travels with a job: enough to walk."""
        return {"depth": self.depth, "feature": self.feature, "cut": self.cut, "value": self.value}

    def walk(self, model: int, k: int, bins: np.ndarray, n: int, steps: int) -> np.ndarray:
        """Node of the first n rows of a model after some steps; `bins` has a row per feature. A row at a leaf goes on to the left, where the leaf's value is."""
        feature, cut = self.feature[model, k], self.cut[model, k]
        from_ = np.maximum(feature, 0) * np.int64(bins.shape[1])
        cut = np.where(feature >= 0, cut, np.iinfo(np.int16).max)
        node, row, flat = np.ones(n, np.int64), np.arange(n), bins.ravel()
        for _ in range(steps):
            node = 2 * node + (flat[from_[node] + row] > cut[node])
        return node

    def bottom(self, model: int, k: int) -> np.ndarray:
        """Values by node, those of leaves handed down to the nodes below them."""
        value, feature = self.value[model, k].copy(), self.feature[model, k]
        leaf = feature < 0
        for node in range(2, len(value)):
            if leaf[node // 2]:
                value[node] = value[node // 2]
        return value


def gradients(y: np.ndarray, margin: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, (rows, classes)."""
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], p * (1 - p)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(margin.shape[1])), 2 * p * (1 - p)


def quanta(objective: str, y: np.ndarray, w: np.ndarray, margin: np.ndarray, quantum: float, centre: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of weighted rows as whole numbers of the quantum, (rows, classes); with squared loss margins and labels are rounded each for themselves, as distances from a centre."""
    w = w[:, None] / quantum
    if objective == "squared":
        return np.rint((margin - centre) * w) - np.rint((y[:, None] - centre) * w), np.rint(np.broadcast_to(w, margin.shape))
    g, h = gradients(y, margin, objective)
    return np.rint(g * w), np.rint(h * w)


@dataclass
class Block:
    """Binned rows of one group of keys: y, w, ids, bins (a row per feature) and margins (a row per class).

    With a fan, rows stand by the first number that they train, and have no margins.
    """

    group: int
    y: np.ndarray
    w: np.ndarray
    id: np.ndarray
    bins: np.ndarray
    margin: np.ndarray | None
    first: np.ndarray | None

    def models(self, fan: dict[int, tuple[int, int, int]] | None) -> Iterator[tuple[int, int]]:
        """(model, n): the first n rows train the model."""
        if fan is None:
            yield self.group, len(self.y)
            return
        start, low, high = fan[self.group]
        ends = np.searchsorted(self.first, np.arange(low, high + 1), side="right")
        for i, n in enumerate(ends.tolist()):
            if n:
                yield start + i, n

    def margins(self, model: int, n: int, base: np.ndarray, pending: list[Tree]) -> np.ndarray:
        out = np.repeat(base[model][:, None], n, axis=1) if self.margin is None else self.margin.copy()
        for tree in pending:
            for k in range(len(out)):
                out[k] += tree.bottom(model, k)[tree.walk(model, k, self.bins, n, tree.depth)]
        return out


def packed(n_features: int, edges, base: np.ndarray, bins: int, fanned: bool):
    """Blocks of a task's rows (group, first, y, w, id, features), pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def blocks() -> Iterator[bytes]:
            t = pa.Table.from_batches(held)
            group, first, y, w, ids, *xs = (c.to_numpy() for c in t.columns)
            order = np.lexsort((first, group))
            heads = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            for at in np.split(order, heads[1:]):
                g = int(group[at[0]])
                x = np.stack([np.searchsorted(e, v[at]) for e, v in zip(edges.value[g], xs)]).astype(np.uint8 if bins <= 256 else np.int16)
                margin = None if fanned else np.repeat(base[g][:, None], len(at), axis=1)
                yield pickle.dumps(Block(g, y[at], w[at], ids[at], x, margin, first[at] if fanned else None), pickle.HIGHEST_PROTOCOL)

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= 2 * PART_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks()), pa.binary())], ["block"])
                held, count = [], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks()), pa.binary())], ["block"])

    return run


def histograms(spec: Spec, shared, tree, level: int, number: int, quantum: float):
    """(model and class, sums of g, h and rows by node, feature and bin) of a task's rows in the nodes of a level."""
    nodes = 1 << level

    def run(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        fan, base, pending, may = shared.value
        now = tree.value
        for block in blocks:
            seen = drawn(block.id, spec, number)
            centre = base[fan[block.group][0] if fan else block.group, 0]
            for model, n in block.models(fan):
                open_ = [k for k in range(spec.classes) if not level or (now.feature[model, k, nodes >> 1 : nodes] >= 0).any()]
                if not open_:
                    continue
                g, h = quanta(spec.objective, block.y[:n], block.w[:n], block.margins(model, n, base, pending).T, quantum, centre)
                for k in open_:
                    node = now.walk(model, k, block.bins, n, level)
                    real = np.append(now.feature[model, k, nodes >> 1 : nodes] >= 0, False) if level else np.array([True])
                    use = seen[:n] & (real[(node >> 1) - (nodes >> 1)] if level else True)
                    whole = bool(use.all())
                    at, gk, hk = ((node - nodes, g[:, k], h[:, k]) if whole else (v[use] for v in (node - nodes, g[:, k], h[:, k])))
                    out = np.zeros((3, nodes, len(block.bins), spec.bins), np.int64)
                    for f in np.flatnonzero(may[model]):
                        b = block.bins[f, :n]
                        cell = at * spec.bins + (b if whole else b[use])
                        # A block's sums of whole numbers are exact in doubles.
                        for i, v in enumerate((gk, hk, None)):
                            out[i, :, f] = np.bincount(cell, v, nodes * spec.bins).reshape(nodes, spec.bins)
                    yield model * spec.classes + k, out

    return run


def best_splits(spec: Spec, quantum: float, key: int, sums: np.ndarray, may: np.ndarray) -> list[tuple]:
    """(model and class, node, g, h, n, gain or None, bin, gl, hl, nl) from the whole sums of a model's class; of equal gains the least bin."""
    real = lambda v: v * quantum

    def score(g, h):
        return np.maximum(np.abs(real(g)) - spec.l1, 0.0) ** 2 / (real(h) + spec.l2)

    g, h, n = sums
    some = int(np.flatnonzero(may)[0])
    total = [v[:, some].sum(axis=1)[:, None, None] for v in (g, h, n)]
    left = [v.cumsum(axis=2) for v in (g, h, n)]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (score(left[0], left[1]) + score(total[0] - left[0], total[1] - left[1]) - score(total[0], total[1]))
        fits = (real(left[1]) >= spec.min_child) & (real(total[1] - left[1]) >= spec.min_child) & (left[2] > 0) & (left[2] < total[2]) & (gain > 1e-9)
    gain = np.where(fits, gain, -np.inf).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    out = []
    for node in np.flatnonzero(total[2].ravel()).tolist():
        b = int(best[node])
        top = float(gain[node, b])
        out.append((key, node, *(int(v[node, 0, 0]) for v in total), top if top > -np.inf else None, b, *(int(v[node].ravel()[b]) for v in left)))
    return out


@dataclass
class Cells:
    """Rows of a group by bins, label (none with squared loss), weight and first number that they train, in this order.

    `seen` counts the rows of a cell that a tree sees, a row per tree, or one row where every
    tree sees all; `up` sums their labels' quanta (squared loss).
    """

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    first: np.ndarray
    seen: np.ndarray
    up: np.ndarray | None

    def bytes_of(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if v is not None)

    def of(self, at) -> Cells:
        return Cells(*(None if v is None else v[..., at] for v in vars(self).values()))

    def pieces(self, most: int = 1 << 22) -> Iterator[Cells]:
        step = max(1, most * len(self.y) // self.bytes_of())
        for i in range(0, len(self.y), step):
            yield self.of(slice(i, i + step))

    @staticmethod
    def joined(parts: list[Cells]) -> Cells:
        """One of several, equal cells added up."""
        cells = Cells(*(None if v[0] is None else np.concatenate(v, axis=-1) for v in zip(*(vars(p).values() for p in parts))))
        order, heads = grouped([*cells.bins, cells.y, cells.w, cells.first])
        if len(heads) == len(order):
            return cells.of(order)
        out = cells.of(order[heads])
        # A group has at most WHOLE_ROWS rows.
        out.seen = np.stack([np.add.reduceat(v[order].astype(np.uint32), heads) for v in cells.seen])
        if out.up is not None:
            out.up = np.stack([np.add.reduceat(v[order], heads) for v in cells.up])
        return out


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts rows by their columns, and where rows with other values begin in it."""
    code, size = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        if c.dtype == np.uint8:
            n = int(c.max()) + 1
        else:
            values, c = (c[:1], 0) if (c == c[0]).all() else np.unique(c, return_inverse=True)
            n = len(values)
        if size > (1 << 62) // n:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code, size = code * n + c, size * n
    order = np.argsort(code, kind="stable")
    code = code[order]
    return order, np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def cells_of(spec: Spec, bins: np.ndarray, y: np.ndarray, w: np.ndarray, ids: np.ndarray, first: np.ndarray, quantum: float, centre: float) -> Cells | None:
    """The cells of a task's rows; None if they are more than one task may fit."""
    squared = spec.objective == "squared"
    lift = np.rint((y - centre) * (w / quantum)).astype(np.int64) if squared else None
    label = np.zeros(len(y)) if squared else y
    order, heads = grouped([*bins, label, w, first])
    ends = np.append(heads[1:], len(order))
    every = spec.subsample >= 1
    turns, kind = 1 if every else spec.trees, np.min_scalar_type(int((ends - heads).max()))
    if len(heads) * turns * (kind.itemsize + 8 * squared) > WHOLE:
        return None
    at = order[heads]
    seen = np.empty((turns, len(heads)), kind)
    up = np.empty((turns, len(heads)), np.int64) if squared else None
    ids, lift = ids[order], lift[order] if squared else None
    # Runs of whole cells that stay in a core's cache while all trees draw from them.
    runs = np.unique(np.append(np.searchsorted(heads, np.arange(0, len(order), 1 << 14)), len(heads)))
    for a, b in zip(runs[:-1], runs[1:]):
        rows, starts = slice(heads[a], ends[b - 1]), heads[a:b] - heads[a]
        for t in range(turns):
            hit = drawn(ids[rows], spec, t)
            seen[t, a:b] = np.add.reduceat(hit.astype(np.int64), starts)
            if squared:
                up[t, a:b] = np.add.reduceat(lift[rows] * hit, starts)
    return Cells(bins[:, at], label[at], w[at], first[at], seen, up)


def dealt(edges, starts, parts):
    """Rows (group, first, y, w, id, features) as binned columns for the tasks that count their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def blocks() -> pa.RecordBatch:
            group, first, y, w, ids, *xs = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            order = np.argsort(group, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            part, out = [], []
            for at in np.split(order, heads[1:]):
                g = int(group[at[0]])
                bins = np.stack([np.searchsorted(e, v[at]) for e, v in zip(edges.value[g], xs)])
                bins = bins.astype(np.uint8 if bins.max() < 256 else np.int16)
                for i in range(min(parts[g], len(at))):
                    some = slice(i, None, parts[g])
                    part.append(starts[g] + i)
                    out.append(pickle.dumps((g, bins[:, some], y[at[some]], w[at[some]], ids[at[some]], first[at[some]]), pickle.HIGHEST_PROTOCOL))
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(out, pa.binary())], ["part", "block"])

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= BINNED:
                yield blocks()
                held, count = [], 0
        if count:
            yield blocks()

    return run


def counted(spec: Spec, quantum: float, centres: np.ndarray):
    """(group, bytes, piece of the cells) of a task's rows, which are all of one group; no piece where the cells are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [pickle.loads(b) for batch in batches for b in batch.column(1).to_pylist()]
        if not blocks:
            return
        group = blocks[0][0]
        bins, y, w, ids, first = (np.concatenate([b[i] for b in blocks], axis=-1) for i in range(1, 6))
        del blocks
        cells = cells_of(spec, bins, y, w, ids, first, quantum, float(centres[group]))
        for size, piece in [(WHOLE + 1, b"")] if cells is None else ((p.bytes_of(), pickle.dumps(p, pickle.HIGHEST_PROTOCOL)) for p in cells.pieces()):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([size], pa.int64()), pa.array([piece], pa.binary())], ["group", "size", "piece"])

    return run


def packs(widths: list[int], most: int = 1 << 12) -> list[list[int]]:
    """Features that are summed together: their bins make at most `most` cells."""
    out: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        for pack in out:
            if math.prod(widths[i] for i in (*pack, f)) <= most:
                pack.append(f)
                break
        else:
            out.append([f])
    return out


def boosted(spec: Spec, widths: list[int], cells: Cells, base: np.ndarray, may: np.ndarray, quantum: float, centre: float) -> list[Tree]:
    """All trees of one model from its cells: those that the level jobs grow from its rows."""
    change = np.zeros(len(cells.y), bool)
    change[:1] = True
    for b in cells.bins:
        change[1:] |= b[1:] != b[:-1]
    starts = np.flatnonzero(change)  # Cells of the same bins go down a tree together.
    own = np.cumsum(change) - 1
    bins = np.ascontiguousarray(cells.bins[:, starts])
    flat, row = bins.ravel(), np.arange(len(starts))
    together = []
    for pack in packs(widths):
        code = np.zeros(len(starts), np.int64)
        for f in pack:
            code = code * widths[f] + bins[f]
        together.append((pack, [widths[f] for f in pack], code))
    squared = spec.objective == "squared"
    margin = np.repeat(base[:, None], len(starts), axis=1)
    y = np.full(len(cells.y), centre) if squared else cells.y
    out = []
    for number in range(spec.trees):
        tree = Tree(1, spec.classes, spec.depth)
        out.append(tree)
        turn = number if len(cells.seen) > 1 else 0
        seen = cells.seen[turn].astype(float)
        g, h = quanta(spec.objective, y, cells.w, margin[:, own].T, quantum, centre)
        n = np.add.reduceat(seen, starts)
        for k in range(spec.classes):
            values = (np.add.reduceat(g[:, k] * seen - (cells.up[turn] if squared else 0), starts), np.add.reduceat(h[:, k] * seen, starts), n)
            node = np.ones(len(starts), np.int64)
            for level in range(spec.depth):
                nodes = 1 << level
                at = node - nodes
                if level:
                    real = np.repeat(tree.feature[0, k, nodes >> 1 : nodes] >= 0, 2)
                    if not real.all():
                        at = np.where(real, np.arange(nodes), nodes)[at]
                sums = np.zeros((3, nodes, len(widths), spec.bins), np.int64)
                for pack, shape, code in together:
                    if not may[number, pack].any():
                        continue
                    size = math.prod(shape)
                    cell = at * size + code
                    for i, v in enumerate(values):
                        part = np.bincount(cell, v, (nodes + 1) * size)[: nodes * size].reshape(nodes, *shape)
                        for j, f in enumerate(pack):
                            if may[number, f]:
                                sums[i, :, f, : shape[j]] = part.sum(axis=tuple(x + 1 for x in range(len(pack)) if x != j))
                more = grow(tree, best_splits(spec, quantum, k, sums, may[number]), level, spec, quantum)
                if not more:
                    node <<= spec.depth - level
                    break
                feature = tree.feature[0, k]
                from_ = np.maximum(feature, 0) * np.int64(len(starts))
                cut = np.where(feature >= 0, tree.cut[0, k], np.iinfo(np.int16).max)
                node = 2 * node + (flat[from_[node] + row] > cut[node])
            margin[k] += tree.bottom(0, k)[node]
    return out


def whole(spec: Spec, quantum: float, shared, copies: int):
    """(model, its trees' arrays) from rows (group, turn, piece) that stand by group and turn; a turn fits every `copies`-th model of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fan, base, widths, n_models = shared.value
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        # Features of a tree, for all models.
        may = np.stack([allowed(n_models, len(widths[0]), spec, t) for t in range(spec.trees)], axis=1)
        for (group, turn), pieces in groupby(rows, key=lambda r: r[:2]):
            cells = Cells.joined([pickle.loads(p[2]) for p in pieces])
            start, low, high = fan[group]
            centre = float(base[start, 0])
            for model, some in trained(cells, start, low, high, turn, copies):
                trees = boosted(spec, widths[group], some, base[model], may[model], quantum, centre)
                packed_ = pickle.dumps([np.concatenate([getattr(t, name) for t in trees]) for name in TREE], pickle.HIGHEST_PROTOCOL)
                yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([packed_], pa.binary())], ["model", "trees"])

    return run


def trained(cells: Cells, start: int, low: int, high: int, turn: int, copies: int) -> Iterator[tuple[int, Cells]]:
    """(model, cells of the rows that train it) for the models of a turn; a cell of a model has rows of all first numbers up to the model's."""
    if low == high:
        if turn == 0:
            yield start, cells
        return
    change = np.zeros(len(cells.y), bool)
    change[:1] = True
    for v in (*cells.bins, cells.y, cells.w):
        change[1:] |= v[1:] != v[:-1]
    own, every = np.cumsum(change) - 1, cells.of(np.flatnonzero(change))
    order = np.argsort(cells.first, kind="stable")
    ends = np.searchsorted(cells.first[order], np.arange(low, high + 1), side="right")
    rows, seen = np.zeros(len(every.y), np.int64), np.zeros(every.seen.shape)
    up, begin = None if cells.up is None else np.zeros(every.up.shape), 0
    for i, end in enumerate(ends.tolist()):
        new, begin = order[begin:end], end
        for t in range(len(seen)):
            seen[t] += np.bincount(own[new], cells.seen[t, new], len(rows))
            if up is not None:
                up[t] += np.bincount(own[new], cells.up[t, new], len(rows))
        rows += np.bincount(own[new], minlength=len(rows))
        if i % copies == turn and rows.any():
            at = np.flatnonzero(rows)
            yield start + i, replace(every, seen=seen, up=up).of(at)


def _given(model: pa.Array, xs: tuple[pa.Array, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Which rows of a batch have a model and all features; the models and features of those."""
    good = model.is_valid()
    for x in xs:
        good = pc.and_(good, x.is_valid())
    use = good.to_numpy(zero_copy_only=False)
    m = pc.fill_null(model, 0).to_numpy(zero_copy_only=False).astype(np.int64)[use]
    return use, m, [pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False)[use] for v in xs]


def _lists(use: np.ndarray, out: np.ndarray) -> pa.Array:
    """Rows of margins as lists, null where none is used."""
    counts = np.where(use, out.shape[1], 0)
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), mask=np.append(~use, False))
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))


class Forest:
    """The trees of all models: keys of the models, edges of their bins, one Tree a round."""

    def __init__(self, spec: Spec, keys: list[str], features: list[str], models: list[tuple], edges: list[list[list[float]]], base: np.ndarray):
        self.spec, self.keys, self.features, self.models, self.edges, self.base = spec, keys, features, models, edges, base
        self.trees: list[Tree] = []
        self.key_types: list = []

    def _frame(self, spark: SparkSession, columns: dict, types: str) -> DataFrame:
        """Columns of plain values as rows: a null among whole numbers stays one."""
        fields = ", ".join(f"{k} {t}" for k, t in zip(self.keys, self.key_types))
        return spark.createDataFrame(list(zip(*columns.values())), f"{fields}, {types}")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node: model keys, tree, class, node, feature, cut, left, right, value, gain, cover, n_rows.

        Rows with feature <= cut go left; leaves have neither and add `value` to the margin.
        """
        rows: dict[str, list] = {c: [] for c in (*self.keys, "tree", "class", "node", "feature", "cut", "left", "right", "value", "gain", "cover", "n_rows")}
        for t, tree in enumerate(self.trees):
            for m, k, node in np.argwhere(tree.count > 0).tolist():
                f = int(tree.feature[m, k, node])
                split = f >= 0
                for c, v in zip(rows, (*self.models[m], t, k, node, self.features[f] if split else None, self.edges[m][f][tree.cut[m, k, node]] if split else None, 2 * node if split else None,
                                       2 * node + 1 if split else None, None if split else float(tree.value[m, k, node]), float(tree.gain[m, k, node]), float(tree.cover[m, k, node]), int(tree.count[m, k, node]))):
                    rows[c].append(v)
        return self._frame(spark, rows, "tree int, class int, node int, feature string, cut double, left int, right int, value double, gain double, cover double, n_rows long")

    def arrays(self, spark: SparkSession) -> DataFrame:
        """One row per model: base margins and the trees' features, cuts and values, round by round, class by class."""
        cuts = np.zeros((len(self.models), len(self.features), self.spec.bins))
        for m, edges in enumerate(self.edges):
            for f, values in enumerate(edges):
                cuts[m, f, : len(values)] = values
        out: dict[str, list] = {c: [] for c in (*self.keys, "base", "feature", "cut", "value")}
        for m, key in enumerate(self.models):
            feature = np.concatenate([t.feature[m].ravel() for t in self.trees]).astype(np.int64)
            bins = np.concatenate([t.cut[m].ravel() for t in self.trees])
            cut = cuts[m, np.maximum(feature, 0), bins]
            for c, v in zip(out, (*key, self.base[m].tolist(), feature.tolist(), cut.tolist(), np.concatenate([t.value[m].ravel() for t in self.trees]).tolist())):
                out[c].append(v)
        if not self.models:
            out = {c: [] for c in out}
        return self._frame(spark, out, "base array<double>, feature array<int>, cut array<double>, value array<double>")

    def margins(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """Every row with the margins of its model's classes in an array; null without a model or with a missing feature."""
        return self.margins_of(df, {name: [F.col(f) for f in self.features]})

    def margins_of(self, df: DataFrame, versions: dict[str, list[Column]]) -> DataFrame:
        """A column of margins for every version of the features of a row.

        Where the margins of all bins of all models are up to LATTICE bytes, tasks look rows up in
        them. Trees of up to WALKED bytes go to the tasks, which walk all rows of a batch at once.
        Beyond, a fold over the trees with a walk from root to leaf inside; the trees of a
        model come with its row by a measured join.
        """
        if 0 < len(self.models) <= LOOKED_UP and sum(math.prod(len(e) + 1 for e in edges) for edges in self.edges) * self.spec.classes * 8 <= LATTICE:
            return self._looked_up(df, versions)
        if self.models and len(self.models) * len(self.trees) * self.spec.classes * (2 << self.spec.depth) * 20 <= WALKED:
            return self._walked(df, versions)
        spec, slots = self.spec, 2 << self.spec.depth
        table = self.arrays(df.sparkSession).withColumnsRenamed({c: f"__{c}" for c in ("base", "feature", "cut", "value")})
        rows = join_measured(df.withColumns({f"__x_{n}": F.array(*[x.cast("double") for x in xs]) for n, xs in versions.items()}), table, self.keys, "left")

        def leaf(start, x):
            def step(node, _):
                f = F.get("__feature", start + node)
                return F.when(f < 0, node).otherwise(2 * node + F.when(F.get(x, f) > F.get("__cut", start + node), 1).otherwise(0))

            return F.aggregate(F.sequence(F.lit(1), F.lit(spec.depth)), F.lit(1), step)

        def margin(k, x):
            start = lambda t: (t * spec.classes + k) * slots
            trees = F.sequence(F.lit(0), F.lit(len(self.trees) - 1))
            return F.aggregate(trees, F.get("__base", k), lambda total, t: total + F.get("__value", start(t) + leaf(start(t), x)))

        def every(x):
            whole = F.col("__base").isNotNull() & ~F.exists(x, lambda v: v.isNull())
            return F.when(whole, F.transform(F.sequence(F.lit(0), F.lit(spec.classes - 1)), lambda k: margin(k, x)))

        return rows.withColumns({n: every(f"__x_{n}") for n in versions}).drop(*[f"__x_{n}" for n in versions], "__base", "__feature", "__cut", "__value")

    def _lattice(self, model: int) -> np.ndarray:
        """Margins of a model, (classes, bins of its features): every leaf is a box of bins; trees are added in their order."""
        shape = [len(e) + 1 for e in self.edges[model]]
        out = np.empty((self.spec.classes, *shape))
        for k in range(self.spec.classes):
            out[k] = self.base[model, k]
            for tree in self.trees:
                feature, cut, value = (v[model, k].tolist() for v in (tree.feature, tree.cut, tree.value))
                boxes = [(1, tuple(slice(0, n) for n in shape))]
                while boxes:
                    node, box = boxes.pop()
                    f = feature[node]
                    if f < 0:
                        out[(k, *box)] += value[node]
                        continue
                    at = min(max(cut[node] + 1, box[f].start), box[f].stop)
                    boxes += [(2 * node, (*box[:f], slice(box[f].start, at), *box[f + 1 :])), (2 * node + 1, (*box[:f], slice(at, box[f].stop), *box[f + 1 :]))]
        return out.reshape(self.spec.classes, -1)

    def _looked_up(self, df: DataFrame, versions: dict[str, list[Column]]) -> DataFrame:
        spec = self.spec
        held = df.sparkSession.sparkContext.broadcast([([np.array(e) for e in edges], self._lattice(m)) for m, edges in enumerate(self.edges)])

        @F.arrow_udf("array<double>")
        def margins(model: pa.Array, *xs: pa.Array) -> pa.Array:
            use, m, values = _given(model, xs)
            out = np.empty((len(m), spec.classes))
            order = np.argsort(m.astype(np.int16), kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(m[order])) + 1) if len(m) else []:
                edges, lattice = held.value[m[at[0]]]
                cell = np.zeros(len(at), np.int64)
                for e, x in zip(edges, values):
                    cell = cell * (len(e) + 1) + np.searchsorted(e, x[at])
                out[at] = lattice[:, cell].T
            return _lists(use, out)

        return self._scored(df, margins, versions)

    def _scored(self, df: DataFrame, margins, versions: dict[str, list[Column]]) -> DataFrame:
        index = self._frame(df.sparkSession, {**{k: [m[i] for m in self.models] for i, k in enumerate(self.keys)}, "__m": list(range(len(self.models)))}, "__m int")
        rows = join_measured(df, index, self.keys, "left")
        return rows.withColumns({n: margins("__m", *[x.cast("double") for x in xs]) for n, xs in versions.items()}).drop("__m")

    def _walked(self, df: DataFrame, versions: dict[str, list[Column]]) -> DataFrame:
        spec, slots = self.spec, 2 << self.spec.depth
        cuts = np.zeros((len(self.models), len(self.features), spec.bins))
        for m, edges in enumerate(self.edges):
            for f, values in enumerate(edges):
                cuts[m, f, : len(values)] = values
        shape = (len(self.models), len(self.trees), spec.classes, slots)
        feature, cut, value = np.zeros(shape, np.int16), np.full(shape, np.inf), np.zeros(shape)
        at = np.arange(len(self.models))[:, None]
        for t, tree in enumerate(self.trees):
            for k in range(spec.classes):
                split = tree.feature[:, k] >= 0
                feature[:, t, k] = np.maximum(tree.feature[:, k], 0)
                cut[:, t, k] = np.where(split, cuts[at, feature[:, t, k], tree.cut[:, k]], np.inf)
                value[:, t, k] = tree.value[:, k]
                for node in range(2, slots):
                    value[:, t, k, node] = np.where(split[:, node // 2], value[:, t, k, node], value[:, t, k, node // 2])
        spark = df.sparkSession
        held = spark.sparkContext.broadcast((feature.ravel(), cut.ravel(), value.ravel(), self.base))

        @F.arrow_udf("array<double>")
        def margins(model: pa.Array, *xs: pa.Array) -> pa.Array:
            feature, cut, value, base = held.value
            use, m, values = _given(model, xs)
            flat, row = np.stack(values, axis=1).ravel(), np.arange(len(m)) * len(xs)
            out = base[m].copy()
            for t in range(shape[1]):
                for k in range(spec.classes):
                    start = ((m * shape[1] + t) * spec.classes + k) * slots
                    node = np.ones(len(m), np.int64)
                    for _ in range(spec.depth):
                        node = 2 * node + ~(flat[row + feature[start + node]] <= cut[start + node])
                    out[:, k] += value[start + node]
            return _lists(use, out)

        return self._scored(df, margins, versions)

    def skipped(self, df: DataFrame) -> DataFrame:
        """Keys of rows without a model and their number of rows."""
        rows = self.margins(df, "__margin").where(F.col("__margin").isNull() & F.forall(F.array(*self.features), lambda x: x.isNotNull()))
        return rows.groupBy(*self.keys).agg(F.count("*").alias("n_rows"))

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with `prediction`; classifiers add the chance of every class and the largest as confidence."""
        rows = self.margins(df, "__margin")
        if self.spec.objective == "squared":
            return rows.withColumn("prediction", F.get("__margin", 0)).drop("__margin")
        rows = rows.withColumn("__chances", self.chances("__margin"))
        rows = classified(rows, "__chances", max(2, self.spec.classes))
        return rows.withColumn("predicted_class", likeliest("__chances")).drop("__margin", "__chances")

    def chances(self, margin: str) -> Column:
        """The chance of every class from a column of margins."""
        if self.spec.objective == "logistic":
            p = 1 / (1 + F.exp(-F.get(margin, 0)))
            return F.when(F.col(margin).isNotNull(), F.array(1 - p, p))
        raised = F.transform(margin, lambda x: F.exp(x - F.array_max(margin)))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def likeliest(chances: str) -> Column:
    return (F.array_position(chances, F.array_max(chances)) - 1).cast("int")


def walk_forward(df: DataFrame, keys: list[str], features: list[str], label: str, row_id: Column, spec: Spec, start: str, ts: str = "utc_ts", midnight_cut: bool = False, max_weeks: int | None = None, weight: str | None = None) -> DataFrame:
    """Weekly refits: each validation row scored by its week's model, fitted on all rows before that week.

    All weeks are models of one fit, so the plan does not grow with them; rows are binned once
    and a row trains every later week without being copied. Rows whose week has no model stay, unscored.
    """
    weeks = operational_weeks(df, start, max_weeks, ts).agg(F.max("week_num")).first()[0] or 0
    folds = assign_folds(df, start, ts, midnight_cut)
    train = folds.where(F.col("first_train_week") <= weeks)
    forest = fit(train, keys, features, label, row_id, spec, weight, ("week_num", F.col("first_train_week"), weeks))
    return forest.predict(folds.where(F.col("val_week") <= weeks).withColumn("week_num", F.col("val_week")).drop("val_week", "first_train_week"))


def fit(df: DataFrame, keys: list[str], features: list[str], label: str, row_id: Column, spec: Spec, weight: str | None = None, fan: tuple[str, Column, int] | None = None) -> Forest:
    """One boosted model per key on its rows, all fitted side by side.

    Rows with a null label or feature are left out. `row_id` numbers rows; it decides which
    trees see a row, and rows of one id are seen together; rows without one go by their values. With `fan`, a name, a row's first
    number and the last of all, a row trains a model beside its keys for every number from its
    first to the last; bins are those of the keys. Its margins are walked anew in every level,
    as they differ from model to model and would take rows times models to keep. Models whose
    cells are few are fitted each in one task, with a fan in as many as there are cores for; for
    the others the driver runs one job per level and sees the splits, at most a row per node.
    """
    rows = df.dropna(subset=[*features, label])
    if weight:
        rows = rows.where(F.col(weight) > 0)
    plain = written(rows.select(
        *keys, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.coalesce(row_id.cast("long"), F.xxhash64(*features, label)).alias("id"),
        (fan[1].cast("int") if fan else F.lit(0)).alias("__first")))
    last = fan[2] if fan else 0
    facts = plain.where(F.col("__first") <= last).groupBy(*keys, "__first").agg(
        F.sum(F.col("y") * F.col("w")).alias("sum"), F.sum("w").alias("weight"), F.min("y").alias("least"), F.max("y").alias("most"), F.max("w").alias("heaviest"), F.count("*").alias("n"))
    every = [*keys, fan[0]] if fan else keys
    firsts = facts.orderBy(*keys, "__first").limit(MOST_MODELS + 1).collect()
    group_of = {k: g for g, k in enumerate(dict.fromkeys(tuple(r[k] for k in keys) for r in firsts))}
    ranges: dict[int, tuple[int, int, int]] = {}
    models, means, total = [], [], {}
    by = {(group_of[tuple(r[k] for k in keys)], r["__first"]): r for r in firsts}
    for key, g in group_of.items():
        low = min(first for group, first in by if group == g) if fan else 0
        ranges[g] = (len(models), low, last)
        up, weighed = 0.0, 0.0
        for number in range(low, last + 1):
            if (g, number) in by:
                up, weighed = up + by[g, number]["sum"], weighed + by[g, number]["weight"]
            models.append((*key, number) if fan else key)
            means.append(up / weighed)
    if len(models) > MOST_MODELS or len(firsts) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    held: dict[tuple, list] = {}
    for r in bin_edges(plain, keys, features, spec.bins).collect():
        held.setdefault(tuple(r[k] for k in keys), [[]] * len(features))[r["f"]] = list(r["edges"])
    spec = replace(spec, classes=spec.classes if spec.objective == "softmax" else 1)
    squared = spec.objective == "squared"
    base = np.array([[m if squared else 0.0] * spec.classes for m in means]).reshape(len(models), spec.classes)
    n_keys = len(keys)
    forest = Forest(spec, every, features, models, [held[m[:n_keys]] for m in models], base)
    forest.key_types = [plain.schema[k].dataType.simpleString() for k in keys] + (["int"] if fan else [])
    if not models:
        return forest
    heaviest = max(r["heaviest"] for r in firsts)
    widest = max(max(r["most"] for r in firsts if group_of[tuple(r[k] for k in keys)] == g) - min(r["least"] for r in firsts if group_of[tuple(r[k] for k in keys)] == g) for g in ranges) if squared else 0.0
    largest = heaviest * (max(1.0, 2 * widest) if squared else 1.0)
    quantum = 2.0 ** (math.ceil(math.log2(largest)) - QUANTUM_BITS)

    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    fields = ", ".join(f"{k} {t}" for k, t in zip(keys, forest.key_types))
    index = spark.createDataFrame([(*k, g) for k, g in group_of.items()], f"{fields}, __group int")
    edges = sc.broadcast([[np.array(e) for e in held[k]] for k in group_of])
    cores, rows_of = sc.defaultParallelism, {g: 0 for g in ranges}
    for r in firsts:
        rows_of[group_of[tuple(r[k] for k in keys)]] += r["n"]
    forest.trees = [Tree(len(models), spec.classes, spec.depth) for _ in range(spec.trees)]
    binned = join_measured(plain.where(F.col("__first") <= last), index, keys).select("__group", "__first", "y", "w", "id", *features)
    centres = base[[ranges[g][0] for g in range(len(group_of))]][:, 0]
    large = _fit_whole(forest, binned, edges, ranges, rows_of, centres, quantum, cores)
    if large:
        _fit_levels(forest, binned.where(F.col("__group").isin(large)), edges, ranges if fan else None, sum(rows_of[g] for g in large), base[[ranges[g][0] for g in range(len(group_of))]], quantum, cores)
    return forest


def _fit_whole(forest: Forest, binned: DataFrame, edges, ranges: dict[int, tuple[int, int, int]], rows_of: dict[int, int], centres: np.ndarray, quantum: float, cores: int) -> list[int]:
    """Fit the groups of which one task holds the cells; the numbers of the others."""
    spec, spark = forest.spec, binned.sparkSession
    sc = spark.sparkContext
    parts = {g: max(-(-n // COUNTED), min(-(-cores // len(ranges)), -(-n // LEAST_ROWS))) for g, n in rows_of.items()}
    starts, total = {}, 0
    for g, n in parts.items():
        starts[g], total = total, total + n
    blocks = binned.mapInArrow(dealt(edges, starts, parts), "part int, block binary").repartitionById(total, "part")
    pieces = written(blocks.mapInArrow(counted(spec, quantum, centres), "group int, size long, piece binary"))
    size = {r["group"]: r["size"] for r in pieces.groupBy("group").agg(F.sum("size").alias("size")).collect()}
    small = [g for g, n in rows_of.items() if size[g] <= WHOLE and n <= WHOLE_ROWS]
    if small:
        widest = max(high - low + 1 for _, low, high in ranges.values())
        copies = max(1, min(widest, 2 * cores // len(small)))
        tasks = min(len(small) * copies, cores * 8)
        shared = sc.broadcast((ranges, forest.base, [[len(e) + 1 for e in forest.edges[ranges[g][0]]] for g in range(len(ranges))], len(forest.models)))
        place = F.create_map(*[F.lit(x) for i, g in enumerate(small) for x in (g, i)])[F.col("group")] if len(small) < len(ranges) else F.col("group")
        turns = pieces.where(F.col("group").isin(small)) if len(small) < len(ranges) else pieces
        turns = turns.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("task", ((place * copies + F.col("turn")) % tasks).cast("int"))
        turns = turns.repartitionById(tasks, "task").sortWithinPartitions("group", "turn").select("group", "turn", "piece")
        for r in turns.mapInArrow(whole(spec, quantum, shared, copies), "model int, trees binary").collect():
            for name, values in zip(TREE, pickle.loads(r["trees"])):
                for tree, v in zip(forest.trees, values):
                    getattr(tree, name)[r["model"]] = v
        shared.destroy()
    return [g for g in rows_of if g not in set(small)]


def _fit_levels(forest: Forest, binned: DataFrame, edges, fan: dict[int, tuple[int, int, int]] | None, n: int, first_base: np.ndarray, quantum: float, cores: int) -> None:
    """Fit models whose rows stand in many tasks, a job for every level of a tree."""
    spec, spark, models, features, base = forest.spec, binned.sparkSession, forest.models, forest.features, forest.base
    sc = spark.sparkContext
    parts = max(-(-n // PART_ROWS), min(cores, -(-n // LEAST_ROWS)))
    # A task holds the rows of few models, so that it sends few sums.
    binned = binned.repartitionByRange(parts, "__group", F.xxhash64("id"))
    state = binned.mapInArrow(packed(len(features), edges, first_base, spec.bins, fan is not None), "block binary").rdd
    state = state.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def splits(cell: tuple[int, np.ndarray]) -> list[tuple]:
        return best_splits(spec, quantum, *cell, shared.value[3][cell[0] // spec.classes])

    pending: list[Tree] = []
    stale = []
    for number, tree in enumerate(forest.trees):
        shared = sc.broadcast((fan, base, pending, allowed(len(models), len(features), spec, number)))
        for level in range(spec.depth):
            now = sc.broadcast(tree)
            sums = state.mapPartitions(histograms(spec, shared, now, level, number, quantum)).reduceByKey(np.add, min(parts, cores * 4))
            found = sums.flatMap(splits).collect()
            now.destroy()
            for old in stale:
                old.unpersist()
            stale = []
            if not grow(tree, found, level, spec, quantum):
                break
        shared.destroy()
        pending.append(tree)
        if len(pending) == PENDING and number + 1 < spec.trees and not fan:
            # The next job keeps the new blocks; the old ones go after it.
            carry = sc.broadcast(pending)
            stale, state, pending = [state], state.map(carried(carry, base)).persist(StorageLevel.MEMORY_AND_DISK), []
            if (number + 1) // PENDING % LINEAGE == 0:
                checkpoint_dir(spark)
                state.checkpoint()
    state.unpersist()


def grow(tree: Tree, found: list, level: int, spec: Spec, quantum: float) -> bool:
    """Enter the splits of a level; their halves are leaves until they are split in turn."""
    nodes, more = 1 << level, False

    def leaf(g: int, h: int) -> float:
        total = g * quantum
        return -spec.rate * math.copysign(max(abs(total) - spec.l1, 0.0), total) / (h * quantum + spec.l2)

    for key, at, g, h, n, gain, best, gl, hl, nl in found:
        (model, k), node = divmod(key, spec.classes), at + nodes
        tree.value[model, k, node], tree.cover[model, k, node], tree.count[model, k, node] = leaf(g, h), h * quantum, n
        if gain is None:
            continue
        more = True
        feature, cut = divmod(best, spec.bins)
        tree.feature[model, k, node], tree.cut[model, k, node], tree.gain[model, k, node] = feature, cut, gain
        for child, cg, ch, cn in ((2 * node, gl, hl, nl), (2 * node + 1, g - gl, h - hl, n - nl)):
            tree.value[model, k, child], tree.cover[model, k, child], tree.count[model, k, child] = leaf(cg, ch), ch * quantum, cn
    return more


def carried(pending, base: np.ndarray):
    """The block with the pending trees added to its margins."""

    def run(block: Block) -> Block:
        return replace(block, margin=block.margins(block.group, len(block.y), base, pending.value))

    return run


def importances(table: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, importance): share of the split gains, 0 for features without a split; from a forest's table."""
    gains = table.where("feature is not null").groupBy(*keys, "feature").agg(F.sum("gain").alias("gain"))
    spine = table.select(*keys).distinct().withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    total = F.sum("gain").over(Window.partitionBy(*keys))
    return spine.join(gains, [*keys, "feature"], "left").na.fill(0.0, ["gain"]).select(*keys, "feature", F.when(total > 0, F.col("gain") / total).otherwise(0.0).alias("importance"))


def complexity(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_trees, nodes, leaves, depth, complexity): complexity is the mean number of nodes of a tree."""
    level = F.floor(F.log2(F.col("node").cast("double")) + 1e-9).cast("int")
    trees = F.countDistinct("tree", "class")
    return table.groupBy(*keys).agg(trees.alias("n_trees"), F.count("*").alias("nodes"), F.count_if(F.col("feature").isNull()).alias("leaves"), F.max(level).alias("depth"), (F.count("*") / trees).alias("complexity"))
