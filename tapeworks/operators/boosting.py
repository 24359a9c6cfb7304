"""Leaf-wise histogram gradient boosting for two classes, grown over Spark tables.

Features are cut into bins once; rows travel as blocks of bins, labels and scores. For each step of a tree, every task adds up
gradients, Hessians and rows of its blocks by (model, node, feature, bin), one grouped aggregate adds up the tasks, and the best
split of each node is found from those sums, whose number depends on nodes, features and bins alone. A tree grows at its leaf
of most gain. Models of several groups (folds) grow side by side in the same jobs. Scores are written with the blocks every few
rounds, so that a task applies only the latest trees, and a lost executor costs no more."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .evaluation import _before

MISSING = 255
BLOCK = 4096
#: Rows for which another task is worth its start.
TASK = 1 << 16


@dataclass
class Tree:
    """Nodes in order of creation, the root first; feature -1: a leaf. Rows of a bin up to ``cut`` go left, missing ones where told."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (features x rows)."""
        feature, cut, missing = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        left, right, rows = np.array(self.left), np.array(self.right), np.arange(bins.shape[1])
        at = np.zeros(bins.shape[1], np.int64)
        while (inner := feature[at] >= 0).any():
            here, row = at[inner], rows[inner]
            bin_ = bins[feature[here], row]
            goes = np.where(bin_ == MISSING, missing[here], bin_ <= cut[here])
            at[inner] = np.where(goes, left[here], right[here])
        return at


@dataclass
class Ensemble:
    columns: list[str]
    thresholds: list[list[float]]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins (features x rows) of values (features x rows): how many thresholds lie below; NaN is missing."""
        out = np.empty(values.shape, np.uint8)
        for f, t in enumerate(self.thresholds):
            out[f] = np.where(np.isnan(values[f]), MISSING, np.searchsorted(t, values[f], side="left"))
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(bins.shape[1], self.start)
        for tree in self.trees:
            total += np.array(tree.value)[tree.leaves(bins)]
        return total

    def expression(self) -> Column:
        """The probability as a Spark expression over the columns: a CASE for each tree."""

        def of(tree: Tree, node: int) -> Column:
            f = tree.feature[node]
            if f < 0:
                return F.lit(float(tree.value[node]))
            x = F.col(self.columns[f]).cast("double")
            none = x.isNull() | F.isnan(x)
            cuts = self.thresholds[f]
            below = x <= cuts[tree.cut[node]] if tree.cut[node] < len(cuts) else F.lit(True)  # beyond the last: all that is not missing
            goes = (none | below) if tree.missing_left[node] else (~none & below)
            return F.when(goes, of(tree, tree.left[node])).otherwise(of(tree, tree.right[node]))

        values = F.array(*[of(tree, 0) for tree in self.trees]) if self.trees else F.array().cast("array<double>")
        return 1 / (1 + F.exp(-F.aggregate(values, F.lit(self.start), lambda total, x: total + x)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Ensemble:
        found = json.loads(text)
        return Ensemble(found["columns"], found["thresholds"], found["start"], [Tree(**t) for t in found["trees"]])


def bin_thresholds(rows: DataFrame, columns: list[str], by: str, most: int = 255, sample: int = 200_000) -> dict:
    """{group: thresholds of each column}: midpoints of neighbouring distinct values where a column has at most ``most``, else
    quantiles at k / ``most``, midway between the values that they lie between. A group of more than ``sample`` rows is
    represented by about so many, chosen by a hash of the whole row. Nulls and NaN are left out. One number a threshold comes to
    the driver."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_rows"))
    place = F.pmod(F.xxhash64(F.struct(*columns)), F.lit(1 << 30))
    chosen = rows.select(by, *columns).join(F.broadcast(sizes), by).where(place < F.lit(float(sample << 30)) / F.col("_rows"))  # a row a group
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    long = chosen.select(by, F.explode(pairs).alias("_x")).select(by, "_x.feature", (F.col("_x.x") + F.lit(0.0)).alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    counted = long.groupBy(by, "feature", "x").agg(F.count("*").alias("_count"))
    slot = F.when(F.col("x") == 0, 0).otherwise(F.signum("x") * (F.floor(F.log2(F.abs("x")) * 8) + 10_000)).cast("int")
    placed = written(_before(counted, [by, "feature"], F.col("x"), "_count", slot), "boosting-values")
    distinct = placed.groupBy(by, "feature").agg(F.count("*").alias("_distinct"))
    placed = placed.join(distinct, [by, "feature"])
    few = placed.where(F.col("_distinct") <= most)
    out: dict = {}
    for r in few.select(by, "feature", "x").collect():  # at most ``most`` values a column and group
        out.setdefault(r[by], [[] for _ in columns])[r.feature].append(r.x)
    out = {g: [[(a + b) / 2 for a, b in zip(sorted(x), sorted(x)[1:], strict=False)] for x in found] for g, found in out.items()}
    n = F.col("total") - 1
    end = F.col("before") + F.col("_count")
    k = F.explode(F.sequence(F.lit(1), F.lit(most - 1)))
    many = placed.where(F.col("_distinct") > most).select(by, "feature", "x", "before", end.alias("end"), n.alias("n"), k.alias("k"))
    low, high = F.expr(f"k * n div {most}"), F.expr(f"(k * n + {most - 1}) div {most}")
    holds = lambda at: (F.col("before") <= at) & (at < F.col("end"))
    cuts = many.where(holds(low) | holds(high)).groupBy(by, "feature", "k").agg(
        ((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))) / 2).alias("cut")
    )
    for r in cuts.collect():
        out.setdefault(r[by], [[] for _ in columns])[r.feature].append(r.cut)
    return {g: [sorted(set(x)) for x in found] for g, found in out.items()}


def _blocks(rows: DataFrame, models: dict, columns: list[str], by: str, label: str, tasks: int) -> DataFrame:
    """(model, y, bins, score): up to BLOCK rows of a model in one, score being where boosting starts."""
    keys = {g: i for i, g in enumerate(models)}
    number = F.create_map(*[F.lit(x) for g, i in keys.items() for x in (g, i)])[F.col(by)]
    source = rows.select(number.alias("model"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    ensembles = list(models.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int8)
            values = np.array([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]).reshape(len(columns), -1)
            for m in np.unique(model).tolist():
                own = np.flatnonzero(model == m)
                for a in range(0, len(own), BLOCK):
                    at = own[a : a + BLOCK]
                    bins, score = ensembles[m].bins(values[:, at]), np.full(len(at), ensembles[m].start)
                    yield pa.record_batch([pa.array([m], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (y[at], bins, score)]], ["model", "y", "bins", "score"])

    return written(source.coalesce(tasks).mapInArrow(run, "model int, y binary, bins binary, score binary"), "boosting-blocks")


def _opened(batches: Iterator[pa.RecordBatch], width: int, trees: list[list[Tree]]):
    """(model, y, bins, score with the trees added) of each block."""
    for batch in batches:
        for m, y, bins, score in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            y, bins = np.frombuffer(y, np.int8), np.frombuffer(bins, np.uint8).reshape(width, -1)
            score = np.frombuffer(score).copy()
            for tree in trees[m]:
                score += np.array(tree.value)[tree.leaves(bins)]
            yield m, y, bins, score


def _histograms(y: np.ndarray, bins: np.ndarray, score: np.ndarray, tree: Tree, wanted: list[int]) -> np.ndarray:
    """Sums ([gradient, Hessian, rows], feature, 256 bins of each wanted node) over the rows of a block."""
    p = 1 / (1 + np.exp(-score))
    weights = (p - y, p * (1 - p), None)
    slots = np.full(len(tree.feature), -1)
    slots[wanted] = np.arange(len(wanted))
    slot = slots[tree.leaves(bins)]
    at = np.flatnonzero(slot >= 0)
    sums = np.zeros((3, len(bins), len(wanted) * 256))
    for f in range(len(bins)):
        cell = slot[at] * 256 + bins[f, at]
        for k, w in enumerate(weights):
            sums[k, f] = np.bincount(cell, None if w is None else w[at], sums.shape[2])
    return sums


def _sums(blocks: DataFrame, width: int, trees: list[list[Tree]], growing: dict[int, Tree], wanted: dict[int, list[int]]) -> dict:
    """{(model, node): sums (feature, bin, [gradient, Hessian, rows])} over the rows of each wanted node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for m, y, bins, score in _opened(batches, width, trees):
            if m in wanted:
                total[m] = total.get(m, 0) + _histograms(y, bins, score, growing[m], wanted[m])
        for m, sums in total.items():
            f, cell = np.nonzero(sums[2])
            node = np.array(wanted[m])[cell // 256]
            columns = [np.full(len(f), m, np.int32), node.astype(np.int32), f.astype(np.int32), (cell % 256).astype(np.int32), *[s[f, cell] for s in sums]]
            yield pa.record_batch([pa.array(c) for c in columns], ["model", "node", "feature", "bin", "g", "h", "n"])

    found = blocks.mapInArrow(run, "model int, node int, feature int, bin int, g double, h double, n double")
    found = found.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
    model, node, feature, bin_, *sums = (found.column(i).to_numpy() for i in range(7))
    out = {(m, k): np.zeros((width, 256, 3)) for m, nodes in wanted.items() for k in nodes}
    for key in out:
        own = np.flatnonzero((model == key[0]) & (node == key[1]))
        np.add.at(out[key], (feature[own], bin_[own]), np.column_stack([s[own] for s in sums]))
    return out


@dataclass
class _Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: np.ndarray
    right: np.ndarray


def best_split(sums: np.ndarray, leaf: int, l2: float, least: float = 1e-3) -> _Split | None:
    """The split of most gain (of equal gains the first feature, then the lowest cut, missing rows right) with ``leaf`` rows and
    a Hessian of ``least`` on both sides; None if none gains. sums: (feature, bin, [gradient, Hessian, rows])."""
    whole, best = sums[0].sum(axis=0), None
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    below = np.cumsum(sums[:, :MISSING], axis=1)
    options = [below] if not sums[:, MISSING, 2].any() else [below, below + sums[:, MISSING : MISSING + 1]]
    gains = []
    for left in options:
        right = whole - left
        gain = value(left) + value(right) - value(whole)
        fine = (left[..., 2] >= leaf) & (right[..., 2] >= leaf) & (left[..., 1] >= least) & (right[..., 1] >= least)
        gains.append(np.where(fine, gain, -np.inf))
    gains = np.stack(gains, axis=-1)
    f, cut, side = np.unravel_index(int(np.argmax(gains)), gains.shape)
    if gains[f, cut, side] > 0:
        left = options[side][f, cut]
        best = _Split(float(gains[f, cut, side]), int(f), int(cut), bool(side), left, whole - left)
    return best


class _Growth:
    """One tree as it grows: splits known so far, also of nodes that may turn out not to be split."""

    def __init__(self, leaves: int, leaf: int, rate: float, l2: float):
        self.most, self.leaf, self.rate, self.l2 = leaves, leaf, rate, l2
        self.tree, self.splits, self.sums = Tree(), {}, {}

    def wanted(self) -> list[int]:
        """Nodes whose split has to be known before the tree is, and their siblings' children, which soon may be."""
        if not self.splits:
            return [0]
        leaves, _ = self._chosen()
        if leaves is None:
            return []
        near = [c for x in leaves if self.splits.get(x) for c in (self.tree.left[x], self.tree.right[x])]
        return [x for x in [*leaves, *near] if x not in self.splits]

    def learn(self, node: int, sums: np.ndarray) -> None:
        if node == 0:
            self.sums[0] = sums[0].sum(axis=0)
        split = self.splits[node] = best_split(sums, self.leaf, self.l2)
        if split:
            t = self.tree
            t.feature[node], t.cut[node], t.missing_left[node] = split.feature, split.cut, split.missing_left
            t.left[node], t.right[node] = t.add(), t.add()
            for child, own in ((t.left[node], split.left), (t.right[node], split.right)):
                self.sums[child] = own
                if own[2] < 2 * self.leaf:
                    self.splits[child] = None

    def _chosen(self) -> tuple[list[int] | None, list[int]]:
        """(leaves to look into, nodes split) on the way of most gain; no leaves once the tree is known."""
        leaves, inner = [0], []
        while len(leaves) < self.most:
            if any(x not in self.splits for x in leaves):
                return leaves, inner
            gain, node = max(((self.splits[x].gain, -x) for x in leaves if self.splits[x]), default=(0, 0))
            if gain <= 0:
                break
            leaves.remove(-node)
            leaves += [self.tree.left[-node], self.tree.right[-node]]
            inner.append(-node)
        return None, inner

    def grown(self) -> Tree:
        """The tree with its chosen splits only, and the leaves' values."""
        inner, out, queue = set(self._chosen()[1]), Tree(), [(0, 0)]
        while queue:
            node, new = queue.pop(0)
            g, h, _ = self.sums[node]
            out.value[new] = float(-self.rate * g / (h + self.l2))
            if node in inner:
                t = self.tree
                out.feature[new], out.cut[new], out.missing_left[new] = t.feature[node], t.cut[node], t.missing_left[node]
                out.left[new], out.right[new] = out.add(), out.add()
                queue += [(t.left[node], out.left[new]), (t.right[node], out.right[new])]
        return out


def fit(
    train: DataFrame, columns: list[str], by: str, label: str = "target_up_15m", rounds: int = 200, rate: float = 0.05, leaves: int = 7,
    leaf: int = 500, l2: float = 1.0, bins: int = 255, sample: int = 200_000, keep: int = 20,
) -> dict:
    """{group: Ensemble} fitted to each group of ``by`` (none null) by log loss: ``rounds`` trees of at most ``leaves`` leaves of
    ``leaf`` rows each, their values shrunk by ``rate`` and penalised by ``l2``. keep: rounds between two writings of the scores.

    Nulls and NaN in a column are a bin of their own, which goes to the better side. A group with one label only gets a start
    of the smoothed rate and trees that change nothing of note; no rows give no models."""
    cuts = bin_thresholds(train, columns, by, bins, sample)
    rates = {r[by]: (r.up, r.n) for r in train.groupBy(by).agg(F.sum(F.col(label).cast("long")).alias("up"), F.count("*").alias("n")).collect()}  # a row a group
    models = {}
    for g, (up, n) in sorted(rates.items()):
        p = up / n if 0 < up < n else (up + 1) / (n + 2)
        models[g] = Ensemble(list(columns), cuts.get(g, [[] for _ in columns]), float(np.log(p / (1 - p))))
    if not models:
        return {}
    tasks = -(-sum(n for _, n in rates.values()) // TASK)
    blocks = _blocks(train, models, columns, by, label, tasks)
    if tasks == 1:
        grown = _grown_alone(blocks, len(columns), rounds, (leaves, leaf, rate, l2))
        for i, model in enumerate(models.values()):
            model.trees = grown[i]
        return models
    recent: list[list[Tree]] = [[] for _ in models]
    for turn in range(rounds):
        growing = [_Growth(leaves, leaf, rate, l2) for _ in models]
        while wanted := {m: w for m, x in enumerate(growing) if (w := x.wanted())}:
            sums = _sums(blocks, len(columns), recent, {m: growing[m].tree for m in wanted}, wanted)
            for (m, node), own in sums.items():
                growing[m].learn(node, own)
        for own, x, model in zip(recent, growing, models.values(), strict=True):
            own.append(x.grown())
            model.trees.append(own[-1])
        if (turn + 1) % keep == 0 and turn + 1 < rounds:
            blocks = _kept(blocks, len(columns), recent)
            recent = [[] for _ in models]
    return models


def _grown_alone(blocks: DataFrame, width: int, rounds: int, settings: tuple) -> dict[int, list[Tree]]:
    """{model: its trees} where all rows are at most TASK: each model is grown in a task of its own, in one job instead of several
    for each tree, by the same sums and splits."""

    def run(group: pa.Table) -> pa.Table:
        rows = list(_opened(group.to_batches(), width, [[]] * (group.column("model")[0].as_py() + 1)))
        rows.sort(key=lambda r: (r[1].tobytes(), r[2].tobytes()))  # blocks come in no order of their own
        y, bins, score = (np.concatenate([r[i] for r in rows], axis=-1) for i in (1, 2, 3))
        trees = []
        for _ in range(rounds):
            growth = _Growth(*settings)
            while wanted := growth.wanted():
                sums = _histograms(y, bins, score, growth.tree, wanted).reshape(3, width, len(wanted), 256)
                for i, node in enumerate(wanted):
                    growth.learn(node, np.moveaxis(sums[:, :, i], 0, -1))
            trees.append(growth.grown())
            score = score + np.array(trees[-1].value)[trees[-1].leaves(bins)]
        return pa.table({"model": pa.array([rows[0][0]], pa.int32()), "trees": [json.dumps([asdict(t) for t in trees])]})

    found = blocks.groupBy("model").applyInArrow(run, "model int, trees string").collect()  # a row a model
    return {r.model: [Tree(**t) for t in json.loads(r.trees)] for r in found}


def _kept(blocks: DataFrame, width: int, trees: list[list[Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, y, bins, score in _opened(batches, width, trees):
            yield pa.record_batch([pa.array([m], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (y, bins, score)]], ["model", "y", "bins", "score"])

    return written(blocks.mapInArrow(run, blocks.schema), "boosting-blocks")


def probabilities(models: dict, rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with the probability of up as ``name`` from their group's model; null where the group has none."""
    keys, ensembles = {g: i for i, g in enumerate(models)}, list(models.values())
    if not models:
        return rows.withColumn(name, F.lit(None).cast("double"))
    number = F.create_map(*[F.lit(x) for g, i in keys.items() for x in (g, i)])[F.col(by)]

    @F.pandas_udf("double")
    def score(model: pd.Series, *xs: pd.Series) -> pd.Series:
        out, m = np.full(len(model), np.nan), model.to_numpy(dtype=float, na_value=-1)
        values = np.array([x.to_numpy(dtype=float, na_value=np.nan) for x in xs])
        for i in np.unique(m[m >= 0]).astype(int).tolist():
            own = np.flatnonzero(m == i)
            out[own] = 1 / (1 + np.exp(-ensembles[i].scores(ensembles[i].bins(values[:, own]))))
        return pd.Series(out)

    p = score(number, *[F.col(c).cast("double") for c in ensembles[0].columns])
    return rows.withColumn(name, F.when(number.isNotNull(), p))
