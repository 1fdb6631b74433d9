"""Boosted trees over histograms of binned inputs, stopped by the validation part's PR-AUC, with exact reasons."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.operators import evaluate, ranking
from paysift.operators.model import NUMBERS, OTHER, VOCABULARIES, model_matrix
from paysift.storage import write_table

#: Gradients are added as multiples of this, as whole numbers, so that sums don't depend on their order.
UNIT = 2.0**-20
#: Rounds after which the margins of the stored rows are written anew, so that a pass has at most so many trees to follow.
CARRY = 8
_SUMS = pa.schema([("cell", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])


@dataclass(frozen=True)
class Settings:
    """rounds at most, levels of a tree, bins of an input, shrinkage of a tree, L2 weight, least weight of a leaf (sum of
    second derivatives), and how many rounds may pass without a better validation figure."""

    rounds: int = 100
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    smoothing: float = 1.0
    least: float = 1.0
    patience: int = 10


@dataclass(frozen=True)
class Tree:
    """A full binary tree in arrays: the children of node i are 2i + 1 and 2i + 2. A leaf has feature -1. A row goes left if its
    bin is at most `bin`. n counts the training rows of a node."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int64))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row of bins, as deep as the tree goes."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1))):
            feature = self.feature[at]
            inner = feature >= 0
            right = bins[rows, np.maximum(feature, 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def of(self, features: Sequence[int]) -> Tree:
        """The tree of inputs that are some of a model's, with the model's numbers for them."""
        return Tree(np.where(self.feature >= 0, np.array([*features, -1])[self.feature], -1), self.bin, self.value, self.n)

    def paths(self) -> Iterator[tuple[float, dict[int, tuple[int, int, float]]]]:
        """Every leaf's value, and for each feature on its way the bins it admits (low < bin <= high) and the share of training
        rows that its splits send this way."""
        waiting: list[tuple[int, dict[int, tuple[int, int, float]]]] = [(0, {})]
        while waiting:
            node, way = waiting.pop()
            f = int(self.feature[node])
            if f < 0:
                yield float(self.value[node]), way
                continue
            low, high, share = way.get(f, (-1, 1 << 30, 1.0))
            for child, bounds in ((2 * node + 1, (low, min(high, int(self.bin[node])))), (2 * node + 2, (max(low, int(self.bin[node])), high))):
                waiting.append((child, way | {f: (*bounds, share * (self.n[child] / self.n[node]))}))


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows of numbers: 0 for none, else one more than the edges below the number."""
    out = np.zeros(values.shape, np.uint8)
    for f, cuts in enumerate(edges):
        column = values[:, f]
        out[:, f] = np.where(np.isnan(column), 0, 1 + np.searchsorted(cuts, column, side="left"))
    return out


def best_splits(g: np.ndarray, h: np.ndarray, settings: Settings) -> list[tuple[int, int] | None]:
    """The (feature, bin) of the greatest gain for each node of sums by (node, feature, bin); None where there is no gain."""
    gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    total_g, total_h = gl[:, :, -1:], hl[:, :, -1:]
    score = lambda a, b: a * a / (b + settings.smoothing)
    gain = score(gl, hl) + score(total_g - gl, total_h - hl) - score(total_g, total_h)
    gain = np.where((hl >= settings.least) & (total_h - hl >= settings.least), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return [divmod(int(b), g.shape[2]) if flat[i, b] > 1e-9 else None for i, b in enumerate(best)]


class BoostedModel:
    """Trees whose values add up, with a base, to the logit of the score."""

    def __init__(self, names: Sequence[str], edges: Sequence[np.ndarray], base: float, trees: Sequence[Tree] = (), version: str = "current") -> None:
        self.names, self.edges, self.base, self.trees, self.version = list(names), list(edges), base, list(trees), version

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The margins of rows of bins; `start` has what other trees and the base give."""
        out = np.full(len(bins), self.base) if start is None else start.copy()
        for tree in self.trees:
            out += tree.value[tree.nodes(bins)]
        return out

    def expected(self) -> float:
        """The margin of a row of which nothing is known."""
        return self.base + sum(value * math.prod(share for *_, share in way.values()) for tree in self.trees for value, way in tree.paths())

    def attributions(self, bins: np.ndarray) -> np.ndarray:
        """Each input's Shapley value of each row's margin; with expected() they add up to it.

        A leaf counts as the product of one factor for every feature on its way: whether the row's bin is admitted, if the
        feature is known, else the share of rows that go this way. Of such a product the values by number of known features are
        the coefficients of a polynomial, so a leaf takes the square of its depth and not all subsets.
        """
        out = np.zeros(bins.shape)
        for tree in self.trees:
            for value, way in tree.paths():
                m = len(way)
                weights = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
                admitted = {f: ((bins[:, f] > low) & (bins[:, f] <= high)).astype(float) for f, (low, high, _) in way.items()}
                for f, (*_, share) in way.items():
                    parts = [np.ones(len(bins))]
                    for other, (*_, z) in way.items():
                        if other != f:
                            known = [np.zeros(len(bins)), *[p * admitted[other] for p in parts]]
                            parts = [a + b for a, b in zip(known, [*[p * z for p in parts], np.zeros(len(bins))])]
                    out[:, f] += value * (admitted[f] - share) * sum(w * p for w, p in zip(weights, parts))
        return out

    def score(self, matrix: DataFrame) -> DataFrame:
        """matrix with model_score, batch or stream."""
        given = matrix.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            model = given.value
            return pd.Series(1 / (1 + np.exp(-model.margins(binned(np.stack(x.to_numpy()), model.edges))))) if len(x) else pd.Series([], dtype=float)

        return matrix.withColumn("model_score", probability(_inputs(self.names)))

    def contributions(self, scored: DataFrame) -> DataFrame:
        """scored with a map of each input's part of the logit."""
        given = scored.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def parts(x: pd.Series) -> pd.Series:
            model = given.value
            return pd.Series(list(model.attributions(binned(np.stack(x.to_numpy()), model.edges)))) if len(x) else pd.Series([], dtype=object)

        return scored.withColumn("contributions", F.map_from_arrays(F.array(*[F.lit(n) for n in self.names]), parts(_inputs(self.names))))


def input_names() -> list[str]:
    """Numbers, and a 0/1 flag for every category but `missing`."""
    return [*NUMBERS, *[f"{c}={v}" for c, words in VOCABULARIES.items() for v in [*words, OTHER]]]


def _inputs(names: Sequence[str]) -> Column:
    """The inputs of a matrix as one array; null is NaN."""
    flag = lambda c, v: (F.col(c) == v).cast("double")
    columns = [flag(*n.split("=", 1)) if "=" in n else F.col(n).cast("double") for n in names]
    return F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in columns])


def input_edges(matrix: DataFrame, names: Sequence[str], bins: int) -> tuple[list[np.ndarray], list[int]]:
    """At most bins - 2 edges of each input, and the inputs that vary, which alone can split rows.

    The edges are quantiles of mergeable sketches, all in one pass; of an input with one value or none no sketch is made.
    """
    shares = [i / (bins - 2) for i in range(1, bins - 2)]
    rows = matrix.select(_inputs(names).alias("x"))
    x = [F.nullif(F.col("x")[i], F.lit(float("nan"))) for i in range(len(names))]
    seen = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(x) for f in (F.count, F.min, F.max)]).first()
    several = [i for i in range(len(names)) if seen[f"count{i}"] and seen[f"min{i}"] != seen[f"max{i}"]]
    found = rows.agg(*[F.percentile_approx(x[i], shares, 10_000).alias(f"e{i}") for i in several]).first() if several else None
    edges = [np.unique(np.array(found[f"e{i}"], float)) if i in several else np.array([seen[f"min{i}"]] if seen[f"count{i}"] else [], float) for i in range(len(names))]
    return edges, [i for i in range(len(names)) if i in several or 0 < seen[f"count{i}"] < seen["n"]]


_STORED = "y double, w double, m double, bins binary"


def _stored(matrix: DataFrame, names: Sequence[str], edges: Sequence[np.ndarray], label: str, weight: float, base: float, name: str) -> DataFrame:
    """(y, w, m, bins): labels, weights, margins and a byte an input, written once."""
    cuts = list(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in binned(values, cuts)], pa.binary())], names=["y", "w", "m", "bins"])

    y = F.col(label).cast("double")
    rows = matrix.where(y.isNotNull()).select(y.alias("y"), F.when(y == 1, F.lit(float(weight))).otherwise(1.0).alias("w"), F.lit(float(base)).alias("m"), _inputs(names).alias("x"))
    return write_table(rows.mapInArrow(run, _STORED), name)


def _bins(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, features)


def _margins(batch: pa.RecordBatch, bins: np.ndarray, model: BoostedModel) -> np.ndarray:
    return model.margins(bins, batch.column(2).to_numpy())


def _carried(rows: DataFrame, model: BoostedModel, name: str) -> DataFrame:
    """Stored rows with the model's trees in their margins, written anew."""
    shared, features = rows.sparkSession.sparkContext.broadcast(model), len(model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = _margins(batch, _bins(batch, features), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(margins), batch.column(3)], names=["y", "w", "m", "bins"])

    return write_table(rows.mapInArrow(run, _STORED), name)


def _histogram(rows: DataFrame, model: Broadcast, tree: Tree, first: int, settings: Settings) -> tuple[np.ndarray, ...]:
    """Sums of first and second derivatives and of rows by (node of a level, feature, bin).

    Each task adds up its rows; Spark adds up the tasks. What comes here has a row a cell, whatever the number of rows.
    """
    features = len(model.value.names)
    shape = (first + 1, features, settings.bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h, n = (np.zeros(shape, np.int64) for _ in range(3))
        for batch in batches:
            bins, y, w = _bins(batch, features), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p = 1 / (1 + np.exp(-_margins(batch, bins, model.value)))
            node = tree.nodes(bins) - first
            inside = np.flatnonzero((node >= 0) & (node <= first))
            parts = (g, np.rint(w * (p - y) / UNIT)), (h, np.rint(w * p * (1 - p) / UNIT)), (n, np.ones(len(y)))
            step = max(1, int(2**52 * UNIT / w.max())) if len(w) else 1  # sums of so many rows are whole numbers in doubles
            for at in range(0, len(inside), step):
                some = inside[at : at + step]
                cells = node[some] * settings.bins
                for f in range(features):
                    where = cells + bins[some, f]
                    for sums, part in parts:
                        sums[:, f] += np.bincount(where, part[some], (first + 1) * settings.bins).reshape(first + 1, -1).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, g.ravel()[at], h.ravel()[at], n.ravel()[at])], schema=_SUMS)

    sums = rows.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
    out = [np.zeros(math.prod(shape), np.int64) for _ in range(3)]
    for x, c in zip(out, ("g", "h", "n")):
        x[sums.column("cell").to_numpy()] = sums.column(c).to_numpy()
    g, h, n = (x.reshape(shape) for x in out)
    return g * UNIT, h * UNIT, n


def grow(rows: DataFrame, model: BoostedModel, settings: Settings) -> Tree:
    """The next tree, a pass over the rows a level: what the sums say of a split also says what its two sides are worth."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    tree = Tree.empty(settings.depth)

    def settle(node: int, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        tree.n[node] = n.sum()
        tree.value[node] = -settings.rate * g.sum() / (h.sum() + settings.smoothing)

    for level in range(settings.depth):
        first = 2**level - 1
        g, h, n = _histogram(rows, shared, tree, first, settings)
        if level == 0:
            settle(0, g[0, 0], h[0, 0], n[0, 0])
        splits = best_splits(g, h, settings)
        for i, split in enumerate(splits):
            if split is None:
                continue
            f, b = tree.feature[first + i], tree.bin[first + i] = split
            for child, side in ((2 * (first + i) + 1, slice(0, b + 1)), (2 * (first + i) + 2, slice(b + 1, None))):
                settle(child, g[i, f, side], h[i, f, side], n[i, f, side])
        if not any(splits):
            break
    shared.unpersist()
    return tree


def validation_figure(rows: DataFrame, model: BoostedModel) -> float:
    """PR-AUC of the stored validation rows."""
    shared, features = rows.sparkSession.sparkContext.broadcast(model), len(model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_margins(batch, _bins(batch, features), shared.value)), batch.column(0).cast(pa.int32())], names=["score", "is_fraud"])

    return float(ranking.ranking_metrics(rows.mapInArrow(run, "score double, is_fraud int")).first()["pr_auc"])


def fit(training: DataFrame, validation: DataFrame, settings: Settings | None = None, label: str = "is_fraud", names: Sequence[str] | None = None, version: str = "current") -> tuple[BoostedModel, list[float]]:
    """(model, PR-AUC of the validation part after each round), fitted on a matrix with a label column.

    Positives weigh as much as negatives together. Rounds end when `patience` of them have not bettered the figure; the model keeps
    the trees up to its best one. Rows without a label take no part. Reruns agree to the last bit.
    """
    settings, names = settings or Settings(), list(names or input_names())
    if not 3 < settings.bins <= 256:
        raise ValueError("bins must be between 4 and 256")
    weight = evaluate.class_weight(training, label).first()["positive_weight"]
    edges, vary = input_edges(training, names, settings.bins)
    vary = vary or [0]
    few, cuts = [names[i] for i in vary], [edges[i] for i in vary]
    known = training.where(F.col(label).isNotNull())
    n, positive = known.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    if not 0 < positive < n:
        raise ValueError("training needs rows of both classes")
    base = math.log(weight * positive / (n - positive))
    rows = _stored(training, few, cuts, label, weight, base, "training")
    held = _stored(validation, few, cuts, label, 1.0, base, "validation")
    trees: list[Tree] = []  # of the inputs that vary
    model = BoostedModel(few, cuts, base)  # with the trees that the stored margins don't have yet
    figures: list[float] = []
    best, kept = -1.0, 0
    for number in range(1, settings.rounds + 1):
        trees.append(grow(rows, model, settings))
        model = BoostedModel(few, cuts, base, [*model.trees, trees[-1]])
        figures.append(validation_figure(held, model))
        if figures[-1] > best + 1e-9:
            best, kept = figures[-1], number
        if number - kept >= settings.patience:
            break
        if number % CARRY == 0 and number < settings.rounds:
            rows, held = _carried(rows, model, "training"), _carried(held, model, "validation")
            model = BoostedModel(few, cuts, base)
    return BoostedModel(names, edges, base, [t.of(vary) for t in trees[:kept]], version), figures


def train_and_test(
    rows: DataFrame, settings: Settings | None = None, label: str = "is_fraud", time: str = "event_time", key: str = "transaction_id", train: float = 0.7, validation: float = 0.15,
) -> tuple[BoostedModel, DataFrame, DataFrame]:
    """(model, thresholds, test figures): grown on the oldest rows, stopped and tuned on the next, measured on the newest."""
    parts = write_table(ranking.time_split(rows, train, validation, time, key), "parts")
    matrix = lambda name: model_matrix(parts.where(F.col("part") == name), keep=(key, time, label))
    model, _ = fit(matrix("train"), matrix("validation"), settings, label)
    chosen = evaluate.tune_thresholds(model.score(matrix("validation")), score="model_score", label=label)
    row = chosen.first()
    tested = evaluate.evaluate_model(model.score(matrix("test")), row["review_threshold"], row["block_threshold"], score="model_score", label=label)
    return model, chosen, tested
