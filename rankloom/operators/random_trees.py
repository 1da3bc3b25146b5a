"""Extremely randomised trees: cuts are drawn at random within a node's ranges, the best of the drawn ones splits it.

A forest grows level by level, all trees and nodes of a level at once. Two passes over the rows make a level: the ranges and label counts of open nodes, then the label counts
left of each drawn cut. Rows stay where they are; a task passes on its counts by tree, node and feature, which are summed. The driver holds the trees, which
are bounded by their number and depth, never rows. What is drawn depends on seed, tree and node only, and counts are whole numbers, so a forest doesn't depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Tree:
    """Splits by node (feature, cut; the children of node k are 2k and 2k + 1, rows up to the cut go to 2k), and shares of label 1 by leaf."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at = np.ones(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            here = at[open_]
            known = [k for k in np.unique(here).tolist() if k in self.splits]
            if not known:
                break
            moved = []
            for k in known:
                rows = open_[here == k]
                f, cut = self.splits[k]
                at[rows] = 2 * k + (x[rows, f] > cut)
                moved.append(rows)
            open_ = np.concatenate(moved)
        return at


@dataclass(frozen=True)
class Growth:
    """Trees, their depth, the fewest rows of a leaf, the share of features drawn at a node, whether labels weigh the same, and the seed."""

    trees: int = 100
    depth: int = 10
    leaf: int = 4
    share: float = 0.9
    balanced: bool = True
    seed: int = 42


def drawn(g: Growth, tree: int, node: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, float]]:
    """The cuts that a node may be split at: of features with more than one value, one cut each."""
    rng = np.random.default_rng([g.seed, tree, node])
    order, spots = rng.permutation(len(low)), rng.random(len(low))
    wide = [f for f in order.tolist() if high[f] > low[f]]
    return [(f, float(low[f] + spots[f] * (high[f] - low[f]))) for f in wide[: max(1, round(g.share * len(low)))]]


def impurity(n0: float, n1: float) -> float:
    """Gini's impurity times the weight."""
    n = n0 + n1
    return 2.0 * n0 * n1 / n if n else 0.0


def best(g: Growth, weights: tuple[float, float], counts: tuple[int, int], cuts: list[tuple[int, float]], left: list[tuple[int, int]]) -> tuple[int, float] | None:
    """The cut that leaves the least impurity and a leaf's rows on either side, the lowest feature of equal ones; none if no cut does."""
    found = []
    for (f, cut), (l0, l1) in zip(cuts, left, strict=True):
        r0, r1 = counts[0] - l0, counts[1] - l1
        if min(l0 + l1, r0 + r1) >= g.leaf:
            w0, w1 = weights
            found.append((round(impurity(l0 * w0, l1 * w1) + impurity(r0 * w0, r1 * w1), 9), f, cut))
    return min(found)[1:] if found else None


def weights_of(g: Growth, n0: int, n1: int) -> tuple[float, float]:
    return (0.5 * (n0 + n1) / n0, 0.5 * (n0 + n1) / n1) if g.balanced and n0 and n1 else (1.0, 1.0)


def share_of(weights: tuple[float, float], n0: int, n1: int) -> float:
    a, b = n0 * weights[0], n1 * weights[1]
    return b / (a + b) if a + b else 0.0


def _matrix(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    x = batch[column]
    return np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _ranges(forest: list[Tree], open_: list[set[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch), np.asarray(batch["label"]).astype(bool)
            rows = []
            for t, tree in enumerate(forest):
                at = tree.nodes(x) if open_[t] else np.zeros(0)
                for k in open_[t] & set(np.unique(at).tolist()):
                    mine = at == k
                    n1 = int(y[mine].sum())
                    rows += [(t, k, f, int(mine.sum()) - n1, n1, a, b) for f, (a, b) in enumerate(zip(x[mine].min(axis=0).tolist(), x[mine].max(axis=0).tolist(), strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["tree", "node", "feature", "n0", "n1", "low", "high"])

    return run


def _lefts(forest: list[Tree], cuts: dict[tuple[int, int], list[tuple[int, float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch), np.asarray(batch["label"]).astype(bool)
            rows, at = [], {t: forest[t].nodes(x) for t in {t for t, _ in cuts}}
            for (t, k), of in cuts.items():
                mine = at[t] == k
                if mine.any():
                    xs, ys = x[mine], y[mine]
                    for f, cut in of:
                        left = xs[:, f] <= cut
                        n1 = int(ys[left].sum())
                        rows.append((t, k, f, int(left.sum()) - n1, n1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["tree", "node", "feature", "n0", "n1"])

    return run


def grow(rows: DataFrame, g: Growth = Growth()) -> list[Tree]:
    """A forest on rows (features: an array of doubles of one length, label 0 or 1). Without rows its trees say 0."""
    data = rows.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))
    forest, open_ = [Tree() for _ in range(g.trees)], [{1} for _ in range(g.trees)]
    weights = None
    for level in range(g.depth + 1):
        if not any(open_):
            break
        seen = data.mapInArrow(_ranges(forest, open_), "tree long, node long, feature long, n0 long, n1 long, low double, high double")
        seen = seen.groupBy("tree", "node", "feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("low").alias("low"), F.max("high").alias("high"))
        nodes: dict[tuple[int, int], list] = {}
        for r in seen.orderBy("tree", "node", "feature").toLocalIterator():  # trees x nodes x features
            nodes.setdefault((r.tree, r.node), []).append(r)
        if weights is None:
            first = next(iter(nodes.values()), None)
            weights = weights_of(g, first[0].n0, first[0].n1) if first else (1.0, 1.0)
        cuts = {}
        for (t, k), of in nodes.items():
            n0, n1 = of[0].n0, of[0].n1
            forest[t].leaves[k] = share_of(weights, n0, n1)
            if level < g.depth and min(n0, n1) > 0 and n0 + n1 >= 2 * g.leaf:
                cuts[t, k] = drawn(g, t, k, np.array([r.low for r in of]), np.array([r.high for r in of]))
        cuts = {at: of for at, of in cuts.items() if of}
        left = data.mapInArrow(_lefts(forest, cuts), "tree long, node long, feature long, n0 long, n1 long").groupBy("tree", "node", "feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        sums = {(r.tree, r.node, r.feature): (r.n0, r.n1) for r in left.toLocalIterator()} if cuts else {}
        open_ = [set() for _ in range(g.trees)]
        for (t, k), of in cuts.items():
            counts = nodes[t, k][0].n0, nodes[t, k][0].n1
            split = best(g, weights, counts, of, [sums.get((t, k, f), (0, 0)) for f, _ in of])
            if split:
                forest[t].splits[k] = split
                del forest[t].leaves[k]
                open_[t] = open_[t] | {2 * k, 2 * k + 1}
    return forest


def probability(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """The mean of the trees' shares."""
    total = np.zeros(len(x))
    for tree in forest:
        at = tree.nodes(x)
        total += np.array([tree.leaves.get(k, 0.0) for k in at.tolist()])
    return total / max(len(forest), 1)


def score(rows: DataFrame, forest: list[Tree], column: str = "probability") -> DataFrame:
    """The rows with their probability."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability(forest, _matrix(batch)) if batch.num_rows else [], pa.float64())], [*names, column])

    return rows.mapInArrow(run, schema)
