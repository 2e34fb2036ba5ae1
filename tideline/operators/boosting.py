"""Boosted regression trees of all folds side by side, over rows that are kept as bins.

Features are cut at thresholds from a bounded sample of each fold's training rows; every row is then a byte a feature.
A level of a tree is one pass: tasks count and add up gradients by node and bin, the sums are combined, and the driver,
which holds nothing but those sums, splits the nodes. Of two children only the smaller one is summed, the other is the
rest of its parent. The first pass of a round gives the validation errors of the round before, so a fold ends with the
round that its patience names, and no tree is fitted twice.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import ship


@dataclass(frozen=True)
class Settings:
    """The first tree counts in full, the others by `step`; gradients are those of the squared error."""

    rounds: int = 500
    patience: int = 50
    depth: int = 5
    bins: int = 255
    least: int = 50
    step: float = 0.03
    rows: float = 0.9
    columns: float = 0.9
    seed: int = 7


#: Rows of a block, of a stored partition at most, and trees that passes apply before predictions are stored again.
BLOCK_ROWS, PART_ROWS, HELD_TREES = 32_768, 4_000_000, 4
WIDTH = 256


@dataclass
class Tree:
    """Splits by level and values of the lowest level; a node that isn't split sends all rows left."""

    depth: int
    column: np.ndarray = None
    bin: np.ndarray = None
    value: np.ndarray = None

    def __post_init__(self):
        self.column = np.full(2**self.depth - 1, -1)
        self.bin, self.value = np.zeros(2**self.depth - 1, np.uint8), np.zeros(2**self.depth)

    def nodes(self, x: np.ndarray, level: int) -> np.ndarray:
        """The node of every row, which is a column of `x`, on a level."""
        at = np.zeros(x.shape[1], np.uint8)
        for k in range(level):
            right = np.zeros(x.shape[1], bool)
            for j, (column, cut) in enumerate(zip(self.column[2**k - 1 : 2 ** (k + 1) - 1], self.bin[2**k - 1 :], strict=False)):
                if column >= 0:
                    right |= (at == j) & (x[column] > cut)
            at = 2 * at + right
        return at


def added(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for tree in trees:
        out += tree.value[tree.nodes(x, tree.depth)]
    return out


@dataclass
class Model:
    thresholds: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(t, x[:, k]) for k, t in enumerate(self.thresholds)], np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return added(self.trees, self.binned(x))


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the best one that `patience` further rounds do not better, and whether there were that many."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def midpoints(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between distinct values: all, or those nearest to even shares of the values."""
    known, n = np.unique(values, return_counts=True)
    between = (known[1:] + known[:-1]) / 2
    if len(between) < bins:
        return between
    below = np.cumsum(n)[:-1]
    return between[np.unique(np.abs(below[None, :] - np.arange(1, bins)[:, None] * len(values) / bins).argmin(1))]


def thresholds(train: DataFrame, counts: dict[str, int], columns: list[str], bins: int) -> dict[str, list[np.ndarray]]:
    """By fold and column, from bins * bins training rows or 10,000, which a hash of their values picks."""
    wanted = max(bins * bins, 10_000)
    share = F.create_map(*[F.lit(v) for fold, n in counts.items() for v in (fold, min(1.0, wanted / n))])
    picked = F.pmod(F.xxhash64("label", *columns), F.lit(1 << 40)) < share[F.col("fold_id")] * float(1 << 40)

    def of_fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold_id": pdf["fold_id"].iloc[:1], "t": [[midpoints(pdf[c].to_numpy(float), bins) for c in columns]]})

    found = train.where(picked).select("fold_id", *columns).groupBy("fold_id").applyInPandas(of_fold, "fold_id string, t array<array<double>>")
    return {r.fold_id: [np.array(t, float) for t in r.t] for r in found.collect()}


def blocks(parts: DataFrame, models: dict[str, Model], columns: list[str], partitions: int) -> RDD:
    """(fold, trained on, number, bins by column, labels, predictions) of up to BLOCK_ROWS rows each. The number is a
    digest of the labels: a block that is made again draws the same rows."""

    def packed(fold: str, train: bool, held: list) -> pd.DataFrame:
        x, y = (np.concatenate(a, axis=-1) for a in zip(*held, strict=True))
        return pd.DataFrame({"fold": [fold], "train": [train], "x": [x.tobytes()], "y": [y.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            x, y = pdf[columns].to_numpy(float), pdf["label"].to_numpy(float)
            for key, at in pdf.groupby(["fold_id", "train"]).indices.items():
                mine = held.setdefault(key, [])
                mine.append((models[key[0]].binned(x[at]), y[at]))
                if sum(len(a[1]) for a in mine) >= BLOCK_ROWS:
                    yield packed(*key, held.pop(key))
        for key, mine in held.items():
            yield packed(*key, mine)

    def unpacked(row) -> tuple:
        y = np.frombuffer(row.y)
        return row.fold, row.train, zlib.crc32(row.y), np.frombuffer(row.x, np.uint8).reshape(len(columns), len(y)), y, np.zeros(len(y))

    return parts.mapInPandas(run, "fold string, train boolean, x binary, y binary").rdd.coalesce(partitions).map(unpacked)


@dataclass
class Growing:
    """What a task has to know of a fold in a pass."""

    round: int
    level: int
    held: list[Tree]
    tree: Tree
    slots: np.ndarray  # node -> place among the nodes to sum, or -1


def sums(part: Iterator[tuple], growing: dict[str, Growing], how: Settings) -> Iterator[dict]:
    """By fold: counts and sums of gradients by node, column and bin, and the squared error and number of validation rows."""
    found: dict = {}
    for fold, train, number, x, y, stored in part:
        if fold not in growing or not (train or growing[fold].level == 0):
            continue
        g = growing[fold]
        now = stored + added(g.held, x)
        places = int(g.slots.max()) + 1
        if fold not in found:
            found[fold] = [np.zeros((places, len(x), WIDTH, 2)), 0.0, 0]
        own = found[fold]
        if not train:
            own[1] += float(((y - now) ** 2).sum())
            own[2] += len(y)
            continue
        gradient = 2 * (y - now) if g.round else y
        drawn = np.random.default_rng((how.seed, g.round, number)).random(len(y), np.float32) < how.rows
        place = g.slots[g.tree.nodes(x, g.level)]
        at = np.flatnonzero(drawn & (place >= 0))
        base, gradient = place[at] * WIDTH, gradient[at]
        for k, bins in enumerate(x):
            cell = base + bins[at]
            own[0][:, k, :, 0] += np.bincount(cell, minlength=places * WIDTH).reshape(places, WIDTH)
            own[0][:, k, :, 1] += np.bincount(cell, gradient, places * WIDTH).reshape(places, WIDTH)
    yield found


def together(a: dict, b: dict) -> dict:
    for fold, own in b.items():
        a[fold] = [p + q for p, q in zip(a[fold], own, strict=True)] if fold in a else own
    return a


def split(h: np.ndarray, allowed: np.ndarray, least: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Column and bin of the greatest gain, first one first, with count and sum of both sides; None if there is no gain."""
    left = h.cumsum(1)[:, :-1]
    whole = h[0].sum(0)
    right = whole - left
    gain = (left[..., 1] ** 2 / np.maximum(left[..., 0], 1)) + (right[..., 1] ** 2 / np.maximum(right[..., 0], 1)) - whole[1] ** 2 / max(whole[0], 1)
    gain[(left[..., 0] < least) | (right[..., 0] < least) | ~allowed[:, None]] = 0
    column, cut = np.unravel_index(gain.argmax(), gain.shape)
    if gain[column, cut] <= 1e-12 * whole[1] ** 2 / max(whole[0], 1):
        return None
    return int(column), int(cut), left[column, cut], right[column, cut]


def grown(tree: Tree, level: int, nodes: dict[int, np.ndarray], weight: float, draw, how: Settings) -> tuple[dict, list[tuple[int, int]]]:
    """Split a level's nodes, given by their sums. Returns the parents' sums and, for each, (child to sum, its sibling)."""
    pairs = []
    for node, h in nodes.items():
        if found := split(h, draw(level, node), how.least):
            column, cut, *sides = found
            k = 2**level - 1 + node
            tree.column[k], tree.bin[k] = column, cut
            small = 2 * node + int(sides[1][0] < sides[0][0])
            pairs.append((small, small ^ 1))
        else:
            sides = [h[0].sum(0)]
        for side, (n, s) in enumerate(sides):  # values of the leaf in case that nothing below splits
            tree.value[(2 * node + side) << (how.depth - level - 1)] = weight * s / max(n, 1)
    return nodes, pairs


def fit(rows: DataFrame, columns, how: Settings = Settings()) -> dict[str, Model]:
    """A model for every fold that has rows in both its `train` and `valid` segments, up to its best round on the latter.

    `rows` have fold_id, segment, label and the columns, none missing, and are read three times: store what they are
    made from.
    """
    columns, sc = list(columns), ship(rows.sparkSession).sparkContext
    train = F.col("segment") == "train"
    parts = rows.where(train | (F.col("segment") == "valid")).select("fold_id", train.alias("train"), "label", *columns)
    counts: dict = {}
    for r in parts.groupBy("fold_id", "train").count().collect():  # two rows a fold
        counts.setdefault(r.fold_id, {})[r.train] = r["count"]
    counts = {fold: n for fold, n in sorted(counts.items()) if len(n) == 2}
    if not counts:
        return {}
    parts = parts.where(F.col("fold_id").isin(list(counts)))
    edges = thresholds(parts.where("train"), {fold: n[True] for fold, n in counts.items()}, columns, how.bins)
    models = {fold: Model(edges[fold]) for fold in counts}
    total = sum(sum(n.values()) for n in counts.values())
    stored = blocks(parts, models, columns, max(sc.defaultParallelism, -(-total // PART_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    errors, live, held = {fold: [] for fold in models}, list(models), {fold: [] for fold in models}
    for turn in range(how.rounds + 1):
        trees = {fold: Tree(how.depth) for fold in live}
        weight = how.step if turn else 1.0
        above, pairs = {}, {fold: [(0, None)] for fold in live}
        for level in range(how.depth):
            slots = {fold: np.full(2**level, -1) for fold in live}
            for fold in live:
                for place, (node, _) in enumerate(pairs[fold]):
                    slots[fold][node] = place
            growing = {fold: Growing(turn, level, held[fold], trees[fold], slots[fold]) for fold in live if pairs[fold]}
            if not growing:
                break
            found = stored.mapPartitions(lambda part, g=growing: sums(part, g, how)).treeReduce(together)
            if level == 0 and turn:
                for fold in list(live):
                    errors[fold].append(found[fold][1] / found[fold][2])
                    best, ended = best_round(errors[fold], how.patience)
                    if ended or turn == how.rounds:
                        models[fold].trees = models[fold].trees[:best]
                        live.remove(fold)
            for fold in [f for f in live if f in growing]:
                nodes = {}
                for place, (node, sibling) in enumerate(pairs[fold]):
                    nodes[node] = found[fold][0][place]
                    if sibling is not None:
                        rest = above[fold][node >> 1] - nodes[node]
                        nodes[sibling] = np.where(rest[..., :1] > 0, rest, 0.0)

                def draw(at: int, node: int, turn=turn, fold=fold) -> np.ndarray:
                    rng = np.random.default_rng((how.seed, turn, zlib.crc32(fold.encode()), at, node))
                    return np.isin(np.arange(len(columns)), rng.permutation(len(columns))[: math.ceil(how.columns * len(columns))])

                above[fold], pairs[fold] = grown(trees[fold], level, dict(sorted(nodes.items())), weight, draw, how)
        if not live:
            break
        for fold in live:
            models[fold].trees.append(trees[fold])
            held[fold] = [*held[fold], trees[fold]]
        if len(held[live[0]]) >= HELD_TREES:
            stored, held = advanced(stored, {fold: held[fold] for fold in live}), {fold: [] for fold in live}
    stored.unpersist()
    return models


def advanced(stored: RDD, held: dict[str, list[Tree]]) -> RDD:
    """The blocks of folds that go on, their predictions with the trees that are held."""
    now = stored.filter(lambda b: b[0] in held).map(lambda b: (*b[:5], b[5] + added(held[b[0]], b[3]))).persist(StorageLevel.MEMORY_AND_DISK)
    now.count()
    stored.unpersist()
    return now


def scored(rows: DataFrame, models: dict[str, Model], columns) -> DataFrame:
    """(datetime, instrument, score, fold_id) of rows by the model of their fold; rows of folds without one are left out."""
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, out = pdf[names].to_numpy(float), np.zeros(len(pdf))
            for fold, at in pdf.groupby("fold_id").indices.items():
                out[at] = models[fold].predict(x[at])
            yield pdf[["datetime", "instrument"]].assign(score=out, fold_id=pdf["fold_id"])

    own = rows.where(F.col("fold_id").isin(list(models))).select("datetime", "instrument", "fold_id", *names)
    return own.mapInPandas(run, "datetime date, instrument string, score double, fold_id string")
