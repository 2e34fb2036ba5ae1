"""Models as data jobs: boosted trees fold by fold, and a per-date peer network with given weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import boosting
from tideline.operators.boosting import best_round  # noqa: F401
from tideline.operators.features import FEATURE_COLUMNS
from tideline.session import cut

MODEL_FEATURES = PEER_FEATURES = FEATURE_COLUMNS
#: A task lets its sums of dates go when it holds this many.
HELD_DATES = 1000


def complete(rows: DataFrame, columns) -> DataFrame:
    return rows.na.drop(subset=list(columns))


def fit_trees(train: DataFrame, valid: DataFrame, columns, rounds: int = 500, patience: int = 50) -> boosting.Model:
    """Squared loss with row and column subsampling, up to the best round on the validation part."""
    part = lambda df, name: df.select(F.lit("one").alias("fold_id"), F.lit(name).alias("segment"), "label", *columns)
    return boosting.fit(part(train, "train").unionByName(part(valid, "valid")), columns, boosting.Settings(rounds, patience))["one"]


def walk_forward(rows: DataFrame, fold_ids: list[str], columns=MODEL_FEATURES) -> DataFrame:
    """Fit on each fold's training part, score its test part, and lay the folds' scores end to end. The rows by fold are
    read four times and never stored as such: store what they are made from."""
    rows = complete(rows, [*columns, "label"]).where(F.col("fold_id").isin(fold_ids))
    models = boosting.fit(rows, columns)
    scores = boosting.scored(rows.where("segment = 'test'"), models, columns)
    return scores.select("datetime", "instrument", "score", "fold_id", F.lit("boosted_trees").alias("model_id"))


def weights(width: int, prototypes: int, heads: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"encode": (width, width * heads), "assign": (width * heads, prototypes), "query": (width * heads, width * heads), "key": (width * heads, width * heads), "value": (width * heads, width * heads), "out": (2 * width * heads,)}
    return {k: rng.normal(scale=0.3, size=s) for k, s in shapes.items()}


def weights_from(table: DataFrame, limit: int = 1_000_000) -> dict[str, np.ndarray]:
    """The network's matrices from a table of (name, r, c, value), one row an element; `out` is a column. A model has
    `limit` elements at most. Raises if an element is missing or given twice."""
    if (n := table.count()) > limit:
        raise ValueError(f"{n} weights, {limit} at most")
    found: dict[str, dict] = {}
    for w in table.select("name", "r", "c", "value").collect():
        if (w.r, w.c) in found.setdefault(w.name, {}):
            raise ValueError(f"{w.name} has element {w.r}, {w.c} twice")
        found[w.name][w.r, w.c] = w.value
    out = {}
    for name, cells in found.items():
        shape = tuple(1 + max(at) for at in zip(*cells, strict=True))
        if len(cells) != shape[0] * shape[1]:
            raise ValueError(f"{name} has gaps")
        out[name] = np.array([cells[at] for at in sorted(cells)]).reshape(shape)
    return out | ({"out": out["out"].ravel()} if "out" in out else {})


def peer_forward(rows: DataFrame, columns=PEER_FEATURES, prototypes: int = 8, heads: int = 2, given: dict | None = None) -> DataFrame:
    """Score of every row from its own encoding and its attention over the prototypes of its date.

    Tasks add up the parts of a date that they read, a combining aggregation adds those up to the prototypes, and rows
    are scored in batches after a join by date: no task holds a date.
    """
    w = given or weights(len(columns), prototypes, heads)
    names = list(columns)
    width = w["encode"].shape[1]

    def softmax(x: np.ndarray, axis: int) -> np.ndarray:
        e = np.exp(x - x.max(axis=axis, keepdims=True))
        return e / e.sum(axis=axis, keepdims=True)

    def encoded(pdf: pd.DataFrame) -> np.ndarray:
        return np.tanh(np.clip(pdf[names].to_numpy(float), -3, 3) @ w["encode"])

    def flushed(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(d, k, row.tolist()) for d, s in held.items() for k, row in enumerate(s)], columns=["day", "k", "s"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per date and prototype: the weighted sum of encodings, and the weight as its last element."""
        held: dict = {}
        for pdf in batches:
            h = encoded(pdf)
            a = softmax(h @ w["assign"], 1)
            h = np.concatenate([h, np.ones((len(h), 1))], 1)
            for d, at in pdf.groupby("day").indices.items():
                held[d] = held.get(d, 0) + a[at].T @ h[at]
            if len(held) > HELD_DATES:
                yield flushed(held)
                held = {}
        yield flushed(held)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = width // heads
        for pdf in batches:
            h, context = encoded(pdf), np.zeros((len(pdf), width))
            for at in pdf.groupby("day").indices.values():
                s = np.array(pdf["s"].iloc[at[0]]).reshape(-1, width + 1)
                p = s[:, :-1] / np.maximum(s[:, -1:], 1e-8)
                for k in range(heads):
                    part = slice(k * size, (k + 1) * size)
                    q, key, v = h[at] @ w["query"][:, part], p @ w["key"][:, part], p @ w["value"][:, part]
                    context[at, part] = softmax(q @ key.T / np.sqrt(size), 1) @ v
            yield pdf[["datetime", "instrument"]].assign(score=np.concatenate([h, h - context], 1) @ w["out"])

    # Rows without a date are a cross-section of their own.
    day = F.coalesce(F.unix_date("datetime"), F.lit(-(2**31)))
    rows = cut(rows.select("datetime", "instrument", *names, day.alias("day")))
    parts = rows.select("day", *names).mapInPandas(sums, "day int, k int, s array<double>")
    added = parts.groupBy("day", "k").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(width + 1)]).alias("s"))
    dates = added.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("s")).select("day", F.flatten("s.s").alias("s"))
    return rows.join(dates, "day").mapInPandas(forward, "datetime date, instrument string, score double")
