"""The peer network, forward: encoder, market gate, prototypes, attention over them, and head, with given weights.

A cross-section is a date. Its rows meet only in the prototypes, which are weighted means of their encodings: tasks add
up the parts of dates that they read, a combining aggregation adds those up, and rows are scored against the prototypes of
their date. No task holds a date: it takes some ten thousand rows at a time and computes those of a date together. Rows
that the mask leaves out add nothing, score 0 and never leave the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import broadcast_if_small, cut

HELD_DATES = 1000
#: Bytes of all dates' prototypes up to which every worker holds them; beyond, rows are joined with those of their date,
#: which are some hundred times as wide as a row.
SHARED_BYTES = 64 << 20
EPSILON = 1e-5  # of the layer norms
#: Rows that a task holds to find those of one date, and rows of a date computed at once (some MB, which caches hold).
HELD_ROWS, BLOCK_ROWS = 1 << 16, 1 << 12
#: The normal distribution function is 0 or 1 to the last bit outside of +-REACH; inside it is expanded around GRID points a unit.
REACH, GRID = 9, 128

#: name -> shape of every weight, by the sizes i (inputs), m (market state), h (hidden), k (prototypes).
SHAPES = {
    "encoder_w": "ih", "encoder_b": "1h", "encoder_scale": "1h", "encoder_shift": "1h", "gate_w": "mh", "gate_b": "1h", "gate2_w": "hh", "gate2_b": "1h",
    "assign_w": "hk", "assign_b": "1k", "query_w": "hh", "query_b": "1h", "key_w": "hh", "key_b": "1h", "value_w": "hh", "value_b": "1h", "mix_w": "hh", "mix_b": "1h",
    "head_w": "dh", "head_b": "1h", "head_scale": "1h", "head_shift": "1h", "out_w": "h1", "out_b": "11",
}


def checked(w: dict[str, np.ndarray], inputs: int, market: int, heads: int) -> dict[str, np.ndarray]:
    """The weights as matrices; raises if one is missing, has another shape, or the heads don't share the hidden size."""
    gated = market > 0
    wanted = {n: s for n, s in SHAPES.items() if gated or not n.startswith("gate")}
    if missing := sorted(set(wanted) - set(w)):
        raise ValueError(f"weights {missing} are missing")
    hidden, kinds = w["encoder_w"].shape[1], np.atleast_2d(w["assign_w"]).shape[1]
    size = {"1": 1, "i": inputs, "m": market, "h": hidden, "k": kinds, "d": 2 * hidden}
    if hidden % heads:
        raise ValueError(f"{heads} heads don't share {hidden} hidden units")
    out = {}
    for n, s in wanted.items():
        shape = tuple(size[x] for x in s)
        if w[n].size != shape[0] * shape[1] or (w[n].ndim == 2 and w[n].shape != shape):
            raise ValueError(f"{n} has shape {w[n].shape} where {shape} is due")
        out[n] = w[n].reshape(shape)
    return out


def _expansions() -> np.ndarray:
    """Taylor coefficients of the normal distribution function at the grid's points, up to degree 5: half a step away
    the rest is below 1e-16."""
    x = np.arange(-REACH * GRID, REACH * GRID + 1) / GRID
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    value = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in x.tolist()])
    slopes = (1, -x / 2, (x**2 - 1) / 6, -(x**3 - 3 * x) / 24, (x**4 - 6 * x**2 + 3) / 120)
    out = np.array([value, *[density * k for k in slopes]])
    out[:, 0], out[:, -1] = 0, np.eye(len(out))[0]
    return out


_EXPANSIONS = _expansions()


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Whole arrays at once, as numpy has no error function."""
    y = np.clip(x, -REACH, REACH)
    at = np.rint(y * GRID)
    d = y - at / GRID
    with np.errstate(invalid="ignore"):  # what is no number stays so through d
        at = (at + REACH * GRID).astype(np.int64)
    out = _EXPANSIONS[-1].take(at, mode="clip")
    for c in _EXPANSIONS[-2::-1]:
        out *= d
        out += c.take(at, mode="clip")
    return out


def gelu(x: np.ndarray) -> np.ndarray:
    return x * normal_cdf(x)


def norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + EPSILON) * scale + shift


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def encode(w: dict, x: np.ndarray, state: np.ndarray | None) -> np.ndarray:
    """Encodings of rows of one date, scaled by the gate of its market state."""
    h = gelu(norm(x @ w["encoder_w"] + w["encoder_b"], w["encoder_scale"], w["encoder_shift"]))
    if state is None:
        return h
    return h * (2 / (1 + np.exp(-(gelu(state[None] @ w["gate_w"] + w["gate_b"]) @ w["gate2_w"] + w["gate2_b"]))))


def attend(w: dict, h: np.ndarray, p: np.ndarray, heads: int) -> np.ndarray:
    """Scores of rows of one date from their encodings and its prototypes. All heads are computed at once: keys and values
    of a head fill its block of a matrix that is zero elsewhere."""
    hidden, kinds = h.shape[1], len(p)
    size = hidden // heads
    q, key, v = h @ w["query_w"] + w["query_b"], p @ w["key_w"] + w["key_b"], p @ w["value_w"] + w["value_b"]
    keys, values = np.zeros((hidden, heads * kinds)), np.zeros((heads * kinds, hidden))
    for k in range(heads):
        own, to = slice(k * size, (k + 1) * size), slice(k * kinds, (k + 1) * kinds)
        keys[own, to], values[to, own] = key[:, own].T / math.sqrt(size), v[:, own]
    shares = softmax((q @ keys).reshape(-1, heads, kinds)).reshape(-1, heads * kinds)
    context = shares @ values @ w["mix_w"] + w["mix_b"]
    y = gelu(norm(np.concatenate([h, h - context], 1) @ w["head_w"] + w["head_b"], w["head_scale"], w["head_shift"]))
    return (y @ w["out_w"] + w["out_b"])[:, 0]


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _by_day(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(day, its rows), several times for a day of over BLOCK_ROWS."""
    days = table["day"].to_numpy()
    order = np.argsort(days, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(days[order])) + 1):
        for at in range(0, len(own), BLOCK_ROWS):
            yield int(days[own[0]]), own[at : at + BLOCK_ROWS]


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    out = np.empty((len(table), len(names)))
    for k, n in enumerate(names):
        out[:, k] = table[n].to_numpy()
    return out


def forward(rows: DataFrame, columns: list[str], weights: dict[str, np.ndarray], heads: int = 4, state: DataFrame | None = None, states: tuple[str, ...] = (), valid: str | None = None, stored: bool = False) -> DataFrame:
    """(datetime, instrument, score) of every row. `state` has one row a date with the columns `states`; without it the
    network has no gate. `valid` names a boolean column; missing counts as false. Rows that are `stored` already, or come
    from such by cheap steps, are read several times and not stored again. Raises if a valid row has a feature that
    is missing or not finite, a date no state, or a date no valid row."""
    names, market = [f"x{k}" for k in range(len(columns))], [f"m{k}" for k in range(len(states))]
    w = checked(weights, len(names), len(market), heads)
    hidden, kinds = w["encoder_w"].shape[1], w["assign_w"].shape[1]
    ok = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)
    day = F.coalesce(F.unix_date("datetime"), F.lit(-(2**31)))  # rows without a date are a cross-section of their own
    rows = rows.select("datetime", "instrument", ok.alias("ok"), day.alias("day"), *[F.when(ok, F.col(c).cast("double")).alias(n) for c, n in zip(columns, names, strict=True)])
    rows = rows if stored else cut(rows)
    found = cut(rows.groupBy("day").agg(F.min("datetime").alias("datetime"), F.bool_or("ok").alias("any")))  # one row a date
    gated = rows
    if market:
        per = state.select(F.unix_date("datetime").alias("day"), *[F.col(c).cast("double").alias(m) for c, m in zip(states, market, strict=True)])
        per = broadcast_if_small(per, 16 + 8 * len(market))
        gated = rows.join(per, "day", "left")
        if none := found.join(per, "day", "left").where(" or ".join(f"{m} is null" for m in market)).first():
            raise ValueError(f"date {none.datetime} has no market state")

    def flushed(held: dict) -> pa.RecordBatch:
        out = [(d, k, row.tolist()) for d, s in held.items() for k, row in enumerate(s)]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["day", "k", "s"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per date and prototype: the weighted sum of encodings, and the weight as its last element."""
        held: dict = {}
        for table in _held(batches, HELD_ROWS):
            x, m = _matrix(table, names), _matrix(table, market)
            for d, at in _by_day(table):
                h = encode(w, x[at], m[at[0]] if market else None)
                a = softmax(h @ w["assign_w"] + w["assign_b"])
                held[d] = held.get(d, 0) + a.T @ np.concatenate([h, np.ones((len(h), 1))], 1)
            if len(held) > HELD_DATES:
                yield flushed(held)
                held = {}
        yield flushed(held)

    def scores(table: pa.Table, of_date) -> Iterator[pa.RecordBatch]:
        x, score = _matrix(table, names), np.zeros(len(table))
        for d, at in _by_day(table):
            s, m = of_date(d, at[0])
            s = s.reshape(kinds, hidden + 1)
            score[at] = attend(w, encode(w, x[at], m if market else None), s[:, :-1] / np.maximum(s[:, -1:], 1e-8), heads)
        yield from table.select(["datetime", "instrument"]).append_column("score", pa.array(score)).to_batches()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, 1):
            yield from scores(table, lambda d, k: tuple(table[c][int(k)].values.to_numpy() for c in ("s", "m")))  # noqa: B023

    parts = gated.where("ok").select("day", *names, *market).mapInArrow(sums, "day int, k int, s array<double>")
    added = parts.groupBy("day", "k").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(hidden + 1)]).alias("s"))
    dates = added.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("s")).select("day", F.flatten("s.s").alias("s"))
    if market:
        dates = dates.join(per, "day")
    dates = cut(dates.select("day", "s", F.array(*[F.col(m) for m in market]).cast("array<double>").alias("m")))  # prototypes of a date: a fixed size
    if not dates.where("exists(s, e -> isnan(e))").isEmpty():  # as where a feature is not finite, or finite ones overflow
        bad = " or ".join(f"{n} is null or isnan({n}) or abs({n}) = double('inf')" for n in names)
        if wrong := rows.where(f"ok and ({bad})").first():
            raise ValueError(f"{wrong.instrument} on {wrong.datetime} is valid and has a feature that is not finite")
    if bare := found.where("not any").first():
        raise ValueError(f"date {bare.datetime} has no valid row")
    out = "datetime date, instrument string, score double"
    masked = rows.where("not ok").select("datetime", "instrument", F.lit(0.0).alias("score"))
    rows = rows.where("ok").drop("ok")
    if dates.count() * 8 * kinds * (hidden + 1) > SHARED_BYTES:
        return rows.join(dates, "day").mapInArrow(joined, out).unionByName(masked)
    shared = rows.sparkSession.sparkContext.broadcast({r.day: (np.array(r.s), np.array(r.m)) for r in dates.collect()})

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, HELD_ROWS):
            yield from scores(table, lambda d, k: shared.value[d])

    return rows.mapInArrow(looked_up, out).unionByName(masked)
