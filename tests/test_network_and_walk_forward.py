"""The network against a plain forward pass; the walk-forward job killed and started again."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tideline.operators import network, walkforward
from tideline.session import cut, unique_folder

DAY = date(2020, 1, 6)
COLUMNS, STATES, HEADS, HIDDEN, KINDS = ["a", "b", "c"], ("u", "v"), 2, 8, 4


def given(seed=3):
    rng = np.random.default_rng(seed)
    size = {"1": 1, "i": 3, "m": 2, "h": HIDDEN, "k": KINDS, "d": 2 * HIDDEN}
    return {n: rng.normal(scale=0.5, size=(size[s[0]], size[s[1]])) for n, s in network.SHAPES.items()}


def plain(w, x, state, ok, gated=True):
    """One date, row by row and head by head, in the order of the definition."""
    erf = np.vectorize(math.erf)
    gelu = lambda z: 0.5 * z * (1 + erf(z / math.sqrt(2)))
    lin = lambda z, n: z @ w[f"{n}_w"] + w[f"{n}_b"][0]

    def norm(z, n):
        mean = z.mean(1)[:, None]
        return (z - mean) / np.sqrt(((z - mean) ** 2).mean(1)[:, None] + 1e-5) * w[f"{n}_scale"][0] + w[f"{n}_shift"][0]

    h = gelu(norm(lin(np.where(ok[:, None], x, 0), "encoder"), "encoder"))
    if gated:
        h = h * 2 / (1 + np.exp(-lin(gelu(lin(state, "gate")), "gate2")))
    e = np.exp(lin(h, "assign"))
    a = e / e.sum(1)[:, None] * ok[:, None]
    p = (a.T @ h) / np.maximum(a.sum(0), 1e-8)[:, None]
    q, k, v = lin(h, "query"), lin(p, "key"), lin(p, "value")
    context, d = np.zeros_like(h), HIDDEN // HEADS
    for j in range(HEADS):
        s = slice(j * d, (j + 1) * d)
        t = np.exp(q[:, s] @ k[:, s].T / math.sqrt(d))
        context[:, s] = t / t.sum(1)[:, None] @ v[:, s]
    y = gelu(norm(lin(np.concatenate([h, h - lin(context, "mix")], 1), "head"), "head"))
    return np.where(ok, lin(y, "out")[:, 0], 0.0)


def sample(spark, order=0):
    rng = random.Random(1)
    rows = [(DAY + timedelta(days=d), f"i{k}", *[rng.gauss(0, 1) for _ in range(3)], rng.random() < 0.8 or k == 0) for d in range(3) for k in range(20)]
    rows = [r if r[5] else (*r[:2], None, float("nan"), 1e9, r[5]) for r in rows]
    state = [(DAY + timedelta(days=d), rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(3)]
    random.Random(order).shuffle(rows)
    df = spark.createDataFrame(rows, "datetime date, instrument string, a double, b double, c double, ok boolean").repartition(3)
    return rows, state, df, spark.createDataFrame(state, "datetime date, u double, v double")


@pytest.mark.parametrize("gated", [True, False])
def test_forward_is_that_of_the_definition(spark, gated):
    rows, state, df, states = sample(spark)
    w = given()
    out = network.forward(df, COLUMNS, w, HEADS, states if gated else None, STATES if gated else (), "ok").collect()
    got = {(r.datetime, r.instrument): r.score for r in out}
    assert len(out) == len(rows)
    for day, *m in state:
        own = [r for r in rows if r[0] == day]
        x = np.array([[0 if v is None else v for v in r[2:5]] for r in own])
        want = plain(w, x, np.array(m), np.array([r[5] for r in own]), gated)
        assert [got[r[:2]] for r in own] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-12)


def test_order_and_masked_rows_don_t_matter(spark):
    _, _, df, states = sample(spark)
    w = given()
    of = lambda rows: {(r.datetime, r.instrument): r.score for r in network.forward(rows, COLUMNS, w, HEADS, states, STATES, "ok").collect()}
    whole, again = of(df), of(sample(spark, 5)[2])
    assert whole == pytest.approx(again, rel=1e-9)
    kept = of(df.where("ok"))
    assert kept == pytest.approx({k: whole[k] for k in kept}, rel=1e-9)
    assert all(whole[k] == 0 for k in set(whole) - set(kept)) and len(kept) < len(whole)


def test_the_network_refuses(spark):
    _, _, df, states = sample(spark)
    w = given()
    run = lambda rows, s=states, weights=w, heads=HEADS: network.forward(rows, COLUMNS, weights, heads, s, STATES, "ok")
    with pytest.raises(ValueError, match="not finite"):
        run(df.withColumn("ok", F.lit(True)))
    with pytest.raises(ValueError, match="no market state"):
        run(df, states.limit(2))
    with pytest.raises(ValueError, match="no valid row"):
        run(df.withColumn("ok", F.col("ok") & (F.col("datetime") != F.lit(DAY))))
    with pytest.raises(ValueError, match="missing"):
        run(df, weights={n: x for n, x in w.items() if n != "gate2_b"})
    with pytest.raises(ValueError, match="shape"):
        run(df, weights=w | {"head_w": np.zeros((3, 3))})
    with pytest.raises(ValueError, match="heads"):
        run(df, heads=3)
    assert network.forward(df.limit(0), COLUMNS, w, HEADS, states, STATES, "ok").collect() == []


def test_stored_rows_are_read_and_masked_ones_stay_where_they_are(spark, monkeypatch):
    _, _, df, states = sample(spark)
    run = lambda rows, **how: network.forward(rows, COLUMNS, given(), HEADS, states, STATES, "ok", **how)
    of = lambda out: {(r.datetime, r.instrument): r.score for r in out.collect()}
    whole, kept, made = of(run(df)), cut(df), []
    monkeypatch.setattr(network, "cut", lambda x: made.append(x.columns) or cut(x))
    out = run(kept, stored=True)
    assert made and not any("x0" in columns for columns in made)
    assert of(out) == pytest.approx(whole, rel=1e-12)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in text and "MapInPandas" not in text


def test_the_distribution_function_is_that_of_math():
    x = np.concatenate([np.linspace(-12, 12, 20001), [np.inf, -np.inf]])
    want = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in x])
    assert abs(network.normal_cdf(x) - want).max() < 1e-15 and np.isnan(network.normal_cdf(np.array([np.nan])))[0]


def test_large_dates_and_batches_in_parts(spark, monkeypatch):
    _, _, df, states = sample(spark)
    of = lambda: {(r.datetime, r.instrument): r.score for r in network.forward(df, COLUMNS, given(), HEADS, states, STATES, "ok").collect()}
    want = of()
    monkeypatch.setattr(network, "HELD_ROWS", 7)
    monkeypatch.setattr(network, "HELD_DATES", 1)
    assert of() == pytest.approx(want, rel=1e-12)


def folds_of(spark):
    rng = random.Random(2)
    rows = []
    for fold in ("f1", "f2", "f3", "none"):
        for k in range(60):
            x, y = rng.gauss(0, 1), rng.gauss(0, 1)
            segment = "test" if fold == "none" else ["train", "valid", "test"][k // 20]
            rows.append((fold, segment, DAY + timedelta(days=k % 20 // 5), f"i{k}", 2 * x - y if k % 7 else None, x, y))
    return cut(spark.createDataFrame(rows, "fold_id string, segment string, datetime date, instrument string, label double, x double, y double"))


def least_squares(fits, stop_after=None):
    inner = LinearRegression(featuresCol=walkforward.INPUT, labelCol="label", predictionCol="score", solver="normal")

    def fit(train, valid):
        if stop_after is not None and len(fits) >= stop_after:
            raise KeyboardInterrupt("killed")
        fits.append(train.count())
        assert valid.count()
        return inner.fit(train)

    return walkforward.ColumnEstimator(["x", "y"], fit)


def test_a_killed_job_goes_on_where_it_stopped(spark):
    rows, folder, fits = folds_of(spark), unique_folder(spark, "walk"), []
    ids = ["f1", "f2", "f3", "none"]
    with pytest.raises(KeyboardInterrupt):
        walkforward.run(rows, ids, least_squares(fits, 1), folder, "m")
    assert len(fits) == 1 and walkforward.done(spark, f"{folder}/f1/scores") and not walkforward.done(spark, f"{folder}/f2/scores")
    scores = walkforward.run(rows, ids, least_squares(fits), folder, "m")
    assert len(fits) == 3  # f1 is not fitted again, `none` has nothing to fit
    assert scores.count() == 60 and {r.fold_id for r in scores.select("fold_id").distinct().collect()} == {"f1", "f2", "f3"}
    assert scores.where("abs(score - label) > 1e-6").count() == 0
    walkforward.run(rows, ids, least_squares(fits), folder, "m")
    assert len(fits) == 3
    with pytest.raises(ValueError, match="another job"):
        walkforward.run(rows, ids, least_squares(fits), folder, "other")
    measured = {r.fold_id: r for r in walkforward.measured(scores).collect()}
    assert set(measured) == {"f1", "f2", "f3", "all"} and measured["all"].rank_ic_mean == pytest.approx(1.0)
    assert measured["all"].observations == sum(measured[f].observations for f in ("f1", "f2", "f3"))


def test_a_model_keeps_its_columns(spark):
    rows, path = folds_of(spark), unique_folder(spark, "model")
    model = least_squares([]).fit(rows.where("fold_id = 'f1' and label is not null"))
    model.write().overwrite().save(path)
    back = walkforward.ColumnModel.read().load(path)
    assert back.columns == ["x", "y"]
    test = rows.where("segment = 'test'")
    score = lambda m: sorted((r.fold_id, r.instrument, r.score) for r in m.transform(test).collect())
    assert score(back) == score(model)
    with pytest.raises(ValueError, match="column 0 is y where the model has x"):
        back.transform(test.select("fold_id", "instrument", "y", "x"))
    with pytest.raises(ValueError, match="missing"):
        back.transform(test.drop("y"))
