"""Rolling moments against numpy, ranks and medians of crowded dates against plain ones."""

import hashlib
import math
import random
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import features, metrics, portfolio, ranks, state

DAY = date(2020, 1, 6)


def test_windows_are_made_of_smaller_ones():
    assert features.steps((5, 10, 20, 60)) == [(5, 5), (10, 2), (20, 2), (60, 3)]
    assert features.steps((7, 1)) == [(7, 7)] and features.steps(()) == []


def test_large_values_leave_no_trace(spark):
    """1e12 next to 1e-3: a window without the large value is as exact as if it had never been."""
    rng = random.Random(4)
    n = 200
    x = [rng.uniform(1e-3, 2e-3) for _ in range(n)]
    x[50] = x[120] = 1e12
    x[170] = None
    day = [DAY + timedelta(days=k) for k in range(n)]
    rows = [(day[k], "A", *[x[k]] * len(features.MEANS)) for k in range(n)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, " + ", ".join(f"{c} double" for c in features.MEANS)).repartition(3)
    got = features.moments(df, (5, 10, 20, 60)).orderBy("datetime").collect()
    for w in (5, 10, 20, 60):
        for k, r in enumerate(got):
            own = x[max(0, k - w + 1) : k + 1]
            m = r[f"_w{w}"]
            if len(own) < w or None in own:
                assert m["m_turnover"] is None and m["s_turnover"] is None and m["co"] is None
                continue
            mean = math.fsum(own) / w
            spread = math.fsum((v - mean) ** 2 for v in own)
            assert m["m_turnover"] == pytest.approx(mean, rel=1e-12)
            assert m["s_turnover"] == pytest.approx(spread, rel=1e-9)
            assert m["co"] == pytest.approx(spread, rel=1e-9)


def test_a_constant_window_has_no_spread(spark):
    rows = [(DAY + timedelta(days=k), "A", *[0.1] * len(features.MEANS)) for k in range(70)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, " + ", ".join(f"{c} double" for c in features.MEANS))
    last = features.moments(df, (5, 7, 60)).orderBy(F.desc("datetime")).first()
    assert [last[f"_w{w}"]["s_ret_1d"] for w in (5, 7, 60)] == [0.0] * 3 and last["_w60"]["m_ret_1d"] == 0.1


def sample(spark, seed=1, n=3000):
    """One crowded date with a value that a third of its rows share, and a small date with nothing to cut."""
    rng = random.Random(seed)
    rows = []
    for day, size in ((DAY, n), (DAY + timedelta(days=1), 40)):
        for k in range(size):
            score = 0.25 if rng.random() < 0.35 else round(rng.gauss(0, 1), 2)
            rows.append((day, f"{rng.choice('abé')}{k:05d}", score, rng.choice([None, -1.0, 0.0, rng.random()]), True, 0.1))
    return rows, spark.createDataFrame(rows, "datetime date, instrument string, score double, label double, tradable boolean, forward_return double").repartition(5)


@pytest.mark.parametrize("most", [200, 10**6])
def test_ranks_of_a_crowded_date(spark, most):
    rows, df = sample(spark)
    got = {(r.datetime, r.instrument): r for r in ranks.average_ranks(df, {"score": "rank"}, most=most).collect()}
    numbers = {(r.datetime, r.instrument): r for r in ranks.numbered(df, "score", "instrument", "r", "n", descending=True, most=most).collect()}
    for day in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == day]
        ordered = sorted(r[2] for r in own)
        first = {v: ordered.index(v) for v in set(ordered)}
        for r in own:
            assert got[r[:2]]["rank"] == first[r[2]] + (ordered.count(r[2]) + 1) / 2
        for k, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1].encode())), 1):
            assert (numbers[r[:2]]["r"], numbers[r[:2]]["n"]) == (k, len(own))


def test_metrics_don_t_depend_on_how_dates_are_cut(spark):
    _, df = sample(spark, 2)
    close = lambda a, b: [tuple(x) for x in a] == [tuple(pytest.approx(v) if isinstance(v, float) else v for v in x) for x in b]
    for run in (
        lambda most: metrics.rank_ic(df, most=most),
        lambda most: metrics.bucket_means(metrics.buckets(df, most=most)),
        lambda most: portfolio.top_fraction(df, 0.1, most).select("datetime", "instrument", "k", "r"),
        lambda most: ranks.medians(df, {"score": "a", "label": "b"}, most=most),
    ):
        a, b = (sorted(map(tuple, run(most).collect())) for most in (150, 10**6))
        assert a and close(a, b)


def test_median_by_selection(spark):
    rows, df = sample(spark, 3)
    for most in (20, 90):
        got = {r.datetime: r for r in ranks.medians(df, {"score": "a", "label": "b"}, most=most).collect()}
        for day in got:
            assert got[day].a == pytest.approx(statistics.median(r[2] for r in rows if r[0] == day))
            assert got[day].b == pytest.approx(statistics.median(r[3] for r in rows if r[0] == day and r[3] is not None))


def test_median_without_values(spark):
    df = spark.createDataFrame([(DAY, None)] * 30, "datetime date, v double")
    assert [tuple(r) for r in ranks.medians(df, {"v": "m"}, most=10).collect()] == [(DAY, None)]
    assert ranks.medians(df.limit(0), {"v": "m"}, most=10).collect() == []


def test_a_million_rows_of_one_date(spark):
    """Ranks and the median of 1,000,000 rows in parts none of which holds more than a thirtieth."""
    n, most = 1_000_000, 31_250
    df = spark.range(n, numPartitions=8).select(F.lit(DAY).alias("datetime"), F.lpad(F.col("id").cast("string"), 7, "0").alias("instrument"), ((F.col("id") * 7919) % n / 8.0).alias("score"))
    many = ranks.crowded(df, ["datetime"], most)
    sizes = ranks.parted(df, F.col("score"), ["datetime"], many, most).groupBy("_part").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= n / 30 and sizes[1] >= 64
    wrong = ranks.average_ranks(df, {"score": "rank"}, most=most).where(F.abs(F.col("rank") - (F.col("score") * 8 + 1)) > 1e-6)
    assert wrong.count() == 0
    assert ranks.medians(df, {"score": "m"}, most=most).first().m == (n - 1) / 16


def test_digest_of_many_keys_is_streamed(spark):
    names = [f"k{(k * 7919) % 100000:05d}é" for k in range(400)]
    df = spark.createDataFrame([(DAY, x) for x in names] + [(DAY + timedelta(days=1), "one")], "datetime date, instrument string")
    want = {DAY: hashlib.sha256("".join(x + "\0" for x in sorted(names)).encode()).hexdigest(), DAY + timedelta(days=1): hashlib.sha256(b"one\0").hexdigest()}
    for most in (100, 10_000):
        assert {r.datetime: r.digest for r in state.keyset_digests(df, most).collect()} == want


def test_rank_sum_is_that_of_positions(spark):
    _, df = sample(spark, 5)
    total = ranks.average_ranks(df, {"score": "rank"}, most=100).groupBy("datetime").agg(F.sum("rank"), F.count("*")).collect()
    assert all(np.isclose(s, n * (n + 1) / 2) for _, s, n in total)
