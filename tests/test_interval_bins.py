"""Interval winners of short and long histories against plain loops."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import intervals

DAY = date(2000, 1, 3)


def day(k):
    return DAY + timedelta(days=k)


@pytest.mark.parametrize("most", [2, 64])
def test_winner_is_the_greatest_that_covers(spark, most):
    rng = random.Random(most)
    spans = [(rng.choice("ABC"), rng.randint(0, 3), day(s), rng.choice([None, day(s + rng.randint(-2, 40))])) for s in (rng.randrange(300) for _ in range(60))]
    spans += [("D", 1, None, day(5)), ("E", 1, day(0), day(0)), (None, 1, day(0), None)]
    rows = [(i, day(d), k) for k, (i, d) in enumerate((i, d) for i in "ABCDEF" for d in range(-5, 330, 3))] + [("A", None, 999), (None, day(1), 998)]
    s = spark.createDataFrame(spans, "instrument string, rank int, start date, end date")
    r = spark.createDataFrame(rows, "instrument string, at date, k int").repartition(3)
    got = {x.k: x.hit for x in intervals.latest_covering(r, s, "at", ["rank"], "hit", most=most).collect()}
    assert len(got) == len(rows)
    for i, d, k in rows:
        own = [(x[1], x[2], x[3]) for x in spans if i is not None and x[0] == i and d and x[2] and x[2] <= d and (x[3] is None or d < x[3])]
        want = max(own, key=lambda x: (x[0], x[1], x[2] is not None and x[2] or date.min)) if own else None
        assert (got[k] and tuple(got[k])) == want


def test_a_hundred_thousand_intervals_of_one_instrument(spark):
    """Days meet the intervals of their bin: every interval is found, and few pairs are looked at."""
    n = 100_000
    spans = spark.range(n, numPartitions=4).select(F.lit("A").alias("instrument"), F.col("id").alias("rank"), F.date_add(F.lit(DAY), (F.col("id") % 20000).cast("int")).alias("start"), F.date_add(F.lit(DAY), (F.col("id") % 20000 + 2).cast("int")).alias("end"))
    rows = spark.range(20001).select(F.lit("A").alias("instrument"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("at"), "id")
    found = intervals.latest_covering(rows, spans, "at", ["rank"], "hit").select("id", "hit.rank")
    # Of the five intervals that start on each day the last has rank 80000 + day; the day before's still covers.
    want = F.when(F.col("id") == 20000, 99_999).otherwise(80_000 + F.col("id"))
    assert found.where(~F.col("rank").eqNullSafe(want)).count() == 0


def test_action_inside_the_label(spark):
    rows = [("A", day(k), day(k + 1) if k < 8 else None, day(k + 3) if k < 8 else None) for k in range(10)] + [("B", day(0), day(1), day(3))]
    actions = [("A", day(5)), ("A", day(5)), ("C", day(1)), ("A", None)]
    got = intervals.action_in_label(
        spark.createDataFrame(rows, "instrument string, datetime date, label_start date, label_end date"), spark.createDataFrame(actions, "instrument string, action_date date")
    ).collect()
    assert len(got) == len(rows)
    assert {(r.instrument, r.datetime) for r in got if r.label_crosses_action} == {("A", day(k)) for k in (2, 3, 4)}
