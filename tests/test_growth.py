"""Steps whose cost must not outgrow the input: one pass by instrument, lists, sides read once, prototypes held apart."""

import random
import re
from datetime import date, timedelta

import pytest

from pyspark.sql import functions as F

from tests.test_network_and_walk_forward import COLUMNS, HEADS, HIDDEN, KINDS, STATES, given, sample
from tideline.operators import checks, intervals, ledgers, network, trees
from tideline.operators.features import features, history
from tideline.plans import audit, panel, registry
from tideline.plans.panel import Inputs
from tideline.session import partitions_for
from tideline.sources import fixtures

DAY = date(2020, 1, 6)
SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def gappy(spark):
    rng = random.Random(4)
    calendar = spark.createDataFrame([(DAY + timedelta(days=7 * k), k + 1) for k in range(30)], "session date, pos int")
    rows = [(DAY + timedelta(days=7 * k), f"i{j}", rng.random(), None if rng.random() < 0.1 else rng.random()) for k in range(30) for j in range(6) if rng.random() < 0.7]
    return calendar, spark.createDataFrame(rows, "datetime date, instrument string, open double, close double")


def test_labels_of_a_panel_need_no_join_of_it(spark):
    calendar, panel = gappy(spark)
    got = intervals.labelled(panel, calendar)
    want = intervals.labels(intervals.label_schedule(panel, calendar), panel).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "close" in got.columns and plan(got).count("SortMergeJoin") <= plan(intervals.label_schedule(panel, calendar)).count("SortMergeJoin")


@pytest.mark.parametrize("most", [64, 2, 0])
def test_events_by_list_and_by_order_are_alike(spark, most):
    _, panel = gappy(spark)
    rng = random.Random(5)
    events = [(f"i{rng.randrange(8)}", DAY + timedelta(days=rng.randrange(200)), k, k * 3) for k in range(30)] + [("i1", None, 77, 5)]
    events = spark.createDataFrame(events, "instrument string, known date, tie int, v int")
    got = intervals.asof_backward(panel, events, "instrument", "datetime", "known", ["tie"], ["v"], most)
    want = intervals._asof_ordered(panel, events, "instrument", "datetime", "known", ["tie"], ["v"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_flags_shuffle_the_panel_once(spark):
    """Only lists of events and intervals are joined to it, by instrument."""
    x = Inputs(spark, SMALL)
    text = x.flagged()._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") <= 3  # the panel, and the few lines that the two halves of the view `action` let through
    assert not re.search(r"hashpartitioning\([^)]*label_", text)


def test_keys_of_both_sides_are_read_once(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k int, t string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (None, "z")], "k int, t string")
    got = checks.keys_differ(a, b, ["k", "t"])
    assert sorted((r.t, r.side) for r in got.collect()) == [("w", "right"), ("x", "left"), ("z", "left"), ("z", "right")]
    assert "Join" not in plan(got)


def test_the_score_contract_multiplies_no_rows(spark):
    rows = [(DAY, "a", "f1", "m", 1.0), (DAY, "a", "f1", "m", None), (DAY, "b", "f2", "n", 2.0), (None, "b", "f2", "n", 2.0)]
    scores = spark.createDataFrame(rows, "datetime date, instrument string, fold_id string, model_id string, score double")
    out = checks.score_contract(scores, 2, "2020-01-06")
    assert out.first().asDict() == {"rows": 4, "keys": 2, "missing": 1, "models": 2, "folds": 2, "late": 3, "ok": False}
    empty = checks.score_contract(scores.limit(0), 0, "2020-01-06").first()
    assert (empty.rows, empty["keys"], empty.missing, empty.late) == (0, 0, 0, 0)


def test_prototypes_don_t_ride_on_rows(spark, monkeypatch):
    _, _, df, states = sample(spark)
    run = lambda: network.forward(df, COLUMNS, given(), HEADS, states, STATES, "ok")
    of = lambda out: {(r.datetime, r.instrument): r.score for r in out.collect()}
    held = run()
    assert "Join" not in plan(held)
    monkeypatch.setattr(network, "SHARED_BYTES", 8 * KINDS * (HIDDEN + 1))
    joined = run()
    assert "Join" in plan(joined)
    assert of(held) == pytest.approx(of(joined), rel=1e-12)


def test_partitions_grow_with_rows(spark):
    assert partitions_for(spark, 2000, 50) == 40 and partitions_for(spark, 10, 50) == 4


def test_poisoned_rows_are_compared_where_they_are(spark):
    """One shuffle by instrument for both builds and all sets of columns, and no grouping of pairs."""
    rows = [(DAY + timedelta(days=7 * k), f"i{j}", float(k + j + 1)) for k in range(12) for j in range(3)]
    panel = spark.createDataFrame(rows, "datetime date, instrument string, amount double")
    build = lambda df: df.withColumns({"own": F.sum("amount").over(history()), "next": F.lead("amount", 2).over(history())})
    out = checks.future_poisons(panel, str(DAY + timedelta(days=35)), {"good": ("own",), "bad": ("own", "next")}, build=build)
    assert plan(out).count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan(out)
    assert sorted((r.variant, (r.datetime - DAY).days, r.instrument, r.changed) for r in out.collect()) == [("bad", d, f"i{j}", 1) for d in (28, 35) for j in range(3)]


def test_means_of_windows_are_computed_once(spark):
    """A mean is a column, not text repeated inside every sum of squares."""
    columns = "datetime date, instrument string, open double, high double, low double, close double, volume double, amount double, turnover double, corporate_action boolean"
    text = plan(features(spark.createDataFrame([], columns)))
    assert "_m_ret_1d" in text


def test_ledger_tasks_hold_a_bounded_number_of_ids(spark, monkeypatch):
    """Every step by id or order is dealt by the number of rows, and adaptive execution does not undo it."""
    known = [(k, "a", f"e{k}", None) for k in range(20)]
    new = [(20, "a", "e20", None), (21, "a", "e3", None), (22, "b", None, "f22"), (23, "b", None, "f22"), (5, "z", "e5", None), (24, "a", "e24", None)]
    columns = "source_event_id long, event string, evaluation_id string, fit_id string"
    ledger, journal = spark.createDataFrame(known, columns), spark.createDataFrame(new, columns)
    asked = []
    monkeypatch.setattr(ledgers, "partitions_for", lambda s, rows: asked.append(rows) or 7)
    ranged, cut = [], ledgers.cut
    monkeypatch.setattr(ledgers, "cut", lambda df: ranged.append(plan(df)) or cut(df))
    out = ledgers.problems(ledger, journal, 22, 5)
    found = [(5, "conflict"), (21, "repeated_evaluation"), (22, "repeated_fit"), (23, "repeated_fit"), (24, "evaluation_cap")]
    assert sorted((r.source_event_id, r.problem) for r in out.collect()) == found
    assert asked == [26] and any("rangepartitioning" in p and re.search(r"rangepartitioning\([^)]*, 7\)", p) for p in ranged)
    assert not re.search(r"hashpartitioning\(source_event_id#\d+L, (?!7\b)", plan(out)) and "hashpartitioning(source_event_id" in plan(out)


def test_lines_go_to_their_leaves_before_lists_are_made(spark, monkeypatch):
    rows = spark.createDataFrame([(DAY, str(k), k / 3) for k in range(40)], "datetime date, instrument string, close double")
    plans, cut = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    trees.tree(rows, "datetime", "instrument", ["close"], 1, parts=7)
    below = plans[0].split("Exchange")
    assert len(below) == 2 and "Aggregate" not in below[1] and ", 7)" in below[1]


def test_only_unlike_cells_become_text(spark):
    """Rows are joined by their values; the same fractions, missing ones and those unlike below rounding are no change."""
    left = [("a", 1.0, 1.5, 1), ("b", None, None, 2), ("c", 0.0, 2.0, 3), ("d", 1.0, 1.0, 4), ("e", None, 5.0, None), ("f", 1.0, 2.0, 3)]
    right = [("a", 1.0, 1.5, 1), ("b", None, None, 2), ("c", -0.0, 2.00001, 3), ("d", 2.0, None, 5), ("e", 3.0, 5.0, 0), ("g", 1.0, None, 3)]
    schema = "instrument string, close double, turnover float, volume long"
    a, b = (spark.createDataFrame(side, schema).withColumn("datetime", F.lit(DAY)) for side in (left, right))
    columns = ["close", "turnover", "volume"]
    out = trees.changed_cells(a, b, tuple(trees.tree(x, "datetime", "instrument", columns, 1) for x in (a, b)), "datetime", "instrument", columns, 1)
    want = [("d", "close", "1.0000", "2.0000"), ("d", "turnover", "1.0000", ""), ("d", "volume", "4", "5"), ("e", "close", "", "3.0000"), ("e", "volume", "", "0"), ("f", "-", "row", None), ("g", "-", None, "row")]
    assert sorted(tuple(r)[1:] for r in out.collect()) == want
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(38,4)" in text and "decimal(38,4)" not in text[text.index("Join FullOuter") :]


def test_fractions_are_spelled_as_when_rounded_first(spark):
    rng = random.Random(8)
    values = [s * v for s in (1, -1) for v in (0.0, 5e-5, 4.9999e-5, 0.00005, 1.00005, 2.675, 1e-12, 99999999.99995, 99999999999.99995, 1e11, 123456789012345.67, 3e15)]
    values += [rng.choice((1, -1)) * round(rng.random() * 10 ** rng.randrange(16), rng.randrange(8)) for _ in range(5000)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    rounded = F.coalesce(F.round(F.col("v") + 1e-9, 4).cast("decimal(38,4)").cast("string"), F.lit(""))
    assert rows.where(~trees.canonical("v", "double", 4).eqNullSafe(rounded)).collect() == []
    assert "CASE WHEN" in plan(rows.select(trees.canonical("v", "double", 4)))


def test_tree_difference_stores_what_it_compares(spark, monkeypatch):
    stored, cut = [], audit.cut
    for module in (audit, panel):
        monkeypatch.setattr(module, "cut", lambda df: stored.append(set(df.columns)) or cut(df))
    assert registry.QUERIES["tree_difference"](spark, SMALL).count() == 56
    assert stored == [{"datetime", "instrument", "s", "pos", "close", "volume", "turnover"}]


def test_prices_by_one_number_are_those_by_struct(spark, monkeypatch):
    """First and last lines of a group are found without sorting, unless orders are too far apart for one number."""
    short = fixtures.panel(spark, SMALL)
    assert "SortAggregate" not in plan(short)
    monkeypatch.setattr(fixtures, "MOST_LONG", 1)
    wide = fixtures.panel(spark, SMALL)
    assert "SortAggregate" in plan(wide)
    assert short.exceptAll(wide).isEmpty() and wide.exceptAll(short).isEmpty()


@pytest.mark.parametrize("order", [(-(1 << 62), 1 << 62), (None, 4), (7, 9)])
def test_lines_are_ordered_by_any_keys(spark, order):
    low, high = order
    rows = [(DAY, DAY, low, 2, 3, 10.0), (DAY, DAY, high, 1, 1, 20.0), (DAY + timedelta(days=1), DAY, low, 1, 1, 30.0), (DAY, DAY, high, 1, 2, 40.0)]
    lines = spark.createDataFrame(rows, "d date, week date, o long, l int, p long, px double")
    n, at = fixtures._order(lines, "d", "week", ["o", "l", "p"])
    got = lines.groupBy("week").agg(F.min_by("px", at), F.max_by("px", at)).first()
    assert (n, got[1], got[2]) == (4, 10.0, 30.0)
    assert fixtures._order(lines.limit(0), "d", "week", ["o", "l", "p"])[0] == 0
