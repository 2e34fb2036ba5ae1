"""Panel operators on small hand tables and by their properties."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.functions import safe
from tideline.operators import checks, eligibility, features, folds, intervals, metrics, portfolio, state

DAY = date(2020, 1, 6)


def weeks(n):
    return [DAY + timedelta(days=7 * k) for k in range(n)]


def panel(spark, n=80, ids=("A", "B"), flag_at=None):
    rows = []
    for j, i in enumerate(ids):
        for k, d in enumerate(weeks(n)):
            close = 10.0 + j + (k * 7 % 13) / 10
            rows.append((d, i, close - 0.1, close + 0.3, close - 0.4, close, 1000.0 + 37 * (k % 11), 5e4 + k, 0.01 * (k % 5), flag_at == k))
    return spark.createDataFrame(rows, "datetime date, instrument string, open double, high double, low double, close double, volume double, amount double, turnover double, corporate_action boolean")


def test_first_return_is_missing_and_windows_wait(spark):
    rows = {r.datetime: r for r in features.features(panel(spark, ids=("A",))).collect()}
    d = weeks(80)
    assert rows[d[0]].ret_1d is None and rows[d[1]].ret_1d is not None
    assert rows[d[4]].ret_mean_5 is None and rows[d[5]].ret_mean_5 is not None
    assert len(features.FEATURE_COLUMNS) == 50


def test_action_masks_sixty_rows(spark):
    rows = features.features(panel(spark, n=80, ids=("A",), flag_at=10)).orderBy("datetime").collect()
    assert [r.feature_eligible for r in rows] == [True] * 10 + [False] * 60 + [True] * 10
    assert all(rows[20][c] is None for c in features.FEATURE_COLUMNS)


def test_future_change_leaves_the_past(spark):
    p = panel(spark)
    assert checks.future_poison(p, str(weeks(80)[60])).count() == 0
    changed = features.features(p.withColumn("amount", F.lit(1.0))).where(F.col("datetime") > F.lit(weeks(80)[60])).select("log_amount").distinct().count()
    assert changed == 1


def test_constant_column_has_no_correlation(spark):
    flat = panel(spark, ids=("A",)).withColumn("volume", F.lit(5.0))
    assert features.features(flat).where("price_volume_corr_5 is not null").count() == 0


def test_missing_values_stay_missing(spark):
    row = spark.sql("select double('nan') a, double('inf') b, cast(null as double) c, 0.0d z, 1.0d one").select(
        safe.finite(F.col("a")).alias("a"), safe.finite(F.col("b")).alias("b"), safe.at_least(F.col("c"), 0.0).alias("c"), safe.ratio(F.col("one"), F.col("z")).alias("d"), safe.holds(F.col("c") > 0).alias("e")
    ).first()
    assert tuple(row) == (None, None, None, None, False)


def test_state_hand_table(spark):
    rows = [(DAY, "a", True, 0.01, 0.1, 1.0, 0.3), (DAY, "b", True, 0.03, 0.2, -1.0, 0.4), (DAY, "c", True, 0.02, 0.4, -1.0, 0.5), (DAY, "d", False, 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, feature_eligible boolean, ret_mean_20 double, ret_std_20 double, ret_1d double, turnover_mean_20 double")
    got = state.daily_state(state.population(df)).first()
    assert (got.mkt_trend_20, got.mkt_vol_20, got.mkt_breadth_1d, got.mkt_turnover_20, got.population_count) == (pytest.approx(0.02), 0.2, pytest.approx(1 / 3), 0.4, 3)
    other = state.daily_state(state.population(df.orderBy(F.desc("instrument")))).first()
    assert other.population_keyset_sha256 == got.population_keyset_sha256


def test_membership_end_counts_only_if_announced(spark):
    rows = spark.createDataFrame([(date(2020, 6, 1), "A"), (date(2020, 6, 1), "B"), (date(2020, 1, 1), "A")], "datetime date, instrument string")
    m = spark.createDataFrame(
        [("A", date(2020, 1, 5), date(2020, 2, 1), date(2020, 5, 1), None), ("B", date(2020, 1, 5), date(2020, 2, 1), date(2020, 5, 1), date(2020, 4, 1)), ("A", date(2022, 1, 1), date(2020, 1, 1), None, None)],
        "instrument string, pub date, eff_from date, eff_to date, out_pub date",
    )
    got = {(r.instrument, r.datetime.month): r.universe_member for r in intervals.membership_asof(rows, m, "2021-01-01").collect()}
    assert got == {("A", 6): True, ("B", 6): False, ("A", 1): False}


def test_status_is_as_known(spark):
    rows = spark.createDataFrame([(date(2020, 3, k), "A") for k in (1, 10, 20)], "datetime date, instrument string")
    e = spark.createDataFrame(
        [("A", "*ST x", date(2020, 3, 1), date(2020, 3, 10)), ("A", "plain", date(2020, 3, 15), date(2020, 3, 12)), ("A", "z", date(2020, 3, 20), None)], "instrument string, name string, effective date, publish date"
    )
    got = sorted((r.datetime.day, r.special_status_forbidden, r.special_status_unknown) for r in intervals.status_asof(rows, e).collect())
    assert got == [(1, False, False), (10, True, False), (20, False, True)]


def test_labels_need_the_sessions_rows(spark):
    p = panel(spark, n=10, ids=("A",)).where(F.col("datetime") != F.lit(weeks(10)[6]))
    calendar = spark.createDataFrame([(d, k + 1) for k, d in enumerate(weeks(10))], "session date, pos int")
    got = {r.datetime: r for r in intervals.labels(intervals.label_schedule(p, calendar), p).collect()}
    d = weeks(10)
    assert got[d[0]].label == pytest.approx(got[d[0]].label_close / got[d[0]].label_open - 1)
    assert got[d[1]].label is None and got[d[1]].label_end == d[6]
    assert got[d[5]].label_start is None


def test_first_reason_adds_up(spark):
    rows = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, True), (4, True, True)], "k int, a boolean, b boolean")
    found = eligibility.first_reason(rows, (("not_a", "not a"), ("not_b", "not b")))
    assert {r.k: r.reason for r in found.collect()} == {1: "not_b", 2: "not_a", 3: None, 4: None}
    assert sum(r["rows"] for r in eligibility.reason_counts(found).collect()) == 4


def test_rank_ic_ties_and_constants(spark):
    rows = [(DAY, f"i{k}", s, y) for k, (s, y) in enumerate([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 4.0)])] + [(DAY + timedelta(1), f"i{k}", 1.0, float(k)) for k in range(4)]
    got = {r.datetime: r.rank_ic for r in metrics.rank_ic(spark.createDataFrame(rows, "datetime date, instrument string, score double, label double")).collect()}
    assert got[DAY] == pytest.approx(0.9486832980505138) and got[DAY + timedelta(1)] is None


def test_folds_and_purge(spark):
    f = folds.annual_folds(spark, 2012, 2018, 2020, 5)
    first = f.orderBy("fold_id").first()
    assert (first.fold_id, str(first.train_start), str(first.train_end), str(first.valid_start), str(first.test_end)) == ("wf_2018", "2012-01-01", "2016-12-31", "2017-01-01", "2018-12-31")
    days = [date(2016, 12, 1) + timedelta(days=7 * k) for k in range(120)]
    calendar = spark.createDataFrame([(d, k + 1) for k, d in enumerate(days)], "session date, pos int")
    rows = spark.createDataFrame([(d, "A", d + timedelta(days=35)) for d in days], "datetime date, instrument string, label_end date")
    tagged = folds.purged_segments(rows, folds.embargoed(f.where("fold_id = 'wf_2018'"), calendar, 5))
    got = {r.segment: (r.lo, r.hi) for r in tagged.groupBy("segment").agg(F.min("datetime").alias("lo"), F.max("label_end").alias("hi")).collect()}
    assert "train" not in got and got["valid"][1] < date(2018, 1, 1) and got["test"][0] >= date(2018, 1, 1) + timedelta(days=28)
    assert folds.overlapping_keys(tagged).count() == 0


def events(spark):
    rows = [(DAY + timedelta(days=k), f"u{i:02d}", float((i * 7 + k * 3) % 19), 0.001 * ((i + k) % 5), 1e6 if i % 3 else None, i % 4 != 0) for k in range(21) for i in range(20)]
    return spark.createDataFrame(rows, "datetime date, instrument string, score double, forward_return double, adv20 double, tradable boolean")


def test_portfolio_invariants(spark):
    df = events(spark)
    held = portfolio.holdings(df, 0.1, 0.05, 0.1, 1e7)
    assert held.where("weight > 0.05 or weight < 0").count() == 0
    ledger = portfolio.weekly_ledger(df).collect()
    assert len(ledger) == 4 and all(r.cost >= 0 and r.net <= r.gross and r.invested <= 1 for r in ledger)
    assert [r.datetime.weekday() for r in sorted(ledger, key=lambda r: r.ordinal)] == [4, 4, 4, 6]


def test_untradable_week_sells_everything(spark):
    df = events(spark)
    last = df.agg(F.max("datetime")).first()[0]
    off = df.withColumn("tradable", F.col("tradable") & (F.col("datetime") < F.lit(last - timedelta(days=1))))
    rows = sorted(portfolio.weekly_ledger(off).collect(), key=lambda r: r.ordinal)
    assert rows[-1].names == 0 and rows[-1].turnover == pytest.approx(rows[-2].invested)


def test_bootstrap_of_a_shift_is_above_zero(spark):
    rows = [(k, 0.01 * ((k * 37 % 21) - 10) / 10 + 0.004, 0.01 * ((k * 37 % 21) - 10) / 10) for k in range(120)]
    got = portfolio.bootstrap(spark.createDataFrame(rows, "i long, candidate double, benchmark double")).first()
    assert got.low > 0 and got.low <= got.point <= got.high
    few = portfolio.bootstrap(spark.createDataFrame(rows[:7], "i long, candidate double, benchmark double")).first()
    assert few.low is None


def test_reference_bootstrap_has_its_draws_and_blocks(spark):
    from pathlib import Path

    import duckdb
    import numpy as np

    import __spark_entry__
    from tideline.plans import panel as plans

    got = __spark_entry__.queries()["bootstrap_ci_reference"](spark, __spark_entry__.SMALL).first()
    db = duckdb.connect()
    for path in Path(__spark_entry__.SMALL).glob("*.parquet"):
        db.sql(f"create view {path.stem} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    assert tuple(got) == pytest.approx(db.sql(__spark_entry__.oracle_sql()["bootstrap_ci_reference"]).fetchall()[0], abs=2e-5)
    rows = plans._pairs(plans.Inputs(spark, __spark_entry__.SMALL)).orderBy("i").toPandas()
    n, deltas = len(rows), []
    for draw in range(2000):
        starts = [portfolio.mixed(draw, block, 7, n) for block in range(-(-n // 4))]
        at = np.concatenate([(s + np.arange(4)) % n for s in starts])[:n]
        a, b = (rows[c].to_numpy()[at] for c in ("candidate", "benchmark"))
        deltas.append((a.mean() / a.std(ddof=1) - b.mean() / b.std(ddof=1)) * 52**0.5)
    assert got.draws == 2000 and (got.low, got.high) == pytest.approx(tuple(np.quantile(deltas, [0.025, 0.975])), abs=2e-5)


def test_promotion_paths(spark):
    cols = "seed_share double, fold_share double, ci_low double, best_year_share double, stress_ir double, hard_failures int"
    rows = [(1.0, 1.0, 0.1, 0.3, 0.5, 0), (1.0, 1.0, -0.1, 0.3, 0.5, 0), (0.4, 1.0, 0.1, 0.3, 0.5, 0), (1.0, 1.0, 0.1, 0.3, 0.5, 2)]
    got = [r.decision for r in portfolio.promotion(spark.createDataFrame(rows, cols)).collect()]
    assert sorted(got) == sorted(["PROMOTE", "HOLD", "REJECT", "REJECT"])


def test_peer_context_ignores_order_and_other_dates(spark):
    from tideline.operators.peers import peer_context

    anchors = spark.createDataFrame([(k, *[((7 * k + 3 * j) % 11 - 5) / 5.0 for j in range(2)]) for k in range(4)], "k long, w0 double, w1 double")
    rows = [(DAY, f"i{k}", k / 5, 1 - k / 7) for k in range(5)]
    cols = "datetime date, instrument string, h0 double, h1 double"
    one = {r.instrument: (r.c0, r.c1) for r in peer_context(spark.createDataFrame(rows, cols), anchors, 2).collect()}
    more = [*rows[::-1], (DAY + timedelta(1), "x", 9.0, 9.0)]
    two = {r.instrument: (r.c0, r.c1) for r in peer_context(spark.createDataFrame(more, cols), anchors, 2).where(F.col("datetime") == F.lit(DAY)).collect()}
    assert all(one[k] == pytest.approx(two[k]) for k in one)


def test_models_take_all_features():
    from tideline.operators import scoring

    assert scoring.MODEL_FEATURES == scoring.PEER_FEATURES == features.FEATURE_COLUMNS


def test_trees_end_by_validation_with_patience(spark):
    from tideline.operators import scoring

    assert scoring.best_round([5, 3, 4, 2, 4, 4, 1], 2) == (4, True) and scoring.best_round([5, 3, 2], 2) == (3, False)
    rows = [(k % 2 == 0, float(k * 37 % 101), float(k * 53 % 97), float(k * 37 % 101) + 0.5 * (k * 53 % 97)) for k in range(600)]
    df = spark.createDataFrame(rows, "t boolean, a double, b double, label double").coalesce(2)
    model = scoring.fit_trees(df.where("t"), df.where("not t"), ("a", "b"), rounds=40, patience=10)
    assert model.getNumTrees > 10


def test_peer_forward_needs_no_whole_date(spark):
    import numpy as np

    from tideline.operators import scoring

    rows = [(DAY + timedelta(k % 2), f"i{k:02d}", k % 7 / 7, 1 - k % 5 / 4, k % 3 - 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, a double, b double, c double").repartition(5)
    out = scoring.peer_forward(df, ("a", "b", "c"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = {r.instrument: r.score for r in out.collect()}
    w, soft = scoring.weights(3, 8, 2), lambda x: np.exp(x) / np.exp(x).sum(1, keepdims=True)
    for day in range(2):
        mine = [r for r in rows if r[0] == DAY + timedelta(day)]
        h = np.tanh(np.array([r[2:] for r in mine]) @ w["encode"])
        a = soft(h @ w["assign"])
        p = (a.T @ h) / a.sum(0)[:, None]
        seen = [soft((h @ w["query"][:, at]) @ (p @ w["key"][:, at]).T / 3**0.5) @ (p @ w["value"][:, at]) for at in (slice(0, 3), slice(3, 6))]
        want = np.concatenate([h, h - np.concatenate(seen, 1)], 1) @ w["out"]
        assert [got[r[1]] for r in mine] == pytest.approx(list(want))
    assert len(got) == 40


def test_names_without_a_return_are_not_bought(spark):
    rows = [(DAY, f"i{k}", 10.0 - k, None if k < 2 else 0.01 * k, True, 1e9) for k in range(6)] + [(DAY, "x", 99.0, 0.5, False, 1e9), (DAY, "y", None, 0.5, True, 1e9)]
    df = spark.createDataFrame(rows, "datetime date, instrument string, score double, forward_return double, tradable boolean, adv20 double")
    got = portfolio.top_fraction(df, 0.5).orderBy("r").collect()
    assert [(r.instrument, r.k) for r in got] == [("i2", 2), ("i3", 2)]
    ledger = portfolio.weekly_ledger(df, fraction=0.5, cap=1.0).first()
    assert ledger.names == 2 and ledger.gross == pytest.approx(0.5 * 0.02 + 0.5 * 0.03)


def test_a_total_loss_is_a_drawdown_of_one(spark):
    rows = spark.createDataFrame([(d, "s", r) for d, r in zip(weeks(4), [0.1, -1.0, 0.2, None], strict=True)], "datetime date, series string, net double")
    got = metrics.wealth(rows, "net").orderBy("datetime").collect()
    assert [r.wealth for r in got] == pytest.approx([1.1, 0.0, 0.0, 0.0]) and [r.drawdown for r in got] == pytest.approx([0.0, -1.0, -1.0, -1.0])


def test_state_needs_all_seven_flags(spark):
    sources = "0.01d ret_mean_20, 0.1d ret_std_20, 1.0d ret_1d, 0.3d turnover_mean_20"
    flags = {c: "true" for c in state.REQUIRED} | {c: "false" for c in state.REFUSED}
    row = lambda f: spark.sql(f"select date'2020-01-06' datetime, 'a' instrument, {sources}, {', '.join(f'{v} {c}' for c, v in f.items())}")
    assert state.state_population(row(flags)).count() == 1
    for c, v in flags.items():
        assert state.state_population(row(flags | {c: "false" if v == "true" else "true"})).count() == 0
        assert state.state_population(row(flags | {c: "cast(null as boolean)"})).count() == 0
        with pytest.raises(ValueError, match=c):
            state.state_population(row({k: x for k, x in flags.items() if k != c}))


def test_active_until_delisted(spark):
    rows = spark.createDataFrame([(date(2020, 3, k), i) for k in (1, 10) for i in "ABC"], "datetime date, instrument string")
    master = spark.createDataFrame([("A", None), ("B", date(2020, 3, 10))], "instrument string, delist_date date")
    got = {(r.instrument, r.datetime.day) for r in intervals.is_active(rows, master).where("is_active").collect()}
    assert got == {("A", 1), ("A", 10), ("B", 1)}


def test_a_leaking_feature_is_found(spark):
    p = panel(spark)
    leak = lambda rows: rows.withColumn("ahead", F.lead("amount").over(features.history()))
    got = checks.future_poison(p, str(weeks(80)[60]), build=leak, columns=("ahead",)).collect()
    assert {(r.instrument, r.datetime, r.changed) for r in got} == {(i, weeks(80)[60], 1) for i in "AB"}


def test_folds_follow_the_calendar(spark):
    days = [date(2012, 1, 2) + timedelta(days=30 * k) for k in range(12 * 9)]
    calendar = spark.createDataFrame([(d, k + 1) for k, d in enumerate(days)], "session date, pos int")
    got = sorted(tuple(r) for r in folds.calendar_folds(calendar, 5, wait=6, seal=2020).collect())
    assert got == sorted(tuple(r) for r in folds.annual_folds(spark, 2012, 2018, 2019, 5).collect())


def test_contract_readers_refuse(spark, tmp_path):
    from tideline.operators import contracts
    from tideline.sources import readers

    def calendar(name, ids):
        path = str(tmp_path / name)
        spark.createDataFrame([(i,) for i in ids], "session_id string").coalesce(1).write.option("header", True).csv(path)
        return contracts.read_calendar(spark, path, "session_id string", "2021-01-01")

    p = contracts.PREFIX
    assert [str(r.session) for r in calendar("good", [f"{p}2020-01-02", f"{p}2020-01-03"]).collect()] == ["2020-01-02", "2020-01-03"]
    for name, ids, why in (("none", [], "empty"), ("twice", [f"{p}2020-01-02"] * 2, "repeated"), ("back", [f"{p}2020-01-03", f"{p}2020-01-02"], "ascending"), ("late", [f"{p}2021-01-02"], "sealed")):
        with pytest.raises(ValueError, match=why):
            calendar(name, ids)
    with pytest.raises(ValueError, match="2 times"):
        contracts.attach_one(spark.sql("select 'a' k"), spark.sql("select 'a' k, 1 v union all select 'a', 2"), "k")

    columns = {"datetime": "date", "instrument": "string", "close": "double"}
    own = panel(spark, n=60).select(*columns)
    years = own.groupBy(F.year("datetime").alias("year")).agg(F.count("*").alias("rows"))
    bound = lambda name, rows, declared=years: (readers.write_years(rows, str(tmp_path / name)), contracts.read_bound(spark, str(tmp_path / name), [2020], columns, declared, 2030))[1]
    assert bound("sound", own).count() == own.where("year(datetime) = 2020").count()
    with pytest.raises(ValueError, match="declared"):
        bound("short", own.where("instrument = 'A'"))
    with pytest.raises(ValueError, match="missing"):
        bound("gaps", own.withColumn("close", F.when(F.col("instrument") == "A", F.col("close"))))
    with pytest.raises(ValueError, match="repeated"):
        bound("again", own.withColumn("instrument", F.lit("A")))
    with pytest.raises(ValueError, match="sealed"):
        contracts.read_bound(spark, str(tmp_path / "sound"), [2031], columns, years, 2030)


def test_shared_folder_is_asked_for_off_a_local_master(spark, monkeypatch):
    from tideline import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)


def test_union_of_scores_refuses_repeats_and_gaps(spark, tmp_path):
    from tideline.operators import contracts

    part = lambda *rows: spark.createDataFrame([(DAY, *r) for r in rows], "datetime date, instrument string, score double")
    assert contracts.union_scores([part(("a", 1.0)), part(("b", 2.0))], str(tmp_path / "sound")).count() == 2
    for name, rows, why in (("twice", (("a", 2.0),), "twice"), ("none", (("b", None),), "finite"), ("far", (("b", float("inf")),), "finite"), ("nan", (("b", float("nan")),), "finite")):
        with pytest.raises(ValueError, match=why):
            contracts.union_scores([part(("a", 1.0)), part(*rows)], str(tmp_path / name))


def test_weights_from_a_table(spark):
    from tideline.operators import scoring
    from tideline.sources.fixtures import view

    w = scoring.weights_from(view(spark, "/root/testdata/sf0.001", "peer_weights"))
    assert {k: v.shape for k, v in w.items()} == {k: v.shape for k, v in scoring.weights(50, 8, 2).items()}
    cells = lambda *rows: spark.createDataFrame(rows, "name string, r long, c long, value double")
    assert scoring.weights_from(cells(("a", 0, 1, 2.0), ("a", 0, 0, 1.0)))["a"].tolist() == [[1.0, 2.0]]
    for rows, why in (((("a", 0, 1, 2.0),), "gaps"), ((("a", 0, 0, 2.0),) * 2, "twice")):
        with pytest.raises(ValueError, match=why):
            scoring.weights_from(cells(*rows))
    with pytest.raises(ValueError, match="at most"):
        scoring.weights_from(cells(("a", 0, 0, 1.0), ("a", 0, 1, 1.0)), limit=1)
