"""Hash trees, ledgers under caps, manifests, database extracts and the bootstrap, each with its faults planted."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import folds, ledgers, portfolio, trees
from tideline.session import cut, unique_folder
from tideline.sources import manifest, readers

DAY = date(2020, 1, 6)


def keyed(spark, n=20_000):
    k = F.col("id")
    return spark.range(n).select(F.date_add(F.lit(DAY), (k % 3).cast("int")).alias("datetime"), k.cast("string").alias("instrument"), F.when(k % 13 != 0, k / 7).alias("close"), (k % 11).alias("volume"))


def test_one_altered_cell_is_found_in_one_leaf(spark):
    a = cut(keyed(spark))
    b = cut(a.withColumn("close", F.when(F.col("instrument") == "4321", F.col("close") + 1).otherwise(F.col("close"))))
    depth = trees.depth_for(a, "datetime", leaf=100)
    assert depth == 2
    both = tuple(cut(trees.tree(x, "datetime", "instrument", ["close", "volume"], depth)) for x in (a, b))
    leaves = trees.differing_leaves(*both, "datetime", depth).collect()
    assert len(leaves) == 1
    assert both[0].where(F.col("level") == depth).agg(F.max("n")).first()[0] < 200
    met = trees.placed(a, "instrument", depth).where((F.col("node") == leaves[0].node) & (F.col("datetime") == leaves[0].datetime)).count()
    assert met < 200  # of 20,000 rows these are joined
    got = trees.changed_cells(a, b, both, "datetime", "instrument", ["close", "volume"], depth).collect()
    assert [tuple(r) for r in got] == [(DAY + timedelta(days=4321 % 3), "4321", "close", "617.2857", "618.2857")]


def test_lost_rows_lost_groups_and_missing_values(spark):
    rows = [(DAY, str(k), float(k), k) for k in range(50)] + [(DAY + timedelta(days=1), "only", None, 1)]
    schema = "datetime date, instrument string, close double, volume long"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([r for r in rows if r[1] not in ("7", "only")] + [(DAY, "new", 1.0, None)], schema)
    for depth in (0, 1, 3):
        both = tuple(trees.tree(x, "datetime", "instrument", ["close", "volume"], depth) for x in (a, b))
        got = sorted(tuple(r)[1:] for r in trees.changed_cells(a, b, both, "datetime", "instrument", ["close", "volume"], depth).collect())
        assert got == [("7", "-", "row", None), ("new", "-", None, "row"), ("only", "-", "row", None)]
        same = (both[0], both[0])
        assert trees.changed_cells(a, a, same, "datetime", "instrument", ["close", "volume"], depth).collect() == []
    assert trees.depth_for(a.limit(0), "datetime") == 0 and trees.tree(a.limit(0), "datetime", "instrument", ["close"], 1).collect() == []


def events(spark, rows):
    return spark.createDataFrame(rows, "source_event_id long, event string, evaluation_id string, fit_id string")


def test_a_ledger_commits_once(spark):
    path = unique_folder(spark, "ledger")
    first = events(spark, [(k, "start", f"e{k}", None) for k in range(5)] + [(10, "fit", None, "f10")])
    assert ledgers.append(spark, path, first, 10, 5) == 6
    assert ledgers.append(spark, path, first, 10, 5) == 0
    more = events(spark, [(3, "start", "e3", None), (20, "start", "e20", None), (21, "fit", None, "f21")])
    assert ledgers.append(spark, path, more, 10, 5) == 2
    schema = "source_event_id long, event string, evaluation_id string, fit_id string"
    assert ledgers.read_ledger(spark, path, schema).count() == 8


@pytest.mark.parametrize(
    "row,problem",
    [
        ((3, "other", "e3", None), "conflict"),
        ((30, "start", "e4", None), "repeated_evaluation"),
        ((30, "fit", None, "f10"), "repeated_fit"),
        ((30, "start", "e30", None), "evaluation_cap"),
        ((30, "fit", None, "f30"), "fit_cap"),
    ],
)
def test_a_ledger_refuses_and_stays_as_it_is(spark, row, problem):
    path = unique_folder(spark, "ledger")
    ledgers.append(spark, path, events(spark, [(k, "start", f"e{k}", None) for k in range(5)] + [(10, "fit", None, "f10")]), 5, 1)
    caps = (5, 1) if problem.endswith("cap") else (50, 50)
    with pytest.raises(ValueError, match=problem):
        ledgers.append(spark, path, events(spark, [row]), *caps)
    assert ledgers.read_ledger(spark, path, "source_event_id long, event string, evaluation_id string, fit_id string").count() == 6


def test_a_batch_that_another_took_is_not_overwritten(spark, monkeypatch):
    path = unique_folder(spark, "ledger")
    ledgers.append(spark, path, events(spark, [(1, "start", "e1", None)]), 9, 9)
    own = ledgers.problems

    def late(*args):  # another writer commits between reading and renaming
        events(spark, [(3, "start", "e3", None)]).write.parquet(f"{path}/batch=2")
        return own(*args)

    monkeypatch.setattr(ledgers, "problems", late)
    with pytest.raises(RuntimeError, match="meanwhile"):
        ledgers.append(spark, path, events(spark, [(2, "start", "e2", None)]), 9, 9)
    monkeypatch.undo()
    assert ledgers.append(spark, path, events(spark, [(2, "start", "e2", None)]), 9, 9) == 1
    assert {r[0] for r in ledgers.read_ledger(spark, path, "source_event_id long").collect()} == {1, 2, 3}


def test_running_counts_across_partitions(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("at"), "id")
    got = ledgers.running(rows.withColumn("even", F.col("at") % 2 == 0), ["at"], {"even": "n"})
    assert got.where(F.col("n") != F.floor(F.col("at") / 2) + 1).count() == 0


def matrix(spark):
    return spark.range(900).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("datetime"), F.lit("A").alias("instrument"), F.col("id").cast("double").alias("close"))


COLUMNS = {"datetime": "date", "instrument": "string", "close": "double"}


def test_a_manifest_is_kept_to(spark):
    path = unique_folder(spark, "published")
    manifest.publish(matrix(spark), path)
    rows = manifest.scan(spark, path, [2020, 2021], COLUMNS, "2023-01-01")
    assert rows.count() == 361 + 365 and rows.agg(F.max("datetime")).first()[0] == date(2021, 12, 31)
    assert manifest.scan(spark, path, [2022], COLUMNS, "2023-01-01").count() == 900 - 726
    for years, seal, said in (([], "2023-01-01", "no years"), ([2022], "2022-03-01", "sealed"), ([2019], "2023-01-01", "not in the manifest")):
        with pytest.raises(ValueError, match=said):
            manifest.scan(spark, path, years, COLUMNS, seal)


@pytest.mark.parametrize("fault", ["absent", "more", "rows", "year"])
def test_a_manifest_scan_refuses(spark, fault, tmp_path):
    import shutil
    from pathlib import Path

    path = str(tmp_path / "published")
    manifest.publish(matrix(spark), path)
    folder = Path(path, "data", "year=2021")
    own = next(folder.glob("part-*"))
    if fault == "absent":
        own.unlink()
    elif fault == "more":
        shutil.copy(own, folder / "part-x.parquet")
    else:
        rows = spark.read.parquet(str(own))
        rows = rows.limit(5) if fault == "rows" else rows.withColumn("datetime", F.date_add("datetime", 300))
        rows.coalesce(1).write.parquet(str(tmp_path / "other"))
        for crc in folder.glob(".*.crc"):
            crc.unlink()
        shutil.copy(next((tmp_path / "other").glob("part-*")), own)
    with pytest.raises(ValueError, match={"absent": "missing", "more": "without entry", "rows": "declared", "year": "holds dates"}[fault]):
        manifest.scan(spark, path, [2021], COLUMNS, "2023-01-01")
    assert manifest.scan(spark, path, [2020], COLUMNS, "2023-01-01").count() == 361


def test_a_database_is_read_in_even_ranges(spark):
    """Keys bunch at one end; ranges follow the rows. The embedded database comes with Spark."""
    url, options = "jdbc:derby:memory:extract;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") < 2900, F.col("id") - 1000).otherwise(F.col("id") * 1000).alias("K"), F.col("id").alias("V"))
    rows.coalesce(1).write.jdbc(url, "trades", mode="overwrite", properties=options)
    got = readers.extract_jdbc(spark, url, "trades", "K", 6, options)
    assert sorted(r.V for r in got.collect()) == list(range(3000))
    assert 4 <= got.rdd.getNumPartitions() <= 9
    rows.limit(0).write.jdbc(url, "nothing", mode="overwrite", properties=options)
    with pytest.raises(ValueError, match="no rows"):
        readers.extract_jdbc(spark, url, "nothing", "K", 4, options)


def test_ranges_hold_about_equally_many():
    assert readers.extract_ranges([(k, k + 1, 1) for k in range(10)], 5) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    keys = [*range(900), *range(100_000, 10_000_000, 99_000)]
    count = lambda a, b, width: {k: sum(a + k * width <= x < min(b, a + (k + 1) * width) for x in keys) for k in {(x - a) // width for x in keys if a <= x < b}}
    cells = readers.counted_cells(count, 0, 10_000_001, len(keys) / 8)
    assert sum(n for *_, n in cells) == len(keys) and all(x[1] == y[0] for x, y in zip(cells, cells[1:]))
    ranges = readers.extract_ranges(cells, 8)
    held = [sum(a <= x < b for x in keys) for a, b in ranges]
    assert sum(held) == len(keys) and max(held) <= 2 * len(keys) / 8


@pytest.mark.parametrize("n,length", [(97, 4), (40, 8), (9, 4)])
def test_bootstrap_by_prefix_moments_is_that_of_the_periods(spark, n, length):
    rng = random.Random(n)
    rows = [(k, rng.gauss(0.01, 0.05), rng.gauss(0, 0.04)) for k in range(n)]
    got = portfolio.bootstrap(spark.createDataFrame(rows, "i long, candidate double, benchmark double"), draws=300, length=length, seed=5).first()
    a, b = (np.array([r[k] for r in rows]) for k in (1, 2))
    deltas = []
    for draw in range(300):
        at = np.concatenate([(portfolio.mixed(draw, block, 5, n) + np.arange(length)) % n for block in range(-(-n // length))])[:n]
        deltas.append(sum(s * x[at].mean() / x[at].std(ddof=1) * 52**0.5 for s, x in ((1, a), (-1, b))))
    want = np.quantile(deltas, [0.025, 0.975]) if n >= max(8, 2 * length) else (None, None)
    assert (got.low, got.high) == pytest.approx(tuple(want), rel=1e-9) and got.draws == 300


def test_reasons_begin_with_hard_failures(spark):
    schema = "seed_share double, fold_share double, ci_low double, best_year_share double, stress_ir double, hard_failures array<string>"
    rows = spark.createDataFrame([(1.0, 1.0, -0.1, 0.3, 0.5, ["leak"]), (1.0, 1.0, 0.1, 0.3, 0.5, []), (1.0, 1.0, 0.1, 0.3, 0.5, None)], schema)
    got = [(list(r.reasons), r.decision) for r in portfolio.promotion(rows).collect()]
    assert got == [(["leak", "interval_includes_zero"], "REJECT"), ([], "PROMOTE"), ([], "PROMOTE")]


def test_an_empty_segment_is_an_error(spark):
    f = spark.createDataFrame([("a", DAY, DAY)], "fold_id string, valid_start date, test_start date")
    tagged = spark.createDataFrame([("a", s, DAY, DAY) for s in ("train", "test")], "fold_id string, segment string, datetime date, label_end date")
    with pytest.raises(ValueError, match="valid part of a is empty"):
        folds.require_segments(tagged, f)
    assert folds.require_segments(tagged, f, ("train", "test")).count() == 2
    assert folds.overlapping_labels(tagged, f).select("segment").collect() == [("train",)]


def test_files_are_in_order_and_names_of_times_are_empty(spark, tmp_path):
    rng = random.Random(8)
    keys = [(DAY + timedelta(days=d), f"i{k:02d}") for d in range(30) for k in range(40)]
    rng.shuffle(keys)
    schema = "datetime date, instrument string, feature_name string, feature_value double, vendor_available_time timestamp, label_start_time timestamp"
    from datetime import datetime

    rows = [(d, i, "close", 1.0, datetime(2020, 1, 2, 3, 4, 5) if i != "i00" else None, None) for d, i in keys]
    out = readers.consumed(spark.createDataFrame(rows, schema).repartition(5), ["vendor_available_time", "label_start_time"], "p1", "t0", "t1")
    path = str(tmp_path / "sorted")
    back = readers.write_sorted(out, path, ["datetime", "instrument"])
    assert back.count() == len(rows) and len(back.columns) == len(set(out.columns))
    one = back.where("instrument = 'i00'").first()
    assert (one.vendor_available_time, one.revision_known_time, one.label_start_time, one.calendar_session_id) == ("", "", "", "XSHG_XSHE-")
    assert back.where("instrument = 'i01'").first().vendor_available_time == "2020-01-02T03:04:05" and set(readers.CONSTANTS) <= set(back.columns)
    from pathlib import Path

    import pyarrow.parquet as pq

    files = sorted(Path(path).glob("part-*"))
    got = [k for f in files for k in zip(*(pq.read_table(f).column(c).to_pylist() for c in ("datetime", "instrument")))]
    assert got == sorted(keys)


def test_periods_that_one_side_lacks_are_dropped(spark):
    a = spark.createDataFrame([(DAY + timedelta(days=7 * k), 1.0 * k if k != 2 else None) for k in range(6)], "datetime date, candidate double")
    b = spark.createDataFrame([(DAY + timedelta(days=7 * k), 2.0 * k) for k in (5, 3, 2, 1, 9)], "datetime date, benchmark double")
    assert [(r.i, r.candidate, r.benchmark) for r in portfolio.aligned(a, b).orderBy("i").collect()] == [(0, 1.0, 2.0), (1, 3.0, 6.0), (2, 5.0, 10.0)]
