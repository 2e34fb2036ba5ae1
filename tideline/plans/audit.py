"""Queries of sources, profiles, set operations, checks, event ledger and scoring, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import safe
from tideline.operators import checks, contracts, eligibility, folds, intervals, ledgers, network, portfolio, profiles, scoring, state, trees, walkforward
from tideline.operators.features import daily as features_daily
from tideline.operators.features import FEATURE_COLUMNS, features, history
from tideline.plans import oracles
from tideline.plans.panel import _STATE, CUTOFF, KEYS, Inputs, _q, _standing, _state, rounded
from tideline.plans.registry import query
from tideline.session import broadcast_if_small, cut, partitions_for, unique_folder
from tideline.sources import manifest, readers

ZONE = "Asia/Shanghai"

# Sources


@query(oracles.sql("select datetime, instrument, close from panel where datetime >= date '1996-01-01' and datetime < date '1999-01-01'", "panel"))
def scan_years(x: Inputs) -> DataFrame:
    """Published by year under a manifest; three years are scanned by it."""
    path = unique_folder(x.spark, "published")
    manifest.publish(x.panel.select(*KEYS, "close", "volume"), path)
    return manifest.scan(x.spark, path, [1996, 1997, 1998], {"datetime": "date", "instrument": "string", "close": "double"}, "2002-01-01")


@query(oracles.sql("select year(datetime)::int \"year\", count(*) \"rows\", min(datetime) first, max(datetime) last from panel group by 1", "panel"))
def manifest_rows(x: Inputs) -> DataFrame:
    """What the manifest says of each year's files, as the files tell it."""
    files = manifest.publish(x.panel.select(*KEYS, "close"), unique_folder(x.spark, "published"))
    return files.groupBy("year").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


@query(oracles.sql("select t.fold_id, datetime, instrument, segment from tagged t join folds f on f.fold_id = t.fold_id where case segment when 'train' then label_end + case when s % 17 = 3 and pos % 10 = 1 then 900 else 0 end >= valid_start when 'valid' then label_end >= test_start else false end", "folds"))
def q_label_overlap(x: Inputs) -> DataFrame:
    """Rows whose label reaches into a later part of their fold; planted: some training labels end 900 days later."""
    late = (F.col("segment") == "train") & (F.col("s") % 17 == 3) & (F.col("pos") % 10 == 1)
    rows = x.tagged().withColumn("label_end", F.when(late, F.date_add("label_end", 900)).otherwise(F.col("label_end")))
    return folds.overlapping_labels(rows, x.folds()).select("fold_id", *KEYS, "segment")


@query("select l_orderkey, l_partkey, l_quantity from lineitem where l_suppkey = 3 and l_shipdate < timestamp '1997-01-01'")
def scan_filtered(x: Inputs) -> DataFrame:
    rows = x.spark.read.parquet(f"{x.dir}/lineitem.parquet")
    return rows.where((F.col("l_suppkey") == 3) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_partkey", "l_quantity")


@query(oracles.sql("select instrument, effective, name from status_event where effective < date '1998-01-01'", "status_event"))
def asof_cut(x: Inputs) -> DataFrame:
    return readers.before(x.status_event, "effective", "1998-01-01").select("instrument", "effective", "name")


@query(oracles.sql("select m.instrument, m.list_date from master m where m.instrument in (select instrument from membership where index_id = 'IDX1')", "master", "membership"))
def snapshot_semijoin(x: Inputs) -> DataFrame:
    ids = x.membership.where("index_id = 'IDX1'").select("instrument")
    return x.master.join(ids, "instrument", "left_semi").select("instrument", "list_date")


@query(oracles.sql("select instrument, ordinal, start_day, end_day from halt where start_day <= date '1997-12-31' and (end_day is null or end_day >= date '1997-01-01')", "halt"))
def snapshot_halt_overlap(x: Inputs) -> DataFrame:
    return x.halt.where("start_day <= date '1997-12-31' and (end_day is null or end_day >= date '1997-01-01')")


@query(oracles.sql("select year(datetime)::int \"year\", count(*) \"rows\" from panel group by 1", "panel"))
def matrix_sink(x: Inputs) -> DataFrame:
    return readers.write_years(x.panel, unique_folder(x.spark, "matrix-years"))


@query(oracles.sql("select 'S' || strftime(session, '%Y%m%d') session_id, session, session::timestamp + interval 90 minute open_utc, session::timestamp + interval 7 hour close_utc from calendar", "calendar"))
def calendar_rows(x: Inputs) -> DataFrame:
    s = F.col("session")
    ntz = lambda clock: safe.local_timestamp(s, clock, ZONE).cast("timestamp_ntz")
    return x.calendar.select(F.concat(F.lit("S"), F.date_format(s, "yyyyMMdd")).alias("session_id"), "session", ntz("09:30:00").alias("open_utc"), ntz("15:00:00").alias("close_utc"))


@query(oracles.sql("select session, strftime(session::timestamp + interval 90 minute, '%Y-%m-%dT%H:%M:%S.000000Z') iso, session local_day from calendar", "calendar"))
def local_clock(x: Inputs) -> DataFrame:
    at = safe.local_timestamp(F.col("session"), "09:30:00", ZONE)
    return x.calendar.select("session", safe.iso(at).alias("iso"), safe.local_day(at, ZONE).alias("local_day"))


@query("select event_id, try_cast(t as double) number, try_cast(t as date) as_day from (select event_id, case event_id % 3 when 0 then event_type when 1 then (event_id % 900 + 100)::varchar else '2001-02-' || lpad((event_id % 31 + 1)::varchar, 2, '0') end t from events)")
def coercion(x: Inputs) -> DataFrame:
    """Words, numbers and days, some of which no February has."""
    rows = x.spark.read.parquet(f"{x.dir}/events.parquet")
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.col("event_type")).when(n % 3 == 1, (n % 900 + 100).cast("string")).otherwise(F.concat(F.lit("2001-02-"), F.lpad((n % 31 + 1).cast("string"), 2, "0")))
    return rows.select("event_id", safe.number(text).alias("number"), safe.day(text).alias("as_day"))


_LONG = ("ret_1d", "close_location", "log_volume", "turnover_raw")


def _long(x: Inputs) -> DataFrame:
    return readers.unpivot_long(features(x.panel, ()).select(*KEYS, *_LONG), list(KEYS), list(_LONG))


_LONG_SQL = " union all ".join(f"select datetime, instrument, '{c}' feature_name, {c} feature_value from feats" for c in _LONG)


@query(oracles.sql(f"select datetime, instrument, feature_name, {_q('feature_value', 4)} feature_value from ({_LONG_SQL})", "features"))
def unpivot_long(x: Inputs) -> DataFrame:
    return rounded(_long(x), 4, "feature_value")


@query(oracles.sql(f"select instrument || ':' || strftime(datetime, '%Y%m%d') || ':' || feature_name row_id, 'rev:' || instrument || ':' || strftime(datetime, '%Y%m%d') revision_id, 'S' || strftime(datetime, '%Y%m%d') calendar_session_id, 'RAW' adjustment_mode, '' adjustment_time from ({_LONG_SQL})", "features"))
def row_keys(x: Inputs) -> DataFrame:
    return readers.row_keys(_long(x)).select("row_id", "revision_id", "calendar_session_id", "adjustment_mode", "adjustment_time")


@query(oracles.sql(f"select datetime, instrument, sha256(instrument || ':' || strftime(datetime, '%Y%m%d')) sample_id, {_q('close', 4)} as \"close\", volume from panel", "panel"))
def json_roundtrip(x: Inputs) -> DataFrame:
    return rounded(readers.json_round_trip(x.panel), 4, "close")


@query(oracles.sql(f"select datetime, instrument, feature_name, {_q('feature_value', 4)} feature_value from ({_LONG_SQL})", "features"))
def csv_long_sink(x: Inputs) -> DataFrame:
    return rounded(readers.csv_round_trip(_long(x), "long"), 4, "feature_value")


@query(oracles.sql("select * from journal", "journal"))
def jsonl_scan(x: Inputs) -> DataFrame:
    path = unique_folder(x.spark, "journal-json")
    x.journal.write.json(path)
    return x.spark.read.schema(x.journal.schema).option("mode", "FAILFAST").json(path)


_FS = "fs as (select s.datetime, s.instrument, s.score, t.fold_id from scores s join tagged t on t.instrument = s.instrument and t.datetime = s.datetime and t.segment = 'test' where s.score is not null)"
oracles.PARTS["fold_scores"] = ((), ("scores", "folds"), _FS)


def _fold_scores(x: Inputs) -> DataFrame:
    rows = x.scores().where("score is not null")
    ranges = folds.embargoed(x.folds(), x.calendar, 5)
    rows = folds.purged_segments(rows, ranges).where("segment = 'test'").select(*KEYS, "score", "fold_id")
    return rows.withColumn("model_id", F.lit("mean_reversion"))


@query(oracles.sql(f"select datetime, instrument, {_q('score', 4)} score, fold_id, 'mean_reversion' model_id from fs where fold_id = 'wf_2000'", "fold_scores"))
def fold_scores(x: Inputs) -> DataFrame:
    return rounded(_fold_scores(x).where("fold_id = 'wf_2000' and model_id = 'mean_reversion'"), 4, "score")


@query(oracles.sql(f"select datetime, instrument, {_q('score', 4)} score, fold_id from fs", "fold_scores"))
def fold_union(x: Inputs) -> DataFrame:
    rows = cut(_fold_scores(x.store("panel", "calendar")).drop("model_id"))
    parts = [rows.where(F.col("fold_id") == f"wf_{y}") for y in (1999, 2000, 2001)]
    return rounded(contracts.union_scores(parts, unique_folder(x.spark, "fold-scores")), 4, "score")


# Profiles


@query(oracles.sql("select count(*) \"rows\", count(distinct instrument) ids, count(distinct exchange || ':' || instrument) tickers, min(list_date) first_list, max(list_date) last_list, count(delist_date) delisted from master", "master"))
def profile_security(x: Inputs) -> DataFrame:
    return profiles.security_profile(x.master)


@query(oracles.sql("select exchange, min(session) \"first\", max(session) \"last\", count_if(is_open)::bigint open_days, count(*) \"rows\" from exchange_calendar group by exchange", "exchange_calendar"))
def profile_calendar(x: Inputs) -> DataFrame:
    return profiles.calendar_profile(x.exchange_calendar)


@query(oracles.sql("select min(datetime) \"first\", max(datetime) \"last\", count(*) \"rows\", count(distinct instrument) ids, count_if(limit_up is null or limit_down is null)::bigint missing from limits", "limits"))
def profile_limits(x: Inputs) -> DataFrame:
    return profiles.limit_profile(x.limits)


@query(oracles.sql("select min(start_day) \"first\", max(start_day) \"last\", count(*) \"rows\", count_if(start_day is null)::bigint missing_start, count_if(end_day is null)::bigint open_ended from halt", "halt"))
def profile_halts(x: Inputs) -> DataFrame:
    return profiles.halt_profile(x.halt)


_ST = {"rows": "true", "missing_publish": "publish is null", "late": "publish > effective", "early": "publish < effective", "same_day": "publish = effective"}


@query(oracles.sql("select " + ", ".join(f"count_if({c})::bigint \"{k}\", count_if({c} and effective between date '1996-01-01' and date '1998-12-31')::bigint {k}_inside" for k, c in _ST.items()) + " from status_event", "status_event"))
def profile_status(x: Inputs) -> DataFrame:
    return profiles.status_profile(x.status_event, "1996-01-01", "1998-12-31")


@query(oracles.sql("select name, count(*) \"rows\" from status_event group by name", "status_event"))
def status_histogram(x: Inputs) -> DataFrame:
    return profiles.histogram(x.status_event, "name")


@query(oracles.sql("select instrument, effective, publish from status_event where publish is null or publish > effective", "status_event"))
def clock_anomalies(x: Inputs) -> DataFrame:
    return x.status_event.where("publish is null or publish > effective").select("instrument", "effective", "publish")


@query(oracles.sql("select min(action_date) \"first\", max(action_date) \"last\", count(*) \"rows\", count(distinct instrument) ids, count(distinct (instrument, action_date)) distinct_rows from action", "action"))
def profile_actions(x: Inputs) -> DataFrame:
    return profiles.action_profile(x.action)


@query(oracles.sql("select index_id, count(*) \"rows\", count_if(eff_to is null)::bigint open, count_if(pub is null)::bigint missing_pub, count_if(pub > eff_from)::bigint late_in, count_if(eff_to is not null and out_pub is null)::bigint missing_out_pub, count_if(out_pub > eff_to)::bigint late_out, min(datediff('day', pub, eff_from))::int least_lead, max(datediff('day', pub, eff_from))::int most_lead from membership group by index_id", "membership"))
def membership_clock(x: Inputs) -> DataFrame:
    return profiles.membership_clock(x.membership)


@query(oracles.sql("select index_id, year(eff_from)::int \"year\", count(*) additions, count_if(out_pub is null)::bigint missing_out_pub, count_if(pub > eff_from)::bigint late from membership group by 1, 2", "membership"))
def yearly_coverage(x: Inputs) -> DataFrame:
    return profiles.yearly_coverage(x.membership)


@query(oracles.sql("select index_id, count(*) \"rows\", min(eff_from) first_in, max(eff_from) last_in, min(eff_to) first_out, max(eff_to) last_out, count_if(eff_to is null)::bigint open, count(distinct instrument) members from membership group by index_id", "membership"))
def interval_summary(x: Inputs) -> DataFrame:
    return profiles.interval_summary(x.membership)


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1 order by n desc, 1, 2 limit 200")
def duplicate_keys(x: Inputs) -> DataFrame:
    return profiles.duplicate_keys(x.spark.read.parquet(f"{x.dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(oracles.sql("select min(publish) \"first\", max(publish) \"last\", count(publish) \"rows\" from status_event", "status_event"))
def date_bounds(x: Inputs) -> DataFrame:
    return profiles.date_bounds(x.status_event, "publish")


@query(oracles.sql("select enough, dated, started, case when enough and dated and started then 'CANDIDATE' else 'REJECTED' end status from (select count(*) >= 10 enough, count(start_day) = count(*) dated, min(start_day) < date '1996-01-01' started from halt)", "halt"))
def source_verdict(x: Inputs) -> DataFrame:
    return profiles.verdict(profiles.halt_profile(x.halt), {"enough": "rows >= 10", "dated": "missing_start = 0", "started": "first < date '1996-01-01'"})


@query(oracles.sql("select instrument, count_if(datetime <= date '1998-06-01')::bigint rows_before, max(case when datetime <= date '1998-06-01' then datetime end) last_before, min(case when datetime >= date '1998-09-01' then datetime end) first_after from panel group by instrument having rows_before > 0 and first_after is not null order by rows_before desc, instrument limit 1", "panel"))
def pick_instrument(x: Inputs) -> DataFrame:
    return profiles.pick_instrument(x.panel, "1998-06-01", "1998-09-01")


@query(oracles.sql("select a.session, a.is_open open_a, b.is_open open_b from exchange_calendar a join exchange_calendar b on a.session = b.session and a.exchange = 'A' and b.exchange = 'B' where a.is_open <> b.is_open", "exchange_calendar"))
def calendar_mismatch(x: Inputs) -> DataFrame:
    return profiles.calendar_mismatch(x.exchange_calendar)


@query(oracles.sql("select a.instrument, a.eff_from, a.eff_to from membership a where a.index_id = 'IDX0' and exists (select 1 from membership b where b.index_id = 'IDX0' and b.instrument = a.instrument and b.eff_to is not distinct from a.eff_to)", "membership"))
def interval_nullsafe(x: Inputs) -> DataFrame:
    m = x.membership.where("index_id = 'IDX0'").select("instrument", "eff_from", "eff_to")
    other = x.membership.where("index_id = 'IDX0'").select("instrument", "eff_to")
    return profiles.nullsafe_interval_rows(m, other, ["instrument", "eff_to"])


@query(oracles.sql("select instrument, effective, name from (select *, row_number() over (partition by instrument order by effective desc, name desc) r from status_event) where r = 1", "status_event"))
def lookup_latest(x: Inputs) -> DataFrame:
    return profiles.lookup_latest(x.status_event, "instrument", ["effective"], ["name"])


@query(oracles.sql("select instrument, datetime, close left_value, case when s % 7 = 0 then close + 1e-12::double else close end right_value from panel where s % 7 = 0 and close + 1e-12::double <> close", "panel"))
def replay_diff(x: Inputs) -> DataFrame:
    again = x.panel.withColumn("close", F.when(F.col("s") % 7 == 0, F.col("close") + 1e-12).otherwise(F.col("close")))
    return profiles.replay_differences(x.panel, again, ["instrument", "datetime"], "close")


@query(oracles.sql("select (select count(*) from (select distinct instrument from membership intersect select instrument from master where asset_class = 'E')) common, (select count(*) from (select instrument from master except select instrument from membership where index_id = 'IDX1')) missing, (select count(*) from (select instrument from membership union all select instrument from master)) total", "membership", "master"))
def set_ops(x: Inputs) -> DataFrame:
    m, s = x.membership, x.master
    n = lambda df, name: df.agg(F.count("*").alias(name))
    common = m.select("instrument").intersect(s.where("asset_class = 'E'").select("instrument"))
    missing = s.select("instrument").join(m.where("index_id = 'IDX1'").select("instrument"), "instrument", "left_anti").distinct()
    return n(common, "common").crossJoin(n(missing, "missing")).crossJoin(n(m.select("instrument").unionAll(s.select("instrument")), "total"))


@query(oracles.sql("select min(datetime) \"first\", max(datetime) \"last\", count(*) \"rows\", count(distinct instrument) instruments, count(distinct datetime) dates from panel", "panel"))
def manifest_stats(x: Inputs) -> DataFrame:
    return x.panel.agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.count("*").alias("rows"), F.count_distinct("instrument").alias("instruments"), F.count_distinct("datetime").alias("dates"))


@query(oracles.sql("select event, count(*) \"rows\", count_if(counts_evaluation)::bigint evaluations, count_if(counts_fit)::bigint fits from journal group by event", "journal"))
def event_counts(x: Inputs) -> DataFrame:
    return x.journal.groupBy("event").agg(F.count("*").alias("rows"), F.count_if("counts_evaluation").alias("evaluations"), F.count_if("counts_fit").alias("fits"))


# Checks


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def q_unique(x: Inputs) -> DataFrame:
    return checks.repeated_keys(x.spark.read.parquet(f"{x.dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(oracles.sql("select count(*) \"rows\", count_if(publish is null)::bigint publish, count_if(effective is null)::bigint effective from status_event", "status_event"))
def q_nulls(x: Inputs) -> DataFrame:
    return checks.missing_counts(x.status_event, ["publish", "effective"])


@query("select count_if(l_orderkey % 97 = 3 or l_orderkey % 97 = 5)::bigint l_quantity, count_if(l_orderkey % 89 = 7)::bigint l_extendedprice, 0::bigint l_discount from lineitem")
def q_finite(x: Inputs) -> DataFrame:
    """Planted: values that are no number and both infinities."""
    n, rows = F.col("l_orderkey"), x.spark.read.parquet(f"{x.dir}/lineitem.parquet")
    bad = lambda c, at: F.when(n % 97 == at, F.lit(float("nan"))).when(n % 97 == at + 2, F.lit(float("-inf"))).otherwise(F.col(c))
    planted = {"l_quantity": bad("l_quantity", 3), "l_extendedprice": F.when(n % 89 == 7, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))}
    return checks.nonfinite_counts(rows.withColumns(planted), ["l_quantity", "l_extendedprice", "l_discount"])


@query(oracles.sql("select datetime, instrument from panel where datetime >= date '2001-03-01'", "panel"))
def q_seal(x: Inputs) -> DataFrame:
    return checks.past_seal(x.panel, "2001-03-01").select(*KEYS)


@query(oracles.sql("select count(*) \"rows\", 0::bigint event_after_published, count_if(datetime > published)::bigint published_after_vendor, 0::bigint vendor_after_prediction, 0::bigint prediction_not_before_tradable, count_if(label_start <> datetime + 7)::bigint tradable_not_label_start, count_if(label_start >= label_end)::bigint label_start_not_before_end from (select *, case when s % 10 = 3 then datetime - 1 else datetime end published from sched) where label_start is not null", "labels"))
def q_time_order(x: Inputs) -> DataFrame:
    rows = intervals.label_schedule(x.panel, x.calendar).where("label_start is not null")
    at = lambda d, clock: safe.local_timestamp(d, clock, ZONE)
    d = F.col("datetime")
    vendor = F.when(F.col("s") % 10 == 3, F.date_add(d, -1)).otherwise(d)
    return checks.time_order(
        rows.select(
            at(d, "15:00:00").alias("event_time"), at(d, "15:30:00").alias("published_time"), at(vendor, "16:00:00").alias("vendor_time"), at(d, "17:00:00").alias("prediction_time"),
            at(F.date_add(d, 7), "09:30:00").alias("tradable_time"), at(F.col("label_start"), "09:30:00").alias("label_start_time"), at(F.col("label_end"), "15:00:00").alias("label_end_time"),
        )
    )


@query(oracles.sql("select year(datetime)::int \"year\", count(*) left_value, count(*) + case when year(datetime) = 1998 then 1 else 0 end right_value from panel where year(datetime) = 1998 group by year(datetime)", "panel"))
def q_manifest(x: Inputs) -> DataFrame:
    observed = x.panel.groupBy(F.year("datetime").alias("year")).agg(F.count("*").alias("n"))
    declared = observed.withColumn("n", F.col("n") + F.when(F.col("year") == 1998, 1).otherwise(0))
    return checks.declared_against_observed(observed, declared, "year", "n")


@query(oracles.sql("select count(*) \"rows\", count(distinct (datetime, instrument, fold_id)) keys, 0::bigint missing, 1::bigint models, count(distinct fold_id) folds, count_if(datetime >= date '2002-01-01')::bigint late, count(*) = count(distinct (datetime, instrument, fold_id)) and count(distinct fold_id) = 3 and count_if(datetime >= date '2002-01-01') = 0 ok from fs", "fold_scores"))
def q_scores(x: Inputs) -> DataFrame:
    return checks.score_contract(_fold_scores(x), 3, "2002-01-01")


@query(oracles.sql(f"select datetime, instrument, count(*) n from ({_LONG_SQL}) where not (feature_name = 'ret_1d' and feature_value is null) group by 1, 2 having count(*) <> 4", "features"))
def q_rectangular(x: Inputs) -> DataFrame:
    return checks.rectangular(_long(x).where("not (feature_name = 'ret_1d' and feature_value is null)"), list(KEYS), len(_LONG))


@query(oracles.sql(f"select datetime, instrument, 'ret_1d' feature_name from ({_LONG_SQL}) where feature_name = 'ret_1d' and feature_value is null", "features"))
def q_cells_complete(x: Inputs) -> DataFrame:
    return checks.incomplete_cells(_long(x).where("not (feature_name = 'ret_1d' and feature_value is null)"), list(KEYS), list(_LONG))


@query(oracles.sql("select datetime, instrument, 'left' side from panel where not corporate_action and corporate_action is null union all select datetime, instrument, 'left' from panel where corporate_action", "panel"))
def q_keys_equal(x: Inputs) -> DataFrame:
    return checks.keys_differ(x.panel, x.panel.where("not corporate_action"), list(KEYS))


@query(oracles.sql("select 'leaking' variant, datetime, instrument, 1 changed from (select *, lead(datetime) over (partition by instrument order by datetime) nd, lead(amount) over (partition by instrument order by datetime) na from panel) where datetime <= date '1999-06-07' and nd > date '1999-06-07' and na > 0", "panel"))
def q_future_poison(x: Inputs) -> DataFrame:
    """The features, of which none may change, and a feature that looks one row ahead, which must be found."""
    leak = lambda rows: features(rows.withColumn("next_amount", F.lead("amount").over(history())))
    return checks.future_poisons(x.panel, "1999-06-07", {"features": FEATURE_COLUMNS, "leaking": ("next_amount",)}, build=leak)


@query(oracles.sql("select sha256(string_agg(digest, chr(10) order by datetime)) fingerprint, sum(n)::bigint \"rows\" from (select datetime, sha256(string_agg(datetime::varchar || '|' || instrument, chr(10) order by datetime::varchar || '|' || instrument)) digest, count(*) n from panel group by datetime)", "panel"))
def fingerprint(x: Inputs) -> DataFrame:
    return checks.fingerprint(x.panel, list(KEYS))


@query(oracles.sql("select count(*) intervals, min(label_start) \"first\", max(label_end) \"last\" from (select distinct instrument, datetime, label_start, label_end from sched where label_end is not null)", "labels"))
def label_intervals(x: Inputs) -> DataFrame:
    rows = intervals.label_schedule(x.panel, x.calendar).where("label_end is not null").select("instrument", "datetime", "label_start", "label_end").distinct()
    return rows.agg(F.count("*").alias("intervals"), F.min("label_start").alias("first"), F.max("label_end").alias("last"))


@query(oracles.sql("select j.source_event_id, j.event, 'append' kind from journal j where not exists (select 1 from ledger l where l.source_event_id = j.source_event_id) union all select j.source_event_id, j.event, 'conflict' from journal j join ledger l on l.source_event_id = j.source_event_id and l.event <> j.event", "journal", "ledger"))
def ledger_reconcile(x: Inputs) -> DataFrame:
    return checks.reconcile(x.journal, x.ledger)


@query(oracles.sql("select source_event_id, case when schema_version <> 'v1' then 'schema_version' else 'both_flags' end problem from journal where schema_version <> 'v1' or (counts_evaluation and counts_fit)", "journal"))
def event_validity(x: Inputs) -> DataFrame:
    return checks.invalid_events(x.journal)


@query(oracles.sql("select j.source_event_id from journal j where j.source_event_id not in (select source_event_id from ledger)", "journal", "ledger"))
def ledger_missing(x: Inputs) -> DataFrame:
    return checks.missing_starts(x.journal, x.ledger)


@query(oracles.sql("select count(*) \"rows\", count(b.instrument) matched, count(*) - count(b.instrument) missing from membership a left join (select distinct instrument, eff_to from membership where index_id = 'IDX1') b on b.instrument = a.instrument and b.eff_to is not distinct from a.eff_to where a.index_id = 'IDX0'", "membership"))
def interval_compare(x: Inputs) -> DataFrame:
    other = x.membership.where("index_id = 'IDX1'").select("instrument", "eff_to").distinct()
    return profiles.interval_matches(x.membership.where("index_id = 'IDX0'"), other, "instrument", "eff_to")


@query(oracles.sql("select m.index_id, m.instrument, m.eff_from, s.exchange, i.s_nationkey from membership m join master s on s.instrument = m.instrument left join instruments i on i.instrument = m.instrument order by m.eff_from desc, m.index_id, m.instrument limit 200", "membership", "master", "instruments"))
def dimension_lookup(x: Inputs) -> DataFrame:
    rows = x.membership.join(x.master.select("instrument", "exchange"), "instrument").join(x.instruments.select("instrument", "s_nationkey"), "instrument", "left")
    return rows.orderBy(F.desc("eff_from"), "index_id", "instrument").limit(200).select("index_id", "instrument", "eff_from", "exchange", "s_nationkey")


@query(oracles.sql("select datetime, instrument from panel where year(datetime) <> year(datetime + 7)", "panel"))
def q_partition_year(x: Inputs) -> DataFrame:
    """Rows whose partition year (here of the week after) is not their own year."""
    return checks.wrong_partition(x.panel.withColumn("year", F.year(F.date_add("datetime", 7))), "year").select(*KEYS)


@query(oracles.sql("select datetime, case when year(datetime) = 1998 then 'keyset' else 'state' end problem from state where year(datetime) = 1998 or month(datetime) = 3", "state"))
def q_state_digest(x: Inputs) -> DataFrame:
    """Dates whose stored digests are not those computed again from the population; one year's key sets and every March's
    states are altered."""
    now = cut(state.state_digest(_state(x), _STATE).select("datetime", F.col("population_keyset_sha256").alias("k"), F.col("state_sha256").alias("s")))
    stored = now.withColumns({"k": F.when(F.year("datetime") == 1998, F.lit("?")).otherwise(F.col("k")), "s": F.when(F.month("datetime") == 3, F.lit("?")).otherwise(F.col("s"))})
    return state.wrong_digests(now, stored, {"k": "keyset", "s": "state"})


_CELLS = ("close", "volume", "turnover")
_LINE = "instrument || '|' || " + " || '|' || ".join(f"coalesce(round({c} + 1e-9, 4)::decimal(38,4)::varchar, '')" for c in _CELLS)


@query(oracles.sql(f"""
, l as (select datetime, left(md5(instrument), 2) node, {_LINE} line from panel),
t2 as (select datetime, node, sha256(string_agg(line, chr(10) order by line)) digest, count(*) n from l group by 1, 2),
t1 as (select datetime, left(node, 1) node, sha256(string_agg(digest, '' order by node)) digest, sum(n)::bigint n from t2 group by 1, left(node, 1)),
t0 as (select datetime, '' node, sha256(string_agg(digest, '' order by node)) digest, sum(n)::bigint n from t1 group by 1)
select datetime, 0 "level", node, digest, n from t0 union all select datetime, 1, node, digest, n from t1 union all select datetime, 2, node, digest, n from t2""", "panel"))
def hash_tree(x: Inputs) -> DataFrame:
    """The panel's tree, two levels below each date's root."""
    return trees.tree(x.panel, "datetime", "instrument", list(_CELLS), 2)


@query(oracles.sql("""
select datetime, instrument, 'close' "column", coalesce(round(close + 1e-9, 4)::decimal(38,4)::varchar, '') "before", coalesce(round(close + 0.5::double + 1e-9, 4)::decimal(38,4)::varchar, '') "after"
from panel where (s + 3 * pos) % 101 = 7 and (s + pos) % 103 <> 5
union all select datetime, instrument, '-', 'row', null from panel where (s + pos) % 103 = 5""", "panel"))
def tree_difference(x: Inputs) -> DataFrame:
    """Cells altered and rows lost between the stored panel and a faulty copy, found by descending their trees."""
    a = cut(x.panel.select(*KEYS, "s", "pos", *_CELLS))
    b = a.where((F.col("s") + F.col("pos")) % 103 != 5).withColumn("close", F.when((F.col("s") + 3 * F.col("pos")) % 101 == 7, F.col("close") + 0.5).otherwise(F.col("close")))
    depth, parts = 1 + trees.depth_for(a, "datetime"), partitions_for(x.spark, a.count())
    both = tuple(trees.tree(rows, "datetime", "instrument", list(_CELLS), depth, parts=parts) for rows in (a, b))
    return trees.changed_cells(a, b, both, "datetime", "instrument", list(_CELLS), depth)


_TRIALS = """
, j as (select source_event_id, event, case when counts_evaluation then 'e' || (case when source_event_id % 5003 = 0 then source_event_id + 2 else source_event_id end)::varchar end evaluation_id,
        case when not counts_evaluation then 'f' || (case when source_event_id % 4001 = 0 then source_event_id + 2 else source_event_id end)::varchar end fit_id from journal),
l as (select source_event_id, case when source_event_id % 2001 = 0 then event || '!' else event end event, evaluation_id, fit_id from j where source_event_id % 3 = 0),
n as (select j.* from j where source_event_id % 3 <> 0),
u as (select *, false fresh from l union all select *, true from n),
c as (select *, count(evaluation_id) over (order by source_event_id) + (select count(evaluation_id) from l) ne, count(fit_id) over (order by source_event_id) + (select count(fit_id) from l) nf from n),
caps as (select (select count(*) * 49 // 100 from j) e, (select count(*) * 48 // 100 from j) f)
select j.source_event_id, 'conflict' problem from j join l using (source_event_id) where j.event <> l.event
union all select source_event_id, 'repeated_evaluation' from n where evaluation_id in (select evaluation_id from u where evaluation_id is not null group by 1 having count(*) > 1 and bool_or(fresh))
union all select source_event_id, 'repeated_fit' from n where fit_id in (select fit_id from u where fit_id is not null group by 1 having count(*) > 1 and bool_or(fresh))
union all select source_event_id, 'evaluation_cap' from c, caps where evaluation_id is not null and ne > e
union all select source_event_id, 'fit_cap' from c, caps where fit_id is not null and nf > f"""


@query(oracles.sql(_TRIALS, "journal"))
def ledger_caps(x: Inputs) -> DataFrame:
    """What keeps the journal out of the ledger: altered events, ids used twice over old and new, and additions over the
    caps, which are 49 and 48 of 100 events."""
    n = F.col("source_event_id")
    own = lambda kind, every: F.concat(F.lit(kind), F.when(n % every == 0, n + 2).otherwise(n).cast("string"))
    journal = x.journal.select(n, "event", F.when(F.col("counts_evaluation"), own("e", 5003)).alias("evaluation_id"), F.when(~F.col("counts_evaluation"), own("f", 4001)).alias("fit_id"))
    journal = cut(journal)
    known = journal.where(n % 3 == 0).withColumn("event", F.when(n % 2001 == 0, F.concat("event", F.lit("!"))).otherwise(F.col("event")))
    rows = journal.count()
    return ledgers.problems(cut(known), journal, rows * 49 // 100, rows * 48 // 100)


@query(oracles.sql("select s.datetime, s.instrument from scores s where s.score is not null and s.label is not null", "scores"))
def complete_case(x: Inputs) -> DataFrame:
    return scoring.complete(x.scores(), ["score", "label"]).select(*KEYS)


@query(oracles.sql("select datetime, instrument, turnover, volume from panel where datetime between date '1997-01-06' and date '1997-12-29'", "panel"))
def segment_prepare(x: Inputs) -> DataFrame:
    return folds.prepare(x.panel, {"valid": ("1997-01-06", "1997-12-29")}, {"feature": ("turnover", "volume")}, "valid", "feature")


# Models


@query(None)
def gbt_walk_forward(x: Inputs) -> DataFrame:
    rows = features(x.labelled()).select(*KEYS, "label", "label_end", *scoring.MODEL_FEATURES)
    rows = cut(scoring.complete(rows, [*scoring.MODEL_FEATURES, "label"]))  # before folds, each of which holds most rows
    rows = folds.purged_segments(rows, folds.embargoed(x.folds(), x.calendar, 5)).select(*KEYS, *scoring.MODEL_FEATURES, "fold_id", "segment", "label")
    return scoring.walk_forward(rows, ["wf_1999", "wf_2000", "wf_2001"])


@query(None)
def peer_forward(x: Inputs) -> DataFrame:
    rows = x.feats().select(*KEYS, *scoring.PEER_FEATURES).na.drop()
    return scoring.peer_forward(rows, given=scoring.weights_from(x.peer_weights))


_TIMES = ("prediction_time", "vendor_available_time", "tradable_time", "label_start_time", "label_end_time", "universe_announced_time", "universe_effective_from", "universe_effective_to")
_ISO = lambda c: f"coalesce(strftime({c}::timestamp, '%Y-%m-%dT%H:%M:%S'), '')"
_CONSUMED = readers.CONSTANTS | {"ingested_time": "2001-06-01T00:00:00", "parse_ready_time": "2001-06-01T01:00:00"}


@query(oracles.sql(f"""
, t as (select l.datetime, l.instrument, l.datetime prediction_time, l.datetime vendor_available_time, l.label_start tradable_time, l.label_start label_start_time, l.label_end label_end_time,
          m.pub universe_announced_time, m.eff_from universe_effective_from, m.eff_to universe_effective_to, l.close, l.turnover
        from labelled l left join member m on m.instrument = l.instrument and m.datetime = l.datetime),
u as (select * from (select *, unnest(['close', 'turnover']) feature_name, unnest([close, turnover]) feature_value from t))
select datetime, instrument, feature_name, {_q('feature_value', 4)} feature_value, {', '.join(f'{_ISO(c)} {c}' for c in _TIMES)},
  {', '.join(f"'{v}' {c}" for c, v in _CONSUMED.items())}, instrument || ':' || strftime(datetime, '%Y%m%d') || ':' || feature_name row_id,
  'panel-v1:' || instrument || ':' || strftime(datetime, '%Y%m%d') revision_id, {_ISO('vendor_available_time')} revision_known_time,
  'XSHG_XSHE-' || left({_ISO('label_start_time')}, 10) calendar_session_id from u""", "labels", "member"))
def consumed_values(x: Inputs) -> DataFrame:
    """Two values of every row in the form in which they are consumed, written in order and read back; times that a row
    does not have are empty."""
    rows = intervals.membership_asof(x.labelled(), x.membership, CUTOFF)
    known = ("datetime", "datetime", "label_start", "label_start", "label_end", "member_pub", "member_from", "member_to")
    rows = rows.select(*KEYS, *[F.col(c).cast("timestamp").alias(t) for c, t in zip(known, _TIMES, strict=True)], "close", "turnover")
    long = rounded(rows.unpivot([*KEYS, *_TIMES], ["close", "turnover"], "feature_name", "feature_value"), 4, "feature_value")
    out = readers.consumed(long, list(_TIMES), "panel-v1", _CONSUMED["ingested_time"], _CONSUMED["parse_ready_time"])
    return readers.write_sorted(out, unique_folder(x.spark, "consumed"), [*KEYS, "feature_name"])


@query(oracles.sql("""
, c as (select datetime, avg(intraday_return) / 100 v from daily where intraday_return is not null and pos % 7 <> 3 group by datetime),
b as (select datetime, avg(gap_return) / 100 v from daily where gap_return is not null and pos % 11 <> 5 group by datetime)
select datetime, round(c.v + 1.234e-7::double, 7) + 0::double candidate, round(b.v + 1.234e-7::double, 7) + 0::double benchmark from c join b using (datetime)""", "features"))
def benchmark_alignment(x: Inputs) -> DataFrame:
    """Two series of their own tables, each without some periods; periods that either lacks are dropped."""
    daily = cut(features_daily(x.panel))
    mean = lambda c, name, gone: daily.where(F.col(c).isNotNull() & gone).groupBy("datetime").agg((F.avg(c) / 100).alias(name))
    both = portfolio.aligned(mean("intraday_return", "candidate", F.col("pos") % 7 != 3), mean("gap_return", "benchmark", F.col("pos") % 11 != 5))
    return rounded(both.select("datetime", "candidate", "benchmark"), 7, "candidate", "benchmark")


@query(None)
def peer_network(x: Inputs) -> DataFrame:
    """The whole network over all 50 features and the market state, rows that lack any left out by its mask. Features and
    the flags of the state's population are computed once, and stored; the state and the network read them there."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scoring.PEER_FEATURES])
    rows = features(_standing(x, x.panel)).withColumns({"price_domain_valid": eligibility.price_domain(), "known": known})
    kept = cut(rows.select(*KEYS, "known", *state.REQUIRED, *state.REFUSED, *scoring.PEER_FEATURES))
    daily = state.daily_state(state.state_population(kept))
    some = cut(kept.where("known").select("datetime").distinct().join(daily.select("datetime"), "datetime"))
    alive = kept.join(broadcast_if_small(some, 8), "datetime", "left_semi")
    clipped = alive.select(*KEYS, "known", *[F.greatest(F.least(F.col(c), F.lit(3.0)), F.lit(-3.0)).alias(c) for c in scoring.PEER_FEATURES])
    return network.forward(clipped, list(scoring.PEER_FEATURES), scoring.weights_from(x.network_weights), 4, daily, _STATE, "known", stored=True)


@query(oracles.sql("""
, fit as (select fold_id, regr_slope(label, turnover) b, regr_intercept(label, turnover) a from tagged where segment = 'train' and label is not null and turnover is not null group by fold_id),
sc as (select t.fold_id, t.datetime, t.instrument, round(a + b * turnover, 9) score, label from tagged t join fit on fit.fold_id = t.fold_id where segment = 'test' and label is not null and turnover is not null),
rk as (select *, rank() over (partition by fold_id, datetime order by score) + (count(*) over (partition by fold_id, datetime, score) - 1) / 2.0 rs,
       rank() over (partition by fold_id, datetime order by label) + (count(*) over (partition by fold_id, datetime, label) - 1) / 2.0 rl from sc),
ics as (select fold_id, datetime, case when count(*) >= 3 then covar_pop(rs, rl) / nullif(stddev_pop(rs) * stddev_pop(rl), 0) end rank_ic, count(*) n from rk group by 1, 2),
both_ as (select * from ics union all select 'all', datetime, rank_ic, n from ics)
select fold_id, round(avg(rank_ic) + 1.234e-7::double, 6) + 0::double rank_ic_mean, round(stddev_samp(rank_ic) + 1.234e-7::double, 6) + 0::double rank_ic_std, sum(n)::bigint observations, count(rank_ic) dates
from both_ group by fold_id""", "folds"))
def walk_forward_fitted(x: Inputs) -> DataFrame:
    """A least-squares model fitted on every fold's training part, stored, loaded, and measured on its test part."""
    rows = x.tagged().select("fold_id", "segment", *KEYS, "label", "turnover").where("turnover is not null")
    least_squares = LinearRegression(featuresCol=walkforward.INPUT, labelCol="label", predictionCol="score", solver="normal", standardization=False)
    estimator = walkforward.ColumnEstimator(["turnover"], lambda train, valid: least_squares.fit(train))
    ids = sorted(r.fold_id for r in x.folds().select("fold_id").collect())  # one row a fold
    scores = walkforward.run(cut(rows), ids, estimator, unique_folder(x.spark, "walk-forward"), "least_squares")
    out = walkforward.measured(scores.withColumn("score", F.round("score", 9)))
    return rounded(out, 6, "rank_ic_mean", "rank_ic_std").select("fold_id", "rank_ic_mean", "rank_ic_std", "observations", "dates")
