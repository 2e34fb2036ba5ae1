"""Queries of the contract rules; each but the readers is run on rows with planted violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import safe
from tideline.operators import contracts, eligibility, intervals, metrics
from tideline.plans import oracles
from tideline.plans.audit import ZONE
from tideline.plans.panel import CUTOFF, KEYS, Inputs, _r, rounded
from tideline.plans.registry import query
from tideline.session import unique_folder
from tideline.sources import readers

CLOCKS = {"open_time": "09:30:00", "close_time": "15:00:00", "break_start": "11:30:00", "break_end": "13:00:00"}
_MINUTES = {"open_time": 90, "close_time": 420, "break_start": 210, "break_end": 300}


@query(oracles.sql(f"select session, {', '.join(f'session::timestamp + interval {m} minute {c}' for c, m in _MINUTES.items())} from calendar", "calendar"))
def calendar_csv(x: Inputs) -> DataFrame:
    """The session calendar as a CSV file with four clocks, read back under its rules."""
    day, path = F.col("session"), unique_folder(x.spark, "calendar-csv")
    times = [safe.iso(safe.local_timestamp(day, t, ZONE)).alias(c) for c, t in CLOCKS.items()]
    x.calendar.orderBy("session").select(contracts.session_id(day).alias("session_id"), *times).coalesce(1).write.option("header", True).csv(path)
    back = contracts.read_calendar(x.spark, path, f"session_id string, {', '.join(f'{c} timestamp' for c in CLOCKS)}", "2030-01-01")
    return back.select("session", *[F.col(c).cast("timestamp_ntz").alias(c) for c in CLOCKS])


@query(oracles.sql("""
, c as (select pos ordinal, case when pos % 60 = 5 then session - 7 when pos % 60 = 30 then session - 21 else session end session from calendar),
b as (select *, lag(session) over (order by ordinal) before from c)
select ordinal, session, case when session >= date '2001-06-01' then 'sealed' when session = before then 'repeated' else 'not ascending' end problem
from b where session >= date '2001-06-01' or session <= before""", "calendar"))
def calendar_problems(x: Inputs) -> DataFrame:
    moved = F.when(F.col("pos") % 60 == 5, F.date_add("session", -7)).when(F.col("pos") % 60 == 30, F.date_add("session", -21)).otherwise(F.col("session"))
    return contracts.calendar_problems(x.calendar.select(F.col("pos").alias("ordinal"), moved.alias("session")), "2001-06-01")


@query(oracles.sql("select year(datetime)::int \"year\", count(*) \"rows\", count(distinct instrument) instruments, round(sum(volume) + 1.234e-7::double, 3) + 0::double volume from panel where year(datetime) in (1996, 1997) group by 1", "panel"))
def bound_product(x: Inputs) -> DataFrame:
    """A matrix written by year; two years of it are read under all checks."""
    path = unique_folder(x.spark, "bound-matrix")
    panel = x.store("panel").panel
    columns = {"datetime": "date", "instrument": "string", "close": "double", "volume": "double"}
    readers.assert_schema(panel.select(*columns), columns)
    readers.write_years(panel.select(*columns), path)
    declared = panel.groupBy(F.year("datetime").alias("year")).agg(F.count("*").alias("rows"))
    rows = contracts.read_bound(x.spark, path, [1996, 1997], columns, declared, 2002)
    out = rows.groupBy(F.year("datetime").alias("year")).agg(F.count("*").alias("rows"), F.count_distinct("instrument").alias("instruments"), F.sum("volume").alias("volume"))
    return rounded(out, 3, "volume")


_POPULATION = ("split", "member_pub", "member_from", "member_to", "valid_from", "valid_to", "label_start", "label_end")


@query(oracles.sql("""
select r.datetime, r.instrument, r.split, m.pub member_pub, m.eff_from member_from, m.eff_to member_to, a.list_date valid_from, a.delist_date valid_to, l.label_start, l.label_end
from reasons r join member m on m.instrument = r.instrument and m.datetime = r.datetime join master a on a.instrument = r.instrument
join labelled l on l.instrument = r.instrument and l.datetime = r.datetime where r.reason is null""", "flags", "master"))
def population_sink(x: Inputs) -> DataFrame:
    """One narrow row per included sample, written and read back."""
    included = eligibility.first_reason(x.flagged()).where("reason is null")
    valid = x.master.select("instrument", F.col("list_date").alias("valid_from"), F.col("delist_date").alias("valid_to"))
    rows = contracts.attach_one(included, valid, "instrument").select(*KEYS, *_POPULATION)
    path = unique_folder(x.spark, "population")
    rows.write.option("compression", "zstd").parquet(path)
    return x.spark.read.schema(rows.schema).parquet(path)


@query(oracles.sql("select p.datetime, p.instrument, m.exchange from panel p left join master m on m.instrument = p.instrument", "panel", "master"))
def master_attach(x: Inputs) -> DataFrame:
    return contracts.attach_one(x.panel.select(*KEYS), x.master.select("instrument", "exchange"), "instrument").select(*KEYS, "exchange")


@query(oracles.sql("select instrument, count(*) n from (select instrument from master union all select instrument from instruments where s % 9 = 4) group by instrument having count(*) > 1", "master", "instruments"))
def master_repeats(x: Inputs) -> DataFrame:
    twice = x.master.select("instrument").unionByName(x.instruments.where("s % 9 = 4").select("instrument"))
    return contracts.repeated(twice, "instrument")


@query(oracles.sql("select datetime, instrument, session_id from (select datetime, instrument, s, case when s % 19 = 6 then 'XSHG_XSHE-' || strftime(datetime + 1, '%Y-%m-%d') when s % 19 = 7 then null else 'XSHG_XSHE-' || strftime(datetime, '%Y-%m-%d') end session_id from panel) where s % 19 in (6, 7)", "panel"))
def audit_sessions(x: Inputs) -> DataFrame:
    own = contracts.session_id(F.col("datetime"))
    given = F.when(F.col("s") % 19 == 6, contracts.session_id(F.date_add("datetime", 1))).when(F.col("s") % 19 == 7, F.lit(None)).otherwise(own)
    return contracts.unknown_sessions(x.panel.select(*KEYS, given.alias("session_id")), x.calendar).select(*KEYS, "session_id")


@query(oracles.sql("select datetime, instrument from panel where (s + pos) % 31 in (4, 5)", "panel"))
def audit_revisions(x: Inputs) -> DataFrame:
    turn, at = (F.col("s") + F.col("pos")) % 31, safe.local_timestamp(F.col("datetime"), "15:00:00", ZONE)
    late = safe.local_timestamp(F.date_add("datetime", 1), "15:00:00", ZONE)
    rows = x.panel.select(*KEYS, at.alias("prediction_time"), F.when(turn == 4, late).when(turn == 5, F.lit(None)).otherwise(at).alias("revision_known_time"))
    return contracts.late_revisions(rows).select(*KEYS)


@query(oracles.sql("""select datetime, instrument from (select datetime, instrument, pub, case when instrument like '%3' then eff_from + 400 else eff_from end f, eff_to from member)
where not (datetime >= pub and datetime >= f and (eff_to is null or datetime < eff_to))""", "member"))
def audit_membership(x: Inputs) -> DataFrame:
    rows = intervals.membership_asof(x.panel.select(*KEYS), x.membership, CUTOFF).where("universe_member")
    moved = F.when(F.col("instrument").endswith("3"), F.date_add("member_from", 400)).otherwise(F.col("member_from"))
    return contracts.wrong_members(rows.withColumn("member_from", moved)).select(*KEYS)


@query(oracles.sql("""select permanent_id, count(distinct instrument) instruments, count_if(not list_date <= datetime)::bigint early
from (select case when s % 23 = 7 then s - 1 else s end permanent_id, p.instrument, p.datetime, m.list_date from panel p join master m on m.instrument = p.instrument) group by 1
having count(distinct instrument) > 1 or count_if(not list_date <= datetime) > 0""", "panel", "master"))
def audit_identity(x: Inputs) -> DataFrame:
    ids = F.when(F.col("s") % 23 == 7, F.col("s") - 1).otherwise(F.col("s"))
    rows = x.panel.select(*KEYS, ids.alias("permanent_id")).join(x.master.select("instrument", F.col("list_date").alias("valid_from")), "instrument")
    return contracts.wrong_identities(rows)


@query(oracles.sql("select datetime, instrument from panel where (s + 2 * pos) % 37 in (1, 2, 3)", "panel"))
def audit_adjustment(x: Inputs) -> DataFrame:
    turn = (F.col("s") + 2 * F.col("pos")) % 37
    mode = F.when(turn == 1, "FORWARD").when(turn == 2, F.lit(None)).otherwise("RAW")
    rows = x.panel.select(*KEYS, mode.alias("adjustment_mode"), F.when(turn == 3, "2001-01-01").otherwise("").alias("adjustment_time"))
    return contracts.wrong_adjustments(rows).select(*KEYS)


_JOURNAL = """
, j as (select source_event_id row_id, event, schema_version, case when source_event_id % 83 = 0 then 'run-x' else run_id end run_id,
        case when source_event_id % 79 = 0 then 0 else event_seq + 1 end event_seq, run_id r0, event_seq s0, counts_evaluation, counts_fit from journal),
k as (select *, case when row_id % 89 = 0 then r0 || ':' || lpad((s0 + 2)::varchar, 6, '0') else run_id || ':' || lpad(event_seq::varchar, 6, '0') end source_event_id from j)
select row_id, problem from (select row_id, case when schema_version <> 'v1' then 'schema_version' when run_id = 'run-x' then 'run_id' when event_seq < 1 then 'event_seq'
  when row_id % 89 = 0 then 'source_event_id' when counts_evaluation = counts_fit or counts_fit <> (row_id % 2 = 1) then 'flags' end problem from k) where problem is not null"""


@query(oracles.sql(_JOURNAL, "journal"))
def event_identity(x: Inputs) -> DataFrame:
    n = F.col("source_event_id")
    name = lambda run, seq: F.concat(run, F.lit(":"), F.lpad(seq.cast("string"), 6, "0"))
    rows = x.journal.select(n.alias("row_id"), "schema_version", "run_id", F.col("run_id").alias("r0"), "event_seq", "counts_evaluation", "counts_fit", (n % 2 == 1).alias("is_fit"))
    rows = rows.withColumns({"run_id": F.when(F.col("row_id") % 83 == 0, "run-x").otherwise(F.col("run_id")), "s0": F.col("event_seq"), "event_seq": F.when(F.col("row_id") % 79 == 0, 0).otherwise(F.col("event_seq") + 1)})
    given = F.when(F.col("row_id") % 89 == 0, name(F.col("r0"), F.col("s0") + 2)).otherwise(name(F.col("run_id"), F.col("event_seq")))
    return contracts.wrong_events(rows.withColumn("source_event_id", given), x.journal.select("run_id").distinct(), "v1")


_BY_FOLD = ("rank_ic_mean", "rank_ic_std")


@query(oracles.sql(f"""
, fit as (select fold_id, avg(turnover) m, case when stddev_pop(turnover) >= 1e-12 then stddev_pop(turnover) else 1 end sd from tagged where segment = 'train' group by fold_id),
sc as (select t.fold_id, t.datetime, t.instrument, round(-(turnover - m) / sd, 9) score, label from tagged t join fit on fit.fold_id = t.fold_id where segment = 'test' and label is not null and turnover is not null),
rk as (select *, rank() over (partition by fold_id, datetime order by score) + (count(*) over (partition by fold_id, datetime, score) - 1) / 2.0 rs,
       rank() over (partition by fold_id, datetime order by label) + (count(*) over (partition by fold_id, datetime, label) - 1) / 2.0 rl from sc),
ics as (select fold_id, datetime, case when count(*) >= 3 then covar_pop(rs, rl) / nullif(stddev_pop(rs) * stddev_pop(rl), 0) end rank_ic, count(*) n from rk group by 1, 2),
both_ as (select * from ics union all select 'all', datetime, rank_ic, n from ics),
sums as (select fold_id, avg(rank_ic) rank_ic_mean, stddev_samp(rank_ic) rank_ic_std, sum(n)::bigint observations, count(rank_ic) dates from both_ group by fold_id)
select fold_id, {_r(_BY_FOLD, 6)}, observations, dates from sums""", "folds"))
def walk_forward_metrics(x: Inputs) -> DataFrame:
    """Every fold standardised on its training rows, scored by falling turnover, and measured by fold and over all."""
    from tideline.operators import folds

    x.store("panel", "calendar")
    rows = x.tagged().select("fold_id", *KEYS, "segment", "turnover", "label")
    scaled = folds.standardized(rows, folds.standardizer(rows, ("turnover",)), ("turnover",)).where("segment = 'test'")
    scored = scaled.select("fold_id", *KEYS, F.round(-F.col("turnover"), 9).alias("score"), "label")
    return rounded(metrics.by_fold(scored), 6, *_BY_FOLD).select("fold_id", *_BY_FOLD, "observations", "dates")
