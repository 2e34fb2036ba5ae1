"""DuckDB SQL of the intermediate tables that several oracle queries share, written apart from the DataFrame code."""

from __future__ import annotations

from tideline.operators.features import WINDOWS
from tideline.sources.fixtures import ctes

_OVER = "partition by instrument order by datetime"
_ROLLED = {"ret_mean": ("avg", "ret_1d"), "ret_std": ("stddev_pop", "ret_1d"), "downside_vol": ("stddev_pop", "downside"), "range_mean": ("avg", "high_low_range"), "turnover_mean": ("avg", "turnover"), "turnover_std": ("stddev_pop", "turnover"), "log_volume_mean": ("avg", "log_volume"), "log_amount_mean": ("avg", "log_amount"), "amihud_mean": ("avg", "amihud_raw")}
_DAILY = ("ret_1d", "gap_return", "intraday_return", "high_low_range", "close_location", "upper_shadow", "lower_shadow", "log_volume", "log_amount", "turnover_raw")


def _rolled() -> str:
    out = []
    for w in WINDOWS:
        out += [f"case when count({x}) over w{w} = {w} then {f}({x}) over w{w} end {n}_{w}" for n, (f, x) in _ROLLED.items()]
        pair = lambda c: f"case when ret_1d is not null and log_volume is not null then {c} end"
        a, b = pair("ret_1d"), pair("log_volume")
        out.append(f"case when count({a}) over w{w} = {w} then (covar_pop({a}, {b}) over w{w}) / nullif((stddev_pop({a}) over w{w}) * (stddev_pop({b}) over w{w}), 0) end price_volume_corr_{w}")
    return ",\n".join(out)


FEATURES = f"""
d0 as (select *, lag(close) over ({_OVER}) prev_close from panel),
d1 as (
  select *, close / nullif(prev_close, 0) - 1 ret_1d, open / nullif(prev_close, 0) - 1 gap_return, close / nullif(open, 0) - 1 intraday_return,
         high / nullif(low, 0) - 1 high_low_range, (close - low) / nullif(high - low, 0) close_location,
         (high - greatest(open, close)) / nullif(open, 0) upper_shadow, (least(open, close) - low) / nullif(open, 0) lower_shadow,
         ln(1 + greatest(volume, 0)) log_volume, ln(1 + greatest(amount, 0)) log_amount, turnover turnover_raw from d0),
daily as (
  select *, abs(ret_1d) / nullif(abs(amount), 0) amihud_raw, case when ret_1d is not null then least(ret_1d, 0) end downside,
         max(corporate_action::int) over ({_OVER} rows 59 preceding) = 1 contaminated from d1),
rolled as (
  select *, {_rolled()} from daily
  window {", ".join(f"w{w} as ({_OVER} rows {w - 1} preceding)" for w in WINDOWS)}),
feats as (
  select * exclude ({", ".join(_DAILY)}, {", ".join(f"{n}_{w}" for w in WINDOWS for n in (*_ROLLED, "price_volume_corr"))}), not contaminated feature_eligible,
         {", ".join(f"case when not contaminated then {c} end {c}" for c in (*_DAILY, *(f"{n}_{w}" for w in WINDOWS for n in (*_ROLLED, "price_volume_corr"))))}
  from rolled)"""

LABELS = """
sched as (
  select p.*, a.session label_start, b.session label_end
  from panel p left join calendar c on c.session = p.datetime
  left join calendar b on b.pos = c.pos + 5 left join calendar a on a.pos = c.pos + 1 and b.session is not null),
labelled as (
  select s.*, o.open label_open, x.close label_close, x.close / nullif(o.open, 0) - 1 label
  from sched s left join panel o on o.instrument = s.instrument and o.datetime = s.label_start
  left join panel x on x.instrument = s.instrument and x.datetime = s.label_end)"""

MEMBER = """
member_known as (
  select instrument, pub, eff_from, case when out_pub < date '2001-06-01' then eff_to end eff_to
  from membership where pub < date '2001-06-01' and eff_from < date '2001-06-01'),
member_hits as (
  select p.instrument, p.datetime, m.pub, m.eff_from, m.eff_to,
         row_number() over (partition by p.instrument, p.datetime order by m.eff_from desc, m.pub desc, m.eff_to desc nulls last) r
  from panel p join member_known m on p.instrument = m.instrument and p.datetime >= m.pub and p.datetime >= m.eff_from
   and (m.eff_to is null or p.datetime < m.eff_to)),
member as (select * from member_hits where r = 1)"""

STATUS = """
ev as (
  select instrument, publish, effective, greatest(publish, effective) known,
         regexp_matches(upper(name), '(^|\\*)ST|PT|退') forbidden from status_event),
known_ev as (select instrument, known, arg_max(forbidden, effective) forbidden from ev where publish is not null group by instrument, known),
unknown_ev as (select instrument, min(effective) unknown_from from ev where publish is null group by instrument),
status as (
  select p.instrument, p.datetime, coalesce(k.forbidden, false) special_status_forbidden,
         coalesce(u.unknown_from <= p.datetime, false) special_status_unknown
  from panel p asof left join known_ev k on p.instrument = k.instrument and p.datetime >= k.known
  left join unknown_ev u on p.instrument = u.instrument)"""

LISTING = """
listing as (
  select m.instrument, c.session eligible_from
  from (select instrument, (select min(pos) from calendar where session >= list_date) pos from master) m left join calendar c on c.pos = m.pos + 59)"""

EXECUTION = """
limit_state as (
  select l.instrument, l.datetime, coalesce(abs(l.label_open - x.limit_up) <= 1e-8, false) or coalesce(abs(l.label_open - x.limit_down) <= 1e-8, false) execution_at_limit
  from labelled l left join limits x on x.instrument = l.instrument and x.datetime = l.label_start),
halt_hits as (
  select l.instrument, l.datetime, h.start_day, h.end_day, row_number() over (partition by l.instrument, l.datetime order by h.ordinal desc) r
  from labelled l join halt h on h.instrument = l.instrument and l.label_start >= h.start_day and (h.end_day is null or l.label_start < h.end_day)),
crossing as (
  select distinct l.instrument, l.datetime from labelled l join action a on a.instrument = l.instrument and a.action_date between l.label_start and l.label_end)"""

BOUNDS = """
bounds as (
  select (select max(session) from (select session from calendar where session >= date '2000-01-01' order by session limit 6)) embargoed,
         (select min(session) from (select session from calendar where session >= date '2000-01-01' order by session desc limit 6)) last_label),
splits as (
  select datetime, instrument, label_end, case when datetime < date '2000-01-01' then 'TRAIN' when datetime >= embargoed then 'MODEL_SELECTION' else 'UNASSIGNED' end split, last_label
  from labelled cross join bounds),
split_rows as (
  select datetime, instrument, split, coalesce(case split when 'TRAIN' then label_end < date '2000-01-01' when 'MODEL_SELECTION' then label_end <= last_label end, false) label_interval_in_split
  from splits)"""

FOLDS = """
folds as (
  select 'wf_' || y fold_id, make_date(greatest(y - 4, f), 1, 1) train_start, make_date(y - 2, 12, 31) train_end, make_date(y - 1, 1, 1) valid_start,
         make_date(y - 1, 12, 31) valid_end, make_date(y, 1, 1) test_start, make_date(y, 12, 31) test_end
  from (select distinct year(session)::int y, (select min(year(session))::int from calendar) f from calendar) where y >= f + 4 and y < 2002),
folds_from as (
  select f.*, (select session from calendar where pos = 5 + (select min(pos) from calendar where session >= f.valid_start)) valid_from,
         (select session from calendar where pos = 5 + (select min(pos) from calendar where session >= f.test_start)) test_from from folds f),
tagged as (
  select * from (
    select l.*, f.fold_id, case when l.datetime between train_start and train_end and label_end < valid_start then 'train'
             when l.datetime >= valid_from and l.datetime <= valid_end and label_end < test_start then 'valid'
             when l.datetime >= test_from and l.datetime <= test_end then 'test' end segment
    from labelled l join folds_from f on l.datetime between f.train_start and f.test_end)
  where segment is not null)"""

SCORES = """
scores as (
  select f.datetime, f.instrument, -f.ret_mean_5 score, l.label from feats f join labelled l on f.instrument = l.instrument and f.datetime = l.datetime),
ranked as (
  select *, rank() over (partition by datetime order by score) + (count(*) over (partition by datetime, score) - 1) / 2.0 rs,
         rank() over (partition by datetime order by label) + (count(*) over (partition by datetime, label) - 1) / 2.0 rl
  from scores where score is not null and label is not null),
ic as (
  select datetime, case when count(*) >= 3 then covar_pop(rs, rl) / nullif(stddev_pop(rs) * stddev_pop(rl), 0) end rank_ic, count(*) n from ranked group by datetime),
bucketed as (
  select datetime, instrument, label, least(ceil(r::double / n * 10), 10)::int bucket
  from (select *, row_number() over (partition by datetime order by score, instrument) r, count(*) over (partition by datetime) n from scores where score is not null and label is not null)
  where n >= 10)"""

LEDGER = """
weeks as (
  select datetime, row_number() over (order by datetime) ordinal from (
    select coalesce(max(case when isodow(datetime) = 5 then datetime end), max(datetime)) datetime
    from (select distinct datetime from events_daily) group by datetime + (((4 - (isodow(datetime) - 1)) % 7 + 7) % 7)::int)),
held as (
  select * from (
    select e.*, w.ordinal, greatest(1, ceil(count(*) over (partition by e.datetime) * 0.1::double)) k,
           row_number() over (partition by e.datetime order by score desc, instrument) r
    from events_daily e join weeks w on w.datetime = e.datetime where tradable and score is not null and forward_return is not null) where r <= k),
weighted as (
  select *, greatest(0, least(case when adv20 is null then least(1.0 / k, 0.05::double) else least(1.0 / k, 0.05::double, greatest(adv20, 0) * 0.1::double / 1e7::double) end, 0.05::double)) weight from held),
moves as (
  select ordinal, instrument, sum(w) w, sum(b) b, sum(gain) gain, sum(one) one from (
    select ordinal, instrument, weight w, 0::double b, coalesce(weight * forward_return, 0) gain, 1 one from weighted
    union all select ordinal + 1, instrument, 0, weight, 0, 0 from weighted) group by ordinal, instrument),
sums as (select ordinal, sum(abs(w - b)) turnover, sum(gain) gross, sum(w) invested, sum(one) names, max(w) heaviest from moves group by ordinal),
wl as (
  select w.datetime, w.ordinal, coalesce(turnover, 0) turnover, coalesce(turnover, 0) * 10 / 1e4::double cost, coalesce(gross, 0) gross,
         coalesce(gross, 0) - coalesce(turnover, 0) * 10 / 1e4::double net, coalesce(invested, 0) invested, coalesce(names, 0) names, coalesce(heaviest, 0) heaviest
  from weeks w left join sums s on s.ordinal = w.ordinal)"""

PARTS = {
    "features": (("panel",), (), FEATURES),
    "labels": (("panel", "calendar"), (), LABELS),
    "member": (("panel", "membership"), (), MEMBER),
    "status": (("panel", "status_event"), (), STATUS),
    "listing": (("master", "calendar"), (), LISTING),
    "execution": (("limits", "halt", "action"), ("labels",), EXECUTION),
    "splits": ((), ("labels",), BOUNDS),
    "folds": ((), ("labels",), FOLDS),
    "scores": ((), ("features", "labels"), SCORES),
    "ledger_weeks": (("events_daily",), (), LEDGER),
}


def sql(query: str, *needs: str) -> str:
    """A query with the fixture views and shared parts it names, each once and in order."""
    views: list[str] = []
    parts: list[str] = []

    def visit(n: str) -> None:
        if n not in PARTS:
            views.append(n)
            return
        own, others, text = PARTS[n]
        views.extend(own)
        for o in others:
            visit(o)
        if text not in parts:
            parts.append(text)

    for n in needs:
        visit(n)
    heads = [x for x in (ctes(*views), *parts) if x]
    if not heads:
        return query
    return f"with {', '.join(heads)}\n{query.strip()}"  # a query that starts with a comma goes on with clauses of its own
