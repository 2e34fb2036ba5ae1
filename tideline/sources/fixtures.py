"""Inputs of the panel operators, derived from the star-schema tables by plain SQL.

Each view is one SELECT that Spark and DuckDB both run; only day arithmetic is spelled per engine. Everything is
arithmetic on keys, so the views grow with the tables and need no random numbers.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import partitions_for

EPOCH = "date '1995-01-02'"
#: The price limits of a panel row.
LIMIT_UP, LIMIT_DOWN = "case when (s + pos) % 11 = 0 then open else 1.1e0 * open end", "0.9e0 * open"
#: Orders below this are one number.
MOST_LONG = 1 << 63

#: view -> (other views it reads, tables it reads, SELECT). DAYS(a, b) is a - b in days, PLUS(d, n) a date n days on.
VIEWS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "panel": (
        (),
        ("lineitem",),
        f"""
        with li as (
          select cast(l_shipdate as date) d, cast(date_trunc('week', l_shipdate) as date) datetime, l_suppkey s,
                 l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity px, l_quantity q,
                 cast(l_extendedprice as decimal(18,2)) v, cast(l_discount as decimal(18,2)) t
          from lineitem),
        rk as (
          select *, row_number() over (partition by s, datetime order by d, l_orderkey, l_linenumber, l_partkey) ra,
                 row_number() over (partition by s, datetime order by d desc, l_orderkey desc, l_linenumber desc, l_partkey desc) rd
          from li)
        select datetime, s, cast(s as string) instrument, cast(DAYS(datetime, {EPOCH}) / 7 as bigint) pos,
               max(case when ra = 1 then px end) open, max(px) high, min(px) low, max(case when rd = 1 then px end) close,
               sum(q) volume, cast(sum(v) as double) amount, cast(sum(t) as double) / count(*) turnover,
               (s * 7 + cast(DAYS(datetime, {EPOCH}) / 7 as bigint)) % 293 = 0 corporate_action
        from rk group by datetime, s""",
    ),
    "calendar": (
        ("panel",),
        (),
        "select session, cast(row_number() over (order by session) as int) pos from (select distinct datetime session from panel) x",
    ),
    "exchange_calendar": (
        ("calendar",),
        (),
        "select 'A' exchange, session, true is_open from calendar union all select 'B', session, pos % 97 <> 13 from calendar",
    ),
    "instruments": ((), ("supplier",), "select s_suppkey s, cast(s_suppkey as string) instrument, s_nationkey, s_acctbal from supplier"),
    "membership": (
        ("instruments",),
        (),
        f"""
        select instrument, index_id, eff_from, pub, eff_to, case when (s + k) % 9 <> 0 then PLUS(eff_to, -10) end out_pub
        from (select s, k, instrument, index_id, eff_from, PLUS(eff_from, -((5 * s + k) % 20)) pub,
                     case when (s + k) % 4 <> 0 then PLUS(eff_from, 500 + (53 * s) % 700) end eff_to
              from (select s, k, instrument, 'IDX' || cast(k as string) index_id, PLUS({EPOCH}, (37 * s + 900 * k) % 1800) eff_from
                    from instruments cross join (select 0 k union all select 1) ks) a) b""",
    ),
    "status_event": (
        ("instruments",),
        (),
        """
        select instrument, name, effective, case when (s + k) % 13 <> 0 then PLUS(effective, -5 + (17 * s + 11 * k) % 11) end publish
        from (select s, k, instrument, case (s + k) % 3 when 0 then '*ST A' when 1 then 'normal' else 'pt B' end name,
                     PLUS(date '1995-06-01', (131 * s + 607 * k) % 2200) effective
              from instruments cross join (select 0 k union all select 1 union all select 2) ks) a""",
    ),
    "halt": (
        ("instruments",),
        (),
        """
        select instrument, k ordinal, start_day, case when not (k = 2 and s % 29 = 0) then PLUS(start_day, (s + k) % 15) end end_day
        from (select s, k, instrument, PLUS(date '1995-03-01', (211 * s + 733 * k) % 2300) start_day
              from instruments cross join (select 0 k union all select 1 union all select 2) ks) a""",
    ),
    "limits": (
        ("panel",),
        (),
        f"select datetime, instrument, {LIMIT_UP} limit_up, {LIMIT_DOWN} limit_down from panel",
    ),
    "action": (
        ("panel",),
        (),
        "select instrument, datetime action_date from panel where corporate_action union all select instrument, datetime from panel where corporate_action and s % 2 = 0",
    ),
    "master": (
        ("instruments",),
        (),
        """
        select instrument, PLUS(date '1994-06-01', (97 * s) % 1500) list_date, case when s % 50 = 0 then date '2000-06-30' end delist_date,
               case when s % 2 = 0 then 'XSHG' else 'XSHE' end exchange, case when s % 41 = 0 then 'F' else 'E' end asset_class
        from instruments""",
    ),
    "events_daily": (
        (),
        ("events",),
        """
        with d as (select cast(ts as date) datetime, user_id, cast(sum(cast(value as decimal(20,6))) as double) score from events group by 1, 2)
        select datetime, cast(user_id as string) instrument, user_id, score,
               (lead(score) over (partition by user_id order by datetime) - score) / 1000 forward_return,
               1e6 * (user_id % 7) adv20, user_id % 5 <> 0 tradable
        from d""",
    ),
    "journal": (
        (),
        ("events",),
        """
        select event_id source_event_id, 'run-' || cast(event_id % 5 as string) run_id, cast(event_id % 1000 as int) event_seq, event_type event,
               case when event_id % 211 = 0 then 'v0' else 'v1' end schema_version,
               event_id % 2 = 0 counts_evaluation, case when event_id % 97 = 0 then true else event_id % 2 = 1 end counts_fit
        from events""",
    ),
    "ledger": (
        (),
        ("events",),
        "select event_id source_event_id, case when event_id % 51 = 0 then event_type || '!' else event_type end event from events where event_id % 3 = 0",
    ),
    "peer_weights": (
        (),
        ("nation", "part"),
        """
        select name, r, c, (((31 * r + 17 * c + 101 * k) * (7 * r + 3 * c + 11)) % 1009 - 504) / 1700.0e0 value
        from (select n_nationkey k, a.p_partkey r, b.p_partkey c,
                     case n_nationkey when 0 then 'encode' when 1 then 'assign' when 2 then 'query' when 3 then 'key' when 4 then 'value' when 5 then 'out' end name
              from nation cross join part a cross join part b where n_nationkey < 6 and a.p_partkey < 200 and b.p_partkey < 100) x
        where (name = 'encode' and r < 50) or (name = 'assign' and r < 100 and c < 8) or (name in ('query', 'key', 'value') and r < 100) or (name = 'out' and c < 1)""",
    ),
    "network_weights": (
        (),
        ("nation", "part"),
        """
        select name, r, c, case when name like '%scale' then 1.0e0 else (((31 * r + 17 * c + 101 * k) * (7 * r + 3 * c + 11)) % 1009 - 504) / 2400.0e0 end value
        from (select n_nationkey k, a.p_partkey r, b.p_partkey c,
                     case n_nationkey when 0 then 'encoder_w' when 1 then 'encoder_b' when 2 then 'encoder_scale' when 3 then 'encoder_shift' when 4 then 'gate_w' when 5 then 'gate_b'
                       when 6 then 'gate2_w' when 7 then 'gate2_b' when 8 then 'assign_w' when 9 then 'assign_b' when 10 then 'query_w' when 11 then 'query_b' when 12 then 'key_w'
                       when 13 then 'key_b' when 14 then 'value_w' when 15 then 'value_b' when 16 then 'mix_w' when 17 then 'mix_b' when 18 then 'head_w' when 19 then 'head_b'
                       when 20 then 'head_scale' when 21 then 'head_shift' when 22 then 'out_w' when 23 then 'out_b' end name,
                     case when n_nationkey = 0 then 50 when n_nationkey = 4 then 4 when n_nationkey = 18 then 128 when n_nationkey in (6, 8, 10, 12, 14, 16, 22) then 64 else 1 end rows_,
                     case when n_nationkey in (8, 9) then 16 when n_nationkey in (22, 23) then 1 else 64 end columns_
              from nation cross join part a cross join part b where n_nationkey < 24 and a.p_partkey < 128 and b.p_partkey < 64) x
        where r < rows_ and c < columns_""",
    ),
    "anchors": (
        (),
        ("nation",),
        """
        select k, (((7 * k + 0) % 11) - 5) / 5.0e0 w0, (((7 * k + 3) % 11) - 5) / 5.0e0 w1,
               (((7 * k + 6) % 11) - 5) / 5.0e0 w2, (((7 * k + 9) % 11) - 5) / 5.0e0 w3
        from (select cast(n_nationkey as bigint) k from nation where n_nationkey < 16) x""",
    ),
}


def _spell(sql: str, spark: bool) -> str:
    def replace(text: str, name: str, form) -> str:
        while (at := text.find(f"{name}(")) >= 0:
            depth, commas, start = 0, [], at + len(name) + 1
            for i in range(start, len(text)):
                if text[i] == "(":
                    depth += 1
                elif text[i] == ")":
                    if not depth:
                        break
                    depth -= 1
                elif text[i] == "," and not depth:
                    commas.append(i)
            text = text[:at] + form(text[start : commas[0]].strip(), text[commas[0] + 1 : i].strip()) + text[i + 1 :]
        return text

    if spark:
        sql = replace(sql, "DAYS", lambda a, b: f"datediff({a}, {b})")
        return replace(sql, "PLUS", lambda d, n: f"date_add({d}, cast({n} as int))")
    sql = replace(sql, "DAYS", lambda a, b: f"datediff('day', {b}, {a})")
    return replace(sql, "PLUS", lambda d, n: f"({d} + cast({n} as integer))")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.withColumns({"d": F.col("l_shipdate").cast("date"), "datetime": F.date_trunc("week", "l_shipdate").cast("date")})


def _order(lines: DataFrame, day: str, week: str, keys: list[str]) -> tuple[int, Column]:
    """Number of lines, and a column that orders the lines of a week by day and keys: one number where those of all lines
    fit in it, since first and last prices by a number are aggregated without sorting; else the struct of them."""
    found = lines.agg(F.count("*").alias("n"), F.count(day).alias(day), *[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.count, F.min, F.max)]).first()
    low = {k: found[f"min_{k}"] for k in keys}
    spans = {k: (found[f"max_{k}"] or 0) - (low[k] or 0) + 1 for k in keys}
    if any(found[c] < found["n"] for c in (day, *[f"count_{k}" for k in keys])) or 7 * math.prod(spans.values()) >= MOST_LONG:
        return found["n"], F.struct(day, *keys)
    at = F.datediff(day, week).cast("long")
    for k in keys:
        at = at * F.lit(spans[k]) + (F.col(k) - F.lit(low[k] or 0))
    return found["n"], at


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the view `panel`, shuffled once, by instrument: what is grouped, ordered or joined by instrument
    afterwards needs no further shuffle. First and last prices are those of the least and greatest order of a group, so
    that no group is numbered twice."""
    lines = _lines(spark, sf_dir).withColumns({"s": F.col("l_suppkey"), "instrument": F.col("l_suppkey").cast("string"), "px": F.expr("l_extendedprice / l_quantity")})
    count, at = _order(lines, "d", "datetime", ["l_orderkey", "l_linenumber", "l_partkey"])
    n = partitions_for(spark, count)
    lines = lines.select("datetime", "s", "instrument", at.alias("at"), "px", "l_quantity", "l_extendedprice", "l_discount").repartition(n, "instrument")
    tenths = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    rows = lines.groupBy("instrument", "datetime", "s").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"),
        F.sum("l_quantity").alias("volume"), tenths("l_extendedprice").alias("amount"), (tenths("l_discount") / F.count("*")).alias("turnover"),
    )
    rows = rows.withColumn("pos", F.expr(_spell(f"cast(DAYS(datetime, {EPOCH}) / 7 as bigint)", True)))
    return rows.select("datetime", "s", "instrument", "pos", "open", "high", "low", "close", "volume", "amount", "turnover", F.expr("(s * 7 + pos) % 293 = 0").alias("corporate_action"))


def view(spark: SparkSession, sf_dir: str, name: str, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """A fixture view as a DataFrame over the tables of a folder; `stored` views are taken as they are."""
    if stored and name in stored:
        return stored[name]
    if name == "panel":
        return panel(spark, sf_dir)
    others, tables, sql = VIEWS[name]
    if name == "calendar" and not (stored and "panel" in stored):  # the panel's dates are those of its lines
        return spark.sql(_spell(sql.replace("from panel", "from {panel}"), True), panel=_lines(spark, sf_dir).select("datetime"))
    frames = {o: view(spark, sf_dir, o, stored) for o in others} | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for n in frames:
        sql = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(_spell(sql, True), **frames)


def ctes(*names: str) -> str:
    """`name as (...)` clauses of DuckDB for the views and what they read, in order."""
    out: dict[str, str] = {}

    def visit(n: str) -> None:
        for o in VIEWS[n][0]:
            visit(o)
        out.setdefault(n, f"{n} as ({_spell(VIEWS[n][2], False)})")

    for n in names:
        visit(n)
    return ",\n".join(out.values())
