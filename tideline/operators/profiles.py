"""Profiles of source tables: each is one aggregation (or one per group), so a table is read once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def security_profile(master: DataFrame) -> DataFrame:
    return master.agg(
        F.count("*").alias("rows"),
        F.count_distinct("instrument").alias("ids"),
        F.count_distinct(F.concat_ws(":", "exchange", "instrument")).alias("tickers"),
        F.min("list_date").alias("first_list"),
        F.max("list_date").alias("last_list"),
        F.count("delist_date").alias("delisted"),
    )


def calendar_profile(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy("exchange").agg(F.min("session").alias("first"), F.max("session").alias("last"), n_if(F.col("is_open")).alias("open_days"), F.count("*").alias("rows"))


def limit_profile(limits: DataFrame) -> DataFrame:
    missing = F.col("limit_up").isNull() | F.col("limit_down").isNull()
    return limits.agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.count("*").alias("rows"), F.count_distinct("instrument").alias("ids"), n_if(missing).alias("missing"))


def halt_profile(halts: DataFrame) -> DataFrame:
    return halts.agg(F.min("start_day").alias("first"), F.max("start_day").alias("last"), F.count("*").alias("rows"), n_if(F.col("start_day").isNull()).alias("missing_start"), n_if(F.col("end_day").isNull()).alias("open_ended"))


def status_profile(events: DataFrame, start: str, end: str) -> DataFrame:
    """Counts over both clocks, for all events and for those in effect in a period."""
    inside = F.col("effective").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    facts = {"rows": F.lit(True), "missing_publish": F.col("publish").isNull(), "late": F.col("publish") > F.col("effective"), "early": F.col("publish") < F.col("effective"), "same_day": F.col("publish") == F.col("effective")}
    return events.agg(*[n_if(c).alias(k) for k, c in facts.items()], *[n_if(c & inside).alias(f"{k}_inside") for k, c in facts.items()])


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("rows"))


def action_profile(actions: DataFrame) -> DataFrame:
    return actions.agg(F.min("action_date").alias("first"), F.max("action_date").alias("last"), F.count("*").alias("rows"), F.count_distinct("instrument").alias("ids"), F.count_distinct("instrument", "action_date").alias("distinct_rows"))


def membership_clock(membership: DataFrame) -> DataFrame:
    lead = F.datediff("eff_from", "pub")
    return membership.groupBy("index_id").agg(
        F.count("*").alias("rows"),
        n_if(F.col("eff_to").isNull()).alias("open"),
        n_if(F.col("pub").isNull()).alias("missing_pub"),
        n_if(F.col("pub") > F.col("eff_from")).alias("late_in"),
        n_if(F.col("eff_to").isNotNull() & F.col("out_pub").isNull()).alias("missing_out_pub"),
        n_if(F.col("out_pub") > F.col("eff_to")).alias("late_out"),
        F.min(lead).alias("least_lead"),
        F.max(lead).alias("most_lead"),
    )


def yearly_coverage(membership: DataFrame) -> DataFrame:
    return membership.groupBy("index_id", F.year("eff_from").alias("year")).agg(F.count("*").alias("additions"), n_if(F.col("out_pub").isNull()).alias("missing_out_pub"), n_if(F.col("pub") > F.col("eff_from")).alias("late"))


def interval_summary(membership: DataFrame) -> DataFrame:
    return membership.groupBy("index_id").agg(F.count("*").alias("rows"), F.min("eff_from").alias("first_in"), F.max("eff_from").alias("last_in"), F.min("eff_to").alias("first_out"), F.max("eff_to").alias("last_out"), n_if(F.col("eff_to").isNull()).alias("open"), F.count_distinct("instrument").alias("members"))


def duplicate_keys(rows: DataFrame, keys: list[str], limit: int = 200) -> DataFrame:
    """The `limit` most repeated keys: a report, bounded by design."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(limit)


def date_bounds(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(column).alias("rows"))


def verdict(profile: DataFrame, checks: dict[str, str]) -> DataFrame:
    """A one-row profile with each check (SQL over its columns) and the status that follows from all of them."""
    named = profile.withColumns({k: F.coalesce(F.expr(v), F.lit(False)) for k, v in checks.items()})
    ok = reduce(lambda a, b: a & b, [F.col(k) for k in checks])
    return named.select(*checks, F.when(ok, "CANDIDATE").otherwise("REJECTED").alias("status"))


def pick_instrument(panel: DataFrame, before: str, after: str) -> DataFrame:
    """The instrument with rows both up to `before` and from `after` on that has most rows before; ties by name."""
    d = F.col("datetime")
    a, b = d <= F.lit(before).cast("date"), d >= F.lit(after).cast("date")
    counts = panel.groupBy("instrument").agg(n_if(a).alias("rows_before"), F.max(F.when(a, d)).alias("last_before"), F.min(F.when(b, d)).alias("first_after"))
    return counts.where("rows_before > 0 and first_after is not null").orderBy(F.desc("rows_before"), "instrument").limit(1)


def calendar_mismatch(calendars: DataFrame) -> DataFrame:
    """Sessions on which two exchanges disagree about being open."""
    a = calendars.where("exchange = 'A'").select("session", F.col("is_open").alias("open_a"))
    b = calendars.where("exchange = 'B'").select("session", F.col("is_open").alias("open_b"))
    return a.join(b, "session", "full").where(~F.col("open_a").eqNullSafe(F.col("open_b")))


def nullsafe_interval_rows(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a partner equal on every column, missing values counting as equal."""
    condition = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[c]) for c in on])
    return rows.join(other, condition, "left_semi")


def lookup_latest(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key, by a combining aggregate."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in [*order, *values]])


def replay_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys on one side only, or with values that are not identical."""
    x, y = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    both = x.withColumn("in_left", F.lit(True)).join(y.withColumn("in_right", F.lit(True)), keys, "full")
    return both.where(F.col("in_left").isNull() | F.col("in_right").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select(*keys, "left_value", "right_value")


def interval_matches(rows: DataFrame, other: DataFrame, key: str, end: str) -> DataFrame:
    """How many intervals have a partner with the same key and the same (or equally open) end."""
    o = other.select(F.col(key).alias("_key"), F.col(end).alias("_end"))
    both = rows.join(o, (rows[key] == o["_key"]) & rows[end].eqNullSafe(o["_end"]), "left")
    return both.agg(F.count("*").alias("rows"), F.count("_key").alias("matched"), (F.count("*") - F.count("_key")).alias("missing"))
