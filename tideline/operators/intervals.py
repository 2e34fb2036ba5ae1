"""Joins against histories: interval membership, as-of status, halts, events inside intervals, calendar offsets.

An instrument's events and intervals, where they are few, go along as one list: rows are joined by instrument alone,
never multiplied, and not shuffled again where they are partitioned by instrument. Where they are many, as-of questions
are a union of both sides followed by one ordered window, and intervals and days are dealt to bins of time, so that a day
meets the intervals of its bin and not all of its instrument's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.safe import holds
from tideline.session import broadcast_if_small, cut

#: Most intervals of an instrument that go along as a list, and how many a bin of a longer history holds on average.
LISTED, BINNED = 64, 8


def latest_covering(rows: DataFrame, spans: DataFrame, at: str, rank: list[str], name: str, on: str = "instrument", most: int = LISTED) -> DataFrame:
    """Rows with `name`: the struct (rank columns, start, end) of the span that covers their day `at`, of several the
    greatest, or null. A span has a `start` that counts and an `end` that doesn't; a null end is open."""
    spans = spans.select(on, F.struct(*rank, "start", "end").alias("span")).where("span.start is not null")
    many = cut(spans.groupBy(on).agg(F.count("*").alias("_n"), F.min("span.start").alias("_low")).where(F.col("_n") > most))
    some = not many.isEmpty()
    few = broadcast_if_small(many.select(on), 32)
    usual = spans.join(few, on, "left_anti") if some else spans
    lists = usual.groupBy(on).agg(F.collect_list("span").alias("_spans"))  # LISTED at most
    covers = lambda s: (F.col(at) >= s["start"]) & (s["end"].isNull() | (F.col(at) < s["end"]))
    out = rows.join(broadcast_if_small(lists, 32 + 32 * len(rank)), on, "left").withColumn(name, F.array_max(F.filter("_spans", covers))).drop("_spans")
    if not some:
        return out
    days = rows.select(on, F.col(at).alias("_at")).where("_at is not null").join(few, on, "left_semi").distinct()
    reach = days.groupBy(on).agg(F.max("_at").alias("_high"))
    scale = many.join(reach, on).withColumn("_width", F.greatest(F.lit(1), F.ceil(BINNED * F.datediff("_high", "_low") / F.col("_n"))))
    scale = broadcast_if_small(cut(scale), 48)
    bin_of = lambda day: F.floor(F.datediff(day, "_low") / F.col("_width"))
    end = F.least(F.coalesce(F.date_sub("span.end", 1), F.col("_high")), F.col("_high"))
    binned = spans.join(scale, on).withColumn("_end", end).where(F.col("_end") >= F.col("span.start"))
    binned = binned.select(on, "span", F.explode(F.sequence(bin_of(F.col("span.start")), bin_of(F.col("_end")))).alias("_bin"))
    inside = days.join(scale, on).where("_at >= _low").select(on, "_at", bin_of(F.col("_at")).alias("_bin"))
    hit = inside.join(binned, [on, "_bin"]).where((F.col("_at") >= F.col("span.start")) & (F.col("span.end").isNull() | (F.col("_at") < F.col("span.end"))))
    best = hit.groupBy(on, F.col("_at").alias(at)).agg(F.max("span").alias("_best"))
    return out.join(best, [on, at], "left").withColumn(name, F.coalesce(name, "_best")).drop("_best").select(*out.columns)


def membership_asof(panel: DataFrame, membership: DataFrame, cutoff: str) -> DataFrame:
    """Is the instrument a member on the day, as known then; the winner is the latest by start, then announcement.

    Intervals announced or starting at the cutoff or later don't exist yet. An end counts only if its announcement is
    known before the cutoff.
    """
    end = F.when(F.col("out_pub").isNotNull() & (F.col("out_pub") < F.lit(cutoff).cast("date")), F.col("eff_to"))
    known = membership.where((F.col("pub") < F.lit(cutoff).cast("date")) & (F.col("eff_from") < F.lit(cutoff).cast("date")))
    m = known.select("instrument", "pub", "eff_from", end.alias("eff_to")).withColumns({"start": F.greatest("pub", "eff_from"), "end": F.col("eff_to")})
    found = latest_covering(panel, m, "datetime", ["eff_from", "pub", "eff_to"], "_m")
    columns = {"universe_member": F.col("_m").isNotNull(), "member_pub": F.col("_m.pub"), "member_from": F.col("_m.eff_from"), "member_to": F.col("_m.eff_to")}
    return found.withColumns(columns).drop("_m")


def special_name(name: Column) -> Column:
    """ST at the start or after a star, PT, or the delisting character."""
    return F.upper(F.coalesce(name, F.lit(""))).rlike(r"(^|\*)ST|PT|退")


def asof_backward(rows: DataFrame, events: DataFrame, on: str, at: str, known: str, ties: list[str], values: list[str], most: int = LISTED) -> DataFrame:
    """Each row with the `values` of the last event known at its time. Events of an instrument that has few go along as
    one list, so rows stay where they are; rows of the others are united with the events and ordered, without a range
    join."""
    names = [c for c in rows.columns]
    many = cut(events.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
    some = not many.isEmpty()
    few = broadcast_if_small(many.select(on), 32)
    usual = events.join(few, on, "left_anti") if some else events
    lists = usual.groupBy(on).agg(F.collect_list(F.struct(F.col(known).alias("_at"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(ties)], F.struct(*values).alias("_v"))).alias("_events"))
    before = lambda e: e["_at"].isNull() | (e["_at"] <= F.col(at))
    left = rows.join(few, on, "left_anti") if some else rows
    found = left.join(broadcast_if_small(lists, 32 + 32 * (len(ties) + len(values))), on, "left").withColumn("_last", F.array_max(F.filter("_events", before))["_v"])
    found = found.select(*names, *[F.col(f"_last.{v}").alias(v) for v in values])
    if not some:
        return found
    return found.unionByName(_asof_ordered(rows.join(few, on, "left_semi").select(*names), events.join(few, on, "left_semi"), on, at, known, ties, values))


def _asof_ordered(rows: DataFrame, events: DataFrame, on: str, at: str, known: str, ties: list[str], values: list[str]) -> DataFrame:
    """The same by one union and one window."""
    names = [c for c in rows.columns]
    left = rows.withColumns({"_at": F.col(at), "_side": F.lit(1), **{f"_t{k}": F.lit(None).cast(events.schema[t].dataType) for k, t in enumerate(ties)}, "_v": F.lit(None).cast(events.select(F.struct(*values)).schema[0].dataType)})
    right = events.select(
        F.col(on), F.col(known).alias("_at"), F.lit(0).alias("_side"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(ties)], F.struct(*values).alias("_v")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("_at", "_side", *[f"_t{k}" for k in range(len(ties))]).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w)
    return both.withColumn("_last", last).where("_side = 1").select(*names, *[F.col(f"_last.{v}").alias(v) for v in values])


def status_asof(panel: DataFrame, events: DataFrame) -> DataFrame:
    """special_status_forbidden: the last known event names a special status. special_status_unknown: some event without
    a publication date is in effect."""
    e = events.withColumns({"known": F.greatest("publish", "effective"), "forbidden": special_name(F.col("name"))})
    found = asof_backward(panel, e.where("publish is not null"), "instrument", "datetime", "known", ["effective"], ["forbidden"])
    unknown = e.where("publish is null").groupBy("instrument").agg(F.min("effective").alias("unknown_from"))
    joined = found.join(broadcast_if_small(unknown, 24), "instrument", "left")
    return joined.withColumns(
        {"special_status_forbidden": F.coalesce("forbidden", F.lit(False)), "special_status_unknown": holds(F.col("unknown_from") <= F.col("datetime"))}
    ).drop("forbidden", "unknown_from")


def is_active(rows: DataFrame, master: DataFrame) -> DataFrame:
    """In the master and not delisted by the day."""
    m = master.select("instrument", F.col("delist_date").alias("_gone"), F.lit(True).alias("_known"))
    active = holds(F.col("_known") & (F.col("_gone").isNull() | (F.col("_gone") > F.col("datetime"))))
    return rows.join(broadcast_if_small(m, 24), "instrument", "left").withColumn("is_active", active).drop("_gone", "_known")


def action_flag(panel: DataFrame, actions: DataFrame) -> DataFrame:
    keys = actions.select("instrument", F.col("action_date").alias("datetime"), F.lit(True).alias("_hit")).distinct()
    return panel.join(keys, ["instrument", "datetime"], "left").withColumn("has_action", F.coalesce("_hit", F.lit(False))).drop("_hit")


def label_schedule(panel: DataFrame, calendar: DataFrame, start: int = 1, end: int = 5) -> DataFrame:
    """Label start and end are calendar sessions after the day, both missing if the calendar ends before."""
    at = lambda k, name: calendar.select((F.col("pos") - k).alias("pos"), F.col("session").alias(name))
    ahead = calendar.select(F.col("session").alias("datetime"), "pos").join(at(start, "label_start"), "pos").join(at(end, "label_end"), "pos").drop("pos")
    return panel.join(broadcast_if_small(ahead, 24), "datetime", "left")


def labels(scheduled: DataFrame, prices: DataFrame) -> DataFrame:
    """close at label end over open at label start, minus one; missing if the instrument has no row there."""
    p = lambda on, src, name: prices.select("instrument", F.col("datetime").alias(on), F.col(src).alias(name))
    rows = scheduled.join(p("label_start", "open", "label_open"), ["instrument", "label_start"], "left")
    rows = rows.join(p("label_end", "close", "label_close"), ["instrument", "label_end"], "left")
    return rows.withColumn("label", F.try_divide("label_close", "label_open") - 1)


def ahead(rows: DataFrame, columns: dict[str, tuple[str, str]], steps: int) -> DataFrame:
    """Rows with columns of their instrument's row on a later day: new name -> (column of the day, column to take), or
    null where there is no such row. For panels with unique keys whose day lies at most `steps` of the instrument's rows
    ahead; the panel is looked up in its own order, so no join is needed."""
    over = Window.partitionBy("instrument").orderBy("datetime")
    kept = rows.columns
    taken = F.struct("datetime", *sorted({c for _, c in columns.values()}))
    rows = rows.withColumns({f"_f{k}": F.lead(taken, k).over(over) for k in range(1, steps + 1)})
    at = lambda day, c: F.coalesce(*[F.when(F.col("instrument").isNotNull() & (F.col(f"_f{k}.datetime") == F.col(day)), F.struct(F.col(f"_f{k}.{c}").alias("v"))) for k in range(1, steps + 1)])["v"]
    return rows.select(*kept, *[at(day, c).alias(name) for name, (day, c) in columns.items()])


def labelled(panel: DataFrame, calendar: DataFrame, taken: dict[str, tuple[str, str]] | None = None, start: int = 1, end: int = 5) -> DataFrame:
    """Schedule and labels of a panel with unique keys whose dates are sessions, with its own prices: the result of
    `labels(label_schedule(panel, calendar), panel)` in one ordered pass. `taken` names further columns to look up."""
    columns = {"label_open": ("label_start", "open"), "label_close": ("label_end", "close")} | (taken or {})
    rows = ahead(label_schedule(panel, calendar, start, end), columns, end)
    return rows.withColumn("label", F.try_divide("label_close", "label_open") - 1)


def open_limit_state(rows: DataFrame, limits: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    on = limits.select("instrument", F.col("datetime").alias("label_start"), "limit_up", "limit_down")
    return touched(rows.join(on, ["instrument", "label_start"], "left"), tolerance)


def touched(rows: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Does the price at label start lie at one of the limits of that day, which the rows have."""
    touch = lambda c: holds(F.abs(F.col("label_open") - F.col(c)) <= tolerance)
    return rows.withColumn("execution_at_limit", touch("limit_up") | touch("limit_down"))


def halt_at(rows: DataFrame, halts: DataFrame) -> DataFrame:
    """Halted at the label start (half-open); the last matching interval in source order gives the times."""
    h = halts.select("instrument", "ordinal", F.col("start_day").alias("start"), F.col("end_day").alias("end"))
    found = latest_covering(rows, h, "label_start", ["ordinal"], "_h")
    return found.withColumns({"halt_start": F.col("_h.start"), "halt_end": F.col("_h.end"), "execution_halted": F.col("_h").isNotNull()}).drop("_h")


def action_in_label(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Is there an action from label start to label end: the last one known at the end lies not before the start."""
    a = actions.select("instrument", "action_date").where("action_date is not null").withColumn("_known", F.col("action_date"))
    found = asof_backward(rows, a, "instrument", "label_end", "_known", [], ["action_date"])
    return found.withColumn("label_crosses_action", holds(F.col("action_date") >= F.col("label_start"))).drop("action_date")


def listing_age(rows: DataFrame, master: DataFrame, calendar: DataFrame, sessions: int = 60) -> DataFrame:
    """Listed for `sessions` sessions, the listing session counted; past the calendar's end never."""
    first = _first_session(master, calendar)
    nth = calendar.select((F.col("pos") - (sessions - 1)).alias("pos"), F.col("session").alias("eligible_from"))
    age = first.join(nth, "pos", "left").select("instrument", "eligible_from")
    return rows.join(broadcast_if_small(cut(age), 24), "instrument", "left").withColumn("listing_age_eligible", holds(F.col("datetime") >= F.col("eligible_from"))).drop("eligible_from")


def _first_session(master: DataFrame, calendar: DataFrame) -> DataFrame:
    """(instrument, pos) of the first session on or after listing, by one ordered pass over both."""
    both = calendar.select(F.col("session").alias("d"), "pos", F.lit(None).cast("string").alias("instrument"), F.lit(0).alias("side")).unionByName(
        master.select(F.col("list_date").alias("d"), F.lit(None).cast("int").alias("pos"), "instrument", F.lit(1).alias("side"))
    )
    w = Window.partitionBy(F.year("d")).orderBy("d", F.desc("side")).rowsBetween(0, Window.unboundedFollowing)
    inside = both.withColumns({"next": F.first("pos", ignorenulls=True).over(w), "y": F.year("d")}).where("side = 1")
    later = calendar.groupBy(F.year("session").alias("fy")).agg(F.min("pos").alias("fpos"))
    rest = inside.where("next is null").select("instrument", "y").distinct().join(later, F.col("fy") > F.col("y")).groupBy("instrument").agg(F.min("fpos").alias("pos"))
    return inside.where("next is not null").select("instrument", F.col("next").alias("pos")).unionByName(rest.select("instrument", "pos"))
