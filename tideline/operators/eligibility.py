"""Row eligibility: price domain, splits, and the first failing reason of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.safe import all_of, holds


def price_domain() -> Column:
    above = [holds(F.col(c) > 0) for c in ("open", "high", "low", "close")]
    return all_of(above + [holds(F.col(c) >= 0) for c in ("volume", "amount")])


def boundary_sessions(calendar: DataFrame, selection_start: str, gap: int = 5) -> dict:
    """First session of the selection part past the embargo, and the last one whose labels still end inside it."""
    inside = calendar.where(F.col("session") >= F.lit(selection_start).cast("date"))
    first = inside.orderBy("session").limit(gap + 1).agg(F.max("session")).first()[0]
    last = inside.orderBy(F.desc("session")).limit(gap + 1).agg(F.min("session")).first()[0]
    return {"start": selection_start, "embargoed": str(first), "last_label": str(last)}


def assign_split(rows: DataFrame, bounds: dict) -> DataFrame:
    d = F.col("datetime")
    date = lambda k: F.lit(bounds[k]).cast("date")
    split = F.when(d < date("start"), "TRAIN").when(d >= date("embargoed"), "MODEL_SELECTION").otherwise("UNASSIGNED")
    rows = rows.withColumn("split", split)
    inside = F.when(F.col("split") == "TRAIN", F.col("label_end") < date("start")).when(F.col("split") == "MODEL_SELECTION", F.col("label_end") <= date("last_label"))
    return rows.withColumn("label_interval_in_split", F.coalesce(inside, F.lit(False)))


#: Reasons in the order in which they are charged (fixed names); SQL over the row's flags.
REASONS = (
    ("before_research_start", "datetime < date '1995-06-01'"),
    ("outside_pit_universe", "not universe_member"),
    ("listing_age_lt_60_sessions", "not listing_age_eligible"),
    ("special_status_forbidden", "special_status_forbidden"),
    ("special_status_unknown", "special_status_unknown"),
    ("feature_action_mask", "not feature_eligible"),
    ("missing_or_nonfinite_features", "not finite_features"),
    ("missing_or_nonfinite_label", "not finite_label"),
    ("invalid_raw_price_domain", "not price_domain_valid"),
    ("execution_at_price_limit", "execution_at_limit"),
    ("execution_halted", "execution_halted"),
    ("label_crosses_corporate_action", "label_crosses_action"),
    ("purge_or_embargo", "not label_interval_in_split"),
    ("unassigned_split", "split = 'UNASSIGNED'"),
)


def first_reason(rows: DataFrame, reasons=REASONS) -> DataFrame:
    """Each row charged to its first failing reason; NULL means included."""
    return rows.withColumn("reason", F.coalesce(*[F.when(holds(F.expr(c)), F.lit(n)) for n, c in reasons]))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("rows"))
