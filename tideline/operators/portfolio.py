"""Weekly top-fraction portfolio as tables: rebalance dates, holdings, turnover and returns; bootstrap; decision."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ranks
from tideline.operators.metrics import information_ratio, wealth
from tideline.session import broadcast_if_small, cut


def rebalance_dates(rows: DataFrame, weekday: int = 4) -> DataFrame:
    """One date per Saturday-to-Friday week: the last on the weekday, else the week's last; numbered in order."""
    d = F.col("datetime")
    week = F.date_add(d, F.pmod(F.lit(4) - F.weekday(d), F.lit(7)))
    chosen = rows.select("datetime").distinct().groupBy(week.alias("week")).agg(F.coalesce(F.max(F.when(F.weekday(d) == weekday, d)), F.max(d)).alias("datetime"))
    # One row per week: the ordering below is over a calendar, not over data.
    return chosen.select("datetime", F.row_number().over(Window.orderBy("datetime")).alias("ordinal"))


def top_fraction(rows: DataFrame, fraction: float, most: int = ranks.MOST) -> DataFrame:
    """The max(1, ceil(n * fraction)) highest scores per date among tradable rows with a score and a forward return."""
    live = cut(rows.where(F.coalesce("tradable", F.lit(False)) & F.col("score").isNotNull() & F.col("forward_return").isNotNull()))
    placed = ranks.numbered(live, "score", "instrument", "r", "_n", descending=True, most=most)
    return placed.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(fraction)))).drop("_n").where("r <= k")


def capped_weights(selected: DataFrame, cap: float, participation: float, notional: float) -> DataFrame:
    """min(1 / k, cap), then a capacity bound where it is known; never scaled up again."""
    base = F.least(1 / F.col("k"), F.lit(cap))
    capacity = F.greatest("adv20", F.lit(0.0)) * participation / notional
    bound = F.when(F.col("adv20").isNotNull(), F.least(base, capacity)).otherwise(base)
    return selected.withColumn("weight", F.greatest(F.lit(0.0), F.least(bound, F.lit(cap))))


def holdings(rows: DataFrame, fraction: float, cap: float, participation: float, notional: float) -> DataFrame:
    dates = rebalance_dates(rows)
    at = rows.join(broadcast_if_small(dates, 16), "datetime")
    return capped_weights(top_fraction(at, fraction), cap, participation, notional)


def weekly_ledger(rows: DataFrame, fraction: float = 0.1, cap: float = 0.05, participation: float = 0.1, notional: float = 1e7, bps: float = 10.0) -> DataFrame:
    """Per rebalance: turnover against the weights before, cost, gross and net return, invested share, names and the
    largest weight. A date with nothing tradable sells everything and still has a row."""
    held = holdings(rows, fraction, cap, participation, notional)
    now = held.select("ordinal", "instrument", "weight", F.lit(0.0).alias("before"), F.coalesce(F.col("weight") * F.col("forward_return"), F.lit(0.0)).alias("gain"), F.lit(1).alias("name"))
    then = held.select((F.col("ordinal") + 1).alias("ordinal"), "instrument", F.lit(0.0).alias("weight"), F.col("weight").alias("before"), F.lit(0.0).alias("gain"), F.lit(0).alias("name"))
    moves = now.unionByName(then).groupBy("ordinal", "instrument").agg(F.sum("weight").alias("w"), F.sum("before").alias("b"), F.sum("gain").alias("gain"), F.sum("name").alias("name"))
    sums = moves.groupBy("ordinal").agg(F.sum(F.abs(F.col("w") - F.col("b"))).alias("turnover"), F.sum("gain").alias("gross"), F.sum("w").alias("invested"), F.sum("name").alias("names"), F.max("w").alias("heaviest"))
    out = rebalance_dates(rows).join(sums, "ordinal", "left").na.fill(0)
    cost = F.col("turnover") * bps / 1e4
    return out.select("datetime", "ordinal", "turnover", cost.alias("cost"), "gross", (F.col("gross") - cost).alias("net"), "invested", "names", "heaviest")


def portfolio_metrics(ledger: DataFrame, periods: int = 52, cap: float = 0.05) -> DataFrame:
    """Information ratios, compounded yearly returns, drawdown, turnover, invested share, cost, and the safeguards: no
    cost is negative, no more than everything is invested, and no weight is over the cap."""
    rows = wealth(ledger.withColumn("series", F.lit(1)), "net")
    yearly = lambda r: F.pow(F.product(1 + F.col(r)), periods / F.count("*")) - 1
    return rows.agg(
        information_ratio("net", periods).alias("net_ir"),
        information_ratio("gross", periods).alias("gross_ir"),
        yearly("net").alias("annual_net"),
        yearly("gross").alias("annual_gross"),
        F.avg("turnover").alias("mean_turnover"),
        F.avg("invested").alias("mean_invested"),
        F.sum("cost").alias("total_cost"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("names").alias("most_names"),
        F.count("*").alias("periods"),
        F.bool_and((F.col("cost") >= 0) & (F.col("invested") <= 1 + 1e-9) & (F.col("heaviest") <= cap + 1e-9)).alias("safe"),
    )


def mixed(draw, block, seed: int, n: int):
    """A start index from whole-number mixing: the same in every engine."""
    m = 2147483647
    x = (7919 * draw + 104729 * block + seed) % m
    for _ in range(2):
        x = (x * x + 12345) % m
    return x % n


def aligned(candidate: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Periods that both series have, numbered in order from 0: datetime, i, candidate, benchmark. One row a period."""
    both = candidate.select("datetime", "candidate").join(benchmark.select("datetime", "benchmark"), "datetime").where("candidate is not null and benchmark is not null")
    return both.withColumn("i", (F.row_number().over(Window.orderBy("datetime")) - 1).cast("long"))


def bootstrap(pairs: DataFrame, draws: int = 2000, length: int = 4, seed: int = 7, periods: int = 52) -> DataFrame:
    """Circular moving-block bootstrap of the difference of information ratios: point, 2.5 % and 97.5 % quantiles.

    `pairs` has a position i from 0 on, candidate and benchmark: one row per period. A draw is told by the moments of its
    blocks, and a block by two prefix sums of values and squares around the circle, so a draw costs its blocks and not
    its periods. Values are taken off their means first, so that squares don't cancel.
    """
    spark = pairs.sparkSession
    names = ("candidate", "benchmark")
    whole = pairs.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    n, blocks = whole.n, -(-whole.n // length)
    # Around the circle once more, for blocks that begin near its end. One row a period: a calendar, not data.
    off = {c: F.col(c) - F.lit(whole[c]) for c in names}
    circle = pairs.select("i", *[off[c].alias(c) for c in names])
    circle = circle.unionByName(circle.withColumn("i", F.col("i") + n).where(F.col("i") < n + length))
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(x).over(upto), F.lit(0.0)).alias(f"{c}{k}") for c in names for k, x in ((1, F.col(c)), (2, F.col(c) * F.col(c)))]
    nulls = F.coalesce(F.sum(F.when(F.col("candidate").isNull() | F.col("benchmark").isNull(), 1).otherwise(0)).over(upto), F.lit(0)).alias("gaps")
    last = circle.agg(F.lit(n + length).cast("long").alias("i"), *[F.lit(None).cast("double").alias(c) for c in names])
    prefix = cut(circle.unionByName(last).select("i", F.struct(*sums, nulls).alias("p")))
    block = F.col("block")
    taken = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long"))).alias("block"))
    size = F.least(F.lit(length), F.lit(n) - block * length)
    taken = taken.where(F.lit(n > 0)).withColumns({"start": mixed(F.col("draw"), block, seed, max(n, 1)), "size": size}).withColumn("stop", F.col("start") + F.col("size"))
    side = lambda name, as_: broadcast_if_small(prefix.select(F.col("i").alias(name), F.col("p").alias(as_)), 48)
    cut_ = taken.join(side("start", "a"), "start").join(side("stop", "b"), "stop")
    moment = lambda f: F.sum(F.col(f"b.{f}") - F.col(f"a.{f}"))
    total = cut_.groupBy("draw").agg(F.sum("size").alias("n"), moment("gaps").alias("gaps"), *[moment(f"{c}{k}").alias(f"{c}{k}") for c in names for k in (1, 2)])

    def ratio_of(c: str):
        spread = F.sqrt(F.greatest((F.col(f"{c}2") - F.col(f"{c}1") * F.col(f"{c}1") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
        # A draw of one value many times has no spread but for rounding.
        return F.when((F.col("n") > 1) & (F.col("gaps") == 0) & (spread > 1e-12), (F.col(f"{c}1") / F.col("n") + F.lit(whole[c])) / spread * math.sqrt(periods))

    per = total.select((ratio_of("candidate") - ratio_of("benchmark")).alias("d"))
    point = pairs.agg((information_ratio("candidate", periods) - information_ratio("benchmark", periods)).alias("point"))
    usable = F.when(F.count("d") == F.count("*"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))))
    out = per.agg(usable.alias("q"), F.count("*").alias("draws"))
    ok = n >= max(8, 2 * length)
    return out.crossJoin(point).select("point", F.when(F.lit(ok), F.col("q")[0]).alias("low"), F.when(F.lit(ok), F.col("q")[1]).alias("high"), "draws")


def shares(comparison: DataFrame) -> DataFrame:
    """Share of seeds and of folds whose mean delta is positive."""
    share = lambda key: comparison.groupBy(key).agg(F.avg("net_ir_delta").alias("m")).agg(F.avg((F.col("m") > 0).cast("double")).alias(f"{key}_share"))
    return share("seed").crossJoin(share("fold_id"))


def promotion(facts: DataFrame) -> DataFrame:
    """Reasons and decision from seed_share, fold_share, ci_low, best_year_share, stress_ir and hard_failures: their
    names, which come first among the reasons, or their number."""
    hard = F.col("hard_failures")
    listed = facts.schema["hard_failures"].dataType.typeName() == "array"
    count = F.size(F.coalesce(hard, F.array())) if listed else hard
    reason = lambda c, name: F.when(F.expr(c), F.lit(name))
    reasons = F.array_compact(
        F.array(
            reason("seed_share < 0.8", "seed_consistency"),
            reason("fold_share < 0.6", "fold_consistency"),
            reason("ci_low <= 0", "interval_includes_zero"),
            reason("best_year_share > 0.5", "one_year_dominates"),
            reason("stress_ir <= 0", "stress_cost"),
        )
    )
    decision = (
        F.when(count > 0, "REJECT")
        .when(F.size("reasons") == 0, "PROMOTE")
        .when(F.expr("seed_share < 0.5 or fold_share < 0.5 or stress_ir <= 0"), "REJECT")
        .otherwise("HOLD")
    )
    reasons = F.concat(F.coalesce(hard, F.array()), reasons) if listed else reasons
    return facts.withColumn("reasons", reasons).withColumn("decision", decision)
