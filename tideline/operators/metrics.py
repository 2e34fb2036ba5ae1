"""Cross-sectional and series metrics. Ranks are per date (`ranks`); totals combine by aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ranks
from tideline.session import cut


def rank_ic(rows: DataFrame, score: str = "score", label: str = "label", least: int = 3, most: int = ranks.MOST) -> DataFrame:
    """Spearman correlation per date over complete rows; missing for few rows or a constant side."""
    full = cut(rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select("datetime", F.col(score).alias("score"), F.col(label).alias("label")))
    ranked = ranks.average_ranks(full, {"score": "_s", "label": "_l"}, most=most)
    ic = F.try_divide(F.covar_pop("_s", "_l"), F.stddev_pop("_s") * F.stddev_pop("_l"))
    return ranked.groupBy("datetime").agg(F.when(F.count("*") >= least, ic).alias("rank_ic"), F.count("*").alias("n"))


def ic_summary(ic: DataFrame) -> DataFrame:
    rows = ic.agg(F.avg("rank_ic").alias("mean"), F.stddev_samp("rank_ic").alias("std"), F.avg(F.coalesce(F.round("rank_ic", 12) > 0, F.lit(False)).cast("double")).alias("pos"), F.count("rank_ic").alias("dates"), F.sum("n").alias("observations"))
    return rows.select(
        F.col("mean").alias("rank_ic_mean"), F.col("std").alias("rank_ic_std"), F.try_divide("mean", "std").alias("rank_icir"), F.col("pos").alias("rank_ic_positive_fraction"), "observations", "dates"
    )


def by_fold(scored: DataFrame) -> DataFrame:
    """IC summary of each fold's scores and, as fold `all`, of all folds' dates together."""
    tagged = scored.withColumn("datetime", F.struct("fold_id", "datetime"))
    ic = rank_ic(tagged).select("datetime.fold_id", "rank_ic", "n")
    both = ic.unionByName(ic.withColumn("fold_id", F.lit("all")))
    return both.groupBy("fold_id").agg(F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_samp("rank_ic").alias("rank_ic_std"), F.sum("n").alias("observations"), F.count("rank_ic").alias("dates"))


def buckets(rows: DataFrame, score: str = "score", groups: int = 10, most: int = ranks.MOST) -> DataFrame:
    """Percentile bucket of each complete row within its date; dates with fewer rows than buckets are left out."""
    full = cut(rows.where(F.col(score).isNotNull() & F.col("label").isNotNull()))
    ranked = ranks.numbered(full, score, "instrument", "_r", "_n", most=most).where(F.col("_n") >= groups)
    return ranked.withColumn("bucket", F.least(F.ceil(F.col("_r") / F.col("_n") * groups), F.lit(groups)).cast("int")).drop("_n", "_r")


def bucket_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.avg("label").alias("mean_label"), F.count("*").alias("rows"))


def decile_slope(means: DataFrame) -> DataFrame:
    """Least-squares slope of bucket means, and top minus bottom; both missing under two buckets."""
    return means.agg(
        F.try_divide(F.covar_pop("bucket", "mean_label"), F.var_pop("bucket")).alias("decile_slope"),
        F.when(F.count("*") > 1, F.max_by("mean_label", "bucket") - F.min_by("mean_label", "bucket")).alias("top_minus_bottom"),
    )


def information_ratio(returns: str = "net", periods: int = 52):
    """Annualised mean over sample deviation; missing under two values or without variation."""
    return F.when(F.stddev_samp(returns) > 0, F.avg(returns) / F.stddev_samp(returns) * math.sqrt(periods))


def wealth(rows: DataFrame, returns: str, order: str = "datetime", by: str = "series") -> DataFrame:
    """Compounded wealth, its running peak (from the first value on) and the drawdown, per series. A product, and not
    a sum of logarithms: a return of -1 or less is a value like any other."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("wealth", F.product(1 + F.coalesce(F.col(returns), F.lit(0.0))).over(w))
    return out.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)


def concordance(p: str, y: str):
    """1 - 2 cov / (var + var + (difference of means)^2 + 1e-8); squared error for fewer than two rows."""
    gap = F.avg(p) - F.avg(y)
    ccc = 1 - 2 * F.covar_pop(p, y) / (F.var_pop(p) + F.var_pop(y) + gap * gap + 1e-8)
    return F.when(F.count("*") < 2, F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))).otherwise(ccc)


def date_mse(rows: DataFrame, p: str, y: str) -> DataFrame:
    per = rows.groupBy("datetime").agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("mse"))
    return per.agg(F.avg("mse").alias("date_balanced_mse"), F.count("*").alias("dates"))


def long_short(rows: DataFrame, groups: int = 10) -> DataFrame:
    """Per date: mean label of the top bucket, of the bottom one, their difference, and the mean of all."""
    g = rows.groupBy("datetime").agg(
        F.avg(F.when(F.col("bucket") == groups, F.col("label"))).alias("top"), F.avg(F.when(F.col("bucket") == 1, F.col("label"))).alias("bottom"), F.avg("label").alias("average")
    )
    return g.withColumn("long_short", F.col("top") - F.col("bottom"))
