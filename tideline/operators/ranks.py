"""Ranks and medians inside a date, without one task per date.

Dates with more than `most` rows are cut by value: quantiles from a bounded sketch give splits, and a row's part is told
by the splits below its value, so parts of a date are in order and equal values never lie in two of them. Values that
are a split have a part of their own; where one value fills a part, however many rows share it, nothing is left to sort.
Counts of the parts, added up in order, are the offsets of the ranks inside them. Dates of usual size are one part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import broadcast_if_small, cut

#: Rows of a date that one task sorts.
MOST = 1_000_000
#: Most splits of a date; beyond MOST times this a part holds more than MOST rows.
SPLITS = 5_000


def crowded(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    return cut(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most))


def parted(rows: DataFrame, value: Column, by: list[str], many: DataFrame, most: int, name: str = "_part") -> DataFrame:
    """Rows with their part of the crowded groups `many`, 0 elsewhere; `value` is a number and never missing."""
    top = many.agg(F.max("_n")).first()[0]
    if not top:
        return rows.withColumn(name, F.lit(0))
    parts = min(math.ceil(2 * top / most), SPLITS)
    few = broadcast_if_small(many.select(*by), 64)
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    splits = cut(rows.join(few, by, "left_semi").groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, at, 20 * parts)).alias("_splits")))
    inside = rows.join(broadcast_if_small(splits, 64 + 8 * parts), by, "left")
    below = F.size(F.filter("_splits", lambda s: s < value)) * 2 + F.array_contains("_splits", value).cast("int")
    return inside.withColumn(name, F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(below)).drop("_splits")


def tallied(rows: DataFrame, value: Column, by: list[str], part: str = "_part") -> DataFrame:
    """(by, part, _size, _low, _high, _before): parts with their rows, ends, and the rows of their group before them."""
    sizes = rows.groupBy(*by, part).agg(F.count("*").alias("_size"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return cut(sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))))


def average_ranks(rows: DataFrame, columns: dict[str, str], by: str = "datetime", most: int = MOST) -> DataFrame:
    """Rows with the rank of each column in its group under a new name; ties share their mean rank."""
    many = crowded(rows, [by], most)
    usual = many.isEmpty()
    for column, name in columns.items():
        if usual:
            w = Window.partitionBy(by).orderBy(column)
            rank = F.rank().over(w) + (F.count("*").over(Window.partitionBy(by, column)) - 1) / 2
            rows = rows.withColumn(name, rank)
            continue
        inside = parted(rows, F.col(column), [by], many, most)
        parts = tallied(inside, F.col(column), [by]).withColumn("_one", F.col("_low") == F.col("_high")).drop("_low", "_high")
        # Rows of a part with one value need no order and are left where they are.
        inside = inside.join(broadcast_if_small(parts, 64), [by, "_part"]).withColumn("_stay", F.when(F.col("_one"), F.spark_partition_id()).otherwise(-1))
        own = [by, "_part", "_stay"]
        local = F.rank().over(Window.partitionBy(*own).orderBy(column)) + (F.count("*").over(Window.partitionBy(*own, column)) - 1) / 2
        rank = F.col("_before") + F.when(F.col("_one"), (F.col("_size") + 1) / 2).otherwise(local)
        rows = inside.withColumn(name, rank).drop("_part", "_size", "_before", "_one", "_stay")
    return rows


def leading(text: str) -> Column:
    """The first seven bytes of a text as a number in the order of its bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(text), "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def numbered(rows: DataFrame, column: str, tie: str, number: str, count: str, by: str = "datetime", descending: bool = False, most: int = MOST) -> DataFrame:
    """Rows with their number in their group, by column (descending if asked) and then by the text `tie`, and with the
    group's count. Rows of one value that fill a part are cut by the text."""
    many = crowded(rows, [by], most)
    order = [F.desc(column) if descending else F.asc(column), F.asc(tie)]
    if many.isEmpty():
        return rows.withColumns({count: F.count("*").over(Window.partitionBy(by)), number: F.row_number().over(Window.partitionBy(by).orderBy(*order))})
    value = -F.col(column) if descending else F.col(column)
    inside = parted(rows, value, [by], many, most)
    inside = parted(inside, leading(tie), [by, "_part"], crowded(inside, [by, "_part"], most), most, "_sub").withColumn("_part", F.struct("_part", "_sub")).drop("_sub")
    parts = tallied(inside, value, [by]).select(by, "_part", "_before", F.sum("_size").over(Window.partitionBy(by)).alias(count))
    inside = inside.join(broadcast_if_small(parts, 64), [by, "_part"])
    return inside.withColumn(number, (F.col("_before") + F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).cast("int")).drop("_part", "_before")


def medians(rows: DataFrame, columns: dict[str, str], by: str = "datetime", most: int = MOST) -> DataFrame:
    """One row per group: the exact median of each column, by name. Groups of usual size are sorted whole; of crowded
    ones only the part that holds the middle is looked at again, until it is one value or fits."""
    many = crowded(rows, [by], most)
    usual = rows if many.isEmpty() else rows.join(broadcast_if_small(many.select(by), 32), by, "left_anti")
    out = usual.groupBy(by).agg(*[F.median(c).alias(n) for c, n in columns.items()])
    if many.isEmpty():
        return out
    found = None
    for column, name in columns.items():
        near = rows.join(broadcast_if_small(many.select(by), 32), by, "left_semi").select(by, F.col(column).alias("_v")).where("_v is not null")
        size = near.groupBy(by).agg(F.count("*").alias("_n"))
        places = size.select(by, F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))).alias("place"))
        middle = selected(near, places, by, most).groupBy(by).agg(F.avg("value").alias(name))
        middle = many.select(by).join(middle, by, "left")
        found = middle if found is None else found.join(middle, by)
    return out.unionByName(cut(found))


def selected(near: DataFrame, places: DataFrame, by: str, most: int) -> DataFrame:
    """(by, place, value): the value `_v` at each place (from 0) of the order of its group."""
    rows = near.withColumn("_path", F.lit(""))
    open_ = cut(places.select(by, "place", F.lit("").alias("_path"), F.col("place").alias("left")))
    found = None
    while True:
        own = [by, "_path"]
        many = crowded(rows, own, most)
        inside = cut(parted(rows, F.col("_v"), own, many, most))
        parts = tallied(inside, F.col("_v"), own)
        hit = cut(open_.join(parts, own).where((F.col("_before") <= F.col("left")) & (F.col("left") < F.col("_before") + F.col("_size"))))
        one = F.col("_low") == F.col("_high")
        done = hit.where(one).select(by, "place", F.col("_low").alias("value"))
        fits = hit.where(~one & (F.col("_size") <= most))
        values = inside.join(broadcast_if_small(fits.select(*own, "_part").distinct(), 64), [*own, "_part"], "left_semi").groupBy(*own, "_part").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        done = done.unionByName(fits.join(values, [*own, "_part"]).select(by, "place", F.get("_all", (F.col("left") - F.col("_before")).cast("int")).alias("value")))
        found = done if found is None else found.unionByName(done)
        again = hit.where(~one & (F.col("_size") > most))
        if again.isEmpty():
            return found
        path = F.concat(F.col("_path"), F.lit("/"), F.col("_part").cast("string"))
        few = broadcast_if_small(again.select(*own, "_part").distinct(), 64)
        rows = inside.join(few, [*own, "_part"], "left_semi").select(by, "_v", path.alias("_path"))
        open_ = cut(again.select(by, "place", path.alias("_path"), (F.col("left") - F.col("_before")).alias("left")))
