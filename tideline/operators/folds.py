"""Walk-forward folds: annual train, validation and test ranges, purged and embargoed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import broadcast_if_small


def annual_folds(spark: SparkSession, first_train_year: int, first_test_year: int, last_test_year: int, train_years: int) -> DataFrame:
    """Folds of the given test years, one year each after one of validation."""
    years = spark.range(first_test_year, last_test_year + 1).select(F.col("id").cast("int").alias("y"), F.lit(first_train_year).alias("first"))
    return _ranges(years, train_years)


def calendar_folds(calendar: DataFrame, train_years: int, wait: int = 4, seal: int | None = None) -> DataFrame:
    """Folds of every year of a calendar that has `wait` years before it; years from the seal on have none."""
    year = F.year("session")
    first = calendar.agg(F.min(year).alias("first"))
    years = calendar.select(year.alias("y")).distinct().crossJoin(first).where(F.col("y") >= F.col("first") + wait)
    return _ranges(years if seal is None else years.where(F.col("y") < seal), train_years)


def _ranges(years: DataFrame, train_years: int) -> DataFrame:
    y = F.col("y")
    day = lambda year, text: F.to_date(F.concat(year.cast("string"), F.lit(text)))
    begin = F.greatest(y - 1 - train_years, F.col("first"))
    return years.select(
        F.concat(F.lit("wf_"), y.cast("string")).alias("fold_id"),
        day(begin, "-01-01").alias("train_start"),
        day(y - 2, "-12-31").alias("train_end"),
        day(y - 1, "-01-01").alias("valid_start"),
        day(y - 1, "-12-31").alias("valid_end"),
        day(y, "-01-01").alias("test_start"),
        day(y, "-12-31").alias("test_end"),
    )


def embargoed(folds: DataFrame, calendar: DataFrame, sessions: int) -> DataFrame:
    """The session `sessions` after the first one of the validation and test ranges."""
    out = folds
    for part in ("valid", "test"):
        first = folds.join(calendar, F.col("session") >= F.col(f"{part}_start")).groupBy("fold_id").agg(F.min("pos").alias("p"))
        at = first.join(calendar, F.col("pos") == F.col("p") + sessions, "left").select("fold_id", F.col("session").alias(f"{part}_from"))
        out = out.join(at, "fold_id", "left")
    return out


def purged_segments(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows by fold and segment. Training and validation labels must end before the next range starts; the test range is
    embargoed but not purged. The fold table has one row per year."""
    d, e = F.col("datetime"), F.col("label_end")
    segment = (
        F.when(d.between(F.col("train_start"), F.col("train_end")) & (e < F.col("valid_start")), "train")
        .when((d >= F.col("valid_from")) & (d <= F.col("valid_end")) & (e < F.col("test_start")), "valid")
        .when((d >= F.col("test_from")) & (d <= F.col("test_end")), "test")
    )
    hit = d.between(F.col("train_start"), F.col("test_end"))
    return rows.join(broadcast_if_small(folds, 128), hit).withColumn("segment", segment).where("segment is not null")


def overlapping_labels(tagged: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of a training or validation part whose label ends on or after the start of the part that follows."""
    starts = broadcast_if_small(folds.select("fold_id", F.col("valid_start").alias("_v"), F.col("test_start").alias("_t")), 48)
    after = F.when(F.col("segment") == "train", F.col("_v")).when(F.col("segment") == "valid", F.col("_t"))
    return tagged.join(starts, "fold_id").where(F.col("label_end") >= after).drop("_v", "_t")


def require_segments(tagged: DataFrame, folds: DataFrame, names: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """The bounds of every fold's parts; raises if a part of a fold has no row."""
    bounds = segment_bounds(tagged)
    wanted = folds.select("fold_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("segment"))
    if empty := wanted.join(bounds, ["fold_id", "segment"], "left_anti").orderBy("fold_id", "segment").first():
        raise ValueError(f"the {empty.segment} part of {empty.fold_id} is empty")
    return bounds


def segment_bounds(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("fold_id", "segment").agg(F.min("datetime").alias("first_date"), F.max("datetime").alias("last_date"), F.count("*").alias("rows"))


def standardizer(tagged: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation per fold over its training rows; a deviation under 1e-12 or missing counts as 1."""
    aggs = []
    for c in columns:
        s = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(s >= 1e-12, s).otherwise(F.lit(1.0)).alias(f"{c}_scale")]
    return tagged.where("segment = 'train'").groupBy("fold_id").agg(*aggs)


def standardized(tagged: DataFrame, fitted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    rows = tagged.join(broadcast_if_small(fitted, 32 + 16 * len(columns)), "fold_id", "left")
    return rows.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in columns}).drop(*fitted.columns[1:])


def overlapping_keys(tagged: DataFrame) -> DataFrame:
    """Keys that lie in more than one segment of a fold."""
    return tagged.groupBy("fold_id", "datetime", "instrument").agg(F.count_distinct("segment").alias("n")).where("n > 1")


def out_of_order(bounds: DataFrame) -> DataFrame:
    """Segments that start before the one before has ended."""
    rank = F.when(F.col("segment") == "train", 0).when(F.col("segment") == "valid", 1).otherwise(2)
    w = Window.partitionBy("fold_id").orderBy(rank)
    return bounds.withColumn("before", F.lag("last_date").over(w)).where("first_date <= before")


def prepare(panel: DataFrame, segments: dict, column_sets: dict, segment: str, column_set: str) -> DataFrame:
    """The rows of a named segment (inclusive dates) with the columns of a named set; unknown names are errors."""
    first, last = segments[segment]
    inside = F.col("datetime").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return panel.where(inside).select("datetime", "instrument", *column_sets[column_set])
