"""Rules that a published panel must keep. Each gives its violations as rows, or raises where nothing may be returned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.safe import holds
from tideline.session import broadcast_if_small

PREFIX = "XSHG_XSHE-"


def session_id(day) -> F.Column:
    return F.concat(F.lit(PREFIX), F.date_format(day, "yyyy-MM-dd"))


def calendar_problems(sessions: DataFrame, seal: str) -> DataFrame:
    """(ordinal, session, problem) of a calendar that must ascend without repeats and end before the seal. One row a
    session, so one ordered pass over it is small."""
    before = F.lag("session").over(Window.orderBy("ordinal"))
    day = F.col("session")
    problem = F.when(day.isNull(), "missing").when(day >= F.lit(seal).cast("date"), "sealed").when(day == before, "repeated").when(day < before, "not ascending")
    return sessions.select("ordinal", "session", problem.alias("problem")).where("problem is not null")


def read_calendar(spark: SparkSession, path: str, schema: str, seal: str) -> DataFrame:
    """A calendar file with its session day from the id; raises if it is empty or breaks a rule."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    day = F.to_date(F.regexp_replace("session_id", f"^{PREFIX}", ""))
    rows = rows.withColumns({"session": day, "ordinal": F.monotonically_increasing_id()})
    found = calendar_problems(rows, seal).first()
    if found or rows.isEmpty():
        raise ValueError(f"the calendar is empty or has a session that is {found.problem}" if found else "the calendar is empty")
    return rows.drop("ordinal")


def read_bound(spark: SparkSession, path: str, years: list[int], columns: dict[str, str], declared: DataFrame, seal: int) -> DataFrame:
    """Chosen years of a written matrix with the agreed columns. Raises unless the rows are as many as declared, keys
    are unique, values are there, no year is sealed and every date lies in the year of its folder."""
    if late := [y for y in years if y >= seal]:
        raise ValueError(f"years {late} are sealed")
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    rows = spark.read.schema(f"{schema}, year int").parquet(path).where(F.col("year").isin(years))
    if stray := rows.where(F.year("datetime") != F.col("year")).first():
        raise ValueError(f"date {stray.datetime} lies in the folder of {stray.year}")
    rows = rows.select(*columns)
    want = declared.where(F.col("year").isin(years)).agg(F.sum("rows")).first()[0] or 0
    gaps = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    seen = rows.agg(F.count("*").alias("_rows"), *gaps).first().asDict()
    if (n := seen.pop("_rows")) != want:
        raise ValueError(f"{n} rows where {want} are declared")
    if missing := [c for c, k in seen.items() if k]:
        raise ValueError(f"missing values in {missing}")
    if not rows.groupBy("datetime", "instrument").count().where("count > 1").isEmpty():
        raise ValueError("repeated keys")
    return rows


def union_scores(parts: list[DataFrame], path: str) -> DataFrame:
    """Scores of several folds end to end, written and read back. Raises if a score is not finite or a key repeats."""
    rows = reduce(DataFrame.unionByName, parts)
    rows.write.option("compression", "zstd").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if not back.where(~holds(F.abs("score") < float("inf"))).isEmpty():
        raise ValueError("a score is missing or not finite")
    if not back.groupBy("datetime", "instrument").count().where("count > 1").isEmpty():
        raise ValueError("a key is scored twice")
    return back


def attach_one(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that must not multiply rows: raises if the right side repeats a key."""
    again = repeated(right, key).first()
    if again:
        raise ValueError(f"{key} {again[0]} occurs {again.n} times on the side to attach")
    return rows.join(right, key, "left")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unknown_sessions(rows: DataFrame, calendar: DataFrame, column: str = "session_id") -> DataFrame:
    """Rows whose session id names no session of the calendar; a missing id names none."""
    known = broadcast_if_small(calendar.select(session_id(F.col("session")).alias(column)).distinct(), 40)
    return rows.join(known, column, "left_anti")


def late_revisions(rows: DataFrame) -> DataFrame:
    """Rows whose revision was not known by the time of prediction, or never."""
    return rows.where(~holds(F.col("revision_known_time") <= F.col("prediction_time")))


def wrong_members(rows: DataFrame) -> DataFrame:
    """Rows whose recorded membership does not hold on their day: announced, begun, not ended."""
    day = F.col("datetime")
    inside = holds(day >= F.col("member_pub")) & holds(day >= F.col("member_from")) & (F.col("member_to").isNull() | holds(day < F.col("member_to")))
    return rows.where(~inside)


def wrong_identities(rows: DataFrame) -> DataFrame:
    """Permanent ids that name several instruments, or are used before they are valid."""
    per = rows.groupBy("permanent_id").agg(F.count_distinct("instrument").alias("instruments"), F.count_if(~holds(F.col("valid_from") <= F.col("datetime"))).alias("early"))
    return per.where("instruments > 1 or early > 0")


def wrong_adjustments(rows: DataFrame) -> DataFrame:
    """Rows that are not raw, or raw with a time of adjustment."""
    return rows.where(~holds(F.col("adjustment_mode") == "RAW") | (F.coalesce("adjustment_time", F.lit("")) != ""))


def wrong_events(journal: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """(row_id, problem) of the first rule that a journal event breaks: version, known run, sequence from 1, an id made of
    run and sequence, flags as its type has them."""
    known = broadcast_if_small(runs.select("run_id").distinct().withColumn("_known", F.lit(True)), 40)
    own = F.concat(F.col("run_id"), F.lit(":"), F.lpad(F.col("event_seq").cast("string"), 6, "0"))
    problem = (
        F.when(~holds(F.col("schema_version") == version), "schema_version")
        .when(F.col("_known").isNull(), "run_id")
        .when(~holds(F.col("event_seq") >= 1), "event_seq")
        .when(~holds(F.col("source_event_id") == own), "source_event_id")
        .when(~(holds(F.col("counts_evaluation") != F.col("counts_fit")) & holds(F.col("counts_fit") == F.col("is_fit"))), "flags")
    )
    return journal.join(known, "run_id", "left").select("row_id", problem.alias("problem")).where("problem is not null")
