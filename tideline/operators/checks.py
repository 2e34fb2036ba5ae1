"""Data-quality and leakage checks; each returns its violations, or one row of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.safe import any_of
from tideline.operators.features import FEATURE_COLUMNS, features
from tideline.operators.profiles import n_if, replay_differences
from tideline.session import cut


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), *[n_if(F.col(c).isNull()).alias(c) for c in columns])


def nonfinite_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.agg(*[n_if(bad(F.col(c))).alias(c) for c in columns])


def past_seal(rows: DataFrame, boundary: str, column: str = "datetime") -> DataFrame:
    return rows.where(F.col(column) >= F.lit(boundary).cast("date"))


def wrong_partition(rows: DataFrame, partition: str, column: str = "datetime") -> DataFrame:
    return rows.where(F.col(partition) != F.year(column))


def time_order(rows: DataFrame) -> DataFrame:
    """How many rows break event <= published <= vendor <= prediction < tradable = label start < label end."""
    pairs = {"event_after_published": "event_time > published_time", "published_after_vendor": "published_time > vendor_time", "vendor_after_prediction": "vendor_time > prediction_time", "prediction_not_before_tradable": "prediction_time >= tradable_time", "tradable_not_label_start": "tradable_time <> label_start_time", "label_start_not_before_end": "label_start_time >= label_end_time"}
    return rows.agg(F.count("*").alias("rows"), *[n_if(F.expr(c)).alias(k) for k, c in pairs.items()])


def declared_against_observed(observed: DataFrame, declared: DataFrame, key: str, value: str) -> DataFrame:
    return replay_differences(observed, declared, [key], value)


def score_contract(scores: DataFrame, folds: int, boundary: str) -> DataFrame:
    """One row: rows, distinct keys, missing scores, models, folds, late rows, and whether all is as agreed. Rows are
    stored with the columns that count; each key is met once, models and folds in a table of their few pairs."""
    late = F.col("datetime") >= F.lit(boundary).cast("date")
    keys = ("datetime", "instrument", "fold_id")
    rows = cut(scores.select(*keys, "model_id", F.col("score").isNull().alias("gone"), late.alias("late")))
    pairs = rows.groupBy("fold_id", "model_id").agg(F.count("*").alias("n"), n_if(F.col("gone")).alias("gone"), n_if(F.col("late")).alias("late"))
    out = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("gone"), F.lit(0)).alias("missing"),
        F.count_distinct("model_id").alias("models"),
        F.count_distinct("fold_id").alias("folds"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late"),
    )
    met = rows.select(*keys).na.drop().distinct().agg(F.count("*").alias("keys"))
    out = out.crossJoin(met).select("rows", "keys", "missing", "models", "folds", "late")
    return out.withColumn("ok", F.expr(f"rows = keys and missing = 0 and models = 1 and folds = {folds} and late = 0"))


def keys_differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side that the other lacks, both ways; each side is read once. A missing value equals nothing."""
    sides = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(*keys, F.lit(0), F.lit(1)))
    met = sides.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    alone = (F.col("_a") != F.col("_b")) | any_of([F.col(k).isNull() for k in keys])
    side = F.array_compact(F.array(F.when(F.col("_a") == 1, "left"), F.when(F.col("_b") == 1, "right")))
    return met.where(alone).select(*keys, F.explode(side).alias("side"))


def rectangular(long: DataFrame, sample: list[str], features_: int) -> DataFrame:
    """Samples whose number of feature rows is not the expected one."""
    return long.groupBy(*sample).agg(F.count("*").alias("n")).where(F.col("n") != features_)


def incomplete_cells(long: DataFrame, sample: list[str], names: list[str]) -> DataFrame:
    """Sample and feature pairs without a row: expected pairs come from exploding a fixed list of names."""
    expected = long.select(*sample).distinct().withColumn("feature_name", F.explode(F.array(*[F.lit(n) for n in names])))
    return expected.join(long.select(*sample, "feature_name"), [*sample, "feature_name"], "left_anti")


def future_poison(panel: DataFrame, protected: str, factor: float = 1_000_003.0, build=features, columns: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """Rows up to the protected date, and how many of their features change, when every later amount is multiplied:
    none may."""
    return future_poisons(panel, protected, {"": columns}, factor, build).drop("variant")


def future_poisons(panel: DataFrame, protected: str, variants: dict[str, tuple[str, ...]], factor: float = 1_000_003.0, build=features) -> DataFrame:
    """The same for several named sets of columns that `build` makes together. It builds on the panel and then, on the
    same rows with their later amounts multiplied, once more: what is shuffled and sorted by instrument stays so, and a
    row is compared with itself. `build` has to keep rows and the columns that it does not make."""
    later = F.col("datetime") > F.lit(protected).cast("date")
    keys = ("datetime", "instrument")
    columns = dict.fromkeys(c for own in variants.values() for c in own)
    raw = F.struct(*[c for c in panel.columns if c not in keys])
    first = build(panel.withColumn("_raw", raw)).select(*keys, "_raw.*", F.when(~later, F.struct(*columns)).alias("_own"))
    bitten = first.withColumn("amount", F.when(later, F.col("amount") * factor).otherwise(F.col("amount")))
    rows = build(bitten).where(~later)
    changed = lambda own: sum((F.when(F.col(f"_own.{c}").eqNullSafe(F.col(c)), 0).otherwise(1) for c in own), F.lit(0))
    found = F.array(*[F.struct(F.lit(n).alias("variant"), changed(own).alias("changed")) for n, own in variants.items()])
    return rows.select(*keys, F.explode(found).alias("f")).select("f.variant", *keys, "f.changed").where("changed > 0")


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Digest of a keyed set in two levels: a digest per date, then one of the dates' digests in order."""
    line = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    per = rows.groupBy("datetime").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("datetime", "digest")))
    return per.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), "\n"), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def reconcile(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """What to append (events not in the ledger) and what conflicts (same id, another payload)."""
    new = journal.join(ledger.select("source_event_id"), "source_event_id", "left_anti").select("source_event_id", "event", F.lit("append").alias("kind"))
    both = journal.join(ledger.select("source_event_id", F.col("event").alias("known")), "source_event_id").where("event <> known")
    return new.unionByName(both.select("source_event_id", "event", F.lit("conflict").alias("kind")))


def invalid_events(journal: DataFrame) -> DataFrame:
    """Events with a wrong schema version or with flags that disagree."""
    version = F.when(F.col("schema_version") != "v1", F.lit("schema_version"))
    flags = F.when(F.col("counts_evaluation") & F.col("counts_fit"), F.lit("both_flags"))
    return journal.withColumn("problem", F.coalesce(version, flags)).where("problem is not null").select("source_event_id", "problem")


def missing_starts(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    return journal.join(ledger, "source_event_id", "left_anti").select("source_event_id")
