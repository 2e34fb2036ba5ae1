"""A ledger of trials that starts are reconciled into, under caps.

The order of the log is distributed: it is range-partitioned, each partition is counted once, and the partitions' sums
added up in order are the offsets of the counts inside them, so that no task orders the whole log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import broadcast_if_small, cut, partitions_for


def running(rows: DataFrame, order: list[str], flags: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Rows with running counts of boolean columns under new names, over all rows in order."""
    ranged = cut(rows.repartitionByRange(*([partitions] if partitions else []), *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(*[F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(f"_{n}") for c, n in flags.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in flags.values()])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = {n: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).over(inside) + F.col(f"_{n}") for c, n in flags.items()}
    return ranged.join(broadcast_if_small(offsets, 32), "_part").withColumns(counted).drop("_part", *[f"_{n}" for n in flags.values()])


def additions(ledger: DataFrame, journal: DataFrame) -> DataFrame:
    """Journal events that the ledger does not have; events it has are left alone, alike or not."""
    return journal.join(ledger.select("source_event_id"), "source_event_id", "left_anti")


def problems(ledger: DataFrame, journal: DataFrame, evaluations: int, fits: int, order: str = "source_event_id") -> DataFrame:
    """(source_event_id, problem) of what keeps a journal from being appended: a `conflict` with a known event of the
    same id, a `repeated_event`, an evaluation or fit id that old and new events together use twice
    (`repeated_evaluation`, `repeated_fit`), and every addition with which a total goes over its cap (`evaluation_cap`,
    `fit_cap`), in the order of their ids after all events of the ledger."""
    # Tasks hold a bounded number of ids: these rows are so narrow that one file split, or one partition that adaptive
    # execution puts together, has many millions of them.
    n = partitions_for(journal.sparkSession, ledger.count() + journal.count())
    whole, ledger, journal = ledger, *(df.repartition(n, "source_event_id") for df in (ledger, journal))
    known = ledger.select("source_event_id", F.col("event").alias("old"), F.col("evaluation_id").alias("old_e"), F.col("fit_id").alias("old_f"))
    both = journal.join(known, "source_event_id")
    unlike = ~F.col("event").eqNullSafe(F.col("old")) | ~F.col("evaluation_id").eqNullSafe(F.col("old_e")) | ~F.col("fit_id").eqNullSafe(F.col("old_f"))
    named = lambda df, text: df.select("source_event_id", F.lit(text).alias("problem"))
    found = named(both.where(unlike), "conflict")
    found = found.unionByName(named(journal.groupBy("source_event_id").count().where("count > 1"), "repeated_event"))
    names = ["source_event_id", "evaluation_id", "fit_id"]
    new = cut(additions(ledger, journal).select(*names, F.col(order).alias("_at")).dropDuplicates(["source_event_id"]))
    everything = whole.select(*names, F.lit(False).alias("new")).unionByName(new.select(*names, F.lit(True).alias("new")))
    for column, text in (("evaluation_id", "repeated_evaluation"), ("fit_id", "repeated_fit")):
        twice = everything.where(F.col(column).isNotNull()).repartition(n, column).groupBy(column).agg(F.count("*").alias("n"), F.max("new").alias("any_new")).where("n > 1 and any_new")
        found = found.unionByName(named(new.join(broadcast_if_small(twice.select(column), 40), column, "left_semi"), text))
    spent = whole.agg(F.count("evaluation_id").alias("e"), F.count("fit_id").alias("f")).first()
    counted = running(new.withColumns({"is_e": F.col("evaluation_id").isNotNull(), "is_f": F.col("fit_id").isNotNull()}), ["_at", "source_event_id"], {"is_e": "n_e", "is_f": "n_f"}, n)
    found = found.unionByName(named(counted.where(F.col("is_e") & (F.col("n_e") + spent.e > evaluations)), "evaluation_cap"))
    return found.unionByName(named(counted.where(F.col("is_f") & (F.col("n_f") + spent.f > fits)), "fit_cap"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed batches of a ledger, empty where none is."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch=*")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(spark: SparkSession, path: str, journal: DataFrame, evaluations: int, fits: int) -> int:
    """Append a journal's new starts to the ledger under `path` as one batch, and return how many; the second time there
    are none. Raises with the first problem before anything is written.

    A batch is written aside and then renamed to its number. Renaming fails where the name is taken, so of two writers
    that read the same ledger one has to begin again, and no half batch is ever seen.
    """
    columns = ["source_event_id", "event", "evaluation_id", "fit_id"]
    journal = journal.select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in journal.schema.fields)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # The number is taken before the ledger is read: a batch that comes in meanwhile has it too.
    batches = [s.getPath().getName() for s in files.listStatus(at(path))] if files.exists(at(path)) else []
    number = 1 + max([int(b.split("=")[1]) for b in batches if b.startswith("batch=")], default=0)
    ledger = cut(read_ledger(spark, path, schema))
    if bad := problems(ledger, journal, evaluations, fits).orderBy("source_event_id", "problem").first():
        raise ValueError(f"event {bad.source_event_id}: {bad.problem}")
    new = cut(additions(ledger, journal))
    if not (n := new.count()):
        return 0
    aside, place = at(f"{path}/_new-{number}"), at(f"{path}/batch={number}")
    new.write.mode("overwrite").parquet(aside.toString())
    if files.exists(place) or not files.rename(aside, place):
        raise RuntimeError(f"batch {number} was committed meanwhile; read the ledger again")
    return n
