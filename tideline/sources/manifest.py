"""A matrix published by year under a manifest, and scanned by it.

Every year has a folder of files, and the manifest one row a file: year, name, rows, first and last date, as the files
themselves tell (`_metadata`). A scan names its years: only their folders are listed, never a sealed one, and it raises
unless the files are those of the manifest, hold as many rows, and keep to their year and before the seal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "year int, file string, rows long, first date, last date"


def _files(df: DataFrame, column: str) -> DataFrame:
    per = df.groupBy(F.col("year").cast("int").alias("year"), F.col("_metadata.file_name").alias("file"))
    return per.agg(F.count("*").alias("rows"), F.min(column).alias("first"), F.max(column).alias("last"))


def publish(matrix: DataFrame, path: str, column: str = "datetime") -> DataFrame:
    """Write the matrix and its manifest; returns the manifest. Years are dealt by ranges of the date, so a large one has
    many files and a task few open ones."""
    spark = matrix.sparkSession
    rows = matrix.withColumn("year", F.year(column)).repartitionByRange("year", column)
    rows.write.partitionBy("year").option("compression", "zstd").parquet(f"{path}/data")
    written = spark.read.schema(rows.schema).parquet(f"{path}/data")
    _files(written, column).coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.schema(SCHEMA).parquet(f"{path}/manifest")


def listed(spark: SparkSession, folder: str) -> set[str]:
    """Names of the data files in a folder; none if it is absent."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return {n for n in names if not n.startswith(("_", "."))}


def scan(spark: SparkSession, path: str, years: list[int], columns: dict[str, str], seal: str, column: str = "datetime") -> DataFrame:
    """The named columns of the named years. `seal` is the first day that may not be read."""
    if not years:
        raise ValueError("no years are named")
    if late := [y for y in years if y >= int(seal[:4])]:
        raise ValueError(f"years {late} are sealed")
    # One row a file of the named years: as many as the scan would list anyway.
    manifest = spark.read.schema(SCHEMA).parquet(f"{path}/manifest").where(F.col("year").isin(years)).collect()
    if unknown := sorted(set(years) - {m.year for m in manifest}):
        raise ValueError(f"years {unknown} are not in the manifest")
    folders = {y: f"{path}/data/year={y}" for y in years}
    found = {(y, n) for y, folder in folders.items() for n in listed(spark, folder)}
    declared = {(m.year, m.file): m for m in manifest}
    if found != set(declared):
        gone, more = sorted(set(declared) - found), sorted(found - set(declared))
        raise ValueError(f"files missing: {gone}; files without entry: {more}")
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    rows = spark.read.schema(f"{schema}, year int").option("basePath", f"{path}/data").parquet(*folders.values())
    seen = {(m.year, m.file): m for m in _files(rows.select("year", column, "_metadata"), column).collect()}
    for key, m in sorted(declared.items()):
        s = seen.get(key)
        if (s.rows if s else 0) != m.rows:
            raise ValueError(f"{key[1]} of {key[0]} has {s.rows if s else 0} rows where {m.rows} are declared")
        if s.first is None or s.first.year != key[0] or s.last.year != key[0]:
            raise ValueError(f"{key[1]} of {key[0]} holds dates from {s.first} to {s.last}")
        if str(s.last) >= seal:
            raise ValueError(f"{key[1]} of {key[0]} reaches {s.last}, sealed from {seal}")
    return rows.select(*columns)
