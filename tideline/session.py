"""Session settings in one place, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tideline")
        .config(map=SETTINGS)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a temporary one stands in, but only on a local master:
    executors elsewhere would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/tideline-{spark.sparkContext.applicationId}"


def unique_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, so that two runs never write to one place."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete the tables that this application has cut. Results not yet read are lost; call it when all are."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame as a table in the shared folder and read it back: nothing before it is computed again.

    A table, and not checkpoint(), because it is compressed and columnar, and because a checkpoint carries the plan's
    inferred constraints along, which grow without end in the iterative operators.
    """
    path = unique_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


#: Rows of a batch between the JVM and Python where the session leaves Spark's 10,000: rows here are whole texts.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers, which on a cluster (or from another folder) can't import it otherwise."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId not in _shipped:
        root = Path(__file__).parent
        name = Path(tempfile.mkdtemp(prefix="spark-")) / "tideline_package.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(name))
        _shipped.add(sc.applicationId)
    return spark


#: Bytes of a method beyond which the JVM interprets it for good; Spark's default lets whole stages grow past that.
METHOD_BYTES = 8000


def compilable(spark: SparkSession) -> SparkSession:
    """Split generated code that the JVM would never compile, where the session leaves Spark's default: rows with many
    computed columns otherwise run interpreted, several times as long."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)
    return spark


#: Rows that a task of a wide shuffle sorts or groups.
TASK_ROWS = 500_000


def partitions_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Partitions for a shuffle of so many rows: those of the session, or more, so that a task's memory does not grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Mark a side for broadcasting if its counted rows stay under a size bound; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
