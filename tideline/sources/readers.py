"""Scans and sinks: explicit schemas, pruned years, JSON and CSV round trips. Readers and writers are Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import unique_folder


def assert_schema(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    found = dict(df.dtypes)
    wrong = {c: (t, found.get(c)) for c, t in expected.items() if found.get(c) != t}
    if wrong:
        raise ValueError(f"columns differ from the agreed schema: {wrong}")
    return df


def scan_years(rows: DataFrame, column: str, first: int, last: int, columns: list[str], seal: int | None = None) -> DataFrame:
    """Rows of the named years with the named columns; years from the seal on are never read."""
    if seal is not None and last >= seal:
        raise ValueError(f"year {last} is sealed")
    # A range on the column itself reaches the Parquet reader; year(column) would not.
    inside = (F.col(column) >= F.lit(f"{first}-01-01").cast("date")) & (F.col(column) < F.lit(f"{last + 1}-01-01").cast("date"))
    return rows.where(inside).select(*columns)


def before(rows: DataFrame, column: str, cutoff: str) -> DataFrame:
    return rows.where(F.col(column) < F.lit(cutoff).cast("date"))


def write_years(matrix: DataFrame, path: str, column: str = "datetime") -> DataFrame:
    """Write one folder per year, and count the rows that the files hold."""
    years = matrix.withColumn("year", F.year(column))
    years.write.partitionBy("year").option("compression", "zstd").parquet(path)
    written = matrix.sparkSession.read.schema(years.schema).parquet(path)
    return written.groupBy("year").agg(F.count("*").alias("rows"))


#: Equal steps of a key column in which the database counts its rows before an extract.
STEPS = 1024

Cell = tuple[int, int, int]  # first key, key after the last, rows


def extract_ranges(cells: list[Cell], parts: int) -> list[tuple[int, int]]:
    """Half-open ranges of keys with about equally many rows, made of cells in order."""
    share, held, out = sum(n for *_, n in cells) / parts, 0, []
    start = cells[0][0]
    for _, stop, n in cells:
        held += n
        if held >= share:
            out.append((start, stop))
            start, held = stop, 0
    return out + ([(start, cells[-1][1])] if start < cells[-1][1] else [])


def counted_cells(count: Callable[[int, int, int], dict[int, int]], low: int, high: int, most: float) -> list[Cell]:
    """Cells over [low, high) by `count(low, high, width)`, rows of each step; a step with more rows than `most` is
    counted in finer ones."""
    width = max(1, -(-(high - low) // STEPS))
    found = count(low, high, width)
    out: list[Cell] = []
    for k in range(-(-(high - low) // width)):
        a, b, n = low + k * width, min(high, low + (k + 1) * width), found.get(k, 0)
        out += counted_cells(count, a, b, most) if n > most and b - a > 1 else [(a, b, n)]
    return out


def extract_jdbc(spark: SparkSession, url: str, table: str, column: str, parts: int, properties: dict[str, str] | None = None, fetch: int = 10_000) -> DataFrame:
    """A database table read in parallel by ranges of a whole-number column that hold about equally many rows: the
    database counts them in equal steps first. Rows without a key are a range of their own; raises if there is no row."""
    options = {"fetchsize": str(fetch)} | (properties or {})
    ask = lambda sql: spark.read.jdbc(url, f"({sql}) q", properties=options)
    ends = ask(f"select min({column}) lo, max({column}) hi, count(*) n, count({column}) k from {table}").first()
    low, high, n, keys = ends
    if not n:
        raise ValueError(f"{table} has no rows")
    predicates = [f"{column} is null"] if keys < n else []
    if keys:

        def count(a: int, b: int, width: int) -> dict[int, int]:
            step = f"({column} - ({a})) / {width}"
            return {int(r[0]): int(r[1]) for r in ask(f"select s, count(*) n from (select {step} s from {table} where {column} >= {a} and {column} < {b}) t group by s").collect()}

        predicates += [f"{column} >= {a} and {column} < {b}" for a, b in extract_ranges(counted_cells(count, low, high + 1, keys / parts), parts)]
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


RECORD = T.StructType(
    [
        T.StructField("raw_key", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("payload", T.StructType([T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType())])),
    ]
)


def json_round_trip(panel: DataFrame, name: str = "snapshot") -> DataFrame:
    """Rows as nested JSON records, written, read back with a fixed schema, and the date parsed from the key again."""
    path = unique_folder(panel.sparkSession, f"{name}-json")
    key = F.concat_ws(":", "instrument", F.date_format("datetime", "yyyyMMdd"))
    panel.select(key.alias("raw_key"), F.sha2(key, 256).alias("sample_id"), F.struct("close", "volume").alias("payload")).write.json(path)
    back = panel.sparkSession.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    parts = F.split("raw_key", ":")
    return back.select(F.to_date(parts[1], "yyyyMMdd").alias("datetime"), parts[0].alias("instrument"), "sample_id", "payload.close", "payload.volume")


def csv_round_trip(rows: DataFrame, name: str) -> DataFrame:
    path = unique_folder(rows.sparkSession, f"{name}-csv")
    rows.write.option("header", True).csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).csv(path)


def unpivot_long(matrix: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return matrix.unpivot(keys, columns, "feature_name", "feature_value")


def row_keys(long: DataFrame) -> DataFrame:
    day = F.date_format("datetime", "yyyyMMdd")
    return long.withColumns(
        {
            "row_id": F.concat_ws(":", "instrument", day, "feature_name"),
            "revision_id": F.concat_ws(":", F.lit("rev"), "instrument", day),
            "calendar_session_id": F.concat(F.lit("S"), day),
            "adjustment_mode": F.lit("RAW"),
            "adjustment_time": F.lit("").cast("string"),
        }
    )


# Fixed values of the consumed form: constant columns, and those that are empty because nothing is known of them.
CONSTANTS = {
    "ingested_time": "", "parse_ready_time": "", "ingestion_batch_id": "", "ingested_object_sha256": "", "universe_member": "true", "security_status": "ACTIVE", "adjustment_mode": "RAW",
    "adjustment_known_time": "", "adjustment_invariance_pass": "", "halt_time": "", "quote_resume_time": "", "trade_resume_time": "",
}


def consumed(long: DataFrame, times: list[str], product: str, ingested: str, ready: str) -> DataFrame:
    """Long rows as they are consumed: every time as ISO text, missing ones empty, the row's names, and the constants.
    Raises nothing: rows whose value is not finite are left to `checks`."""
    day = F.date_format("datetime", "yyyyMMdd")
    own = CONSTANTS | {"ingested_time": ingested, "parse_ready_time": ready}
    rows = long.withColumns({c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")) for c in times} | {c: F.lit(v) for c, v in own.items()})
    return rows.withColumns(
        {
            "row_id": F.concat_ws(":", "instrument", day, "feature_name"),
            "revision_id": F.concat_ws(":", F.lit(product), "instrument", day),
            "revision_known_time": F.col("vendor_available_time"),
            "calendar_session_id": F.concat(F.lit("XSHG_XSHE-"), F.substring("label_start_time", 1, 10)),
        }
    )


def write_sorted(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write rows in one order over all files, by ranges and not through one task, and read them back. Files are named by
    their range, so their order is that of the rows."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
