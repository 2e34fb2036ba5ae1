"""Daily market state: one row per date from the eligible cross-section, with digests of its keys and values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.safe import holds
from tideline.operators import ranks
from tideline.session import broadcast_if_small, cut

# What makes a row part of the population, and the state's sources.
REQUIRED = ("universe_member", "listing_age_eligible", "is_active", "price_domain_valid", "feature_eligible")
REFUSED = ("special_status_forbidden", "special_status_unknown")
SOURCES = ("ret_mean_20", "ret_std_20", "ret_1d", "turnover_mean_20")


def state_population(panel: DataFrame) -> DataFrame:
    """The rows of the daily state: all seven flags must be there, five hold and two don't, and the sources are known."""
    if missing := [c for c in (*REQUIRED, *REFUSED) if c not in panel.columns]:
        raise ValueError(f"the state's population needs the flags {missing}")
    return population(panel)


def population(panel: DataFrame) -> DataFrame:
    """The same by those of the flags that the panel has."""
    ok = [holds(F.col(c)) for c in REQUIRED if c in panel.columns] + [~F.coalesce(F.col(c), F.lit(True)) for c in REFUSED if c in panel.columns]
    for c in SOURCES:
        ok.append(F.col(c).isNotNull())
    rows = panel
    for c in ok:
        rows = rows.where(c)
    return rows.select("datetime", "instrument", *SOURCES)


#: Keys of a date whose digest is made from a sorted list; more are streamed through the hash in order.
LISTED = 10_000


def keyset_digests(rows: DataFrame, most: int = LISTED) -> DataFrame:
    """(datetime, digest): SHA-256 of a date's sorted instruments, each followed by NUL."""
    many = ranks.crowded(rows, ["datetime"], most)
    nul = F.lit("\0")
    listed = lambda df: df.groupBy("datetime").agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("instrument")), "\0"), nul), 256).alias("digest"))
    if many.isEmpty():
        return listed(rows)
    few = broadcast_if_small(many.select("datetime"), 16)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, hash_ = None, None
        for batch in batches:
            for d, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hash_ is None or d != day:
                    if hash_ is not None:
                        yield pa.RecordBatch.from_pylist([{"datetime": day, "digest": hash_.hexdigest()}])
                    day, hash_ = d, hashlib.sha256()
                hash_.update(name.encode() + b"\0")
        if hash_ is not None:
            yield pa.RecordBatch.from_pylist([{"datetime": day, "digest": hash_.hexdigest()}])

    sorted_ = rows.join(few, "datetime", "left_semi").select("datetime", "instrument").repartition("datetime").sortWithinPartitions("datetime", "instrument")
    return listed(rows.join(few, "datetime", "left_anti")).unionByName(sorted_.mapInArrow(streamed, "datetime date, digest string"))


def daily_state(rows: DataFrame, most: int = ranks.MOST, listed: int = LISTED) -> DataFrame:
    """mean trend, median volatility, share of risers, median turnover, count, and the digest of the date's keys; stored,
    one row a date, since it is counted and joined several times."""
    rows = cut(rows.select("datetime", "instrument", *SOURCES))
    sums = rows.groupBy("datetime").agg(F.avg("ret_mean_20").alias("mkt_trend_20"), F.avg((F.col("ret_1d") > 0).cast("double")).alias("mkt_breadth_1d"), F.count("*").alias("population_count"))
    middle = ranks.medians(rows, {"ret_std_20": "mkt_vol_20", "turnover_mean_20": "mkt_turnover_20"}, most=most)
    digests = keyset_digests(rows, listed).withColumnRenamed("digest", "population_keyset_sha256")
    out = sums.join(middle, "datetime").join(digests, "datetime")
    return cut(out.select("datetime", "mkt_trend_20", "mkt_vol_20", "mkt_breadth_1d", "mkt_turnover_20", "population_count", "population_keyset_sha256"))


def state_digest(state: DataFrame, columns: tuple[str, ...], digits: int = 4) -> DataFrame:
    """Digest of a date's count, keys and values in canonical text; a half is rounded up, whatever its last bits are."""
    head = [F.date_format("datetime", "yyyy-MM-dd"), F.col("population_count").cast("string"), F.col("population_keyset_sha256")]
    text = F.concat_ws("|", *head, *[F.coalesce(F.round(F.col(c) + 1e-9, digits).cast("decimal(38,4)").cast("string"), F.lit("")) for c in columns])
    return state.withColumn("state_sha256", F.sha2(text, 256))


def wrong_digests(now: DataFrame, stored: DataFrame, names: dict[str, str]) -> DataFrame:
    """(datetime, problem): the first digest of a date that is not the stored one; a date that one side lacks is
    `missing`."""
    a, b = now.select("datetime", F.struct(*names).alias("a")), stored.select("datetime", F.struct(*names).alias("b"))
    problem = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing")
    for column, name in names.items():
        problem = problem.when(~F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}")), name)
    return a.join(b, "datetime", "full").select("datetime", problem.alias("problem")).where("problem is not null")


def join_state(rows: DataFrame, state: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """State by exact date; one row per date, broadcast if that is small."""
    return rows.join(broadcast_if_small(state.select("datetime", *columns), 8 + 8 * len(columns)), "datetime", "left")


def constant_within_date(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Dates on which a state column takes more than one value."""
    uneven = [F.max(c) != F.min(c) for c in columns]
    bad = uneven[0]
    for u in uneven[1:]:
        bad = bad | u
    return rows.groupBy("datetime").agg(bad.alias("bad")).where("bad").select("datetime")


def gate_scale(rows: DataFrame, hidden: str, state: tuple[str, ...], weights: tuple[float, ...], bias: float) -> DataFrame:
    """hidden * 2 * sigmoid(weights . state + bias)."""
    z = F.lit(bias)
    for c, w in zip(state, weights, strict=True):
        z = z + F.col(c) * F.lit(w)
    return rows.withColumn("gated", F.col(hidden) * 2 / (1 + F.exp(-z)))
