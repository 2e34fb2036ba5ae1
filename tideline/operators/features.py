"""Fifty trailing features per instrument: ten daily ones and ten rolling families over four windows.

Windows count an instrument's own rows; a rolling value needs as many non-missing inputs as the window is wide. All
windows share one partitioning and order, so an instrument is shuffled and sorted once. Their moments are merged from
those of smaller windows, which takes a few look-backs a row whatever the window's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.safe import at_least, finite, ratio
from tideline.session import compilable

# Raw columns, windows and feature names.
RAW_COLUMNS = ("open", "high", "low", "close", "volume", "amount", "turnover")
WINDOWS = (5, 10, 20, 60)
DAILY_FEATURES = (
    "ret_1d",
    "gap_return",
    "intraday_return",
    "high_low_range",
    "close_location",
    "upper_shadow",
    "lower_shadow",
    "log_volume",
    "log_amount",
    "turnover_raw",
)
ROLLING_FAMILIES = (
    "ret_mean",
    "ret_std",
    "downside_vol",
    "range_mean",
    "turnover_mean",
    "turnover_std",
    "log_volume_mean",
    "log_amount_mean",
    "amihud_mean",
    "price_volume_corr",
)
FEATURE_COLUMNS = (*DAILY_FEATURES, *(f"{family}_{w}" for w in WINDOWS for family in ROLLING_FAMILIES))
EVENT_ROWS = 60


def history():
    return Window.partitionBy("instrument").orderBy("datetime")


def daily(panel: DataFrame) -> DataFrame:
    """Previous close, the ten daily features, and the two inputs of rolling families that are no features."""
    c = {n: finite(F.col(n).cast("double")) for n in RAW_COLUMNS}
    rows = panel.withColumns(c).withColumn("prev_close", F.lag("close").over(history()))
    o, h, l, x, p = (F.col(n) for n in ("open", "high", "low", "close", "prev_close"))
    rows = rows.withColumns(
        {
            "ret_1d": ratio(x, p) - 1,
            "gap_return": ratio(o, p) - 1,
            "intraday_return": ratio(x, o) - 1,
            "high_low_range": ratio(h, l) - 1,
            "close_location": ratio(x - l, h - l),
            "upper_shadow": ratio(h - F.greatest(o, x), o),
            "lower_shadow": ratio(F.least(o, x) - l, o),
            "log_volume": F.log1p(at_least(F.col("volume"), 0.0)),
            "log_amount": F.log1p(at_least(F.col("amount"), 0.0)),
            "turnover_raw": F.col("turnover"),
        }
    )
    r = F.col("ret_1d")
    return rows.withColumns({"amihud_raw": ratio(F.abs(r), F.abs(F.col("amount"))), "downside": F.when(r.isNotNull(), F.least(r, F.lit(0.0)))})


# A window's moments: means, sums of squared deviations, and the sum of products of deviations of return and volume.
MEANS = ("ret_1d", "downside", "high_low_range", "turnover", "log_volume", "log_amount", "amihud_raw")
SPREADS = ("ret_1d", "downside", "turnover", "log_volume")
CROSS = ("ret_1d", "log_volume")


def steps(windows: tuple[int, ...]) -> list[tuple[int, int]]:
    """(size, parts) of the windows to build, least first: a window of `size` rows is `parts` windows of size / parts
    rows end to end. Each begins at the widest one before that divides it, and grows by prime factors, largest first."""
    made: dict[int, int] = {}
    for w in sorted(windows):
        size = max((m for m in made if w % m == 0), default=1)
        rest, factors, d = w // size, [], 2
        while rest > 1:
            while rest % d == 0:
                factors.append(d)
                rest //= d
            d += 1
        for p in sorted(factors, reverse=True):
            size *= p
            made.setdefault(size, p)
    return sorted(made.items())


def moments(rows: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """A struct `_w<size>` per window with the moments of its rows, missing where any of the window's values is.

    Windows are merged from smaller ones that lie end to end, so a row costs as many look-backs as its sizes have
    factors, and not as many as it has rows; and since nothing is ever taken away from a running total, a large value
    leaves no trace once it has left the window.
    """
    single = [f"{x} m_{x}" for x in MEANS] + [f"if({x} is not null, 0d, null) s_{x}" for x in SPREADS]
    single.append(f"if({CROSS[0]} is not null and {CROSS[1]} is not null, 0d, null) co")
    rows, kept = rows.withColumn("_w1", _struct(single)), rows.columns
    for size, parts in steps(windows):
        part = size // parts
        back = {f"_b{j}": F.lag(f"_w{part}", j * part).over(history()) for j in range(1, parts)}
        names = [f"_w{part}", *back]
        first = names[0]
        means = {f"_m_{x}": F.expr(f"{first}.m_{x} + ({' + '.join(f'({n}.m_{x} - {first}.m_{x})' for n in names[1:])}) / {parts}d") for x in MEANS}
        merged = [f"_m_{x} m_{x}" for x in MEANS]
        for name, x, y in [(f"s_{x}", x, x) for x in SPREADS] + [("co", *CROSS)]:
            inside = " + ".join(f"{n}.{name}" for n in names)
            between = " + ".join(f"({n}.m_{x} - _m_{x}) * ({n}.m_{y} - _m_{y})" for n in names)
            merged.append(f"{inside} + {part}d * ({between}) {name}")
        # Means are columns of their own: as text inside the sums they would be computed twice for each part.
        rows = rows.withColumns(back).withColumns(means).withColumn(f"_w{size}", _struct(merged)).drop(*back, *means)
    return rows.select(*kept, *[f"_w{w}" for w in sorted(set(windows))])


def _struct(fields: list[str]) -> Column:
    return F.expr(f"struct({', '.join(f'{value} as {name}' for value, name in (f.rsplit(' ', 1) for f in fields))})")


def rolling(width: int) -> dict[str, str]:
    """The rolling families of one window from its moments, as SQL expressions."""
    w, (a, b) = f"_w{width}", CROSS
    deviation = lambda x: f"sqrt({w}.s_{x} / {width}d)"
    found = {
        "ret_mean": f"{w}.m_ret_1d",
        "ret_std": deviation("ret_1d"),
        "downside_vol": deviation("downside"),
        "range_mean": f"{w}.m_high_low_range",
        "turnover_mean": f"{w}.m_turnover",
        "turnover_std": deviation("turnover"),
        "log_volume_mean": f"{w}.m_log_volume",
        "log_amount_mean": f"{w}.m_log_amount",
        "amihud_mean": f"{w}.m_amihud_raw",
        "price_volume_corr": f"try_divide({w}.co / {width}d, {deviation(a)} * {deviation(b)})",
    }
    return {f"{k}_{width}": v for k, v in found.items()}


def event_mask(rows: DataFrame, flag: str = "corporate_action", name: str = "contaminated") -> DataFrame:
    """The rows with `name`: whether the flag was set on any of an instrument's last EVENT_ROWS rows, from the number of
    its last flagged row."""
    numbered = rows.withColumn("_row", F.row_number().over(history()))
    flagged = F.last(F.when(F.coalesce(F.col(flag), F.lit(False)), F.col("_row")), ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("_flagged", flagged).withColumn(name, F.coalesce(F.col("_row") - F.col("_flagged") < EVENT_ROWS, F.lit(False))).drop("_row", "_flagged")


def features(panel: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The panel with its features; rows near a corporate action have none and are not eligible."""
    compilable(panel.sparkSession)
    rows = event_mask(daily(panel))
    kept = rows.columns
    rows = moments(rows, windows)
    found = {n: n for n in DAILY_FEATURES} | {k: v for w in windows for k, v in rolling(w).items()}
    columns = [f"if(not contaminated and not isnan({v}) and abs({v}) < double('inf'), {v}, null) as {n}" for n, v in found.items()]
    return rows.selectExpr(*[f"`{c}`" for c in kept if c not in found], *columns, "not contaminated as feature_eligible")
