"""Peer context: each row against K prototypes of its date, at a cost of rows times K and never row pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(xs: list[Column], ys: list[Column]) -> Column:
    out = xs[0] * ys[0]
    for x, y in zip(xs[1:], ys[1:], strict=True):
        out = out + x * y
    return out


def peer_context(rows: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Row minus its attention over the prototypes of its date.

    A row is assigned to the anchors by softmax; a prototype is the assignment-weighted mean of the date's rows, found
    by a combining aggregation. The anchors (a fixed K rows) are broadcast and kept as one array per row, so the
    assignment needs no shuffle.
    """
    hs = [F.col(f"h{j}") for j in range(width)]
    spec = anchors.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", *[f"w{j}" for j in range(width)]))).alias("anchors"))
    with_anchors = rows.crossJoin(F.broadcast(spec))
    weights = F.transform("anchors", lambda a: F.exp(_dot(hs, [a[f"w{j}"] for j in range(width)])))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    assigned = with_anchors.withColumn("e", weights).withColumn("sum", total)
    parts = assigned.select("datetime", *hs, "sum", F.posexplode("e").alias("k", "e")).withColumn("a", F.col("e") / F.col("sum"))
    protos = parts.groupBy("datetime", "k").agg(*[(F.sum(F.col("a") * h) / F.greatest(F.sum("a"), F.lit(1e-8))).alias(f"p{j}") for j, h in enumerate(hs)])
    lists = protos.groupBy("datetime").agg(F.array_sort(F.collect_list(F.struct("k", *[f"p{j}" for j in range(width)]))).alias("protos"))
    at = rows.join(lists, "datetime")
    attention = F.transform("protos", lambda p: F.exp(_dot(hs, [p[f"p{j}"] for j in range(width)]) / 2))
    at = at.withColumn("b", attention)
    share = F.aggregate("b", F.lit(0.0), lambda s, v: s + v)

    def mean_of(j: int) -> Column:
        weighted = F.zip_with("protos", "b", lambda p, b: p[f"p{j}"] * b)
        return F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v) / share

    mean = [mean_of(j) for j in range(width)]
    return at.select("datetime", "instrument", *[(h - m).alias(f"c{j}") for j, (h, m) in enumerate(zip(hs, mean, strict=True))])
