"""A hash tree over keyed rows: digests of hash ranges inside a group, combined upward.

A key's place is the hexadecimal MD5 of its text, and a node of level l holds the keys whose places begin with the same l
digits. A leaf's digest is that of its rows' sorted lines, an inner node's that of its children's digests in order. Two
stored trees are compared from the root down, only into nodes that differ, and only the rows of the leaves that differ
are joined, by their values as they are; text is made of those cells only that are not the same. The depth keeps leaves
at about LEAF rows, so no list of a group's keys is ever collected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import broadcast_if_small, cut

LEAF = 1000
FRACTIONS = ("double", "float")
#: Fractions below this are rounded by the cast to decimals alone: a double of at most 15 digits, four of them behind the
#: point, is spelled by them. Above it the rounded double may be spelled otherwise than the value, rounded.
EXACT = 1e11


def depth_for(rows: DataFrame, group: str, leaf: int = LEAF) -> int:
    """Levels below the root that bring the largest group's leaves to about `leaf` rows."""
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    return max(0, math.ceil(math.log(max(most, 1) / leaf, 16)))


def canonical(column: str, kind: str, digits: int) -> Column:
    """A value as text that engines agree on; fractions are rounded, a half upward whatever its last bits are."""
    if kind in FRACTIONS:
        value, form = F.col(column) + 1e-9, f"decimal(38,{digits})"
        rounded = F.round(value, digits).cast(form)
        text = (F.when(F.abs(value) < EXACT, value.cast(form)).otherwise(rounded) if digits <= 4 else rounded).cast("string")
    else:
        text = F.col(column).cast("string")
    return F.coalesce(text, F.lit(""))


def placed(rows: DataFrame, key: str, depth: int, node: str = "node") -> DataFrame:
    return rows.withColumn(node, F.left(F.md5(F.col(key).cast("string")), F.lit(depth)))


def tree(rows: DataFrame, group: str, key: str, columns: list[str], depth: int, digits: int = 4, parts: int | None = None) -> DataFrame:
    """(group, level, node, digest, n) of every node, root first in level 0; store it, comparisons read it by level.
    `parts` is the number of partitions to which the lines go, else that of the session."""
    kinds = dict(rows.dtypes)
    line = F.concat_ws("|", F.col(key).cast("string"), *[canonical(c, kinds[c], digits) for c in columns])
    leaves = placed(rows.select(group, key, line.alias("line")), key, depth).select(group, "node", "line")
    # Lines go to their leaves as they are: lists made before the shuffle would be of one line or two.
    leaves = leaves.repartition(parts, group, "node") if parts else leaves.repartition(group, "node")
    level = leaves.groupBy(group, "node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    out = None
    for k in range(depth, -1, -1):
        if k < depth:
            children = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])  # 16 at most
            level = level.groupBy(group, F.left("node", F.lit(k)).alias("node")).agg(F.sha2(F.array_join(children, ""), 256).alias("digest"), F.sum("n").alias("n"))
        level = cut(level)
        own = level.select(group, F.lit(k).alias("level"), "node", "digest", "n")
        out = own if out is None else own.unionByName(out)
    return out


def differing_leaves(a: DataFrame, b: DataFrame, group: str, depth: int) -> DataFrame:
    """(group, node) of the leaves in which two trees of equal depth differ, found by descending from the roots."""
    open_ = None
    for k in range(depth + 1):
        x, y = (t.where(F.col("level") == k).select(group, "node", "digest") for t in (a, b))
        if open_ is not None:
            inside = F.left("node", F.lit(k - 1))
            few = broadcast_if_small(open_.withColumnRenamed("node", "above"), 64)
            x, y = (t.withColumn("above", inside).join(few, [group, "above"], "left_semi").drop("above") for t in (x, y))
        both = x.join(y.withColumnRenamed("digest", "other"), [group, "node"], "full")
        open_ = cut(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select(group, "node"))
    return open_


def changed_cells(a: DataFrame, b: DataFrame, trees: tuple[DataFrame, DataFrame], group: str, key: str, columns: list[str], depth: int, digits: int = 4) -> DataFrame:
    """(group, key, column, before, after) of every cell in which stored rows `a` and `b` differ, values as canonical
    text; a row that one side lacks is one line with column `-` and its presence. Only rows of differing leaves are met."""
    leaves = broadcast_if_small(differing_leaves(*trees, group, depth), 64)

    def near(rows: DataFrame, name: str) -> DataFrame:
        own = placed(rows, key, depth).join(leaves, [group, "node"], "left_semi")
        return own.select(group, key, F.struct(*columns).alias(name))

    kinds = {c: (dict(a.dtypes)[c], dict(b.dtypes)[c]) for c in columns}
    text = lambda side, c: canonical(f"{side}.{c}", kinds[c]["xy".index(side)], digits)

    def unlike(c: str) -> Column:
        texts = text("x", c) != text("y", c)
        # The same fraction has the same text, which takes long to make.
        return ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) & texts if kinds[c][0] == kinds[c][1] and kinds[c][0] in FRACTIONS else texts

    both = near(a, "x").join(near(b, "y"), [group, key], "full")
    lost = F.col("x").isNull() | F.col("y").isNull()
    both = both.where(reduce(Column.__or__, [unlike(c) for c in columns], lost))
    cell = lambda c: F.when(~lost & unlike(c), F.struct(F.lit(c).alias("column"), text("x", c).alias("before"), text("y", c).alias("after")))
    there = lambda side: F.when(F.col(side).isNotNull(), F.lit("row"))
    alone = F.when(lost, F.struct(F.lit("-").alias("column"), there("x").alias("before"), there("y").alias("after")))
    return both.select(group, key, F.explode(F.array_compact(F.array(alone, *[cell(c) for c in columns]))).alias("d")).select(group, key, "d.*")
