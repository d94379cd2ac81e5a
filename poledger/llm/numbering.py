"""Positions inside large groups without giving a whole group to one task.

A seeded hash of the key deals the rows of a group into a fixed number of buckets. Bucket totals
are one small row each; their running sums give every bucket its start, and a window inside the
bucket gives the rest. The order is by hash, so it looks random and is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that name the bucket: 16 ** 3 buckets for each group.
DIGITS = 3


def seeded(seed: str, key: Column) -> Column:
    """Hex digest of the key, the same in every engine; a null key is a key of its own."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def starts(rows: DataFrame, group: str, order: str, amount: Column, ties: list[str], name: str) -> DataFrame:
    """`rows` with a column `name`: the sum of `amount` over the rows of the group before this one,
    in the order of the hex column `order`, then `ties`."""
    dealt = rows.withColumn("bucket__", F.substring(order, 1, DIGITS)).withColumn("amount__", amount)
    totals = dealt.groupBy(group, "bucket__").agg(F.sum("amount__").alias("total__"))
    before = Window.partitionBy(group).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "bucket__", F.coalesce(F.sum("total__").over(before), F.lit(0)).alias("base__"))
    inside = Window.partitionBy(group, "bucket__").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(base, [group, "bucket__"])
        .withColumn(name, F.col("base__") + F.coalesce(F.sum("amount__").over(inside), F.lit(0)))
        .drop("bucket__", "amount__", "base__")
    )
