"""Ranks and running values within groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewrack.session import materialize


def by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` spread by ranges of (keys, order), with the range of each row as ``_range``; a hot group lies in many tasks.

    The ranges are written down, as a range of a lost executor must come back with the same rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, how: Callable[[Column | str], Column], both: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """``df`` with ``how`` (F.max, F.sum) of ``value`` over the earlier rows of each row's group, by ``order``; null where there are none.

    ``both`` puts two such values together. A row's value is that of the earlier ranges of its group, of which each counts
    as one row, and that of the earlier rows of its own range. Keys may be null; order makes rows of a group unique.
    """
    x = by_ranges(df, keys, order)
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = x.groupBy(*keys, "_range").agg(how(value).alias("_t")).withColumn("_before", how("_t").over(earlier))
    sums = sums.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_range_of"), "_before")
    here = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = reduce(Column.__and__, [F.col("_range") == F.col("_range_of"), *[F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]])
    joined = x.withColumn("_here", how(value).over(here)).join(sums, same)
    return joined.withColumn(out, both(F.col("_before"), F.col("_here"))).select(*df.columns, out)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """``df`` with the place from 1 (bigint) of each row in its group, by ``order``, whose last column makes it unique.

    A row's rank is its place in its range plus the size of the group's earlier ranges. Keys and order must not be null.
    """
    x = by_ranges(df, keys, order)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = x.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return x.withColumn("_place", place).join(counts, [*keys, "_range"]).withColumn(out, (F.col("_place") + F.col("_before")).cast("bigint")).drop("_range", "_place", "_before")
