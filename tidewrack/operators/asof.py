"""Joins with the last earlier row, and values of the row before, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ranking import running


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, carried: Sequence[str], tie: str) -> DataFrame:
    """``left`` with the ``carried`` columns of the last row of ``right`` of the same keys at or before it; null where there is none.

    Of rows of one time the greatest ``tie`` counts; ``tie``, a column of both, makes rows of a key and time unique on
    either side. Both sides are read once, in one order by ranges: no pairs are made, and a hot key lies in many tasks.
    """
    right_row = F.struct(F.col(right_at).alias("at"), F.col(tie).alias("tie"), *carried)
    b = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), right_row.alias("_right"))
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    x = a.unionByName(b, allowMissingColumns=True)
    x = running(x, keys, ["_at", "_side", "_tie"], "_right", F.max, F.greatest, "_last").where("_side = 1")
    return x.select("_left.*", *[F.col(f"_last.{c}").alias(c) for c in carried])


def with_previous(rows: DataFrame, keys: Sequence[str], order: str, carried: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """``rows`` with the ``carried`` columns of the row before, by ``order``, which is unique in a key."""
    x = rows.withColumn("_value", F.struct(order, *carried))
    x = running(x, keys, [order], "_value", F.max, F.greatest, "_previous")
    return x.select(*rows.columns, *[F.col(f"_previous.{c}").alias(f"{prefix}{c}") for c in carried])


def ntiles(ranked: DataFrame, rank: str, n: int, total: int, out: str) -> DataFrame:
    """``ranked`` (places from 1 to ``total``) in n parts whose sizes differ by one at most, the larger ones first."""
    size, larger = divmod(total, n)
    place = F.col(rank) - 1
    first = larger * (size + 1)
    part = F.when(place < first, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - first) / max(size, 1)))
    return ranked.withColumn(out, (part + 1).cast("int"))
