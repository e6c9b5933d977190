"""Folds of repeated readings into one current state, in closed form.

Readings of a key come in an order (``seq``). A reading sets a record if its rank exceeds that of every earlier one. All
that a sequential fold would keep follows from the first row of the greatest rank and from the record setters. Only the first
row of each rank can set a record, so rows are reduced to these before the shuffle, and the running maximum goes by
ranges: a key of any size is never one task, and nothing is folded row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewrack.functions.text import squeezed
from tidewrack.operators.ranking import running

# The orders of statuses and confidences; answers rank on_track above unclear.
STATUS_RANK = {"blocked": 3, "at_risk": 2, "unclear": 1, "on_track": 0}
ANSWER_STATUS_RANK = {"blocked": 3, "at_risk": 2, "on_track": 1, "unclear": 0}
CONFIDENCE_RANK = {"high": 2, "medium": 1, "low": 0}


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    """The rank of a value; values that have none rank lowest (-1)."""
    out = F.lit(-1)
    for name, r in ranks.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def firsts_of_ranks(rows: DataFrame, key: str, rank: str, seq: str, carried: tuple[str, ...]) -> DataFrame:
    """One row for each key and rank: ``first`` (seq and the ``carried`` columns of its first row), ``is_record``, and n, last_seen, and of each carried column the first non-null value of its rows as (seq, value) in ``some``.

    ``is_record``: whether the rank exceeds all earlier ones of the key by ``seq``, which is unique in it. Keys may be null.
    """
    seen = "seen_at" in rows.columns
    some = F.struct(*[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(c).alias("value")))).alias(c) for c in carried])
    x = rows.groupBy(key, rank).agg(
        F.min(F.struct(F.col(seq).alias("seq"), *carried, *(["seen_at"] if seen else []))).alias("first"), F.count("*").alias("n"), some.alias("some"), *([F.max("seen_at").alias("last_seen")] if seen else [])
    )
    x = running(x.withColumn("_seq", F.col("first.seq")), [key], ["_seq"], rank, F.max, F.greatest, "_before").drop("_seq")
    return x.withColumn("is_record", F.col("_before").isNull() | (F.col(rank) > F.col("_before"))).drop("_before")


def _winner(column: str, rank: str) -> Column:
    """The value of the first row of the greatest rank."""
    return F.max_by(F.col(f"first.{column}"), F.col(rank)).alias(column)


def _of_last_record(column: str) -> Column:
    """The value of the last record setter that has one."""
    has = F.col("is_record") & F.col(f"first.{column}").isNotNull()
    return F.max_by(F.when(has, F.col(f"first.{column}")), F.when(has, F.col("first.seq")))


def merge_items(rows: DataFrame, key: str, rank: str, seq: str) -> DataFrame:
    """One row for each key: status, confidence of the winner; owner and blocker of the last record setter that has one, else the first of the key.

    Keys that are null form a key of their own; an empty table gives no rows.
    """
    x = firsts_of_ranks(rows, key, rank, seq, ("status", "confidence", "owner", "blocker"))
    carried = lambda c: F.coalesce(_of_last_record(c), F.min(F.col(f"some.{c}"))["value"]).alias(c)
    return x.groupBy(key).agg(_winner("status", rank), _winner("confidence", rank), carried("owner"), carried("blocker"), F.sum("n").alias("readings"))


def topic_state(rows: DataFrame, key: str, rank: str, seq: str) -> DataFrame:
    """The stored state of each key: the winner's status, confidence and blocker, the last record setter's owner, and counts.

    first_seen is that of the first arrival, last_seen the greatest; ``updates`` are the record setters after the first.
    """
    x = firsts_of_ranks(rows, key, rank, seq, ("status", "confidence", "owner", "blocker"))
    return x.groupBy(key).agg(
        _winner("status", rank), _winner("confidence", rank), _winner("blocker", rank), _of_last_record("owner").alias("owner"), F.sum("n").alias("mentions"),
        F.min_by("first.seen_at", "first.seq").alias("first_seen"), F.max("last_seen").alias("last_seen"), (F.count_if("is_record") - 1).alias("updates"),
    )


def union_evidence(evidence: DataFrame, keys: list[str], span: str, seq: str) -> DataFrame:
    """The first row of each (keys, span without regard to white space)."""
    squeezed_span = squeezed(F.col(span))
    rest = [c for c in evidence.columns if c not in keys]
    x = evidence.groupBy(*keys, squeezed_span.alias("_span")).agg(F.min_by(F.struct(*rest), seq).alias("first"))
    return x.select(*keys, "first.*")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each key by ``order`` with their place; a report of n rows a key.

    Spark stops a key's rows at n before the shuffle (window group limit), so a hot key sends n rows a task.
    """
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def most_within(rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """key, most: the most rows of a key in any ``width`` seconds and the one before, that is, from t - width to t.

    Rows are counted by second before the shuffle. Time is cut into spans a second longer than the width; a count looks at its
    own span and the one before, which also gets a copy, so a window holds two spans and never all of a key.
    """
    n = rows.where(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("_at")).agg(F.count("*").alias("_n"))
    span = F.floor(F.col("_at") / (width + 1))
    x = n.select("*", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))).alias("_s")).select(key, "_at", "_n", "_s.*")
    within = W.partitionBy(key, "span").orderBy("_at").rangeBetween(-width, 0)
    return x.withColumn("_most", F.sum("_n").over(within)).where("own").groupBy(key).agg(F.max("_most").alias("most"))
