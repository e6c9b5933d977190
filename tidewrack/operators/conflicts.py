"""Claims about one subject that contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import claim_key

#: Claims that share more than this part of their words don't oppose each other.
LIKE = 0.7


def distinct_claims(items: DataFrame) -> DataFrame:
    """(subject, claim, first): one row for each distinct claim (blocker) of a subject, with its first item by seq.

    Items without a claim take no position. Repeated readings are reduced to one before the shuffle.
    """
    x = items.withColumn("subject", claim_key(F.col("topic"))).withColumn("claim", claim_key(F.col("blocker"))).where("claim <> '' AND subject IS NOT NULL")
    return x.groupBy("subject", "claim").agg(F.min(F.struct("seq", "topic", "blocker", "source", "owner", "status", "confidence")).alias("first"))


def conflicts(items: DataFrame) -> DataFrame:
    """Pairs of distinct claims of a subject that oppose each other, the earlier item first, and which one is taken.

    The later item wins if it alone is of high confidence or, of one source, if only the earlier is blocked.
    """
    c = distinct_claims(items)
    a, b = c.select("subject", F.col("claim").alias("claim_a"), F.col("first").alias("a")), c.select("subject", F.col("claim").alias("claim_b"), F.col("first").alias("b"))
    wa, wb = F.array_distinct(F.split("claim_a", " ")), F.array_distinct(F.split("claim_b", " "))
    alike = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb))
    x = a.join(b, "subject").where((F.col("a.seq") < F.col("b.seq")) & (F.col("claim_a") != F.col("claim_b")) & (alike <= LIKE))
    sure = (F.col("b.confidence") == "high") & (F.col("a.confidence") != "high")
    turned = (F.col("a.source") == F.col("b.source")) & (F.col("a.status") == "blocked") & (F.col("b.status") != "blocked")
    return x.select("subject", F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), "claim_a", "claim_b", F.when(sure | turned, F.col("b.seq")).otherwise(F.col("a.seq")).alias("winner"), F.lit("newer_wins").alias("resolution"))


def conflict_positions(items: DataFrame) -> DataFrame:
    """subject, claim, seq, opposing: each distinct claim of a subject with the number of claims that oppose it; claims without any have no row.

    Claims oppose each other unless they are alike, so those alike are counted and taken from all. Claims alike share more
    than ``LIKE`` of the longer one's words, hence at least one of the rarest words of each: only claims that meet in
    such a word are compared, never all of a subject.
    """
    c = distinct_claims(items).select("subject", "claim", F.col("first.seq").alias("seq"), F.array_distinct(F.split("claim", " ")).alias("words"))
    said = c.select("subject", "claim", "words", F.explode("words").alias("word"))
    rare = said.groupBy("subject", "word").agg(F.count("*").alias("n"))
    # n words, of which more than LIKE n are shared: one of any n - floor(LIKE n) of them is
    kept = F.size("words") - F.floor(F.size("words") * LIKE)
    by_rarity = said.join(rare, ["subject", "word"]).groupBy("subject", "claim", "words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    keys = by_rarity.select("subject", "claim", "words", F.explode(F.slice("r", F.lit(1), kept.cast("int"))).alias("k")).select("subject", "claim", "words", F.col("k.word").alias("word"))
    a, b = keys, keys.select("subject", "word", F.col("claim").alias("other"), F.col("words").alias("other_words"))
    meet = a.join(b, ["subject", "word"]).where(F.col("claim") != F.col("other")).select("subject", "claim", "words", "other", "other_words").distinct()
    alike = meet.where(F.size(F.array_intersect("words", "other_words")) / F.greatest(F.size("words"), F.size("other_words")) > LIKE).groupBy("subject", "claim").agg(F.count("*").alias("alike"))
    total = c.groupBy("subject").agg(F.count("*").alias("total"))
    x = c.join(total, "subject").join(alike, ["subject", "claim"], "left").withColumn("opposing", F.col("total") - 1 - F.coalesce("alike", F.lit(0)))
    return x.where("opposing > 0").select("subject", "claim", "seq", "opposing")
