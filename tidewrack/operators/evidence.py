"""Claims against the texts that they quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.keys import norm_key
from tidewrack.functions.text import squeezed


def checked_evidence(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each piece of evidence with ``verdict``: ``verified`` (its span, white space aside, stands in the artifact's text), ``not_in_text``, ``no_artifact``, ``empty``.

    ``artifacts`` has one row for each artifact_id. Only the containment test, not the text, passes on.
    """
    texts = artifacts.select(norm_key(F.col("artifact_id")).alias("_id"), squeezed(F.col("text")).alias("_text"), F.lit(True).alias("_known"))
    span = squeezed(F.col("span"))
    x = evidence.withColumn("_id", norm_key(F.col("artifact_id"))).join(texts, "_id", "left")
    verdict = (
        F.when(F.coalesce(span, F.lit("")) == "", "empty").when(F.col("_known").isNull(), "no_artifact")
        .when(F.coalesce(F.contains(F.col("_text"), span), F.lit(False)), "verified").otherwise("not_in_text")
    )
    return x.withColumn("verdict", verdict).drop("_id", "_text", "_known")


def dropped_topics(checked: DataFrame) -> DataFrame:
    """Topics without any verified evidence, with the number of pieces."""
    return checked.groupBy("topic_key").agg(F.count("*").alias("pieces"), F.count_if(F.col("verdict") == "verified").alias("verified")).where("verified = 0").drop("verified")


def fabricated(answers: DataFrame, cited: str, available: str) -> DataFrame:
    """``answers`` with ``fabricated``: cited ids that the context never offered, in order."""
    return answers.withColumn("fabricated", F.array_except(F.col(cited), F.coalesce(F.col(available), F.array().cast("array<string>"))))


def assert_verified(checked: DataFrame) -> DataFrame:
    """``checked`` itself if all of it is verified; raises ValueError with the first piece that isn't."""
    bad = checked.where("verdict <> 'verified'").orderBy("artifact_id", "span").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['artifact_id']}: {bad[0]['verdict']}: {bad[0]['span']!r}")
    return checked
