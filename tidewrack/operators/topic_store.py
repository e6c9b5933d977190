"""Topics kept as tables in a folder: batches of readings are merged into what is stored, each giving a new version.

A version is a folder of Parquet named after its number; the last one that was written whole is the state. A batch that
is merged again under its number after a failure replaces its own version, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.folds import firsts_of_ranks

_CARRIED = ("status", "confidence", "owner", "blocker")
#: What is stored of a topic: its state, the rank and place of the reading that won, and the version that made and last changed it.
SCHEMA = (
    "topic string, status string, confidence string, blocker string, owner string, mentions bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, updates bigint, "
    "best_rank bigint, made_in bigint, changed_in bigint, embedded_for string"
)


class TopicStore:
    """The topics under ``path`` in a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or ())

    def topics(self, before: int | None = None) -> DataFrame:
        """The last version, or the last with a number less than ``before``; an empty table if there is none."""
        known = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v={known[-1]}") if known else self.spark.createDataFrame([], SCHEMA)

    def _write(self, topics: DataFrame, number: int) -> DataFrame:
        topics.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/v={number}")
        return self.topics()

    def upsert(self, readings: DataFrame, number: int | None = None) -> DataFrame:
        """Merge a batch of readings (topic, the carried fields, seen_at, seq, state_rank) that came after all that is stored; gives the new state.

        A topic's stored rank counts as that of its earlier readings: only a reading that exceeds it changes status,
        confidence and blocker, and the owner if it names one. Stored topics are probed by one left join of the batch.
        """
        number = (max(self._versions(), default=-1) + 1) if number is None else number
        stored = self.topics(number)
        firsts = firsts_of_ranks(readings, "topic", "state_rank", "seq", _CARRIED).join(stored.select("topic", "best_rank"), "topic", "left")
        record = F.col("is_record") & (F.col("best_rank").isNull() | (F.col("state_rank") > F.col("best_rank")))
        x = firsts.withColumn("is_record", record)
        won = lambda c: F.max_by(F.when(F.col("is_record"), F.col(f"first.{c}")), F.when(F.col("is_record"), F.col("state_rank")))
        has_owner = F.col("is_record") & F.col("first.owner").isNotNull()
        batch = x.groupBy("topic").agg(
            *[won(c).alias(c) for c in ("status", "confidence", "blocker")], F.max_by(F.when(has_owner, F.col("first.owner")), F.when(has_owner, F.col("first.seq"))).alias("owner"), F.sum("n").alias("mentions"),
            F.min_by("first.seen_at", "first.seq").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count_if("is_record").alias("records"), F.max(F.when(F.col("is_record"), F.col("state_rank"))).alias("best_rank"),
        )
        s, b = stored.alias("s"), batch.alias("b")
        old, new = F.col("s.mentions").isNotNull(), F.col("b.mentions").isNotNull()
        changed = F.coalesce(F.col("b.records") > 0, F.lit(False))
        merged = s.join(b, F.col("s.topic") == F.col("b.topic"), "full").select(
            F.coalesce("s.topic", "b.topic").alias("topic"), *[F.when(changed, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in ("status", "confidence", "blocker")],
            F.coalesce("b.owner", "s.owner").alias("owner"), (F.coalesce("s.mentions", F.lit(0)) + F.coalesce("b.mentions", F.lit(0))).alias("mentions"), F.coalesce("s.first_seen", "b.first_seen").alias("first_seen"),
            F.greatest("s.last_seen", "b.last_seen").alias("last_seen"), (F.coalesce("s.updates", F.lit(-1)) + F.coalesce("b.records", F.lit(0))).alias("updates"), F.greatest("s.best_rank", "b.best_rank").alias("best_rank"),
            F.when(old, F.col("s.made_in")).otherwise(F.lit(number)).cast("bigint").alias("made_in"), F.when(new, F.lit(number)).otherwise(F.col("s.changed_in")).cast("bigint").alias("changed_in"), F.col("s.embedded_for").alias("embedded_for"),
        )
        return self._write(merged, number)

    def set_embedded(self, embedded: DataFrame, number: int | None = None) -> DataFrame:
        """Note the texts (topic, text) that topics were embedded for; topics that aren't stored are ignored."""
        number = (max(self._versions(), default=-1) + 1) if number is None else number
        x = self.topics(number).join(embedded.select("topic", F.col("text").alias("_text")), "topic", "left")
        return self._write(x.withColumn("embedded_for", F.coalesce("_text", "embedded_for")), number)
