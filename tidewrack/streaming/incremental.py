"""Incremental forms: new messages and current topic states from a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.session import shared_dir


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the Parquet files at ``path``: a folder, or one file (then its folder is watched for that name)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def deduplicated(stream: DataFrame, id_column: str, time_column: str, delay: str) -> DataFrame:
    """The first row of each id; ids are remembered until the watermark of ``time_column`` has passed them by ``delay``."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([id_column])


def windowed_counts(stream: DataFrame, time_column: str, key: str, width: str, delay: str) -> DataFrame:
    """Rows by window and key; late rows count until the watermark has passed."""
    return stream.withWatermark(time_column, delay).groupBy(F.window(time_column, width).alias("w"), key).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now (trigger availableNow), written as Parquet in the shared folder, and read from there."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/tidewrack-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def fold_batches(stream: DataFrame, key: str, rank: str, seq: str, columns: list[str], base: str | None = None) -> DataFrame:
    """The row of the greatest rank (ties: least seq) of each key, kept as a table that each batch replaces by a new version.

    A late row of lower rank changes nothing but ``mentions``. The last version is the result. Under one ``base`` (a folder
    of the shared file system; a new one if none is given) a later run goes on where the last one ended: the stream's
    checkpoint and the versions lie there, and a batch that is run again replaces its own version.
    """
    spark = stream.sparkSession
    base = (base or f"{shared_dir(spark).rstrip('/')}/tidewrack-fold-{uuid.uuid4().hex}").rstrip("/")
    value = F.struct(F.col(rank).alias("rank"), (-F.col(seq)).alias("order"), *columns)

    def versions(before: int | None = None) -> list[int]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/v=*/_SUCCESS")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return [v for v in sorted(int(f.getPath().getParent().getName()[2:]) for f in found or ()) if before is None or v < before]

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.max(value).alias("best"), F.count("*").alias("mentions"))
        if known := versions(number):
            new = new.unionByName(spark.read.parquet(f"{base}/v={known[-1]}")).groupBy(key).agg(F.max("best").alias("best"), F.sum("mentions").alias("mentions"))
        new.write.mode("overwrite").parquet(f"{base}/v={number}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    known = versions()
    last = spark.read.parquet(f"{base}/v={known[-1]}") if known else spark.createDataFrame([], stream.schema).groupBy(key).agg(F.max(value).alias("best"), F.count("*").alias("mentions"))
    return last.select(key, *[F.col(f"best.{c}").alias(c) for c in columns], "mentions")
