"""Session settings, the shared checkpoint folder, and materialisation in it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tidewrack", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; other settings stay those of the cluster."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset, which only a local session may."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return configured or sc.getCheckpointDir()


def _new_table(spark: SparkSession) -> str:
    path, sc = f"{shared_dir(spark).rstrip('/')}/tidewrack-{uuid.uuid4().hex}", spark.sparkContext
    if not hasattr(sc, "_tidewrack_tables"):
        sc._tidewrack_tables = []
    sc._tidewrack_tables.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that this session's queries wrote in the shared folder, when their results were read; gives their number."""
    sc = spark.sparkContext
    gone, sc._tidewrack_tables = getattr(sc, "_tidewrack_tables", []), []
    for path in gone:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors.

    Columnar and compressed, so smaller than an RDD checkpoint, and its size is known to later joins.
    """
    spark = df.sparkSession
    path = _new_table(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Write frames of one schema (at least one) as one table, one after the other, and read it back; a later frame is made when the earlier ones are written."""
    path = ""
    for df in parts:
        path = path or _new_table(df.sparkSession)
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context, so Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewrack_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "tidewrack_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(to))
    sc._tidewrack_shipped = True
