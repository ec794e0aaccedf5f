"""Tables that cut a job's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder given to setCheckpointDir. Where neither is set, a local master
    (tests) gets a temporary folder; on a cluster that is an error, as executors would each write to a disk of their own."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and no executor holds the only copy."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing that is still to run reads them."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def partitions_of(table: DataFrame, growth: float = 1.0) -> int:
    """Partitions for a shuffle of a materialized table, or of `growth` times its rows: as many as Spark cuts its files
    into by their bytes, and the session's shuffle partitions at least."""
    return max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(growth * table.rdd.getNumPartitions()))
