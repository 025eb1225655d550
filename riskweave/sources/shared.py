"""Tables in the folder that the driver and all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local one is made for a local master only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("riskweave.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-riskweave-")
        spark.conf.set("riskweave.shared.dir", path)
    return path


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses yet; it is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/riskweave-{uuid.uuid4().hex[:12]}-{name}"
    where, fs = _located(spark, path)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table and reads it back."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes tables made by stored() once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            where, fs = _located(df.sparkSession, path)
            fs.delete(where, True)
