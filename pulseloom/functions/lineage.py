"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode may it be unset; then a new one is made."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="pulseloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def settle(df: DataFrame, trash: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back with the same schema.

    The files outlive lost executors. Their path is noted in `trash`, where given, for remove(); others stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pulseloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if trash is not None:
        trash.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, trash: list[str]) -> None:
    """Deletes settled tables that nothing reads any more and empties the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while trash:
        path = jvm.org.apache.hadoop.fs.Path(trash.pop())
        path.getFileSystem(conf).delete(path, True)
