"""Tables written into the folder that driver and executors share, so that later plans start from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; where that is unset, a temporary folder on a local master, and an error on
    a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tapeworks-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/tapeworks-{sc.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder, read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> int:
    """A number that changes with a table's files: their names, sizes and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))
