"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder where it is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scrollmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What a query has exchanged goes when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def write_named(rows: DataFrame, folder: str, suffix: str) -> str:
    """Write each value of rows (name, value) as a file of its own, named by name and suffix, to a new folder; its path.

    Executors write the files; the driver renames them, so there should be no more than it can list.
    """
    spark = rows.sparkSession
    path = f"{folder}-{uuid.uuid4().hex}"
    rows.select("name", "value").repartition("name").write.partitionBy("name").text(f"{path}/parts")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/parts/name=*/*.txt")) or []:
        name = found.getPath().getParent().getName().removeprefix("name=")
        fs.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(root, name + suffix))
    fs.delete(jvm.org.apache.hadoop.fs.Path(root, "parts"), True)
    return path
