"""Tables that are written to the shared folder, and read from there, instead of being derived again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the folder that the session has set; a local master without either gets
    a temporary folder, a cluster an error, as a folder of the driver's machine is no use to executors."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes a narrow table to the shared folder and returns it without its lineage. The files survive a lost
    executor, and Spark's cleaner removes them with the DataFrame."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """df written once to the shared folder, in as many buckets by key as there are shuffle partitions, and sorted in them:
    what groups, windows or joins such tables by columns of which key is one reads them without an exchange. The table's
    name goes again; its folder stays until the shared folder is cleared."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key, *order)
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # of an external table only the name
    return table


def forget(spark: SparkSession, folder: str) -> None:
    """Removes a folder below the shared one, by the file system that it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
