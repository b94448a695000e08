"""Folders every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's checkpoint folder, for data written between stages.

    A local master may leave ``spark.checkpoint.dir`` unset and gets a temporary
    folder; a cluster has to name one, since executors do not share local disks.
    """
    root = setting(spark, "spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="fhirlake-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def through_table(df: DataFrame, purpose: str, partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write once, read back: later consumers share the work and survive lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    writer = df.write.mode("overwrite").option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_together(jobs: Sequence[Callable[[], object]], threads: int = 4) -> list:
    """Submit independent Spark jobs at once, so that one's last tasks leave no slots idle.

    All jobs finish before the first failure is raised.
    """
    with ThreadPoolExecutor(threads) as pool:
        futures = [pool.submit(inheritable_thread_target(job)) for job in jobs]
    return [f.result() for f in futures]
