"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A session on one machine that has none gets a temporary one;
    a cluster without one is an error, as its executors couldn't read each other's files."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loamgraph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage. Its shuffle files go once it is written, as
    nothing reads them after."""
    spark = df.sparkSession
    shared_folder(spark)
    with freeing_shuffles(spark):
        return df.select("*").checkpoint()  # whether shuffles are freed is settled where a frame is made


def forget(*frames: DataFrame) -> None:
    """Delete the files of what ``cut`` gave; nothing may read those frames any more, nor what was made of them and isn't
    written. Frames that are no checkpoints themselves are passed over."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD":
            file = plan.rdd().getCheckpointFile()
            if file.isDefined():
                remove_folder(df.sparkSession, file.get())


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here free their shuffle files at once and not when the driver collects garbage."""
    before = spark.conf.get(FREEING, None)
    spark.conf.set(FREEING, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREEING) if before is None else spark.conf.set(FREEING, before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a job wrote, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
