"""Stage tables in a folder that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and no executor runs elsewhere (tests).

    A cluster must name a folder that all its executors reach: anything else would lose stage tables.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fennwick-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/stages/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows, dealt over the cores if it has fewer partitions than there are; a larger table stays as it is.

    For scans with costly work on each row: one row group is one task, however many cores wait. Not for other plans, as
    counting their partitions may run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the running stage, and a table used twice is computed once.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove the stage tables that ``tables`` read, as soon as no plan needs them any more; files elsewhere stay."""
    for df in tables:
        inside = re.compile(re.escape(re.sub("^file:/*", "/", shared_dir(df.sparkSession))) + "/stages/[^/]+-[0-9a-f]{32}(?=/)")
        for folder in {m[0] for f in df.inputFiles() if (m := inside.match(re.sub("^file:/*", "/", f)))}:
            remove(df.sparkSession, folder)


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """While this holds, the shuffle files of a query go when it ends, not when the driver's JVM happens to collect garbage.

    For builds that write one table after the other: a plan that is run twice would shuffle its rows twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
