"""Batches of predictions with a commit log: what the log does not name does not count.

``<out>/predictions/batch=<number>`` holds the rows of a batch and
``<out>/log/batch=<number>`` one row for each file in it. The log is written
after the rows, and both replace what a lost attempt at the same number has
left, so a batch that is tried again is neither doubled nor missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "place long, file string, n_sources long, seconds double, batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """place, file, n_sources, seconds and batch of every file that counts; (batch, place) is the order of the run."""
    if not _exists(spark, f"{out_dir}/log"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{out_dir}/log")


def read_committed(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows of all batches in the log."""
    numbers = [r["batch"] for r in read_log(spark, out_dir).select("batch").distinct().collect()]  # one for each batch
    if not numbers:
        raise FileNotFoundError(f"no batch has been committed to {out_dir}")
    paths = [f"{out_dir}/predictions/batch={n}" for n in sorted(numbers)]
    return spark.read.parquet(*paths)


def commit_batch(rows: DataFrame, number: int, out_dir: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Write ``transform`` of ``rows`` (with their ``file``) as batch ``number``, then its log.

    The time is shared out to the files by their numbers of rows.
    """
    started = time.monotonic()
    transform(rows).write.mode("overwrite").parquet(f"{out_dir}/predictions/batch={number}")
    seconds = time.monotonic() - started
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_sources")).orderBy("file").collect()  # one row for each file
    every = sum(r["n_sources"] for r in files) or 1
    log = [(i, r["file"], r["n_sources"], seconds * r["n_sources"] / every) for i, r in enumerate(files)]
    table = rows.sparkSession.createDataFrame(log, LOG.rsplit(",", 1)[0])
    table.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/log/batch={number}")
