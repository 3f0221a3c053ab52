"""Scoring files as they arrive, and the throughput of past runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.sources.runlog import commit_batch, read_committed


def stream_score(
    spark: SparkSession, in_dir: str, out_dir: str, schema: T.StructType | str,
    transform: Callable[[DataFrame], DataFrame], checkpoint: str, fmt: str = "parquet",
    name_glob: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """Score every file of ``in_dir`` once and append to ``out_dir``.

    Runs until the waiting files are done. A restart with the same checkpoint
    goes on where the last run stopped; the file sink commits each batch once.
    ``transform`` maps rows to rows (scoring is row-local), so batch and
    stream give the same result.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        transform(reader.load(in_dir))
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out_dir)


def stream_score_logged(
    spark: SparkSession, in_dir: str, out_dir: str, schema: T.StructType | str,
    transform: Callable[[DataFrame], DataFrame], checkpoint: str, fmt: str = "parquet",
    name_glob: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """As ``stream_score``, with a log of the run: each batch and the files in it, in the order they were done.

    A batch that was cut short between its rows and its log has the same
    number and files when the stream starts again, and replaces what is there.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(in_dir).withColumn("file", F.col("_metadata.file_path"))
    scored = lambda batch: transform(batch.drop("file"))
    query = (
        rows.writeStream.foreachBatch(lambda batch, number: commit_batch(batch, number, out_dir, scored))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_committed(spark, out_dir)


def scoring_throughput(runs: DataFrame, order: Sequence[str] = ("file",)) -> DataFrame:
    """Running seconds per source over a log (run, file, n_sources, seconds),
    one row per file in the order of ``order``: the file names, or for a run
    log ``("batch", "place")``."""
    more = [c for c in order if c != "file"]
    files = runs.groupBy("run", "file", *more).agg(
        F.sum("n_sources").alias("n_sources"), F.sum("seconds").alias("seconds")
    )
    upto = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.select(
        "run", "file", *more, "n_sources", "seconds",
        F.try_divide(F.col("seconds"), F.col("n_sources").cast("double")).alias("file_secs_per_source"),
        F.try_divide(F.sum("seconds").over(upto), F.sum("n_sources").over(upto).cast("double")).alias("secs_per_source"),
    )
