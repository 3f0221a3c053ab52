"""Tables of very many small folders."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (loads pa.compute)
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPED = set("\"#%'*/:=?\\{[]^\x7f") | {chr(i) for i in range(1, 32)}


def _folder(column: str, value: str | None) -> str:
    """The name that Spark gives the folder of a value."""
    held = "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value) if value else "__HIVE_DEFAULT_PARTITION__"
    return f"{column}={held}"


def write_folders(df: DataFrame, path: str, column: str) -> None:
    """Replace ``path`` by the Parquet files of ``df``, one folder for each value of ``column``, a file for each task that holds it.

    The same folders as ``partitionBy`` writes. Where Hadoop has no native
    library, its local file system starts a process for each file, checksum
    file and folder, so on a local path tasks write the files themselves, with
    checksums of pages. A file is renamed when it is whole, to a name that
    another attempt of its task gives as well.
    """
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        df.write.mode("overwrite").partitionBy(column).parquet(path)
        return
    system.delete(place, True)
    root = unquote(system.makeQualified(place).toUri().getRawPath())
    names = [c for c in df.columns if c != column]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, now, writer, files = TaskContext.get().partitionId(), uuid.uuid4().hex, None, None, 0

        def end() -> None:
            writer.close()
            os.replace(f"{now}/.{attempt}", f"{now}/part-{part:05d}.snappy.parquet")

        for batch in batches:
            runs = pa.compute.run_end_encode(batch.column("_folder"))
            rows, start = batch.select(names), 0
            for stop, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                folder = f"{root}/{_folder(column, value)}"
                if folder != now:
                    if writer is not None:
                        end()
                    os.makedirs(folder, exist_ok=True)
                    now, files = folder, files + 1
                    writer = pq.ParquetWriter(f"{folder}/.{attempt}", rows.schema, write_page_checksum=True)
                writer.write_batch(rows.slice(start, stop - start))
                start = stop
        if writer is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    # rows of a folder come one after another, so a task holds one file open
    dealt = df.withColumn("_folder", F.col(column).cast("string")).sortWithinPartitions("_folder").drop(column)
    dealt.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    os.makedirs(root, exist_ok=True)
    open(f"{root}/_SUCCESS", "w").close()
