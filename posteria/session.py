"""Shared storage that operators use to cut lineage."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    In local mode a missing setting falls back to a temporary folder; on a
    cluster it is an error, because a machine-local folder is lost with its
    machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if re.fullmatch(r"local(\[.*\])?", context.master) is None:  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="posteria-"))
    return context.getCheckpointDir()


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_STAGED: dict[str, list[str]] = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block go when it ends, so write the result inside."""
    before = len(_STAGED.get(spark.sparkContext.applicationId, ()))
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables that this session has staged, all but the first ``keep``; returns how many.

    Results that still read them must have been written.
    """
    held = _STAGED.get(spark.sparkContext.applicationId, [])
    gone, held[keep:] = held[keep:], []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in gone:
        place = path(name)
        place.getFileSystem(conf).delete(place, True)
    return len(gone)


def claimed_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``release`` deletes like a staged table."""
    path = staged_path(spark, label)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Everything downstream reads the same files, so a lost executor never
    recomputes a different answer and iterated plans stay short.
    """
    spark = df.sparkSession
    path = claimed_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="posteria-zip-")) / "posteria.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))  # copied from the driver to every executor
    _SHIPPED.add(context.applicationId)
