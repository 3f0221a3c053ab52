"""Reading catalogs: fixed schemas, sampled schemas, manifests, resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_catalog(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """Read CSV (with header) or parquet. CSV needs a schema: nothing is
    inferred over a big table."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fmt = fmt or ("parquet" if paths[0].rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("a CSV scan needs a schema; take one with schema_from_sample")
    if fmt == "csv":
        # match by position only after the names were checked
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(paths)


def schema_from_sample(spark: SparkSession, path: str, n: int = 100) -> T.StructType:
    """Types inferred from the header and the first ``n`` rows of one CSV file."""
    lines = [r[0] for r in spark.read.text(path).limit(n + 1).collect()]
    sample = spark.sparkContext.parallelize(lines, 1)
    return spark.read.csv(sample, header=True, inferSchema=True).schema


def read_manifest(spark: SparkSession, manifest: str) -> list[str]:
    """File names listed one per line."""
    return [r[0].rstrip() for r in spark.read.text(manifest).collect() if r[0].strip()]


def existing_only(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """The listed files that exist, in their order: each folder is listed once."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, list[str]] = {}
    for name in files:
        folders.setdefault(hadoop.Path(name).getParent().toString(), []).append(name)
    found = set()
    for folder, names in folders.items():
        path = hadoop.Path(folder)
        system = path.getFileSystem(conf)
        if system.exists(path):
            present = {s.getPath().getName() for s in system.listStatus(path)}
            found |= {n for n in names if hadoop.Path(n).getName() in present}
    return [n for n in files if n in found]


def scan_manifest(
    spark: SparkSession, files: str | Sequence[str], schema: T.StructType | str, fmt: str | None = None
) -> DataFrame:
    """All listed files as one table with the path of its file in ``file``, which
    tells files of one name in different folders apart. Files that do not exist
    are ignored."""
    listed = read_manifest(spark, files) if isinstance(files, str) else list(files)
    present = existing_only(spark, listed)
    if not present:
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    return scan_catalog(spark, present, schema, fmt).withColumn("file", F.col("_metadata.file_path"))


def pending_only(batch: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows (or files) of ``batch`` that the sink does not hold yet."""
    return batch.join(done.select(*on).distinct(), list(on), "left_anti")
