"""Bulk prediction as one call: the listed files that exist and are not done, scored and written batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.plans.predict import score
from posteria.sources import runlog
from posteria.sources.catalog import existing_only, read_manifest, scan_catalog
from posteria.sources.sinks import CatalogState, prediction_columns


def predict_files(
    spark: SparkSession, files: str | Sequence[str], schema: T.StructType | str, state: CatalogState, keys: Sequence[str], out_dir: str,
    mode: str = "reduced", mixtures: bool = False, n_iter: int = 300, files_per_batch: int = 64, fmt: str | None = None, **how,
) -> DataFrame:
    """Predictions for every listed file, those of earlier runs included.

    ``files`` is a list or a text file of names, one a line. Files that do not
    exist are left out; files in the log of ``out_dir`` are not scored again,
    so a run that was cut short goes on where it stopped and a repeated run
    adds nothing. ``reduced`` output holds keys and predictions, ``full`` also
    the other columns of the catalog; numbers have four digits, six with
    mixtures.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    listed = read_manifest(spark, files) if isinstance(files, str) else list(files)
    log = runlog.read_log(spark, out_dir).select("file", "batch").collect()  # one row for each file done
    done = {_plain(r["file"]) for r in log}
    waiting = [f for f in dict.fromkeys(existing_only(spark, listed)) if _plain(f) not in done]
    extra = [c for c in schema.names if c not in keys]
    number = max((r["batch"] for r in log), default=-1) + 1

    def scored(rows: DataFrame) -> DataFrame:
        kept = extra if mode == "full" else []
        found = score(rows.drop("file"), state, keys, n_iter, kept, mixtures, **how)
        return prediction_columns(found, keys, extra, mode, 6 if mixtures else 4)

    for at in range(0, len(waiting), files_per_batch):
        rows = scan_catalog(spark, waiting[at : at + files_per_batch], schema, fmt)
        runlog.commit_batch(rows.withColumn("file", F.col("_metadata.file_path")), number, out_dir, scored)
        number += 1
    return runlog.read_committed(spark, out_dir)


def _plain(name: str) -> str:
    """A file's name without the scheme of a local path, as listed and as Spark reports it."""
    for scheme in ("file://", "file:"):
        if name.startswith(scheme):
            name = name[len(scheme) :]
            break
    return name.replace("%20", " ")
