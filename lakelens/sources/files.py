"""File inventory source and snapshot sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import written
from ..operators.catalog import apply_changes, missing, not_ignored, snapshot_changes, with_kind


def inventory(spark: SparkSession, root: str, library_id: int) -> DataFrame:
    """One row a regular file below ``root``: path, name, extension, size, mtime_s, kind; contents are never read.

    Ignored folders and files are left out at every level.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    files = raw.filter(not_ignored(F.col("path"))).select(
        F.lit(library_id).cast("long").alias("library_id"), "path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"),
        F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime_s"),
    )
    return with_kind(files, spark).withColumnRenamed("kind_of", "kind")


def rescan(scan: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes, next catalog snapshot (written) and removed rows of a scan."""
    changes = snapshot_changes(scan, catalog)
    return changes, written(apply_changes(changes), "catalog"), missing(catalog, scan)
