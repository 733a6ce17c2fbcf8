"""A listing of scans that reads only documents that have changed.

A kept table holds a row for each file: its name, size, time of change, and what a listing or a summary shows of it. Files
are listed with sizes and times alone; those that the table doesn't have as they are now are read and merged in, and
those that are gone are left out when the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import KeptTable
from .scans import documents, present_fields

ROW = "filename string, size bigint, changed timestamp, ok boolean, discovery_id string, seed_ip string, timestamp string, device_count bigint, elapsed double, failed_count bigint"


def table(spark: SparkSession, path: str) -> KeptTable:
    return KeptTable(spark, path, ROW, ["filename"], ["changed", "size"])


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, size, changed) of every *.json of a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def refreshed(spark: SparkSession, folder: str, path: str) -> tuple[DataFrame, int]:
    """(rows of the files that are there, how many documents were read). `path` is the kept table's folder."""
    kept, there = table(spark, path), files(spark, folder)
    new = [r[0] for r in there.join(kept.rows().select("filename", "size", "changed"), ["filename", "size", "changed"], "left_anti").select("filename").collect()]
    if new:
        texts = spark.read.option("wholetext", True).text([f"{folder.rstrip('/')}/{n}" for n in new]).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
        kept.merge(there.join(present_fields(documents(texts)), "filename"))
    return kept.rows().join(there.select("filename", "size", "changed"), ["filename", "size", "changed"], "left_semi"), len(new)


def listing(rows: DataFrame) -> DataFrame:
    """Scans by file name, the latest first; files that do not parse are left out."""
    return rows.where("ok").select("filename", "discovery_id", "seed_ip", "timestamp", "device_count").orderBy(F.desc("filename"))


def summaries(rows: DataFrame) -> DataFrame:
    return rows.where("ok").select(F.col("discovery_id").alias("scan_id"), "device_count", "seed_ip", "timestamp", "elapsed", "failed_count")
