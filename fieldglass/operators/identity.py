"""Names of devices by their addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import first_rows, last_rows


def named_by_address(df: DataFrame, devices: DataFrame, address: str, name: str = "device_name") -> DataFrame:
    """df with the name of the first device (scan_id, hostname, device_ord, mgmt_ip) of its scan that has the address; null for an address that is empty or that no device has."""
    one = devices.where("mgmt_ip <> ''").groupBy("scan_id", F.col("mgmt_ip").alias(address)).agg(F.min_by("hostname", "device_ord").alias(name))
    return df.drop(name).join(one, ["scan_id", address], "left")


def renamed(devices: DataFrame, found: DataFrame) -> DataFrame:
    """Devices (scan_id, hostname, device_ord, mgmt_ip, ...) under the names that were found at their addresses.

    found is (scan_id, mgmt_ip, hostname, ord); the last name of an address holds, and of two addresses with one name the
    later. The first device of the address with another name takes it: at the place of the device that had the name,
    which it replaces, or after all others. All renames look at the devices as given. `place` is the new order."""
    latest = last_rows(found.select("scan_id", "mgmt_ip", F.col("hostname").alias("_new"), F.col("ord").alias("_ord")), ["scan_id", "mgmt_ip"], ["_ord"])
    hits = devices.join(latest, ["scan_id", "mgmt_ip"]).where(F.col("hostname") != F.col("_new"))
    hits = last_rows(first_rows(hits, ["scan_id", "mgmt_ip"], ["device_ord"]), ["scan_id", "_new"], ["_ord"])
    # What is taken away: the old names, and devices that have a new name already.
    away = hits.select("scan_id", "hostname").unionByName(hits.select("scan_id", F.col("_new").alias("hostname"))).distinct()
    kept = devices.join(away, ["scan_id", "hostname"], "left_anti").withColumn("place", F.struct(F.lit(0).alias("part"), F.col("device_ord").cast("bigint").alias("at")))
    held = devices.select("scan_id", F.col("hostname").alias("_new"), F.col("device_ord").cast("bigint").alias("_held"))
    moved = hits.join(held, ["scan_id", "_new"], "left").withColumn("hostname", F.col("_new"))
    moved = moved.withColumn("place", F.struct(F.when(F.col("_held").isNull(), 1).otherwise(0).alias("part"), F.coalesce("_held", F.col("_ord").cast("bigint")).alias("at")))
    return kept.unionByName(moved.select(*kept.columns))
