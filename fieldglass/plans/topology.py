"""Nodes and edges of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as net
from ..functions.text import filled
from ..operators.rows import first_rows
from .flat import Tables


def _neighbors(t: Tables) -> DataFrame:
    n = t["cdp_lldp.neighbors"]
    return n.select("scan_id", "hostname", "device_ord", "item_ord", F.coalesce("remote_device", F.lit("Unknown")).alias("target"), F.coalesce("local_intf", F.lit("?")).alias("local"), F.coalesce("remote_intf", F.lit("?")).alias("remote"), F.coalesce("protocols", F.array().cast("array<string>")).alias("protocols"))


def edges(t: Tables) -> DataFrame:
    """One edge for each pair of devices, the first record of either; parallel links collapse."""
    n = _neighbors(t).withColumn("_k", F.struct(F.least("hostname", "target").alias("a"), F.greatest("hostname", "target").alias("b")))
    e = first_rows(n, ["scan_id", "_k"], ["device_ord", "item_ord"])
    return e.select("scan_id", F.col("hostname").alias("source"), "target", net.short_interface(F.col("local")).alias("local_interface"), net.short_interface(F.col("remote")).alias("remote_interface"), net.link_layer(F.col("protocols")).alias("link_type"), F.array_join("protocols", "+").alias("protocols"), F.struct("device_ord", "item_ord").alias("place"))


def seed_host(t: Tables) -> DataFrame:
    """(scan_id, seed): the first device with the seed's address."""
    return t["devices"].join(t["scans"].select("scan_id", F.col("seed_ip").alias("mgmt_ip")), ["scan_id", "mgmt_ip"]).groupBy("scan_id").agg(F.min_by("hostname", "device_ord").alias("seed"))


def nodes(t: Tables) -> DataFrame:
    """Devices and the neighbours they name. Routing and ARP are not known here."""
    d = t["devices"].select("scan_id", F.col("hostname").alias("id"), filled("device_category").alias("kind"))
    names = d.select("scan_id", "id").unionByName(_neighbors(t).select("scan_id", F.col("target").alias("id"))).distinct()
    out = names.join(d, ["scan_id", "id"], "left").join(seed_host(t), "scan_id", "left")
    kind = filled("kind")
    kind = F.when(kind == "", "unknown").otherwise(kind)
    return out.select("scan_id", "id", net.short_host(F.col("id")).alias("label"), kind.alias("type"), net.colour(kind).alias("color"), F.col("id").alias("full_name"), F.coalesce(F.col("id") == F.col("seed"), F.lit(False)).alias("is_seed"), F.lit(False).alias("has_routing"), F.lit(0).cast("bigint").alias("arp_count"), F.struct("id").alias("place"))
