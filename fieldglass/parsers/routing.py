"""Routes, OSPF, BGP, EIGRP and VRFs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import present, whole
from .base import by_block, by_pattern, by_tokens, first_match, keys_of

IP = r"\d+\.\d+\.\d+\.\d+"
# VRFs for which no commands are sent.
SKIPPED_VRFS = ["default", "management", "Mgmt-vrf"]


def route_summary(df: DataFrame) -> DataFrame:
    rows = by_pattern(df, r"(\w+(?:\s\d+)?)\s{2,}(\d+)\s+", {"source": 1, "count": 2}, numbers=("count",))
    return rows.where(~F.lower("source").isin("route", "total", "maximum"))


def ospf_processes(df: DataFrame) -> DataFrame:
    """Processes with their distinct areas in the order in which they are named."""
    head = r"[^\n]*[Rr]outing\s+[Pp]rocess\s+\"?ospf\s+(\d+)\"?\s+with\s+ID\s+(\S+)"
    b = by_block(df, head)
    rest = F.regexp_replace("block", r"^[^\n]*\n?", "")
    areas = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"(?m)^[^\n]*\bArea\s+(\S+)"), F.lit(1)))
    return b.select(*keys_of(df), "item_ord", F.regexp_extract("block", head, 1).alias("process_id"), F.regexp_extract("block", head, 2).alias("router_id"), areas.alias("areas"))


def ospf_interfaces(df: DataFrame) -> DataFrame:
    """The first five columns, by place."""
    rows = by_tokens(df)
    rows = rows.where((F.size("t") >= 5) & ~F.lower(F.get("t", F.lit(0))).startswith("interface"))
    names = ["interface", "area", "cost", "state", "neighbors"]
    return rows.select(*keys_of(df), "item_ord", *[F.get("t", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _peer(df: DataFrame, last: str) -> DataFrame:
    """A number in the last column means prefixes of an established peer, anything else is the state."""
    n = whole(F.col(last))
    return df.withColumn("state", F.when(n.isNotNull(), "Established").otherwise(F.col(last))).withColumn("prefixes_received", F.coalesce(n, F.lit(0).cast("bigint")))


def bgp_summary(df: DataFrame) -> DataFrame:
    pattern = rf"\s*({IP})\s+\d+\s+(\d+)\s+\d+\s+\d+\s+\d+\s+\d+\s+\d+\s+(\S+)\s+(\S+)\s*$"
    rows = by_pattern(df, pattern, {"neighbor": 1, "asn": 2, "up_down": 3, "last": 4})
    return _peer(rows, "last").drop("last")


def bgp_records(df: DataFrame) -> DataFrame:
    """Records of a template library with the names of this schema."""
    for c in ("state_or_prefixes_received", "state_pfxrcd", "bgp_neighbor", "neighbor", "neighbor_as", "asn", "up_down"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    out = _peer(df.withColumn("_last", present("state_or_prefixes_received", "state_pfxrcd")), "_last")
    keys = [c for c in ("scan_id", "hostname", "item_ord") if c in df.columns]
    return out.select(*keys, present("bgp_neighbor", "neighbor").alias("neighbor"), present("neighbor_as", "asn").alias("asn"), present("up_down").alias("up_down"), "state", "prefixes_received")


def bgp_table(df: DataFrame) -> DataFrame:
    pattern = rf"\s*([*>sdhibSr ]{{0,4}})\s*({IP}(?:/\d+)?)\s+({IP})\s+(\d+)\s+(\d+)\s+\d+\s+(.+?)\s*$"
    rows = by_pattern(df, pattern, {"status": 1, "network": 2, "next_hop": 3, "metric": 4, "local_pref": 5, "path": 6})
    return rows.withColumn("status", F.trim("status")).withColumn("path", F.trim("path"))


def eigrp_topology(df: DataFrame) -> DataFrame:
    pattern = rf"([APUS])\s+({IP}(?:/\d+)?),\s+(\d+)\s+successors?,\s+FD\s+is\s+(\d+)"
    return by_pattern(df, pattern, {"code": 1, "network": 2, "successors": 3, "feasible_distance": 4}, numbers=("successors",))


def eigrp_neighbors(df: DataFrame) -> DataFrame:
    """Neighbours in detail; a later line may say that one is a stub."""
    head = rf"\s*\d+\s+({IP})\s+(\S+)\s+\d+\s+(\S+)"
    b = by_block(df, rf"[ \t]*\d+[ \t]+{IP}[ \t]+\S+[ \t]+\d+[ \t]+\S")
    stub = F.regexp_like("block", F.lit("(?i)stub peer"))
    flags = first_match(F.col("block"), r"(?i)stub peer[^(\r\n]*\(([^)]+)\)")
    part = lambda g: F.regexp_extract("block", f"^{head}", g)
    return b.select(*keys_of(df), "item_ord", part(1).alias("neighbor"), part(2).alias("interface"), part(3).alias("uptime"), stub.alias("stub"), F.trim(F.coalesce(flags, F.lit(""))).alias("stub_flags"))


def ios_vrfs(df: DataFrame) -> DataFrame:
    """show ip vrf: a line for each VRF, more interfaces on lines of 30 blanks and more."""
    head = r"(\S+)[ \t]+(\S+)[ \t]+\S+[ \t]+(\S+)[ \t]*$"
    b = by_block(df, rf"{head}")
    part = lambda g: F.regexp_extract("block", f"(?m)^{head}", g)
    more = F.regexp_extract("block", r"^[^\n]*\n((?:\s{30,}\S+[ \t]*(?:\R|\z))*)", 1)
    also = F.filter(F.split(more, r"\s+"), lambda x: x != "")
    rows = b.select(*keys_of(df), "item_ord", part(1).alias("name"), part(2).alias("rd"), F.concat(F.array(part(3)), also).alias("interfaces"))
    # A VRF named again adds interfaces to the first.
    keys = [*keys_of(df), "name"]
    grouped = rows.groupBy(*keys).agg(F.min("item_ord").alias("item_ord"), F.min_by("rd", "item_ord").alias("rd"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "interfaces"))), lambda x: x["interfaces"])).alias("interfaces"))
    return grouped.select(*keys_of(df), "item_ord", "name", "rd", F.lit("").alias("description"), "interfaces")


def nxos_vrfs(df: DataFrame) -> DataFrame:
    rows = by_pattern(df, r"(\S+)\s+(\d+)\s+(\S+)\s+(\S+)", {"name": 1})
    return rows.select(*rows.columns, F.lit("").alias("rd"), F.lit("").alias("description"), F.array().cast("array<string>").alias("interfaces"))


def ios_vrf_interfaces(df: DataFrame) -> DataFrame:
    rows = by_pattern(df, r"(\S+)\s+(\S+)\s+(\S+)\s+\S+", {"vrf": 3, "interface": 1, "ip_address": 2})
    return rows.where(F.length("ip_address") - F.length(F.replace("ip_address", F.lit("."), F.lit(""))) == 3)


def nxos_vrf_interfaces(df: DataFrame) -> DataFrame:
    return by_pattern(df, r"(\S+)\s+(\S+)\s+(\d+)\s+", {"vrf": 2, "interface": 1}).withColumn("ip_address", F.lit(""))


def vrf_routes(df: DataFrame) -> DataFrame:
    rows = by_pattern(df, rf"\s*([A-Z*]+(?:\s+\S+)?)\s+({IP}(?:/\d+)?)\s+(.+)", {"protocol": 1, "network": 2, "_rest": 3})
    via = F.regexp_replace(F.coalesce(first_match(F.col("_rest"), r"via\s+(\S+)"), F.lit("")), ",+$", "")
    return rows.withColumn("protocol", F.trim("protocol")).withColumn("next_hop", via).drop("_rest")


def vrf_arp(df: DataFrame) -> DataFrame:
    pattern = rf"\s*Internet\s+({IP})\s+(\S+)\s+([0-9a-fA-F]{{4}}\.[0-9a-fA-F]{{4}}\.[0-9a-fA-F]{{4}})\s+\S+\s+(\S+)"
    return by_pattern(df, pattern, {"ip_address": 1, "age": 2, "mac_address": 3, "interface": 4})


def by_vrf(raw: DataFrame, kind: str) -> DataFrame:
    """Raw outputs (command, text) of `show ip <kind> vrf <name>` with the name as vrf, instead of the command."""
    name = F.regexp_extract("command", rf"^show ip {kind} vrf (\S+)", 1)
    return raw.withColumn("vrf", name).where("vrf <> ''").drop("command")


def vrf_commands(vrfs: DataFrame) -> DataFrame:
    """The commands of the second phase: routes and ARP of every VRF but the usual ones."""
    keys = [c for c in vrfs.columns if c in ("scan_id", "hostname")]
    rows = vrfs.where(~F.col("name").isin(SKIPPED_VRFS))
    return rows.select(*keys, "item_ord", F.posexplode(F.transform(F.array(F.lit("route"), F.lit("arp")), lambda k: F.concat(F.lit("show ip "), k, F.lit(" vrf "), F.col("name")))).alias("ord", "command"))
