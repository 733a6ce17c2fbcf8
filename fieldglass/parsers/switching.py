"""Spanning tree, VLANs, switch ports, gateways and stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as net
from ..functions.text import filled, plain_breaks
from ..operators.rows import last_rows
from .base import by_block, by_pattern, by_tokens, keys_of, last_match, tokens

# States of a gateway protocol.
STATES = ["Active", "Standby", "Listen", "Init", "Speak"]


def stp_detail(df: DataFrame) -> DataFrame:
    """show spanning-tree detail: ports within VLANs, with the VLAN's topology changes and each port's path cost."""
    head = r"[ \t]*VLAN(\d+)\s+is\s+executing"
    vlans = by_block(df, head, outer="_vlan_ord")
    port = r"[^\n]*Port\s+\d+\s+\((.+?)\)\s+of\s+VLAN\d+\s+is\s+(\S+)\s+(\S+)"
    before = F.regexp_extract("block", rf"(?s)^(.*?)(?:\n{port}|\z)", 1)
    changes = F.coalesce(last_match(before, r"Number of topology changes\s+(\d+)").cast("bigint"), F.lit(0).cast("bigint"))
    # Taken by a fixed pattern, which is compiled once, where a split compiles it for each block.
    pieces = F.regexp_extract_all("block", F.lit(rf"(?m)^(?={port})(?s:.+?)(?:(?=^{port})|\z)"), F.lit(0))
    ports = vlans.select(*keys_of(df), "_vlan_ord", F.regexp_extract("block", f"^{head}", 1).cast("bigint").alias("vlan"), changes.alias("topology_changes"), F.posexplode(F.filter(pieces, lambda b: F.regexp_like(b, F.lit(f"^{port}")))).alias("_port_ord", "block"))
    part = lambda g: F.regexp_extract("block", f"^{port}", g)
    cost = F.coalesce(last_match(F.col("block"), r"Port path cost\s+(\d+)").cast("bigint"), F.lit(0).cast("bigint"))
    return ports.select(*keys_of(df), (F.col("_vlan_ord") * 100_000 + F.col("_port_ord")).alias("item_ord"), "vlan", F.trim(F.substring_index(part(1), ",", 1)).alias("interface"), part(2).alias("role"), part(3).alias("state"), cost.alias("cost"), "topology_changes")


def inconsistent_ports(df: DataFrame) -> DataFrame:
    """Lines after the rule of dashes."""
    after = df.withColumn("text", F.regexp_extract(F.coalesce("text", F.lit("")), r"(?ms)^[ \t]*---[^\n]*\n(.*)", 1))
    return by_pattern(after, r"\s*VLAN(\d+)\s+(\S+)\s+(.+?)\s*$", {"interface": 2, "vlan": 1, "type": 3}, numbers=("vlan",))


def stp_roots(df: DataFrame) -> DataFrame:
    """Root summary; without a root port the last column stands for it."""
    pattern = r".*?VLAN(\d+)\s+(\d+)\s+([0-9a-fA-F.]+)\s+(\d+)\s+.*?(?:(\S+)\s*)?$"
    return by_pattern(df, pattern, {"vlan": 1, "priority": 2, "root_address": 3, "cost": 4, "port": 5}, numbers=("vlan", "priority", "cost"))


def port_states(df: DataFrame) -> DataFrame:
    """show spanning-tree: role, status and type of each port of a VLAN; the last of a port holds."""
    b = by_block(df.withColumn("text", plain_breaks(F.col("text"))), r"[ \t]*VLAN0*\d+[ \t]*$")
    vlan = F.regexp_extract("block", r"^\s*VLAN0*(\d+)", 1)
    port = r"(?m)^[ \t]*(\S+)[ \t]+(Root|Desg|Altn|Back|Mstr)[ \t]+(\S+)[ \t]+\S+[ \t]+\S+[ \t]+(\S.*?)[ \t]*$"
    rows = b.select(*keys_of(df), F.col("item_ord").alias("_block"), vlan.alias("vlan_id"), F.posexplode(F.regexp_extract_all("block", F.lit(port), F.lit(0))).alias("item_ord", "_port"))
    # One match for all fields, each then in a line of its own.
    fields = F.split(F.regexp_replace("_port", port, "$1\n$2\n$3\n$4"), "\n")
    part = lambda i: F.get(fields, F.lit(i))
    rows = rows.select(*keys_of(df), "_block", "item_ord", "vlan_id", part(0).alias("interface"), part(1).alias("role"), part(2).alias("status"), part(3).alias("stp_type"))
    return last_rows(rows, [*keys_of(df), "vlan_id", "interface"], ["_block", "item_ord"]).drop("_block", "item_ord")


def blocked_ports(blocked: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """show spanning-tree blockedports, with role, status and reason from show spanning-tree where that is there."""
    keys = keys_of(blocked)
    # The table begins after the line that names it.
    table = blocked.withColumn("text", F.regexp_extract(F.coalesce("text", F.lit("")), r"(?is)^(?:.*?\n)??[^\n]*(?:Blocked Interfaces|blocked ports)[^\n]*\n(.*)", 1))
    rows = by_tokens(table).where((F.size("t") >= 2) & ~F.col("bare").startswith("---") & ~F.col("bare").startswith("Number of blocked") & ~F.contains("bare", F.lit("Blocked Interfaces")) & ~F.contains(F.lower("bare"), F.lit("blocked ports")))
    ports = tokens(F.replace(F.array_join(F.slice("t", 2, F.size("t")), " "), F.lit(","), F.lit(" ")))
    rows = rows.select(*keys, F.col("item_ord").alias("_line"), net.vlan_id(F.get("t", F.lit(0))).alias("vlan_id"), F.posexplode(ports).alias("_port", "interface"))
    if full is None:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("role", "status", "stp_type")])
    else:
        rows = rows.join(port_states(full), [*keys, "vlan_id", "interface"], "left")
    reason = F.regexp_extract(F.coalesce("stp_type", F.lit("")), r"\*(\S+)", 1)
    return rows.select(*keys, (F.col("_line") * 1_000 + F.col("_port")).alias("item_ord"), "vlan_id", "interface", F.lit("").alias("name"), F.coalesce("status", F.lit("BLK")).alias("status"), F.coalesce("role", F.lit("")).alias("role"), reason.alias("reason"))


def _with(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in columns if c not in df.columns])


def root_records(df: DataFrame) -> DataFrame:
    """Spanning-tree roots of a template library under one set of names."""
    df = _with(df, "vlan_id", "root_address", "root_id", "root_priority", "priority", "root_cost", "root_port", "hello_time", "max_age", "fwd_delay", "fwd_dly")
    keep = [c for c in ("scan_id", "hostname", "device_ord", "item_ord") if c in df.columns]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*keep, net.vlan_id(text("vlan_id")).alias("vlan_id"), filled("root_address", "root_id").alias("root_address"), filled("root_priority", "priority").alias("root_priority"), text("root_cost").alias("root_cost"), text("root_port").alias("root_port"), text("hello_time").alias("hello_time"), text("max_age").alias("max_age"), filled("fwd_delay", "fwd_dly").alias("fwd_delay"))


def vlan_records(df: DataFrame) -> DataFrame:
    df = _with(df, "vlan_id", "name", "vlan_name")
    keep = [c for c in ("scan_id", "hostname", "device_ord", "item_ord") if c in df.columns]
    return df.select(*keep, net.vlan_id(F.coalesce(F.col("vlan_id").cast("string"), F.lit(""))).alias("vlan_id"), filled("name", "vlan_name").alias("name"))


def switchports(df: DataFrame) -> DataFrame:
    """show interfaces switchport: blocks that begin with Name. The native VLAN is that of the last line that names one."""
    b = by_block(df, "Name:")
    block = F.col("block")
    line = lambda name: F.trim(F.coalesce(last_match(block, rf"(?m)^[ \t]*(?:{name}):([^\r\n]*)"), F.lit("")))
    vlan = last_match(block, r"(?m)^[ \t]*(?:Access Mode VLAN|Trunking Native Mode VLAN):[ \t]*([^\r\n]*)")
    number = F.regexp_extract(F.coalesce(vlan, F.lit("")), r"^(\d+)", 1)
    voice = line("Voice VLAN")
    return b.select(
        *keys_of(df), "item_ord", F.trim(F.regexp_extract("block", r"^Name:\s*([^\r\n]*)", 1)).alias("interface"), line("Administrative Mode").alias("mode"), line("Operational Mode").alias("operational_mode"), line("Administrative Trunking Encapsulation").alias("trunking_encapsulation"),
        F.when(number != "", number).otherwise(F.trim(F.coalesce(vlan, F.lit("")))).alias("native_vlan"), line("Trunking VLANs Enabled|Trunking VLANs Allowed").alias("allowed_vlans"), F.when(F.lower(voice) == "none", "").otherwise(voice).alias("voice_vlan"),
    )


def switchport_records(df: DataFrame) -> DataFrame:
    """Switch ports of a template library under one set of names; lists of VLANs as text."""
    df = _with(df, "interface", "mode", "admin_mode", "native_vlan", "allowed_vlans", "trunking_vlans", "voice_vlan")
    if dict(df.dtypes)["trunking_vlans"].startswith("array"):
        df = df.withColumn("trunking_vlans", F.array_join("trunking_vlans", ","))
    keep = [c for c in ("scan_id", "hostname", "device_ord", "item_ord") if c in df.columns]
    voice = F.coalesce("voice_vlan", F.lit(""))
    text = lambda *c: F.coalesce(*c, F.lit(""))
    return df.select(*keep, text("interface").alias("interface"), text("mode", "admin_mode").alias("mode"), text("native_vlan").alias("native_vlan"), text("allowed_vlans", "trunking_vlans").alias("allowed_vlans"), F.when(F.lower(voice) == "none", "").otherwise(voice).alias("voice_vlan"))


def _vlan_interface(c):
    return F.regexp_replace(c, r"^Vl(\d)", r"Vlan$1")


def hsrp_brief(df: DataFrame) -> DataFrame:
    """show standby brief or show hsrp brief: rows after the header. The state is the first token that names one exactly, else in any case; the last address is the virtual one."""
    after = df.withColumn("text", F.regexp_extract(F.coalesce("text", F.lit("")), r"(?ms)^[^\n]*Interface[^\n]*(?:Grp|Group)[^\n]*\n(.*)", 1))
    rows = by_tokens(after).where((F.size("t") >= 5) & ~F.regexp_like("bare", F.lit(r"^(?:---|\*:)")) & ~F.regexp_like("bare", F.lit("Interface.*(?:Grp|Group)")))
    ips = F.filter("t", lambda x: F.regexp_like(x, F.lit(r"^\d+\.\d+\.\d+\.\d+")))
    exact = F.try_element_at(F.filter("t", lambda x: x.isin(STATES)), F.lit(1))
    loose = F.try_element_at(F.filter("t", lambda x: F.lower(x).isin([s.lower() for s in STATES])), F.lit(1))
    state = F.when(F.size(ips) > 0, F.coalesce(exact, F.initcap(loose), F.lit(""))).otherwise("")
    return rows.select(*keys_of(df), "item_ord", _vlan_interface(F.get("t", F.lit(0))).alias("interface"), F.get("t", F.lit(1)).alias("group"), F.get("t", F.lit(2)).alias("priority"), F.coalesce(F.try_element_at(ips, F.lit(-1)), F.lit("")).alias("virtual_ip"), state.alias("state"))


def hsrp_records(df: DataFrame) -> DataFrame:
    """Gateway records of a template library, in either case of names, where interface and virtual address are there."""
    df = df.toDF(*[c.lower() for c in df.columns])
    df = _with(df, "interface", "group", "grp", "group_number", "priority", "pri", "configured_priority", "virtual_ip", "virtualip", "primary_ipv4_address", "state", "hsrp_router_state")
    keep = [c for c in ("scan_id", "hostname", "device_ord", "item_ord") if c in df.columns]
    out = df.select(*keep, _vlan_interface(filled("interface")).alias("interface"), filled("group", "grp", "group_number").alias("group"), filled("priority", "pri", "configured_priority").alias("priority"), filled("virtual_ip", "virtualip", "primary_ipv4_address").alias("virtual_ip"), filled("state", "hsrp_router_state").alias("state"))
    return out.where("interface <> '' and virtual_ip <> ''")


def stack_members(df: DataFrame) -> DataFrame:
    """show switch detail: members wherever the pattern is found."""
    pattern = r"(?i)[* ]*(\d+)\s+(\w+)\s+([0-9a-f.]+)\s+(\d+)\s+(\S+)\s+(\S+)"
    hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
    rows = df.select(*keys_of(df), F.posexplode(hits).alias("item_ord", "hit"))
    names = ["switch", "role", "mac_address", "priority", "hw_ver", "state"]
    return rows.select(*keys_of(df), "item_ord", *[F.regexp_extract("hit", pattern, g).alias(n) for g, n in enumerate(names, 1)])
