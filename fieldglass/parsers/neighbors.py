"""Neighbours and ARP entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network as net
from ..functions.text import whole
from .base import by_block, by_tokens, first_match, keys_of, last_match

L3_FIELDS = ["remote_ip", "remote_device", "local_intf", "protocol", "state"]
# Flags before NX-OS ARP entries, starts of lines that hold none, and what ends an LLDP description.
FLAGS = ["*", "+", "#", "CP", "PS", "RO", "D"]
ARP_HEADERS = ["Protocol", "MAC", "Destination", "Address", "IP", "Total", "ARP", "Flags"]
NOT_DESCRIPTION = ["Time remaining", "System Capabilities", "Enabled Capabilities", "Management", "IP:", "IPv4", "IPv6", "Auto Negotiation", "Physical media", "Vlan ID", "Local Port id"]
#: What is trimmed from fields.
BLANKS = " \t"


def _before_dot(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def cdp(df: DataFrame) -> DataFrame:
    """show cdp neighbors detail: blocks that begin with Device ID."""
    # One pass takes the lines of all fields; the patterns of each field then read no others.
    b = by_block(df, r"[ \t]*Device ID:").withColumn("_f", F.regexp_extract_all("block", F.lit(r"(?m)^(?:[ \t]*(?:Platform|Interface):[^\r\n]*|[^\n]*(?:IPv4 Address:|IP address:)[^\r\n]*)"), F.lit(0)))
    of = lambda name: F.array_join(F.filter("_f", lambda x: F.contains(x, F.lit(name))), "\n")
    b = b.select("*", of("Platform:").alias("_p"), of("Interface:").alias("_i"))
    # Of several addresses the last that is one counts; texts in parentheses are none.
    address = last_match(of("ddress:"), r"(?m)^[^\n]*(?:IPv4 Address:|IP address:)[ \t]*([^\s(][^\r\n]*?)[ \t]*$")
    return b.select(
        *keys_of(df), "item_ord",
        _before_dot(F.trim(first_match(F.substring_index("block", "\n", 1), r"Device ID:[ \t]*([^\r\n]*)"))).alias("remote_device"),
        address.alias("remote_ip"),
        last_match(F.col("_p"), r"(?m)^[ \t]*Platform:[ \t]*([^,\r\n]*?)[ \t]*(?:,|$)").alias("remote_platform"),
        last_match(F.col("_p"), r"(?m)^[ \t]*Platform:[^\r\n]*Capabilities:[ \t]*([^,\r\n]*?)[ \t]*(?:,|$)").alias("remote_capabilities"),
        last_match(F.col("_i"), r"(?m)^[ \t]*Interface:[ \t]*([^,\r\n]*?)[ \t]*(?:,|$)").alias("local_intf"),
        last_match(F.col("_i"), r"(?m)^[ \t]*Interface:[^,\r\n]*,[^,\r\n]*Port ID[^,\r\n]*:[ \t]*([^,:\r\n]*?)[ \t]*(?:,|$)").alias("remote_intf"),
    )


def lldp(df: DataFrame) -> DataFrame:
    """show lldp neighbors detail: blocks that begin with Chassis id. A description goes on over lines that start nothing else."""
    b = by_block(df, r"[ \t]*Chassis id:")
    # One pass takes the lines of all fields; each field is looked up among them.
    names = ["Chassis id", "Port id", "Local Port id", "System Name", "System Capabilities", "System Description"]
    b = b.withColumn("_f", F.regexp_extract_all("block", F.lit(rf"(?m)^[ \t]*(?:{'|'.join(names)}):.*"), F.lit(0)))
    b = b.withColumn("_f", F.transform("_f", lambda x: F.btrim(x, F.lit(BLANKS))))
    block = F.col("block")
    field = lambda name: F.btrim(F.substring(F.try_element_at(F.filter("_f", lambda x: x.startswith(f"{name}:")), F.lit(-1)), len(name) + 2, 1 << 30), F.lit(BLANKS))
    b = b.withColumn("_after", F.regexp_extract(block, r"(?ms)^[ \t]*System Description:[^\n]*\n?(.*)", 1))
    after = F.col("_after")
    stops = "|".join([*NOT_DESCRIPTION, "Chassis id:", "System Name:", "Port id:", "System Description:"])
    # Lines of a description without the blanks at their ends; each find takes a line, those that start something else with an empty group.
    after = F.when(F.contains(after, F.lit("\x0b")) | F.contains(after, F.lit("\f")), F.translate(after, "\x0b\f", "\n\n")).otherwise(after)
    described = F.array_remove(F.regexp_extract_all(after, F.lit(rf"[ \t]*+(?:(?:{stops}).*+|(.*(?<=\S)))"), F.lit(1)), "")
    has_description = F.exists("_f", lambda x: x.startswith("System Description:"))
    # Addresses count between the line that opens their section and one that starts something else.
    section = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*Management Address(?:es)?:[^\n]*\n((?:[ \t]*(?:(?:IP|Other)[^\n]*)?(?:\n|\z))*)"), F.lit(1))
    address = last_match(F.array_join(section, "\n"), r"(?m)^[ \t]*IP:[ \t]*(\S[^\r\n]*?)[ \t]*$")
    return b.select(
        *keys_of(df), "item_ord",
        _before_dot(field("System Name")).alias("remote_device"), address.alias("remote_ip"), field("Chassis id").alias("remote_platform"), field("System Capabilities").alias("remote_capabilities"),
        field("Local Port id").alias("local_intf"), field("Port id").alias("remote_intf"), F.when(has_description, F.array_join(described, " ")).alias("system_description"),
    )


def _l3(rows: DataFrame, keys: list[str], ip: Column, device: Column, interface: Column, protocol: str, state: Column) -> DataFrame:
    return rows.select(*keys, "item_ord", ip.alias("remote_ip"), device.alias("remote_device"), interface.alias("local_intf"), F.lit("Router").alias("remote_capabilities"), F.lit(protocol).alias("protocol"), state.alias("state"))


def _null() -> Column:
    return F.lit(None).cast("string")


def ospf(df: DataFrame) -> DataFrame:
    """show ip ospf neighbor: full or up neighbours with an address."""
    rows = by_tokens(df)
    state = F.upper(F.get("t", F.lit(2)))
    rows = rows.where((F.size("t") >= 6) & ~F.regexp_like("bare", F.lit("^(?:Neighbor|OSPF|Total)")) & (F.contains(state, F.lit("FULL")) | F.contains(state, F.lit("UP"))) & net.is_ipv4(F.get("t", F.lit(4))))
    return _l3(rows, keys_of(df), F.get("t", F.lit(4)), _null(), F.get("t", F.lit(5)), "OSPF", state)


def eigrp(df: DataFrame) -> DataFrame:
    """show ip eigrp neighbors: lines that begin with a number and an address."""
    rows = by_tokens(df)
    rows = rows.where((F.size("t") >= 3) & ~F.regexp_like("bare", F.lit("^(?:H |EIGRP|IP-EIGRP)")) & whole(F.get("t", F.lit(0))).isNotNull() & net.is_ipv4(F.get("t", F.lit(1))))
    return _l3(rows, keys_of(df), F.get("t", F.lit(1)), _null(), F.get("t", F.lit(2)), "EIGRP", F.lit("UP"))


def bgp(df: DataFrame) -> DataFrame:
    """show ip bgp neighbors: blocks by neighbour, established ones only; the local address stands for the interface."""
    b = by_block(df, r"[ \t]*BGP neighbor is ")
    block = F.col("block")
    state = last_match(block, r"(?m)^[^\r\n]*BGP state ?=[ \t]*([^,\r\n]*?)[ \t]*(?:,|$)")
    hosts = F.filter(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*Local host:[ \t]*([^,\r\n]*?)[ \t]*(?:,|$)"), F.lit(1)), net.is_ipv4)
    rows = b.withColumn("state", state).where(F.contains(F.upper("state"), F.lit("ESTABLISHED")))
    ip = F.trim(first_match(block, r"BGP neighbor is ([^,\r\n]*)"))
    return _l3(rows, keys_of(df), ip, _null(), F.try_element_at(hosts, F.lit(-1)), "BGP", F.col("state")).where("remote_ip <> ''")


def isis(df: DataFrame) -> DataFrame:
    """show isis neighbors: up neighbours, known by their system id."""
    rows = by_tokens(df)
    state = F.upper(F.get("t", F.lit(3)))
    rows = rows.where((F.size("t") >= 4) & ~F.regexp_like("bare", F.lit("^(?:System|IS-IS|Tag)")) & F.contains(state, F.lit("UP")))
    return _l3(rows, keys_of(df), _null(), F.get("t", F.lit(0)), F.get("t", F.lit(1)), "IS-IS", state)


PROTOCOLS = {"ospf": ospf, "eigrp": eigrp, "bgp": bgp, "isis": isis}


def l3_neighbors(texts: dict[str, DataFrame]) -> DataFrame | None:
    """The neighbours of several protocols, {protocol: texts}; unknown protocols have none."""
    parts = [PROTOCOLS[p.lower()](df) for p, df in texts.items() if p.lower() in PROTOCOLS]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def arp(df: DataFrame) -> DataFrame:
    """ARP tables in three layouts, tried in turn: Internet ip age mac type interface; mac ip name interface; [flag] ip age mac interface."""
    rows = by_tokens(df).where((F.col("bare") != "") & ~F.regexp_like("bare", F.lit(f"^(?:{'|'.join(ARP_HEADERS)})")))
    t = lambda i: F.get("t", F.lit(i) if isinstance(i, int) else i)
    n = F.size("t")
    ios = (n >= 5) & (t(0) == "Internet")
    junos = (n >= 4) & F.contains(t(0), F.lit(":")) & net.is_ipv4(t(1))
    at = F.when(t(0).isin(FLAGS), 1).otherwise(0)
    nxos = (n >= at + 3) & net.is_ipv4(t(at))
    record = lambda ip, mac, age, intf: F.array(F.struct(ip.alias("ip"), mac.alias("mac"), age.alias("age"), F.coalesce(intf, F.lit("")).alias("interface")))
    found = (
        F.when(ios, F.when(net.is_ipv4(t(1)), record(t(1), net.mac(t(3)), F.when(t(2) == "-", "0").otherwise(t(2)), t(5))))
        .when(junos, record(t(1), t(0), F.lit("?"), t(3)))
        .when(nxos, record(t(at), net.mac(t(at + 2)), t(at + 1), t(at + 3)))
    )
    # A list of one record or none: a filter would look at all layouts again.
    return rows.select(*keys_of(df), "item_ord", F.inline(found))
