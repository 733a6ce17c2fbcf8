"""Sheets that list records of one collector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lifecycle as life
from ..functions import network as net
from ..functions.text import filled, joined, present
from ..operators.rows import first_rows, looked_up

HOST = ["scan_id", "hostname"]
Tables = dict[str, DataFrame]


def place(*columns: str):
    return F.struct(*columns).alias("place")


def arp_summary(t: Tables) -> DataFrame:
    rows = t["arp.entries"].groupBy(*HOST, present("interface").alias("interface")).agg(F.count("*").alias("entry_count"))
    return rows.select("scan_id", F.col("hostname").alias("device"), "interface", "entry_count", place("hostname", "interface"))


def arp_detail(t: Tables) -> DataFrame:
    return t["arp.entries"].select("scan_id", F.col("hostname").alias("device"), *[present(c).alias(c) for c in ("interface", "ip", "mac", "age")], place("hostname", "item_ord"))


def arp_counts(t: Tables) -> DataFrame:
    """ARP entries by interface, VLAN interfaces first and by number, then the others by name."""
    rows = t["arp.entries"].groupBy(*HOST, F.coalesce(F.nullif("interface", F.lit("")), F.lit("Unknown")).alias("interface")).agg(F.count("*").alias("entry_count"))
    number = F.nullif(F.regexp_extract("interface", r"^[Vv]lan(\d+)$", 1), F.lit("")).try_cast("decimal(38,0)")
    order = F.struct("hostname", number.isNull().alias("other"), number.alias("number"), "interface")
    return rows.select("scan_id", F.col("hostname").alias("device"), "interface", "entry_count", order.alias("place"))


def mac_table(t: Tables) -> DataFrame:
    return t["mac_table.entries"].select("scan_id", F.col("hostname").alias("device"), present("mac").alias("mac_address"), present("vlan").alias("vlan"), present("type").alias("type"), present("ports").alias("port"), place("hostname", "item_ord"))


def interface_status(t: Tables) -> DataFrame:
    return t["interfaces.interfaces_status"].select("scan_id", F.col("hostname").alias("device"), present("port").alias("port"), present("name").alias("description"), *[present(c).alias(c) for c in ("status", "vlan", "duplex", "speed", "type")], place("hostname", "item_ord"))


def ip_interfaces(t: Tables) -> DataFrame:
    return t["interfaces.ip_interfaces"].select("scan_id", F.col("hostname").alias("device"), *[present(c).alias(c) for c in ("interface", "ip_address", "status", "protocol")], place("hostname", "item_ord"))


def links(t: Tables) -> DataFrame:
    """Neighbour links, each once whichever end it is seen from; the end that comes first by host counts."""
    n = t["cdp_lldp.neighbors"].select("scan_id", "hostname", "item_ord", F.coalesce("local_intf", F.lit("?")).alias("local_interface"), F.coalesce("remote_device", F.lit("Unknown")).alias("remote_device"), F.coalesce("remote_intf", F.lit("?")).alias("remote_interface"), present("remote_ip").alias("remote_ip"), joined(F.col("protocols")).alias("protocols"))
    keyed = n.withColumn("_key", net.link_key(F.col("hostname"), F.col("local_interface"), F.col("remote_device"), F.col("remote_interface")))
    one = first_rows(keyed, ["scan_id", "_key"], ["hostname", "item_ord"])
    return one.select("scan_id", F.col("hostname").alias("local_device"), "local_interface", "remote_device", "remote_interface", "remote_ip", "protocols", place("hostname", "item_ord"))


def described(df: DataFrame, pid: str, descriptions: DataFrame) -> DataFrame:
    """Adds platform_description: by the part number, else without its last part, else without what follows a slash. descriptions is (pid, description)."""
    p = F.col(pid)
    base = F.when(F.contains(p, F.lit("-")), F.regexp_replace(F.regexp_replace(p, "-+$", ""), "-[^-]*$", "")).otherwise(p)
    keys = [p, base, F.substring_index(p, "/", 1)]
    for i, key in enumerate(keys):
        df = df.join(descriptions.select(F.col("pid").alias(f"_k{i}"), F.col("description").alias(f"_d{i}")), key == F.col(f"_k{i}"), "left")
    out = df.withColumn("platform_description", F.when(present(pid) == "", "").otherwise(F.coalesce(*[F.col(f"_d{i}") for i in range(3)], F.lit(""))))
    return out.drop(*[f"_{x}{i}" for x in "kd" for i in range(3)])


def inventory_devices(t: Tables) -> DataFrame:
    """Devices with platform, version and serial number; a serial number may come from the first inventory item."""
    first = lambda name: t[f"device_inventory.{name}"].where("item_ord = 0")
    d = t["devices"].join(first("version").select(*HOST, "version", F.col("serial").alias("_s1"), "hardware"), HOST, "left")
    d = d.join(first("inventory").select(*HOST, F.col("sn").alias("_s2")), HOST, "left")
    d = d.select(*HOST, *[present(c).alias(c) for c in ("mgmt_ip", "device_type", "device_category")], filled("platform", "hardware").alias("platform"), present("version").alias("software_version"), filled("_s1", "_s2").alias("serial_number"))
    out = described(d, "platform", t["platform_descriptions"])
    return out.select("scan_id", "hostname", "mgmt_ip", "device_type", F.col("device_category").alias("category"), "platform", "platform_description", "software_version", "serial_number", place("hostname"))


def stack_members(t: Tables) -> DataFrame:
    m = t["device_inventory.stack_members"].join(t["devices"].select(*HOST, "mgmt_ip"), HOST)
    return m.select("scan_id", "hostname", present("mgmt_ip").alias("mgmt_ip"), filled("switch").alias("member"), filled("role").alias("role"), filled("model", "hw_ver").alias("model"), filled("serial").alias("serial"), filled("mac").alias("mac"), filled("priority").alias("priority"), filled("state").alias("state"), place("hostname", "item_ord"))


def modules(t: Tables) -> DataFrame:
    """Line cards; for devices without any module record, the components of the inventory."""
    m = t["device_inventory.modules"].select(*HOST, "item_ord", filled("slot").alias("slot"), filled("type").alias("type"), filled("model").alias("model"), filled("serial").alias("serial"), filled("status").alias("status"), filled("ports").alias("ports"))
    i = t["device_inventory.inventory"].join(m.select(*HOST).distinct(), HOST, "left_anti").where(life.is_component(F.col("name"), F.col("descr")))
    i = i.select(*HOST, "item_ord", filled("name").alias("slot"), filled("descr").alias("type"), filled("pid").alias("model"), filled("sn").alias("serial"), F.lit("").alias("status"), F.lit("").alias("ports"))
    rows = m.where(life.is_module(F.col("model"), F.col("type"))).unionByName(i).join(t["devices"].select(*HOST, "mgmt_ip"), HOST)
    return rows.select("scan_id", "hostname", present("mgmt_ip").alias("mgmt_ip"), "slot", "type", "model", "serial", "status", "ports", place("hostname", "item_ord"))


def configs(t: Tables) -> DataFrame:
    """Configurations that are not empty."""
    return t["config.config"].where("config <> ''").select("scan_id", "hostname", "config", place("hostname"))


def interface_notes(rows: DataFrame, t: Tables, interface: str = "interface") -> DataFrame:
    """Adds description and neighbor of an interface: the first record of that name in any case; descriptions by interface come before those by port."""
    d = t["interfaces.interfaces_description"]
    by_name = d.select(*HOST, "item_ord", F.lit(0).alias("_pass"), F.lower("interface").alias("_i"), "description")
    by_port = d.select(*HOST, "item_ord", F.lit(1).alias("_pass"), F.lower(F.coalesce("port", "interface")).alias("_i"), "description")
    n = t["cdp_lldp.neighbors"].select(*HOST, "item_ord", F.lower("local_intf").alias("_i"), F.col("remote_device").alias("neighbor"))
    rows = rows.withColumn("_i", F.lower(interface))
    rows = looked_up(rows, by_name.unionByName(by_port).where("_i <> ''"), [*HOST, "_i"], ["_pass", "item_ord"], "description")
    return looked_up(rows, n, [*HOST, "_i"], ["item_ord"], "neighbor").drop("_i")
