"""Lifecycle of hardware, modules and software, as of a given day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lifecycle as life
from ..functions.text import filled, present
from ..operators.rows import first_rows
from .flat import HOST, Tables

#: Columns of a record that sheets show.
DATES = ["end_of_sale", "end_of_sw_maintenance", "end_of_vulnerability_support", "end_of_service_contract_renewal", "last_date_of_support"]
RECORD = ["description", *DATES, "migration_pid", "migration_name", "bulletin_url"]


def _first(c: Column) -> Column:
    """The first of a list that has been made text."""
    return F.substring_index(c, ", ", 1)


def records(t: Tables, as_of: Column, kind: str) -> DataFrame:
    """(scan_id, key, record fields, unlisted) of fresh cached records of hardware ("hw") or software ("sw")."""
    fresh = t["eox_cache"].where(F.startswith("key", F.lit(f"{kind}:")) & (F.datediff(as_of, F.try_to_date(F.substring("fetched_at", 1, 10), "yyyy-MM-dd")) < life.TTL_DAYS))
    return fresh.select("scan_id", F.substring("key", 4, 100_000).alias("key"), *[F.col("record")[c].alias(c) for c in RECORD], (F.lower(F.coalesce(F.col("record")["_pid_not_found"], F.lit(""))) == "true").alias("unlisted"), F.lit(True).alias("known"))


def _devices(t: Tables) -> DataFrame:
    return t["devices"].where(F.startswith("device_type", F.lit("cisco"))).select(*HOST, present("mgmt_ip").alias("mgmt_ip"), "device_type", life.clean_pid(F.col("platform")).alias("platform_pid"), present("platform").alias("platform"))


def _items(t: Tables) -> DataFrame:
    i = t["device_inventory.inventory"]
    return i.select(*HOST, "item_ord", present("name").alias("name"), life.clean_pid(F.col("pid")).alias("clean"), present("pid").alias("pid"), filled("sn").alias("sn"), filled("descr").alias("descr"))


def chassis(t: Tables) -> DataFrame:
    """The chassis of each device: part number from show version, else the platform, overridden by the inventory's chassis; stacks without any go by their first member."""
    v = t["device_inventory.version"].where("item_ord = 0").select(*HOST, life.clean_pid(_first(F.col("hardware"))).alias("v_pid"), _first(present("serial")).alias("v_serial"))
    name = F.lower(F.trim("name"))
    i = _items(t)
    own = first_rows(i.where(F.contains(name, F.lit("chassis")) | (name == "1")).select(*HOST, "item_ord", F.col("clean").alias("c_pid"), F.col("sn").alias("c_sn"), F.col("descr").alias("c_descr")), HOST, ["item_ord"]).drop("item_ord")
    member = first_rows(i.where(F.regexp_like(F.trim("name"), F.lit(r"^[Ss]witch\s+1$")) & (F.col("clean") != "")).select(*HOST, "item_ord", F.col("clean").alias("m_pid"), F.col("sn").alias("m_sn"), F.col("descr").alias("m_descr")), HOST, ["item_ord"]).drop("item_ord")
    d = _devices(t).join(v, HOST, "left").join(own, HOST, "left").join(member, HOST, "left")
    pid = filled("c_pid", "v_pid", "platform_pid")
    bare = pid == ""
    return d.select(
        *HOST, "mgmt_ip", "platform_pid", F.when(bare, present("m_pid")).otherwise(pid).alias("pid"), F.when(bare, filled("c_sn", "v_serial", "m_sn")).otherwise(filled("c_sn", "v_serial")).alias("serial"),
        F.when(bare, filled("c_descr", "m_descr")).otherwise(present("c_descr")).alias("descr"),
    )


def _row(df: DataFrame, as_of: Column, *head: Column, no_pid: Column | None = None) -> DataFrame:
    gone = no_pid if no_pid is not None else F.lit(False)
    state = life.state(F.col("known"), F.col("unlisted"), gone, F.col("last_date_of_support"), F.col("end_of_sale"), as_of)
    days = F.when(state.isin(life.NO_PID, life.NO_DATA, life.UNLISTED), F.lit(None)).otherwise(life.days_left(F.col("last_date_of_support"), as_of))
    order = F.struct(days.isNull().alias("blank"), F.coalesce(days, F.lit(0)).alias("days"), "hostname", "item_ord")
    return df.select("scan_id", *head, *[present(c).alias(c) for c in DATES], days.cast("bigint").alias("days_remaining"), state.alias("status"), present("migration_pid").alias("replacement_pid"), present("migration_name").alias("replacement_name"), present("bulletin_url").alias("bulletin_url"), order.alias("place"))


def hardware(t: Tables, as_of: Column) -> DataFrame:
    """A row for each chassis and stack member, the most urgent first."""
    hw = records(t, as_of, "hw")
    c = chassis(t)
    by = lambda df, key: df.join(hw.withColumnRenamed("key", key), ["scan_id", key], "left")
    # A platform that has a record replaces a part number that has none.
    listed = hw.where("not unlisted").select("scan_id", F.col("key").alias("platform_pid"), F.lit(True).alias("alt"))
    first = hw.select("scan_id", F.col("key").alias("pid"), (~F.col("unlisted")).alias("hit"))
    c = c.join(listed, ["scan_id", "platform_pid"], "left").join(first, ["scan_id", "pid"], "left")
    swap = (F.col("pid") != "") & ~F.coalesce("hit", F.lit(False)) & F.coalesce("alt", F.lit(False)) & (F.col("platform_pid") != F.col("pid"))
    c = c.withColumn("pid", F.when(swap, F.col("platform_pid")).otherwise(F.col("pid"))).drop("alt", "hit")
    rows = by(c.withColumn("item_ord", F.lit(-1)), "pid")
    none = F.col("pid") == ""
    description = F.when(none | ~F.coalesce("known", F.lit(False)), F.when(none, F.col("descr")).otherwise("")).otherwise(present("description"))
    head = lambda component, text: [F.col("hostname").alias("device_name"), F.col("mgmt_ip").alias("management_ip"), component.alias("component"), F.col("pid"), text.alias("description"), F.col("serial").alias("serial_number")]
    a = _row(rows, as_of, *head(F.lit("Chassis"), F.when(~none & F.col("known").isNull(), F.col("descr")).otherwise(description)), no_pid=none)
    # Members by the inventory item of their number, else their own model, else the chassis.
    number = F.regexp_extract(F.trim("name"), r"^[Ss]witch\s+(\d+)", 1)
    per = first_rows(_items(t).where((number != "") & (F.col("clean") != "")).select(*HOST, "item_ord", number.alias("switch"), F.col("clean").alias("i_pid"), F.col("sn").alias("i_sn"), F.col("descr").alias("i_descr")), [*HOST, "switch"], ["item_ord"]).drop("item_ord")
    m = t["device_inventory.stack_members"].select(*HOST, "item_ord", present("switch").alias("switch"), life.clean_pid(F.col("model")).alias("own"), present("serial").alias("own_serial"))
    m = m.join(per, [*HOST, "switch"], "left").join(c.select(*HOST, "mgmt_ip", F.col("pid").alias("c_pid")), HOST)
    m = by(m.withColumn("pid", filled("i_pid", "own", "c_pid")).withColumn("serial", filled("i_sn", "own_serial")), "pid")
    b = _row(m, as_of, *head(F.concat(F.lit("Stack Member "), "switch"), F.when(F.col("known"), present("description")).otherwise(present("i_descr"))))
    return a.unionByName(b)


def modules(t: Tables, as_of: Column) -> DataFrame:
    """Modules, then inventory items that are no chassis, slots or consumables; looked up by the part number as it is written."""
    hw = records(t, as_of, "hw")
    d = _devices(t).select(*HOST, "mgmt_ip")
    m = t["device_inventory.modules"].select(*HOST, "item_ord", present("model").alias("pid"), present("serial").alias("serial"), F.concat(F.lit("Module Slot "), present("slot")).alias("component"), F.lit("").alias("descr"))
    m = m.where((F.col("pid") != "") & ~life.is_chassis(F.col("pid")) & ~life.is_consumable(F.col("pid"), F.lit(""), F.lit("")))
    i = _items(t).where((F.col("pid") != "") & ~F.contains(F.lower("name"), F.lit("chassis")) & ~life.is_slot(F.col("name")) & ~life.is_chassis(F.col("pid")) & ~life.is_consumable(F.col("name"), F.col("descr"), F.col("pid")))
    i = i.select(*HOST, (F.col("item_ord") + 1_000_000).alias("item_ord"), "pid", F.col("sn").alias("serial"), F.col("name").alias("component"), "descr")
    rows = m.unionByName(i).join(d, HOST).join(hw.withColumnRenamed("key", "pid"), ["scan_id", "pid"], "left")
    text = F.when(F.col("known"), present("description")).otherwise(F.col("descr"))
    return _row(rows, as_of, F.col("hostname").alias("device_name"), F.col("mgmt_ip").alias("management_ip"), "component", "pid", text.alias("description"), F.col("serial").alias("serial_number"))


def software(t: Tables, as_of: Column) -> DataFrame:
    sw = records(t, as_of, "sw")
    v = t["device_inventory.version"].where("item_ord = 0").select(*HOST, _first(present("version")).alias("version"), _first(present("hardware")).alias("hardware"))
    d = _devices(t).join(v, HOST, "left").withColumn("os", life.os_type(F.col("device_type"))).withColumn("item_ord", F.lit(0))
    key = F.when((present("version") != "") & F.col("os").isNotNull(), F.concat(life.software_version(F.col("version"), F.col("os")), F.lit("|"), "os"))
    d = d.withColumn("key", key).join(sw, ["scan_id", "key"], "left")
    rows = _row(d, as_of, F.col("hostname").alias("device_name"), F.col("mgmt_ip").alias("management_ip"), "device_type", filled("platform", "hardware").alias("platform"), present("version").alias("current_version"), present("os").alias("os_type"))
    return rows.drop("end_of_service_contract_renewal", "replacement_pid", "replacement_name")


def wanted(t: Tables) -> DataFrame:
    """Distinct keys to look up: part numbers of inventories, stacks, modules and platforms, and versions with their family."""
    d = _devices(t)
    of = lambda df, c: df.join(d.select(*HOST), HOST).select("scan_id", life.clean_pid(F.col(c)).alias("pid"))
    pids = of(t["device_inventory.inventory"], "pid").unionByName(of(t["device_inventory.stack_members"], "model")).unionByName(of(t["device_inventory.modules"], "model")).unionByName(d.select("scan_id", F.col("platform_pid").alias("pid")))
    hw = pids.where("pid <> ''").select("scan_id", F.concat(F.lit("hw:"), "pid").alias("key"))
    v = t["device_inventory.version"].where("item_ord = 0").join(d.select(*HOST, life.os_type(F.col("device_type")).alias("os")), HOST)
    sw = v.where((_first(present("version")) != "") & F.col("os").isNotNull()).select("scan_id", F.concat(F.lit("sw:"), life.software_version(_first(F.col("version")), F.col("os")), F.lit("|"), "os").alias("key"))
    return hw.unionByName(sw).distinct()


def breakdown(hw: DataFrame, mod: DataFrame, sw: DataFrame, states: DataFrame) -> DataFrame:
    """(scan_id, status, hw_chassis, hw_modules, software) for every state. states is (scan_id, ord, status)."""
    counts = None
    for name, df in (("hw_chassis", hw), ("hw_modules", mod), ("software", sw)):
        part = df.select("scan_id", "status", *[F.lit(1 if n == name else 0).alias(n) for n in ("hw_chassis", "hw_modules", "software")])
        counts = part if counts is None else counts.unionByName(part)
    n = counts.groupBy("scan_id", "status").agg(*[F.sum(c).alias(c) for c in ("hw_chassis", "hw_modules", "software")])
    out = states.join(n, ["scan_id", "status"], "left")
    return out.select("scan_id", "status", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("hw_chassis", "hw_modules", "software")], F.struct("ord").alias("place"))


def status_sheet(t: Tables, as_of: Column) -> DataFrame:
    every = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("status")) for i, s in enumerate(life.STATES)])
    states = t["devices"].select("scan_id").distinct().select("scan_id", F.explode(every).alias("s")).select("scan_id", "s.ord", "s.status")
    return breakdown(hardware(t, as_of), modules(t, as_of), software(t, as_of), states)


def summary(t: Tables, as_of: Column) -> DataFrame:
    """Counts of devices, part numbers and versions, with and without data."""
    from .l2 import metrics

    d = t["devices"].groupBy("scan_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.startswith("device_type", F.lit("cisco")), F.lit(False))).alias("cisco"))
    known = F.col("status") != life.NO_DATA
    pids = hardware(t, as_of).select("scan_id", "pid", "status").unionByName(modules(t, as_of).select("scan_id", "pid", "status")).where("pid <> ''")
    pids = pids.groupBy("scan_id").agg(F.countDistinct("pid").alias("pids"), F.countDistinct(F.when(known, F.col("pid"))).alias("pids_known"))
    sw = software(t, as_of).where("current_version <> ''").groupBy("scan_id").agg(F.countDistinct("current_version").alias("sw"), F.countDistinct(F.when(known, F.col("current_version"))).alias("sw_known"))
    row = d.join(pids, "scan_id", "left").join(sw, "scan_id", "left").na.fill(0)
    row = row.withColumn("other", F.col("total") - F.col("cisco")).withColumn("pids_none", F.col("pids") - F.col("pids_known")).withColumn("sw_none", F.col("sw") - F.col("sw_known"))
    return metrics(row, [("Total Devices", "total"), ("Cisco Devices", "cisco"), ("Non-Cisco Devices (skipped)", "other"), ("Unique PIDs Checked", "pids"), ("PIDs with EOX Data", "pids_known"), ("PIDs with No EOX Data", "pids_none"), ("Unique Versions Checked", "sw"), ("Versions with EOX Data", "sw_known"), ("Versions with No EOX Data", "sw_none")])


