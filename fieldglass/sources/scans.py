"""Scan documents: one JSON document a scan, with a map of devices that hold raw and parsed output of collectors.

Documents are read as texts, one a row, and taken apart with JSON functions: scalars are read as text, lists as lists,
so that fields that are a list here and a scalar there, or whose names vary, come under one schema. Order in a document
means something (first and last wins), so every table carries device_ord and item_ord.

A document may also come in parts, where a column `place` orders them: each part is a document with some of the devices
(one, say), so that no row holds a scan. Every part has the document's id; the rest of what isn't a device counts as the
first part has it. Places differ by the number of a part's devices at least. A document is left out if one of its parts
does not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_table

KEYS = ["scan_id", "hostname", "device_ord"]
#: The column that orders the parts of a document.
PLACE = "place"
#: Record lists of a collector: collector -> list -> {column: names that may hold it}. Arrays end with [].
RECORDS: dict[tuple[str, str], dict[str, list[str]]] = {
    ("cdp_lldp", "neighbors"): {c: [c] for c in ("remote_device", "remote_ip", "remote_platform", "remote_capabilities", "local_intf", "remote_intf", "system_description", "protocols[]")},
    ("l3_routing", "neighbors"): {c: [c] for c in ("remote_ip", "remote_device", "local_intf", "protocol", "state", "protocols[]")},
    ("l3_routing", "routes"): {"network": ["network", "destination"], "mask": ["mask", "prefix_length"], "next_hop": ["nexthop_ip", "next_hop"], "interface": ["nexthop_if", "interface"], "protocol": ["protocol"], "metric": ["metric"]},
    ("arp", "entries"): {"ip": ["ip", "address"], "mac": ["mac", "hardware"], "interface": ["interface", "port"], "age": ["age"]},
    ("mac_table", "entries"): {"mac": ["mac", "destination_address"], "vlan": ["vlan", "vlan_id"], "type": ["type"], "ports": ["ports", "destination_port"]},
    ("interfaces", "interfaces_status"): {"port": ["port", "interface"], "name": ["name", "description"], "status": ["status"], "vlan": ["vlan"], "duplex": ["duplex"], "speed": ["speed"], "type": ["type"]},
    ("interfaces", "interfaces_description"): {"interface": ["interface"], "port": ["port"], "description": ["description"]},
    ("interfaces", "ip_interfaces"): {"interface": ["intf", "interface"], "ip_address": ["ipaddr", "ip_address"], "status": ["status"], "protocol": ["proto", "protocol"]},
    ("interfaces", "ip_interfaces_full"): {c: [c] for c in ("interface", "ip_address[]", "prefix_length[]", "primary_ip_address", "primary_ip_subnet", "secondary_ip_address[]", "secondary_ip_subnet[]")},
    ("device_inventory", "version"): {"version": ["version|os_version|os"], "serial": ["serial|serial_number|serialnum"], "hardware": ["hardware|platform"]},
    ("device_inventory", "inventory"): {"name": ["name"], "descr": ["descr|description"], "pid": ["pid"], "sn": ["sn|serial_number"]},
    ("device_inventory", "modules"): {"slot": ["module|slot"], "type": ["type|module_type"], "model": ["model"], "serial": ["serial|serialnum"], "status": ["status"], "ports": ["ports"]},
    ("device_inventory", "stack_members"): {"switch": ["switch|member"], "role": ["role"], "model": ["model"], "hw_ver": ["hw_ver"], "serial": ["serial|serialnum"], "mac": ["mac_address|mac"], "priority": ["priority"], "state": ["state|status"]},
    ("stp_vlan", "spanning_tree_root"): {"vlan_id": ["vlan_id"], "root_address": ["root_address|root_id"], "root_priority": ["root_priority|priority"], "root_cost": ["root_cost"], "root_port": ["root_port"]},
    ("stp_vlan", "vlans"): {"vlan_id": ["vlan_id"], "name": ["name|vlan_name"]},
    ("stp_vlan", "blocked_ports"): {c: [c] for c in ("vlan_id", "interface", "name", "status", "role", "reason")},
    ("stp_detail", "stp_detail"): {c: [c] for c in ("vlan", "interface", "role", "state", "cost", "topology_changes")},
    ("stp_detail", "inconsistent_ports"): {c: [c] for c in ("interface", "vlan", "type")},
    ("stp_detail", "stp_root_summary"): {c: [c] for c in ("vlan", "priority", "root_address", "cost", "port")},
    ("switchport", "switchports"): {c: [c] for c in ("interface", "mode", "native_vlan", "allowed_vlans", "voice_vlan")},
    ("switchport", "port_security"): {"interface": ["interface"]},
    ("switchport", "storm_control"): {"interface": ["interface"]},
    ("hsrp", "entries"): {c: [c] for c in ("interface", "group", "priority", "state", "virtual_ip")},
    ("routing_detail", "route_summary"): {c: [c] for c in ("source", "count")},
    ("routing_detail", "ospf_processes"): {c: [c] for c in ("process_id", "router_id", "areas[]")},
    ("routing_detail", "ospf_interfaces"): {"interface": ["interface"], "area": ["area"], "cost": ["cost"], "state": ["state"], "neighbors": ["neighbors", "nbrs_full"]},
    ("routing_detail", "bgp_summary"): {c: [c] for c in ("neighbor", "asn", "state", "prefixes_received", "up_down")},
    ("routing_detail", "bgp_table"): {c: [c] for c in ("status", "network", "next_hop", "metric", "local_pref", "path")},
    ("routing_detail", "eigrp_topology"): {c: [c] for c in ("code", "network", "successors", "feasible_distance")},
    ("routing_detail", "eigrp_neighbors"): {c: [c] for c in ("neighbor", "interface", "uptime", "stub", "stub_flags")},
    ("vrf", "vrfs"): {c: [c] for c in ("name", "rd", "description", "interfaces[]")},
    ("vrf", "vrf_interfaces"): {c: [c] for c in ("vrf", "interface", "ip_address")},
    ("edge_services", "ip_interfaces"): {c: [c] for c in ("interface", "ip_address", "acl_in", "acl_out", "proxy_arp", "urpf", "directed_broadcast")},
    ("edge_services", "nat_translations"): {c: [c] for c in ("protocol", "inside_global", "inside_local", "outside_local", "outside_global")},
}
ACL = "array<struct<name:string,type:string,entries:array<struct<action:string,protocol:string,source:string,destination:string,hit_count:bigint>>>>"
NAT = "struct<active_translations:bigint,peak_translations:bigint,hits:bigint,misses:bigint,outside_interfaces:array<string>,inside_interfaces:array<string>,pools:array<struct<name:string,total_addresses:bigint,allocated:bigint,utilization_pct:bigint>>>"
DEVICE = "struct<hostname:string,mgmt_ip:string,device_type:string,device_category:string,platform:string,collector_data:map<string,string>>"
DOCUMENT = f"struct<discovery_id:string,seed_ip:string,timestamp:string,params:map<string,string>,devices:map<string,{DEVICE}>,scan_summary:struct<elapsed:double,failed_count:bigint,failed:map<string,string>>,eox_cache:map<string,struct<fetched_at:string,record:map<string,string>>>>"

Tables = dict[str, DataFrame]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text, doc) of every *.json of a folder; texts that are no JSON have a null doc."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    return documents(files)


def documents(texts: DataFrame) -> DataFrame:
    """(filename, text) with the parsed document."""
    return texts.withColumn("doc", F.when(F.try_parse_json("text").isNotNull(), F.from_json("text", DOCUMENT)))


def heads(docs: DataFrame) -> DataFrame:
    """(filename, doc, device_count) of every document, doc without its devices, and null where the document does not parse."""
    head = F.struct(*[F.col(f"doc.{c}").alias(c) for c in ("discovery_id", "seed_ip", "timestamp", "scan_summary")])
    count = F.coalesce(F.size(F.map_keys("doc.devices")), F.lit(0)).cast("bigint").alias("device_count")
    each = docs.select("filename", F.when(F.col("doc").isNotNull(), head).alias("doc"), count, *[c for c in docs.columns if c == PLACE])
    if PLACE not in docs.columns:
        return each
    first = F.when(F.every(F.col("doc").isNotNull()), F.min_by("doc", PLACE)).alias("doc")
    return each.groupBy("filename").agg(first, F.sum("device_count").alias("device_count"))


def listing(docs: DataFrame) -> DataFrame:
    """Scans by file name, the latest first; files that do not parse are left out."""
    return present_fields(docs).where("ok").select("filename", "discovery_id", "seed_ip", "timestamp", "device_count").orderBy(F.desc("filename"))


def summaries(docs: DataFrame) -> DataFrame:
    """One row a scan: devices, seed, time, and how long it took where that is known."""
    return heads(docs).where("doc is not null").select(
        F.col("doc.discovery_id").alias("scan_id"), "device_count", F.coalesce("doc.seed_ip", F.lit("")).alias("seed_ip"), F.coalesce("doc.timestamp", F.lit("")).alias("timestamp"), "doc.scan_summary.elapsed", "doc.scan_summary.failed_count"
    )


def present_fields(docs: DataFrame) -> DataFrame:
    """(filename, ok and what listings and summaries show) of every document, parsed or not."""
    d = lambda c: F.coalesce(F.col(f"doc.{c}"), F.lit("")).alias(c)
    return heads(docs).select("filename", F.col("doc").isNotNull().alias("ok"), d("discovery_id"), d("seed_ip"), d("timestamp"), "device_count", "doc.scan_summary.elapsed", "doc.scan_summary.failed_count")


def parsed(docs: DataFrame) -> DataFrame:
    """Documents that parse; of those in parts, the ones of which all parts do. Only the names of the others are broadcast."""
    good = docs.where("doc is not null")
    if PLACE not in docs.columns:
        return good
    return good.join(F.broadcast(docs.where("doc is null").select("filename").distinct()), "filename", "left_anti")


def discovery_id(at: Column, seed: Column) -> Column:
    return F.concat_ws("_", F.date_format(at, "yyyy-MM-dd_HH-mm-ss"), seed)


def _field(record: Column, names: list[str]) -> Column:
    """The first alternate that is there; of alternates joined by | the first that is not empty."""
    get = lambda n: record[n]
    if "|" in names[0]:
        return F.coalesce(*[F.nullif(get(n), F.lit("")) for n in names[0].split("|")])
    return F.coalesce(*[get(n) for n in names])


def _list(text: Column) -> Column:
    """A list of texts; a scalar is a list of one, null stays null."""
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))


def _scalar(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("[")), F.array_join(F.from_json(text, "array<string>"), ", ")).otherwise(text)


def stored(docs: DataFrame) -> DataFrame:
    """The outputs of collectors, written once in the shared folder by collector, so that each of some forty tables reads its own collector only, not all documents."""
    return shared_table(outputs(docs), "collector")


def entries(docs: DataFrame) -> DataFrame:
    each = parsed(docs).select(F.col("doc.discovery_id").alias("scan_id"), *[c for c in docs.columns if c == PLACE], F.posexplode(F.map_entries("doc.devices")).alias("device_ord", "e"))
    return each.withColumn("device_ord", F.col("device_ord") + F.col(PLACE)).drop(PLACE) if PLACE in docs.columns else each


def outputs(docs: DataFrame) -> DataFrame:
    """(keys, collector, p): raw and parsed output of each collector of each device."""
    each = entries(docs).select("scan_id", F.col("e.key").alias("hostname"), "device_ord", F.explode("e.value.collector_data").alias("collector", "payload"))
    return each.select(*KEYS, "collector", F.from_json("payload", "struct<raw:map<string,string>,parsed:map<string,string>>").alias("p"))


def tables(docs: DataFrame, each: DataFrame | None = None) -> Tables:
    """All tables of parsed documents: scans, devices, raw (a map of command to text), raw_outputs, parsed (whether a collector has parsed keys), one for each record list, eox_cache. `each` are the outputs of collectors, best as `stored` has them."""
    good = parsed(docs).withColumn("scan_id", F.col("doc.discovery_id"))
    if PLACE in docs.columns:  # what isn't a device, as the first part has it
        head = F.struct(*[F.col(f"doc.{c}").alias(c) for c in ("seed_ip", "timestamp", "scan_summary", "params", "eox_cache")])
        good = good.groupBy("filename", "scan_id").agg(F.min_by(head, PLACE).alias("doc"))
    out: Tables = {"scans": good.select("scan_id", "doc.seed_ip", "doc.timestamp", "doc.scan_summary", "doc.params")}
    devices = entries(docs).select("scan_id", F.col("e.key").alias("hostname"), "device_ord", *[F.col(f"e.value.{c}").alias(c) for c in ("mgmt_ip", "device_type", "device_category", "platform")], F.col("e.value.collector_data").alias("collectors"))
    out["devices"] = devices.withColumn("platform", _scalar(F.col("platform"))).withColumn("collectors", F.coalesce(F.map_keys("collectors"), F.array().cast("array<string>")))
    each = outputs(docs) if each is None else each
    out["parsed"] = each.select(*KEYS, "collector", F.coalesce(F.size(F.map_keys("p.parsed")) > 0, F.lit(False)).alias("has"))
    out["raw"] = each.select(*KEYS, "collector", F.col("p.raw").alias("raw"))
    out["raw_outputs"] = each.select(*KEYS, "collector", F.explode("p.raw").alias("command", "text"))
    for (collector, name), columns in RECORDS.items():
        held = each.where(F.col("collector") == collector).select(*KEYS, F.posexplode(F.from_json(F.col("p.parsed")[name], "array<map<string,string>>")).alias("item_ord", "r"))
        # Names of fields in any case.
        held = held.withColumn("r", F.transform_keys("r", lambda k, _: F.lower(k))) if collector == "device_inventory" else held
        pick = []
        for column, names in columns.items():
            bare = column.removesuffix("[]")
            value = _field(F.col("r"), [n.removesuffix("[]") for n in names])
            pick.append((_list(value) if column.endswith("[]") else _scalar(value)).alias(bare))
        out[f"{collector}.{name}"] = held.select(*KEYS, "item_ord", *pick)
    one = lambda collector: each.where(F.col("collector") == collector)
    out["config.config"] = one("config").select(*KEYS, F.coalesce(F.col("p.parsed")["config"], F.lit("")).alias("config"))
    out["edge_services.access_lists"] = one("edge_services").select(*KEYS, F.posexplode(F.from_json(F.col("p.parsed")["access_lists"], ACL)).alias("item_ord", "a")).select(*KEYS, "item_ord", "a.*")
    out["edge_services.nat_statistics"] = one("edge_services").select(*KEYS, F.from_json(F.nullif(F.col("p.parsed")["nat_statistics"], F.lit("{}")), NAT).alias("n")).where("n is not null").select(*KEYS, "n.*")
    for kind, fields in (("vrf_routes", "protocol:string,network:string,next_hop:string"), ("vrf_arp", "ip_address:string,age:string,mac_address:string,interface:string")):
        rows = one("vrf").select(*KEYS, F.explode(F.from_json(F.col("p.parsed")[kind], f"map<string,array<struct<{fields}>>>")).alias("vrf", "r"))
        out[f"vrf.{kind}"] = rows.select(*KEYS, "vrf", F.posexplode("r").alias("item_ord", "r")).select(*KEYS, "vrf", "item_ord", "r.*")
    out["ntp_logging"] = one("ntp_logging").select(*KEYS, F.col("p.parsed").alias("parsed"))
    out["eox_cache"] = good.select("scan_id", F.explode("doc.eox_cache").alias("key", "c")).select("scan_id", "key", "c.fetched_at", "c.record")
    return out


def interface_addresses(full: DataFrame) -> DataFrame:
    """Addresses of interfaces, (keys, item_ord, ip_ord, interface, ip, prefix, secondary), from either shape of record: lists of addresses and prefixes, or a primary one and secondary lists."""
    empty = F.array().cast("array<string>")
    entry = lambda ip, prefix, secondary: F.struct(ip.alias("ip"), F.coalesce(prefix, F.lit("")).alias("prefix"), secondary.alias("secondary"))
    after = lambda subnet: F.when(F.contains(subnet, F.lit("/")), F.substring_index(subnet, "/", -1)).otherwise("")
    lists = F.transform("ip_address", lambda ip, i: entry(ip, F.get("prefix_length", i), i > 0))
    more = F.transform(F.coalesce("secondary_ip_address", empty), lambda ip, i: entry(ip, after(F.get("secondary_ip_subnet", i)), F.lit(True)))
    single = F.concat(F.array(entry(F.col("primary_ip_address"), after(F.col("primary_ip_subnet")), F.lit(False))), more)
    every = F.when(F.col("ip_address").isNotNull(), lists).when(F.col("primary_ip_address").isNotNull(), single)
    keep = [c for c in ("scan_id", "hostname", "device_ord", "item_ord") if c in full.columns]
    rows = full.where("interface <> ''").select(*keep, "interface", F.posexplode(every).alias("ip_ord", "e")).select(*keep, "ip_ord", "interface", "e.*")
    return rows.where("ip <> ''")


def upserted(records: DataFrame) -> DataFrame:
    """Devices from records in order of arrival: what an earlier record left empty a later one fills."""
    from ..operators.rows import upsert

    return upsert(records, ["scan_id", "hostname"], ["ord"], ["mgmt_ip", "device_type", "device_category", "platform"])


def host_list(texts: DataFrame, types: list[str]) -> DataFrame:
    """(list_id, text) -> one row for each line that means a host or an error: line_no, ip, device_type, error. The first line of an address counts."""
    rows = texts.select("list_id", F.posexplode(F.split("text", r"\R")).alias("line_no", "line"))
    rows = rows.withColumn("line_no", F.col("line_no") + 1).withColumn("t", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))
    rows = rows.where((F.size("t") > 0) & ~F.startswith(F.get("t", F.lit(0)), F.lit("#"))).withColumn("ip", F.get("t", F.lit(0))).withColumn("device_type", F.get("t", F.lit(1)))
    where = F.concat(F.lit("Line "), F.col("line_no").cast("string"))
    octets = F.split("ip", r"\.")
    valid = (F.size(octets) == 4) & F.forall(octets, lambda o: F.regexp_like(o, F.lit("^[0-9]+$")) & (o.try_cast("int") <= 255))
    bad_ip = F.when(~F.coalesce(valid, F.lit(False)), F.concat(where, F.lit(": invalid IP address '"), "ip", F.lit("'")))
    bad_type = F.when(F.col("device_type").isNotNull() & ~F.col("device_type").isin(types), F.concat(where, F.lit(": unknown device type '"), "device_type", F.lit("'")))
    marked = rows.withColumn("error", F.coalesce(bad_ip, bad_type))
    picked = marked.groupBy("list_id", "ip").agg(F.min_by(F.struct("line_no", "device_type", "error"), "line_no").alias("r"))
    return picked.select("list_id", "r.line_no", "ip", "r.device_type", "r.error")


def lifecycle_records(raw: DataFrame) -> DataFrame:
    """Records of a lifecycle service, whose dates are structs of a value, as flat texts."""
    texts = {"pid": "EOLProductID", "description": "ProductIDDescription", "bulletin_number": "ProductBulletinNumber", "bulletin_url": "LinkToProductBulletinURL"}
    dates = {
        "eox_announcement": "EOXExternalAnnouncementDate", "end_of_sale": "EndOfSaleDate", "end_of_sw_maintenance": "EndOfSWMaintenanceReleases", "end_of_vulnerability_support": "EndOfSecurityVulSupportDate",
        "end_of_routine_failure_analysis": "EndOfRoutineFailureAnalysisDate", "end_of_service_contract_renewal": "EndOfServiceContractRenewal", "last_date_of_support": "LastDateOfSupport", "end_of_svc_attach": "EndOfSvcAttachDate",
    }
    move = {"migration_pid": "MigrationProductId", "migration_name": "MigrationProductName", "migration_strategy": "MigrationStrategy"}
    has = set(raw.columns)
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    pick = [clean(F.col(s)).alias(n) if s in has else F.lit("").alias(n) for n, s in texts.items()]
    pick += [clean(F.col(f"{s}.value")).alias(n) if s in has else F.lit("").alias(n) for n, s in dates.items()]
    pick += [clean(F.col(f"EOXMigrationDetails.{s}")).alias(n) if "EOXMigrationDetails" in has else F.lit("").alias(n) for n, s in move.items()]
    return raw.select(*pick)


def cached(wanted: DataFrame, cache: DataFrame, as_of: Column, ttl_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Of wanted keys (scan_id, key) the records that are fresh, and the keys that have to be fetched."""
    fresh = cache.where(F.datediff(as_of, F.try_to_date(F.substring("fetched_at", 1, 10), "yyyy-MM-dd")) < ttl_days)
    return wanted.join(fresh, ["scan_id", "key"]), wanted.join(fresh.select("scan_id", "key"), ["scan_id", "key"], "left_anti")


def available(devices: DataFrame, required: list[str]) -> DataFrame:
    """(scan_id, available): whether one device has all required collectors."""
    has = F.size(F.array_except(F.array(*[F.lit(x) for x in required]), "collectors")) == 0
    return devices.groupBy("scan_id").agg(F.coalesce(F.max(has), F.lit(False)).alias("available"))


def gated(df: DataFrame, parsed: DataFrame, collector: str) -> DataFrame:
    """df for the scans in which some device has parsed output of the collector."""
    return df.join(parsed.where((F.col("collector") == collector) & F.col("has")).select("scan_id").distinct(), "scan_id", "left_semi")


