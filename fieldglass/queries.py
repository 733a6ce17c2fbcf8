"""The registered queries: the operators on driver tables in the shape of scans, each with SQL of its own for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import lifecycle as life
from .functions import network as net
from .operators import detection, graph
from .operators.overlap import nested_networks
from .parsers import edge as p_edge
from .parsers import neighbors as p_neighbors
from .parsers import routing as p_routing
from .parsers import switching as p_switching
from .plans import edge, flat, l2, l3, lifecycle, topology
from .sources.platforms import PLATFORMS, platform_descriptions
from .sources.scans import host_list, interface_addresses
from .streaming.progress import live_state

Query = Callable[[SparkSession, str], DataFrame]
#: The day from which lifecycles are reckoned in registered queries.
AS_OF = "2026-01-10"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

with_ = A.with_


class Scans(dict):
    """Tables of scans made from driver tables when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def adapted(self, name: str) -> DataFrame:
        return A.adapted(self.spark, self.sf_dir, name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = out = TABLES[name](self)
        return out


def _acls(s: Scans) -> DataFrame:
    rule = F.struct("n", "action", "protocol", "source", "destination", F.col("hits").alias("hit_count"))
    grouped = s.adapted("rules").groupBy("scan_id", "hostname", F.col("o").alias("item_ord"), "name").agg(F.array_sort(F.collect_list(rule)).alias("e"))
    return grouped.select("scan_id", "hostname", "item_ord", "name", F.lit("Extended").alias("type"), F.transform("e", lambda x: x.dropFields("n")).alias("entries"))


def _nat(s: Scans) -> DataFrame:
    pool = lambda i: F.struct(F.concat(F.lit("P"), i.cast("string")).alias("name"), (F.lit(100) + i).cast("bigint").alias("total_addresses"), F.col("util").alias("allocated"), (F.col("util") + i).cast("bigint").alias("utilization_pct"))
    pools = F.when(F.col("pools") == 0, F.lit(None)).otherwise(F.transform(F.sequence(F.lit(1), F.col("pools").cast("int")), pool))
    return s.adapted("nat").select("scan_id", "hostname", F.col("active").alias("active_translations"), (F.col("active") + 5).alias("peak_translations"), F.array(F.lit("Vlan1"), F.lit("Vlan2")).alias("inside_interfaces"), F.array(F.lit("Gi0/0")).alias("outside_interfaces"), pools.alias("pools"))


def _cache(s: Scans) -> DataFrame:
    c = s.adapted("lookups")
    record = F.create_map(*[x for k, v in {"description": F.concat(F.lit("about "), "key"), "end_of_sale": F.col("eos"), "last_date_of_support": F.col("ldos"), "migration_pid": F.lit("NEW"), "bulletin_url": F.lit("u"), "_pid_not_found": F.col("unlisted").cast("string")}.items() for x in (F.lit(k), v)])
    return c.select("scan_id", "key", "fetched_at", record.alias("record"))


TABLES: dict[str, Callable[[Scans], DataFrame]] = {
    "devices": lambda s: s.adapted("devices"),
    "scans": lambda s: s.adapted("devices").select("scan_id").distinct().select("scan_id", F.concat(F.lit("10.9.1."), F.substring("scan_id", 2, 1)).alias("seed_ip")),
    "arp.entries": lambda s: s.adapted("arp"),
    "mac_table.entries": lambda s: s.adapted("mac"),
    "cdp_lldp.neighbors": lambda s: A.neighbors(s.adapted("pairs")),
    "stp_vlan.spanning_tree_root": lambda s: s.adapted("roots"),
    "stp_vlan.vlans": lambda s: s.adapted("vlan_names"),
    "stp_vlan.blocked_ports": lambda s: s.adapted("blocked").withColumn("role", F.lit("")),
    "switchport.switchports": lambda s: s.adapted("ports"),
    "switchport.storm_control": lambda s: s.adapted("port_flags").where("kind = 0"),
    "switchport.port_security": lambda s: s.adapted("port_flags").where("kind = 1"),
    "config.config": lambda s: s.adapted("configs"),
    "interfaces.ip_interfaces_full": lambda s: A.full_interfaces(s.adapted("ip_flat")),
    "interfaces.interfaces_description": lambda s: s.adapted("intf_notes").withColumn("port", F.lit(None).cast("string")),
    "hsrp.entries": lambda s: s.adapted("hsrp").withColumnRenamed("grp", "group"),
    "routing_detail.route_summary": lambda s: s.adapted("route_counts").withColumnRenamed("cnt", "count"),
    "routing_detail.bgp_summary": lambda s: s.adapted("bgp"),
    "routing_detail.ospf_interfaces": lambda s: s.adapted("ospf_if").withColumnRenamed("nbrs", "neighbors"),
    "routing_detail.ospf_processes": lambda s: s.adapted("ospf_proc").select("scan_id", "hostname", F.lit(0).alias("item_ord"), F.lit("1").alias("process_id"), F.concat(F.lit("10.255.0."), F.col("k").cast("string")).alias("router_id"), F.array(F.lit("0"), F.lit("7")).alias("areas")),
    "routing_detail.eigrp_neighbors": lambda s: s.adapted("l3_neighbors").select("scan_id", "hostname", "item_ord", F.col("remote_ip").alias("neighbor"), F.lit("Gi0/1").alias("interface"), (F.col("item_ord") % 9 == 0).cast("string").alias("stub"), F.lit("CONNECTED").alias("stub_flags")),
    "l3_routing.neighbors": lambda s: s.adapted("l3_neighbors").withColumn("protocols", F.array("protocol")),
    "l3_routing.routes": lambda s: s.adapted("routes"),
    "edge_services.access_lists": _acls,
    "edge_services.nat_statistics": _nat,
    "device_inventory.inventory": lambda s: s.adapted("items"),
    "device_inventory.modules": lambda s: s.adapted("modules").select("*", F.lit("ok").alias("status"), F.lit("48").alias("ports")),
    "device_inventory.stack_members": lambda s: s.adapted("stack"),
    "device_inventory.version": lambda s: s.adapted("versions").withColumn("item_ord", F.lit(0)),
    "platform_descriptions": lambda s: platform_descriptions(s.spark),
    "eox_cache": _cache,
}


def register(name: str, build: Callable[[Scans], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Scans(spark, sf_dir)).drop("place")
    if sql:
        ORACLES[name] = sql


# --- flat sheets -----------------------------------------------------------------------------------------------------

SITE = "split_part({h}, '-', 1)"
site = lambda h="hostname": SITE.format(h=h)

register("A1_arp_summary", flat.arp_summary, with_("arp") + "SELECT scan_id, hostname AS device, interface, count(*) AS entry_count FROM arp GROUP BY ALL")
register("F18_arp_detail", flat.arp_detail, with_("arp") + "SELECT scan_id, hostname AS device, interface, ip, mac, age FROM arp")
register("F18_mac_table", flat.mac_table, with_("mac") + "SELECT scan_id, hostname AS device, mac AS mac_address, vlan, type, ports AS port FROM mac")
register(
    "J1_arp_mac_map", l3.arp_mac_map,
    with_("arp", "mac") + f", m AS (SELECT scan_id, hostname, lower(mac) AS k, arg_max(vlan, item_ord) AS vlan FROM mac GROUP BY ALL) SELECT a.scan_id, a.hostname AS device, {site('a.hostname')} AS site, ip AS ip_address, mac AS mac_address, interface, coalesce(m.vlan, '') AS vlan, upper(substr(replace(mac, '.', ''), 1, 6)) AS vendor_oui FROM arp a LEFT JOIN m ON m.scan_id = a.scan_id AND m.hostname = a.hostname AND m.k = lower(a.mac)",
)
LINKS = (
    with_("pairs") + A.NEIGHBORS + ", n AS (SELECT *, hostname || ':' || local_intf AS x, remote_device || ':' || coalesce(remote_intf, '?') AS y FROM neighbors)"
    ", r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, least(x, y), greatest(x, y) ORDER BY hostname, item_ord) AS rn FROM n)"
    " SELECT scan_id, hostname AS local_device, local_intf AS local_interface, remote_device, coalesce(remote_intf, '?') AS remote_interface, remote_ip, replace(protocols, ',', ', ') AS protocols FROM r WHERE rn = 1"
)
register("W1_links", flat.links, LINKS)
register(
    "G4_topology_edges", topology.edges,
    with_("pairs") + A.NEIGHBORS + ", r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, least(hostname, remote_device), greatest(hostname, remote_device) ORDER BY device_ord, item_ord) AS rn FROM neighbors)"
    " SELECT scan_id, hostname AS source, remote_device AS target, replace(local_intf, 'GigabitEthernet', 'G') AS local_interface, replace(coalesce(remote_intf, '?'), 'GigabitEthernet', 'G') AS remote_interface, CASE WHEN protocols = 'CDP,OSPF' THEN 'both' ELSE 'l2' END AS link_type, replace(protocols, ',', '+') AS protocols FROM r WHERE rn = 1",
)
register(
    "U4_topology_nodes", topology.nodes,
    with_("devices", "pairs") + A.NEIGHBORS + ", names AS (SELECT scan_id, hostname AS id FROM devices UNION SELECT scan_id, remote_device FROM neighbors), seed AS (SELECT scan_id, arg_min(hostname, device_ord) AS s FROM devices WHERE mgmt_ip = '10.9.1.' || substr(scan_id, 2, 1) GROUP BY scan_id)"
    ", k AS (SELECT n.scan_id, n.id, coalesce(nullif(d.device_category, ''), 'unknown') AS type, coalesce(n.id = s.s, false) AS is_seed FROM names n LEFT JOIN devices d ON d.scan_id = n.scan_id AND d.hostname = n.id LEFT JOIN seed s ON s.scan_id = n.scan_id)"
    " SELECT scan_id, id, id AS label, type, CASE type WHEN 'switch' THEN '#00D9FF' WHEN 'router' THEN '#FF4444' ELSE '#999999' END AS color, id AS full_name, is_seed, false AS has_routing, CAST(0 AS BIGINT) AS arp_count FROM k",
)

DESCRIBED = ", d AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PLATFORMS.items()) + ") v(pid, description)) "
register(
    "J16_inventory_devices", flat.inventory_devices,
    with_("devices", "versions", "items") + DESCRIBED + ", i AS (SELECT scan_id, hostname, sn FROM items WHERE item_ord = 0)"
    ", k AS (SELECT d.*, coalesce(nullif(d.platform, ''), nullif(v.hardware, ''), '') AS p, coalesce(v.version, '') AS sw, coalesce(nullif(v.serial, ''), nullif(i.sn, ''), '') AS sn FROM devices d LEFT JOIN versions v USING (scan_id, hostname) LEFT JOIN i USING (scan_id, hostname))"
    " SELECT k.scan_id, k.hostname, coalesce(mgmt_ip, '') AS mgmt_ip, coalesce(device_type, '') AS device_type, coalesce(device_category, '') AS category, p AS platform, CASE WHEN p = '' THEN '' ELSE coalesce(a.description, b.description, c.description, '') END AS platform_description, sw AS software_version, k.sn AS serial_number"
    " FROM k LEFT JOIN d a ON a.pid = p LEFT JOIN d b ON b.pid = CASE WHEN contains(p, '-') THEN regexp_replace(regexp_replace(p, '-+$', ''), '-[^-]*$', '') ELSE p END LEFT JOIN d c ON c.pid = split_part(p, '/', 1)",
)
register(
    "F8_stack_members", flat.stack_members,
    with_("devices", "stack") + "SELECT s.scan_id, s.hostname, mgmt_ip, switch AS member, role, coalesce(nullif(model, ''), hw_ver) AS model, coalesce(serial, '') AS serial, mac, priority, state FROM stack s JOIN devices USING (scan_id, hostname)",
)
register(
    "U7_modules", flat.modules,
    with_("devices", "modules", "items") + r", skip AS (SELECT *, lower(descr) || ' ' || lower(name) AS t FROM items), a AS (SELECT scan_id, hostname, slot, type, model, serial, 'ok' AS status, '48' AS ports FROM modules WHERE NOT regexp_matches(model, '^WS-C[0-9]') AND NOT regexp_matches(lower(model), 'pvdm|gbic|stack') AND NOT regexp_matches(lower(type), 'pvdm|gbic|stack')"
    " UNION ALL SELECT scan_id, hostname, name, descr, pid, sn, '', '' FROM skip i WHERE NOT EXISTS (SELECT 1 FROM modules m WHERE m.scan_id = i.scan_id AND m.hostname = i.hostname) AND NOT regexp_matches(t, 'fan|power supply|psu|sfp|transceiver|sensor|clk|usb') AND NOT contains(lower(name), 'chassis'))"
    " SELECT a.scan_id, a.hostname, mgmt_ip, slot, type, model, serial, status, ports FROM a JOIN devices USING (scan_id, hostname)",
)

# --- layer 2 ---------------------------------------------------------------------------------------------------------

VID = r"regexp_replace(vlan_id, '^[Vv][Ll][Aa][Nn]0*([0-9]+)$', '\1')"
DEFAULT = r"(lower(trim({n})) = 'default' OR regexp_matches(lower(trim({n})), '^vlan0*[0-9]+$'))"
PARTS = r"list_distinct(string_split_regex(lower(trim({n})), '[_\-\s]+'))"


def similar(a: str, b: str) -> str:
    x, y = f"lower(trim({a}))", f"lower(trim({b}))"
    shared = f"len(list_intersect({PARTS.format(n=a)}, {PARTS.format(n=b)})) * 2 >= greatest(len({PARTS.format(n=a)}), len({PARTS.format(n=b)}))"
    return f"({x} = {y} OR ({DEFAULT.format(n=a)} AND {DEFAULT.format(n=b)}) OR (abs(length({x}) - length({y})) <= 3 AND (levenshtein({x}, {y}) <= 2 OR {shared})))"


GROUPS = f"len(string_split(list_reduce(list_prepend('', names), lambda h, n: CASE WHEN len(list_filter(string_split(h, '~'), lambda g: g <> '' AND {similar('n', 'g')})) > 0 THEN h ELSE h || '~' || n END), '~')) - 1"
VLANS = (
    f", r0 AS (SELECT scan_id, {VID} AS vid, hostname, device_ord, arg_max(root_address, item_ord) AS mac, arg_max(root_priority, item_ord) AS pri, arg_max(root_cost, item_ord) AS cost, min(item_ord) AS item_ord FROM roots WHERE root_address <> '' GROUP BY ALL)"
    f", n0 AS (SELECT scan_id, {VID} AS vid, hostname, device_ord, arg_max(name, item_ord) AS name FROM vlan_names GROUP BY ALL)"
    ", seen AS (SELECT scan_id, vid, min((device_ord, item_ord)) AS at_ FROM r0 GROUP BY ALL)"
    ", own AS (SELECT r0.scan_id, mac, hostname, row_number() OVER (PARTITION BY r0.scan_id, mac ORDER BY at_, device_ord) AS rn, at_, device_ord FROM r0 JOIN seen USING (scan_id, vid) WHERE cost = '0')"
    ", owner AS (SELECT * FROM own WHERE rn = 1)"
    ", by_root AS (SELECT scan_id, vid, mac, count(*) AS n, min(device_ord) AS first, arg_min(pri, device_ord) AS pri, string_agg(hostname, ', ' ORDER BY hostname) AS ons FROM r0 GROUP BY ALL)"
    ", top AS (SELECT *, row_number() OVER (PARTITION BY scan_id, vid ORDER BY n DESC, first) AS rn, count(*) OVER (PARTITION BY scan_id, vid) AS roots, string_agg(mac || ' on ' || ons, '; ' ORDER BY first) OVER (PARTITION BY scan_id, vid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bridges FROM by_root)"
    f", named AS (SELECT scan_id, vid, arg_min(name, ({DEFAULT.format(n='name')}, device_ord)) AS best, list_sort(list_distinct(list(name))) AS names FROM n0 GROUP BY ALL)"
    ", varied AS (SELECT scan_id, vid, string_agg('\"' || name || '\" on ' || ons, '; ' ORDER BY name) AS varied FROM (SELECT scan_id, vid, name, string_agg(hostname, ', ' ORDER BY hostname) AS ons FROM n0 GROUP BY ALL) GROUP BY ALL)"
    ", sw AS (SELECT scan_id, vid, list_sort(list_distinct(list(hostname))) AS sw FROM (SELECT scan_id, vid, hostname FROM r0 UNION SELECT scan_id, vid, hostname FROM n0) GROUP BY ALL)"
    f", v AS (SELECT sw.scan_id, sw.vid, sw, coalesce(top.mac, '') AS mac, coalesce(top.pri, '') AS pri, coalesce(roots, 0) AS roots, bridges, coalesce(best, '') AS best, varied, coalesce(owner.hostname, '') AS owner, CASE WHEN names IS NULL THEN 0 ELSE {GROUPS} END AS groups FROM sw LEFT JOIN top ON top.scan_id = sw.scan_id AND top.vid = sw.vid AND rn = 1 LEFT JOIN named ON named.scan_id = sw.scan_id AND named.vid = sw.vid LEFT JOIN varied ON varied.scan_id = sw.scan_id AND varied.vid = sw.vid LEFT JOIN owner ON owner.scan_id = sw.scan_id AND owner.mac = top.mac)"
    ", bp AS (SELECT scan_id, hostname, interface, string_agg(vlan_id, ', ' ORDER BY CAST(vlan_id AS BIGINT)) AS vs FROM (SELECT DISTINCT scan_id, hostname, interface, vlan_id FROM blocked) GROUP BY ALL)"
    ", svi AS (SELECT *, regexp_extract(interface, '^[Vv]lan([0-9]+)$', 1) AS vid FROM addresses WHERE regexp_matches(interface, '^[Vv]lan[0-9]+$'))"
)
L2 = with_("roots", "vlan_names", "blocked", "ip_flat", "hsrp", "devices") + A.ADDRESSES + VLANS
L2_FINDINGS = (
    ", f AS (SELECT scan_id, hostname, interface || ' -- ' || st AS title, interface || ' is ' || st || '. Affects VLANs: ' || vs || '.' AS description FROM (SELECT b.scan_id, b.hostname, b.interface, string_agg(DISTINCT status, '/' ORDER BY status) || CASE WHEN max(reason) <> '' THEN ' (' || string_agg(DISTINCT nullif(reason, ''), ', ' ORDER BY nullif(reason, '')) || ')' ELSE '' END AS st, any_value(vs) AS vs FROM blocked b JOIN bp USING (scan_id, hostname, interface) GROUP BY ALL)"
    " UNION ALL SELECT scan_id, CASE WHEN owner <> '' THEN owner WHEN mac <> '' THEN mac ELSE 'unknown' END, 'VLAN ' || vid || ' -- default STP priority', 'Root priority ' || pri || ' (32768+' || vid || ', untuned). Root election is arbitrary.' FROM v WHERE TRY_CAST(pri AS BIGINT) IN (32768, 32768 + CAST(vid AS BIGINT))"
    " UNION ALL SELECT scan_id, '', 'VLAN ' || vid || ' -- STP root bridge mismatch', 'Multiple root bridges detected: ' || bridges || '.' FROM v WHERE roots > 1"
    " UNION ALL SELECT l.scan_id, '', 'VLAN ' || l.vid || CASE WHEN coalesce(v.best, '') <> '' THEN ' (' || v.best || ')' ELSE '' END || ' -- /' || l.prefix || ' subnet', 'Large subnet (/' || l.prefix || '): ' || l.every || '. Verify intent.' FROM (SELECT s.scan_id, s.vid, s.prefix, string_agg(s.hostname || ': ' || s.ip || '/' || s.prefix, ', ' ORDER BY s.device_ord, s.item_ord, s.ip_ord) AS every FROM svi s JOIN (SELECT scan_id, vid, arg_min(prefix, (device_ord, item_ord, ip_ord)) AS prefix FROM svi WHERE CAST(prefix AS BIGINT) < 20 GROUP BY ALL) p USING (scan_id, vid, prefix) GROUP BY ALL) l LEFT JOIN v ON v.scan_id = l.scan_id AND v.vid = l.vid"
    " UNION ALL SELECT scan_id, '', 'VLAN ' || vid || ' -- name discrepancy', 'Different names: ' || varied || '.' FROM v WHERE groups > 1)"
    ", fs AS (SELECT *, CASE WHEN contains(lower(title), 'mismatch') THEN 'Critical' WHEN regexp_matches(lower(title), 'blk|bkn|default stp|subnet|bpdu|storm|trunk|topology') THEN 'Warning' ELSE 'Info' END AS severity FROM f) "
)
register(
    "A3_vlan_documentation", l2.vlan_documentation,
    L2 + ", s1 AS (SELECT scan_id, vid, string_agg(hostname || ': ' || ip || '/' || prefix || CASE WHEN secondary THEN ' (secondary)' ELSE '' END, '; ' ORDER BY hostname, item_ord, ip_ord) AS x FROM svi GROUP BY ALL)"
    ", h1 AS (SELECT scan_id, substr(interface, 5) AS vid, string_agg(hostname || ': ' || virtual_ip || ' (' || CASE WHEN state <> '' THEN state || ', ' ELSE '' END || 'pri ' || priority || ')', '; ' ORDER BY hostname, item_ord) AS x FROM hsrp GROUP BY ALL)"
    ", b1 AS (SELECT scan_id, vid, string_agg(hostname || '-' || interface || ' BLK on VLANs ' || vs, '; ' ORDER BY hostname, interface) AS x FROM (SELECT DISTINCT b.scan_id, b.hostname, b.interface, b.vlan_id AS vid, vs FROM blocked b JOIN bp USING (scan_id, hostname, interface)) GROUP BY ALL)"
    " SELECT v.scan_id, v.vid AS vlan_id, array_to_string(list_sort(list_distinct(list_transform(sw, lambda x: split_part(x, '-', 1)))), ', ') AS site, best AS vlan_name, array_to_string(sw, ', ') AS seen_on, CASE WHEN owner <> '' THEN owner ELSE mac END AS stp_root_bridge, pri AS root_priority, coalesce(s1.x, '') AS svi_ip_cidr, coalesce(h1.x, '') AS hsrp_vip, coalesce(b1.x, '') AS blocked_ports, CASE WHEN roots > 1 THEN 'STP root mismatch -- see Findings' ELSE '' END AS notes"
    " FROM v LEFT JOIN s1 USING (scan_id, vid) LEFT JOIN h1 USING (scan_id, vid) LEFT JOIN b1 USING (scan_id, vid)",
)
register("R1_R5_l2_findings", l2.findings_sheet, L2 + L2_FINDINGS + f"SELECT scan_id, hostname, CASE WHEN contains(hostname, '-') THEN {site()} ELSE '' END AS site, title AS port, description AS notes FROM fs")


def metric_sql(row: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT scan_id, '{label}' AS metric, CAST({c} AS BIGINT) AS value FROM {row}" for label, c in pairs)


def counted(f: str) -> str:
    return f"(SELECT count(*) FROM {f} x WHERE x.scan_id = d.scan_id AND severity = '{{}}')"


SEV = ", ".join(f"{counted('fs').format(s)} AS {s.lower()}" for s in ("Critical", "Warning", "Info"))
SEV_ROWS = [(f"{s} Findings", s.lower()) for s in ("Critical", "Warning", "Info")]
register("A11_l2_summary", l2.summary, L2 + L2_FINDINGS + f", m AS (SELECT d.scan_id, count(*) AS devices, (SELECT count(*) FROM v WHERE v.scan_id = d.scan_id) AS vlans, {SEV} FROM devices d GROUP BY d.scan_id) " + metric_sql("m", [("Device Count", "devices"), ("VLAN Count", "vlans"), *SEV_ROWS]))
register("A4_A5_root_bridges", l2.root_bridges, L2 + f"SELECT scan_id, hostname, {site()} AS site, arg_min(mac, (at_, device_ord, mac)) AS root_bridge_id FROM owner GROUP BY scan_id, hostname")
register(
    "J5_J6_port_security", l2.port_security,
    with_("devices", "configs", "ports", "port_flags") + f"SELECT p.scan_id, p.hostname AS device, {site('p.hostname')} AS site, p.interface, mode, CASE WHEN contains(config, 'bpduguard default') OR contains(config, 'bpduguard enable') THEN 'Yes' ELSE 'No' END AS bpdu_guard, CASE WHEN contains(config, 'guard root') THEN 'Yes' ELSE 'No' END AS root_guard,"
    " CASE WHEN EXISTS (SELECT 1 FROM port_flags f WHERE kind = 0 AND f.scan_id = p.scan_id AND f.hostname = p.hostname AND f.interface = lower(p.interface)) THEN 'Yes' ELSE 'No' END AS storm_control, CASE WHEN EXISTS (SELECT 1 FROM port_flags f WHERE kind = 1 AND f.scan_id = p.scan_id AND f.hostname = p.hostname AND f.interface = lower(p.interface)) THEN 'Yes' ELSE 'No' END AS port_security, voice_vlan FROM ports p LEFT JOIN configs c ON c.scan_id = p.scan_id AND c.hostname = p.hostname",
)
register("C33_unhardened_ports", lambda t: l2.unhardened(l2.port_security(t)).where("lacks_bpdu_guard or lacks_root_guard or lacks_storm_control").select("scan_id", "device", "interface", "lacks_bpdu_guard", "lacks_root_guard", "lacks_storm_control").groupBy("scan_id", "lacks_bpdu_guard", "lacks_root_guard", "lacks_storm_control").agg(F.count("*").alias("n")),
    with_("devices", "configs", "ports", "port_flags") + ", k AS (SELECT p.scan_id, contains(lower(mode), 'access') AS a, contains(lower(mode), 'trunk') AS t, contains(config, 'bpduguard default') OR contains(config, 'bpduguard enable') AS b, contains(config, 'guard root') AS g, EXISTS (SELECT 1 FROM port_flags f WHERE kind = 0 AND f.scan_id = p.scan_id AND f.hostname = p.hostname AND f.interface = lower(p.interface)) AS s FROM ports p JOIN configs c ON c.scan_id = p.scan_id AND c.hostname = p.hostname)"
    ", l AS (SELECT scan_id, a AND NOT b AS lacks_bpdu_guard, t AND NOT g AS lacks_root_guard, (a OR t) AND NOT s AS lacks_storm_control FROM k) SELECT *, count(*) AS n FROM l WHERE lacks_bpdu_guard OR lacks_root_guard OR lacks_storm_control GROUP BY ALL")  # fmt: skip
register(
    "F10_J3_trunks", lambda t: l2.trunks(t),
    with_("ports", "pairs") + A.NEIGHBORS + f", n AS (SELECT scan_id, hostname, lower(local_intf) AS i, arg_min(remote_device, item_ord) AS r FROM neighbors GROUP BY ALL) SELECT p.scan_id, p.hostname AS device, {site('p.hostname')} AS site, interface, native_vlan, allowed_vlans, coalesce(r, '') AS neighbor, allowed_vlans = 'ALL' AS unpruned, native_vlan = '1' AS native_vlan_1 FROM ports p LEFT JOIN n ON n.scan_id = p.scan_id AND n.hostname = p.hostname AND n.i = lower(p.interface) WHERE mode = 'Trunk'",
)

# --- layer 3 ---------------------------------------------------------------------------------------------------------

INT = "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"
SIZE = "CAST(pow(2, 32 - CAST(prefix AS BIGINT)) AS BIGINT)"
NETS = A.ADDRESSES + f", n AS (SELECT *, {INT} - {INT} % {SIZE} AS lo, {INT} - {INT} % {SIZE} + {SIZE} - 1 AS hi, ip || '/' || prefix AS cidr FROM addresses), pairs_ AS (SELECT a.scan_id, a.hostname AS ha, a.item_ord AS oa, a.ip_ord AS pa, a.interface AS ia, a.cidr AS ca, b.hostname AS hb, b.item_ord AS ob, b.ip_ord AS pb, b.interface AS ib, b.cidr AS cb FROM n a JOIN n b ON a.scan_id = b.scan_id AND a.lo <= b.hi AND b.lo <= a.hi AND a.hostname < b.hostname AND (a.lo <> b.lo OR a.hi <> b.hi))"
DOTTED = "CAST({x} // 16777216 AS BIGINT) || '.' || CAST({x} // 65536 % 256 AS BIGINT) || '.' || CAST({x} // 256 % 256 AS BIGINT) || '.' || CAST({x} % 256 AS BIGINT)"
register(
    "J10_address_audit", l3.address_audit,
    with_("ip_flat") + NETS + ", o AS (SELECT scan_id, h, oo, p, string_agg(x, '; ' ORDER BY yh, yo, yp) AS overlap FROM (SELECT scan_id, ha AS h, oa AS oo, pa AS p, 'Overlaps ' || hb || ' ' || ib AS x, hb AS yh, ob AS yo, pb AS yp FROM pairs_ UNION ALL SELECT scan_id, hb, ob, pb, 'Overlaps ' || ha || ' ' || ia, ha, oa, pa FROM pairs_) GROUP BY ALL)"
    f" SELECT n.scan_id, hostname AS device, {site()} AS site, interface, cidr AS ip_cidr, {DOTTED.format(x='lo')} || '/' || prefix AS subnet, regexp_extract(interface, '^[Vv]lan([0-9]+)$', 1) AS vlan, coalesce(overlap, '') AS overlap FROM n LEFT JOIN o ON o.scan_id = n.scan_id AND o.h = n.hostname AND o.oo = n.item_ord AND o.p = n.ip_ord",
)
register("J10_nested_networks", lambda t: nested_networks(l3.addresses(t).select("scan_id", "lo", "prefix"), ["scan_id"]), with_("ip_flat") + NETS + ", u AS (SELECT DISTINCT scan_id, lo, CAST(prefix AS INTEGER) AS prefix, hi FROM n) SELECT a.scan_id, a.lo, a.prefix, b.lo AS outer_lo, b.prefix AS outer_prefix FROM u a JOIN u b ON a.scan_id = b.scan_id AND b.lo <= a.lo AND a.hi <= b.hi AND b.prefix < a.prefix")
register("E1_interface_addresses", lambda t: interface_addresses(t["interfaces.ip_interfaces_full"]), with_("ip_flat") + A.ADDRESSES + "SELECT scan_id, hostname, device_ord, item_ord, ip_ord, interface, ip, prefix, secondary FROM addresses")
register(
    "J2_J4_routed_interfaces", l3.routed_interfaces,
    with_("ip_flat", "intf_notes", "pairs") + A.ADDRESSES + A.NEIGHBORS + ", d AS (SELECT scan_id, hostname, lower(interface) AS i, arg_min(description, item_ord) AS x FROM intf_notes GROUP BY ALL), m AS (SELECT scan_id, hostname, lower(local_intf) AS i, arg_min(remote_device, item_ord) AS x FROM neighbors GROUP BY ALL)"
    f" SELECT a.scan_id, a.hostname AS device, {site('a.hostname')} AS site, interface, ip || '/' || prefix AS ip_cidr, coalesce(nullif(d.x, ''), m.x, '') AS description, CASE WHEN contains(interface, 'Loopback') THEN 'Loopback' WHEN contains(interface, 'mgmt') THEN 'OOB management' WHEN contains(interface, 'Port-channel') THEN 'Routed port-channel' ELSE 'Routed interface' END || CASE WHEN secondary THEN ' (secondary)' ELSE '' END AS notes"
    " FROM addresses a LEFT JOIN d ON d.scan_id = a.scan_id AND d.hostname = a.hostname AND d.i = lower(a.interface) LEFT JOIN m ON m.scan_id = a.scan_id AND m.hostname = a.hostname AND m.i = lower(a.interface) WHERE NOT regexp_matches(interface, '^[Vv]lan[0-9]+$')",
)
KIND = "CASE WHEN contains(lower(source), 'connected') THEN 'connected' WHEN contains(lower(source), 'static') THEN 'static' WHEN contains(lower(source), 'ospf') THEN 'ospf' WHEN contains(lower(source), 'eigrp') THEN 'eigrp' WHEN contains(lower(source), 'bgp') THEN 'bgp' ELSE 'other' END"
register(
    "A2_route_summary", l3.route_summary,
    with_("route_counts") + f", k AS (SELECT scan_id, hostname, {KIND} AS kind, coalesce(TRY_CAST(cnt AS BIGINT), 0) AS n FROM route_counts) SELECT scan_id, hostname AS device, {site()} AS site, " + ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN n ELSE 0 END) AS BIGINT) AS {k}" for k in ("connected", "static", "ospf", "eigrp", "bgp", "other")) + ", CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY scan_id, hostname",
)
register(
    "J18_E5_ospf_topology", l3.ospf_topology,
    with_("ospf_if", "ospf_proc") + f", p AS (SELECT scan_id, hostname, '10.255.0.' || k AS rid FROM ospf_proc) SELECT i.scan_id, i.hostname AS device, {site('i.hostname')} AS site, CASE WHEN rid IS NULL THEN '' ELSE '1' END AS process_id, coalesce(rid, '') AS router_id, area, interface, cost, state, nbrs AS neighbors FROM ospf_if i LEFT JOIN p ON p.scan_id = i.scan_id AND p.hostname = i.hostname"
    f" UNION ALL SELECT p.scan_id, p.hostname, {site('p.hostname')}, '1', rid, a.area, '', '', '', '' FROM p, (VALUES ('0'), ('7')) a(area) WHERE NOT EXISTS (SELECT 1 FROM ospf_if i WHERE i.scan_id = p.scan_id AND i.hostname = p.hostname)",
)
register("F18_protocol_neighbors", l3.protocol_neighbors, with_("l3_neighbors") + f"SELECT scan_id, hostname AS device, {site()} AS site, protocol, remote_ip AS neighbor_ip, remote_device AS neighbor_device, state FROM l3_neighbors")
register("F18_routes", l3.routes, with_("routes") + f"SELECT scan_id, hostname AS device, {site()} AS site, network, mask, next_hop, interface, protocol, metric FROM routes")
register("F18_fhrp_status", l3.fhrp_status, with_("hsrp") + f'SELECT scan_id, hostname AS device, {site()} AS site, interface, grp AS "group", priority, state, virtual_ip FROM hsrp')

L3 = with_("devices", "ip_flat", "l3_neighbors", "route_counts", "routes", "bgp", "hsrp", "ospf_if") + NETS
BGP_DOWN = "SELECT scan_id, hostname, 'Critical' AS severity, 'BGP peer not Established' AS title, 'Neighbor ' || neighbor || ' AS ' || asn || ' state: ' || state AS description FROM bgp WHERE state <> 'Established'"
FHRP_ODD = "SELECT scan_id, hostname, 'Warning', 'FHRP group in unexpected state', 'Interface ' || interface || ' group ' || grp || ' VIP ' || virtual_ip || ' state: ' || state FROM hsrp WHERE state = 'Init'"
L3_FINDINGS = (
    f", fs AS ({BGP_DOWN} UNION ALL {FHRP_ODD}"
    " UNION ALL SELECT scan_id, hostname, 'Critical', 'OSPF neighbor not FULL', 'Neighbor ' || remote_ip || ' state: ' || state FROM l3_neighbors WHERE protocol = 'ospf' AND state <> '' AND NOT contains(lower(state), 'full') AND NOT contains(lower(state), 'dr')"
    " UNION ALL SELECT scan_id, hostname, 'Info', 'EIGRP stub peer', 'Neighbor ' || remote_ip || ' on Gi0/1 is stub (CONNECTED)' FROM l3_neighbors WHERE item_ord % 9 = 0"
    " UNION ALL SELECT scan_id, hostname, 'Warning', 'Static routes alongside dynamic protocol', n || ' static route(s) present despite dynamic routing protocol(s) -- potential oversight' FROM (SELECT scan_id, hostname, bool_or((source IN ('ospf', 'eigrp', 'bgp', 'isis') OR contains(source, 'ospf') OR contains(source, 'eigrp') OR lower(source) = 'bgp') AND coalesce(TRY_CAST(cnt AS BIGINT), 0) > 0) AS d, arg_max(TRY_CAST(cnt AS BIGINT), item_ord) FILTER (source = 'static' AND TRY_CAST(cnt AS BIGINT) > 0) AS n FROM route_counts GROUP BY ALL) WHERE d AND n IS NOT NULL"
    " UNION ALL SELECT scan_id, hostname, 'Warning', 'Large number of /32 host routes', count(*) || ' host routes detected -- possible redistribution leak' FROM routes WHERE mask IN ('32', '255.255.255.255', '/32') GROUP BY scan_id, hostname HAVING count(*) > 20"
    " UNION ALL SELECT scan_id, ha, 'Critical', 'Overlapping IP subnet', ha || ' ' || arg_min(ia, (oa, pa, ob, pb)) || ' (' || ca || ') overlaps with ' || hb || ' ' || arg_min(ib, (oa, pa, ob, pb)) || ' (' || cb || ')' FROM pairs_ GROUP BY scan_id, ha, ca, hb, cb"
    " UNION ALL SELECT scan_id, arg_min(hostname, (hostname, item_ord)), 'Warning', 'Asymmetric OSPF costs in area ' || area, 'Cost range ' || min(c) || '-' || max(c) || ' across ' || count(*) || ' interfaces in area ' || area FROM (SELECT *, TRY_CAST(cost AS BIGINT) AS c FROM ospf_if) WHERE c IS NOT NULL GROUP BY scan_id, area HAVING count(*) >= 2 AND min(c) > 0 AND max(c) > 100 * min(c)) "
)
FOUND = f"SELECT scan_id, hostname AS device, {site()} AS site, severity, title AS finding, description AS details FROM fs"
register("R6_R13_l3_findings", lambda t: l3.findings_sheet(l3.findings(t)), L3 + L3_FINDINGS + FOUND)
ROUTED = "(SELECT count(*) FROM (SELECT scan_id, hostname FROM l3_neighbors UNION SELECT scan_id, hostname FROM routes UNION SELECT scan_id, hostname FROM route_counts) x WHERE x.scan_id = d.scan_id)"
register("A11_l3_summary", l3.summary, L3 + L3_FINDINGS + f", m AS (SELECT d.scan_id, count(*) AS devices, {ROUTED} AS routed, (SELECT count(*) FROM routes r WHERE r.scan_id = d.scan_id) AS routes_, {SEV} FROM devices d GROUP BY d.scan_id) " + metric_sql("m", [("Total Devices", "devices"), ("Routed Devices", "routed"), ("Total Routes", "routes_"), *SEV_ROWS]))

# --- edge ------------------------------------------------------------------------------------------------------------

register("F18_bgp_peers", edge.bgp_peers, with_("bgp") + f"SELECT scan_id, hostname AS device, {site()} AS site, neighbor, asn, state, prefixes_received AS prefixes_rcvd, up_down AS uptime FROM bgp")
register(
    "E4_nat_overview", edge.nat_overview,
    with_("nat") + ", p AS (SELECT *, 0 AS i FROM nat WHERE pools = 0 UNION ALL SELECT *, 1 FROM nat WHERE pools >= 1 UNION ALL SELECT *, 2 FROM nat WHERE pools >= 2)"
    f" SELECT scan_id, hostname AS device, {site()} AS site, 'Vlan1, Vlan2' AS inside_intfs, 'Gi0/0' AS outside_intfs, CAST(active AS VARCHAR) AS active_translations, CAST(active + 5 AS VARCHAR) AS peak, CASE WHEN i = 0 THEN '' ELSE 'P' || i END AS pool_name, CASE WHEN i = 0 THEN '' ELSE CAST(100 + i AS VARCHAR) END AS total_addrs, CASE WHEN i = 0 THEN '' ELSE CAST(util AS VARCHAR) END AS allocated, CASE WHEN i = 0 THEN '' ELSE CAST(util + i AS VARCHAR) END AS util_pct FROM p",
)
PERMIT = "action = 'permit' AND protocol = 'ip' AND source = 'any' AND destination = 'any'"
register("A9_acl_audit", edge.acl_audit, with_("rules") + f"SELECT scan_id, hostname AS device, {site()} AS site, name AS acl_name, 'Extended' AS type, count(*) AS rule_count, count(*) FILTER (hits = 0) AS zero_hit_rules, CASE WHEN bool_or({PERMIT}) THEN 'Yes' ELSE 'No' END AS has_permit_any FROM rules GROUP BY scan_id, hostname, o, name")
EDGE = with_("devices", "bgp", "nat", "rules", "hsrp") + (
    f", fs AS ({BGP_DOWN} UNION ALL {FHRP_ODD} UNION ALL SELECT scan_id, hostname, 'Warning', 'Single-homed BGP', 'Only 1 BGP peer (' || min(neighbor) || ' AS ' || min(asn) || ') -- no redundancy' FROM bgp GROUP BY scan_id, hostname HAVING count(*) = 1"
    " UNION ALL SELECT scan_id, hostname, 'Warning', 'NAT pool high utilization', 'Pool ''P' || i || ''' at ' || (util + i) || '% (' || util || '/' || (100 + i) || ')' FROM nat, (VALUES (1), (2)) x(i) WHERE i <= pools AND util + i > 80"
    " UNION ALL SELECT scan_id, hostname, 'Info', 'Dead ACL (all zero hits)', 'ACL ''' || name || ''' has ' || count(*) || ' rules, all with zero hits' FROM rules GROUP BY scan_id, hostname, o, name HAVING max(hits) = 0"
    f" UNION ALL SELECT scan_id, hostname, 'Warning', 'ACL permit ip any any', 'ACL ''' || name || ''' contains permit ip any any' FROM rules WHERE {PERMIT}) "
)
register("R14_R17_edge_findings", lambda t: l3.findings_sheet(edge.findings(t)), EDGE + FOUND)
register(
    "A11_edge_summary", edge.summary,
    EDGE + f", m AS (SELECT d.scan_id, count(*) AS devices, (SELECT count(*) FROM (SELECT scan_id, hostname FROM bgp UNION SELECT scan_id, hostname FROM nat UNION SELECT scan_id, hostname FROM rules) x WHERE x.scan_id = d.scan_id) AS edge_, (SELECT count(*) FROM bgp b WHERE b.scan_id = d.scan_id) AS peers, (SELECT coalesce(sum(active), 0) FROM nat n WHERE n.scan_id = d.scan_id) AS active, {SEV} FROM devices d GROUP BY d.scan_id) "
    + metric_sql("m", [("Total Devices", "devices"), ("Edge Devices", "edge_"), ("BGP Peers", "peers"), ("Active NAT Translations", "active"), *SEV_ROWS]),
)

# --- lifecycle -------------------------------------------------------------------------------------------------------


def clean(x: str) -> str:
    """The part numbers of the adapters, cleaned."""
    return f"CASE WHEN {x} = '10.1.1.1' THEN '' WHEN contains({x}, '(PID:') THEN regexp_extract({x}, 'PID:([^)]+)', 1) ELSE regexp_replace(coalesce({x}, ''), '^cisco ', '') END"


DAY = f"DATE '{AS_OF}'"
HW = f", hw AS (SELECT scan_id, substr(key, 4) AS pid, 'about ' || key AS description, ldos, eos, unlisted, TRUE AS known FROM lookups WHERE date_diff('day', CAST(fetched_at AS DATE), {DAY}) < 7)"
LEFT = f"date_diff('day', {DAY}, TRY_CAST(nullif(ldos, '') AS DATE))"
STATE = f"CASE WHEN {{none}} THEN 'No Platform ID' WHEN known IS NULL THEN 'No Data' WHEN unlisted THEN 'Not in EOX' WHEN {LEFT} < 0 THEN 'End-of-Support' WHEN {LEFT} <= 365 THEN 'Approaching EoS' WHEN TRY_CAST(nullif(eos, '') AS DATE) <= {DAY} THEN 'End-of-Sale' ELSE 'Current' END"


def life_row(none: str = "FALSE") -> str:
    s = STATE.format(none=none)
    return f"coalesce(eos, '') AS end_of_sale, '' AS end_of_sw_maintenance, '' AS end_of_vulnerability_support, '' AS end_of_service_contract_renewal, coalesce(ldos, '') AS last_date_of_support, CASE WHEN {s} IN ('No Platform ID', 'No Data', 'Not in EOX') THEN NULL ELSE {LEFT} END AS days_remaining, {s} AS status, CASE WHEN known THEN 'NEW' ELSE '' END AS replacement_pid, '' AS replacement_name, CASE WHEN known THEN 'u' ELSE '' END AS bulletin_url"


CISCO = f", dev AS (SELECT scan_id, hostname, mgmt_ip, device_type, coalesce(platform, '') AS platform, {clean('platform')} AS pp FROM devices WHERE starts_with(device_type, 'cisco')), it AS (SELECT *, {clean('pid')} AS c FROM items)"
CHASSIS = (
    f", ver AS (SELECT scan_id, hostname, {clean('split_part(hardware, chr(44), 1)')} AS vp, coalesce(serial, '') AS vs FROM versions)"
    ", own AS (SELECT scan_id, hostname, arg_min(c, item_ord) AS cp, arg_min(sn, item_ord) AS cs, arg_min(descr, item_ord) AS cd FROM it WHERE contains(lower(name), 'chassis') OR name = '1' GROUP BY ALL)"
    ", sw1 AS (SELECT scan_id, hostname, arg_min(c, item_ord) AS mp, arg_min(sn, item_ord) AS ms, arg_min(descr, item_ord) AS md FROM it WHERE name = 'Switch 1' AND c <> '' GROUP BY ALL)"
    ", c0 AS (SELECT d.*, coalesce(nullif(cp, ''), nullif(vp, ''), nullif(pp, ''), '') AS p, coalesce(nullif(cs, ''), nullif(vs, ''), '') AS s, coalesce(cd, '') AS ds, mp, ms, md FROM dev d LEFT JOIN ver USING (scan_id, hostname) LEFT JOIN own USING (scan_id, hostname) LEFT JOIN sw1 USING (scan_id, hostname))"
    ", c1 AS (SELECT scan_id, hostname, mgmt_ip, pp, CASE WHEN p = '' THEN coalesce(mp, '') ELSE p END AS pid, CASE WHEN p = '' THEN coalesce(nullif(s, ''), nullif(ms, ''), '') ELSE s END AS serial, CASE WHEN p = '' THEN coalesce(nullif(ds, ''), nullif(md, ''), '') ELSE ds END AS descr FROM c0)"
    ", ch AS (SELECT c1.scan_id, hostname, mgmt_ip, serial, descr, CASE WHEN c1.pid <> '' AND (a.pid IS NULL OR a.unlisted) AND pp <> c1.pid AND b.pid IS NOT NULL AND NOT b.unlisted THEN pp ELSE c1.pid END AS pid FROM c1 LEFT JOIN hw a ON a.scan_id = c1.scan_id AND a.pid = c1.pid LEFT JOIN hw b ON b.scan_id = c1.scan_id AND b.pid = c1.pp)"
    r", mem AS (SELECT scan_id, hostname, regexp_extract(name, '^[Ss]witch\s+([0-9]+)', 1) AS switch, arg_min(c, item_ord) AS ip_, arg_min(sn, item_ord) AS is_, arg_min(descr, item_ord) AS id_ FROM it WHERE regexp_matches(name, '^[Ss]witch\s+[0-9]+') AND c <> '' GROUP BY ALL)"
    f", st AS (SELECT s.scan_id, s.hostname, ch.mgmt_ip, s.switch, coalesce(nullif(ip_, ''), nullif({clean('model')}, ''), ch.pid, '') AS pid, coalesce(nullif(is_, ''), s.serial, '') AS serial, coalesce(id_, '') AS descr FROM stack s JOIN ch ON ch.scan_id = s.scan_id AND ch.hostname = s.hostname LEFT JOIN mem ON mem.scan_id = s.scan_id AND mem.hostname = s.hostname AND mem.switch = s.switch)"
)
HARDWARE = (
    with_("devices", "items", "versions", "stack", "lookups", "modules") + HW + CISCO + CHASSIS
    + f", hrows AS (SELECT ch.scan_id, hostname AS device_name, mgmt_ip AS management_ip, 'Chassis' AS component, ch.pid, CASE WHEN known THEN hw.description ELSE descr END AS description, serial AS serial_number, {life_row(chr(99) + 'h.pid = ' + chr(39) * 2)} FROM ch LEFT JOIN hw ON hw.scan_id = ch.scan_id AND hw.pid = ch.pid"
    f" UNION ALL SELECT st.scan_id, hostname, mgmt_ip, 'Stack Member ' || switch, st.pid, CASE WHEN known THEN hw.description ELSE descr END, serial, {life_row()} FROM st LEFT JOIN hw ON hw.scan_id = st.scan_id AND hw.pid = st.pid) "
)
IS_CHASSIS = r"regexp_matches(pid, '(?i)^(WS-C[0-9]|C9[2-6][0-9]{2}[LX]?-[0-9]|CISCO[0-9]|ISR[0-9].*/K9|VG[23][0-9]{2}|ASR[0-9]|N[579]K-C[0-9]|NCS-[0-9])')"
MODULES = (
    ", mrows AS (SELECT m.scan_id, m.hostname AS device_name, d.mgmt_ip AS management_ip, m.component, m.pid, CASE WHEN known THEN hw.description ELSE m.descr END AS description, m.serial AS serial_number, " + life_row() + " FROM"
    f" (SELECT scan_id, hostname, 'Module Slot ' || slot AS component, model AS pid, '' AS descr, serial FROM (SELECT *, model AS pid FROM modules) WHERE NOT {IS_CHASSIS} AND NOT regexp_matches(model, '(?i)(^|[_-])(fan|power|psu|sfp|transceiver|xcvr|cwdm|dwdm|gbic)($|[_-])')"
    f" UNION ALL SELECT scan_id, hostname, name, pid, descr, sn FROM items WHERE pid <> '' AND NOT contains(lower(name), 'chassis') AND NOT regexp_matches(name, '(?i)^(module )?slot [0-9]') AND NOT {IS_CHASSIS} AND NOT regexp_matches(name, '(?i)(^|[_-])(fan|power|psu|sfp|transceiver|xcvr|cwdm|dwdm|gbic)($|[_-])') AND NOT regexp_matches(descr, '(?i)(^|[_-])(fan|power|psu|sfp|transceiver|xcvr|cwdm|dwdm|gbic)($|[_-])') AND NOT regexp_matches(pid, '(?i)(^|[_-])(fan|power|psu|sfp|transceiver|xcvr|cwdm|dwdm|gbic)($|[_-])')) m"
    " JOIN dev d ON d.scan_id = m.scan_id AND d.hostname = m.hostname LEFT JOIN hw ON hw.scan_id = m.scan_id AND hw.pid = m.pid) "
)
day = lambda: F.lit(AS_OF).cast("date")
register("J13_J14_hardware_lifecycle", lambda t: lifecycle.hardware(t, day()), HARDWARE + "SELECT * FROM hrows")
register("F9_module_lifecycle", lambda t: lifecycle.modules(t, day()), HARDWARE + MODULES + "SELECT * FROM mrows")
register("A12_lifecycle_breakdown", lambda t: lifecycle.status_sheet(t, day()),
    HARDWARE + MODULES + ", srows AS (SELECT scan_id, 'No Data' AS status FROM dev), st_ AS (SELECT * FROM (SELECT DISTINCT scan_id FROM devices) s, (VALUES " + ", ".join(f"('{s}')" for s in life.STATES) + ") v(status))"
    " SELECT scan_id, status, (SELECT count(*) FROM hrows h WHERE h.scan_id = st_.scan_id AND h.status = st_.status) AS hw_chassis, (SELECT count(*) FROM mrows h WHERE h.scan_id = st_.scan_id AND h.status = st_.status) AS hw_modules, (SELECT count(*) FROM srows h WHERE h.scan_id = st_.scan_id AND h.status = st_.status) AS software FROM st_")  # fmt: skip
OS = "CASE device_type WHEN 'cisco_ios' THEN 'IOS' WHEN 'cisco_xe' THEN 'IOS-XE' WHEN 'cisco_nxos' THEN 'NX-OS' END"
NORM = r"CASE WHEN device_type = 'cisco_nxos' THEN regexp_replace(version, '^([0-9]+\.[0-9]+\([0-9]+\)\w+)\([0-9]+\)$', '\1') ELSE regexp_replace(regexp_replace(version, '\(([0-9]+)[A-Za-z]\)', '(\1)', 'g'), '([A-Z]+[0-9]+)[a-z]$', '\1') END"
register(
    "U3_A20_wanted_lookups", lifecycle.wanted,
    with_("devices", "items", "versions", "stack", "modules") + CISCO + f", every AS (SELECT scan_id, c AS pid FROM it JOIN dev USING (scan_id, hostname) UNION SELECT s.scan_id, {clean('model')} FROM stack s JOIN dev USING (scan_id, hostname) UNION SELECT m.scan_id, {clean('model')} FROM modules m JOIN dev USING (scan_id, hostname) UNION SELECT scan_id, pp FROM dev)"
    f" SELECT scan_id, 'hw:' || pid AS key FROM every WHERE pid <> '' UNION SELECT scan_id, 'sw:' || ({NORM}) || '|' || {OS} FROM dev JOIN versions v USING (scan_id, hostname) WHERE coalesce(version, '') <> ''",
)

# --- parsers, on texts made from tables; the SQL selects what went in ---------------------------------------------------


def texts(df: DataFrame, line, header: str = "", order: str = "item_ord") -> DataFrame:
    """One text for each device: a header and a line for each row, in order."""
    every = F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x"))))["x"], "\n")
    return df.groupBy("scan_id", "hostname").agg(F.concat(F.lit(header), every).alias("text"))


def _arp_text(t: Scans) -> DataFrame:
    line = F.when(F.col("item_ord") % 3 == 0, F.concat_ws("  ", F.lit("Internet"), "ip", "age", "mac", F.lit("ARPA"), "interface")).when(F.col("item_ord") % 3 == 1, F.concat_ws("  ", F.lit("*"), "ip", "age", "mac", "interface")).otherwise(F.concat_ws("  ", "ip", "age", "mac", "interface"))
    return p_neighbors.arp(texts(t.adapted("arp"), line, "Protocol  Address  Age\n")).drop("item_ord")


COLONS = "substr({m}, 1, 2) || ':' || substr({m}, 3, 2) || ':' || substr({m}, 5, 2) || ':' || substr({m}, 7, 2) || ':' || substr({m}, 9, 2) || ':' || substr({m}, 11, 2)".format(m="replace(mac, '.', '')")
register("P8_C2_arp_text", _arp_text, with_("arp") + f"SELECT scan_id, hostname, ip, {COLONS} AS mac, age, interface FROM arp")


def _acl_text(t: Scans) -> DataFrame:
    line = F.concat(F.lit("    "), (F.col("n") * 10).cast("string"), F.lit(" "), F.concat_ws(" ", "action", "protocol", "source", "destination"), F.when(F.col("hits") > 0, F.concat(F.lit(" ("), F.col("hits").cast("string"), F.lit(" matches)"))).otherwise(""))
    # The rules of an order lie on several devices; here each order is a device.
    rules = texts(t.adapted("rules").withColumn("hostname", F.col("name")).withColumn("item_ord", F.col("n")), line)
    out = p_edge.access_lists(rules.withColumn("text", F.concat(F.lit("Extended IP access list "), "hostname", F.lit("\n"), "text")))
    # The outer form, as the plain one also filters by the size of the entries, for which they would be parsed twice.
    return out.select("scan_id", "name", F.explode_outer("entries").alias("e")).where("e is not null").select("scan_id", "name", "e.*")


register("P10_access_list_text", _acl_text, with_("rules") + "SELECT scan_id, name, action, protocol, source, destination, hits AS hit_count FROM rules")
register(
    "P25_bgp_summary_text",
    lambda t: p_routing.bgp_summary(texts(t.adapted("bgp"), F.concat_ws("   ", "neighbor", F.lit("4"), "asn", F.lit("1 2 3 0 0"), "up_down", F.when(F.col("state") == "Established", F.col("prefixes_received")).otherwise(F.col("state"))), "Neighbor V AS MsgRcvd\n")).drop("item_ord"),
    with_("bgp") + "SELECT scan_id, hostname, neighbor, asn, up_down, state, CASE WHEN state = 'Established' THEN CAST(prefixes_received AS BIGINT) ELSE 0 END AS prefixes_received FROM bgp",
)
register(
    "P22_route_summary_text",
    lambda t: p_routing.route_summary(texts(t.adapted("route_counts"), F.concat("source", F.lit("       "), "cnt", F.lit("    1   2")), "Route Source    Networks    Subnets\n")).drop("item_ord"),
    with_("route_counts") + "SELECT scan_id, hostname, source, CAST(cnt AS BIGINT) AS count FROM route_counts WHERE TRY_CAST(cnt AS BIGINT) IS NOT NULL",
)
register(
    "P34_J7_blocked_text",
    lambda t: p_switching.blocked_ports(
        texts(t.adapted("blocked"), F.concat(F.lit("VLAN00"), "vlan_id", F.lit("      "), "interface"), "Name   Blocked Interfaces List\n------ -----\n"),
        texts(t.adapted("blocked"), F.concat(F.lit("VLAN00"), "vlan_id", F.lit("\n"), "interface", F.lit(" Desg "), "status", F.lit(" 4 128.1 P2p"), F.when(F.col("reason") != "", F.concat(F.lit(" *"), "reason")).otherwise(""))),
    ).select("scan_id", "hostname", "vlan_id", "interface", "role", F.regexp_replace("reason", "^$", "-").alias("reason")),
    with_("blocked") + ", l AS (SELECT *, last_value(reason) OVER (PARTITION BY scan_id, hostname, vlan_id, interface ORDER BY item_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r FROM blocked) SELECT scan_id, hostname, vlan_id, interface, 'Desg' AS role, CASE WHEN r = '' THEN '-' ELSE r END AS reason FROM l",
)
register(
    "P36_switchport_text",
    lambda t: p_switching.switchports(texts(t.adapted("ports"), F.concat(F.lit("Name: "), "interface", F.lit("\nAdministrative Mode: "), "mode", F.lit("\nAccess Mode VLAN: 77 (x)\nTrunking Native Mode VLAN: "), "native_vlan", F.lit(" (y)\nTrunking VLANs Enabled: "), "allowed_vlans", F.lit("\nVoice VLAN: "), F.when(F.col("voice_vlan") == "", "none").otherwise(F.col("voice_vlan"))))).select("scan_id", "hostname", "interface", "mode", "native_vlan", "allowed_vlans", "voice_vlan"),
    with_("ports") + "SELECT scan_id, hostname, interface, mode, native_vlan, allowed_vlans, voice_vlan FROM ports",
)
register(
    "P14_hsrp_text",
    lambda t: p_switching.hsrp_brief(texts(t.adapted("hsrp"), F.concat_ws("  ", F.regexp_replace("interface", "Vlan", "Vl"), "grp", "priority", F.lit("P"), F.nullif("state", F.lit("")), F.lit("local 10.1.1.1"), "virtual_ip"), "Interface   Grp  Pri P State    Active          Standby         Virtual IP\n")).drop("item_ord"),
    with_("hsrp") + "SELECT scan_id, hostname, interface, grp AS \"group\", priority, virtual_ip, CASE WHEN state = 'standby' THEN 'Standby' ELSE state END AS state FROM hsrp",
)
register(
    "P3_ospf_text",
    lambda t: p_neighbors.ospf(texts(t.adapted("l3_neighbors"), F.concat_ws("  ", F.lit("1.1.1.1"), F.lit("1"), F.when(F.col("state") == "", "DOWN").otherwise(F.col("state")), F.lit("00:00:31"), "remote_ip", F.lit("Gi0/1")), "Neighbor ID     Pri   State\n")).select("scan_id", "hostname", "remote_ip", "local_intf", "protocol", "state"),
    with_("l3_neighbors") + "SELECT scan_id, hostname, remote_ip, 'Gi0/1' AS local_intf, 'OSPF' AS protocol, state FROM l3_neighbors WHERE contains(state, 'FULL')",
)


def _cdp_text(t: Scans) -> DataFrame:
    n = t["cdp_lldp.neighbors"]
    line = F.concat(F.lit("Device ID: "), "remote_device", F.lit(".example.net\n  IP address: "), "remote_ip", F.lit("\nPlatform: cisco X,  Capabilities: Switch IGMP\nInterface: "), "local_intf", F.when(F.col("remote_intf").isNotNull(), F.concat(F.lit(",  Port ID (outgoing port): "), "remote_intf")).otherwise(""))
    return p_neighbors.cdp(texts(n, line)).select("scan_id", "hostname", "remote_device", "remote_ip", "remote_platform", "remote_capabilities", "local_intf", F.coalesce("remote_intf", F.lit("?")).alias("remote_intf"))


register("P1_cdp_text", _cdp_text, with_("pairs") + A.NEIGHBORS + "SELECT scan_id, hostname, remote_device, remote_ip, 'cisco X' AS remote_platform, 'Switch IGMP' AS remote_capabilities, local_intf, coalesce(remote_intf, '?') AS remote_intf FROM neighbors")

# --- graph, detection, streams, scalars, lists ------------------------------------------------------------------------


def _reached(t: Scans) -> DataFrame:
    """Devices by distance from the seed, three steps at most."""
    n = t["cdp_lldp.neighbors"].select("scan_id", "hostname", F.col("remote_device").alias("target"))
    return graph.layers(topology.seed_host(t).select("scan_id", F.col("seed").alias("hostname")), n, ["scan_id", "hostname"], 3)


register(
    "G1_layers", _reached,
    with_("devices", "pairs").replace("WITH ", "WITH RECURSIVE ", 1) + A.NEIGHBORS + ", e AS (SELECT DISTINCT scan_id, hostname, remote_device FROM neighbors), walk AS (SELECT scan_id, arg_min(hostname, device_ord) AS hostname, 0 AS depth FROM devices WHERE mgmt_ip = '10.9.1.' || substr(scan_id, 2, 1) GROUP BY scan_id UNION SELECT w.scan_id, e.remote_device, w.depth + 1 FROM walk w JOIN e ON e.scan_id = w.scan_id AND e.hostname = w.hostname WHERE w.depth < 3) SELECT scan_id, hostname, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY scan_id, hostname",
)

PATTERNS = {"device_types": {"cisco_nxos": {"platforms": ["n7k", "n9k"], "system_descriptions": ["NX-OS"], "priority": 100}, "cisco_xe": {"platforms": ["c9300", "isr4"], "system_descriptions": [], "priority": 90}, "cisco_ios": {"platforms": ["ws-c", "isr"], "system_descriptions": [], "priority": 50}, "cisco_s300": {"platforms": ["sg350"], "priority": 45}}}


def _detected(t: Scans) -> DataFrame:
    d = t["devices"].select("scan_id", "hostname", F.col("platform").alias("remote_platform"), F.when(F.col("device_ord") % 2 == 0, "Router, Switch").when(F.col("device_ord") % 3 == 0, "T").alias("remote_capabilities"), F.lit(None).cast("string").alias("system_description"), F.col("mgmt_ip").alias("remote_ip"))
    seen = detection.frontier(d, detection.pattern_table(t.spark, PATTERNS), {"include_switches": True, "include_other": True})
    return seen.select("scan_id", "hostname", "device_type", "category", "has_routing", "crawl")


register(
    "J17_F6_G2_detection", _detected,
    with_("devices") + ", k AS (SELECT *, lower(platform) AS p, CASE WHEN device_ord % 2 = 0 THEN 'switch' WHEN device_ord % 3 = 0 THEN 'access_point' WHEN platform = '' THEN 'unknown' ELSE 'other' END AS category FROM devices)"
    " SELECT scan_id, hostname, CASE WHEN contains(p, 'n7k') OR contains(p, 'n9k') THEN 'cisco_nxos' WHEN contains(p, 'c9300') OR contains(p, 'isr4') THEN 'cisco_xe' WHEN contains(p, 'ws-c') OR contains(p, 'isr') THEN 'cisco_ios' WHEN contains(p, 'sg350') THEN 'cisco_s300' ELSE 'cisco_ios' END AS device_type, category, category = 'switch' AS has_routing, TRUE AS crawl FROM k WHERE category IN ('switch', 'other')",
)
register(
    "T3_T5_live_state", lambda t: live_state(t.adapted("progress")),
    with_("progress") + "SELECT scan_id, coalesce(arg_max(CASE event WHEN 'scan_complete' THEN 'complete' WHEN 'scan_error' THEN 'error' END, seq) FILTER (event IN ('scan_complete', 'scan_error')), 'running') AS status, count(*) FILTER (event = 'device_complete' AND NOT skipped) AS done, count(*) FILTER (event = 'device_failed') AS failed, count(*) FILTER (event = 'device_complete' AND skipped) AS skipped, max(depth) AS depth, count(*) AS events, arg_max(event, seq) AS last_event FROM progress GROUP BY scan_id",
)


def _hosts(t: Scans) -> DataFrame:
    """A list of hosts for each nation, with comments, repeated addresses and errors."""
    c = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, F.lit("# note")).when(k % 11 == 0, F.concat(F.lit("10.0.300."), k.cast("string"))).when(k % 13 == 0, F.concat(F.lit("10.1.1."), (k % 250).cast("string"), F.lit(" toaster"))).otherwise(F.concat(F.lit("  10.1.1."), (k % 250).cast("string"), F.when(k % 2 == 0, " cisco_ios").otherwise("")))
    lists = c.groupBy(F.col("c_nationkey").alias("list_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("x")))), lambda s: s["x"]), "\n").alias("text"))
    return host_list(lists, ["cisco_ios", "cisco_xe"])


register(
    "S6_host_lists", _hosts,
    "WITH l AS (SELECT c_nationkey AS list_id, c_custkey AS k, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS line_no FROM customer)"
    ", h AS (SELECT *, CASE WHEN k % 11 = 0 THEN '10.0.300.' || k ELSE '10.1.1.' || (k % 250) END AS ip, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 'toaster' WHEN k % 2 = 0 THEN 'cisco_ios' END AS device_type FROM l WHERE k % 7 <> 0)"
    ", e AS (SELECT *, row_number() OVER (PARTITION BY list_id, ip ORDER BY line_no) AS rn FROM h) SELECT list_id, line_no, ip, device_type, CASE WHEN k % 11 = 0 THEN 'Line ' || line_no || ': invalid IP address ''' || ip || '''' WHEN device_type = 'toaster' THEN 'Line ' || line_no || ': unknown device type ''toaster''' END AS error FROM e WHERE rn = 1",
)


def _scalars(t: Scans) -> DataFrame:
    """Names and addresses of parts through the scalar functions."""
    p = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    k = F.col("p_partkey")
    ip = F.concat_ws(".", F.lit("10"), (k % 300).cast("string"), (k % 256).cast("string"), F.lit("9"))
    prefix = (k % 40).cast("string")
    n = net.network(ip, prefix)
    return p.select(
        k.alias("k"), net.is_ipv4(ip).alias("valid"), net.ipv4(ip).alias("number"), net.network_text(n).alias("network"), net.site(F.col("p_name")).alias("site"), net.vlan_id(F.concat(F.lit("VLAN000"), k.cast("string"))).alias("vlan"), net.similar_names(F.col("p_name"), F.col("p_brand")).alias("similar"),
        net.short_interface(F.concat(F.lit("FastEthernet0/"), k.cast("string"))).alias("short"), net.category(net.capabilities(F.when(k % 2 == 0, "Router,Phone").otherwise("B R")), F.col("p_name"), F.lit("")).alias("category"), life.software_version(F.lit("15.2(2a)E10b"), F.lit("IOS")).alias("version"),
    )


register(
    "C1_C19_scalars", _scalars,
    "WITH p AS (SELECT p_partkey AS k, p_name, p_brand, 10 * 16777216 + (p_partkey % 300) * 65536 + (p_partkey % 256) * 256 + 9 AS n, p_partkey % 300 <= 255 AS valid, p_partkey % 40 AS px FROM part), q AS (SELECT *, n - n % CAST(pow(2, 32 - least(px, 32)) AS BIGINT) AS lo FROM p)"
    f" SELECT k, valid, CASE WHEN valid THEN n END AS number, CASE WHEN valid AND px <= 32 THEN {DOTTED.format(x='lo')} || '/' || px ELSE '' END AS network, CASE WHEN contains(p_name, '-') THEN split_part(p_name, '-', 1) ELSE '' END AS site, CAST(k AS VARCHAR) AS vlan, {similar('p_name', 'p_brand')} AS similar, 'F0/' || k AS short, CASE WHEN k % 2 = 0 THEN 'phone' ELSE 'switch' END AS category, '15.2(2)E10' AS version FROM q",
)
