"""Driver tables in the shape of scan tables.

Each adapter is a projection in SQL that Spark and DuckDB read alike; the operators then run on it as on real scans.
Device k is called N(k mod 25)-SW-k. There are three scans; orders belong to scan orderkey mod 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def host(k: str) -> str:
    return f"'N' || ({k} % 25) || '-SW-' || {k}"


def mac(k: str) -> str:
    h = f"lower(lpad(hex(CAST({k} AS BIGINT)), 12, '0'))"
    return f"substr({h}, 1, 4) || '.' || substr({h}, 5, 4) || '.' || substr({h}, 9, 4)"


def div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}.0) AS BIGINT)"


SCAN, LINE = "'s' || (l_orderkey % 3)", "(l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey"
ADDRESS = "((o_orderkey * 2654435761) % 16777216)"
IP = f"'10.' || {div(ADDRESS, 65536)} || '.' || ({div(ADDRESS, 256)} % 256) || '.' || ({ADDRESS} % 256)"
PIDS = "CASE {k} % 9 WHEN 0 THEN 'WS-C2960X-48FPD-L' WHEN 1 THEN 'C9300-48P-A' WHEN 2 THEN 'cisco N7K-C7009' WHEN 3 THEN 'ISR4331/K9' WHEN 4 THEN 'SG350 (PID:SG350-28P-K9)-V' WHEN 5 THEN '10.1.1.1' WHEN 6 THEN 'PWR-' || {k} WHEN 7 THEN '' ELSE 'N9K-X9736-' || ({k} % 40) END"

ADAPTERS = {
    "devices": " UNION ALL ".join(
        f"SELECT 's{g}' AS scan_id, {host('s_suppkey')} AS hostname, s_suppkey AS device_ord, '10.9.' || (s_suppkey % 256) || '.{g}' AS mgmt_ip, CASE s_suppkey % 5 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'cisco_xe' WHEN 2 THEN 'cisco_nxos' WHEN 3 THEN 'arista_eos' END AS device_type,"
        f" CASE s_suppkey % 4 WHEN 0 THEN 'switch' WHEN 1 THEN 'router' WHEN 2 THEN '' END AS device_category, {PIDS.format(k=f'(s_suppkey + {g})')} AS platform FROM {{supplier}}"
        for g in range(3)
    ),
    "arp": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, {LINE} AS item_ord, 'Vlan' || l_linenumber AS interface, '10.' || (l_partkey % 256) || '.' || (l_orderkey % 256) || '.' || l_linenumber AS ip, {mac('l_partkey % 50')} AS mac, CAST(l_partkey % 240 AS VARCHAR(9)) AS age FROM {{lineitem}}",
    "mac": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, {LINE} AS item_ord, upper({mac('l_partkey % 60')}) AS mac, CAST(l_partkey % 100 AS VARCHAR(9)) AS vlan, CASE l_returnflag WHEN 'R' THEN 'DYNAMIC' WHEN 'A' THEN 'STATIC' ELSE 'SECURE' END AS type, 'Gi0/' || l_linenumber AS ports FROM {{lineitem}}",
    "pairs": f"SELECT {SCAN.replace('l_', 'a.l_')} AS scan_id, a.l_suppkey AS ka, b.l_suppkey AS kb, a.l_linenumber AS ia, b.l_linenumber AS ib, a.l_orderkey AS o FROM {{lineitem}} a JOIN {{lineitem}} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "roots": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, l_suppkey AS device_ord, {LINE} AS item_ord, 'VLAN00' || (l_partkey % 50) AS vlan_id, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE {mac('l_partkey % 3 + 1')} END AS root_address, CAST(CASE WHEN l_partkey % 2 = 0 THEN 32768 + l_partkey % 50 ELSE 4096 END AS VARCHAR(9)) AS root_priority, CAST(l_linenumber - 1 AS VARCHAR(9)) AS root_cost FROM {{lineitem}}",
    "vlan_names": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, l_suppkey AS device_ord, {LINE} AS item_ord, CAST(l_partkey % 60 AS VARCHAR(9)) AS vlan_id, CASE l_partkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'USERS_' || (l_partkey % 60) WHEN 2 THEN 'USER_' || (l_partkey % 60) ELSE CASE WHEN l_partkey % 120 < 60 THEN 'VLAN00' || (l_partkey % 60) ELSE 'SERVERS-LAB-' || (l_partkey % 7) END END AS name FROM {{lineitem}}",
    "blocked": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, l_suppkey AS device_ord, {LINE} AS item_ord, CAST(l_partkey % 40 AS VARCHAR(9)) AS vlan_id, 'Gi0/' || l_linenumber AS interface, CASE WHEN l_partkey % 3 = 0 THEN 'BKN*' ELSE 'BLK' END AS status, CASE WHEN l_partkey % 3 = 0 THEN 'BA_Inc' ELSE '' END AS reason FROM {{lineitem}}",
    "ports": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, {LINE} AS item_ord, 'Gi' || l_linenumber || '/' || (l_partkey % 48) AS interface, CASE l_partkey % 3 WHEN 0 THEN 'static access' WHEN 1 THEN 'Trunk' ELSE '' END AS mode, CAST(l_partkey % 5 AS VARCHAR(9)) AS native_vlan, CASE WHEN l_partkey % 2 = 0 THEN 'ALL' ELSE '10,20' END AS allowed_vlans, CASE WHEN l_partkey % 7 = 0 THEN '100' ELSE '' END AS voice_vlan FROM {{lineitem}}",
    "port_flags": f"SELECT DISTINCT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, 'gi' || l_linenumber || '/' || (l_partkey % 48) AS interface, l_partkey % 2 AS kind FROM {{lineitem}}",
    "configs": "SELECT scan_id, hostname, device_ord, CASE device_ord % 4 WHEN 0 THEN 'hostname x spanning-tree portfast bpduguard default' WHEN 1 THEN 'interface y spanning-tree bpduguard enable spanning-tree guard root' WHEN 2 THEN 'plain' ELSE '' END AS config FROM devices",
    "ip_flat": f"SELECT 's' || (o_orderkey % 3) AS scan_id, {host('(o_custkey % 400)')} AS hostname, o_custkey % 400 AS device_ord, o_orderkey AS item_ord, CASE o_orderkey % 5 WHEN 0 THEN 'Vlan' || (o_orderkey % 90) WHEN 1 THEN 'GigabitEthernet0/' || (o_orderkey % 48) WHEN 2 THEN 'Loopback' || (o_orderkey % 10) WHEN 3 THEN 'Port-channel' || (o_orderkey % 20) ELSE 'mgmt0' END AS interface, {IP} AS ip1, CAST(22 + o_orderkey % 9 AS VARCHAR(9)) AS p1, CASE WHEN o_orderkey % 6 = 0 THEN '172.' || (16 + o_orderkey % 16) || '.' || (o_orderkey % 250) || '.1' END AS ip2, CASE WHEN o_orderkey % 12 = 0 THEN '16' ELSE '25' END AS p2, o_orderkey % 2 = 1 AS nx FROM {{orders}}",
    "hsrp": f"SELECT 's' || (o_orderkey % 3) AS scan_id, {host('(o_custkey % 400)')} AS hostname, o_orderkey AS item_ord, 'Vlan' || (o_orderkey % 90) AS interface, CAST(o_orderkey % 10 AS VARCHAR(9)) AS grp, CAST(90 + o_orderkey % 30 AS VARCHAR(9)) AS priority, CASE o_orderkey % 11 WHEN 0 THEN 'Init' WHEN 1 THEN '' WHEN 2 THEN 'standby' ELSE 'Active' END AS state, '10.0.' || (o_orderkey % 250) || '.254' AS virtual_ip FROM {{orders}}",
    "intf_notes": f"SELECT 's' || (o_orderkey % 3) AS scan_id, {host('(o_custkey % 400)')} AS hostname, o_orderkey AS item_ord, CASE WHEN o_orderkey % 2 = 0 THEN 'gigabitethernet0/' || (o_orderkey % 48) ELSE 'PORT-CHANNEL' || (o_orderkey % 20) END AS interface, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'to ' || (o_orderkey % 97) END AS description FROM {{orders}}",
    "route_counts": f"SELECT 's' || (o_orderkey % 3) AS scan_id, {host('(o_custkey % 400)')} AS hostname, o_orderkey AS item_ord, CASE o_orderkey % 8 WHEN 0 THEN 'connected' WHEN 1 THEN 'static' WHEN 2 THEN 'ospf 1' WHEN 3 THEN 'eigrp 10' WHEN 4 THEN 'bgp 65001' WHEN 5 THEN 'BGP' WHEN 6 THEN 'isis' ELSE 'local' END AS source, CASE WHEN o_orderkey % 50 = 7 THEN 'n/a' ELSE CAST(o_orderkey % 10 AS VARCHAR(9)) END AS cnt FROM {{orders}}",
    "bgp": f"SELECT 's' || (o_orderkey % 3) AS scan_id, {host('o_custkey')} AS hostname, o_orderkey AS item_ord, '192.0.' || (o_orderkey % 256) || '.' || (o_custkey % 256) AS neighbor, CAST(64512 + o_orderkey % 1000 AS VARCHAR(9)) AS asn, CASE o_orderstatus WHEN 'F' THEN 'Established' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Idle' ELSE 'Established' END ELSE 'Active' END AS state, CAST(o_orderkey % 500 AS VARCHAR(9)) AS prefixes_received, '0' || (o_orderkey % 10) || ':00:00' AS up_down FROM {{orders}}",
    "ospf_if": f"SELECT 's' || (o_orderkey % 3) AS scan_id, {host('(o_custkey % 300)')} AS hostname, o_orderkey AS item_ord, 'Gi0/' || (o_orderkey % 48) AS interface, CAST(o_custkey % 20 AS VARCHAR(9)) AS area, CASE WHEN o_orderkey % 40 = 3 THEN 'x' ELSE CAST(CASE WHEN o_custkey % 20 < 5 THEN 1 + o_orderkey % 7 ELSE 1 + (o_orderkey % 30) * 10 END AS VARCHAR(9)) END AS cost, 'DR' AS state, CAST(o_orderkey % 4 AS VARCHAR(9)) AS nbrs FROM {{orders}}",
    "ospf_proc": f"SELECT DISTINCT 's' || (o_orderkey % 3) AS scan_id, {host('(o_custkey % 175 * 2)')} AS hostname, o_custkey % 175 * 2 AS k FROM {{orders}}",
    "routes": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, {LINE} AS item_ord, '10.' || (l_partkey % 256) || '.0.0' AS network, CASE l_linenumber WHEN 1 THEN '32' WHEN 2 THEN '255.255.255.255' WHEN 3 THEN '/32' ELSE '24' END AS mask, '10.0.0.' || l_linenumber AS next_hop, 'Gi0/' || l_linenumber AS interface, l_linestatus AS protocol, CAST(l_partkey % 20 AS VARCHAR(9)) AS metric FROM {{lineitem}}",
    "l3_neighbors": f"SELECT 's' || (o_orderkey % 3) AS scan_id, {host('(o_custkey % 400)')} AS hostname, o_orderkey AS item_ord, '10.0.' || (o_orderkey % 256) || '.2' AS remote_ip, 'R' || (o_orderkey % 100) AS remote_device, CASE o_orderkey % 3 WHEN 0 THEN 'ospf' WHEN 1 THEN 'OSPF' ELSE 'bgp' END AS protocol, CASE o_orderkey % 7 WHEN 0 THEN 'INIT' WHEN 1 THEN '2WAY/DROTHER' WHEN 2 THEN '' ELSE 'FULL/BDR' END AS state FROM {{orders}}",
    "rules": f"SELECT {SCAN} AS scan_id, {host('l_suppkey')} AS hostname, l_orderkey AS o, l_linenumber AS n, 'ACL-' || l_orderkey AS name, CASE WHEN l_linestatus = 'O' THEN 'permit' ELSE 'deny' END AS action, CASE WHEN l_partkey % 3 = 0 THEN 'ip' ELSE 'tcp' END AS protocol, CASE WHEN l_partkey % 4 = 0 THEN 'any' ELSE 'host 10.0.0.' || (l_partkey % 200) END AS source, CASE WHEN l_partkey % 2 = 0 THEN 'any' ELSE '10.2.0.0 0.0.255.255' END AS destination, CAST(l_quantity AS BIGINT) % 5 AS hits FROM {{lineitem}}",
    "nat": f"SELECT DISTINCT 's' || (c_custkey % 3) AS scan_id, {host('c_custkey')} AS hostname, c_custkey AS k, c_custkey % 1000 AS active, c_custkey % 3 AS pools, (c_custkey * 7) % 101 AS util FROM {{customer}}",
    "items": f"SELECT 's' || (p_partkey % 3) AS scan_id, {host('(p_partkey % 100 + 1)')} AS hostname, p_partkey AS item_ord, CASE p_partkey % 8 WHEN 0 THEN 'Chassis' WHEN 1 THEN 'Switch 1' WHEN 2 THEN 'Switch 2 - Power' WHEN 3 THEN 'Fan_1' WHEN 4 THEN 'Slot 3' WHEN 5 THEN '1' WHEN 6 THEN 'xcvr-' || p_partkey ELSE 'Line card ' || p_partkey END AS name, p_name AS descr, {PIDS.format(k='p_partkey')} AS pid, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'SN' || p_partkey END AS sn FROM {{part}}",
    "modules": f"SELECT 's' || (p_partkey % 3) AS scan_id, {host('(p_partkey % 60 + 1)')} AS hostname, p_partkey AS item_ord, CAST(p_size AS VARCHAR(9)) AS slot, p_type AS type, CASE p_partkey % 5 WHEN 0 THEN 'WS-C3750X-48' WHEN 1 THEN 'PVDM3-64' WHEN 2 THEN 'GBIC-SX' ELSE 'N9K-X9736-' || (p_partkey % 40) END AS model, 'M' || p_partkey AS serial FROM {{part}}",
    "stack": f"SELECT 's' || (p_partkey % 3) AS scan_id, {host('(p_partkey % 40 + 1)')} AS hostname, p_partkey AS item_ord, CAST(p_partkey % 3 + 1 AS VARCHAR(9)) AS switch, CASE WHEN p_partkey % 3 = 0 THEN 'Active' ELSE 'Member' END AS role, {PIDS.format(k='(p_partkey + 4)')} AS model, 'V01' AS hw_ver, CASE WHEN p_partkey % 2 = 0 THEN 'K' || p_partkey END AS serial, {mac('p_partkey')} AS mac, CAST(p_size AS VARCHAR(9)) AS priority, 'Ready' AS state FROM {{part}}",
    "versions": f"SELECT scan_id, hostname, CASE device_ord % 6 WHEN 0 THEN '15.2(4a)E10' WHEN 1 THEN '16.09.04' WHEN 2 THEN '7.0(3)I7(5)' WHEN 3 THEN '15.5(3)S4b' WHEN 4 THEN '' END AS version, CASE device_ord % 4 WHEN 0 THEN 'WS-C2960X-48FPD-L, WS-C2960X-48' WHEN 1 THEN 'C7009' WHEN 2 THEN '' END AS hardware, CASE WHEN device_ord % 3 = 0 THEN 'V' || device_ord END AS serial FROM devices",
    "lookups": " UNION ALL ".join(
        f"SELECT 's{g}' AS scan_id, 'hw:' || k AS key, CASE WHEN n % 4 = 3 THEN '2025-01-01' ELSE '2026-01-08' END AS fetched_at, CASE n % 5 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2026-06-30' WHEN 2 THEN '2031-01-01' WHEN 3 THEN '2031-01-01' ELSE '' END AS ldos, CASE n % 5 WHEN 2 THEN '2025-01-01' WHEN 3 THEN '2030-01-01' ELSE '' END AS eos, n % 7 = 6 AS unlisted"
        " FROM (SELECT DISTINCT 'N9K-X9736-' || (p_partkey % 40) AS k, p_partkey % 40 AS n FROM {part} UNION ALL SELECT 'PWR-' || p_partkey, p_partkey FROM {part} UNION ALL SELECT k, CAST(n AS BIGINT) FROM (VALUES ('WS-C2960X-48FPD-L', 0), ('N7K-C7009', 1), ('SG350-28P-K9', 2), ('C9300-48P-A', 5)) v(k, n)) q"
        for g in range(3)
    ),
    "progress": "SELECT 'scan-' || user_id AS scan_id, event_id AS seq, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'scan_complete' WHEN event_id % 3 = 1 THEN 'scan_error' ELSE 'scan_started' END WHEN 'purchase' THEN 'device_complete' WHEN 'error' THEN 'device_failed' WHEN 'view' THEN 'layer_complete' ELSE 'collecting_data' END AS event, event_id % 4 = 0 AS skipped, CAST(user_id % 5 AS INT) AS depth FROM {events}",
}
#: Adapters that read others.
NEEDS = {"configs": ["devices"], "versions": ["devices"]}


def with_(*names: str) -> str:
    """The adapters as common table expressions for DuckDB."""
    every: list[str] = []
    for n in names:
        every += [x for x in [*NEEDS.get(n, []), n] if x not in every]
    return "WITH " + ", ".join(f"{n} AS ({ADAPTERS[n].format(**{t: t for t in TABLES})})" for n in every) + " "


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ADAPTERS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    for other in NEEDS.get(name, []):
        sql = sql.replace(f"FROM {other}", f"FROM {{{other}}}")
        frames[other] = adapted(spark, sf_dir, other)
    return spark.sql(sql, **frames)


def neighbors(pairs: DataFrame) -> DataFrame:
    """Both directions of linked devices as CDP records; every fifth lacks the far interface."""

    def side(a: str, b: str, flip: int) -> DataFrame:
        k, other = F.col(f"k{a}"), F.col(f"k{b}")
        name = lambda x: F.concat(F.lit("N"), (x % 25).cast("string"), F.lit("-SW-"), x.cast("string"))
        return pairs.select(
            "scan_id", name(k).alias("hostname"), k.alias("device_ord"), ((F.col("o") * 16 + F.col(f"i{a}") * 2 + flip) * 1000003 + other).alias("item_ord"), name(other).alias("remote_device"), F.concat(F.lit("10.9."), (other % 256).cast("string"), F.lit("."), (F.col("o") % 3).cast("string")).alias("remote_ip"),
            F.concat(F.lit("GigabitEthernet0/"), F.col(f"i{a}").cast("string")).alias("local_intf"), F.when(F.col("o") % 5 != 0, F.concat(F.lit("TenGigabitEthernet1/"), F.col(f"i{b}").cast("string"))).alias("remote_intf"),
            F.when(F.col("o") % 2 == 0, F.array(F.lit("CDP"))).when(F.col("o") % 7 == 0, F.array(F.lit("CDP"), F.lit("OSPF"))).otherwise(F.array(F.lit("LLDP"))).alias("protocols"),
        )

    return side("a", "b", 0).unionByName(side("b", "a", 1))


#: The same for DuckDB, after the adapter `pairs`.
NEIGHBORS = ", neighbors AS (" + " UNION ALL ".join(
    f"SELECT scan_id, {host(f'k{a}')} AS hostname, k{a} AS device_ord, (o * 16 + i{a} * 2 + {flip}) * 1000003 + k{b} AS item_ord, {host(f'k{b}')} AS remote_device, '10.9.' || (k{b} % 256) || '.' || (o % 3) AS remote_ip, 'GigabitEthernet0/' || i{a} AS local_intf, CASE WHEN o % 5 <> 0 THEN 'TenGigabitEthernet1/' || i{b} END AS remote_intf, CASE WHEN o % 2 = 0 THEN 'CDP' WHEN o % 7 = 0 THEN 'CDP,OSPF' ELSE 'LLDP' END AS protocols FROM pairs"
    for a, b, flip in (("a", "b", 0), ("b", "a", 1))
) + ") "


def full_interfaces(flat: DataFrame) -> DataFrame:
    """Interface records in both shapes: lists of addresses, or a primary one and secondary ones."""
    none = F.lit(None).cast("array<string>")
    subnet = lambda ip, p: F.concat(F.substring_index(ip, ".", 3), F.lit(".0/"), p)
    return flat.select(
        "scan_id", "hostname", "device_ord", "item_ord", "interface", F.when(~F.col("nx"), F.array("ip1", F.coalesce("ip2", F.lit("")))).otherwise(none).alias("ip_address"), F.when(~F.col("nx"), F.array("p1", "p2")).otherwise(none).alias("prefix_length"), F.when(F.col("nx"), F.col("ip1")).alias("primary_ip_address"),
        F.when(F.col("nx"), subnet(F.col("ip1"), F.col("p1"))).alias("primary_ip_subnet"), F.when(F.col("nx"), F.array("ip2")).otherwise(none).alias("secondary_ip_address"), F.when(F.col("nx"), F.array(subnet(F.col("ip2"), F.col("p2")))).otherwise(none).alias("secondary_ip_subnet"),
    )


#: The same, one row an address, for DuckDB, after the adapter `ip_flat`.
ADDRESSES = ", addresses AS (SELECT scan_id, hostname, device_ord, item_ord, 0 AS ip_ord, interface, ip1 AS ip, p1 AS prefix, FALSE AS secondary FROM ip_flat UNION ALL SELECT scan_id, hostname, device_ord, item_ord, 1, interface, ip2, p2, TRUE FROM ip_flat WHERE ip2 IS NOT NULL) "
