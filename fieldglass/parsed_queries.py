"""Further registered queries: parsers on texts made from driver tables, sheets, merges, files as texts. The SQL of each selects what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import adapters as A
from .functions import text as tx
from .operators import identity, order
from .operators import neighbors as merging
from .operators.graph import shared_table
from .operators.rows import fallback, upsert
from .parsers import edge as p_edge
from .parsers import management as p_management
from .parsers import neighbors as p_neighbors
from .parsers import routing as p_routing
from .parsers import switching as p_switching
from .plans import edge, flat, l2, l3, lifecycle
from .queries import AS_OF, TABLES, Scans, register, texts, with_
from .sources import scans, sinks
from .streaming.progress import messages

HOST = ["scan_id", "hostname"]
H = "scan_id, hostname"


def made(adapter: str, line: str, header: str = "", order: str = "item_ord"):
    """A device's text from the rows of an adapter."""
    return lambda t: texts(t.adapted(adapter), F.expr(line), header, order)


def plain(t: Scans, text: str, **other: str) -> DataFrame:
    """One text for each device."""
    return t["devices"].select(*HOST, F.expr(text).alias("text"), *[F.expr(v).alias(k) for k, v in other.items()])


def parser(name: str, adapter: str, line: str, parse, columns: str, sql: str, header: str = "", order: str = "item_ord") -> None:
    """A parser on the texts of an adapter's rows; `columns` are expressions over what it gives, `sql` selects them from the adapter."""
    build = made(adapter, line, header, order)
    register(name, lambda t: parse(build(t)).selectExpr("scan_id", "hostname", *columns.split("; ")), with_(adapter) + f"SELECT {H}, {sql}")


# --- neighbours -----------------------------------------------------------------------------------------------------

LLDP = """concat('Chassis id: aabb.cc00.0001\n', coalesce(concat('Port id: ', remote_intf, '\n'), ''), 'Local Port id: ', local_intf, '\nSystem Name: ', remote_device, '.example.net\n\nSystem Description:\nVendor, Version 7\nLine two\nTime remaining: 9 seconds\nSystem Capabilities: B,R\nManagement Addresses:\n    IP: ', remote_ip, '\nAuto Negotiation - supported')"""
register(
    "P2_lldp_text", lambda t: p_neighbors.lldp(texts(t["cdp_lldp.neighbors"], F.expr(LLDP))).drop("item_ord"),
    with_("pairs") + A.NEIGHBORS + f"SELECT {H}, remote_device, remote_ip, 'aabb.cc00.0001' AS remote_platform, 'B,R' AS remote_capabilities, local_intf, remote_intf, 'Vendor, Version 7 Line two' AS system_description FROM neighbors",
)
EIGRP = "concat_ws('  ', cast(item_ord % 9 as string), remote_ip, 'Gi0/1', '12', '01:02:03')"
ISIS = "concat_ws('  ', remote_device, 'Gi0/0', 'aabb.cc00.0200', if(item_ord % 2 = 0, 'Up', 'Init'), '25', 'L2')"
OSPF = "concat_ws('  ', '1.1.1.1', '1', if(state = '', 'DOWN', state), '00:00:31', remote_ip, 'Gi0/1')"
parser("P4_eigrp_text", "l3_neighbors", EIGRP, p_neighbors.eigrp, "remote_ip; local_intf; protocol; state", "remote_ip, 'Gi0/1' AS local_intf, 'EIGRP' AS protocol, 'UP' AS state FROM l3_neighbors", "EIGRP-IPv4 Neighbors for AS(1)\nH   Address   Interface\n")
parser(
    "P5_bgp_neighbors_text", "bgp", "concat('BGP neighbor is ', neighbor, ',  remote AS ', asn, '\n  BGP state = ', state, ', up for 1d\n  Local host: 10.0.0.', cast(cast(asn as bigint) % 200 as string), ', Local port: 179')", p_neighbors.bgp,
    "remote_ip; local_intf; protocol; state", "neighbor AS remote_ip, '10.0.0.' || (CAST(asn AS BIGINT) % 200) AS local_intf, 'BGP' AS protocol, state FROM bgp WHERE state = 'Established'",
)
parser("P6_isis_text", "l3_neighbors", ISIS, p_neighbors.isis, "remote_device; local_intf; protocol; state", "remote_device, 'Gi0/0' AS local_intf, 'IS-IS' AS protocol, 'UP' AS state FROM l3_neighbors WHERE item_ord % 2 = 0", "System Id  Interface  SNPA  State  Holdtime\n")


def _l3(t: Scans) -> DataFrame:
    given = {p: made("l3_neighbors", line)(t) for p, line in {"OSPF": OSPF, "eigrp": EIGRP, "isis": ISIS, "rip": ISIS}.items()}
    return p_neighbors.l3_neighbors(given).select(*HOST, F.coalesce("remote_ip", "remote_device").alias("neighbor"), "protocol", "state")


register(
    "P7_U1_l3_neighbors", _l3,
    with_("l3_neighbors") + f"SELECT {H}, remote_ip AS neighbor, 'OSPF' AS protocol, state FROM l3_neighbors WHERE contains(state, 'FULL') UNION ALL SELECT {H}, remote_ip, 'EIGRP', 'UP' FROM l3_neighbors UNION ALL SELECT {H}, remote_device, 'IS-IS', 'UP' FROM l3_neighbors WHERE item_ord % 2 = 0",
)


def _merged(t: Scans) -> DataFrame:
    n = t["cdp_lldp.neighbors"].withColumn("remote_platform", F.expr("concat('P', cast(item_ord % 7 as string))")).withColumn("system_description", F.expr("if(item_ord % 3 = 0, '', concat('about ', cast(item_ord % 5 as string)))"))
    lldp = F.expr("array_contains(protocols, 'LLDP')")
    r = t.adapted("l3_neighbors").select(*HOST, "item_ord", F.expr("concat('10.9.', cast(item_ord % 120 as string), '.', substr(scan_id, 2, 1))").alias("remote_ip"), "remote_device", F.upper("protocol").alias("protocol"))
    out = merging.merged(n.where(~lldp).drop("protocols", "system_description"), n.where(lldp).drop("protocols"), r)
    return out.select(*HOST, "remote_device", "remote_ip", "remote_platform", "local_intf", "remote_intf", "system_description", F.array_join("protocols", ",").alias("protocols"))


register(
    "J11_J12_merged_neighbors", _merged,
    with_("pairs", "l3_neighbors") + A.NEIGHBORS
    + ", n AS (SELECT *, 'P' || (item_ord % 7) AS p, CASE WHEN item_ord % 3 = 0 THEN '' ELSE 'about ' || (item_ord % 5) END AS d FROM neighbors)"
    f", a AS (SELECT {H}, remote_device AS k, arg_max({{'ip': remote_ip, 'p': p, 'l': local_intf, 'r': remote_intf}}, item_ord) AS v, min(item_ord) AS at_ FROM n WHERE protocols <> 'LLDP' GROUP BY ALL)"
    f", b AS (SELECT {H}, remote_device AS k, arg_min(remote_ip, item_ord) AS ip, arg_min(p, item_ord) AS p, arg_min(local_intf, item_ord) AS l, arg_min(remote_intf, item_ord) FILTER (remote_intf IS NOT NULL) AS r, arg_max(d, item_ord) FILTER (d <> '') AS d, count(*) AS n, min(item_ord) AS at_ FROM n WHERE protocols = 'LLDP' GROUP BY ALL)"
    f", both_ AS (SELECT {H}, k AS remote_device, coalesce(a.v.ip, b.ip) AS remote_ip, CASE WHEN a.k IS NOT NULL THEN a.v.p ELSE b.p END AS remote_platform, coalesce(a.v.l, b.l) AS local_intf, coalesce(a.v.r, b.r) AS remote_intf, b.d AS system_description, CASE WHEN a.at_ IS NOT NULL THEN 'CDP' || repeat(',LLDP', coalesce(b.n, 0)) ELSE substr(repeat(',LLDP', b.n), 2) END AS protocols, a.at_ IS NULL AS part, coalesce(a.at_, b.at_) AS item FROM a FULL OUTER JOIN b USING (scan_id, hostname, k))"
    f", r AS (SELECT {H}, '10.9.' || (item_ord % 120) || '.' || substr(scan_id, 2, 1) AS ip, arg_min(remote_device, item_ord) AS remote_device, string_agg(DISTINCT upper(protocol), ',') AS ps, list(upper(protocol) ORDER BY item_ord) AS every FROM l3_neighbors GROUP BY ALL)"
    ", r1 AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(list_distinct(every), lambda x: {'i': list_position(every, x), 'p': x})), lambda s: s.p), ',') AS more FROM r)"
    f", owner AS (SELECT {H}, remote_ip AS ip, max((part, item)) AS o FROM both_ GROUP BY ALL)"
    " SELECT x.scan_id, x.hostname, x.remote_device, x.remote_ip, remote_platform, local_intf, remote_intf, system_description, x.protocols || CASE WHEN o.ip IS NOT NULL AND r1.more IS NOT NULL THEN ',' || r1.more ELSE '' END AS protocols FROM both_ x LEFT JOIN owner o ON o.scan_id = x.scan_id AND o.hostname = x.hostname AND o.ip = x.remote_ip AND o.o = (x.part, x.item) LEFT JOIN r1 ON r1.scan_id = x.scan_id AND r1.hostname = x.hostname AND r1.ip = x.remote_ip"
    " UNION ALL SELECT r1.scan_id, r1.hostname, r1.remote_device, r1.ip, NULL, NULL, NULL, NULL, more FROM r1 ANTI JOIN owner o ON o.scan_id = r1.scan_id AND o.hostname = r1.hostname AND o.ip = r1.ip",
)

# --- edge, management ------------------------------------------------------------------------------------------------

parser("P9_stack_text", "stack", "concat(if(item_ord % 2 = 0, '*', ' '), switch, '       ', role, ' ', mac, '     ', priority, '     ', hw_ver, '     ', state)", p_switching.stack_members, "switch; role; mac_address; priority; hw_ver; state", "switch, role, mac AS mac_address, priority, hw_ver, state FROM stack", "Switch#  Role   Mac Address     Priority Version  State\n")
parser(
    "P11_ip_interface_text", "ip_flat",
    "concat(interface, ' is up, line protocol is up\n  Internet address is ', ip1, '/', p1, '\n  Outgoing access list is ', if(nx, 'not set', 'OUT_7'), '\n  Inbound  access list is EDGE\n  Proxy ARP is ', if(item_ord % 2 = 0, 'enabled', 'disabled'), if(item_ord % 3 = 0, '\n  IP verify source reachable-via RX', ''), if(item_ord % 5 = 0, '\n  IP directed-broadcast forwarding is enabled', ''))",
    p_edge.ip_interfaces, "interface; ip_address; acl_in; acl_out; proxy_arp; urpf; directed_broadcast",
    "interface, ip1 || '/' || p1 AS ip_address, 'EDGE' AS acl_in, CASE WHEN nx THEN '' ELSE 'OUT_7' END AS acl_out, item_ord % 2 = 0 AS proxy_arp, item_ord % 3 = 0 AS urpf, item_ord % 5 = 0 AS directed_broadcast FROM ip_flat",
)
parser("P12_nat_translations_text", "arp", "concat('tcp ', ip, ':80 10.0.0.1:', age, ' 2.2.2.2:5   2.2.2.3:6')", p_edge.nat_translations, "protocol; inside_global; inside_local; outside_local; outside_global", "'tcp' AS protocol, ip || ':80' AS inside_global, '10.0.0.1:' || age AS inside_local, '2.2.2.2:5' AS outside_local, '2.2.2.3:6' AS outside_global FROM arp", "Pro Inside global Inside local Outside local Outside global\n")
parser(
    "P13_nat_statistics_text", "nat",
    "concat('Total active translations: ', cast(active as string), ' (0 static)\nPeak translations: ', cast(active + 5 as string), ', occurred 1d\nOutside interfaces:  Gi0/0, Gi0/1\nInside interfaces: Vlan1\nHits: ', cast(k as string), '  Misses: 2', if(pools > 0, concat('\n pool P1: netmask 255.255.255.0 total addresses 100, allocated ', cast(util as string), ' (', cast(util as string), '%), misses 0'), ''))",
    p_edge.nat_statistics, "active_translations; peak_translations; hits; misses; array_join(outside_interfaces, ',') AS outside; array_join(inside_interfaces, ',') AS inside; array_join(transform(pools, p -> concat_ws(':', p.name, cast(p.total_addresses as string), cast(p.allocated as string), cast(p.utilization_pct as string))), ';') AS pools",
    "active AS active_translations, active + 5 AS peak_translations, k AS hits, CAST(2 AS BIGINT) AS misses, 'Gi0/0,Gi0/1' AS outside, 'Vlan1' AS inside, CASE WHEN pools > 0 THEN 'P1:100:' || util || ':' || util ELSE '' END AS pools FROM nat", order="k",
)


def _gateways(t: Scans) -> DataFrame:
    r = t.adapted("hsrp").select(*HOST, "item_ord", F.regexp_replace("interface", "Vlan", "Vl").alias("INTERFACE"), F.col("grp").alias("GROUP_NUMBER"), F.col("priority").alias("PRI"), F.expr("if(item_ord % 7 = 0, '', virtual_ip)").alias("PRIMARY_IPV4_ADDRESS"), F.col("state").alias("HSRP_ROUTER_STATE"))
    return p_switching.hsrp_records(r).drop("item_ord")


register("P15_gateway_records", _gateways, with_("hsrp") + f"SELECT {H}, interface, grp AS \"group\", priority, virtual_ip, state FROM hsrp WHERE item_ord % 7 <> 0")
register(
    "P16_ntp_status_text", lambda t: p_management.ntp_status(plain(t, "if(device_ord % 2 = 0, concat('Clock is synchronized, stratum ', cast(device_ord % 5 as string), ', reference is 10.9.9.', cast(device_ord as string)), 'Clock is unsynchronized, stratum 16, no reference clock')")),
    with_("devices") + f"SELECT {H}, device_ord % 2 = 0 AS synchronized, CASE WHEN device_ord % 2 = 0 THEN CAST(device_ord % 5 AS VARCHAR) ELSE '16' END AS stratum, CASE WHEN device_ord % 2 = 0 THEN '10.9.9.' || device_ord ELSE '' END AS reference FROM devices",
)
parser("P17_ntp_peers_text", "arp", "concat('  ', ip, '  .GPS.   1 ', age, '  64  377  1.0')", p_management.ntp_peers, "remote; stratum; `when`; reach; status", "ip AS remote, '1' AS stratum, age AS \"when\", '377' AS reach, '' AS status FROM arp", "  address         ref clock       st   when   poll reach\n")
register(
    "P18_logging_text", lambda t: p_management.logging(plain(t, "concat('Syslog logging: enabled\n', if(device_ord % 3 = 0, '', 'Logging is on\n'), 'Buffer logging:  level debugging, ', cast(device_ord as string), ' bytes\nTrap logging: level informational, 5 message lines\nLogging to 10.8.8.', cast(device_ord as string), ' (udp)\nLogging to 10.8.9.1 (udp)')")).withColumn("hosts", F.array_join("hosts", ",")),
    with_("devices") + f"SELECT {H}, device_ord % 3 <> 0 AS logging_on, device_ord || ' bytes' AS buffer_size, '10.8.8.' || device_ord || ',10.8.9.1' AS hosts, 'informational' AS trap_level FROM devices",
)
register(
    "P19_snmp_text", lambda t: p_management.snmp(plain(t, "concat(if(device_ord % 2 = 0, 'Community s3cret\n', ''), 'Contact: noc ', hostname, '\nLocation: lab\n', if(device_ord % 3 = 0, 'SNMPv3 user', ''))")),
    with_("devices") + f"SELECT {H}, device_ord % 2 = 0 AS communities_detected, device_ord % 3 = 0 AS v3_configured, 'noc ' || hostname AS contact, 'lab' AS location FROM devices",
)


def _aaa(t: Scans) -> DataFrame:
    given = plain(t, "''", sessions="concat('1 alice vty0\n2 bob vty1', if(device_ord % 2 = 0, '\nTotal sessions: 7', ''))", config="if(device_ord % 4 = 3, '', concat('aaa authentication login default group tacacs+ key hush', cast(device_ord as string), ' local\naaa accounting exec default'))")
    return p_management.aaa(given.drop("text")).withColumn("authentication_methods", F.expr("array_join(transform(authentication_methods, m -> concat_ws('/', m.type, m.list_name, m.methods)), ';')"))


register(
    "P20_A19_aaa_text", _aaa,
    with_("devices") + f"SELECT {H}, c AS aaa_configured, CASE WHEN c THEN 'login/default/group tacacs+ key <REDACTED> local' ELSE '' END AS authentication_methods, false AS authorization_configured, c AS accounting_configured, c AS tacacs_configured, false AS radius_configured, CAST(CASE WHEN device_ord % 2 = 0 THEN 7 ELSE 2 END AS BIGINT) AS active_sessions FROM (SELECT *, device_ord % 4 <> 3 AS c FROM devices)",
)
register(
    "P21_redaction", lambda t: p_management.redacted(t["devices"].select(*HOST, F.explode(F.array(F.lit("show snmp"), F.lit("show clock"), F.lit("show running-config | section aaa"))).alias("command"), F.col("hostname").alias("text"))),
    with_("devices") + f"SELECT {H}, command, CASE WHEN command = 'show clock' THEN hostname ELSE '<REDACTED>' END AS text FROM devices, (VALUES ('show snmp'), ('show clock'), ('show running-config | section aaa')) v(command)",
)

# --- routing -----------------------------------------------------------------------------------------------------------

parser("P23_ospf_processes_text", "ospf_proc", "concat('Routing Process \"ospf 1\" with ID 10.255.0.', cast(k as string), '\n  Area BACKBONE(0)\n  Area 7\n  Area 7\nRouting Process \"ospf 2\" with ID 10.254.0.1')", p_routing.ospf_processes, "process_id; router_id; array_join(areas, ',') AS areas", f"'1' AS process_id, '10.255.0.' || k AS router_id, 'BACKBONE(0),7' AS areas FROM ospf_proc UNION ALL SELECT {H}, '2', '10.254.0.1', '' FROM ospf_proc", order="k")
parser("P24_ospf_interfaces_text", "ospf_if", "concat_ws('   ', interface, area, cost, state, nbrs)", p_routing.ospf_interfaces, "interface; area; cost; state; neighbors", "interface, area, cost, state, nbrs AS neighbors FROM ospf_if", "Interface    PID   Area   Cost  State\n")
register(
    "P26_bgp_records", lambda t: p_routing.bgp_records(t.adapted("bgp").select(*HOST, "item_ord", F.col("neighbor").alias("bgp_neighbor"), F.col("asn").alias("neighbor_as"), "up_down", F.expr("if(state = 'Established', prefixes_received, state)").alias("state_pfxrcd"))).drop("item_ord"),
    with_("bgp") + f"SELECT {H}, neighbor, asn, up_down, state, CASE WHEN state = 'Established' THEN CAST(prefixes_received AS BIGINT) ELSE 0 END AS prefixes_received FROM bgp",
)
parser("P27_eigrp_topology_text", "routes", "concat('P ', network, '/24, ', metric, ' successors, FD is ', metric)", p_routing.eigrp_topology, "code; network; successors; feasible_distance", "'P' AS code, network || '/24' AS network, CAST(metric AS BIGINT) AS successors, metric AS feasible_distance FROM routes", "EIGRP topology\nX 1.1.1.1, 1 successors, FD is 1\n")
parser("P28_eigrp_detail_text", "l3_neighbors", "concat(cast(item_ord % 9 as string), '   ', remote_ip, '    Gi0/1          12 01:02:03  1   100  0  45', if(item_ord % 4 = 0, '\n   Stub Peer Advertising (CONNECTED SUMMARY ) Routes', ''))", p_routing.eigrp_neighbors, "neighbor; interface; uptime; stub; stub_flags", "remote_ip AS neighbor, 'Gi0/1' AS interface, '01:02:03' AS uptime, item_ord % 4 = 0 AS stub, CASE WHEN item_ord % 4 = 0 THEN 'CONNECTED SUMMARY' ELSE '' END AS stub_flags FROM l3_neighbors", "H   Address     Interface\n")
parser("P29_bgp_table_text", "routes", "concat('*> ', network, '/24      ', next_hop, '       ', metric, '   100  0 65001 i\n* i                 10.1.1.3       0   150  0 65002 i')", p_routing.bgp_table, "status; network; next_hop; metric; local_pref; path", "'*>' AS status, network || '/24' AS network, next_hop, metric, '100' AS local_pref, '65001 i' AS path FROM routes")
VRF = "concat('V', cast(item_ord as string), '          65000:', cast(item_ord % 90 as string), '     ipv4     Gi0/', cast(item_ord % 48 as string), if(item_ord % 3 = 0, concat('\n', repeat(' ', 40), 'Gi1/7'), ''))"
VRF_SQL = "'V' || item_ord AS name, '65000:' || (item_ord % 90) AS rd, 'Gi0/' || (item_ord % 48) || CASE WHEN item_ord % 3 = 0 THEN '{sep}Gi1/7' ELSE '' END AS interfaces"
parser("P38_vrf_text", "l3_neighbors", VRF, p_routing.ios_vrfs, "name; rd; description; array_join(interfaces, ',') AS interfaces", VRF_SQL.format(sep=",") + ", '' AS description FROM l3_neighbors", "Name                 Default RD            Protocols   Interfaces\n")
parser("P39_nxos_vrf_text", "l3_neighbors", "concat('V', cast(item_ord as string), '    3 Up      --')", p_routing.nxos_vrfs, "name; rd; size(interfaces) AS interfaces", "'V' || item_ord AS name, '' AS rd, 0 AS interfaces FROM l3_neighbors", "VRF-Name  VRF-ID State Reason\n")
parser("P39_vrf_interfaces_text", "ip_flat", "concat_ws('   ', interface, if(nx, ip1, 'unassigned'), 'V7', 'up')", p_routing.ios_vrf_interfaces, "vrf; interface; ip_address", "'V7' AS vrf, interface, ip1 AS ip_address FROM ip_flat WHERE nx", "Interface   IP-Address   VRF   Protocol\n")
parser("P39_nxos_vrf_interfaces_text", "ip_flat", "concat_ws('   ', interface, 'V7', '3', '--')", p_routing.nxos_vrf_interfaces, "vrf; interface; ip_address", "'V7' AS vrf, interface, '' AS ip_address FROM ip_flat", "Interface   VRF-Name   VRF-ID  Site\n")
parser("P40_vrf_routes_text", "routes", "if(item_ord % 3 = 0, concat('C    ', network, '/24 is directly connected, Gi0/1'), concat('O    ', network, '/24 [110/20] via ', next_hop, ', 00:05:00, Gi0/1'))", p_routing.vrf_routes, "protocol; network; next_hop", "CASE WHEN item_ord % 3 = 0 THEN 'C' ELSE 'O' END AS protocol, network || '/24' AS network, CASE WHEN item_ord % 3 = 0 THEN '' ELSE next_hop END AS next_hop FROM routes")
parser("P40_vrf_arp_text", "arp", "concat('Internet  ', ip, '   ', age, '   ', mac, '  ARPA   ', interface)", p_routing.vrf_arp, "ip_address; age; mac_address; interface", "ip AS ip_address, age, mac AS mac_address, interface FROM arp")


def _vrf_outputs(t: Scans) -> DataFrame:
    raw = t["devices"].select(*HOST, F.expr("explode(array(concat('show ip route vrf V', cast(device_ord as string)), 'show ip arp vrf A', 'show vrf'))").alias("command"), F.col("hostname").alias("text"))
    return p_routing.by_vrf(raw, "route").unionByName(p_routing.by_vrf(raw, "arp"))


register("P41_vrf_outputs", _vrf_outputs, with_("devices") + f"SELECT {H}, 'V' || device_ord AS vrf, hostname AS text FROM devices UNION ALL SELECT {H}, 'A', hostname FROM devices")
register(
    "P41_vrf_commands", lambda t: p_routing.vrf_commands(t["devices"].select(*HOST, F.lit(0).alias("item_ord"), F.expr("if(device_ord % 3 = 0, 'management', concat('V', cast(device_ord as string)))").alias("name"))).select(*HOST, "ord", "command"),
    with_("devices") + f"SELECT {H}, ord, 'show ip ' || kind || ' vrf V' || device_ord AS command FROM devices, (VALUES (0, 'route'), (1, 'arp')) v(ord, kind) WHERE device_ord % 3 <> 0",
)
register(
    "P42_fallback", lambda t: fallback(t.adapted("ospf_proc").select(*HOST, F.lit("parsed").alias("source")), t.adapted("ospf_if").select(*HOST, F.lit("raw").alias("source")).distinct(), HOST),
    with_("ospf_proc", "ospf_if") + f"SELECT {H}, 'parsed' AS source FROM ospf_proc UNION ALL SELECT DISTINCT {H}, 'raw' FROM ospf_if ANTI JOIN ospf_proc USING (scan_id, hostname)",
)

# --- switching ---------------------------------------------------------------------------------------------------------

STP = "concat(' ', vlan_id, ' is executing the rstp compatible Spanning Tree protocol\n  Number of topology changes ', root_cost, ' last change occurred\n Port 1 (GigabitEthernet0/', root_cost, if(item_ord % 2 = 0, ', vPC Peer-link', ''), ') of ', vlan_id, ' is designated forwarding\n   Port path cost ', root_priority, ', Port priority 128')"
parser("P30_stp_detail_text", "roots", STP, p_switching.stp_detail, "vlan; interface; role; state; cost; topology_changes", "CAST(substr(vlan_id, 5) AS BIGINT) AS vlan, 'GigabitEthernet0/' || root_cost AS interface, 'designated' AS role, 'forwarding' AS state, CAST(root_priority AS BIGINT) AS cost, CAST(root_cost AS BIGINT) AS topology_changes FROM roots")
parser("P31_inconsistent_ports_text", "roots", "concat(vlan_id, '             Gi0/', root_cost, '     Port Type Inconsistent')", p_switching.inconsistent_ports, "interface; vlan; type", "'Gi0/' || root_cost AS interface, CAST(substr(vlan_id, 5) AS BIGINT) AS vlan, 'Port Type Inconsistent' AS type FROM roots", "VLAN0010 Gi0/1 before\n---- ----\n")
parser("P32_stp_roots_text", "roots", "concat(vlan_id, '        ', root_priority, ' ', if(root_address = '', 'aaaa.bbbb.cccc', root_address), '         ', root_cost, '    2  20  15 Gi0/1')", p_switching.stp_roots, "vlan; priority; root_address; cost; port", "CAST(substr(vlan_id, 5) AS BIGINT) AS vlan, CAST(root_priority AS BIGINT) AS priority, CASE WHEN root_address = '' THEN 'aaaa.bbbb.cccc' ELSE root_address END AS root_address, CAST(root_cost AS BIGINT) AS cost, 'Gi0/1' AS port FROM roots")
parser("P33_port_states_text", "blocked", "concat('VLAN00', vlan_id, '\n', interface, ' Desg ', status, ' 4 128.1 P2p', if(reason <> '', concat(' *', reason), ''))", p_switching.port_states, "vlan_id; interface; role; status; stp_type", "vlan_id, interface, 'Desg' AS role, arg_max(status, item_ord) AS status, arg_max(CASE WHEN reason <> '' THEN 'P2p *' || reason ELSE 'P2p' END, item_ord) AS stp_type FROM blocked GROUP BY scan_id, hostname, vlan_id, interface")
register(
    "P35_root_records", lambda t: p_switching.root_records(t.adapted("roots").select(*HOST, "vlan_id", "root_address", F.lit("none").alias("root_id"), F.col("root_priority").alias("priority"), "root_cost")).select(*HOST, "vlan_id", "root_address", "root_priority", "root_cost", "root_port"),
    with_("roots") + f"SELECT {H}, CAST(CAST(substr(vlan_id, 5) AS BIGINT) AS VARCHAR) AS vlan_id, coalesce(nullif(root_address, ''), 'none') AS root_address, root_priority, root_cost, '' AS root_port FROM roots",
)
register("P35_vlan_records", lambda t: p_switching.vlan_records(t.adapted("vlan_names").select(*HOST, F.concat(F.lit("vlan00"), "vlan_id").alias("vlan_id"), F.col("name").alias("vlan_name"))), with_("vlan_names") + f"SELECT {H}, vlan_id, name FROM vlan_names")
register(
    "P37_switchport_records", lambda t: p_switching.switchport_records(t.adapted("ports").select(*HOST, "interface", F.col("mode").alias("admin_mode"), "native_vlan", F.split("allowed_vlans", ",").alias("trunking_vlans"), F.expr("if(voice_vlan = '', 'None', voice_vlan)").alias("voice_vlan"))),
    with_("ports") + f"SELECT {H}, interface, mode, native_vlan, allowed_vlans, voice_vlan FROM ports",
)

# --- sheets ------------------------------------------------------------------------------------------------------------

TABLES |= {
    "interfaces.interfaces_status": lambda t: t.adapted("ports").select(*HOST, "item_ord", F.col("interface").alias("port"), F.expr("nullif(voice_vlan, '')").alias("name"), F.lit("connected").alias("status"), F.col("native_vlan").alias("vlan"), F.lit("full").alias("duplex"), F.lit(None).cast("string").alias("speed"), F.col("mode").alias("type")),
    "interfaces.ip_interfaces": lambda t: t.adapted("ip_flat").select(*HOST, "item_ord", "interface", F.col("ip2").alias("ip_address"), F.lit("up").alias("status"), F.col("p1").alias("protocol")),
    "stp_detail.stp_detail": lambda t: t.adapted("roots").select(*HOST, "item_ord", F.col("vlan_id").alias("vlan"), F.lit("Gi0/1").alias("interface"), F.lit("Root").alias("role"), F.lit(None).cast("string").alias("state"), F.col("root_priority").alias("cost"), F.expr("if(item_ord % 4 = 0, 'n/a', root_cost)").alias("topology_changes")),
    "vrf.vrfs": lambda t: p_routing.ios_vrfs(made("l3_neighbors", VRF)(t)),
    "edge_services.ip_interfaces": lambda t: t.adapted("ip_flat").select(*HOST, "item_ord", "interface", F.col("ip1").alias("ip_address"), F.col("ip2").alias("acl_in"), F.lit("").alias("acl_out"), F.expr("if(nx, 'True', 'false')").alias("proxy_arp"), F.lit(None).cast("string").alias("urpf")),
}
SITE = "CASE WHEN contains(hostname, '-') THEN split_part(hostname, '-', 1) ELSE '' END AS site"
register("F18_interface_status", flat.interface_status, with_("ports") + "SELECT scan_id, hostname AS device, interface AS port, voice_vlan AS description, 'connected' AS status, native_vlan AS vlan, 'full' AS duplex, '' AS speed, mode AS type FROM ports")
register("F18_ip_interfaces", flat.ip_interfaces, with_("ip_flat") + "SELECT scan_id, hostname AS device, interface, coalesce(ip2, '') AS ip_address, 'up' AS status, p1 AS protocol FROM ip_flat")
register("F18_stp_topology", l2.stp_topology, with_("roots") + f"SELECT scan_id, hostname AS device, {SITE}, vlan_id AS vlan, 'Gi0/1' AS interface, 'Root' AS role, '' AS state, root_priority AS cost, CASE WHEN item_ord % 4 = 0 THEN 0 ELSE CAST(root_cost AS BIGINT) END AS topology_changes FROM roots")
register("A17_vrf_summary", l3.vrf_summary, with_("l3_neighbors") + f"SELECT scan_id, hostname AS device, {SITE}, name AS vrf_name, rd, interfaces, CAST(n AS BIGINT) AS interface_count FROM (SELECT {H}, {VRF_SQL.format(sep=', ')}, CASE WHEN item_ord % 3 = 0 THEN 2 ELSE 1 END AS n FROM l3_neighbors)")
register("F18_edge_interfaces", edge.edge_interfaces, with_("ip_flat") + f"SELECT scan_id, hostname AS device, {SITE}, interface, ip1 AS ip, coalesce(ip2, '') AS acl_in, '' AS acl_out, CASE WHEN nx THEN 'Yes' ELSE 'No' END AS proxy_arp, 'No' AS urpf FROM ip_flat")
register("P43_F12_configs", flat.configs, with_("configs") + f"SELECT {H}, config FROM configs WHERE config <> ''")


def _day():
    return F.lit(AS_OF).cast("date")


register(
    "F18_software_lifecycle", lambda t: lifecycle.software(t, _day()).select("scan_id", "device_name", "management_ip", "device_type", "current_version", "os_type", "status", "days_remaining"),
    with_("devices", "versions") + "SELECT d.scan_id, d.hostname AS device_name, mgmt_ip AS management_ip, device_type, coalesce(version, '') AS current_version, CASE device_type WHEN 'cisco_ios' THEN 'IOS' WHEN 'cisco_xe' THEN 'IOS-XE' WHEN 'cisco_nxos' THEN 'NX-OS' ELSE '' END AS os_type, 'No Data' AS status, CAST(NULL AS BIGINT) AS days_remaining FROM devices d LEFT JOIN versions v USING (scan_id, hostname) WHERE device_type LIKE 'cisco%'",
)

# --- rows of files, order, texts -----------------------------------------------------------------------------------------

DETAIL = {"device": "Device", "interface": "Interface", "ip": "IP", "mac": "MAC", "age": "Age"}
QUOTED = "'\"{h}\":\"' || {c} || '\"'"
register("S12_json_lines", lambda t: sinks.lines(flat.arp_detail(t), DETAIL, "json"), with_("arp") + "SELECT scan_id, '{' || " + " || ',' || ".join(QUOTED.format(h=h, c={"device": "hostname"}.get(c, c)) for c, h in DETAIL.items()) + " || '}' AS line FROM arp")


def _quoted_names(t: Scans) -> DataFrame:
    p = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    note = F.expr("concat(p_name, case p_partkey % 4 when 0 then ', \"x\"' when 1 then ' <&>' when 2 then char(7) else '' end)")
    return p.select(F.lit("s").alias("scan_id"), F.struct("p_partkey").alias("place"), "p_partkey", note.alias("note"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brand"))


NAMES = {"p_partkey": "No", "note": "Note", "brand": "Brand"}
NOTES = "WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ', \"x\"' WHEN 1 THEN ' <&>' WHEN 2 THEN chr(7) ELSE '' END AS note, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS brand FROM part) SELECT 's' AS scan_id, "
register("S13_csv_lines", lambda t: sinks.lines(_quoted_names(t), NAMES, "csv"), NOTES + "p_partkey || ',' || CASE WHEN p_partkey % 4 = 0 THEN '\"' || replace(note, '\"', '\"\"') || '\"' ELSE note END || ',' || brand AS line FROM n")
register("S14_C24_xml_lines", lambda t: sinks.lines(_quoted_names(t), NAMES, "xml"), NOTES + "'<row><field name=\"No\">' || p_partkey || '</field><field name=\"Note\">' || replace(replace(replace(replace(note, chr(7), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</field><field name=\"Brand\">' || brand || '</field></row>' AS line FROM n")


def numbered(df: DataFrame) -> DataFrame:
    """Rows with their number within a scan, in the sheet's order."""
    return order.numbered(df, ["scan_id"], ["place"], "number").withColumn("number", (F.col("number") + 1).cast("int"))


register("O1_order_of_details", lambda t: numbered(flat.arp_detail(t).select("scan_id", "device", "ip", "place")).select("scan_id", "device", "ip", "number"), with_("arp") + "SELECT scan_id, hostname AS device, ip, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY hostname, item_ord) AS INTEGER) AS number FROM arp")
register("O2_order_of_vlans", lambda t: numbered(l2.vlan_places(t)).select("scan_id", "vlan_id", "number"), with_("roots", "vlan_names") + ", v AS (SELECT scan_id, CAST(substr(vlan_id, 5) AS BIGINT) AS n FROM roots WHERE root_address <> '' UNION SELECT scan_id, CAST(vlan_id AS BIGINT) FROM vlan_names) SELECT scan_id, CAST(n AS VARCHAR) AS vlan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY n) AS INTEGER) AS number FROM v")
register(
    "C27_C32_texts", lambda t: t["devices"].select("scan_id", "hostname", tx.prompt_name(F.concat(F.lit(" "), "hostname", F.lit("#> "))).alias("prompt"), tx.masked(F.col("hostname")).alias("shown"), tx.without_keys(F.concat(F.lit("use key "), "hostname", F.lit(" now"))).alias("bare"), tx.joined(F.array("hostname", F.lit("x"))).alias("listed")),
    with_("devices") + "SELECT scan_id, hostname, hostname AS prompt, right(hostname, 4) AS shown, 'use key <REDACTED> now' AS bare, hostname || ', x' AS listed FROM devices",
)


def _documents(t: Scans) -> DataFrame:
    """Scan documents as JSON in parts of one device, a few of them broken."""
    entries = t.adapted("arp").groupBy(*HOST).agg(F.array_sort(F.collect_list(F.struct("item_ord", F.struct(F.col("ip").alias("address"), F.col("mac").alias("hardware"), "interface", "age").alias("r")))).alias("e"))
    d = t["devices"].join(entries, HOST).select(*HOST, F.col("device_ord").cast("bigint").alias("place"), F.struct("mgmt_ip", "device_type", F.struct(F.struct(F.struct(F.transform("e", lambda x: x["r"]).alias("entries")).alias("parsed")).alias("arp")).alias("collector_data")).alias("v"))
    text = F.to_json(F.struct(F.col("scan_id").alias("discovery_id"), F.lit("10.9.1.0").alias("seed_ip"), F.concat(F.lit("2026-01-0"), F.substring("scan_id", 2, 1)).alias("timestamp"), F.create_map("hostname", "v").alias("devices")))
    good = d.select(F.concat("scan_id", F.lit(".json")).alias("filename"), "place", text.alias("text"))
    every = good.unionByName(good.select(F.concat(F.lit("bad-"), "filename").alias("filename"), "place", F.concat(F.lit("{"), "text").alias("text")))
    return shared_table(scans.documents(every).drop("text"))  # parsed once


WITH_ARP = with_("devices", "arp") + ", d AS (SELECT * FROM devices SEMI JOIN arp USING (scan_id, hostname)) "
register("S2_O7_listing", lambda t: scans.listing(_documents(t)).withColumn("number", F.row_number().over(Window.orderBy(F.desc("filename")))), WITH_ARP + "SELECT scan_id || '.json' AS filename, scan_id AS discovery_id, '10.9.1.0' AS seed_ip, '2026-01-0' || substr(scan_id, 2, 1) AS timestamp, count(*) AS device_count, CAST(row_number() OVER (ORDER BY scan_id DESC) AS INTEGER) AS number FROM d GROUP BY scan_id")
register("S3_summaries", lambda t: scans.summaries(_documents(t)).select("scan_id", "device_count", "seed_ip", "timestamp"), WITH_ARP + "SELECT scan_id, count(*) AS device_count, '10.9.1.0' AS seed_ip, '2026-01-0' || substr(scan_id, 2, 1) AS timestamp FROM d GROUP BY scan_id")
register("E2_E3_scan_devices", lambda t: scans.tables(_documents(t))["devices"].select(*HOST, "mgmt_ip", "device_type", F.array_join("collectors", ",").alias("collectors")), WITH_ARP + f"SELECT {H}, mgmt_ip, device_type, 'arp' AS collectors FROM d")
register("E3_P46_scan_arp", lambda t: scans.tables(_documents(t))["arp.entries"].select(*HOST, "item_ord", "ip", "mac", "interface", "age"), with_("devices", "arp") + f"SELECT {H}, CAST(row_number() OVER (PARTITION BY scan_id, hostname ORDER BY item_ord) - 1 AS INTEGER) AS item_ord, ip, mac, interface, age FROM arp SEMI JOIN devices USING (scan_id, hostname)")
register("F1_available_reports", lambda t: scans.available(t["devices"].withColumn("collectors", F.expr("if(device_ord % 50 = 7 and scan_id = 's1', array('arp', 'vrf'), array('arp'))")), ["arp", "vrf"]), with_("devices") + "SELECT scan_id, bool_or(device_ord % 50 = 7 AND scan_id = 's1') AS available FROM devices GROUP BY scan_id")
register(
    "W6_J21_upserts", lambda t: upsert(t.adapted("hsrp"), HOST, ["item_ord"], ["state", "virtual_ip"]).select(*HOST, "state", "virtual_ip", "item_ord"),
    with_("hsrp") + f"SELECT {H}, arg_min(state, item_ord) FILTER (state <> '') AS state, arg_min(virtual_ip, item_ord) AS virtual_ip, min(item_ord) AS item_ord FROM hsrp GROUP BY ALL",
)


def _wanted(t: Scans) -> DataFrame:
    keys = t.adapted("lookups").select("scan_id", "key").unionByName(t["scans"].select("scan_id", F.lit("hw:NEVER").alias("key")))
    fresh, missing = scans.cached(keys, t["eox_cache"], _day())
    return fresh.select("scan_id", "key", F.lit("fresh").alias("state")).unionByName(missing.select("scan_id", "key", F.lit("missing").alias("state")))


register("S10_F2_cached_lookups", _wanted, with_("devices", "lookups") + "SELECT scan_id, key, CASE WHEN fetched_at = '2026-01-08' THEN 'fresh' ELSE 'missing' END AS state FROM lookups UNION ALL SELECT DISTINCT scan_id, 'hw:NEVER', 'missing' FROM devices")


def _lifecycle(t: Scans) -> DataFrame:
    p = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    raw = p.select(F.concat(F.lit(" P"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("EOLProductID"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("ProductIDDescription"), F.struct(F.when(F.col("p_partkey") % 2 == 0, " 2030-01-01 ").alias("value")).alias("LastDateOfSupport"), F.struct(F.col("p_brand").alias("MigrationProductId")).alias("EOXMigrationDetails"))
    raw = raw.withColumn("EOXMigrationDetails", F.struct(F.col("EOXMigrationDetails.MigrationProductId").alias("MigrationProductId"), F.lit(None).cast("string").alias("MigrationProductName"), F.lit(None).cast("string").alias("MigrationStrategy")))
    return scans.lifecycle_records(raw).select("pid", "description", "last_date_of_support", "end_of_sale", "migration_pid", "migration_name")


register("S9_lifecycle_records", _lifecycle, "SELECT 'P' || p_partkey AS pid, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END AS description, CASE WHEN p_partkey % 2 = 0 THEN '2030-01-01' ELSE '' END AS last_date_of_support, '' AS end_of_sale, p_brand AS migration_pid, '' AS migration_name FROM part")
register("T2_messages", lambda t: messages(t.adapted("progress").select("scan_id", "seq", "event")).select("scan_id", "seq", F.split("message", "\n")[0].alias("head")), with_("progress") + "SELECT scan_id, seq, 'event: ' || event AS head FROM progress")

# --- names by address, counts in order ---------------------------------------------------------------------------------


def _shared(t: Scans) -> DataFrame:
    """Devices of which several have one address."""
    return t["devices"].select(*HOST, "device_ord", F.expr("concat('10.9.0.', cast(device_ord % 30 as string))").alias("mgmt_ip"))


def _found(t: Scans) -> DataFrame:
    """Names of two addresses in three: new ones, or that of the address's own first device."""
    n = F.expr("device_ord % 30")
    first = _shared(t).withColumn("n", n).where("n % 3 < 2").groupBy("scan_id", "mgmt_ip", "n").agg(F.min_by("hostname", "device_ord").alias("own"))
    return first.select("scan_id", "mgmt_ip", F.expr("if(n % 3 = 0, concat('REAL-', cast(n as string)), own)").alias("hostname"), F.col("n").alias("ord"))


SHARED = with_("devices", "l3_neighbors") + ", d AS (SELECT scan_id, hostname, device_ord, device_ord % 30 AS n, '10.9.0.' || (device_ord % 30) AS mgmt_ip FROM devices)"
register(
    "J19_names_by_address", lambda t: identity.named_by_address(t.adapted("l3_neighbors").select(*HOST, "item_ord", F.expr("if(item_ord % 7 = 0, '', concat('10.9.0.', cast(item_ord % 40 as string)))").alias("remote_ip")), _shared(t), "remote_ip"),
    SHARED + f", f AS (SELECT scan_id, mgmt_ip, arg_min(hostname, device_ord) AS device_name FROM d GROUP BY ALL), x AS (SELECT {H}, item_ord, CASE WHEN item_ord % 7 = 0 THEN '' ELSE '10.9.0.' || (item_ord % 40) END AS remote_ip FROM l3_neighbors) SELECT x.*, device_name FROM x LEFT JOIN f ON f.scan_id = x.scan_id AND f.mgmt_ip = x.remote_ip",
)
register(
    "G3_renamed_devices", lambda t: identity.renamed(_shared(t), _found(t)).select("*", F.col("place.part").alias("part"), F.col("place.at").alias("at_")),
    # Of addresses with a new name the first device moves to the end; of those named after their own first device the second one replaces it.
    SHARED + ", r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, n ORDER BY device_ord) AS k, first_value(hostname) OVER (PARTITION BY scan_id, n ORDER BY device_ord) AS h1, first_value(device_ord) OVER (PARTITION BY scan_id, n ORDER BY device_ord) AS o1, count(*) OVER (PARTITION BY scan_id, n) AS c FROM d)"
    " SELECT scan_id, CASE WHEN n % 3 = 0 AND k = 1 THEN 'REAL-' || n WHEN n % 3 = 1 AND k = 2 THEN h1 ELSE hostname END AS hostname, device_ord, mgmt_ip, CAST(n % 3 = 0 AND k = 1 AS INTEGER) AS part, CASE WHEN n % 3 = 0 AND k = 1 THEN n WHEN n % 3 = 1 AND k = 2 THEN o1 ELSE device_ord END AS at_ FROM r WHERE NOT (n % 3 = 1 AND k = 1 AND c > 1)",
)


def _mixed_arp(t: Scans) -> dict[str, DataFrame]:
    return {"arp.entries": t.adapted("arp").withColumn("interface", F.expr("case when item_ord % 5 = 0 then concat('Gi0/', cast(item_ord % 3 as string)) when item_ord % 7 = 0 then '' else concat('Vlan', cast(item_ord % 12 as string)) end"))}


register(
    "A22_arp_counts_in_order", lambda t: flat.arp_counts(_mixed_arp(t)).withColumn("number", F.row_number().over(Window.partitionBy("scan_id", "device").orderBy("place"))),
    with_("arp") + f", x AS (SELECT {H}, CASE WHEN item_ord % 5 = 0 THEN 'Gi0/' || (item_ord % 3) WHEN item_ord % 7 = 0 THEN 'Unknown' ELSE 'Vlan' || (item_ord % 12) END AS interface FROM arp), g AS (SELECT {H}, interface, count(*) AS entry_count FROM x GROUP BY ALL)"
    " SELECT scan_id, hostname AS device, interface, entry_count, CAST(row_number() OVER (PARTITION BY scan_id, hostname ORDER BY interface NOT LIKE 'Vlan%', TRY_CAST(substr(interface, 5) AS BIGINT), interface) AS INTEGER) AS number FROM g",
)
