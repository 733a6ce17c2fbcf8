"""Parsers on small texts of our own; expectations are worked out by hand."""

from fieldglass.parsers import edge, management, neighbors, routing, switching


def texts(spark, *t):
    return spark.createDataFrame([("s", f"h{i}", x) for i, x in enumerate(t)], "scan_id string, hostname string, text string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("hostname", "item_ord").collect()]


CDP = """-------------------------
Device ID: core1.example.net
Entry address(es):
  IP address: 10.0.0.9
Platform: cisco C9300-48P,  Capabilities: Router Switch IGMP
Interface: GigabitEthernet1/0/1,  Port ID (outgoing port): TenGigabitEthernet1/1/1
Management address(es):
  IP address: 10.0.0.1
-------------------------
Device ID: phone7
  IPv4 Address: (not available)
Platform: IP Phone
Interface: Gi1/0/2
"""

LLDP = """Chassis id: aabb.cc00.0100
Port id: Gi0/1
Local Port id: Gi0/24
System Name: dist1.example.net

System Description:
Vendor Software, Version 7
Second line
Time remaining: 99 seconds
System Capabilities: B,R
Management Addresses:
    IP: 10.0.0.2
Auto Negotiation - supported
Chassis id: 0011.2233.4455
System Name: srv
"""


def test_cdp_and_lldp(spark):
    fields = ("remote_device", "remote_ip", "remote_platform", "remote_capabilities", "local_intf", "remote_intf")
    assert rows(neighbors.cdp(texts(spark, CDP, "", None)), *fields) == [
        ("core1", "10.0.0.1", "cisco C9300-48P", "Router Switch IGMP", "GigabitEthernet1/0/1", "TenGigabitEthernet1/1/1"),
        ("phone7", None, "IP Phone", None, "Gi1/0/2", None),
    ]
    assert rows(neighbors.lldp(texts(spark, LLDP)), *fields, "system_description") == [
        ("dist1", "10.0.0.2", "aabb.cc00.0100", "B,R", "Gi0/24", "Gi0/1", "Vendor Software, Version 7 Second line"),
        ("srv", None, "0011.2233.4455", None, None, None, None),
    ]


def test_routing_neighbors(spark):
    ospf = "Neighbor ID Pri State Dead Time Address Interface\n10.1.1.1 1 FULL/DR 00:00:31 10.0.0.1 Gi0/1\n10.1.1.2 1 INIT/- 00:00:31 10.0.0.2 Gi0/2\n10.1.1.3 1 FULL/- 00:00:31 nowhere Gi0/3"
    assert rows(neighbors.ospf(texts(spark, ospf)), "remote_ip", "local_intf", "protocol", "state") == [("10.0.0.1", "Gi0/1", "OSPF", "FULL/DR")]
    eigrp = "EIGRP-IPv4 Neighbors for AS(1)\nH Address Interface Hold\n0 10.0.0.3 Gi0/4 12 01:02:03 1 100 0 45\nx 10.0.0.4 Gi0/5"
    assert rows(neighbors.eigrp(texts(spark, eigrp)), "remote_ip", "local_intf", "state") == [("10.0.0.3", "Gi0/4", "UP")]
    bgp = "BGP neighbor is 10.0.0.5,  remote AS 65001\n  BGP state = Established, up for 1d\n  Local host: 10.0.0.6, Local port: 179\nBGP neighbor is 10.0.0.7\n  BGP state = Idle\n"
    assert rows(neighbors.bgp(texts(spark, bgp)), "remote_ip", "local_intf", "state") == [("10.0.0.5", "10.0.0.6", "Established")]
    isis = "System Id Interface SNPA State Holdtime\nr2 Gi0/0 aabb.cc00.0200 Up 25 L2\nr3 Gi0/1 aabb.cc00.0300 Init 25 L2"
    assert rows(neighbors.isis(texts(spark, isis)), "remote_device", "remote_ip", "state") == [("r2", None, "UP")]
    every = neighbors.l3_neighbors({"OSPF": texts(spark, ospf), "isis": texts(spark, isis), "rip": texts(spark, "x")})
    assert sorted(r["protocol"] for r in every.collect()) == ["IS-IS", "OSPF"]


def test_arp(spark):
    text = "Protocol  Address  Age\nInternet  10.1.1.1  -  0050.56aa.bb01  ARPA  Gi0/1\nInternet  10.1.1.2  15  0050.56aa.bb02  ARPA\n* 10.1.1.3  00:00:20  0050.56aa.bb03  Eth1/1\n00:50:56:aa:bb:cc  10.1.1.4  host  ge-0/0/1.0  none\nInternet  bad  1  x  ARPA  y\n10.1.1.5 00:01 0050.56aa.bb05"
    assert rows(neighbors.arp(texts(spark, text)), "ip", "mac", "age", "interface") == [
        ("10.1.1.1", "00:50:56:aa:bb:01", "0", "Gi0/1"),
        ("10.1.1.2", "00:50:56:aa:bb:02", "15", ""),
        ("10.1.1.3", "00:50:56:aa:bb:03", "00:00:20", "Eth1/1"),
        ("10.1.1.4", "00:50:56:aa:bb:cc", "?", "ge-0/0/1.0"),
        ("10.1.1.5", "00:50:56:aa:bb:05", "00:01", ""),
    ]


def test_access_lists(spark):
    text = """Extended IP access list EDGE
    10 permit tcp any host 10.0.0.1 eq 443 (1234 matches)
    20 deny ip 10.0.0.0 0.0.0.255 any
    30 permit udp host 10.1.1.1 10.2.0.0 0.0.255.255 (1 match)
    remark nothing
Standard IP access list 5
    10 permit 10.0.0.0, wildcard bits 0.0.0.255 (7 matches)
Extended IP access list NONE
"""
    got = {r["name"]: (r["type"], [tuple(e) for e in r["entries"]]) for r in edge.access_lists(texts(spark, text)).collect()}
    assert got == {
        "EDGE": ("Extended", [("permit", "tcp", "any", "host 10.0.0.1 eq 443", 1234), ("deny", "ip", "10.0.0.0 0.0.0.255", "any", 0), ("permit", "udp", "host 10.1.1.1", "10.2.0.0 0.0.255.255", 1)]),
        "5": ("Standard", [("permit", "ip", "10.0.0.0, wildcard bits 0.0.0.255", "", 7)]),
        "NONE": ("Extended", []),
    }


def test_ip_interfaces_and_nat(spark):
    text = "Gi0/0 is up, line protocol is up\n  Internet address is 10.0.0.1/24\n  Outgoing access list is not set\n  Inbound  access list is EDGE\n  Proxy ARP is enabled\n  IP verify source reachable-via RX\nVlan1 is down\n  Proxy ARP is disabled\n"
    assert rows(edge.ip_interfaces(texts(spark, text)), "interface", "ip_address", "acl_in", "acl_out", "proxy_arp", "urpf", "directed_broadcast") == [
        ("Gi0/0", "10.0.0.1/24", "EDGE", "", True, True, False),
        ("Vlan1", "", "", "", False, False, False),
    ]
    nat = "Pro Inside global Inside local Outside local Outside global\ntcp 1.1.1.1:80 10.0.0.1:80 2.2.2.2:5 2.2.2.2:5\nPro a b c d"
    assert rows(edge.nat_translations(texts(spark, nat)), "protocol", "inside_local") == [("tcp", "10.0.0.1:80")]
    stats = "Total active translations: 45 (0 static)\nPeak translations: 50, occurred 1d\nOutside interfaces: Gi0/0, Gi0/1\nInside interfaces: Vlan1\nHits: 100  Misses: 2\n pool P1: netmask 255.255.255.0 total addresses 10, allocated 9 (90%), misses 0\n"
    r = edge.nat_statistics(texts(spark, stats, None)).orderBy("hostname").collect()
    assert (r[0]["active_translations"], r[0]["peak_translations"], r[0]["hits"], r[0]["misses"], r[0]["outside_interfaces"], r[0]["inside_interfaces"], [tuple(p) for p in r[0]["pools"]]) == (45, 50, 100, 2, ["Gi0/0", "Gi0/1"], ["Vlan1"], [("P1", 10, 9, 90)])
    assert (r[1]["active_translations"], r[1]["pools"], r[1]["inside_interfaces"]) == (0, [], [])


def test_management(spark):
    r = management.ntp_status(texts(spark, "Clock is synchronized, stratum 3, reference is 10.9.9.9", "")).orderBy("hostname").collect()
    assert [(x["synchronized"], x["stratum"], x["reference"]) for x in r] == [(True, "3", "10.9.9.9"), (False, "", "")]
    peers = "  address         ref clock       st   when   poll reach\n*~10.9.9.9 .GPS. 1 22 64 377 1.0\n10.9.9.8 10.1.1.1 2 5 64 17 1.0"
    assert rows(management.ntp_peers(texts(spark, peers)), "remote", "stratum", "when", "reach", "status") == [("*~10.9.9.9", "1", "22", "377", ""), ("10.9.9.8", "2", "5", "17", "")]
    log = management.logging(texts(spark, "Syslog logging: enabled\nLogging is on\nBuffer logging:  level debugging, 4096 bytes\nTrap logging: level informational, 5 message lines\nLogging to 10.8.8.8 (udp)\n")).first()
    assert (log["logging_on"], log["buffer_size"], log["hosts"], log["trap_level"]) == (True, "4096 bytes", ["10.8.8.8"], "informational")
    snmp = management.snmp(texts(spark, "Community s3cret\nContact: noc\nLocation: lab\n")).first()
    assert (snmp["communities_detected"], snmp["v3_configured"], snmp["contact"], snmp["location"]) == (True, False, "noc", "lab") and "s3cret" not in str(snmp)
    df = spark.createDataFrame([("s", "h", "1 alice vty0\nTotal sessions: 3", "aaa authentication login default group tacacs+ key hush local\naaa accounting exec default")], "scan_id string, hostname string, sessions string, config string")
    aaa = management.aaa(df).first()
    assert (aaa["active_sessions"], aaa["aaa_configured"], aaa["accounting_configured"], aaa["authorization_configured"], aaa["tacacs_configured"], aaa["radius_configured"]) == (3, True, True, False, True, False)
    assert [tuple(m) for m in aaa["authentication_methods"]] == [("login", "default", "group tacacs+ key <REDACTED> local")]
    raw = spark.createDataFrame([("show snmp", "s3cret"), ("show clock", "12:00")], "command string, text string")
    assert {r["command"]: r["text"] for r in management.redacted(raw).collect()} == {"show snmp": "<REDACTED>", "show clock": "12:00"}


def test_routing(spark):
    assert rows(routing.route_summary(texts(spark, "Route Source    Networks\nconnected       5     5     0\nospf 1          15    12\nTotal           20    17\n")), "source", "count") == [("connected", 5), ("ospf 1", 15)]
    ospf = 'Routing Process "ospf 1" with ID 10.0.0.1\n  Area BACKBONE(0)\n  Area 1\n  Area 1\nRouting Process "ospf 2" with ID 10.0.0.2\n'
    assert rows(routing.ospf_processes(texts(spark, ospf)), "process_id", "router_id", "areas") == [("1", "10.0.0.1", ["BACKBONE(0)", "1"]), ("2", "10.0.0.2", [])]
    assert rows(routing.ospf_interfaces(texts(spark, "Interface PID Area Cost State\nGi0/1 1 0 10 DR\n\n")), "interface", "area", "cost", "state", "neighbors") == [("Gi0/1", "1", "0", "10", "DR")]
    bgp = "Neighbor V AS MsgRcvd\n10.0.0.2        4 65002     100     120       50    0    0 01:02:03  300\n10.0.0.3        4 65003      80      90       50    0    0 00:45:00  Active\n10.0.0.4 4 65004 1 1 1 0 0 never Idle (Admin)"
    assert rows(routing.bgp_summary(texts(spark, bgp)), "neighbor", "asn", "state", "prefixes_received", "up_down") == [("10.0.0.2", "65002", "Established", 300, "01:02:03"), ("10.0.0.3", "65003", "Active", 0, "00:45:00")]
    table = "*> 10.0.0.0/24      10.1.1.1       0   100  0 65001 i\n* i                 10.1.1.3       0   150  0 65002 65003 i"
    assert rows(routing.bgp_table(texts(spark, table)), "status", "network", "next_hop", "metric", "local_pref", "path") == [("*>", "10.0.0.0/24", "10.1.1.1", "0", "100", "65001 i")]
    assert rows(routing.eigrp_topology(texts(spark, "P 10.0.0.0/24, 1 successors, FD is 28160\nX 1.1.1.1, 1 successors, FD is 1")), "code", "network", "successors", "feasible_distance") == [("P", "10.0.0.0/24", 1, "28160")]
    detail = "H   Address     Interface\n0   10.0.0.2    Gi0/1          12 01:02:03  1   100  0  45\n   Stub Peer Advertising (CONNECTED SUMMARY ) Routes\n1   10.0.0.3    Gi0/2          12 02:02:03  1   100  0  45\n"
    assert rows(routing.eigrp_neighbors(texts(spark, detail)), "neighbor", "interface", "uptime", "stub", "stub_flags") == [("10.0.0.2", "Gi0/1", "01:02:03", True, "CONNECTED SUMMARY"), ("10.0.0.3", "Gi0/2", "02:02:03", False, "")]


def test_vrfs(spark):
    pad = " " * 40
    ios = f"Name                 Default RD            Protocols   Interfaces\nMGMT                 65000:100             ipv4        Gi0/1\n{pad}Gi0/2\nCUST                 65000:200             ipv4        Gi0/3\n"
    got = rows(routing.ios_vrfs(texts(spark, ios)), "name", "rd", "interfaces")
    assert got[-2:] == [("MGMT", "65000:100", ["Gi0/1", "Gi0/2"]), ("CUST", "65000:200", ["Gi0/3"])]
    assert rows(routing.nxos_vrfs(texts(spark, "VRF-Name  VRF-ID State Reason\nMGMT    3 Up      --\n")), "name", "interfaces") == [("MGMT", [])]
    assert rows(routing.ios_vrf_interfaces(texts(spark, "Interface IP-Address VRF Protocol\nGi0/1 10.1.1.1 MGMT up\n")), "vrf", "interface", "ip_address") == [("MGMT", "Gi0/1", "10.1.1.1")]
    assert rows(routing.vrf_routes(texts(spark, "C    10.1.1.0/24 is directly connected, Gi0/1\nO    10.2.0.0/16 [110/20] via 10.1.1.1, 00:05:00, Gi0/1\n")), "protocol", "network", "next_hop") == [("C", "10.1.1.0/24", ""), ("O", "10.2.0.0/16", "10.1.1.1")]
    assert rows(routing.vrf_arp(texts(spark, "Internet  10.1.1.1   0   0050.56aa.bb01  ARPA   Gi0/1")), "ip_address", "age", "mac_address", "interface") == [("10.1.1.1", "0", "0050.56aa.bb01", "Gi0/1")]
    raw = spark.createDataFrame([("s", "h", "show ip route vrf A", "x"), ("s", "h", "show ip arp vrf A", "y"), ("s", "h", "show vrf", "z")], "scan_id string, hostname string, command string, text string")
    assert [(r["vrf"], r["text"]) for r in routing.by_vrf(raw, "route").collect()] == [("A", "x")]
    vrfs = routing.ios_vrfs(texts(spark, ios)).where("rd <> 'Default'")
    assert sorted(r["command"] for r in routing.vrf_commands(vrfs.where("name in ('MGMT', 'CUST')")).collect()) == ["show ip arp vrf CUST", "show ip arp vrf MGMT", "show ip route vrf CUST", "show ip route vrf MGMT"]


def test_spanning_tree(spark):
    text = " VLAN0010 is executing the rstp compatible Spanning Tree protocol\n  Number of topology changes 369 last change occurred\n Port 1 (GigabitEthernet0/1) of VLAN0010 is designated forwarding\n   Port path cost 4, Port priority 128\n Port 4096 (port-channel1, vPC Peer-link) of VLAN0010 is root blocking\n VLAN0020 is executing the rstp\n Port 2 (Gi0/2) of VLAN0020 is root forwarding\n"
    assert rows(switching.stp_detail(texts(spark, text)), "vlan", "interface", "role", "state", "cost", "topology_changes") == [
        (10, "GigabitEthernet0/1", "designated", "forwarding", 4, 369),
        (10, "port-channel1", "root", "blocking", 0, 369),
        (20, "Gi0/2", "root", "forwarding", 0, 0),
    ]
    bad = "Name Interface Inconsistency\n---- ----\nVLAN0010             Gi0/1     Port Type Inconsistent\n"
    assert rows(switching.inconsistent_ports(texts(spark, bad, "VLAN0010 Gi0/1 x")), "vlan", "interface", "type") == [(10, "Gi0/1", "Port Type Inconsistent")]
    root = "VLAN0001        32769 0050.56aa.bb01         0    2  20  15\nVLAN0010        32778 0050.56aa.bb02         4    2  20  15 Gi0/1"
    assert rows(switching.stp_roots(texts(spark, root)), "vlan", "priority", "root_address", "cost", "port") == [(1, 32769, "0050.56aa.bb01", 0, "15"), (10, 32778, "0050.56aa.bb02", 4, "Gi0/1")]
    blocked = texts(spark, "Name                 Blocked Interfaces List\n-------------------- ------------------------------------\nVLAN0010             Gi0/2, Po50\n\nNumber of blocked ports (segments) in the system : 2\n")
    full = texts(spark, "VLAN0010\n  Spanning tree enabled protocol rstp\nPo50             Desg BKN*1         128.4145 (vPC) Network P2p *BA_Inc\n")
    want = [("10", "Gi0/2", "BLK", "", ""), ("10", "Po50", "BKN*1", "Desg", "BA_Inc")]
    assert rows(switching.blocked_ports(blocked, full), "vlan_id", "interface", "status", "role", "reason") == want
    assert [r[2] for r in rows(switching.blocked_ports(blocked), "vlan_id", "interface", "status")] == ["BLK", "BLK"]


def test_switchports_gateways_stacks(spark):
    text = "Name: Gi0/1\nSwitchport: Enabled\nAdministrative Mode: trunk\nOperational Mode: trunk\nAccess Mode VLAN: 1 (default)\nTrunking Native Mode VLAN: 99 (NATIVE)\nTrunking VLANs Enabled: 10,20\nVoice VLAN: none\n\nName: Gi0/2\nAdministrative Mode: static access\nAccess Mode VLAN: 20 (USERS)\nVoice VLAN: 100\n"
    assert rows(switching.switchports(texts(spark, text)), "interface", "mode", "native_vlan", "allowed_vlans", "voice_vlan") == [("Gi0/1", "trunk", "99", "10,20", ""), ("Gi0/2", "static access", "20", "", "100")]
    hsrp = "                     P indicates configured to preempt.\nInterface   Grp  Pri P State    Active          Standby         Virtual IP\nVl1         0    110 P Active   local           10.1.10.253      10.1.10.1\nVl2         1    90    Standby  10.1.2.2        local           10.1.2.1\n"
    assert rows(switching.hsrp_brief(texts(spark, hsrp)), "interface", "group", "priority", "virtual_ip", "state") == [("Vlan1", "0", "110", "10.1.10.1", "Active"), ("Vlan2", "1", "90", "10.1.2.1", "Standby")]
    records = spark.createDataFrame([("s", "h", 0, "Vl3", "7", "120", "10.3.3.1", "Active"), ("s", "h", 1, "Vl4", "7", "120", None, "Init")], "scan_id string, hostname string, item_ord int, INTERFACE string, GROUP_NUMBER string, PRIORITY string, PRIMARY_IPV4_ADDRESS string, HSRP_ROUTER_STATE string")
    assert rows(switching.hsrp_records(records), "interface", "group", "virtual_ip", "state") == [("Vlan3", "7", "10.3.3.1", "Active")]
    stack = "Switch#  Role   Mac Address     Priority Version  State\n*1       Active 0011.2233.4455     15     V01     Ready\n 2       Member 0011.2233.4466     1      V01     Ready\n"
    assert rows(switching.stack_members(texts(spark, stack)), "switch", "role", "priority", "hw_ver", "state") == [("1", "Active", "15", "V01", "Ready"), ("2", "Member", "1", "V01", "Ready")]
    root = spark.createDataFrame([("s", "h", 0, "VLAN0010", "", "aabb", "32778")], "scan_id string, hostname string, item_ord int, vlan_id string, root_address string, root_id string, priority string")
    assert rows(switching.root_records(root), "vlan_id", "root_address", "root_priority") == [("10", "aabb", "32778")]
    port = spark.createDataFrame([("s", "h", 0, "Gi0/1", "trunk", ["10", "20"], "none")], "scan_id string, hostname string, item_ord int, interface string, admin_mode string, trunking_vlans array<string>, voice_vlan string")
    assert rows(switching.switchport_records(port), "mode", "allowed_vlans", "voice_vlan") == [("trunk", "10,20", "")]
