"""Whole scans of our own through the source, the sheets and the sinks; expectations are worked out by hand."""

import csv
import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pytest

from fieldglass.operators import neighbors as merging
from fieldglass.plans import l2, raw, registry
from fieldglass.sources import scans, sinks
from fieldglass.sources.platforms import platform_descriptions
from fieldglass.streaming import progress


def device(kind="cisco_ios", ip="10.0.0.1", platform="", category="switch", **collectors):
    return {"mgmt_ip": ip, "device_type": kind, "device_category": category, "platform": platform, "collector_data": {k: {"raw": v.pop("_raw", {}), "parsed": v} for k, v in collectors.items()}}


def l2_scan():
    """Three switches with VLANs 10 (agreed), 20 (untuned, renamed) and 30 (two roots)."""
    root = lambda vlan, mac, pri, cost: {"vlan_id": vlan, "root_address": mac, "root_priority": pri, "root_cost": cost}
    core = device(
        stp_vlan={"spanning_tree_root": [root("VLAN0010", "aa10", "4106", "0"), root("20", "bb20", "32788", "4"), root("30", "cc30", "32798", "0")], "vlans": [{"vlan_id": "10", "name": "MGMT"}, {"vlan_id": "20", "name": "USERS"}, {"vlan_id": "30", "name": "SERVERS"}], "blocked_ports": [{"vlan_id": "20", "interface": "Gi0/2", "status": "BLK"}, {"vlan_id": "10", "interface": "Gi0/2", "status": "BLK"}]},
        cdp_lldp={"neighbors": [{"remote_device": "LAB-DIST", "local_intf": "Gi0/1", "remote_intf": "Gi0/24", "remote_ip": "10.0.0.2", "protocols": ["CDP"]}]},
        interfaces={"ip_interfaces_full": [{"interface": "Vlan10", "ip_address": ["10.0.10.1"], "prefix_length": ["24"]}, {"interface": "Vlan30", "ip_address": ["10.30.0.1", "10.31.0.1"], "prefix_length": ["16"]}]},
        hsrp={"entries": [{"interface": "Vlan10", "group": "1", "priority": "110", "state": "Active", "virtual_ip": "10.0.10.254"}]},
        switchport={"switchports": [{"interface": "Gi0/1", "mode": "trunk", "native_vlan": "1", "allowed_vlans": "ALL", "voice_vlan": ""}, {"interface": "Gi0/3", "mode": "static access", "native_vlan": "20", "voice_vlan": "100"}], "storm_control": [{"interface": "gi0/3"}], "port_security": []},
        config={"config": "spanning-tree portfast bpduguard default"},
        stp_detail={"_raw": {"show spanning-tree detail": " VLAN0010 is executing the rstp\n  Number of topology changes 2 last\n Port 1 (Gi0/1) of VLAN0010 is designated forwarding\n   Port path cost 4\n"}, "stp_detail": [], "stp_root_summary": []},
    )
    dist = device(ip="10.0.0.2", stp_vlan={"spanning_tree_root": [root("10", "aa10", "4106", "4"), root("20", "bb20", "32788", "0"), root("30", "cc30", "32798", "4")], "vlans": [{"vlan_id": "20", "name": "PRINTER-POOL-X"}], "blocked_ports": []}, cdp_lldp={"neighbors": [{"remote_device": "LAB-CORE", "local_intf": "Gi0/24", "remote_intf": "Gi0/1", "protocols": ["CDP"]}]}, interfaces={})
    access = device(ip="10.0.0.3", stp_vlan={"spanning_tree_root": [root("30", "dd30", "32798", "8")], "vlans": [], "_raw": {"show spanning-tree blockedports": "Name    Blocked Interfaces List\n----\nVLAN0030   Po50\n", "show spanning-tree": "VLAN0030\nPo50 Desg BKN*4 4 128.1 P2p *BA_Inc\n"}}, cdp_lldp={}, interfaces={})
    return {"discovery_id": "scan-l2", "seed_ip": "10.0.0.1", "timestamp": "2026-01-01T00:00:00", "params": {}, "devices": {"LAB-CORE": core, "LAB-DIST": dist, "SITE2-ACC": access}, "scan_summary": {"elapsed": 12.5, "failed_count": 0, "failed": {}}}


def full_scan():
    """One switch with output of every collector, and one with almost none."""
    sw1 = device(
        ip="192.168.1.1", platform="WS-C3750X-48-S",
        arp={"entries": [{"ip": "192.168.1.2", "mac": "aabb.cc00.0002", "interface": "Gi0/1", "age": "5"}, {"address": "192.168.1.9", "hardware": "ddee.ff00.0009", "port": "Vlan1", "age": "-"}]},
        mac_table={"entries": [{"destination_address": "AABB.CC00.0002", "vlan_id": "1", "type": "DYNAMIC", "destination_port": ["Gi0/1", "Gi0/2"]}]},
        interfaces={"interfaces_status": [{"port": "Gi0/1", "name": "up", "status": "connected", "vlan": "trunk", "duplex": "full", "speed": "1000", "type": "T"}], "ip_interfaces": [{"intf": "Vlan1", "ipaddr": "192.168.1.1", "status": "up", "proto": "up"}], "ip_interfaces_full": [{"interface": "Loopback0", "primary_ip_address": "10.255.0.1", "primary_ip_subnet": "10.255.0.1/32", "secondary_ip_address": ["10.255.1.1"], "secondary_ip_subnet": ["10.255.1.0/24"]}], "interfaces_description": [{"port": "LOOPBACK0", "description": "router id"}]},
        device_inventory={"version": [{"VERSION": "15.2(4)E10", "SERIAL": ["FOC1", "FOC2"], "HARDWARE": ["WS-C3750X-48"]}], "inventory": [{"name": "1", "descr": "chassis", "pid": "WS-C3750X-48P", "sn": "FOC1"}], "modules": [{"module": "3", "type": "Network Module", "model": "C3KX-NM-1G", "serial": "M1", "status": "ok", "ports": "4"}, {"module": "1", "model": "WS-C3750X-48", "type": "x"}], "stack_members": [{"switch": "1", "role": "Active", "hw_ver": "V01", "mac_address": "m1", "priority": "15", "state": "Ready"}]},
        l3_routing={"neighbors": [{"remote_ip": "10.0.0.2", "remote_device": "R2", "local_intf": "Gi0/1", "state": "EXSTART", "protocols": ["ospf"]}], "routes": [{"destination": "10.0.0.0", "prefix_length": "24", "nexthop_ip": "10.0.0.2", "nexthop_if": "Gi0/1", "protocol": "O", "metric": "20"}]},
        routing_detail={"route_summary": [{"source": "ospf 1", "count": 3}, {"source": "static", "count": "2"}], "ospf_processes": [{"process_id": "1", "router_id": "10.255.0.1", "areas": ["0", "1"]}], "ospf_interfaces": [], "bgp_summary": [{"neighbor": "203.0.113.1", "asn": "65001", "state": "Active", "prefixes_received": 0, "up_down": "never"}], "eigrp_neighbors": [{"neighbor": "10.0.0.5", "interface": "Gi0/5", "stub": True, "stub_flags": "CONNECTED"}]},
        vrf={"vrfs": [{"name": "MGMT", "rd": "1:1", "interfaces": ["Gi0/0", "Gi0/9"]}], "vrf_routes": {"MGMT": [{"protocol": "C", "network": "10.1.0.0/16", "next_hop": ""}]}, "vrf_arp": {}},
        edge_services={"access_lists": [{"name": "OUT", "type": "Extended", "entries": [{"action": "permit", "protocol": "ip", "source": "any", "destination": "any", "hit_count": 0}]}], "ip_interfaces": [{"interface": "Gi0/0", "ip_address": "203.0.113.2/30", "acl_in": "OUT", "acl_out": "", "proxy_arp": True, "urpf": False, "directed_broadcast": False}], "nat_translations": [], "nat_statistics": {"active_translations": 45, "peak_translations": 50, "hits": 1, "misses": 0, "inside_interfaces": ["Vlan1"], "outside_interfaces": ["Gi0/0"], "pools": [{"name": "P", "total_addresses": 10, "allocated": 9, "utilization_pct": 90}]}},
        config={"config": "hostname SW1\n"},
    )
    sw2 = device(kind=None, ip="192.168.1.2", category=None, cdp_lldp={})
    cache = {"hw:WS-C3750X-48P": {"fetched_at": "2026-01-08T00:00:00", "record": {"description": "Switch", "end_of_sale": "2016-10-30", "last_date_of_support": "2021-10-31", "migration_pid": "C9300", "bulletin_url": "http://b"}}, "hw:OLD": {"fetched_at": "2025-01-01", "record": {}}}
    return {"discovery_id": "scan-full", "seed_ip": "192.168.1.1", "timestamp": "t", "params": {}, "devices": {"SW1": sw1, "SW2": sw2}, "eox_cache": cache}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("scans")
    for doc in (l2_scan(), full_scan()):
        sinks.save_document(doc, str(path))
    (path / "broken.json").write_text("{not json")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return scans.read_documents(spark, folder).cache()


@pytest.fixture(scope="module")
def t(spark, docs):
    out = scans.tables(docs)
    out["platform_descriptions"] = platform_descriptions(spark)
    out["as_of"] = "2026-01-10"
    return out


def sheet(t, report, name, scan):
    return [tuple(r) for r in sinks.ordered(registry.sheet(t, report, name), scan, list(registry.REPORTS[report].sheets[name].headers))]


def test_listing_and_summaries(docs):
    assert [(r["filename"], r["discovery_id"], r["device_count"]) for r in scans.listing(docs).collect()] == [("scan-l2.json", "scan-l2", 3), ("scan-full.json", "scan-full", 2)]
    got = {r["scan_id"]: (r["device_count"], r["elapsed"], r["failed_count"]) for r in scans.summaries(docs).collect()}
    assert got == {"scan-l2": (3, 12.5, 0), "scan-full": (2, None, None)}


def test_vlans(t):
    rows = {r[0]: r for r in sheet(t, "l2_discovery", "VLAN Documentation", "scan-l2")}
    assert rows["10"] == ("10", "LAB", "MGMT", "LAB-CORE, LAB-DIST", "LAB-CORE", "4106", "LAB-CORE: 10.0.10.1/24", "LAB-CORE: 10.0.10.254 (Active, pri 110)", "LAB-CORE-Gi0/2 BLK on VLANs 10, 20", "")
    assert rows["20"][2:6] == ("USERS", "LAB-CORE, LAB-DIST", "LAB-DIST", "32788")
    assert rows["30"][4] == "LAB-CORE" and rows["30"][9] == "STP root mismatch -- see Findings" and rows["30"][8] == "SITE2-ACC-Po50 BLK on VLANs 30"


def test_l2_findings_in_order(t):
    got = [(r[0], r[2]) for r in sheet(t, "l2_discovery", "Findings", "scan-l2")]
    assert got == [
        ("LAB-CORE", "Gi0/2 -- BLK"), ("SITE2-ACC", "Po50 -- BKN*4 (BA_Inc)"), ("LAB-DIST", "VLAN 20 -- default STP priority"), ("LAB-CORE", "VLAN 30 -- default STP priority"),
        ("", "VLAN 30 -- STP root bridge mismatch"), ("", "VLAN 30 (SERVERS) -- /16 subnet"), ("", "VLAN 20 -- name discrepancy"),
    ]
    assert sheet(t, "l2_discovery", "Findings", "scan-full") == [("No findings detected.", "", "", "")]
    assert dict(sheet(t, "l2_discovery", "Summary", "scan-l2")) == {"Device Count": 3, "VLAN Count": 3, "Critical Findings": 1, "Warning Findings": 5, "Info Findings": 1}


def test_ports_and_trees(t):
    assert sheet(t, "l2_discovery", "Root Bridge IDs", "scan-l2") == [("LAB-CORE", "LAB", "aa10"), ("LAB-DIST", "LAB", "bb20")]
    assert sheet(t, "l2_discovery", "STP Topology", "scan-l2") == [("LAB-CORE", "LAB", "10", "Gi0/1", "designated", "forwarding", "4", 2)]
    assert sheet(t, "l2_discovery", "Port Security", "scan-l2") == [("LAB-CORE", "LAB", "Gi0/1", "trunk", "Yes", "No", "No", "No", ""), ("LAB-CORE", "LAB", "Gi0/3", "static access", "Yes", "No", "Yes", "No", "100")]
    assert sheet(t, "l2_discovery", "Trunk Summary", "scan-l2") == [("LAB-CORE", "LAB", "Gi0/1", "1", "ALL", "LAB-DIST")]
    assert l2.unhardened(l2.port_security(t)).where("lacks_root_guard").count() == 1


def test_flat_sheets(t):
    assert sheet(t, "arp_summary", "Summary", "scan-full") == [("SW1", "Gi0/1", 1), ("SW1", "Vlan1", 1)]
    assert sheet(t, "mac_table", "MAC Table", "scan-full") == [("SW1", "AABB.CC00.0002", "1", "DYNAMIC", "Gi0/1, Gi0/2")]
    assert sheet(t, "interface_summary", "IP Interfaces", "scan-full") == [("SW1", "Vlan1", "192.168.1.1", "up", "up")]
    assert sheet(t, "link_inventory", "Links", "scan-l2") == [("LAB-CORE", "Gi0/1", "LAB-DIST", "Gi0/24", "10.0.0.2", "CDP")]
    rows = sheet(t, "device_inventory", "Devices", "scan-full")
    assert rows[0][4:] == ("WS-C3750X-48-S", "Cisco Catalyst 3750-X 48-Port", "15.2(4)E10", "FOC1, FOC2") and rows[1][2] == ""
    assert sheet(t, "device_inventory", "Modules", "scan-full") == [("SW1", "192.168.1.1", "3", "Network Module", "C3KX-NM-1G", "M1", "ok", "4")]
    assert sheet(t, "device_inventory", "Stack Members", "scan-full") == [("SW1", "192.168.1.1", "1", "Active", "V01", "", "m1", "15", "Ready")]


def test_routing_sheets(t):
    s = lambda name: sheet(t, "routing_summary", name, "scan-full")
    assert dict(s("Summary")) == {"Total Devices": 2, "Routed Devices": 1, "Total Routes": 1, "Critical Findings": 2, "Warning Findings": 1, "Info Findings": 1}
    assert s("Routed Interfaces") == [("SW1", "", "Loopback0", "10.255.0.1/32", "router id", "Loopback"), ("SW1", "", "Loopback0", "10.255.1.1/24", "router id", "Loopback (secondary)")]
    assert s("Route Summary") == [("SW1", "", 0, 2, 3, 0, 0, 0, 5)]
    assert s("OSPF Topology") == [("SW1", "", "1", "10.255.0.1", "0", "", "", "", ""), ("SW1", "", "1", "10.255.0.1", "1", "", "", "", "")]
    assert s("IP Address Audit")[1] == ("SW1", "", "Loopback0", "10.255.1.1/24", "10.255.1.0/24", "", "")
    assert s("ARP MAC Map") == [("SW1", "", "192.168.1.2", "aabb.cc00.0002", "Gi0/1", "1", "AABBCC"), ("SW1", "", "192.168.1.9", "ddee.ff00.0009", "Vlan1", "", "DDEEFF")]
    assert s("VRF Summary") == [("SW1", "", "MGMT", "1:1", "Gi0/0, Gi0/9", 2)]
    assert [r[3] for r in s("Findings")] == ["OSPF neighbor not FULL", "EIGRP stub peer", "Static routes alongside dynamic protocol", "BGP peer not Established"]
    assert s("FHRP Status") == []


def test_edge_sheets(t):
    s = lambda name: sheet(t, "internet_edge", name, "scan-full")
    assert dict(s("Summary")) == {"Total Devices": 2, "Edge Devices": 1, "BGP Peers": 1, "Active NAT Translations": 45, "Critical Findings": 1, "Warning Findings": 3, "Info Findings": 1}
    assert s("NAT Overview") == [("SW1", "", "Vlan1", "Gi0/0", "45", "50", "P", "10", "9", "90")]
    assert s("ACL Audit") == [("SW1", "", "OUT", "Extended", 1, 1, "Yes")]
    assert s("Edge Interfaces") == [("SW1", "", "Gi0/0", "203.0.113.2/30", "OUT", "", "Yes", "No")]
    assert [r[3] for r in s("Findings")] == ["BGP peer not Established", "Single-homed BGP", "NAT pool high utilization", "Dead ACL (all zero hits)", "ACL permit ip any any"]


def test_lifecycle(t):
    rows = sheet(t, "eox_lifecycle", "Hardware Lifecycle", "scan-full")
    assert rows[0][:5] == ("SW1", "192.168.1.1", "Chassis", "WS-C3750X-48P", "Switch") and rows[0][11:14] == (-1532, "End-of-Support", "C9300")
    assert rows[1][2:4] == ("Stack Member 1", "WS-C3750X-48P")
    assert dict((r[0], r[1]) for r in sheet(t, "eox_lifecycle", "Status Breakdown", "scan-full"))["End-of-Support"] == 2
    assert dict(sheet(t, "eox_lifecycle", "Summary", "scan-full"))["Cisco Devices"] == 1


def test_availability(t):
    can = lambda report, **k: {r["scan_id"]: r["available"] for r in registry.can_generate(t, report, **k).collect()}
    assert can("l2_discovery") == {"scan-l2": True, "scan-full": False}
    assert can("eox_lifecycle") == {"scan-l2": False, "scan-full": True} and can("eox_lifecycle", lookups=False)["scan-full"] is False


def test_formats(t):
    data = sinks.sheets_of(t, "arp_summary", "scan-full")
    assert json.loads(sinks.to_json(data))["Summary"][0] == {"Device": "SW1", "Interface": "Gi0/1", "Entry Count": 1}
    text = sinks.to_csv(data).decode()
    assert text.startswith("--- Sheet: Summary ---\nDevice,Interface,Entry Count\r\n") and "\n\n--- Sheet: Detail ---\n" in text
    assert next(csv.reader(io.StringIO(text.split("\n", 1)[1]))) == ["Device", "Interface", "Entry Count"]
    assert [f.text for f in ET.fromstring(sinks.to_xml(data)).find("sheet/row")] == ["SW1", "Gi0/1", "1"]
    book = zipfile.ZipFile(io.BytesIO(sinks.export(t, "arp_summary", "scan-full", "xlsx")))
    page = book.read("xl/worksheets/sheet1.xml").decode()
    assert "Entry Count" in page and 'topLeftCell="A2"' in page and "xl/tables/table1.xml" in book.namelist()
    for part in book.namelist():
        ET.fromstring(book.read(part))
    with pytest.raises(ValueError):
        sinks.export(t, "arp_summary", "scan-full", "pdf")


def test_archives_maps_and_trees(t):
    z = zipfile.ZipFile(io.BytesIO(sinks.export(t, "config_archive", "scan-full", "zip")))
    assert z.namelist() == ["SW1.txt"] and z.read("SW1.txt") == b"hostname SW1\n"
    z = zipfile.ZipFile(io.BytesIO(sinks.config_archive(t, "scan-full", "{}")))
    assert z.namelist() == ["inventory.json", "configs/SW1.txt"]
    page = sinks.export(t, "topology_map", "scan-l2", "html").decode()
    assert '"id":"LAB-CORE"' in page and '"is_seed":true' in page and page.count('"source":') == 1
    ET.fromstring(sinks.export(t, "topology_map", "scan-l2", "svg"))
    links = [{"local_device": "a", "remote_device": "b", "local_intf": "1", "remote_intf": "2", "remote_ip": "10.0.0.2", "protocols": ["CDP"]}]
    assert sinks.tree({"a": "10.0.0.1", "b": ""}, links, "a") == "a (10.0.0.1)\n   └─[CDP] 1 ↔ 2 (10.0.0.2)\n      b"
    near = [{"local_device": a, "remote_device": b, "local_intf": a, "remote_intf": b} for a, b in ("ab", "ac", "bd")]
    assert sinks.tree(dict.fromkeys("abcd", ""), near) == "a\n   ├─ a ↔ b\n   │  b\n   │  │  └─ b ↔ d\n   │  │     d\n   └─ a ↔ c\n      c"
    assert sinks.tree({}, []) == "No devices discovered"


def test_tables_of_sheets(t, spark, tmp_path):
    sinks.write_sheets(t, str(tmp_path), "arp_summary")
    assert spark.read.parquet(f"{tmp_path}/arp_summary/summary").count() == 2
    for kind, start in (("json", '{"Device":'), ("csv", "SW1,"), ("xml", '<row><field name="Device">')):
        sinks.write_sheets(t, f"{tmp_path}/{kind}", "arp_summary", kind)
        rows = spark.read.text(f"{tmp_path}/{kind}/arp_summary/summary").collect()
        assert len(rows) == 2 and all(r["value"].startswith(start) for r in rows), rows


def test_drawing_of_a_network(t):
    svg = ET.fromstring(sinks.export(t, "topology_map", "scan-l2", "svg"))
    tags = [e.tag.split("}")[1] for e in svg]
    n = t["devices"].where("scan_id = 'scan-l2'").count()
    assert tags.count("g") >= n and tags.count("path") == 1 and tags.index("path") < tags.index("g")


def test_merged_neighbors(spark):
    cdp = spark.createDataFrame([("s", "h", 0, "a", None, "P", "Gi0/1"), ("s", "h", 1, "a", None, "P2", "Gi0/9"), ("s", "h", 2, "b", "10.0.0.2", "Q", "Gi0/2")], "scan_id string, hostname string, item_ord int, remote_device string, remote_ip string, remote_platform string, local_intf string")
    lldp = spark.createDataFrame([("s", "h", 0, "a", "10.0.0.1", "mac", "x", "words"), ("s", "h", 1, "c", "10.0.0.3", "mac", "y", None)], "scan_id string, hostname string, item_ord int, remote_device string, remote_ip string, remote_platform string, local_intf string, system_description string")
    l3 = spark.createDataFrame([("s", "h", 0, "10.0.0.2", None, "OSPF"), ("s", "h", 1, "10.0.0.9", None, "BGP"), ("s", "h", 2, None, "r7", "IS-IS")], "scan_id string, hostname string, item_ord int, remote_ip string, remote_device string, protocol string")
    got = [(r["remote_device"], r["remote_ip"], r["remote_platform"], r["local_intf"], r["system_description"], r["protocols"]) for r in merging.merged(cdp, lldp, l3).orderBy("place").collect()]
    assert got == [
        ("a", "10.0.0.1", "P2", "Gi0/9", "words", ["CDP", "LLDP"]), ("b", "10.0.0.2", "Q", "Gi0/2", None, ["CDP", "OSPF"]), ("c", "10.0.0.3", "mac", "y", None, ["LLDP"]),
        (None, "10.0.0.9", None, None, None, ["BGP"]), ("r7", None, None, None, None, ["IS-IS"]),
    ]


def test_upserts_and_lookups(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("s", "h", 0, "10.0.0.1", None, "", None), ("s", "h", 1, "10.0.0.9", "cisco_ios", "switch", "P")], "scan_id string, hostname string, ord int, mgmt_ip string, device_type string, device_category string, platform string")
    r = scans.upserted(rows).first()
    assert (r["mgmt_ip"], r["device_type"], r["device_category"], r["platform"]) == ("10.0.0.1", "cisco_ios", "switch", "P")
    wanted = spark.createDataFrame([("s", "hw:A"), ("s", "hw:B")], "scan_id string, key string")
    cache = spark.createDataFrame([("s", "hw:A", "2026-01-08"), ("s", "hw:B", "2026-01-01")], "scan_id string, key string, fetched_at string")
    fresh, missing = scans.cached(wanted, cache, F.lit("2026-01-10").cast("date"))
    assert [r["key"] for r in fresh.collect()] == ["hw:A"] and [r["key"] for r in missing.collect()] == ["hw:B"]
    raw = spark.createDataFrame([("P", " x ", ({"value": " 2020-01-01 "}), {"MigrationProductId": "N"})], "EOLProductID string, ProductIDDescription string, EndOfSaleDate struct<value:string>, EOXMigrationDetails struct<MigrationProductId:string,MigrationProductName:string,MigrationStrategy:string>")
    r = scans.lifecycle_records(raw).first()
    assert (r["pid"], r["description"], r["end_of_sale"], r["last_date_of_support"], r["migration_pid"], r["migration_name"]) == ("P", "x", "2020-01-01", "", "N", "")


def test_progress_stream(spark, tmp_path):
    events = [{"scan_id": "a", "seq": 1, "event": "scan_started"}, {"scan_id": "a", "seq": 2, "event": "device_complete", "depth": 0}, {"scan_id": "a", "seq": 3, "event": "device_complete", "skipped": True, "depth": 1}, {"scan_id": "b", "seq": 1, "event": "device_failed"}]
    source = tmp_path / "events"
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, events)))
    progress.to_table(progress.event_stream(spark, str(source)), "live", str(tmp_path / "c1")).awaitTermination(120)
    got = lambda: {r["scan_id"]: (r["status"], r["done"], r["skipped"], r["failed"], r["depth"]) for r in spark.sql("select * from live").collect()}
    assert got() == {"a": ("running", 1, 1, 0, 1), "b": ("running", 0, 0, 1, None)}
    (source / "2.json").write_text(json.dumps({"scan_id": "a", "seq": 4, "event": "scan_complete"}))
    progress.to_table(progress.event_stream(spark, str(source)), "live", str(tmp_path / "c1")).awaitTermination(120)
    assert got()["a"][0] == "complete"
    sent = []
    progress.to_messages(progress.event_stream(spark, str(source)), lambda df, i: sent.extend(r["message"] for r in df.collect()), str(tmp_path / "c2")).awaitTermination(120)
    assert len(sent) == 5 and sent[0].startswith("event: scan_started\ndata: {") and sent[0].endswith("\n\n")


def raw_scan():
    """R1 has raw output alone, R2 parsed lists beside it, N1 the commands of another system."""
    only = lambda kind, **raw_: {"mgmt_ip": "10.0.0.1", "device_type": kind, "device_category": "router", "platform": "", "collector_data": {k: {"raw": v} for k, v in raw_.items()}}
    r1 = only(
        "cisco_ios", arp={"show ip arp": "Protocol  Address  Age (min)  Hardware Addr  Type  Interface\nInternet  10.0.0.7  5  aabb.cc00.0007  ARPA  Gi0/1\n"},
        cdp_lldp={"show cdp neighbors detail": "Device ID: R2.lab\n  IP address: 10.0.0.2\nPlatform: C1,  Capabilities: Router\nInterface: Gi0/1,  Port ID (outgoing port): Gi0/9\n", "show lldp neighbors detail": "", "show lldp neighbors": "Chassis id: x\nSystem Name: never\n"},
        l3_routing={"show ip ospf neighbor": "10.9.9.9  1  FULL/DR  00:00:35  10.0.0.2  Gi0/1\n", "show ip eigrp neighbors": "0  10.0.0.3  Gi0/2  12 00:01:02  5  100  0  9\n"},
        routing_detail={"show ip route summary": "Route Source    Networks    Subnets\nstatic          3           1\n", "show ip bgp summary": "203.0.113.1  4  65001  1  1  1  0  0  never  Active\n", "show ip ospf": ' Routing Process "ospf 1" with ID 10.255.0.1\n    Area 0\n'},
        vrf={"show ip vrf": "  Name   Default RD   Protocols  Interfaces\nMGMT   1:1   ipv4   Gi0/0\n", "show ip route vrf MGMT": "S  10.1.0.0/16 [1/0] via 10.0.0.2\n", "show ip arp vrf MGMT": "Internet  10.1.0.1  3  aabb.cc00.0001  ARPA  Gi0/0\n"},
        edge_services={"show access-lists": "Extended IP access list OUT\n    10 permit ip any any (4 matches)\n", "show ip nat statistics": "Total active translations: 7\n"},
        hsrp={"show standby brief": "Interface   Grp  Pri P State   Active   Standby   Virtual IP\nVl10        1    110 P Active  local    10.0.10.2 10.0.10.254\n"},
        switchport={"show interfaces switchport": "Name: Gi0/1\nAdministrative Mode: trunk\nTrunking Native Mode VLAN: 1 (default)\nTrunking VLANs Enabled: ALL\n"},
        config={"show running-config": "hostname R1\n"}, hollow={},
    )
    r2 = device(arp={"_raw": {"show ip arp": "Internet  10.0.0.8  5  aabb.cc00.0008  ARPA  Gi0/2\n"}, "entries": [{"ip": "10.0.0.9", "mac": "m", "interface": "Gi0/9", "age": "1"}]}, config={"_raw": {}, "config": ""})
    n1 = only("cisco_nxos", vrf={"show vrf": "RED   3   Up   --\n"}, hsrp={"show hsrp brief": None}, config={"show running-config": ""})
    return {"discovery_id": "scan-raw", "seed_ip": "10.0.0.1", "timestamp": "t", "params": {}, "devices": {"R1": r1, "R2": r2, "N1": n1}}


@pytest.fixture(scope="module", params=["plain", "stored"])
def from_raw(request, spark):
    texts = spark.createDataFrame([("scan-raw.json", json.dumps(raw_scan())), ("scan-l2.json", json.dumps(l2_scan()))], "filename string, text string")
    docs = scans.documents(texts)
    return raw.filled(scans.tables(docs, scans.stored(docs) if request.param == "stored" else None))


def listed(t, name, *columns, scan="scan-raw"):
    return [tuple(r) for r in t[name].where(f"scan_id = '{scan}'").orderBy("hostname", *(["item_ord"] if "item_ord" in t[name].columns else [])).select("hostname", *columns).collect()]


def test_lists_from_raw_output(from_raw):
    t = from_raw
    assert listed(t, "arp.entries", "ip", "interface", "age") == [("R1", "10.0.0.7", "Gi0/1", "5"), ("R2", "10.0.0.9", "Gi0/9", "1")]
    assert listed(t, "cdp_lldp.neighbors", "remote_device", "remote_ip", "local_intf", "remote_intf", "protocols") == [("R1", "R2", "10.0.0.2", "Gi0/1", "Gi0/9", ["CDP"])]
    assert listed(t, "l3_routing.neighbors", "remote_ip", "protocol", "state") == [("R1", "10.0.0.2", "OSPF", "FULL/DR"), ("R1", "10.0.0.3", "EIGRP", "UP")]
    assert listed(t, "routing_detail.route_summary", "source", "count") == [("R1", "static", "3")]
    assert listed(t, "routing_detail.bgp_summary", "neighbor", "asn", "state", "prefixes_received") == [("R1", "203.0.113.1", "65001", "Active", "0")]
    assert listed(t, "routing_detail.ospf_processes", "process_id", "router_id", "areas") == [("R1", "1", "10.255.0.1", ["0"])]
    assert listed(t, "vrf.vrfs", "name", "rd", "interfaces") == [("N1", "RED", "", []), ("R1", "MGMT", "1:1", ["Gi0/0"])]
    assert listed(t, "vrf.vrf_routes", "vrf", "network", "next_hop") == [("R1", "MGMT", "10.1.0.0/16", "10.0.0.2")]
    assert listed(t, "vrf.vrf_arp", "vrf", "ip_address") == [("R1", "MGMT", "10.1.0.1")]
    assert listed(t, "edge_services.access_lists", "name", "entries") == [("R1", "OUT", [("permit", "ip", "any", "any", 4)])]
    assert listed(t, "edge_services.nat_statistics", "active_translations", "hits") == [("R1", 7, 0)]
    assert listed(t, "hsrp.entries", "interface", "group", "state", "virtual_ip") == [("R1", "Vlan10", "1", "Active", "10.0.10.254")]
    assert listed(t, "switchport.switchports", "interface", "mode", "native_vlan", "allowed_vlans") == [("R1", "Gi0/1", "trunk", "1", "ALL")]
    assert listed(t, "config.config", "config") == [("R1", "hostname R1\n")]
    assert listed(t, "cdp_lldp.neighbors", "remote_device", scan="scan-l2") == [("LAB-CORE", "LAB-DIST"), ("LAB-DIST", "LAB-CORE")]
    has = {(r["hostname"], r["collector"]): r["has"] for r in t["parsed"].where("scan_id = 'scan-raw'").collect()}
    assert has["R1", "vrf"] and has["R2", "arp"] and not has["R1", "hollow"] and len(has) == 15


def test_sheets_from_raw_output(from_raw):
    assert sheet(from_raw, "internet_edge", "BGP Peers", "scan-raw")[0][0] == "R1"
    assert [r[0] for r in sheet(from_raw, "l2_discovery", "VLAN Documentation", "scan-l2")] == ["10", "20", "30"]


def test_configuration_of_patterns(spark, tmp_path):
    from fieldglass.operators import detection

    (tmp_path / "own.yaml").write_text('{"device_types": {"x": {"platforms": ["abc"]}}, "default_device_type": "y"}')
    (tmp_path / "broken.yaml").write_text("{a: [")
    (tmp_path / "words.yaml").write_text("words")
    own = detection.read_config(spark, str(tmp_path / "own.yaml"))
    assert [tuple(r) for r in detection.pattern_table(spark, own).collect()] == [("x", 0, "platform", "abc", 10.0)]
    for name in ("broken.yaml", "words.yaml", "missing.yaml"):
        assert detection.read_config(spark, str(tmp_path / name)) is detection.MINIMAL
    n = spark.createDataFrame([("ABC-1",), ("other",)], "remote_platform string").selectExpr("*", "'' AS remote_capabilities", "'' AS system_description")
    assert [r["device_type"] for r in detection.detected(n, detection.pattern_table(spark, own), own["default_device_type"]).collect()] == ["x", "y"]


def test_documents_in_parts_are_as_whole_ones(spark):
    """Parts of one device each, in any order; a document with one broken part is left out."""
    from fieldglass.sources import scans

    def device(i):
        return {"mgmt_ip": f"10.0.0.{i}", "collector_data": {"arp": {"parsed": {"entries": [{"address": f"10.1.{i}.{k}", "mac": "m"} for k in range(i)]}}}}

    head = {"discovery_id": "a", "seed_ip": "10.0.0.1", "timestamp": "t", "scan_summary": {"elapsed": 1.5}, "eox_cache": {"hw:x": {"fetched_at": "2026-01-01", "record": {"ldos": "y"}}}}
    names = [f"h{9 - i}" for i in range(5)]
    whole = [(f"{f}.json", json.dumps(head | {"discovery_id": f, "devices": {n: device(i) for i, n in enumerate(names)}})) for f in "ab"]
    parts = [(f"{f}.json", i, json.dumps((head if i == 0 else {}) | {"discovery_id": f, "devices": {n: device(i)}})) for f in "abc" for i, n in enumerate(names)]
    parts = [(f, i, "{" + x if f == "c.json" and i == 3 else x) for f, i, x in parts]
    one = scans.documents(spark.createDataFrame(whole, "filename string, text string"))
    many = scans.documents(spark.createDataFrame(parts[::-1], "filename string, place bigint, text string").repartition(4))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert scans.listing(many).collect() == scans.listing(one).collect() and same(scans.summaries(many), scans.summaries(one))
    assert [(r["filename"], r["ok"]) for r in scans.present_fields(many).orderBy("filename").collect()] == [("a.json", True), ("b.json", True), ("c.json", False)]
    got, want = scans.tables(many), scans.tables(one)
    assert got["arp.entries"].count() == 20
    for name in ("scans", "devices", "arp.entries", "eox_cache", "parsed"):
        assert same(got[name], want[name])


def test_no_row_of_the_queries_holds_a_scan(spark, sf_dir):
    from fieldglass.parsed_queries import _documents
    from fieldglass.queries import Scans

    docs = _documents(Scans(spark, sf_dir))
    most = docs.selectExpr("max(size(map_keys(doc.devices)))").first()[0]
    assert most == 1 and docs.where("doc is not null").count() > 100
