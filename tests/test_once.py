"""What is costly is done once: source rows are read once, texts are matched by one pattern for all fields."""

import pytest

from fieldglass.operators import neighbors as merging
from fieldglass.operators.order import numbered
from fieldglass.parsers import neighbors, switching
from fieldglass.plans import l2


@pytest.fixture
def counted(spark):
    """A frame, and how many of its rows have been made so far."""

    def make(rows, schema):
        seen = spark.sparkContext.accumulator(0)

        def count(parts):
            for part in parts:
                seen.add(part.num_rows)
                yield part

        df = spark.createDataFrame(rows, schema)
        return df.mapInArrow(count, df.schema), seen

    return make


def texts(spark, *t):
    return spark.createDataFrame([("s", f"h{i}", x) for i, x in enumerate(t)], "scan_id string, hostname string, text string")


def test_lldp_takes_fields_by_one_pattern(spark):
    text = "Chassis id: aa\r\n Port id:  Gi0/1 \nSystem Name: a.b\nSystem Description:\f one \x0b Time remaining: 9\n\ttwo \u0085 System Capabilities: B\nPort id:\n"
    df = neighbors.lldp(texts(spark, text))
    r = df.collect()[0]
    assert (r["remote_device"], r["remote_platform"], r["remote_intf"], r["remote_capabilities"], r["system_description"]) == ("a", "aa", "", "B", "two")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 4


def test_cdp_reads_lines_of_fields_only(spark):
    text = "Device ID: a.b\n x IP address: 10.0.0.1\nIPv4 Address: (none)\nPlatform: p, Capabilities: R\nInterface: Gi0/1, Port ID (out): Te1\r\nPlatform: q\n"
    df = neighbors.cdp(texts(spark, text))
    r = df.collect()[0]
    assert (r["remote_device"], r["remote_ip"], r["remote_platform"], r["remote_capabilities"], r["local_intf"], r["remote_intf"]) == ("a", "10.0.0.1", "q", "R", "Gi0/1", "Te1")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(block") == 1


def test_roots_and_names_are_read_once(spark, counted):
    roots, seen_roots = counted([("s", "h1", 1, 1, "VLAN0010", "aa", "32768", "0"), ("s", "h2", 2, 2, "10", "bb", "4096", "4")], "scan_id string, hostname string, device_ord int, item_ord int, vlan_id string, root_address string, root_priority string, root_cost string")
    names, seen_names = counted([("s", "h1", 1, 1, "10", "users"), ("s", "h2", 2, 2, "10", "lab")], "scan_id string, hostname string, device_ord int, item_ord int, vlan_id string, name string")
    rows = l2.vlans({"stp_vlan.spanning_tree_root": roots, "stp_vlan.vlans": names}).collect()
    assert [(r["vlan_id"], r["root_mac"], r["n_roots"], r["owner"], r["switches"], r["groups"]) for r in rows] == [("10", "aa", 2, "h1", ["h1", "h2"], 2)]
    assert (seen_roots.value, seen_names.value) == (2, 2)


def test_neighbors_are_merged_from_rows_read_once(spark, counted):
    schema = "scan_id string, hostname string, item_ord int, remote_device string, remote_ip string, protocol string"
    cdp, seen_cdp = counted([("s", "h", 1, "a", "10.0.0.1", None)], schema)
    lldp, seen_lldp = counted([("s", "h", 2, "b", "10.0.0.2", None)], schema)
    l3, seen_l3 = counted([("s", "h", 3, None, "10.0.0.2", "OSPF"), ("s", "h", 4, None, "10.0.0.3", "BGP")], schema)
    rows = merging.merged(cdp.drop("protocol"), lldp.drop("protocol"), l3).orderBy("place").collect()
    assert [(r["remote_device"], r["remote_ip"], r["protocols"]) for r in rows] == [("a", "10.0.0.1", ["CDP"]), ("b", "10.0.0.2", ["LLDP", "OSPF"]), (None, "10.0.0.3", ["BGP"])]
    assert (seen_cdp.value, seen_lldp.value, seen_l3.value) == (1, 1, 2)


def test_rows_to_number_are_made_once(spark, counted):
    df, seen = counted([("s", i) for i in range(50)], "scope string, o int")
    rows = numbered(df, ["scope"], ["o"], rows=10).collect()
    assert sorted((r["o"], r["at"]) for r in rows) == [(i, i) for i in range(50)]
    assert seen.value == 50


def test_ports_of_spanning_tree_are_not_split_by_a_pattern_a_block(spark):
    df = switching.stp_detail(texts(spark, "VLAN0010 is executing x\nNumber of topology changes 3\n Port 1 (Gi0/1, a) of VLAN0010 is root forwarding\n  Port path cost 4\nPort 2 (Gi0/2) of VLAN0010 is alternate blocking"))
    assert [(r["vlan"], r["interface"], r["role"], r["state"], r["cost"], r["topology_changes"]) for r in df.orderBy("item_ord").collect()] == [(10, "Gi0/1", "root", "forwarding", 4, 3), (10, "Gi0/2", "alternate", "blocking", 0, 3)]
    assert "split(block" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_arp_cuts_tokens_once_a_line(spark):
    text = "IP ARP Table\r\n \t*\t10.1.1.3  00:00:20 \t 0050.56aa.bb03  Eth1/1\t\x0bInternet 10.1.1.1 - 0050.56aa.bb01 ARPA\u0085 \n00:50:56:aa:bb:cc 10.1.1.4 a\u00a0b ge-0/0/1.0\nInternet 10.1.1.256 1 x ARPA y\n10.1.1.5"
    df = neighbors.arp(texts(spark, text, "", None))
    assert [(r["item_ord"], r["ip"], r["mac"], r["age"], r["interface"]) for r in df.orderBy("item_ord").collect()] == [
        (1, "10.1.1.3", "00:50:56:aa:bb:03", "00:00:20", "Eth1/1"),
        (2, "10.1.1.1", "00:50:56:aa:bb:01", "0", ""),
        (4, "10.1.1.4", "00:50:56:aa:bb:cc", "?", "ge-0/0/1.0"),
    ]
    # Lines are cut, and tokens are; no filter or layout cuts them again.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3


def test_blocked_ports_are_looked_up_by_few_patterns(spark):
    blocked = texts(spark, "Name  Blocked Interfaces List\r\n---- ----\r\n\tVLAN0010\t Gi0/2, Po50,,Gi0/9 \r\nVLAN0020 ,\x0bVLAN0000 Gi0/1\u0085Number of blocked Ports (segments) : 2\nVLAN0030", None)
    full = texts(spark, "Po50 Desg FWD 1 2.3 P2p *Early\nVLAN0010 \r\n  Spanning tree\r\n\tPo50 \t Altn BLK 1 2.3 P2p *Old\r\nGi0/2 Desg FWD 4 128.1\nPo50 Desg BKN*1 128 4.5 (vPC)  P2p *BA_Inc \t\nGi0/9 Mstr BLK 1 2 Shr\x0b VLAN0000\n Gi0/1 Root FWD 1 2 P2p", "")
    df = switching.blocked_ports(blocked, full)
    assert [(r["vlan_id"], r["interface"], r["status"], r["role"], r["reason"]) for r in df.orderBy("item_ord").collect()] == [
        ("10", "Gi0/2", "BLK", "", ""), ("10", "Po50", "BKN*1", "Desg", "BA_Inc"), ("10", "Gi0/9", "BLK", "Mstr", ""), ("0", "Gi0/1", "FWD", "Root", ""),
    ]
    states = switching.port_states(full)
    assert {(r["vlan_id"], r["interface"]): r["stp_type"] for r in states.collect()} == {("10", "Po50"): "(vPC)  P2p *BA_Inc", ("10", "Gi0/9"): "Shr", ("0", "Gi0/1"): "P2p"}
    # No filter takes a line's blanks off again for each of its conditions.
    assert "RLIKE(regexp_replace(" not in df._jdf.queryExecution().optimizedPlan().toString()
