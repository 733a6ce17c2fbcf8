"""Routing: sheets, and findings R6 to R13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network as net
from ..functions.text import joined, present, whole, whole_or_zero
from ..operators.graph import shared_table
from ..operators.overlap import around, beside, overlapping, rooted
from ..operators.rows import first_rows, looked_up
from ..sources.scans import interface_addresses
from .flat import HOST, Tables, interface_notes, place
from .l2 import SEVERITIES, _finding, metrics, severities

# Masks of a single host, states in which a gateway is at rest, host routes that are too many, and how far costs may differ.
HOST_MASKS, RESTING, MANY_HOST_ROUTES, COST_RATIO = ["32", "255.255.255.255", "/32"], ["active", "standby", "listen"], 20, 100


def _head() -> list[Column]:
    return [F.col("scan_id"), F.col("hostname").alias("device"), net.site(F.col("hostname")).alias("site")]


def addresses(t: Tables) -> DataFrame:
    """Addresses of interfaces with their networks (lo, prefix), in order of host and record."""
    a = interface_addresses(t["interfaces.ip_interfaces_full"]).withColumnRenamed("prefix", "prefix_text")
    # The number and the prefix are columns of their own first, so that each is read from its text once.
    a = a.withColumn("_n", net.ipv4(F.col("ip"))).withColumn("_p", whole(F.col("prefix_text")))
    a = a.withColumn("lo", F.when(F.col("_p").between(0, 32), F.col("_n") - F.pmod("_n", net.span(F.col("_p"))))).withColumn("prefix", F.when(F.col("lo").isNotNull(), F.col("_p").cast("int")))
    both = F.when(F.col("lo").isNotNull(), F.struct("lo", "prefix"))
    return a.select(*HOST, "item_ord", "ip_ord", "interface", "ip", "prefix_text", "secondary", net.cidr(F.col("ip"), F.col("prefix_text")).alias("cidr"), both.alias("net"), "lo", "prefix")


def protocol_neighbors(t: Tables) -> DataFrame:
    return t["l3_routing.neighbors"].select(*_head(), joined(F.col("protocols")).alias("protocol"), present("remote_ip").alias("neighbor_ip"), present("remote_device").alias("neighbor_device"), present("state").alias("state"), place("hostname", "item_ord"))


def routes(t: Tables) -> DataFrame:
    return t["l3_routing.routes"].select(*_head(), *[present(c).alias(c) for c in ("network", "mask", "next_hop", "interface", "protocol", "metric")], place("hostname", "item_ord"))


def routed_interfaces(t: Tables) -> DataFrame:
    a = addresses(t).where(net.svi(F.col("interface")).isNull())
    a = interface_notes(a, t)
    return a.select(*_head(), "interface", F.col("cidr").alias("ip_cidr"), F.coalesce(F.nullif("description", F.lit("")), "neighbor").alias("description"), net.role_note(F.col("interface"), F.col("secondary")).alias("notes"), place("hostname", "interface", "item_ord", "ip_ord"))


# Kinds of route sources, in the order in which they are looked for.
SOURCES = ["connected", "static", "ospf", "eigrp", "bgp"]


def route_summary(t: Tables) -> DataFrame:
    source, count = F.lower(present(F.col("source").cast("string"))), whole_or_zero(F.col("count"))
    kind = F.lit("other")
    for s in reversed(SOURCES):
        kind = F.when(F.contains(source, F.lit(s)), s).otherwise(kind)
    rows = t["routing_detail.route_summary"].select(*HOST, kind.alias("kind"), count.alias("n"))
    sums = [F.sum(F.when(F.col("kind") == s, F.col("n")).otherwise(0)).alias(s) for s in [*SOURCES, "other"]]
    out = rows.groupBy(*HOST).agg(*sums, F.sum("n").alias("total"))
    return out.select(*_head(), *SOURCES, "other", "total", place("hostname"))


def ospf_topology(t: Tables) -> DataFrame:
    """Interfaces of OSPF with the first process of their device; devices without any show the areas of the process."""
    p = first_rows(t["routing_detail.ospf_processes"].select(*HOST, "item_ord", "process_id", "router_id", "areas"), HOST, ["item_ord"]).drop("item_ord")
    i = t["routing_detail.ospf_interfaces"].select(*HOST, "item_ord", *[present(c).alias(c) for c in ("area", "interface", "cost", "state", "neighbors")])
    own = i.join(p, HOST, "left")
    areas = p.join(i.select(*HOST).distinct(), HOST, "left_anti").select("*", F.posexplode("areas").alias("item_ord", "area")).select(*HOST, "item_ord", "area", *[F.lit("").alias(c) for c in ("interface", "cost", "state", "neighbors")], "process_id", "router_id", "areas")
    out = own.unionByName(areas)
    return out.select(*_head(), present("process_id").alias("process_id"), present("router_id").alias("router_id"), "area", "interface", "cost", "state", "neighbors", place("hostname", "item_ord"))


#: Interfaces of a network and all in it that a task lists; those of larger ones are listed by the networks above and below each.
TREE = 5_000


def address_audit(t: Tables) -> DataFrame:
    """All addresses with their networks, and with which interfaces of other devices they overlap."""
    at, network = ["hostname", "item_ord", "ip_ord"], ["scan_id", "lo", "prefix"]
    a = addresses(t).select("scan_id", *at, "interface", "cidr", "lo", "prefix")
    a = shared_table(a.withColumn("x", F.concat(F.lit("Overlaps "), "hostname", F.lit(" "), "interface")))
    roots = shared_table(rooted(a, ["scan_id"]))
    few = beside(a, roots.where(F.col("size") <= TREE), ["scan_id"], at, "x", "; ", "overlap")
    many = a.join(roots.where(F.col("size") > TREE).select(*network), network)
    many = many.join(around(many, ["scan_id"], [*at, "x"]), network, "left").withColumn("overlap", F.array_join(F.filter("around", lambda x: x["hostname"] != F.col("hostname"))["x"], "; "))
    out = few.unionByName(many.drop("around")).unionByName(a.where("lo is null").withColumn("overlap", F.lit("")))
    both = F.when(F.col("lo").isNotNull(), F.struct("lo", "prefix"))
    return out.select(*_head(), "interface", F.col("cidr").alias("ip_cidr"), net.network_text(both).alias("subnet"), present(net.svi(F.col("interface"))).alias("vlan"), present("overlap").alias("overlap"), place(*at))


def arp_mac_map(t: Tables) -> DataFrame:
    """ARP entries with the VLAN of their address in the same device's MAC table, where the last entry counts."""
    m = t["mac_table.entries"].select(*HOST, "item_ord", F.lower("mac").alias("_m"), present("vlan").alias("vlan")).where("_m <> ''")
    a = t["arp.entries"].select(*HOST, "item_ord", present("ip").alias("ip"), present("mac").alias("mac"), present("interface").alias("interface")).withColumn("_m", F.lower("mac"))
    out = looked_up(a, m, [*HOST, "_m"], ["item_ord"], "vlan", last=True)
    return out.select(*_head(), F.col("ip").alias("ip_address"), F.col("mac").alias("mac_address"), "interface", "vlan", net.oui(F.col("mac")).alias("vendor_oui"), place("hostname", "item_ord"))


def vrf_summary(t: Tables) -> DataFrame:
    n = F.coalesce(F.size("interfaces"), F.lit(0)).cast("bigint")
    return t["vrf.vrfs"].select(*_head(), present("name").alias("vrf_name"), present("rd").alias("rd"), joined(F.col("interfaces")).alias("interfaces"), F.greatest(n, F.lit(0).cast("bigint")).alias("interface_count"), place("hostname", "item_ord"))


def fhrp_status(t: Tables) -> DataFrame:
    return t["hsrp.entries"].select(*_head(), *[present(c).alias(c) for c in ("interface", "group", "priority", "state", "virtual_ip")], place("hostname", "item_ord"))


def _seq(*columns: str) -> Column:
    """A text that sorts findings: the host, then numbers of places."""
    numbers = [F.lpad(F.col(c).cast("string"), 18, "0") if c != "hostname" else F.col(c) for c in columns]
    return F.concat_ws("\x01", *numbers)


def _or_mark(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("?"))


def finding_ospf(t: Tables) -> DataFrame:
    low = F.lower(present("state"))
    n = t["l3_routing.neighbors"].where(F.array_contains("protocols", "ospf") & (low != "") & ~F.contains(low, F.lit("full")) & ~F.contains(low, F.lit("dr")))
    return _finding(n, 6, _seq("hostname", "item_ord"), F.col("hostname"), F.lit("OSPF neighbor not FULL"), F.concat(F.lit("Neighbor "), _or_mark("remote_ip"), F.lit(" state: "), "state"), F.lit("Critical"))


def finding_stub(t: Tables) -> DataFrame:
    n = t["routing_detail.eigrp_neighbors"].where(F.lower(present(F.col("stub").cast("string"))) == "true")
    return _finding(n, 7, _seq("hostname", "item_ord"), F.col("hostname"), F.lit("EIGRP stub peer"), F.concat(F.lit("Neighbor "), _or_mark("neighbor"), F.lit(" on "), _or_mark("interface"), F.lit(" is stub ("), F.coalesce("stub_flags", F.lit("unknown flags")), F.lit(")")), F.lit("Info"))


def finding_static(t: Tables) -> DataFrame:
    source, n = F.lower(present(F.col("source").cast("string"))), whole_or_zero(F.col("count"))
    dynamic = source.isin("ospf", "eigrp", "bgp", "isis") | F.contains(source, F.lit("ospf")) | F.contains(source, F.lit("eigrp"))
    static = (source == "static") & (n > 0)
    s = t["routing_detail.route_summary"].groupBy(*HOST).agg(F.max(dynamic & (n > 0)).alias("dynamic"), F.max_by(F.when(static, n), F.when(static, F.col("item_ord"))).alias("n"))
    s = s.where("dynamic and n is not null")
    return _finding(s, 8, _seq("hostname"), F.col("hostname"), F.lit("Static routes alongside dynamic protocol"), F.concat(F.col("n").cast("string"), F.lit(" static route(s) present despite dynamic routing protocol(s) -- potential oversight")), F.lit("Warning"))


def finding_host_routes(t: Tables) -> DataFrame:
    r = t["l3_routing.routes"].where(F.col("mask").isin(HOST_MASKS)).groupBy(*HOST).agg(F.count("*").alias("n")).where(F.col("n") > MANY_HOST_ROUTES)
    return _finding(r, 9, _seq("hostname"), F.col("hostname"), F.lit("Large number of /32 host routes"), F.concat(F.col("n").cast("string"), F.lit(" host routes detected -- possible redistribution leak")), F.lit("Warning"))


def finding_bgp(t: Tables, rule: int = 10) -> DataFrame:
    b = t["routing_detail.bgp_summary"].where((present("state") != "") & (F.col("state") != "Established"))
    return _finding(b, rule, _seq("hostname", "item_ord"), F.col("hostname"), F.lit("BGP peer not Established"), F.concat(F.lit("Neighbor "), _or_mark("neighbor"), F.lit(" AS "), _or_mark("asn"), F.lit(" state: "), "state"), F.lit("Critical"))


def finding_gateway(t: Tables, rule: int = 11) -> DataFrame:
    g = t["hsrp.entries"].where((present("state") != "") & ~F.lower("state").isin(RESTING))
    text = F.concat(F.lit("Interface "), _or_mark("interface"), F.lit(" group "), _or_mark("group"), F.lit(" VIP "), _or_mark("virtual_ip"), F.lit(" state: "), "state")
    return _finding(g, rule, _seq("hostname", "item_ord"), F.col("hostname"), F.lit("FHRP group in unexpected state"), text, F.lit("Warning"))


def finding_overlap(t: Tables) -> DataFrame:
    """Unequal networks of two devices that overlap, once for each pair of devices and addresses."""
    a = addresses(t).select("scan_id", "hostname", "cidr", "lo", "prefix", "item_ord", "ip_ord", "interface")
    # The first interface of each address of a device stands for the others before any pair is made.
    one = overlapping(shared_table(first_rows(a, ["scan_id", "hostname", "cidr", "lo", "prefix"], ["item_ord", "ip_ord"])), ["scan_id"])
    seq = F.concat_ws("\x01", "a_hostname", *[F.lpad(F.col(c).cast("string"), 18, "0") for c in ("a_item_ord", "a_ip_ord")], "b_hostname", *[F.lpad(F.col(c).cast("string"), 18, "0") for c in ("b_item_ord", "b_ip_ord")])
    text = F.concat("a_hostname", F.lit(" "), "a_interface", F.lit(" ("), "a_cidr", F.lit(") overlaps with "), "b_hostname", F.lit(" "), "b_interface", F.lit(" ("), "b_cidr", F.lit(")"))
    return _finding(one, 12, seq, F.col("a_hostname"), F.lit("Overlapping IP subnet"), text, F.lit("Critical"))


def finding_costs(t: Tables) -> DataFrame:
    o = t["routing_detail.ospf_interfaces"].select("scan_id", "hostname", "item_ord", present("area").alias("area"), whole(F.col("cost")).alias("cost")).where("cost is not null")
    a = o.groupBy("scan_id", "area").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"), F.count("*").alias("n"), F.min_by("hostname", F.struct("hostname", "item_ord")).alias("hostname"), F.min(F.struct("hostname", "item_ord")).alias("at"))
    a = a.where((F.col("n") >= 2) & (F.col("lo") > 0) & (F.col("hi") / F.col("lo") > COST_RATIO))
    seq = F.concat_ws("\x01", "at.hostname", F.lpad(F.col("at.item_ord").cast("string"), 18, "0"))
    return _finding(a, 13, seq, F.col("hostname"), F.concat(F.lit("Asymmetric OSPF costs in area "), "area"), F.format_string("Cost range %d-%d across %d interfaces in area %s", "lo", "hi", "n", "area"), F.lit("Warning"))


#: Findings of one device come together, in the order of these rules; those across devices follow.
DEVICE_RULES, NETWORK_RULES = [finding_ospf, finding_stub, finding_static, finding_host_routes, finding_bgp, finding_gateway], [finding_overlap, finding_costs]


def _together(t: Tables, own: list, across: list) -> DataFrame:
    out = None
    for part, rule in [(0, r) for r in own] + [(1, r) for r in across]:
        f = rule(t)
        host = F.when(F.lit(part) == 0, F.col("hostname")).otherwise("")
        f = f.withColumn("place", F.struct(F.lit(part).alias("part"), host.alias("host"), "rule", "seq"))
        out = f if out is None else out.unionByName(f)
    return out


def findings(t: Tables) -> DataFrame:
    return _together(t, DEVICE_RULES, NETWORK_RULES)


def findings_sheet(f: DataFrame) -> DataFrame:
    return f.select("scan_id", F.col("hostname").alias("device"), net.site(F.col("hostname")).alias("site"), F.coalesce("severity", F.lit("Info")).alias("severity"), F.col("title").alias("finding"), F.col("description").alias("details"), "place")


def summary(t: Tables) -> DataFrame:
    d = t["devices"].groupBy("scan_id").agg(F.count("*").alias("devices"))
    routed = t["l3_routing.neighbors"].select(*HOST).unionByName(t["l3_routing.routes"].select(*HOST)).unionByName(t["routing_detail.route_summary"].select(*HOST)).distinct().groupBy("scan_id").agg(F.count("*").alias("routed"))
    r = t["l3_routing.routes"].groupBy("scan_id").agg(F.count("*").alias("routes"))
    row = d.join(routed, "scan_id", "left").join(r, "scan_id", "left").join(severities(findings(t)), "scan_id", "left")
    return metrics(row, [("Total Devices", "devices"), ("Routed Devices", "routed"), ("Total Routes", "routes"), *SEVERITIES])
