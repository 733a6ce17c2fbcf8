"""The edge: peers, address translation, access lists, gateways; findings R14 to R17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined, present, yes_no
from .flat import HOST, Tables, place
from .l2 import SEVERITIES, _finding, metrics, severities
from .l3 import _head, _or_mark, _seq, _together, finding_bgp, finding_gateway

#: Use of an address pool, in percent, above which it is too high.
HIGH_USE = 80


def bgp_peers(t: Tables) -> DataFrame:
    return t["routing_detail.bgp_summary"].select(*_head(), present("neighbor").alias("neighbor"), present("asn").alias("asn"), present("state").alias("state"), present(F.col("prefixes_received").cast("string")).alias("prefixes_rcvd"), present("up_down").alias("uptime"), place("hostname", "item_ord"))


def nat_overview(t: Tables) -> DataFrame:
    """A row for each pool; one without a pool where no list of pools was given."""
    blank = F.array(F.struct(F.lit(None).cast("string").alias("name"), *[F.lit(None).cast("bigint").alias(c) for c in ("total_addresses", "allocated", "utilization_pct")]))
    n = t["edge_services.nat_statistics"].select("*", F.posexplode(F.coalesce("pools", blank)).alias("item_ord", "p"))
    text = lambda c: present(F.col(c).cast("string"))
    return n.select(
        *_head(), joined(F.col("inside_interfaces")).alias("inside_intfs"), joined(F.col("outside_interfaces")).alias("outside_intfs"), text("active_translations").alias("active_translations"), text("peak_translations").alias("peak"),
        text("p.name").alias("pool_name"), text("p.total_addresses").alias("total_addrs"), text("p.allocated").alias("allocated"), text("p.utilization_pct").alias("util_pct"), place("hostname", "item_ord"),
    )


def _permits_all(e: Column) -> Column:
    is_ = lambda c, v: F.lower(F.coalesce(e[c], F.lit(""))) == v
    return is_("action", "permit") & is_("protocol", "ip") & is_("source", "any") & is_("destination", "any")


def _no_hits(e: Column) -> Column:
    return F.coalesce(e["hit_count"], F.lit(0).cast("bigint")) == 0


def acl_audit(t: Tables) -> DataFrame:
    a = t["edge_services.access_lists"].withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<action:string,protocol:string,source:string,destination:string,hit_count:bigint>>")))
    return a.select(*_head(), present("name").alias("acl_name"), present("type").alias("type"), F.size("entries").cast("bigint").alias("rule_count"), F.size(F.filter("entries", _no_hits)).cast("bigint").alias("zero_hit_rules"), yes_no(F.exists("entries", _permits_all)).alias("has_permit_any"), place("hostname", "item_ord"))


def edge_interfaces(t: Tables) -> DataFrame:
    flag = lambda c: yes_no(F.lower(F.col(c).cast("string")) == "true").alias(c)
    return t["edge_services.ip_interfaces"].select(*_head(), present("interface").alias("interface"), present("ip_address").alias("ip"), present("acl_in").alias("acl_in"), present("acl_out").alias("acl_out"), flag("proxy_arp"), flag("urpf"), place("hostname", "item_ord"))


def finding_single(t: Tables) -> DataFrame:
    b = t["routing_detail.bgp_summary"].groupBy(*HOST).agg(F.count("*").alias("n"), F.min_by(F.struct("neighbor", "asn"), "item_ord").alias("b")).where("n = 1")
    mark = lambda c: F.coalesce(F.col(c), F.lit("?"))
    return _finding(b, 15, _seq("hostname"), F.col("hostname"), F.lit("Single-homed BGP"), F.concat(F.lit("Only 1 BGP peer ("), mark("b.neighbor"), F.lit(" AS "), mark("b.asn"), F.lit(") -- no redundancy")), F.lit("Warning"))


def finding_pools(t: Tables) -> DataFrame:
    n = t["edge_services.nat_statistics"].select(*HOST, F.posexplode("pools").alias("item_ord", "p")).where(F.col("p.utilization_pct") > HIGH_USE)
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    text = F.concat(F.lit("Pool '"), mark("p.name"), F.lit("' at "), mark("p.utilization_pct"), F.lit("% ("), mark("p.allocated"), F.lit("/"), mark("p.total_addresses"), F.lit(")"))
    return _finding(n, 16, _seq("hostname", "item_ord"), F.col("hostname"), F.lit("NAT pool high utilization"), text, F.lit("Warning"))


def finding_lists(t: Tables) -> DataFrame:
    """Lists that no packet has met, and rules that let everything through."""
    a = t["edge_services.access_lists"].where(F.size("entries") > 0).withColumn("_at", F.lit(0))
    dead = _finding(a.where(F.forall("entries", _no_hits)), 17, _seq("hostname", "item_ord", "_at"), F.col("hostname"), F.lit("Dead ACL (all zero hits)"), F.concat(F.lit("ACL '"), _or_mark("name"), F.lit("' has "), F.size("entries").cast("string"), F.lit(" rules, all with zero hits")), F.lit("Info"))
    each = a.drop("_at").select(*HOST, "item_ord", "name", F.posexplode("entries").alias("_p", "e")).where(_permits_all(F.col("e"))).withColumn("_at", F.col("_p") + 1)
    open_ = _finding(each, 17, _seq("hostname", "item_ord", "_at"), F.col("hostname"), F.lit("ACL permit ip any any"), F.concat(F.lit("ACL '"), _or_mark("name"), F.lit("' contains permit ip any any")), F.lit("Warning"))
    return dead.unionByName(open_)


def findings(t: Tables) -> DataFrame:
    return _together(t, [lambda x: finding_bgp(x, 14), finding_single, finding_pools, finding_lists, lambda x: finding_gateway(x, 18)], [])


def summary(t: Tables) -> DataFrame:
    d = t["devices"].groupBy("scan_id").agg(F.count("*").alias("devices"))
    b, n = t["routing_detail.bgp_summary"], t["edge_services.nat_statistics"]
    edge = b.select(*HOST).unionByName(n.select(*HOST)).unionByName(t["edge_services.access_lists"].select(*HOST)).distinct().groupBy("scan_id").agg(F.count("*").alias("edge"))
    row = d.join(edge, "scan_id", "left").join(b.groupBy("scan_id").agg(F.count("*").alias("peers")), "scan_id", "left").join(n.groupBy("scan_id").agg(F.sum("active_translations").alias("active")), "scan_id", "left").join(severities(findings(t)), "scan_id", "left")
    return metrics(row, [("Total Devices", "devices"), ("Edge Devices", "edge"), ("BGP Peers", "peers"), ("Active NAT Translations", "active"), *SEVERITIES])
