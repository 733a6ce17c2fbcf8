"""VLANs, spanning tree and switch ports: sheets, and findings R1 to R5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as net
from ..functions.text import present, whole, whole_or_zero, yes_no
from ..operators.graph import shared_table
from ..operators.order import in_ranges, joined_pieces, pieces
from ..operators.rows import fallback, first_rows, last_values, listed, looked_up
from ..parsers import switching
from ..sources.scans import interface_addresses
from .flat import HOST, Tables, place

VLAN = ["scan_id", "vlan_id"]
FINDING = ["scan_id", "rule", "seq", "hostname", "severity", "title", "description"]


def root_records(t: Tables) -> DataFrame:
    r = t["stp_vlan.spanning_tree_root"].select("scan_id", "hostname", "device_ord", "item_ord", net.vlan_id(present("vlan_id")).alias("vlan_id"), present("root_address").alias("root_address"), present("root_priority").alias("root_priority"), present("root_cost").alias("root_cost"))
    return r.where("vlan_id <> '' and root_address <> ''")


def name_records(t: Tables) -> DataFrame:
    v = t["stp_vlan.vlans"].select("scan_id", "hostname", "device_ord", "item_ord", net.vlan_id(present("vlan_id")).alias("vlan_id"), present("name").alias("name"))
    return v.where("vlan_id <> ''")


def roots(t: Tables) -> DataFrame:
    """The last root record of each VLAN and device that names a root."""
    return last_values(root_records(t), ["scan_id", "vlan_id", "hostname"], ["device_ord", "item_ord"])


def names(t: Tables) -> DataFrame:
    """The last name of each VLAN and device."""
    return last_values(name_records(t), ["scan_id", "vlan_id", "hostname"], ["device_ord", "item_ord"])


def vlan_place():
    return F.struct(net.vlan_order(F.col("vlan_id")).alias("o"), "vlan_id").alias("place")


def vlan_places(t: Tables) -> DataFrame:
    """The VLANs that `vlan_documentation` has a row for, each with its place there and nothing else: none of its texts is made."""
    return root_records(t).select(*VLAN).unionByName(name_records(t).select(*VLAN)).distinct().select(*VLAN, vlan_place())


def blocked(t: Tables) -> DataFrame:
    """Blocked ports; where a device has none parsed, those of its raw output."""
    b = t["stp_vlan.blocked_ports"].select(*HOST, "device_ord", "item_ord", net.vlan_id(present("vlan_id")).alias("vlan_id"), present("interface").alias("interface"), F.coalesce("status", F.lit("BLK")).alias("status"), present("role").alias("role"), present("reason").alias("reason"))
    if "raw_outputs" not in t:
        return b
    raw = t["raw_outputs"].where("collector = 'stp_vlan'")
    of = lambda command: raw.where(F.col("command") == command).select(*HOST, "device_ord", "text")
    return fallback(b, switching.blocked_ports(of("show spanning-tree blockedports"), of("show spanning-tree")).drop("name"), HOST)


def stored(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Roots and names, which are read several times, each made once."""
    return shared_table(roots(t)), shared_table(names(t))


def owners(r: DataFrame) -> DataFrame:
    """(scan_id, mac, owner) from roots: the first device that is its own root (cost 0), by VLAN as first seen, then device."""
    seen = r.groupBy(*VLAN).agg(F.min(F.struct("device_ord", "item_ord")).alias("vlan_ord"))
    own = r.where("root_cost = '0'").join(seen, VLAN)
    return own.groupBy("scan_id", F.col("root_address").alias("mac")).agg(F.min_by("hostname", F.struct("vlan_ord", "device_ord")).alias("owner"), F.min(F.struct("vlan_ord", "device_ord")).alias("claim"))


def vlans(t: Tables, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a VLAN: majority root (most devices, the first seen of equals), its device and priority, best name, devices, whether all agree, name groups."""
    r, n = kept or stored(t)
    by_root = r.groupBy(*VLAN, "root_address").agg(F.count("*").alias("n"), F.min("device_ord").alias("first"), F.min_by("root_priority", "device_ord").alias("root_priority"), F.array_sort(F.collect_set("hostname")).alias("on"))
    top = by_root.groupBy(*VLAN).agg(
        F.max_by(F.struct("root_address", "root_priority"), F.struct("n", -F.col("first"))).alias("top"), F.count("*").alias("n_roots"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat("root_address", F.lit(" on "), F.array_join("on", ", ")).alias("x")))), lambda s: s["x"]), "; ").alias("bridges"),
    )
    order = F.struct(net.default_name(F.col("name")).alias("d"), F.col("device_ord").alias("o"))
    named = n.groupBy(*VLAN).agg(F.min_by("name", order).alias("best_name"), F.array_sort(F.collect_set("name")).alias("names"))
    varied = n.groupBy(*VLAN, "name").agg(F.array_sort(F.collect_set("hostname")).alias("on"))
    varied = listed(varied, VLAN, ["name"], F.concat(F.lit('"'), F.col("name"), F.lit('" on '), F.array_join("on", ", ")), "; ", "varied")
    switches = r.select(*VLAN, "hostname").unionByName(n.select(*VLAN, "hostname")).groupBy(*VLAN).agg(F.array_sort(F.collect_set("hostname")).alias("switches"))
    out = switches.join(top, VLAN, "left").join(named, VLAN, "left").join(varied, VLAN, "left")
    out = out.select(*VLAN, "switches", F.col("top.root_address").alias("root_mac"), present(F.col("top.root_priority")).alias("root_priority"), F.coalesce("n_roots", F.lit(0)).alias("n_roots"), present("bridges").alias("bridges"), present("best_name").alias("best_name"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), present("varied").alias("varied"))
    out = out.join(owners(r).select("scan_id", F.col("mac").alias("root_mac"), "owner"), ["scan_id", "root_mac"], "left")
    return out.withColumn("root_mac", present("root_mac")).withColumn("owner", present("owner")).withColumn("groups", F.size(net.name_groups(F.col("names"))))


def svi_addresses(t: Tables) -> DataFrame:
    a = interface_addresses(t["interfaces.ip_interfaces_full"])
    return a.withColumn("vlan_id", net.svi(F.col("interface"))).where("vlan_id is not null")


#: Rows of a range of which the documentation makes pieces of texts.
PIECES = 2_000


def vlan_documentation(t: Tables) -> DataFrame:
    """One row a VLAN. Its lists grow with the devices: they are made in pieces, which only the last step joins, so that no task lists the records of a VLAN, and no row with whole texts is joined or sorted."""
    kept = stored(t)
    on = kept[0].select(*VLAN, "hostname").unionByName(kept[1].select(*VLAN, "hostname")).distinct().where("hostname is not null")
    sites = on.select(*VLAN, net.site(F.col("hostname")).alias("s")).where("s <> ''").distinct().groupBy(*VLAN).agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("site"))
    in_pieces = lambda df, order, value: pieces(in_ranges(df, ["scan_id"], order, PIECES), VLAN, order, value, "; ")
    seen = pieces(in_ranges(on, ["scan_id"], ["hostname"], PIECES), VLAN, ["hostname"], F.col("hostname"), ", ")
    svi = svi_addresses(t).select(*VLAN, "hostname", "item_ord", "ip_ord", F.concat("hostname", F.lit(": "), net.cidr(F.col("ip"), F.col("prefix")), F.when(F.col("secondary"), " (secondary)").otherwise("")).alias("x"))
    svi = in_pieces(svi, ["hostname", "item_ord", "ip_ord"], F.col("x"))
    g = t["hsrp.entries"].withColumn("vlan_id", net.svi(F.col("interface"))).where("vlan_id is not null")
    detail = F.concat_ws(", ", F.nullif(present("state"), F.lit("")), F.when(present("priority") != "", F.concat(F.lit("pri "), "priority")))
    g = g.select(*VLAN, "hostname", "item_ord", F.concat("hostname", F.lit(": "), present("virtual_ip"), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise("")).alias("x"))
    g = in_pieces(g, ["hostname", "item_ord"], F.col("x"))
    # A blocked port is shown under each of its VLANs with all of them. Ports are put in order before they are repeated for each VLAN.
    ports = blocked(t).groupBy(*HOST, "interface").agg(F.array_sort(F.collect_set(F.struct(net.vlan_order(F.col("vlan_id")).alias("o"), "vlan_id"))).alias("_v"))
    ports = in_ranges(ports, ["scan_id"], ["hostname", "interface"], PIECES).withColumn("all", F.array_join(F.transform("_v", lambda x: x["vlan_id"]), ", ")).withColumn("vlan_id", F.explode(F.transform("_v", lambda x: x["vlan_id"])))
    ports = pieces(ports, VLAN, ["hostname", "interface"], F.concat("hostname", F.lit("-"), "interface", F.lit(" BLK on VLANs "), "all"), "; ")
    v = vlans(t, kept).join(sites, VLAN, "left").select(*VLAN, F.struct("site", "best_name", "owner", "root_mac", "root_priority", "n_roots").alias("_r"))
    parts = v
    for i, texts in enumerate((seen, svi, g, ports)):
        parts = parts.unionByName(texts.withColumn("kind", F.lit(i)), allowMissingColumns=True)
    whole_ = lambda i, separator, name: present(joined_pieces(F.col("kind") == i, separator)).alias(name)
    out = parts.groupBy(*VLAN).agg(F.first("_r", ignorenulls=True).alias("_r"), whole_(0, ", ", "seen_on"), whole_(1, "; ", "svi_ip_cidr"), whole_(2, "; ", "hsrp_vip"), whole_(3, "; ", "blocked_ports")).where("_r is not null")
    r = lambda c: F.col(f"_r.{c}")
    return out.select(
        "scan_id", "vlan_id", present(r("site")).alias("site"), r("best_name").alias("vlan_name"), "seen_on", F.when(r("owner") != "", r("owner")).otherwise(r("root_mac")).alias("stp_root_bridge"), r("root_priority").alias("root_priority"),
        "svi_ip_cidr", "hsrp_vip", "blocked_ports", F.when(r("n_roots") > 1, "STP root mismatch -- see Findings").otherwise("").alias("notes"), vlan_place(),
    )


def _finding(df: DataFrame, rule: int, seq, host, title, description, severity=None) -> DataFrame:
    return df.select("scan_id", F.lit(rule).alias("rule"), seq.alias("seq"), host.alias("hostname"), (severity if severity is not None else F.lit(None).cast("string")).alias("severity"), title.alias("title"), description.alias("description"))


def _by_vlan():
    return F.concat(F.lpad(net.vlan_order(F.col("vlan_id")).cast("string"), 18, "0"), F.lit(":"), F.col("vlan_id"))


def finding_blocked(t: Tables) -> DataFrame:
    b = blocked(t).groupBy(*HOST, "interface").agg(F.array_sort(F.collect_set(F.struct(net.vlan_order(F.col("vlan_id")).alias("o"), "vlan_id"))).alias("v"), F.array_sort(F.collect_set("status")).alias("s"), F.array_sort(F.collect_set(F.nullif("reason", F.lit("")))).alias("r"))
    reasons = F.when(F.size("r") > 0, F.concat(F.lit(" ("), F.array_join("r", ", "), F.lit(")"))).otherwise("")
    status = F.concat(F.array_join("s", "/"), reasons)
    listed_ = F.array_join(F.transform("v", lambda x: x["vlan_id"]), ", ")
    return _finding(b, 1, F.concat_ws("\x01", "hostname", "interface"), F.col("hostname"), F.concat("interface", F.lit(" -- "), status), F.concat("interface", F.lit(" is "), status, F.lit(". Affects VLANs: "), listed_, F.lit(".")))


def large_subnets(t: Tables) -> DataFrame:
    """The first prefix below 20 of a VLAN, with all addresses of that prefix."""
    a = svi_addresses(t).withColumn("wide", whole(F.col("prefix"))).where("wide < 20")
    first = first_rows(a.select(*VLAN, "prefix", "wide", "device_ord", "item_ord", "ip_ord"), VLAN, ["device_ord", "item_ord", "ip_ord"]).drop("device_ord", "item_ord", "ip_ord")
    same = svi_addresses(t).join(first, [*VLAN, "prefix"])
    item = F.struct("device_ord", "item_ord", "ip_ord", F.concat("hostname", F.lit(": "), "ip", F.lit("/"), "prefix").alias("x"))
    return same.groupBy(*VLAN).agg(F.min("wide").alias("wide"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]), ", ").alias("every"))


def finding_vlans(t: Tables, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """R2 to R5, all from one row a VLAN, which is computed once: default priority, roots that differ, a large subnet, names that differ."""
    v = vlans(t, kept).join(large_subnets(t), VLAN, "full").withColumn("p", whole(F.col("root_priority"))).withColumn("k", net.vlan_order(F.col("vlan_id")))
    host = F.coalesce(F.nullif("owner", F.lit("")), F.nullif("root_mac", F.lit("")), F.lit("unknown"))
    named = F.when(present("best_name") != "", F.concat(F.lit(" ("), "best_name", F.lit(")"))).otherwise("")
    rules = [
        (2, (F.col("p") == 32768) | (F.col("p") == F.col("k") + 32768), host, F.format_string("VLAN %s -- default STP priority", "vlan_id"), F.format_string("Root priority %d (32768+%d, untuned). Root election is arbitrary.", "p", "k")),
        (3, F.col("n_roots") > 1, F.lit(""), F.format_string("VLAN %s -- STP root bridge mismatch", "vlan_id"), F.concat(F.lit("Multiple root bridges detected: "), "bridges", F.lit("."))),
        (4, F.col("wide").isNotNull(), F.lit(""), F.concat(F.lit("VLAN "), "vlan_id", named, F.lit(" -- /"), F.col("wide").cast("string"), F.lit(" subnet")), F.concat(F.lit("Large subnet (/"), F.col("wide").cast("string"), F.lit("): "), "every", F.lit(". Verify intent."))),
        (5, F.col("groups") > 1, F.lit(""), F.format_string("VLAN %s -- name discrepancy", "vlan_id"), F.concat(F.lit("Different names: "), "varied", F.lit("."))),
    ]
    found = F.array(*[F.when(when, F.struct(F.lit(rule).alias("rule"), host_.alias("hostname"), title.alias("title"), description.alias("description"))) for rule, when, host_, title, description in rules])
    rows = v.select("scan_id", _by_vlan().alias("seq"), F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return rows.select("scan_id", "f.rule", "seq", "f.hostname", F.lit(None).cast("string").alias("severity"), "f.title", "f.description")


# Words in a title that make a finding a warning.
WARNINGS = ["blk", "bkn", "default stp", "subnet", "bpdu", "storm", "trunk", "topology"]


def severity(title):
    low = F.lower(title)
    return F.when(F.contains(low, F.lit("mismatch")), "Critical").when(F.regexp_like(low, F.lit("|".join(WARNINGS))), "Warning").otherwise("Info")


def findings(t: Tables, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All findings, their severity by words of their titles, in order of rule and place."""
    out = finding_blocked(t).unionByName(finding_vlans(t, kept))
    return out.withColumn("severity", severity(F.col("title"))).withColumn("place", F.struct("rule", "seq"))


def findings_sheet(t: Tables) -> DataFrame:
    f = findings(t).select("scan_id", "hostname", net.site(F.col("hostname")).alias("site"), F.col("title").alias("port"), F.col("description").alias("notes"), "place")
    none = t["devices"].select("scan_id").distinct().join(f.select("scan_id").distinct(), "scan_id", "left_anti")
    none = none.select("scan_id", F.lit("No findings detected.").alias("hostname"), *[F.lit("").alias(c) for c in ("site", "port", "notes")], F.struct(F.lit(0).alias("rule"), F.lit("").alias("seq")).alias("place"))
    return f.unionByName(none)


def metrics(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Columns of one row a scan as (metric, value) rows."""
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("metric"), F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias("value")) for i, (label, c) in enumerate(pairs)])
    return df.select("scan_id", F.explode(rows).alias("m")).select("scan_id", "m.metric", "m.value", F.struct("m.place").alias("place"))


def severities(f: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return f.groupBy("scan_id").agg(count("Critical"), count("Warning"), count("Info"))


SEVERITIES = [("Critical Findings", "critical"), ("Warning Findings", "warning"), ("Info Findings", "info")]


def summary(t: Tables) -> DataFrame:
    d = t["devices"].groupBy("scan_id").agg(F.count("*").alias("devices"))
    kept = stored(t)
    v = kept[0].select(*VLAN).unionByName(kept[1].select(*VLAN)).distinct().groupBy("scan_id").agg(F.count("*").alias("vlans"))
    return metrics(d.join(v, "scan_id", "left").join(severities(findings(t, kept)), "scan_id", "left"), [("Device Count", "devices"), ("VLAN Count", "vlans"), *SEVERITIES])


def root_bridges(t: Tables) -> DataFrame:
    """The first address that a device claims."""
    o = owners(shared_table(roots(t))).groupBy("scan_id", F.col("owner").alias("hostname")).agg(F.min_by("mac", F.struct("claim", "mac")).alias("root_bridge_id"))
    return o.select("scan_id", "hostname", net.site(F.col("hostname")).alias("site"), "root_bridge_id", place("hostname"))


def stp_topology(t: Tables) -> DataFrame:
    """Ports of spanning tree; where a device has none parsed, those of its raw output."""
    columns = ["vlan", "interface", "role", "state", "cost"]
    s = t["stp_detail.stp_detail"].select(*HOST, "item_ord", *[present(F.col(c).cast("string")).alias(c) for c in columns], whole_or_zero(F.col("topology_changes")).alias("topology_changes"))
    if "raw_outputs" in t:
        raw = t["raw_outputs"].where("collector = 'stp_detail' and command = 'show spanning-tree detail'").select(*HOST, "text")
        s = fallback(s, switching.stp_detail(raw).select(*HOST, "item_ord", *[F.col(c).cast("string").alias(c) for c in columns], "topology_changes"), HOST)
    return s.select("scan_id", F.col("hostname").alias("device"), net.site(F.col("hostname")).alias("site"), *columns, "topology_changes", place("hostname", "item_ord"))


def port_security(t: Tables) -> DataFrame:
    """Protection of switch ports. Guards are looked for in the whole configuration of a device."""
    ports = t["switchport.switchports"].join(t["config.config"].select(*HOST, "config"), HOST, "left")
    for name in ("storm_control", "port_security"):
        on = t[f"switchport.{name}"].select(*HOST, F.lower("interface").alias("_i")).where("_i <> ''").distinct().withColumn(name, F.lit(True))
        ports = ports.withColumn("_i", F.lower(present("interface"))).join(on, [*HOST, "_i"], "left").drop("_i")
    says = lambda x: F.contains(present("config"), F.lit(x))
    bpdu = says("spanning-tree portfast bpduguard default") | ((present("interface") != "") & says("spanning-tree bpduguard enable"))
    return ports.select(
        "scan_id", F.col("hostname").alias("device"), net.site(F.col("hostname")).alias("site"), present("interface").alias("interface"), present("mode").alias("mode"), yes_no(bpdu).alias("bpdu_guard"), yes_no(says("spanning-tree guard root")).alias("root_guard"),
        yes_no(F.col("storm_control")).alias("storm_control"), yes_no(F.col("port_security")).alias("port_security"), present("voice_vlan").alias("voice_vlan"), place("hostname", "item_ord"),
    )


def unhardened(ports: DataFrame) -> DataFrame:
    """Marks what a port's mode asks for and it lacks: BPDU guard on access ports, root guard on trunks, storm control on both."""
    mode = F.lower("mode")
    access = F.contains(mode, F.lit("access"))
    trunk = ~access & F.contains(mode, F.lit("trunk"))
    off = lambda c: F.col(c) == "No"
    return ports.withColumn("lacks_bpdu_guard", access & off("bpdu_guard")).withColumn("lacks_root_guard", trunk & off("root_guard")).withColumn("lacks_storm_control", (access | trunk) & off("storm_control"))


def trunks(t: Tables) -> DataFrame:
    p = t["switchport.switchports"].where(F.contains(F.lower(present("mode")), F.lit("trunk")))
    n = t["cdp_lldp.neighbors"].select(*HOST, "item_ord", F.lower("local_intf").alias("_i"), F.col("remote_device").alias("neighbor"))
    p = looked_up(p.withColumn("_i", F.lower(present("interface"))), n, [*HOST, "_i"], ["item_ord"], "neighbor")
    unpruned = present("allowed_vlans").isin("ALL", "1-4094", "")
    return p.select("scan_id", F.col("hostname").alias("device"), net.site(F.col("hostname")).alias("site"), present("interface").alias("interface"), present("native_vlan").alias("native_vlan"), present("allowed_vlans").alias("allowed_vlans"), "neighbor", unpruned.alias("unpruned"), (present("native_vlan") == "1").alias("native_vlan_1"), place("hostname", "item_ord"))


