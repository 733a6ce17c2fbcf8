"""Record lists of scan tables from raw output of commands, for devices whose scan holds no parsed list.

Each list names its collector, the commands that may show it (a device is asked one of them, by its type; of several the
first that is there counts) and the parser. A list is filled for a device that has no row of it, so parsed records go
before raw output; a parsed list that is empty on purpose can't be told from one that is missing, and its text is parsed
again. Blocked ports and spanning-tree detail are filled where their sheets are built. Lists that only an external
template library reads (routes, MAC tables, interfaces, inventory) stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neighbors import merged_l2
from ..operators.rows import fallback
from ..parsers import edge, neighbors, routing, switching
from ..sources.scans import KEYS, Tables

Parser = Callable[[DataFrame], DataFrame]

# Commands that show a list.
ROUTES: dict[str, tuple[list[str], Parser]] = {
    "arp.entries": (["show ip arp", "show iparp", "show arp"], neighbors.arp),
    "hsrp.entries": (["show standby brief", "show hsrp brief"], switching.hsrp_brief),
    "stp_detail.inconsistent_ports": (["show spanning-tree inconsistentports"], switching.inconsistent_ports),
    "stp_detail.stp_root_summary": (["show spanning-tree root"], switching.stp_roots),
    "switchport.switchports": (["show interfaces switchport", "show interface switchport"], switching.switchports),
    "device_inventory.stack_members": (["show switch detail", "show virtual-chassis"], lambda df: switching.stack_members(df).withColumnRenamed("mac_address", "mac")),
    "routing_detail.route_summary": (["show ip route summary"], routing.route_summary),
    "routing_detail.ospf_processes": (["show ip ospf"], routing.ospf_processes),
    "routing_detail.ospf_interfaces": (["show ip ospf interface brief"], routing.ospf_interfaces),
    "routing_detail.bgp_summary": (["show ip bgp summary"], routing.bgp_summary),
    "routing_detail.bgp_table": (["show ip bgp"], routing.bgp_table),
    "routing_detail.eigrp_topology": (["show ip eigrp topology"], routing.eigrp_topology),
    "routing_detail.eigrp_neighbors": (["show ip eigrp neighbors detail"], routing.eigrp_neighbors),
    "edge_services.access_lists": (["show access-lists"], edge.access_lists),
    "edge_services.ip_interfaces": (["show ip interface"], edge.ip_interfaces),
    "edge_services.nat_translations": (["show ip nat translations"], edge.nat_translations),
    "edge_services.nat_statistics": (["show ip nat statistics"], edge.nat_statistics),
}
# Commands that show the neighbours of a routing protocol.
PROTOCOLS = {
    "ospf": ["show ip ospf neighbor", "show ip ospf neighbors", "show ospf neighbor"],
    "eigrp": ["show ip eigrp neighbors"],
    "bgp": ["show ip bgp neighbors", "show bgp ipv4 unicast neighbors", "show bgp neighbor"],
    "isis": ["show isis neighbors", "show isis adjacency"],
}
CONFIG = ["show running-config", "show configuration"]
CDP, LLDP = ["show cdp neighbors detail"], ["show lldp neighbors detail", "show lldp neighbors"]
#: Places that the records of one text may take, where those of several texts follow one another.
SPAN = 100_000_000


def texts(t: Tables, collector: str, commands: list[str]) -> DataFrame:
    """(keys, text) of the first of the commands that a device's collector has; empty texts are left out."""
    first = F.coalesce(*[F.try_element_at("raw", F.lit(c)) for c in commands])
    return t["raw"].where(F.col("collector") == collector).select(*KEYS, first.alias("text")).where("text <> ''")


def _cast(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` that rows have, in its types."""
    return rows.select(*[F.col(n).cast(kind).alias(n) for n, kind in like.dtypes if n in rows.columns])


def l2_neighbors(t: Tables) -> DataFrame:
    rows = merged_l2(neighbors.cdp(texts(t, "cdp_lldp", CDP)), neighbors.lldp(texts(t, "cdp_lldp", LLDP)))
    rows = rows.withColumn("item_ord", F.col("place.part") * SPAN + F.col("place.item"))
    return rows.join(t["devices"].select(*KEYS), ["scan_id", "hostname"])


def l3_neighbors(t: Tables) -> DataFrame:
    out = None
    for i, (protocol, commands) in enumerate(PROTOCOLS.items()):
        part = neighbors.PROTOCOLS[protocol](texts(t, "l3_routing", commands)).withColumn("item_ord", F.col("item_ord") + i * SPAN)
        out = part if out is None else out.unionByName(part)
    return out


def vrfs(t: Tables, ios: Parser, nxos: Parser, commands: tuple[str, str]) -> DataFrame:
    """Each of the two layouts has commands of its own."""
    return ios(texts(t, "vrf", [commands[0]])).unionByName(nxos(texts(t, "vrf", [commands[1]])))


def of_vrfs(t: Tables, kind: str, parser: Parser) -> DataFrame:
    each = t["raw"].where("collector = 'vrf'").select(*KEYS, F.explode("raw").alias("command", "text"))
    return parser(routing.by_vrf(each, kind))


def filled(t: Tables) -> Tables:
    """The tables with lists from raw output where a device has none parsed; collectors with raw output count as parsed ones."""
    out: Tables = dict(t)

    def fill(name: str, rows: DataFrame, parsed: DataFrame | None = None) -> None:
        out[name] = fallback(t[name] if parsed is None else parsed, _cast(rows, t[name]), KEYS)

    for name, (commands, parser) in ROUTES.items():
        fill(name, parser(texts(t, name.split(".")[0], commands)))
    # A collector without a configuration has a row with an empty text.
    fill("config.config", texts(t, "config", CONFIG).withColumnRenamed("text", "config"), t["config.config"].where("config <> ''"))
    fill("cdp_lldp.neighbors", l2_neighbors(t))
    fill("l3_routing.neighbors", l3_neighbors(t))
    fill("vrf.vrfs", vrfs(t, routing.ios_vrfs, routing.nxos_vrfs, ("show ip vrf", "show vrf")))
    fill("vrf.vrf_interfaces", vrfs(t, routing.ios_vrf_interfaces, routing.nxos_vrf_interfaces, ("show ip vrf interfaces", "show vrf all interface")))
    fill("vrf.vrf_routes", of_vrfs(t, "route", routing.vrf_routes))
    fill("vrf.vrf_arp", of_vrfs(t, "arp", routing.vrf_arp))
    has = t["raw"].where(F.size("raw") > 0).select(*KEYS, "collector", F.lit(True).alias("has"))
    out["parsed"] = t["parsed"].unionByName(has).groupBy(*KEYS, "collector").agg(F.max("has").alias("has"))
    return out
