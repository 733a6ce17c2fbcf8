"""Reports by name: which collectors they need, their sheets, and the formats they come in. Further reports register themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scans import available, gated
from . import edge, flat, l2, l3, lifecycle, topology
from .flat import Tables

Build = Callable[[Tables], DataFrame]


@dataclass
class Sheet:
    headers: dict[str, str]
    build: Build
    gate: str | None = None


@dataclass
class Report:
    name: str
    label: str
    category: str
    requires: list[str]
    formats: list[str] = field(default_factory=lambda: ["xlsx", "json", "csv", "xml"])
    sheets: dict[str, Sheet] = field(default_factory=dict)


REPORTS: dict[str, Report] = {}


def register(report: Report) -> Report:
    REPORTS[report.name] = report
    return report


def _heads(text: str, **other: str) -> dict[str, str]:
    """Column names and their titles, from "Title, Title, ..."; columns are the titles in small letters unless named otherwise."""
    out = {}
    for title in text.split(", "):
        name = title.lower().replace("/location", "").replace(" / ", "_").replace("#", "").replace("%", "pct").replace("-", "_").strip().replace(" ", "_")
        out[other.get(name, name)] = title
    return out


LINKS = "Local Device, Local Interface, Remote Device, Remote Interface, Remote IP, Protocols"
FHRP = "Device, Site/Location, Interface, Group, Priority, State, Virtual IP"
FOUND = "Device, Site/Location, Severity, Finding, Details"
HARDWARE = "Device Name, Management IP, Component, PID, Description, Serial Number, End-of-Sale, End-of-SW Maintenance, End-of-Vulnerability Support, End-of-Service Contract Renewal, Last Date of Support, Days Remaining, Status, Replacement PID, Replacement Name, Bulletin URL"
SOFTWARE = "Device Name, Management IP, Device Type, Platform, Current Version, OS Type, End-of-Sale, End-of-SW Maintenance, End-of-Vulnerability Support, Last Date of Support, Days Remaining, Status, Bulletin URL"
DISCOVERY, LAYER2, LAYER3, CHECKS = "Discovery & Topology", "Layer 2 Analysis", "Layer 3 Analysis", "Compliance & Config"

register(Report("arp_summary", "ARP Summary", LAYER3, ["arp"], sheets={"Summary": Sheet(_heads("Device, Interface, Entry Count"), flat.arp_summary), "Detail": Sheet(_heads("Device, Interface, IP, MAC, Age"), flat.arp_detail)}))
register(Report("mac_table", "MAC Table", LAYER2, ["mac_table"], sheets={"MAC Table": Sheet(_heads("Device, MAC Address, VLAN, Type, Port"), flat.mac_table)}))
register(
    Report("interface_summary", "Interface Summary", DISCOVERY, ["interfaces"], sheets={
        "Interface Status": Sheet(_heads("Device, Port, Description, Status, VLAN, Duplex, Speed, Type"), flat.interface_status),
        "IP Interfaces": Sheet(_heads("Device, Interface, IP Address, Status, Protocol"), flat.ip_interfaces),
    })
)
register(Report("link_inventory", "Link Inventory", DISCOVERY, ["cdp_lldp"], sheets={"Links": Sheet(_heads(LINKS), flat.links), "By Device": Sheet(_heads(LINKS), flat.links)}))
register(
    Report("device_inventory", "Device Inventory", DISCOVERY, ["device_inventory"], sheets={
        "Devices": Sheet(_heads("Hostname, Mgmt IP, Device Type, Category, Platform, Platform Description, Software Version, Serial Number"), flat.inventory_devices),
        "Stack Members": Sheet(_heads("Hostname, Mgmt IP, Member #, Role, Model, Serial, MAC, Priority, State"), flat.stack_members),
        "Modules": Sheet(_heads("Hostname, Mgmt IP, Slot, Type, Model, Serial, Status, Ports"), flat.modules),
    })
)
register(
    Report("l2_discovery", "Layer 2 Discovery", LAYER2, ["stp_vlan", "cdp_lldp", "interfaces"], sheets={
        "Summary": Sheet(_heads("Metric, Value"), l2.summary),
        "VLAN Documentation": Sheet({"vlan_id": "VLAN ID", "site": "Site/Location", "vlan_name": "VLAN Name", "seen_on": "Seen On (Switches)", "stp_root_bridge": "STP Root Bridge", "root_priority": "Root Priority", "svi_ip_cidr": "SVI IP / CIDR", "hsrp_vip": "HSRP VIP", "blocked_ports": "Blocked Ports", "notes": "Notes"}, l2.vlan_documentation),
        "Findings": Sheet(_heads("Hostname, Site/Location, Port, Notes"), l2.findings_sheet),
        "Root Bridge IDs": Sheet(_heads("Hostname, Site/Location, Root Bridge ID"), l2.root_bridges),
        "STP Topology": Sheet(_heads("Device, Site/Location, VLAN, Interface, Role, State, Cost, Topology Changes"), l2.stp_topology, "stp_detail"),
        "Port Security": Sheet(_heads("Device, Site/Location, Interface, Mode, BPDU Guard, Root Guard, Storm Control, Port Security, Voice VLAN"), l2.port_security, "switchport"),
        "Trunk Summary": Sheet(_heads("Device, Site/Location, Interface, Native VLAN, Allowed VLANs, Neighbor"), l2.trunks, "switchport"),
    })
)
register(
    Report("routing_summary", "Routing Summary", LAYER3, ["l3_routing"], sheets={
        "Summary": Sheet(_heads("Metric, Value"), l3.summary),
        "Protocol Neighbors": Sheet(_heads("Device, Site/Location, Protocol, Neighbor IP, Neighbor Device, State"), l3.protocol_neighbors),
        "Routes": Sheet(_heads("Device, Site/Location, Network, Mask, Next Hop, Interface, Protocol, Metric"), l3.routes),
        "Routed Interfaces": Sheet({"device": "Device", "site": "Site/Location", "interface": "Interface", "ip_cidr": "IP / CIDR", "description": "Description / Neighbor", "notes": "Notes"}, l3.routed_interfaces),
        "Route Summary": Sheet(_heads("Device, Site/Location, Connected, Static, OSPF, EIGRP, BGP, Other, Total"), l3.route_summary, "routing_detail"),
        "OSPF Topology": Sheet(_heads("Device, Site/Location, Process ID, Router ID, Area, Interface, Cost, State, Neighbors"), l3.ospf_topology, "routing_detail"),
        "IP Address Audit": Sheet(_heads("Device, Site/Location, Interface, IP / CIDR, Subnet, VLAN, Overlap"), l3.address_audit, "interfaces"),
        "ARP MAC Map": Sheet(_heads("Device, Site/Location, IP Address, MAC Address, Interface, VLAN, Vendor OUI"), l3.arp_mac_map, "arp"),
        "VRF Summary": Sheet(_heads("Device, Site/Location, VRF Name, RD, Interfaces, Interface Count"), l3.vrf_summary, "vrf"),
        "FHRP Status": Sheet(_heads(FHRP), l3.fhrp_status, "hsrp"),
        "Findings": Sheet(_heads(FOUND), lambda t: l3.findings_sheet(l3.findings(t))),
    })
)
register(
    Report("internet_edge", "Internet Edge", LAYER3, ["routing_detail"], sheets={
        "Summary": Sheet(_heads("Metric, Value"), edge.summary),
        "BGP Peers": Sheet(_heads("Device, Site/Location, Neighbor, ASN, State, Prefixes Rcvd, Uptime"), edge.bgp_peers, "routing_detail"),
        "NAT Overview": Sheet(_heads("Device, Site/Location, Inside Intfs, Outside Intfs, Active Translations, Peak, Pool Name, Total Addrs, Allocated, Util %"), edge.nat_overview, "edge_services"),
        "ACL Audit": Sheet(_heads("Device, Site/Location, ACL Name, Type, Rule Count, Zero-Hit Rules, Has Permit-Any"), edge.acl_audit, "edge_services"),
        "FHRP Status": Sheet(_heads(FHRP), l3.fhrp_status, "hsrp"),
        "Edge Interfaces": Sheet(_heads("Device, Site/Location, Interface, IP, ACL In, ACL Out, Proxy ARP, uRPF"), edge.edge_interfaces, "edge_services"),
        "Findings": Sheet(_heads(FOUND), lambda t: l3.findings_sheet(edge.findings(t))),
    })
)
register(
    Report("eox_lifecycle", "End-of-Life / End-of-Support", CHECKS, ["device_inventory"], formats=["xlsx"], sheets={
        "Summary": Sheet(_heads("Metric, Value"), lambda t: lifecycle.summary(t, as_of(t))),
        "Status Breakdown": Sheet(_heads("Status, HW Chassis, HW Modules, Software"), lambda t: lifecycle.status_sheet(t, as_of(t))),
        "Hardware Lifecycle": Sheet(_heads(HARDWARE), lambda t: lifecycle.hardware(t, as_of(t))),
        "Software Lifecycle": Sheet(_heads(SOFTWARE), lambda t: lifecycle.software(t, as_of(t))),
        "Modules & Components": Sheet(_heads(HARDWARE), lambda t: lifecycle.modules(t, as_of(t))),
    })
)
register(Report("topology_map", "Topology Map", DISCOVERY, ["cdp_lldp"], formats=["html", "svg"], sheets={"Nodes": Sheet({c: c for c in ("id", "label", "type", "color", "full_name", "is_seed", "has_routing", "arp_count")}, topology.nodes), "Edges": Sheet({c: c for c in ("source", "target", "local_interface", "remote_interface", "link_type", "protocols")}, topology.edges)}))
register(Report("config_archive", "Config Archive", CHECKS, ["config"], formats=["zip"], sheets={"Configs": Sheet({"hostname": "hostname", "config": "config"}, flat.configs)}))


def as_of(t: Tables):
    """The day that lifecycles are reckoned from: the tables' own, if they name one."""
    day = t.get("as_of")
    return F.lit(day).cast("date") if isinstance(day, str) else F.current_date()


def sheet(t: Tables, report: str, name: str, gate: bool = True) -> DataFrame:
    """A sheet of all scans, for scans whose devices have output of the collector it hangs on."""
    s = REPORTS[report].sheets[name]
    out = s.build(t)
    return gated(out, t["parsed"], s.gate) if gate and s.gate else out


def can_generate(t: Tables, report: str, lookups: bool = True) -> DataFrame:
    """(scan_id, available); lifecycles also need look-ups to be set up."""
    out = available(t["devices"], REPORTS[report].requires)
    return out if report != "eox_lifecycle" else out.withColumn("available", F.col("available") & F.lit(lookups))
