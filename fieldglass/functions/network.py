"""Addresses, interfaces, VLANs and names of a network."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import whole

# Abbreviations of interface names, in the order in which they apply.
SHORT_NAMES = [("GigabitEthernet", "G"), ("TenGigabitEthernet", "Te"), ("FastEthernet", "F"), ("Ethernet", "E"), ("ethernet", "e"), ("Port-channel", "Po"), ("Vlan", "Vl")]
# Colours by type of device.
COLOURS = {"router": "#FF4444", "switch": "#00D9FF", "firewall": "#FFB800", "access_point": "#00FF88", "server": "#B84DFF", "phone": "#FF6B9D", "unknown": "#999999"}
# What names a firewall.
FIREWALLS = ["palo alto", "paloalto", "fortinet", "fortigate", "checkpoint", "cisco asa", "firepower", "sophos", "sonicwall", "watchguard", "barracuda", "juniper srx", "pa-", "fw-", "pan-os"]
LAYER2, LAYER3 = ["CDP", "LLDP"], ["OSPF", "EIGRP", "BGP", "IS-IS"]


def site(host: Column) -> Column:
    """What stands before the first hyphen of a host name, if there is one."""
    return F.when(F.contains(host, F.lit("-")), F.substring_index(host, "-", 1)).otherwise("")


#: A number up to 255 in at most nine digits.
BYTE = r"0{0,6}(?:[01]?\d\d?|2[0-4]\d|25[0-5])"


def is_ipv4(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$")), F.lit(False))


def ipv4(c: Column) -> Column:
    """The address as a number; null if it is none."""
    byte = lambda i: F.substring_index(F.substring_index(c, ".", i), ".", -1).try_cast("bigint")
    return F.when(is_ipv4(c), byte(1) * 16777216 + byte(2) * 65536 + byte(3) * 256 + byte(4))


def dotted(n: Column) -> Column:
    byte = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def span(prefix: Column) -> Column:
    """Addresses of a network."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (32 - prefix).cast("int"))


def network(ip: Column, prefix: Column) -> Column:
    """(lo, prefix) of the network of an address and a prefix length as texts; null if either is none."""
    n, p = ipv4(ip), whole(prefix)
    return F.when(n.isNotNull() & p.between(0, 32), F.struct((n - F.pmod(n, span(p))).alias("lo"), p.cast("int").alias("prefix")))


def network_text(net: Column) -> Column:
    return F.when(net.isNull(), "").otherwise(F.concat_ws("/", dotted(net["lo"]), net["prefix"].cast("string")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] < b["lo"] + span(b["prefix"])) & (b["lo"] < a["lo"] + span(a["prefix"]))


def cidr(ip: Column, prefix: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat_ws("/", ip, prefix)).otherwise(ip)


def mac(c: Column) -> Column:
    """Dotted hexadecimal as pairs with colons; anything else stays."""
    bare = F.replace(c, F.lit("."), F.lit(""))
    return F.when(F.contains(c, F.lit(".")) & (F.length(bare) == 12), F.regexp_replace(bare, "(..)(?=.)", "$1:")).otherwise(c)


def oui(c: Column) -> Column:
    bare = F.translate(F.coalesce(c, F.lit("")), ":.-", "")
    return F.when(F.length(bare) >= 6, F.upper(F.substring(bare, 1, 6))).otherwise("")


def vlan_id(c: Column) -> Column:
    """VLAN0010 as 10; anything else stays."""
    return F.regexp_replace(c.cast("string"), r"^[Vv][Ll][Aa][Nn]0*(\d+)$", "$1")


def vlan_order(c: Column) -> Column:
    """A number to sort VLAN ids by; 0 for those that are not digits."""
    return F.when(F.regexp_like(c, F.lit(r"^\d+$")), c.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def svi(interface: Column) -> Column:
    """The VLAN of a VLAN interface, else null."""
    return F.nullif(F.regexp_extract(interface, r"^[Vv]lan(\d+)$", 1), F.lit(""))


def default_name(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (F.coalesce(c, F.lit("")) == "") | (low == "default") | F.regexp_like(low, F.lit(r"^vlan0*\d+$"))


def similar_names(a: Column, b: Column) -> Column:
    """Whether two VLAN names are variants of one: equal, both default, or of like length and either two edits apart or with half of their parts in common."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    parts = lambda c: F.array_distinct(F.split(c, r"[_\-\s]+"))
    shared = F.size(F.array_intersect(parts(x), parts(y))) * 2 >= F.greatest(F.size(parts(x)), F.size(parts(y)))
    alike = (F.abs(F.length(x) - F.length(y)) <= 3) & ((F.levenshtein(x, y) <= 2) | shared)
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return empty | (x == y) | (default_name(a) & default_name(b)) | alike


def name_groups(names: Column) -> Column:
    """First names of the groups into which a sorted list of names falls, each name joining the first group whose first name is similar."""
    none = F.array().cast("array<string>")
    return F.aggregate(names, none, lambda heads, n: F.when(F.exists(heads, lambda h: similar_names(n, h)), heads).otherwise(F.concat(heads, F.array(n))))


def role_note(interface: Column, secondary: Column) -> Column:
    low = F.lower(interface)
    has = lambda x: F.contains(low, F.lit(x))
    kind = (
        F.when(has("loopback"), "Loopback")
        .when(has("mgmt") | has("management"), "OOB management")
        .when(has("port-channel") | low.startswith("po"), "Routed port-channel")
        .when(has("tunnel"), "Tunnel")
        .otherwise("Routed interface")
    )
    return F.when(secondary, F.concat(kind, F.lit(" (secondary)"))).otherwise(kind)


def short_interface(c: Column) -> Column:
    for name, short in SHORT_NAMES:
        c = F.regexp_replace(c, f"(?i){name}", short)
    return c


def short_host(c: Column) -> Column:
    """Without the domain, but addresses whole."""
    return F.when(F.regexp_like(c, F.lit(r"^\d+\.\d+\.\d+\.\d+$")), c).otherwise(F.substring_index(c, ".", 1))


def link_layer(protocols: Column) -> Column:
    """l2, l3 or both."""
    known = F.transform(F.coalesce(protocols, F.array().cast("array<string>")), F.upper)
    on = lambda names: F.arrays_overlap(known, F.array(*[F.lit(x) for x in names]))
    return F.when(on(LAYER2) & on(LAYER3), "both").when(on(LAYER3), "l3").otherwise("l2")


def colour(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(COLOURS["unknown"]))


def capabilities(c: Column) -> Column:
    """Capabilities in capitals, separated by commas or white space."""
    text = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), ",", " "))
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def capability_words(c: Column) -> Column:
    """Capabilities as one text in capitals with a space before and after each, in which `any_word` looks for words: the same as the list, without making one."""
    return F.upper(F.concat(F.lit(" "), F.translate(F.coalesce(c, F.lit("")), ",\t\n\x0b\f\r", "      "), F.lit(" ")))


def any_text(text: Column, texts: Iterable[str]) -> Column:
    """Whether one of the texts stands in `text`: one search by one pattern, as many searches make code that the JVM doesn't compile."""
    return F.regexp_like(text, F.lit("|".join(re.sub(r"([^\w\s])", r"\\\1", x, flags=re.ASCII) for x in texts)))


def any_word(words: Column, *names: str) -> Column:
    return any_text(words, [f" {x} " for x in names]) if names else F.lit(False)


def category(caps: Column, platform: Column, description: Column) -> Column:
    """The kind of a device from its capabilities, platform and description."""
    words = F.translate(F.array_join(caps, "\n"), " \n", "\x01 ")  # a space within one is none between two
    return category_of(F.concat(F.lit(" "), words, F.lit(" ")), platform, description)


def category_of(words: Column, platform: Column, description: Column) -> Column:
    """The same from `capability_words`. Every test is a search in a text, so that a row needs no list and no function of its own."""
    any_of = lambda *names: any_word(words, *names)
    text = F.lower(F.concat_ws(" ", F.coalesce(platform, F.lit("")), F.coalesce(description, F.lit(""))))
    firewall = any_text(text, FIREWALLS)
    switching = any_of("SWITCH", "S", "BRIDGE", "B")
    return (
        F.when(firewall, "firewall")
        .when(any_of("WLAN", "W", "AP") | (any_of("TRANS-BRIDGE", "T") & ~switching), "access_point")
        .when(switching, "switch")
        .when(any_of("PHONE"), "phone")
        .when(any_of("HOST", "H", "SERVER"), "server")
        .when(any_of("ROUTER", "R"), "router")
        .otherwise("other")
    )


def has_routing(words: Column) -> Column:
    """Whether `capability_words` name routing."""
    return any_word(words, "ROUTER", "R")


#: The filter that lets a kind of device in.
FILTER_OF = {"router": "include_routers", "firewall": "include_routers", "switch": "include_switches", "phone": "include_phones", "server": "include_servers", "access_point": "include_aps"}


def included(kind: Column, filters: dict[str, bool]) -> Column:
    """Whether the filters let a kind in; kinds without a filter of their own go by include_other. `kind` is mentioned once, as it may be long."""
    other = bool(filters.get("include_other", False))
    differ = [name for name, key in FILTER_OF.items() if bool(filters.get(key, False)) != other]
    return F.coalesce(kind.isin(differ) != F.lit(other), F.lit(other)) if differ else F.lit(other)


def crawlable(capability: Column, filters: dict[str, bool] | None, allowed: list[str] = ("Router", "Switch")) -> Column:
    """Whether a neighbour is visited: without capabilities it is if routers or switches are let in."""
    words = capability_words(capability)
    empty = F.coalesce(capability, F.lit("")) == ""
    if filters is None:
        return empty | any_word(words, *[x.upper() for x in allowed])
    either = bool(filters.get("include_routers", True) or filters.get("include_switches", True))
    return F.when(empty, F.lit(either)).otherwise(included(category_of(words, F.lit(""), F.lit("")), filters))


def link_key(host: Column, interface: Column, other: Column, other_interface: Column) -> Column:
    """One key for a link, whichever end it is seen from."""
    a, b = F.concat_ws(":", host, interface), F.concat_ws(":", other, other_interface)
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
