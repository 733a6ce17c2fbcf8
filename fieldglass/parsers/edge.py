"""Access lists, IP interfaces and address translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_block, by_pattern, keys_of, last_match

IP = r"\d+\.\d+\.\d+\.\d+"
#: The source of a rule ends with any, host x, or an address with or without a wildcard.
SOURCE = rf"^((?:\S+ )*?(?:any(?= |$)|host(?: \S+|$)|{IP}\S*(?: {IP}\S*)?))(?: (.*))?$"


def access_lists(df: DataFrame) -> DataFrame:
    """show access-lists: name, type and entries (action, protocol, source, destination, hit_count)."""
    b = by_block(df, r"(?:Extended|Standard)\s+IP\s+access\s+list\s+\S")
    head = r"^(Extended|Standard)\s+IP\s+access\s+list\s+(\S+)"
    kind = F.regexp_extract("block", head, 1)
    lines = F.transform(F.slice(F.split("block", r"\R"), 2, 2_000_000), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    extended = r"^(\d+)\s+(permit|deny)\s+(\S+)\s+(.*?)(?:\s+\((\d+)\s+match(?:es)?\))?$"
    standard = r"^(\d+)\s+(permit|deny)\s+(.*?)(?:\s+\((\d+)\s+match(?:es)?\))?$"

    # Each pattern is matched once a line: its groups are set on lines of their own, as no line holds an end of line.
    groups = lambda x, pattern, order: F.split(F.regexp_replace(x, pattern, "\n".join(f"${g}" for g in order)), "\n")
    matched = lambda pattern, order: F.filter(F.transform(lines, lambda x: groups(x, pattern, order)), lambda p: F.size(p) == len(order))
    hits = lambda p: F.coalesce(F.nullif(p, F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    # A rest that names no source is one part, all of which is the source.
    split = F.transform(matched(extended, (5, 2, 3, 4)), lambda p: F.struct(p[0].alias("h"), p[1].alias("a"), p[2].alias("p"), groups(F.regexp_replace(F.trim(p[3]), r"\s+", " "), SOURCE, (1, 2)).alias("r")))
    rules = F.transform(split, lambda x: F.struct(x["a"].alias("action"), x["p"].alias("protocol"), x["r"][0].alias("source"), F.coalesce(F.get(x["r"], F.lit(1)), F.lit("")).alias("destination"), hits(x["h"]).alias("hit_count")))
    simple = F.transform(matched(standard, (4, 2, 3)), lambda p: F.struct(p[1].alias("action"), F.lit("ip").alias("protocol"), F.trim(p[2]).alias("source"), F.lit("").alias("destination"), hits(p[0]).alias("hit_count")))
    entries = F.when(kind == "Extended", rules).otherwise(simple)
    return b.select(*keys_of(df), "item_ord", F.regexp_extract("block", head, 2).alias("name"), kind.alias("type"), entries.alias("entries"))


def ip_interfaces(df: DataFrame) -> DataFrame:
    """show ip interface: a record for each interface."""
    b = by_block(df, r"\S+\s+is\s")
    line = lambda start: last_match(F.col("block"), rf"(?m)^[ \t]*{start}")
    unset = lambda c: F.when(c.isNull() | (F.trim(c) == "not set"), "").otherwise(F.trim(c))
    has = lambda pattern: F.regexp_like("block", F.lit(pattern))
    return b.select(
        *keys_of(df), "item_ord", F.regexp_extract("block", r"^(\S+)", 1).alias("interface"), F.coalesce(line(r"Internet address is (\S+)"), F.lit("")).alias("ip_address"),
        unset(line(r"Inbound\s+access list is ([^\r\n]+)")).alias("acl_in"), unset(line(r"Outgoing\s+access list is ([^\r\n]+)")).alias("acl_out"),
        (F.coalesce(line(r"Proxy ARP is (enabled|disabled)"), F.lit("")) == "enabled").alias("proxy_arp"),
        has(r"(?m)IP verify source reachable-via|^[ \t]*Unicast RPF").alias("urpf"),
        (F.coalesce(line(r"IP directed.broadcast forwarding is (enabled|disabled)"), F.lit("")) == "enabled").alias("directed_broadcast"),
    )


def nat_translations(df: DataFrame) -> DataFrame:
    """show ip nat translations: lines of five columns, without the header."""
    pattern = r"\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*$"
    rows = by_pattern(df, pattern, {"protocol": 1, "inside_global": 2, "inside_local": 3, "outside_local": 4, "outside_global": 5})
    return rows.where(~F.lower("protocol").isin("pro", "prot", "protocol"))


def nat_statistics(df: DataFrame) -> DataFrame:
    """show ip nat statistics: one record a text; zeros and empty lists where nothing is said."""
    text = F.coalesce("text", F.lit(""))
    number = lambda p, g=1: F.coalesce(last_match(text, rf"(?m)^[ \t]*{p}", g).cast("bigint"), F.lit(0).cast("bigint"))
    listed = lambda p: F.filter(F.transform(F.split(F.coalesce(last_match(text, rf"(?mi)^[ \t]*{p}[ \t]*([^\r\n]+)"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    pool = r"(?i)^\s*pool\s+(\S+):.+total addresses\s+(\d+).*allocated\s+(\d+)\s+\((\d+)%\)"
    part = lambda x, g: F.regexp_extract(x, pool, g)
    pools = F.transform(
        F.filter(F.split(text, r"\R"), lambda x: F.regexp_like(x, F.lit(pool))),
        lambda x: F.struct(part(x, 1).alias("name"), part(x, 2).cast("bigint").alias("total_addresses"), part(x, 3).cast("bigint").alias("allocated"), part(x, 4).cast("bigint").alias("utilization_pct")),
    )
    return df.select(
        *keys_of(df), number(r"Total active translations:\s+(\d+)").alias("active_translations"), number(r"Peak translations:\s+(\d+)").alias("peak_translations"),
        number(r"Hits:\s+(\d+)\s+Misses:\s+(\d+)").alias("hits"), number(r"Hits:\s+(\d+)\s+Misses:\s+(\d+)", 2).alias("misses"),
        listed("Outside interfaces?:").alias("outside_interfaces"), listed("Inside interfaces?:").alias("inside_interfaces"), pools.alias("pools"),
    )


__all__ = ["access_lists", "ip_interfaces", "nat_translations", "nat_statistics"]
