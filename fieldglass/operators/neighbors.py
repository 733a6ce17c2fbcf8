"""Neighbour records of several protocols made one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_table
from .rows import last_values

FIELDS = ["remote_device", "remote_ip", "remote_platform", "remote_capabilities", "local_intf", "remote_intf", "system_description"]
HOST = ["scan_id", "hostname"]


def _keyed(df: DataFrame) -> DataFrame:
    for c in FIELDS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    key = F.coalesce(F.nullif("remote_device", F.lit("")), F.nullif("remote_ip", F.lit("")))
    return df.withColumn("_key", key)


def merged_l2(cdp: DataFrame, lldp: DataFrame) -> DataFrame:
    """CDP records by device (or address), filled from LLDP where they lack address or interfaces; LLDP's description wins; other LLDP records follow."""
    kept = [*HOST, "_key", *FIELDS, "item_ord"]
    a = last_values(_keyed(cdp).where("_key is not null").select(*kept), [*HOST, "_key"], ["item_ord"])
    every = _keyed(lldp).where("_key is not null").select(*kept)
    # Of several LLDP records the first that has a field fills it, each adds its protocol, and the last description holds.
    o = F.col("item_ord")
    filling = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c)
    first = lambda c: F.min_by(c, o).alias(c)
    latest = F.max_by("system_description", F.when(F.coalesce("system_description", F.lit("")) != "", o)).alias("system_description")
    by = {"remote_ip": filling, "remote_intf": filling, "local_intf": filling}
    b = every.groupBy(*HOST, "_key").agg(*[by.get(c, first)(c) for c in FIELDS if c != "system_description"], latest, F.count("*").alias("_n"), F.min(o).alias("item_ord"))
    side = lambda df, tag: df.select(*HOST, "_key", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in (*HOST, "_key")])
    both = side(a, "a").join(side(b, "b"), [*HOST, "_key"], "full_outer")
    seen = F.col("a_item_ord").isNotNull()

    def field(c: str) -> Column:
        if c in by:
            return F.coalesce(f"a_{c}", f"b_{c}").alias(c)
        if c == "system_description":
            return F.coalesce("b_system_description", "a_system_description").alias(c)
        return F.when(seen, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)

    again = F.array_repeat(F.lit("LLDP"), F.coalesce("b__n", F.lit(0)).cast("int"))
    protocols = F.when(seen, F.concat(F.array(F.lit("CDP")), again)).otherwise(again)
    order = F.struct(F.when(seen, 0).otherwise(1).alias("part"), F.coalesce("a_item_ord", "b_item_ord").alias("item"))
    return both.select(*HOST, *[field(c) for c in FIELDS], protocols.alias("protocols"), order.alias("place"))


def merged(cdp: DataFrame, lldp: DataFrame, l3: DataFrame | None = None) -> DataFrame:
    """All neighbours of a host. Routing neighbours whose address is known add their protocol; the others become records by address (or name).
    Both sides are read twice with routing neighbours, so they are made once."""
    l2 = merged_l2(cdp, lldp)
    if l3 is None:
        return l2
    l2 = shared_table(l2)
    rows = _keyed(l3).withColumn("_key", F.coalesce(F.nullif("remote_ip", F.lit("")), F.nullif("remote_device", F.lit("")))).where("_key is not null")
    o = F.struct("item_ord", "protocol")
    adding = rows.groupBy(*HOST, "_key").agg(
        *[F.min_by(c, o).alias(c) for c in FIELDS], F.transform(F.array_sort(F.collect_set(F.struct("item_ord", "protocol"))), lambda x: x["protocol"]).alias("_more"), F.min("item_ord").alias("_at")
    )
    adding = shared_table(adding.withColumn("_more", F.array_distinct("_more")))
    # An address belongs to the last L2 record that has it.
    owner = l2.where("remote_ip <> ''").groupBy(*HOST, "remote_ip").agg(F.max("place").alias("place"))
    known = owner.join(adding.select(*HOST, F.col("_key").alias("remote_ip"), "_more"), [*HOST, "remote_ip"])
    out = l2.join(known.select(*HOST, "place", "_more"), [*HOST, "place"], "left")
    out = out.withColumn("protocols", F.when(F.col("_more").isNull(), F.col("protocols")).otherwise(F.concat("protocols", F.array_except("_more", "protocols")))).drop("_more")
    alone = adding.join(owner.select(*HOST, F.col("remote_ip").alias("_key")), [*HOST, "_key"], "left_anti")
    alone = alone.select(*HOST, *FIELDS, F.col("_more").alias("protocols"), F.struct(F.lit(2).alias("part"), F.col("_at").alias("item")).alias("place"))
    return out.unionByName(alone)
