"""Networks that overlap.

Two networks overlap only if one lies in the other. So each network looks for those that hold it: for every shorter
prefix length that occurs, its address cut to that length is joined by equality with the networks of that length. No
pair of networks is compared that does not overlap, and networks are joined once, however many interfaces have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as net
from .graph import shared_table


def nested_networks(networks: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, lo, prefix) -> inner and outer networks, the outer holding the inner and not equal to it."""
    one = networks.select(*scope, "lo", "prefix").where("lo is not null").distinct()
    outer = one.select(*scope, F.col("lo").alias("outer_lo"), F.col("prefix").alias("outer_prefix"))
    lengths = one.agg(F.collect_set("prefix").alias("_lengths"))  # one row of 33 numbers at most, so that no scope comes to one task
    cut = one.crossJoin(F.broadcast(lengths)).withColumn("outer_prefix", F.explode(F.filter("_lengths", lambda p: p < F.col("prefix")))).drop("_lengths")
    cut = cut.withColumn("outer_lo", F.col("lo") - F.pmod(F.col("lo"), net.span(F.col("outer_prefix"))))
    return cut.join(outer, [*scope, "outer_lo", "outer_prefix"])


def overlapping(interfaces: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs of interfaces of different hosts whose networks overlap and are not equal, from (scope, hostname, lo, prefix, ...): columns a_* (first host by name) and b_*."""
    held = interfaces.where("lo is not null")
    nested = nested_networks(held, scope)
    named = lambda tag: held.select(*scope, *[F.col(c).alias(f"{tag}_{c}") for c in held.columns if c not in scope])
    inner = named("i").withColumnsRenamed({"i_lo": "lo", "i_prefix": "prefix"})
    outer = named("o").withColumnsRenamed({"o_lo": "outer_lo", "o_prefix": "outer_prefix"})
    pairs = nested.join(inner, [*scope, "lo", "prefix"]).join(outer, [*scope, "outer_lo", "outer_prefix"]).where("i_hostname <> o_hostname")
    rest = [c for c in held.columns if c not in scope and c not in ("lo", "prefix")]
    inner_first = F.col("i_hostname") < F.col("o_hostname")
    pick = lambda tag, c: F.when(inner_first, F.col(f"{'i' if tag == 'a' else 'o'}_{c}")).otherwise(F.col(f"{'o' if tag == 'a' else 'i'}_{c}")).alias(f"{tag}_{c}")
    return pairs.select(*scope, *[pick(t, c) for t in "ab" for c in rest])


def around(interfaces: DataFrame, scope: list[str], fields: list[str]) -> DataFrame:
    """(scope, lo, prefix, around): for each network the fields of all interfaces in networks above and below it, as structs in order.

    Interfaces of one network are listed once and go to other networks as a list, which is sorted once a network and not once an interface."""
    held = interfaces.where("lo is not null")
    nested = nested_networks(held, scope)
    own = held.groupBy(*scope, "lo", "prefix").agg(F.collect_list(F.struct(*fields)).alias("_own"))
    above = nested.join(own.withColumnsRenamed({"lo": "outer_lo", "prefix": "outer_prefix"}), [*scope, "outer_lo", "outer_prefix"]).select(*scope, "lo", "prefix", "_own")
    below = nested.join(own, [*scope, "lo", "prefix"]).select(*scope, F.col("outer_lo").alias("lo"), F.col("outer_prefix").alias("prefix"), "_own")
    every = above.unionByName(below).groupBy(*scope, "lo", "prefix").agg(F.collect_list("_own").alias("_every"))
    return every.select(*scope, "lo", "prefix", F.sort_array(F.flatten("_every")).alias("around"))


def rooted(interfaces: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, lo, prefix) -> the outermost network that holds it (root_lo, root_prefix; itself if there is none), and how many interfaces lie in that."""
    own = interfaces.where("lo is not null").groupBy(*scope, "lo", "prefix").agg(F.count("*").alias("n"))
    own = shared_table(own)  # read several times
    top = nested_networks(own, scope).groupBy(*scope, "lo", "prefix").agg(F.min("outer_prefix").alias("root_prefix"))
    out = own.join(top, [*scope, "lo", "prefix"], "left").withColumn("root_prefix", F.coalesce("root_prefix", "prefix"))
    out = shared_table(out.withColumn("root_lo", F.col("lo") - F.pmod(F.col("lo"), net.span(F.col("root_prefix")))))
    return out.drop("n").join(out.groupBy(*scope, "root_lo", "root_prefix").agg(F.sum("n").alias("size")), [*scope, "root_lo", "root_prefix"])


def beside(interfaces: DataFrame, roots: DataFrame, scope: list[str], order: list[str], value: str, separator: str, name: str, host: str = "hostname") -> DataFrame:
    """Interfaces with `name`, the values of those of other hosts that they overlap without being equal, in order, joined; from `rooted` roots.

    All that an interface can overlap lies in its root's network, which is listed once; texts are made from that list one
    interface after the other, so that what is sent grows with the interfaces and not with the overlaps."""
    columns = [c for c in interfaces.columns if c not in scope]
    rest = [c for c in columns if c not in order]
    row = F.struct(*order, *rest, (F.col("lo") + net.span(F.col("prefix")) - 1).alias("_hi"))
    trees = interfaces.join(roots, [*scope, "lo", "prefix"]).groupBy(*scope, "root_lo", "root_prefix").agg(F.sort_array(F.collect_list(row)).alias("_tree"))
    each = trees.select(*scope, "_tree", F.explode("_tree").alias("_i"))
    me = lambda c: F.col(f"_i.{c}")
    over = lambda x: (x["lo"] <= me("_hi")) & (x["_hi"] >= me("lo")) & ((x["lo"] != me("lo")) | (x["prefix"] != me("prefix"))) & (x[host] != me(host))
    return each.select(*scope, *[me(c).alias(c) for c in columns], F.array_join(F.filter("_tree", over)[value], separator).alias(name))


def forest(networks: DataFrame, scope: list[str]) -> DataFrame:
    """Networks as a forest, from (scope, lo, prefix, n), n being how many are counted at a network.

    One row a network: n, the network right above it (null at the top), depth, and how many are counted in all networks
    above it (outer) and below it (inner). A network has 32 networks above it at most, so what is joined grows with the
    networks, however many of them lie in one; counts are summed before they are shuffled."""
    one = shared_table(networks.where("lo is not null").groupBy(*scope, "lo", "prefix").agg(F.sum("n").alias("n")))  # read several times
    nested = nested_networks(one, scope)
    above = one.select(*scope, F.col("lo").alias("outer_lo"), F.col("prefix").alias("outer_prefix"), F.col("n").alias("_above"))
    up = nested.join(above, [*scope, "outer_lo", "outer_prefix"]).groupBy(*scope, "lo", "prefix")
    up = up.agg(F.max_by("outer_lo", "outer_prefix").alias("parent_lo"), F.max("outer_prefix").alias("parent_prefix"), F.count("*").alias("depth"), F.sum("_above").alias("outer"))
    down = nested.join(one.select(*scope, "lo", "prefix", F.col("n").alias("_below")), [*scope, "lo", "prefix"])
    down = down.groupBy(*scope, F.col("outer_lo").alias("lo"), F.col("outer_prefix").alias("prefix")).agg(F.sum("_below").alias("inner"))
    out = one.join(up, [*scope, "lo", "prefix"], "left").join(down, [*scope, "lo", "prefix"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*scope, "lo", "prefix", "n", "parent_lo", "parent_prefix", count("depth"), count("outer"), count("inner"))


def overlap_counts(interfaces: DataFrame, scope: list[str], host: str = "hostname") -> DataFrame:
    """Interfaces (scope, host, lo, prefix, ...) with `overlaps`, how many of other hosts they overlap without being equal: those above and below in the scope's forest, less those in the host's own. No pair is made."""
    interfaces = shared_table(interfaces)  # read three times
    counted = interfaces.withColumn("n", F.lit(1).cast("long"))
    sums = lambda by, name: forest(counted, by).select(*by, "lo", "prefix", (F.col("outer") + F.col("inner")).alias(name))
    out = interfaces.join(sums(scope, "_all"), [*scope, "lo", "prefix"], "left").join(sums([*scope, host], "_own"), [*scope, host, "lo", "prefix"], "left")
    return out.withColumn("overlaps", F.coalesce(F.col("_all") - F.col("_own"), F.lit(0))).select(*interfaces.columns, "overlaps")
