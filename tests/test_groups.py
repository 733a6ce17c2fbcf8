import random
import time

from pyspark.sql import functions as F

from fieldglass.functions import network as net
from fieldglass.operators.names import grouped, near, segments
from fieldglass.operators.overlap import forest, overlap_counts

NETS = "scan_id string, hostname string, lo bigint, prefix int"


def span(prefix):
    return 1 << (32 - prefix)


def random_networks(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = rng.choice([0, 8, 12, 16, 20, 24, 24, 30, 32])
        lo = rng.randrange(1 << 32) & 0x0F0FFFFF
        out.append((rng.choice("ab"), f"h{rng.randrange(6)}", lo - lo % span(p), p))
    return [*out, ("a", "h1", None, None)]


def test_forest_and_counts_against_pairs(spark):
    rows = random_networks(1, 300)
    df = spark.createDataFrame(rows, NETS)
    within = lambda a, b: a[0] == b[0] and b[3] < a[3] and b[2] <= a[2] < b[2] + span(b[3])
    real = [r for r in rows if r[2] is not None]
    nets = {(r[0], None, r[2], r[3]): 0 for r in real}
    for r in real:
        nets[r[0], None, r[2], r[3]] += 1
    got = {(r["scan_id"], r["lo"], r["prefix"]): r for r in forest(df.withColumn("n", F.lit(1)), ["scan_id"]).collect()}
    assert len(got) == len(nets)
    for a, n in nets.items():
        above = [b for b in nets if within(a, b)]
        below = [b for b in nets if within(b, a)]
        parent = max(above, key=lambda b: b[3], default=(None,) * 4)
        r = got[a[0], a[2], a[3]]
        assert (r["n"], r["parent_lo"], r["parent_prefix"], r["depth"], r["outer"], r["inner"]) == (n, parent[2], parent[3], len(above), sum(nets[b] for b in above), sum(nets[b] for b in below))
    want = sorted(str((*r, 0 if r[2] is None else sum((within(r, b) or within(b, r)) and b[1] != r[1] for b in real))) for r in rows)
    assert sorted(str(tuple(r)) for r in overlap_counts(df, ["scan_id"]).collect()) == want


def test_one_network_over_all_others(spark):
    """A /8 on each of 500 hosts over 100,000 interfaces with networks of their own: fifty million pairs, none of which is made."""
    inner = spark.range(100_000).select(F.lit("s").alias("scan_id"), F.concat(F.lit("h"), (F.col("id") % 500).cast("string")).alias("hostname"), (F.lit(10 << 24) + F.col("id") * 64).alias("lo"), F.lit(26).alias("prefix"))
    outer = spark.range(500).select(F.lit("s").alias("scan_id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("hostname"), F.lit(10 << 24).cast("bigint").alias("lo"), F.lit(8).alias("prefix"))
    began = time.time()
    sums = overlap_counts(inner.unionByName(outer), ["scan_id"]).groupBy("prefix").agg(F.count("*").alias("n"), F.min("overlaps").alias("least"), F.max("overlaps").alias("most")).collect()
    assert {r["prefix"]: tuple(r)[1:] for r in sums} == {26: (100_000, 499, 499), 8: (500, 99_800, 99_800)}
    assert time.time() - began < 120


def fold(spark, names):
    df = spark.createDataFrame([(s, n) for s, n in names], "scope string, name string")
    heads = df.groupBy("scope").agg(net.name_groups(F.array_sort(F.collect_set("name"))).alias("heads"))
    return {r["scope"]: list(r["heads"]) for r in heads.collect()}


def random_names(seed, n):
    rng = random.Random(seed)
    parts = ["users", "user", "srv", "servers", "lab", "Lab", "dmz", "voice", "mgmt", "x", "", "guest1", "guest2", "default", "VLAN0010"]
    out = []
    for _ in range(n):
        name = rng.choice(["_", "-", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append("".join(c for c in name if rng.random() > 0.05) + rng.choice(["", "", str(rng.randrange(30))]))
    return out


def test_leaders_are_those_of_the_fold(spark):
    names = [(f"v{v}", n) for v in range(4) for n in random_names(v, 150) if n] + [("e", ""), ("e", "one"), ("e", "two"), ("d", "default"), ("d", "vlan7"), ("d", "Default ")]
    want = fold(spark, names)
    got = grouped(spark.createDataFrame(names, "scope string, name string").repartition(5), ["scope"]).collect()
    assert len(got) == len(set(names))
    for scope, heads in want.items():
        assert {r["leader"] for r in got if r["scope"] == scope} == set(heads)
        for r in (r for r in got if r["scope"] == scope):
            df_heads = [h for h in heads if h <= r["name"]]
            assert r["leader"] in df_heads
    # Each name's leader is the first that it is similar to.
    checks = spark.createDataFrame([(r["name"], h, r["leader"]) for r in got for h in want[r["scope"]] if h <= r["leader"] and h <= r["name"]], "name string, head string, leader string")
    like = checks.select(net.similar_names(F.col("name"), F.col("head")).alias("like"), (F.col("head") == F.col("leader")).alias("own"), "name", "head")
    assert like.where("like <> own AND NOT (own AND name = head)").count() == 0


def test_tens_of_thousands_of_names_in_one_vlan(spark):
    rng = random.Random(9)
    names = [("v", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) + "-" + str(i)) for i in range(20_000)]
    began = time.time()
    assert grouped(spark.createDataFrame(names, "scope string, name string"), ["scope"]).where("name = leader").count() > 19_000
    assert time.time() - began < 120


def test_empty_table_and_nulls(spark):
    assert grouped(spark.createDataFrame([], "scope string, name string"), ["scope"]).collect() == []
    assert [tuple(r) for r in grouped(spark.createDataFrame([("v", None), ("v", "a"), (None, "b")], "scope string, name string"), ["scope"]).orderBy("scope", "name").collect()] == [(None, "b", "b"), ("v", "", ""), ("v", "a", "")]


def test_near_and_segments():
    assert near("kitten", "sittin") and not near("kitten", "sitting") and near("", "ab") and not near("", "abc") and near("same", "same")
    assert segments(7) == [(0, 2), (2, 4), (4, 7)] and segments(1) == [(0, 0), (0, 0), (0, 1)]
