import random

from pyspark.sql import functions as F

from fieldglass.functions import network as net
from fieldglass.operators.overlap import around


def test_lists_of_networks_above_and_below(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        prefix = rng.choice([8, 20, 22, 24, 30, 32])
        lo = (10 << 24) + rng.randrange(1 << 14)
        rows.append((rng.choice(["s", None, "t"]), f"h{rng.randrange(4)}", i, lo - lo % (1 << (32 - prefix)), prefix))
    rows += [("s", "h0", 300, None, None), ("t", "h1", 301, 0, 0), ("t", "h2", 302, 0, 0)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "scope string, hostname string, i int, lo bigint, prefix int").repartition(5)
    got = {(r["scope"], r["lo"], r["prefix"]): [tuple(x) for x in r["around"]] for r in around(df, ["scope"], ["hostname", "i"]).collect()}
    held = lambda a, b: a[4] > b[4] and a[3] - a[3] % (1 << (32 - b[4])) == b[3]
    want = {}
    for a in rows:
        if a[3] is not None and a[0] is not None:
            near = sorted((b[1], b[2]) for b in rows if b[0] == a[0] and b[3] is not None and (held(a, b) or held(b, a)))
            if near:
                want[a[0], a[3], a[4]] = near
    assert got == want


def test_addresses_of_bytes_only(spark):
    good = {"1.2.3.4": 0x01020304, "000000255.00.0.9": 0xFF000009, "249.250.255.0": 0xF9FAFF00}
    bad = ["256.1.1.1", "1.2.3", "1.2.3.4.5", "1..2.3", "0000000001.1.1.1", "1.2.3.260", " 1.2.3.4", "", None]
    df = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string").select("s", net.is_ipv4(F.col("s")).alias("is"), net.ipv4(F.col("s")).alias("n"))
    assert {r["s"]: (r["is"], r["n"]) for r in df.collect()} == {**{s: (True, n) for s, n in good.items()}, **dict.fromkeys(bad, (False, None))}


def test_the_audit_reads_interfaces_once(spark, sf_dir):
    from fieldglass.queries import QUERIES

    assert not any("orders.parquet" in f for f in QUERIES["J10_address_audit"](spark, sf_dir).inputFiles())
