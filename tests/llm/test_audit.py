import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from fieldglass.llm import audit


def brute(docs, labels):
    """Every order, filter by filter, on lists of documents."""
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts.setdefault(s or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in rows if f in r[0]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def check(docs, labels):
    rows = audit.audit(docs, labels).collect()
    want = brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(rows) == len(got) and got == want


def test_whole_table(spark, sf_dir, docs):
    check(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0, 5), (1, None, 1, 5), (None, 1, 1, 5), (5, 1, 1, 5), (11, 0, None, 5), (99, 1, 1, 5)], "doc_id bigint, quality int, toxic int, mask int")
    clash = odd.withColumn("mask", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("first", F.lit(3)).withColumn("part", F.lit("p")).withColumn("good", F.lit(1)).withColumn("fails", F.lit(31))
    check(clash, labels)
    check(odd, labels.where("false"))
    assert audit.audit(none, labels).collect() == []


def test_copies_and_bounds(spark):
    words = " ".join(f"w{i}" for i in range(50))
    texts = [words, words, "A" * 5 + "b" * 95, "A" * 6 + "b" * 94, " ".join(["x"] * 36 + [f"y{i}" for i in range(64)]), " ".join(["x"] * 35 + [f"y{i}" for i in range(64)]), None, "", None, "#", "very long " * 40000]
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, words, "t"), (None, None, "")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), spark.createDataFrame([(0, 1, 1)], "doc_id bigint, quality int, toxic int"))


def test_sums_invert_to_any_counts(spark):
    rng = np.random.default_rng(3)
    masks = [("p" if i % 3 else "q", int(g), int(x), int(m)) for i, (g, x, m) in enumerate(zip(rng.integers(0, 2, 500), rng.integers(0, 2, 500), rng.integers(0, 32, 500)))]
    out = {r["part"]: r for r in audit.cells(audit.parity_sums(spark.createDataFrame(masks, "part string, good int, toxic int, mask int"))).collect()}
    for part in "pq":
        own = [m for m in masks if m[0] == part]
        for m in range(32):
            assert (out[part]["n"][m], out[part]["n_good"][m], out[part]["n_toxic"][m]) == (sum(x[3] == m for x in own), sum(x[3] == m and x[1] for x in own), sum(x[3] == m and x[2] for x in own))
