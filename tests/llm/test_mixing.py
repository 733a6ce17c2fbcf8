import re
from collections import defaultdict

import numpy as np

from fieldglass.llm import mixing


def goals(sizes):
    """Targets by the rule: share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def check(rows, docs):
    sizes, source = defaultdict(int), {}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for i, t, s in docs:
        sizes[s] += size(t)
        source.setdefault(i, (s, t))
    target = goals(sizes)
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        s, t = source[r["doc_id"]]
        assert r["size"] == size(t) and r["source_size"] == sizes[s]
        np.testing.assert_allclose(r["target"], target[s], rtol=1e-9, atol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 1


def test_whole_table(docs):
    rows = mixing.digest(docs).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.digest(docs.repartition(3)).collect()))
    at = [r["position"] for r in rows]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)


def test_odd_rows(odd, none):
    check(mixing.digest(odd).collect(), [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()])
    assert mixing.digest(none).collect() == []


def test_caps_and_small_ranges(spark):
    rows = [(i, "word " * (i % 7), f"s{i % 4}" if i % 50 else "rare") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sized = df.select("doc_id", "source", mixing.words(df["text"]).alias("size"))
    out = mixing.mixed(sized, ["doc_id"], rows=13).collect()
    check(out, rows)


def test_schedule_follows_the_weights(docs):
    sized = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
    rows = mixing.training_order(mixing.schedule(sized, ["doc_id", "size"]), ["doc_id"]).collect()
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copy_words"]
    assert all(0 <= v for v in taken.values())
    at = [r["position"] for r in rows]
    assert at == sorted(at)
