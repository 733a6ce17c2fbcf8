import re
from itertools import combinations

import numpy as np
import pytest

from fieldglass.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, size, percent):
    """(id, set size, smallest id reachable) of all rows."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc is None, doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows))


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


@pytest.mark.parametrize("size", [2, 5])
def test_whole_table_against_brute_force(docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, size, 80)
    assert got(minhash.near_duplicates(docs, size)) == want
    assert any(w[1] != w[3] for w in want)


def test_odd_rows(odd, none):
    assert got(minhash.near_duplicates(odd, 2)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], 2, 80)
    assert minhash.near_duplicates(none, 2).collect() == []


def test_chains_and_large_groups(spark):
    """A chain in which each text is like the next but not like the one after it, and many copies and near copies."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(1000 - i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(40)]
    rows += [(2000 + i, "one and the same text for all of these rows " * 3) for i in range(400)]
    near = [f"v{i}" for i in range(100)]
    rows += [(3000 + i, " ".join(near[:50] + [f"odd{i}"] + near[50:])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(minhash.near_duplicates(df, 2)) == brute(rows, 2, 80)


def test_small_tiles_lose_no_link(spark, monkeypatch):
    """Many texts that share buckets but are linked only here and there, read in tiles of few rows."""
    rng = __import__("random").Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(2, 12)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "CHUNK", 7)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(minhash.near_duplicates(df, 2)) == brute(rows, 2, 80)


def test_tiles_alone_find_every_link(spark, monkeypatch):
    """Without rounds every link must come from tiles; sets of some 100 shingles, linked in pairs, chains and not at all."""
    rng = __import__("random").Random(11)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(110)]
        for v in range(5):
            w = list(base)
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(110)] = f"x{rng.randrange(100000)}"
            rows.append((100 * v + g, " ".join(w)))
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 2, 80)
    assert sum(w[1] != w[3] for w in want) > 20
    assert got(minhash.near_duplicates(df, 2)) == want


def test_estimate_keeps_small_sets():
    """Sets of 4 of 5 shingles are at 0.8 exactly: none of them may fall to the estimate."""
    rng = np.random.default_rng(1)
    small = [np.unique(rng.integers(0, 1 << 64, 4, np.uint64)) for _ in range(20_000)]
    large = [np.unique(np.append(s, rng.integers(0, 1 << 64, 1, np.uint64))) for s in small]
    x = minhash.sketches(small)[1].view(np.uint64) ^ minhash.sketches(large)[1].view(np.uint64)
    unequal = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
    chance = 1 / (1 << minhash.BITS)
    assert (((1 - unequal / minhash.HASHES) - chance) / (1 - chance)).min() >= minhash.least_estimate(0.8)


def test_confirmation_has_whole_hashes(spark):
    texts = [" ".join(f"w{i * j}" for i in range(50)) for j in range(1, 9)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = {r["node"]: minhash._unpacked(bytes(r["members"])) for r in minhash.node_sets(df, 2).collect()}
    want = minhash.shingle_sets(texts, 2)
    assert len(sets) == len(texts) and all((sets[minhash.node_key(s)] == s).all() for s in want)
