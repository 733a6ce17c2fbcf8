import math
import zlib
from collections import Counter

import numpy as np

from fieldglass.llm import sharding


def check(rows, want):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in want)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(24))
    size = [counts.get(s, 0) for s in range(24)]
    assert max(size) - min(size) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_whole_table(docs):
    rows = sharding.digest(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.digest(docs.repartition(5)).collect()))


def test_odd_rows(odd, none):
    check(sharding.digest(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sharding.digest(none).collect() == []


def test_small_ranges(docs, monkeypatch):
    out = sharding.shuffled_shards(docs.select("doc_id"), 7, ["doc_id"], rows=10).collect()
    for s, n in Counter(r["shard"] for r in out).items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_matrix_has_exact_sums():
    parts = [0, 5, 1000, 37, 1, 400]
    m = sharding.communication_matrix(parts, 24, 3)
    assert m.sum(axis=1).tolist() == parts and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()
    big = sharding.communication_matrix([4_000_000_000, 3_000_000_000], 3, 1)
    assert big.sum(axis=1).tolist() == [4_000_000_000, 3_000_000_000] and np.ptp(big.sum(axis=0)) <= 1


def test_slot_is_long(docs):
    assert dict(sharding.digest(docs).dtypes)["slot"] == "bigint"


def test_inversion_follows_the_law(monkeypatch):
    """Drawn shares against the probabilities from binomial coefficients."""
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 0)
    rng = np.random.default_rng(9)
    for good, bad, sample in ((7, 5, 6), (30, 2, 20), (1, 9, 3), (4, 4, 8), (0, 5, 2), (5, 0, 2)):
        drawn = Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(4000))
        for k in range(max(0, sample - bad), min(sample, good) + 1):
            p = math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample)
            assert abs(drawn.pop(k, 0) / 4000 - p) < 5 * math.sqrt(p * (1 - p) / 4000) + 1e-9
        assert not drawn


def test_moments_beyond_the_generators_range():
    rng = np.random.default_rng(10)
    good, bad, sample = 3_000_000_000, 5_000_000_000, 200_000
    drawn = np.array([sharding.hypergeometric(rng, good, bad, sample) for _ in range(2000)])
    share = good / (good + bad)
    spread = math.sqrt(sample * share * (1 - share) * (good + bad - sample) / (good + bad - 1))
    assert abs(drawn.mean() - sample * share) < 5 * spread / math.sqrt(2000)
    assert abs(drawn.std() / spread - 1) < 0.1


def test_matrix_follows_the_law():
    """The first part's rows in the first shard, over many seeds, against the law of drawing without replacement."""
    parts, shards = [6, 10, 8], 3
    drawn = Counter(int(sharding.communication_matrix(parts, shards, seed)[1, 1]) for seed in range(3000))
    for k in range(9):
        p = math.comb(8, k) * math.comb(16, 10 - k) / math.comb(24, 10)
        assert abs(drawn.get(k, 0) / 3000 - p) < 5 * math.sqrt(p * (1 - p) / 3000) + 1e-9


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(None, None)] * 200 + [(1, "same")] * 100 + [(i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sharding.digest(df).collect()
    check(out, rows)
    assert sorted(map(str, out)) == sorted(map(str, sharding.digest(df.repartition(3)).collect()))
    n = Counter((r["doc_id"], r["copy"]) for r in sharding.numbered(df.select("doc_id")).collect())
    assert set(n.values()) == {1} and n[None, 199] == 1
