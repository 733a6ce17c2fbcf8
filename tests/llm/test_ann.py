import math

import numpy as np

from fieldglass.llm import ann


def brute(rows, every, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out.setdefault(q, []).append([(r, i, s) for r, (s, i) in enumerate(near, 1)])
    return {q: sorted(x for one in v for x in one) for q, v in out.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [x[:2] for x in a[q]] == [x[:2] for x in b[q]]
        np.testing.assert_allclose([x[2] for x in a[q]], [x[2] for x in b[q]], rtol=1e-12)


def test_whole_table_is_exact(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    same(got(ann.digest(df)), brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 100, 10))


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(300)]
    rows += [(600, None), (700, []), (800, [0.0] * 5), (801, [float("nan")] * 5), (802, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (803, [None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (900, [1.0, 2.0]), (901, [1.0, 2.5])]
    rows += [rows[100], rows[100]]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    want = {q: v for q, v in brute(rows, 100, 10).items() if v}
    same(got(ann.digest(df)), want)
    assert ann.digest(df.limit(0)).collect() == []


def test_small_groups_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=7)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for name, value in (("SMALL", 37), ("SIDE_BYTES", 500), ("TILE", (4, 11))):
        monkeypatch.setattr(ann, name, value)
    same(got(ann.digest(df, 10)), brute(rows, 10, 10))


def test_vectors_beyond_double_precision(spark):
    """Squares that overflow or vanish exclude nothing: scores are those of scaled vectors."""
    big = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [3e200, 1e200]), (3, [1.0, 1.0]), (100, [1e-200, 1e-200]), (5, [1e-200, 2e-200]), (6, [1.7e308, -1.7e308])]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")

    def far(v, w):
        most = max(abs(a / 2 - b / 2) for a, b in zip(v, w))
        return 2 * (most * math.sqrt(sum(((a / 2 - b / 2) / most) ** 2 for a, b in zip(v, w)))) if most else 0.0

    for r in ann.digest(df).collect():
        assert math.isclose(r["score"], far(dict(big)[r["query_id"]], dict(big)[r["vec_id"]]), rel_tol=1e-12)
    near = {q: [r["vec_id"] for r in sorted(ann.digest(df).where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (0, 100)}
    assert near[0] == sorted((i for i, _ in big if i), key=lambda i: (far(dict(big)[0], dict(big)[i]), i)) and near[100][0] == 5


def test_a_repeated_row_is_no_hot_group(spark):
    rows = [(200, [1.0, 2.0])] * 3000 + [(i, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    same(got(ann.digest(df, 20)), brute(rows, 20, 10))
