import unicodedata
import zlib

import numpy as np

from fieldglass.llm import toxicity


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_labels(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.digest(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    right = np.mean([r["predicted"] == y for r, y in held])
    assert right > 0.93, right
    assert area(np.array([r["score"] for r, _ in held]), np.array([y for _, y in held])) > 0.85


def test_odd_rows_and_no_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (5, 0, 1), (5, 0, 0), (4, 1, 7)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.digest(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.digest(none, labels).collect() == []
    assert len(toxicity.digest(odd, labels.limit(0)).collect()) == odd.count()


def test_lists_work_without_labels(spark):
    texts = ["a calm and useful note about nothing"] * 40 + ["you are an idiot and a worthless moron"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    told = spark.createDataFrame([], "doc_id bigint, label int")
    score = [r["score"] for r in toxicity.scored(df, toxicity.learn(df, told)).orderBy("doc_id").collect()]
    assert max(score[:40]) < 0.5 < min(score[40:])


def test_mined_words_against_brute_force(spark, docs, sf_dir):
    """Counts of words by class, and what is mined of them, counted in plain Python."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null")
    told = labels.selectExpr("doc_id", "toxic as label")
    of = {r["doc_id"]: r["label"] for r in told.collect()}
    seen, n1, n0 = {}, 0, 0
    for r in docs.collect():
        if r["doc_id"] in of:
            words = set("".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in r["text"] or "").split())
            n1, n0 = n1 + of[r["doc_id"]], n0 + 1 - of[r["doc_id"]]
            for w in words:
                k = seen.setdefault(w, [0, 0])
                k[0] += 1
                k[1] += of[r["doc_id"]]
    got = {r["word"]: (r["k"], r["k1"]) for r in toxicity.word_counts(docs.join(told, "doc_id")).collect()}
    assert got.pop(None) == (n1 + n0, n1)
    names = dict(zip(toxicity.hash_words(sorted(seen)).view(np.int64).tolist(), sorted(seen)))
    assert {names[w]: k for w, k in got.items()} == {w: tuple(k) for w, k in seen.items()}
    share = n1 / (n1 + n0)
    listed = {w for x in toxicity.LEXICONS.values() for w in x.split()}
    good = {w for w, (k, k1) in seen.items() if w not in listed and k1 >= toxicity.LEAST_TEXTS and 2 * k1 > k and (k1 - k * share) / (k * share * (1 - share)) ** 0.5 > toxicity.Z}
    mined = toxicity.mined_words(docs.select("doc_id", "text"), told).lists["mined"].view(np.int64).tolist()
    assert {names[w] for w in mined} == good


def drawn(rng, n):
    """Votes of six voters by a known law: the third copies the second nine times of ten, whatever the class."""
    y = rng.random(n) < 0.3
    p = np.where(y[:, None], [0.8, 0.6, 0.6, 0.7, 0.5, 0.3], [0.1, 0.2, 0.2, 0.05, 0.3, 0.3])
    votes = rng.random((n, 6)) < p
    votes[:, 2] = np.where(rng.random(n) < 0.9, votes[:, 1], votes[:, 2])
    return y, votes


def test_the_label_model_finds_the_law():
    rng = np.random.default_rng(3)
    y, votes = drawn(rng, 40_000)
    label = np.where(rng.random(len(y)) < 0.2, y.astype(int), -1)
    patterns, n = np.unique(np.column_stack((votes, label)), axis=0, return_counts=True)
    model = toxicity.label_model(patterns[:, :6] == 1, patterns[:, 6], n.astype(float), 2)
    assert {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0} >= {frozenset((1, 2))}
    assert abs(model.prior - 0.3) < 0.02
    for j in (0, 3, 4):
        if model.parent[j] < 0:
            assert np.allclose(model.speaks[:, 0, j], [votes[~y, j].mean(), votes[y, j].mean()], atol=0.03)
    right = ((model.posterior(votes, np.full(len(y), -1)) >= 0.5) == y).mean()
    odds = np.log(0.3 / 0.7) + sum(np.log(np.where(votes[:, j], votes[y, j].mean() / votes[~y, j].mean(), (1 - votes[y, j].mean()) / (1 - votes[~y, j].mean()))) for j in (0, 1, 3, 4, 5))
    assert right > ((odds >= 0) == y).mean() - 0.005


def test_estimates_and_posterior_by_definition():
    """Tables, probabilities and posterior against loops over single texts."""
    rng = np.random.default_rng(5)
    _, votes = drawn(rng, 60)
    weight = rng.random((2, 60))
    tables = toxicity.pair_tables(votes, weight)
    parent = np.array([-1, 0, 1, 0, -1, 2])
    speaks = toxicity.estimated(tables, parent)
    for c in (0, 1):
        for j in range(6):
            for above in (0, 1):
                own = [i for i in range(60) if parent[j] < 0 or votes[i, parent[j]] == above]
                p = (sum(weight[c, i] for i in own if votes[i, j]) + 0.5) / (sum(weight[c, i] for i in own) + 1)
                assert abs(speaks[c, above, j] - p) < 1e-9
    model = toxicity.LabelModel(0.3, parent, speaks, np.array([0.1, 0.8]))
    got = model.posterior(votes, np.arange(60) % 3 - 1)
    for i in range(60):
        each = []
        for c in (0, 1):
            p = 0.3 if c else 0.7
            for j in range(6):
                s = speaks[c, int(votes[i, parent[j]]) if parent[j] >= 0 else 0, j]
                p *= s if votes[i, j] else 1 - s
            p *= {-1: 1, 0: 1 - model.label[c], 1: model.label[c]}[i % 3 - 1]
            each.append(p)
        assert abs(got[i] - each[1] / sum(each)) < 1e-9


def test_the_classifier_reaches_the_least_loss():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(300, 3)).astype(np.float32), rng.random(300)
    bag = toxicity.Bag(np.arange(300), rng.integers(0, 4, 300), 300)
    w, words, bias = toxicity.logistic(x, bag, y)

    def loss(w, words, bias):
        z = x @ w + bag.times(words) + bias
        return (np.log1p(np.exp(z)) - y * z).sum() + toxicity.RIDGE * (w @ w) / 2 + toxicity.WORD_RIDGE * (words @ words) / 2 + 1e-3 * bias * bias / 2

    best = loss(w, words, bias)
    for _ in range(200):
        other = np.zeros_like(words)
        other[:4] = rng.normal(size=4) * 0.01
        assert loss(w + rng.normal(size=3) * 0.01, words + other, bias + rng.normal() * 0.01) > best - 1e-3
