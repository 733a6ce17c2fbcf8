import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What every stage gets and gives."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return {name: (a, b) for name, a, b in out}


def test_columns(steps):
    for name, (a, b) in steps.items():
        if name != "tokens":
            assert b.columns == corpus_pipeline.COLUMNS


def test_language_keeps_what_has_one(steps):
    a, b = steps["language"]
    lost = a.join(b, "doc_id", "left_anti").collect()
    assert len(lost) < 0.05 * a.count()
    known = {r["doc_id"]: r["lang"] for r in a.collect()}
    assert sum(known[r["doc_id"]] in (None, r["lang"]) for r in b.collect()) > 0.97 * b.count()


def test_near_duplicates_against_brute_force(steps):
    a, b = steps["near_duplicates"]
    want = {least for _, _, _, least in brute([(r["doc_id"], r["text"]) for r in a.collect()], 5, 80)}
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(want)


def test_personal_data_is_gone_and_all_documents_stay(steps):
    a, b = steps["personal_data"]
    assert Counter(r["doc_id"] for r in a.collect()) == Counter(r["doc_id"] for r in b.collect())
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(email.search(r["text"]) for r in a.collect())
    assert not any(email.search(r["text"]) for r in b.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in b.collect())


def test_mix_takes_whole_documents_up_to_three_times(steps):
    a, b = steps["mixing"]
    texts = {r["doc_id"]: r["text"] for r in a.collect()}
    times = Counter(r["doc_id"] for r in b.collect())
    assert max(times.values()) <= 3 and set(times) <= set(texts)
    assert all(texts[r["doc_id"]] == r["text"] for r in b.collect())


def test_tokens_decode(steps):
    a, b = steps["tokens"]
    assert a.count() == b.count() and all(r["decodes"] for r in b.select("decodes").collect())


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    mark = lambda df: Counter((r["doc_id"], hashlib.sha1(r["token_ids"]).hexdigest()) for r in df.collect())
    assert mark(corpus_pipeline.run(spark, sf_dir)) == mark(steps["tokens"][1])


def test_odd_rows(spark, odd, none, tmp_path):
    for docs, n in ((odd.select(*corpus_pipeline.COLUMNS), "odd"), (none.select(*corpus_pipeline.COLUMNS), "none")):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        if n == "none":
            assert docs.collect() == []


def test_near_copies_without_an_id(spark):
    """Each group keeps one document: of rows without an id one, and none beside a row with an id."""
    text = lambda name, odd: " ".join([f"{name}{i}" for i in range(80)] + [odd])
    rows = [(7, text("a", "x")), (None, text("a", "y")), (None, text("b", "x")), (None, text("b", "y")), (None, text("b", "y")), (None, text("c", "x")), (9, text("d", "x")), (9, text("d", "y")), (8, text("a", "z")), (8, text("e", "x"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["text"][0], str(r["doc_id"])) for r in got) == [("a", "7"), ("b", "None"), ("c", "None"), ("d", "9"), ("e", "8")]
