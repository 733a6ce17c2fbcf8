"""Columns whose names operators use for work or output, and tables in which one row is repeated very often."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldglass.llm import fingerprints, langid, lm, mixing, sharding
from fieldglass.llm.common import repeated

WORK = ["rank", "_o", "_k", "_b", "_s", "_c", "_p", "_r", "_i", "_n", "_l", "_cap", "_ratio", "_stops", "_text", "_train", "_block", "_top", "weight", "n", "place", "part", "block", "bucket", "pack", "totals", "tokens", "kinds", "keys", "counts", "level", "slope"]


@pytest.fixture(scope="module")
def wide(spark):
    """Rows with a column for every name."""
    rows = [(i, f"the text number {i} of the house", "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in WORK])


def whole(out, wide, also):
    assert set(out.columns) == (set(wide.columns) | set(also)) - ({"text"} - set(out.columns))
    rows = out.collect()
    assert len(rows) >= wide.count() and {r["doc_id"] for r in rows} == set(range(40))
    for r in rows:
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in WORK if c not in also)


def test_mixing(wide):
    sized = wide.withColumn("size", mixing.words(F.col("text")))
    whole(mixing.mixed(sized, ["doc_id"]).drop("size"), wide, ["source_size", "target", "taken", "before"])
    out = mixing.training_order(mixing.schedule(sized, ["doc_id"]), ["doc_id"])
    assert set(out.columns) >= set(WORK) and all(r["rank"] == f"rank-{r['doc_id']}" for r in out.collect())


def test_mixing_drops_outputs_and_its_prefix(wide):
    clash = wide.withColumn("size", F.lit(2)).select("*", *[F.lit("x").alias(c) for c in ("source_size", "TARGET", "taken", "before", "position", "copy", "copy_words", "__mix_rank")])
    rows = mixing.schedule(clash, ["doc_id"]).collect()
    assert "__mix_rank" not in rows[0].asDict() and all(isinstance(r["position"], float) for r in rows)


def test_sharding(wide):
    whole(sharding.shuffled_shards(wide, 5, ["doc_id"]), wide, ["shard", "slot"])


def test_lm(wide):
    whole(lm.scored(wide, F.col("doc_id") > 3), wide, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])


def test_langid(wide):
    whole(langid.identified(wide, langid.learn(wide.select("text", "lang"))), wide, ["spans", "lang_pred", "score"])


def test_repeated(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", 1 << 17)], "x string, n bigint")
    assert {r["x"]: r["count"] for r in repeated(df, "n", 100).groupBy("x").count().collect()} == {"a": 1, "b": 5, "c": 1 << 17}


@pytest.fixture(scope="module")
def copies(spark):
    """200,000 rows that are equal in all columns, and a few others."""
    same = spark.range(200_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("One and the same text.").alias("text"), F.lit("s0").alias("source"))
    other = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text number "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    return same.unionByName(other).repartition(16)


def test_mixing_spreads_equal_rows_over_ranges(copies, monkeypatch):
    sized = sharding.numbered(copies.select("doc_id", "source", mixing.words(F.col("text")).alias("size")))
    placed = mixing.mixed(sized, ["doc_id", "size"], copy="copy")
    before = sorted(r["before"] for r in placed.where("doc_id IS NULL").select("before").collect())
    assert len(set(before)) == 200_000
    key = F.md5(F.concat_ws(":", F.lit("11"), F.lit(""), F.col("size").cast("string"), F.when(F.col("copy") > 0, F.col("copy").cast("string"))))
    part = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32) * 51)
    most = sized.where("doc_id IS NULL").groupBy(part.alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 5_000
    rows = mixing.digest(copies).collect()
    taken = sum(r["taken"] for r in rows if r["doc_id"] is None)
    source = sum(r["taken"] for r in rows if r["target"] == next(x["target"] for x in rows if x["doc_id"] is None))
    assert len(rows) == 200_300 and taken <= source and abs(source - rows[0]["target"]) >= 0


def test_lm_sends_equal_rows_once_a_batch(copies):
    kept = copies.select("doc_id", F.col("text").alias("__lm_text"), F.lit(True).alias("__lm_train"))
    packed = lm.packs(kept.withColumn(lm.ROW[0], F.xxhash64("doc_id", "__lm_text")).withColumn(lm.ROW[1], F.xxhash64("__lm_text", "doc_id")).withColumn("__lm_block", F.pmod(F.col(lm.ROW[0]), F.lit(30)).cast("int")))
    assert packed.agg(F.max(F.octet_length("pack"))).first()[0] < 20_000
    rows = lm.scored(copies, F.lit(True)).collect()
    n = Counter(r["doc_id"] for r in rows)
    assert n[None] == 200_000 and len(rows) == 200_300 and len({r["score"] for r in rows if r["doc_id"] is None}) == 1
    assert rows[0]["train_tokens"] == 200_000 * 6 + 300 * 4


def test_fingerprints_of_equal_rows(copies):
    rows = fingerprints.digest(copies).collect()
    same = [r for r in rows if r["doc_id"] is None]
    assert len(rows) == 200_300 and len(same) == 200_000 and sum(r["near_next"] == 1 for r in same) == 199_999


def test_fingerprints_do_not_depend_on_how_rows_are_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(str, fingerprints.digest(docs).collect()))
    assert sorted(map(str, fingerprints.digest(docs.orderBy(F.rand())).collect())) == want and len(want) == docs.count()
