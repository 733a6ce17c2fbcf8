"""A corpus pipeline of five of the operators: language, near-duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, and each works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm import bpe, langid, minhash, mixing, pii
from fieldglass.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a text's letters that its main language has at least.
LEAST_SHARE = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, which lang then names; those without letters (null and empty texts among them) or with no main language go. Repeated rows stay; an empty table gives an empty one."""
    docs = docs.select(*COLUMNS)
    model = langid.learn(docs.select("text", "lang"))
    found = langid.identified(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles link it at 0.8: the one of the smallest id, or one without an id where none has one. Of rows equal in id and text one stays, that of the least source, then lang (nulls first). Texts without words, or null, are no one's duplicates; an empty table gives an empty one. Columns beyond those of documents are left out."""
    docs = docs.select(*COLUMNS).withColumn("row", F.md5("text"))
    ids = minhash.one_of_each(docs, size=5, percent=80).toDF("_id", "_row")
    held = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("row").eqNullSafe(F.col("_row")), "left_semi")
    same = Window.partitionBy("doc_id", "row").orderBy("source", "lang")
    return held.withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what is personal gives way to its kind in brackets. Null texts stay null, empty and repeated rows stay; an empty table gives an empty one."""
    found = pii.find_pii(docs.select(*COLUMNS))
    out = found.withColumn("text", pii.redacted(F.col("text"), F.col("pii")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (those that it doesn't take go), sorted by training position. A null text has no words and comes once, as any without words; a null source is one of its own; repeated rows count each; an empty table gives an empty one."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.words(F.col("text"))).withColumn("row", F.md5("text"))
    keys = ["doc_id", "size", "row"]  # of rows equal in id and text the stage before keeps one
    return mixing.training_order(mixing.schedule(sized, keys), keys).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its bytes. A null text counts as empty, which has no ids; repeated rows give repeated rows; an empty table gives an empty one."""
    path = public_tokenizers.path(RANKS)
    rows = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_sha"), "text")
    back = bpe.encode_decode(rows, path)
    return back.select("doc_id", "lang", "source", "n_tokens", "token_ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("decodes"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Training a language model and packing tokens are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
