"""Uniform shards of exact sizes, with DataFrame functions only.

Rows belong to logical parts by a hash. How many rows each part sends to each shard is drawn once from the
hypergeometric law: a part's row of the communication matrix is a draw without replacement from what the shards still
hold. Within a part rows stand in random order and go out by that matrix (permute, exchange); within a shard they are
put in random order again. Every arrangement is equally likely up to the hash, and shard sizes differ by one at most.

Order within a shard comes from ranges of the random key: counts by shard and range give offsets, so no task holds a
whole shard. Parts and ranges grow with the rows, at about ROWS rows each. The matrix has parts x shards numbers; it is
drawn on the driver from the parts' counts alone and is joined as a small table of one row a part (MOST_PARTS x shards
numbers at most; beyond MOST_PARTS x ROWS rows parts grow, and a part is sorted with spills, never held whole). Draws
follow the hypergeometric law exactly at every size.

Rows are told apart by the key columns; rows equal in all of them are interchangeable, and `numbered` tells them apart
where there may be many. Null keys hash like any value. Texts only give their length and CRC, so their size does not
matter. An empty table gives an empty result. Columns named like an output, or with the
prefix __shard_ of work columns, are dropped first; all others stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unreserved, written

#: Rows that a logical part, or a range of a shard, holds on average; parts at most, which bounds the matrix.
ROWS, MOST_PARTS = 100_000, 1 << 16
#: Rows up to which numpy draws, and deviations around the mode that an inversion looks at (beyond lies less than 1e-80).
NUMPY_ROWS, DEVIATIONS = 1_000_000_000, 20
#: Equal rows that one task numbers.
COPIES = 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` rows drawn without replacement are good ones, at any size.

    Numpy draws from populations below NUMPY_ROWS. Beyond, the same law is inverted around its mode: neighbouring
    probabilities have known ratios, so a window of them needs no factorials.
    """
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, sample)) if sample and good + bad else 0
    total = good + bad
    low, high = max(0, sample - bad), min(sample, good)
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    width = int(DEVIATIONS * (sample * (good / total) * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5) + 100
    k = np.arange(max(low, mode - width), min(high, mode + width) + 1).astype(np.float64)
    ratio = (good - k[:-1]) * (sample - k[:-1]) / (k[1:] * (bad - sample + k[1:]))
    height = np.concatenate(([0.0], np.cumsum(np.log(ratio))))
    mass = np.cumsum(np.exp(height - height.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1], "right")])


def communication_matrix(parts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each part sends to each shard: row sums as given, column sums within one of each other."""
    rng = np.random.default_rng(seed)
    total = sum(parts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(parts), shards), np.int64)
    for i, n in enumerate(parts):
        rest, pool = n, int(left.sum())
        for s in range(shards - 1):
            pool -= int(left[s])
            take = hypergeometric(rng, int(left[s]), pool, rest)
            out[i, s] = take
            rest -= take
        out[i, shards - 1] = rest
        left -= out[i]
    return out


def shuffled_shards(df: DataFrame, shards: int, keys: list[str], seed: int = 7, rows: int = ROWS) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    df = unreserved(df, "__shard_", "shard", "slot")
    total = df.count()
    parts = int(min(MOST_PARTS, max(64, -(-total // rows))))
    ranges = int(max(8, -(-total // (rows * shards))))
    key = lambda salt: F.xxhash64(F.lit(seed * 1000 + salt), *keys)
    df = df.withColumn("__shard_p", F.pmod(key(1), F.lit(parts)).cast("int"))
    counts = {r["__shard_p"]: r["n"] for r in df.groupBy("__shard_p").agg(F.count("*").alias("n")).collect()}  # a number for each part
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    stops = spark.createDataFrame([(p, row) for p, row in enumerate(np.cumsum(matrix, axis=1).tolist())], "__shard_p int, __shard_stops array<bigint>")
    local = Window.partitionBy("__shard_p").orderBy(key(2), *keys)
    sent = df.withColumn("__shard_r", F.row_number().over(local) - 1).join(F.broadcast(stops), "__shard_p")
    sent = sent.withColumn("shard", F.size(F.filter("__shard_stops", lambda c: c <= F.col("__shard_r"))).cast("int")).drop("__shard_r", "__shard_stops", "__shard_p")
    return with_slots(sent, ranges, key(3), keys)


def with_slots(sent: DataFrame, ranges: int, key: Column, keys: list[str]) -> DataFrame:
    """Adds slot: the place of a row in its shard by `key`, from counts by shard and range of the key."""
    sent = sent.withColumn("__shard_k", key).withColumn("__shard_b", F.floor((F.shiftrightunsigned("__shard_k", 33).cast("double") / (1 << 31)) * ranges).cast("int"))
    counts = sent.groupBy("shard", "__shard_b").agg(F.count("*").alias("__shard_n"))
    before = Window.partitionBy("shard").orderBy("__shard_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__shard_b", F.coalesce(F.sum("__shard_n").over(before), F.lit(0)).alias("__shard_o"))
    place = F.row_number().over(Window.partitionBy("shard", "__shard_b").orderBy("__shard_k", *keys))
    return sent.withColumn("__shard_i", place).join(offsets, ["shard", "__shard_b"]).withColumn("slot", (F.col("__shard_o") + F.col("__shard_i") - 1).cast("long")).drop("__shard_k", "__shard_b", "__shard_o", "__shard_i")


def numbered(rows: DataFrame, name: str = "copy") -> DataFrame:
    """Equal rows with numbers from 0. They are counted before they are shuffled, and many equal ones are numbered by many tasks."""
    keys = rows.columns
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__shard_n"))
    chunks = counts.withColumn("__shard_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__shard_n") - 1) / COPIES)))).repartition(*keys, "__shard_c")
    last = F.least(F.lit(COPIES), F.col("__shard_n") - F.col("__shard_c") * COPIES) - 1
    return chunks.withColumn("__shard_i", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*keys, (F.col("__shard_c") * COPIES + F.col("__shard_i")).alias(name))


def digest(df: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; a null text has no bytes and the CRC of none."""
    text = F.coalesce("text", F.lit(""))
    rows = df.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffled_shards(written(numbered(rows)), shards, ["doc_id", "text_crc32", "size", "copy"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
