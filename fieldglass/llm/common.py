"""What the operators of this folder share: the shared folder, text batches and code point tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a batch holds at most, unless one text alone is longer.
BATCH_BYTES = 1 << 18
#: Bytes that each of a cache's two generations holds, and what an entry takes besides its key.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 200


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares, spark.checkpoint.dir, which must be set: executors elsewhere see no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/fieldglass-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that lost executors cost no recomputation and plans stay short."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unreserved(df: DataFrame, prefix: str, *outputs: str) -> DataFrame:
    """df without columns that are named like outputs or begin with the prefix that work columns of an operator have."""
    return df.drop(*[c for c in df.columns if c.lower() in outputs or c.lower().startswith(prefix)])


def combined(batch: pa.RecordBatch, keys: list[str], copies: str) -> pa.RecordBatch:
    """A batch with one row for each value of the key columns (64-bit numbers), and how many rows had it."""
    columns = [batch.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(order)))
    out = batch if len(begin) == len(order) else batch.take(pa.array(order[begin]))
    counts = counts if len(begin) < len(order) else np.ones(len(order), np.int64)
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(counts, pa.int64())], names=[*out.schema.names, copies])


def repeated(df: DataFrame, copies: str, chunk: int = 1 << 16) -> DataFrame:
    """Every row as often as its column `copies` says; the column goes."""
    last = F.floor((F.col(copies) - 1) / chunk)
    chunks = df.withColumn(copies, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda c: F.least(F.lit(chunk), F.col(copies) - c * chunk))))
    return chunks.withColumn(copies, F.explode(F.array_repeat(F.lit(True), F.col(copies).cast("int")))).drop(copies)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with `size` bytes of `column` at most, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches and their texts ("" for null); only a part's texts become strings at a time."""
    for batch in batches:
        for part in slices(batch, column):
            yield part, [x or "" for x in part.column(column).to_pylist()]


class Recent(dict):
    """What `make` gives for a key (bytes), kept for the keys used last: when a generation is full, the one before it goes."""

    def __init__(self, make: Callable[[bytes], object]):
        super().__init__()
        self.make, self.old, self.room = make, {}, CACHE_BYTES

    def __missing__(self, key: bytes):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self.room -= len(key) + ENTRY_BYTES
        if self.room < 0:
            self.old, self.room = dict(self), CACHE_BYTES
            self.clear()
        self[key] = out
        return out

    def empty(self) -> None:
        self.clear()
        self.old, self.room = {}, CACHE_BYTES


#: What empties the caches of this folder's modules.
CACHES: list[Callable[[], None]] = []


def lean(run: Callable) -> Callable:
    """`run` as a task that leaves nothing behind: Python workers serve other stages later, so caches are emptied and unused memory goes back when the rows end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    for empty in CACHES:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one closing 0x0A after each, and the places of those."""
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    return flat, ends


@functools.cache
def categories() -> np.ndarray:
    """First letter of the general category of every code point, as its ASCII code."""
    return np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)).encode(), np.uint8)


@functools.cache
def lower_table() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point, else itself."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and a 64-bit hash of each run of places that are `inside`; the hash is of the values in order."""
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    new = np.concatenate(([True], at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    place = (np.arange(len(at)) - np.repeat(first, length)).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = mix64((values[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F))
        return at[first], length, mix64(np.add.reduceat(each, first) + length.astype(np.uint64))
