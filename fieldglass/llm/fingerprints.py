"""Order MinHash fingerprints of documents.

Every k-mer of a text (K code points) is numbered by its occurrence, so that repeated k-mers count as different. Each
of SLOTS hash functions selects the TUPLE numbered k-mers of the smallest hashes; they are put back in text order and
hashed as a tuple. Two texts agree in a slot about as often as they share k-mers in the same order, so moved or edited
parts lower the likeness. The likeness of two fingerprints is the share of slots that agree.

A text shorter than K is one k-mer; an empty text (or null) has a fingerprint of its own that is like no other text's.
Texts of any length are hashed by one law; a task holds two texts at a time besides a batch, and some 50 bytes for each
of their code points. Documents meet the next one by ranges of (doc_id, hashes of the text): rows go to ranges, the
first document of a range also goes to the range before it, and each task reads its range in order, so texts are moved
once. Range limits come from a sample, so a repeated id and null ids (they stand first) are spread over ranges like any
others. Rows of equal id stand in order of the xxhash64 of their texts. Rows equal in both are followed by one like them,
all but the last; they travel once a batch with their number, so that many of them burden no task. Keys depend on the
rows alone, not on how they are read. An empty table gives an empty result. Columns named like an output are dropped first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import combined, lean, mix64, repeated, text_batches, written

K, SLOTS, TUPLE = 8, 64, 2
#: Different rows that a range holds on average while there are fewer than MANY_RANGES (beyond, their number grows with the fourth root of the rows; a task reads its range row by row), rows of the sample for each range, and k-mers hashed at a time.
ROWS, MANY_RANGES, SAMPLE, CHUNK = 500, 20_000, 20, 1 << 12
#: Bits of a k-mer's hash that tell k-mers apart.
MARK_BITS = 40

_RNG = np.random.default_rng(77)
MULTIPLY = (_RNG.integers(0, 1 << 32, SLOTS, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
ADD = _RNG.integers(0, 1 << 32, SLOTS, np.uint64).astype(np.uint32)[:, None]
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def numbered_kmers(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the k-mers with their occurrence numbers, and the places of the k-mers, in order of their hashes."""
    n = len(points) - K + 1
    with np.errstate(over="ignore"):
        if n < 1:
            acc, n = np.uint64(len(points) + 1), 1
            for p in points:
                acc = mix64(np.array([acc * GOLDEN + np.uint64(p)], np.uint64))[0]
            h = np.array([acc], np.uint64)
        else:
            h, step = points.astype(np.uint64), 1
            while step < K:  # windows of 1, 2, 4, 8 code points
                h = h[:-step] * GOLDEN + h[step:]
                h ^= h >> np.uint64(29)
                step *= 2
            h = mix64(h)
        mark = h >> np.uint64(64 - MARK_BITS)
        if n <= 1 << (64 - MARK_BITS):  # hash and place fit into one number, which sorts faster than two
            key = np.sort((mark << np.uint64(64 - MARK_BITS)) | np.arange(n, dtype=np.uint64))
            place = (key & np.uint64((1 << (64 - MARK_BITS)) - 1)).astype(np.int64)
        else:
            place = np.argsort(mark, kind="stable")
        mark = mark[place]
        first = np.concatenate(([True], mark[1:] != mark[:-1]))
        begin = np.flatnonzero(first)
        number = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        numbered = mark if not number.any() else mark + number.astype(np.uint64) * GOLDEN
        return (mix64(numbered * GOLDEN) >> np.uint64(32)).astype(np.uint32), place


def fingerprint(points: np.ndarray) -> np.ndarray:
    """The slots of a text's code points, 16 bits each."""
    if not len(points):
        return np.zeros(SLOTS, np.uint16)
    x, place = numbered_kmers(points)
    value = np.full((SLOTS, TUPLE), 1 << 32, np.uint64)
    at = np.zeros((SLOTS, TUPLE), np.int64)
    every = np.arange(SLOTS)
    with np.errstate(over="ignore"):
        for begin in range(0, len(x), CHUNK):
            part = x[begin : begin + CHUNK]
            hashed = MULTIPLY * part + ADD
            values, places = [value], [at]
            for _ in range(min(TUPLE, len(part))):
                i = hashed.argmin(axis=1)
                values.append(hashed[every, i].astype(np.uint64)[:, None])
                places.append((i + begin)[:, None])
                hashed[every, i] = 0xFFFFFFFF
            value, at = np.hstack(values), np.hstack(places)
            order = np.argsort(value, axis=1, kind="stable")[:, :TUPLE]
            value, at = np.take_along_axis(value, order, 1), np.take_along_axis(at, order, 1)
        missing = value == 1 << 32
        order = np.argsort(np.where(missing, np.iinfo(np.int64).max, place[at]), axis=1, kind="stable")
        picked = np.where(missing, np.uint64(1), x[at].astype(np.uint64) + np.uint64(2))
        picked = np.take_along_axis(picked, order, 1)
        out = np.arange(1, SLOTS + 1, dtype=np.uint64)
        for j in range(TUPLE):
            out = mix64(out * GOLDEN + picked[:, j])
    return (out >> np.uint64(48)).astype(np.uint16) | np.uint16(1)  # never the empty text's


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(points: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The last half of the code points replaced by as many first ones of the next text, or all."""
    half = len(points) // 2
    return np.concatenate((points[: len(points) - half], after[:half]))


def keyed(df: DataFrame) -> DataFrame:
    """Rows with the key of their order: _k (doc_id; null stands first), _h and _g (two hashes of the text). Rows with one key are equal, so the key is the same however often rows are read."""
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g"))


KEY = ["_k", "_h", "_g"]


def sortable(k: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Keys as strings of 24 bytes in the same order."""
    parts = np.stack([np.asarray(x, np.int64) for x in (k, h, g)], axis=1)
    return np.ascontiguousarray((parts.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")).view("S24").ravel()


def range_starts(df: DataFrame, rows: int = ROWS) -> np.ndarray:
    """The smallest key of each range of about `rows` different keys, in order: some SAMPLE keys a range come to the driver. Keys are written once, in a few bytes a row."""
    keys = written(df.select(*KEY).distinct())
    n = keys.count()
    parts = min(-(-n // rows), int(MANY_RANGES * max(1.0, n / (rows * MANY_RANGES)) ** 0.25))
    if not parts:
        return np.empty(0, "S24")
    share = max(1, n // (parts * SAMPLE))
    some = keys.where(F.pmod(F.xxhash64(F.lit(3), *KEY), F.lit(share)) == 0).toPandas()
    sample = np.sort(sortable(*(some[c] for c in KEY)))
    splits = np.unique(sample[np.arange(1, parts) * len(sample) // parts]) if len(sample) else np.empty(0, "S24")
    starts = keys.groupBy(_part(splits)(*KEY).alias("part")).agg(F.min(F.struct(*KEY)).alias("s")).select("s.*").toPandas()
    return np.sort(sortable(*(starts[c] for c in KEY)))


def _part(splits: np.ndarray):
    @F.pandas_udf("int")
    def part(k: pd.Series, h: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, sortable(k, h, g), "right").astype(np.int32))

    return part


def sent(docs: DataFrame, starts: np.ndarray) -> DataFrame:
    """Rows with place: 2 * their range; and, for the first key of a range, also 2 * the range before it + 1 (the first follows the last). Equal rows of a batch go once, with their number."""
    schema = T.StructType([*docs.schema, T.StructField("copies", T.LongType()), T.StructField("place", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = combined(whole, KEY, "copies")
            key = sortable(*(batch.column(c).to_numpy() for c in KEY))
            part = np.searchsorted(starts, key, "right") - 1
            begins = np.flatnonzero(starts[part] == key)
            for rows, place in ((batch, 2 * part), (batch.take(pa.array(begins)), 2 * ((part[begins] - 1) % len(starts)) + 1)):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(place, pa.int32())], names=schema.names)

    return docs.mapInArrow(run, schema)


class Pairs:
    """Results of documents against what follows them, gathered for the next batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, held: tuple, points: np.ndarray, print_: np.ndarray, copies: int) -> None:
        doc, was, mark = held[:3]
        new = edited(was, points)
        other = fingerprint(new)
        raw = new.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        marks = [x.astype(">u2").tobytes().hex() for x in (mark, other)]
        self.rows.append((doc, len(was), hashlib.sha256(raw).hexdigest(), *marks, likeness(mark, other), likeness(mark, print_), copies))

    def batch(self) -> pa.RecordBatch:
        columns, self.rows = list(zip(*self.rows)) or [()] * 8, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*NAMES, "copies"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their range: every document against its edited text and the next document. All but the last of equal rows are followed by one like them."""
    held, part = None, None  # id, points, fingerprint, key and number of the document that waits for the next one
    out = Pairs()
    for batch, texts in text_batches(batches):
        keys = zip(*(batch.column(c).to_pylist() for c in KEY))
        for place, doc, copies, key, text in zip(batch.column("place").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("copies").to_pylist(), keys, texts):
            if held is None and place & 1:
                continue
            if held is not None and part == place >> 1 and held[3] == key and not place & 1:
                held = (*held[:4], held[4] + copies)
                continue
            points = points_of(text)
            print_ = fingerprint(points)
            if held is not None and part == place >> 1:
                if held[4] > 1:
                    out.add(held, held[1], held[2], held[4] - 1)
                out.add(held, points, print_, 1)
            held, part = (None if place & 1 else (doc, points, print_, key, copies)), place >> 1
        yield out.batch()


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digest(df: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to the edited text and to the next document."""
    docs = keyed(df)
    starts = range_starts(docs)
    if not len(starts):
        return docs.sparkSession.createDataFrame([], SCHEMA)
    placed = sent(docs, starts).withColumn("_range", F.shiftright("place", 1)).repartition("_range").sortWithinPartitions("place", *KEY)
    return repeated(placed.select("place", "doc_id", "copies", *KEY, "text").mapInArrow(lean(_compared), f"{SCHEMA}, copies bigint"), "copies")


def fingerprints(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds fingerprint (hexadecimal) to every row."""
    kept = [c for c in df.columns if c.lower() != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, column):
            marks = [fingerprint(points_of(t)).astype(">u2").tobytes().hex() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(marks, pa.string())], names=[*kept, "fingerprint"])

    return df.select(*kept).mapInArrow(lean(run), T.StructType([*df.select(*kept).schema, T.StructField("fingerprint", T.StringType())]))
