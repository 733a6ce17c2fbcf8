"""Language of texts and of the spans of mixed texts.

Words are runs of letters. A word's score for a language is the sum of log-probabilities of its letter trigrams, hashed
to BUCKETS counts that the training texts of that language give. The script of a word, from code point ranges, narrows
the languages to those whose training texts use that script. A Viterbi path with a switching penalty labels the words.

The path is exact and needs few steps: a run of words with one best language, whose leads over the second best sum to
more than two penalties, keeps that language on every best path, so paths run between such runs only.

Training counts come from all rows given; the model holds languages x BUCKETS numbers. A text that is null or has no
letter has no span and the language "und" with score 0, as has every text if nothing was learned. Ties go to the
first language by name. A very long text is labelled whole, at some 100 bytes a code point. Repeated rows count and
are answered each. Rows keep their other columns; columns named like an output are dropped first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import categories, codepoints, lean, lower_table, mix64, text_batches, unreserved

BUCKETS, SMOOTHING = 1 << 16, 0.5
#: Nats that a change of language costs, and the share of a language's letters that make a script its own.
PENALTY, SCRIPT_SHARE = 8.0, 0.001
UNKNOWN = "und"

# First and last code points of scripts.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # log-probability by bucket and language
    allowed: np.ndarray  # whether a language uses a script, by script (0: any other) and language


@functools.cache
def script_table() -> np.ndarray:
    out = np.zeros(len(categories()), np.uint8)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            out[a : b + 1] = i
    return out


@functools.cache
def letter_table() -> np.ndarray:
    return categories() == ord("L")


def letters_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the letters, the trigram bucket of each, and which of them begin a word."""
    letter = letter_table()[flat]
    at = np.flatnonzero(letter)
    low = np.where(letter, lower_table()[flat], 0).astype(np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), low[:-1]))[at]
    after = np.concatenate((low[1:], np.zeros(1, np.uint64)))[at]
    bucket = (mix64((before << np.uint64(42)) | (low[at] << np.uint64(21)) | after) >> np.uint64(48)).astype(np.int64)
    return at, bucket, before == 0


def train_counts(df: DataFrame) -> DataFrame:
    """(text, lang) -> lang, slot, n: counts by bucket, then by script at BUCKETS and beyond."""
    width = BUCKETS + len(SCRIPTS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch, texts in text_batches(batches):
            flat, ends = codepoints(texts)
            at, bucket, _ = letters_of(flat)
            doc = np.searchsorted(ends, at)
            script = script_table()[flat[at]].astype(np.int64) + BUCKETS
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])[doc]
            for i, name in enumerate(names):
                own = code == i
                counts[name] = counts.get(name, 0) + np.bincount(bucket[own], minlength=width) + np.bincount(script[own], minlength=width)
        for name, n in counts.items():
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n[slot], pa.int64())], names=["lang", "slot", "n"])

    partial = df.select("text", "lang").mapInArrow(lean(run), "lang string, slot int, n bigint")
    return partial.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def learn(df: DataFrame) -> Model:
    """The model of all rows of (text, lang) with a language. What the driver gets is languages x buckets counts."""
    rows = train_counts(df.where("lang is not null")).groupBy("lang").agg(F.collect_list("slot").alias("slot"), F.collect_list("n").alias("n")).collect()
    rows = sorted((r for r in rows if r["slot"]), key=lambda r: r["lang"])
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(rows)))
    for i, r in enumerate(rows):
        counts[r["slot"], i] = r["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * scripts.sum(axis=0)
    allowed[~allowed.any(axis=1)] = True
    return Model([r["lang"] for r in rows], scores, allowed)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Labels of the elements of chains (start, length) that may share their ends; longest chains first, side by side."""
    labels = scores.argmax(axis=1)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n = len(scores)
    stay, source = np.zeros(scores.shape, bool), np.zeros(n, np.int64)
    steps = int(lengths[0]) if len(lengths) else 0
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps + 1)]  # chains longer than t
    path, final = scores[starts], np.zeros(len(starts), np.int64)
    for t in range(1, steps):
        k = live[t]
        if k < len(path):
            final[k : len(path)] = path[k:].argmax(axis=1)
        path = path[:k]
        at = starts[:k] + t
        best = path.argmax(axis=1)
        switch = path[np.arange(k), best][:, None] - PENALTY
        stay[at], source[at] = path >= switch, best
        path = np.maximum(path, switch) + scores[at]
    final[: len(path)] = path.argmax(axis=1)
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = starts[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = np.where(stay[at, now[:k]], now[:k], source[at])
    return labels


def label_words(scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The label of every word on its document's best path."""
    n = len(scores)
    if not n:
        return np.empty(0, np.int64)
    best = scores.argmax(axis=1)
    lead = np.full(n, np.inf)
    if scores.shape[1] > 1:
        two = np.partition(scores, -2, axis=1)[:, -2:]
        lead = (two[:, 1] - two[:, 0]).astype(np.float64)
    new = np.concatenate(([True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])))
    sure = (np.add.reduceat(lead, np.flatnonzero(new)) > 2 * PENALTY)[np.cumsum(new) - 1]
    new |= ~sure  # words outside such runs stand alone
    begin = np.flatnonzero(new)
    total = np.add.reduceat(scores, begin, axis=0, dtype=np.float64)
    run_best, run_doc, fixed = best[begin], doc[begin], sure[begin]
    total[fixed] -= 1e9
    total[fixed, run_best[fixed]] += 1e9
    first = np.concatenate(([True], run_doc[1:] != run_doc[:-1]))
    start = np.flatnonzero(first | fixed)
    stop = np.append(start[1:], len(begin))
    stop = stop + ((stop < len(begin)) & ~first[np.minimum(stop, len(begin) - 1)])  # up to and with the next fixed element of the text
    runs = viterbi(total, start, stop - start)
    return runs[np.cumsum(new) - 1]


def spans_of(texts: list[str], model: Model) -> tuple[np.ndarray, ...]:
    """Spans of one language: text number, first and last + 1 code point, language number, letters."""
    flat, ends = codepoints(texts)
    at, bucket, begins = letters_of(flat)
    first = np.flatnonzero(begins)
    if not len(first) or not model.languages:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    scores = np.add.reduceat(model.scores[bucket], first, axis=0)
    size = np.diff(np.append(first, len(at)))
    scores = np.where(model.allowed[script_table()[flat[at[first]]]], scores, scores.min(axis=1, keepdims=True) - 4 * PENALTY)
    doc = np.searchsorted(ends, at[first])
    label = label_words(scores, doc)
    new = np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])))
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(label)) - 1
    base = np.concatenate(([0], ends[:-1] + 1))[doc[begin]]
    return doc[begin], at[first[begin]] - base, at[first[last]] + size[last] - base, label[begin], np.add.reduceat(size, begin)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("letters", T.LongType())]))


def language_spans(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds spans: array of (start, end, lang, letters) in code points; `column` is kept."""
    df = df.drop(*[c for c in df.columns if c.lower() == "spans" and c != column])
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema, T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = pa.array(m.languages, pa.string())
        for batch, texts in text_batches(batches, column):
            doc, start, end, lang, letters = spans_of(texts, m)
            fields = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(lang, pa.int64())), pa.array(letters, pa.int64())]
            values = pa.StructArray.from_arrays(fields, names=["start", "end", "lang", "letters"])
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, "spans"])

    return df.mapInArrow(lean(run), schema)


def identified(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds spans, lang_pred, the language with most letters, and score, its share of the letters."""
    df = language_spans(unreserved(df, "__langid_", "lang_pred", "score"), model, column)

    def letters(language=None):
        own = F.col("spans") if language is None else F.filter("spans", lambda s: s["lang"] == language)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + s["letters"])

    shares = [F.struct(letters(x).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(model.languages)]
    top = F.when(F.size("spans") > 0, F.array_max(F.array(*shares))) if shares else F.lit(None).cast("struct<n:bigint,i:int,lang:string>")
    df = df.withColumn("__langid_top", top)
    score = F.col("__langid_top.n") / letters()
    return df.withColumn("lang_pred", F.coalesce("__langid_top.lang", F.lit(UNKNOWN))).withColumn("score", F.coalesce(score, F.lit(0.0))).drop("__langid_top")


def fold(column: str = "doc_id", folds: int = 3):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def digest(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (start:end:language, in order); learned from two thirds of the rows by the CRC of doc_id (a null id is held out)."""
    held_out = F.coalesce(fold() == 1, F.lit(True))
    model = learn(df.where(~held_out).select("text", "lang"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["lang"])), ",")
    return identified(df.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold() == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", spans.alias("spans"))
