"""Language-model scores of texts: a weighted backoff automaton over smoothed word n-grams.

States are the n-grams of fewer than ORDER words that occur in training texts; an arc of a state is an n-gram with one
word more, and a failure arc with a weight leads to the state without its first word. Probabilities are smoothed by
P(w | c) = (n(c w) + MU * P(w | c')) / (n(c) + MU), c' being c without its first word; for words alone
P(w) = (n(w) + 0.5) / (N + 0.5 * (V + 1)). A failure arc thus weighs MU / (n(c) + MU). One traversal from left to right
carries the state of each text and adds up log10 probabilities; long texts are cut into pieces that start in the state
in which the piece before ends, so that many pieces are traversed side by side.

The model grows with the corpus and is never in one place. Texts go to blocks of bounded size by a hash. A block sends
its distinct n-grams, with their counts in training texts, to buckets by their hashes; a bucket adds them up over all
blocks and answers each block with the totals of its own n-grams, in its own order. From those a block has the part of
the automaton that its texts can reach. A frequent word is one n-gram a block, so no key is hot. Buckets grow with the
square root of the blocks, so B blocks exchange SPREAD * B^1.5 messages (each of many n-grams), not B^2; a bucket then
holds sqrt(B) / SPREAD blocks' n-grams of one length at a time: some 100 MB for 30 GB of text, 600 MB for a TB.

Texts travel to their blocks in compressed packs, n-grams as compressed differences of sorted keys.

Words are told apart by 64 bits of hash, longer n-grams by 40 bits within their bucket. A null text counts as empty, an
empty text is its end alone. A null id is held out. Without training texts N and V are 0. Every row gets a row;
repeated rows count each, though equal ones travel once a batch with their number, so that many of them burden no block.
An empty table gives an empty result. Of texts only tokens matter, ties don't exist. Columns named like an output, or
with the prefix __lm_ of work columns, are dropped first; all others stay.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import codepoints, combined, mix64, repeated, run_hashes, written

#: Words of an n-gram at most, and the weight of the shorter context for n-grams of two and more words.
ORDER, MU = 3, {2: 30.0, 3: 10.0}
#: Bytes of text that a block holds on average, buckets for the square root of the blocks, and tokens of a piece.
BLOCK_BYTES, SPREAD, PIECE = 4_000_000, 8, 2_048

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
KEY_BITS = 40
#: Two hashes of a whole row, by which equal rows are told.
ROW = ["__lm_row", "__lm_row2"]


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and the number of tokens of each text."""
    flat, ends = codepoints(texts)
    low = flat + np.where((flat >= 65) & (flat <= 90), 32, 0).astype(np.uint32)
    begin, _, word = run_hashes(low, (flat != 32) & ((flat < 9) | (flat > 13)))
    doc = np.searchsorted(ends, begin)
    count = np.bincount(doc, minlength=len(texts)) + 1
    out = np.full(len(word) + len(texts), END, np.uint64)
    out[np.arange(len(word)) + doc] = word
    return out, count


def ngram_keys(tokens: np.ndarray, count: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, of one word up to `order`; before a text stand START tokens."""
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(count) - count] = True
    keys = [tokens]
    start = START
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            before = np.concatenate((np.zeros(1, np.uint64), keys[-1][:-1]))
            before[first] = start
            keys.append(mix64(before * GOLDEN + tokens + np.uint64(n)))
            start = mix64(np.array([start * GOLDEN + START], np.uint64))[0]
    return keys


class Ngrams:
    """The distinct n-grams of one length in a block, in order of bucket, then of the part of the key that travels."""

    def __init__(self, keys: np.ndarray, buckets: int, n: int):
        unique, where = np.unique(keys, return_inverse=True)
        bucket = ((unique >> np.uint64(KEY_BITS)) % np.uint64(buckets)).astype(np.int64)
        short = unique if n == 1 else unique & np.uint64((1 << KEY_BITS) - 1)
        order = np.lexsort((short, bucket))
        self.keys, self.bucket = short[order], bucket[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.where = place[where.ravel()]  # of each token's n-gram

    def parts(self, buckets: int) -> np.ndarray:
        return np.searchsorted(self.bucket, np.arange(buckets + 1))


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all first bytes first, compressed."""
    wide = np.ascontiguousarray(x.astype("<u8"))
    used = max(1, -(-int(wide.max()).bit_length() // 8)) if len(wide) else 1
    return bytes([used]) + zlib.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


def packs(rows: DataFrame) -> DataFrame:
    """Rows with __lm_block as (__lm_block, pack): the rows of a batch that go to one block, as one compressed Arrow stream. Rows of a batch that are equal go once, with their number in __lm_copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for whole in batches:
            batch = combined(whole, ["__lm_block", *ROW], "__lm_copies")
            block = batch.column("__lm_block").to_numpy()
            order = np.argsort(block, kind="stable")
            begin = np.flatnonzero(np.diff(block[order], prepend=-1))
            sorted_ = batch.take(pa.array(order)).drop_columns(["__lm_block"])
            data = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, sorted_.schema, options=options) as out:
                    out.write_batch(sorted_.slice(a, b - a))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[order[begin]], pa.int32()), pa.array(data, pa.binary())], names=["__lm_block", "pack"])

    return rows.mapInArrow(run, "__lm_block int, pack binary")


def _opened(table: pa.Table) -> pa.Table:
    """The rows of a block's packs, equal ones once; packs are opened one after the other."""
    at: dict[tuple[int, int], int] = {}
    kept, copies = [], []
    for pack in table.column("pack"):
        rows = pa.ipc.open_stream(pack.as_buffer()).read_all()
        new = []
        for i, (*key, n) in enumerate(zip(*(rows.column(c).to_pylist() for c in (*ROW, "__lm_copies")))):
            place = at.setdefault(tuple(key), len(copies))
            if place == len(copies):
                copies.append(0)
                new.append(i)
            copies[place] += n
        kept.append(rows.take(pa.array(new, pa.int64())) if len(new) < len(rows) else rows)
    rows = pa.concat_tables(kept)
    return rows.set_column(rows.schema.get_field_index("__lm_copies"), "__lm_copies", pa.array(copies, pa.int64()))


def _texts(table: pa.Table) -> list[str]:
    return [x or "" for x in table.column("__lm_text").to_pylist()]


def totals(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    """(block, bucket, totals, tokens, kinds): for each block the totals of its n-grams in training texts; tokens and kinds of a bucket stand once."""

    def ask(table: pa.Table) -> pa.Table:
        rows = _opened(table)
        tokens, count = tokens_of(_texts(rows))
        train = np.repeat(np.where(rows.column("__lm_train").to_numpy(), rows.column("__lm_copies").to_numpy(), 0), count)
        grams = [Ngrams(k, buckets, n) for n, k in enumerate(ngram_keys(tokens, count, order), 1)]
        counts = [np.bincount(g.where, train, len(g.keys)).astype(np.int64) for g in grams]
        parts = [g.parts(buckets) for g in grams]
        some = [b for b in range(buckets) if any(p[b + 1] > p[b] for p in parts)]
        keys = [[_packed(g.keys[p[b] : p[b + 1]]) for g, p in zip(grams, parts)] for b in some]
        own = [[_planes(c[p[b] : p[b + 1]]) for c, p in zip(counts, parts)] for b in some]
        block = table.column("__lm_block")[0].as_py()
        columns = [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int32()), pa.array(keys, pa.list_(pa.binary())), pa.array(own, pa.list_(pa.binary()))]
        return pa.table(columns, names=["bucket", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        blocks_, keys, counts = (table.column(c).to_pylist() for c in ("block", "keys", "counts"))
        sums: list[list[bytes]] = [[] for _ in blocks_]
        tokens = kinds = 0
        for n in range(order):
            own = [_unpacked(k[n]) for k in keys]
            unique, where = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(where.ravel(), np.concatenate([_numbers(c[n]) for c in counts]), len(unique)).astype("<i8")
            if n == 0:
                tokens, kinds = int(total.sum()), int((total > 0).sum())
            back, begin = total[where.ravel()], 0
            for i, k in enumerate(own):
                sums[i].append(_planes(back[begin : begin + len(k)]))
                begin += len(k)
        once = lambda x: pa.array([x] + [0] * (len(blocks_) - 1), pa.int64())
        columns = [pa.array(blocks_, pa.int32()), table.column("bucket"), pa.array(sums, pa.list_(pa.binary())), once(tokens), once(kinds)]
        return pa.table(columns, names=["block", "bucket", "totals", "tokens", "kinds"])

    asked = blocks.groupBy("__lm_block").applyInArrow(ask, "bucket int, block int, keys array<binary>, counts array<binary>")
    return asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, totals array<binary>, tokens bigint, kinds bigint")


def traverse(counts: list[np.ndarray], arcs: list[np.ndarray], failures: list[np.ndarray], count: np.ndarray) -> np.ndarray:
    """log10 probability of each text. By n-gram length: the total of each token's n-gram, the weight of its arc and of the failure arc of the state before it."""
    order = len(counts)
    known = np.zeros(len(counts[0]), np.int64)  # words of the longest n-gram that ends at a token
    for n in range(order):
        known = np.where(counts[n] > 0, n + 1, known)
    first = np.cumsum(count) - count
    pieces = -(-count // PIECE)
    doc = np.repeat(np.arange(len(count)), pieces)
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[doc] + step * PIECE
    length = np.minimum(PIECE, first[doc] + count[doc] - start)
    sort = np.argsort(-length, kind="stable")
    doc, step, start, length = doc[sort], step[sort], start[sort], length[sort]
    state = np.where(step > 0, known[np.maximum(start - 1, 0)], order - 1)  # a text begins in the state of START tokens
    state = np.minimum(state, order - 1)
    total = np.zeros(len(doc))
    for t in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, "left"))
        at, state = start[:live] + t, state[:live]
        gain, done = np.zeros(live), np.zeros(live, bool)
        after = np.zeros(live, np.int64)
        for n in range(order - 1, -1, -1):  # from states of n words; those without the arc fail to the next
            here = (state >= n) & ~done
            take = here & ((counts[n][at] > 0) | (n == 0))
            gain += np.where(take, arcs[n][at], np.where(here, failures[n][at], 0.0))
            after = np.where(take & (counts[n][at] > 0), min(n + 1, order - 1), after)
            done |= take
        total[:live] += gain
        state = after
    return np.bincount(doc, total, len(count))


def scores(tokens: np.ndarray, count: np.ndarray, totals_: list[np.ndarray], all_tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and score of each text, from the totals of the n-grams at each token."""
    first = np.cumsum(count) - count
    begins = np.zeros(len(tokens), bool)
    begins[first] = True
    p = (totals_[0] + 0.5) / (all_tokens + 0.5 * (kinds + 1))
    texts = totals_[0][tokens == END]
    texts = int(texts[0]) if len(texts) else 0  # as many training texts as ends
    arcs, failures = [np.log10(p)], [np.zeros(len(tokens))]
    for n in range(1, len(totals_)):
        context = np.concatenate((np.zeros(1, np.int64), totals_[n - 1][:-1]))
        context[begins] = texts
        mu = MU[n + 1]
        p = (totals_[n] + mu * p) / (context + mu)
        arcs.append(np.log10(p))
        failures.append(np.log10(mu / (context + mu)))
    known = np.add.reduceat((totals_[0] > 0).astype(np.int64), first)
    return known, np.add.reduceat(arcs[0], first), traverse(totals_, arcs, failures, count)


def scored(df: DataFrame, train: Column, column: str = "text", order: int = ORDER) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to every row; `column` is dropped. The rows for which `train` holds give the counts."""
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in df.columns if c.lower() not in new and c != column and not c.lower().startswith("__lm_")]
    rows = df.select(*kept, F.col(column).alias("__lm_text"), F.coalesce(train, F.lit(False)).alias("__lm_train"))
    rows = rows.withColumn(ROW[0], F.xxhash64(*kept, "__lm_text", "__lm_train")).withColumn(ROW[1], F.xxhash64("__lm_text", "__lm_train", *kept, F.lit(1)))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("__lm_text"), F.lit(0)) + 8)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    buckets = min(blocks, math.ceil(SPREAD * math.sqrt(blocks)))
    rows = rows.withColumn("__lm_block", F.pmod(F.col(ROW[0]), F.lit(blocks)).cast("int"))
    answers = written(totals(packs(rows.select("__lm_block", *ROW, "__lm_text", "__lm_train")), buckets, order))
    all_tokens, kinds = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("kinds")).first())
    out = rows.select(*kept).schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double").add("__lm_copies", "long")

    def run(_, packed: pa.Table, replies: pa.Table) -> pa.Table:
        texts = _opened(packed)
        tokens, count = tokens_of(_texts(texts))
        replies = replies.sort_by("bucket").column("totals").to_pylist()
        at = []
        for n, keys in enumerate(ngram_keys(tokens, count, order)):
            total = np.concatenate([_numbers(r[n]) for r in replies]).astype(np.int64)
            at.append(total[Ngrams(keys, buckets, n + 1).where])
        known, base, score = scores(tokens, count, at, all_tokens, kinds)
        columns = [pa.array(count.astype(np.int64)), pa.array(known), pa.array(np.full(len(count), all_tokens)), pa.array(base), pa.array(score), texts.column("__lm_copies")]
        return pa.table([texts.column(c) for c in kept] + columns, names=[*kept, *new, "__lm_copies"])

    scored_ = packs(rows.select("__lm_block", *ROW, "__lm_text", *kept)).groupBy("__lm_block").cogroup(answers.select("block", "bucket", "totals").groupBy("block")).applyInArrow(run, out)
    return repeated(scored_, "__lm_copies")


def digest(df: DataFrame) -> DataFrame:
    """Scores of every text by the model of those whose id's CRC is not 1 modulo 5."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))
    out = scored(df.select("doc_id", "text", held_out.alias("held_out")), ~held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
