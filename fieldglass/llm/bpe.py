"""Byte-level BPE encoding and decoding with a given rank file.

Pre-tokens are found without a regular expression. Every code point gets a symbol (letter, number, other,
white space by what follows, apostrophe of a contraction); each symbol acts on the states of a small automaton.
The functions that symbols generate under composition form a finite set, so that a prefix composition over a whole
batch is a lookup in a two-dimensional table: blocks are scanned side by side, then the blocks' totals, then both are
composed. The slices between boundaries go through a cache of merged pairs.

Null text counts as empty; an empty text has no tokens. Texts of any length are encoded whole: a long one goes through
in pieces, cut where a slice begins whatever stands before; a very long slice is merged with a heap. A row's result depends on
its text alone: repeated rows give repeated rows, of equal merges the leftmost comes first, an empty table gives an empty one. Rows keep their other columns. Columns named like an output replace nothing: they are dropped first.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, Recent, categories, codepoints, lean, slices, text_batches

#: Code points of a piece of a long text, about, and tokens decoded at a time.
PIECE, TOKENS = 1 << 18, 1 << 16

# Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
CONTRACTIONS = ["s", "t", "m", "d", "re", "ve", "ll"]

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_RUN, SPACE_JOINS, SPACE_ALONE, END = range(9)
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_SPACE, ONE_MORE, TWO_MORE, FRESH = range(8)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at the symbol."""
    if symbol == END:
        return FRESH, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if symbol in (LETTER, NUMBER):
        own = IN_LETTERS if symbol == LETTER else IN_NUMBERS
        return own, state not in (own, AFTER_SPACE)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE}[symbol], True
    if symbol == SPACE_RUN:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_SPACE if symbol == SPACE_JOINS else FRESH), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """compose[f, g] (f, then g) over the generated functions, apply[f, state], begins[state, symbol]. Functions 0 to 8 are the symbols'."""
    functions = [tuple(step(s, c)[0] for s in range(8)) for c in range(9)]
    # Two symbols may act alike; keys keep the first, ids stay distinct for the symbols.
    known = {f: i for i, f in reversed(list(enumerate(functions)))}
    todo = list(dict.fromkeys(functions))
    while todo:
        f = todo.pop()
        for g in functions[:9]:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
                todo.append(h)
    compose = np.array([[known.get(tuple(g[s] for s in f), 0) for g in functions] for f in functions], np.uint16)
    begins = np.array([[step(s, c)[1] for c in range(9)] for s in range(8)])
    return compose, np.array(functions, np.uint8), begins


@functools.cache
def kinds() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, by code point."""
    cat = categories()
    out = np.full(len(cat), 2, np.uint8)
    out[cat == ord("L")] = 0
    out[cat == ord("N")] = 1
    out[WHITE_SPACE] = 3
    return out


def symbols(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of every code point; `ends` are the places of the closing marks."""
    kind = kinds()[flat]
    kind[ends] = 4
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], 4
    out = kind.copy()
    space = kind == 3
    joins = space & (after < 3)
    out[space] = SPACE_RUN
    out[joins] = SPACE_ALONE
    out[joins & (flat == 0x20)] = SPACE_JOINS
    out[kind == 4] = END
    at = np.flatnonzero(flat == 0x27)
    at = at[at + 1 < len(flat)]
    for c in CONTRACTIONS:
        hit = at[flat[at + 1] == ord(c[0])]
        if len(c) == 2:
            hit = hit[hit + 2 < len(flat)]
            hit = hit[flat[hit + 2] == ord(c[1])]
        out[hit] = SHORT if len(c) == 1 else LONG
    return out


def boundaries(flat: np.ndarray, ends: np.ndarray, block: int = 128) -> np.ndarray:
    """Places where a slice begins; the closing marks are among them."""
    compose, apply, begins = automaton()
    symbol = symbols(flat, ends)
    n = len(symbol)
    lanes = -(-n // block)
    table = np.full(lanes * block, END, np.uint8)
    table[:n] = symbol
    table = np.ascontiguousarray(table.reshape(lanes, block).T)  # a row for each step, a column for each block
    width = len(compose)
    flat_compose = compose.ravel()
    prefix = np.empty(table.shape, np.uint16)
    prefix[0] = table[0]
    for i in range(1, block):
        prefix[i] = flat_compose[prefix[i - 1].astype(np.int32) * width + table[i]]
    state, entry = FRESH, np.empty(lanes, np.uint8)
    for j, f in enumerate(prefix[-1].tolist()):
        entry[j] = state
        state = int(apply[f, state])
    before = np.empty_like(table)
    before[0] = entry
    before[1:] = apply.ravel()[prefix[:-1].astype(np.int32) * 8 + entry]
    return np.flatnonzero(begins.ravel()[before * np.uint8(9) + table].T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair of the lowest rank, the leftmost of equals, is joined until none is known."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 40:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 60
    scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while scores and (best := min(scores)) < none:
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0 and after[k] < n and (r := ranks.get(piece[k : end[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@functools.cache
def cache_of(path: str) -> Recent:
    """Slice -> its ids as packed little-endian 32-bit integers."""
    ranks = load_ranks(path)

    def packed(piece: bytes) -> bytes:
        own = ranks.get(piece)
        return own.to_bytes(4, "little") if own is not None else np.array(merge(piece, ranks), "<u4").tobytes()

    return Recent(packed)


@functools.cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, and the start and length of each by id."""
    ranks = load_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    words = [b""] * size
    for word, i in ranks.items():
        words[i] = word
    lengths = np.fromiter(map(len, words), np.int64, size)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


CACHES += [load_ranks.cache_clear, cache_of.cache_clear, vocabulary.cache_clear]


def encode_texts(texts: list[str], path: str) -> tuple[list[bytes], list[bytes]]:
    """For each text its packed ids and the packed ends of the tokens in its UTF-8 bytes."""
    flat, ends = codepoints(texts)
    begins = boundaries(flat, ends)
    width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
    offset = np.concatenate(([0], np.cumsum(width)))
    raw = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
    at = offset[begins].tolist()
    at.append(len(raw))
    pieces = [raw[a:b] for a, b in zip(at, at[1:])]
    closing = np.searchsorted(begins, ends).tolist()  # each closing mark is a piece of its own
    packed = list(map(cache_of(path).__getitem__, pieces))
    lengths = vocabulary(path)[2]
    ids, stops, begin = [], [], 0
    for stop in closing:
        own = b"".join(packed[begin:stop])
        ids.append(own)
        stops.append(np.cumsum(lengths[np.frombuffer(own, "<u4")]).astype("<i4").tobytes())
        begin = stop + 1
    return ids, stops


def cuts(text: str) -> list[str]:
    """A long text in pieces. A single space between other characters begins a slice in every state, so pieces can be encoded one by one."""
    out, begin = [], 0
    while len(text) - begin > 2 * PIECE:
        at = begin + PIECE
        while (at := text.find(" ", at, len(text) - 1)) >= 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at += 1
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


def encode_whole(text: str, path: str) -> tuple[bytes, bytes]:
    """Packed ids and ends of one text, piece by piece."""
    ids, stops, done = [], [], 0
    for piece in cuts(text):
        (own,), (ends,) = encode_texts([piece], path)
        ids.append(own)
        stops.append((np.frombuffer(ends, "<i4") + np.int32(done)).astype("<i4").tobytes())
        done += len(piece.encode("utf-8", "surrogatepass"))
    return b"".join(ids), b"".join(stops)


def decode_ids(ids: list[bytes], stops: list[bytes], path: str) -> list[bytes]:
    """Bytes of each row of packed ids; the retained ends give every token's place in the result."""
    raw, start, length = vocabulary(path)
    out = []
    for a, b in zip(ids, stops):
        parts = []
        for i in range(0, len(a) // 4, TOKENS):
            token = np.frombuffer(a, "<u4")[i : i + TOKENS]
            end = np.frombuffer(b, "<i4")[i : i + TOKENS].astype(np.int64)
            size = length[token]
            end = end - (end[0] - size[0])  # the first of these tokens begins at 0
            source = np.repeat(start[token] - (end - size), size)
            source += np.arange(len(source))
            parts.append(raw[source].tobytes())
        out.append(b"".join(parts))
    return out


def _free(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def encode_part(texts: list[str], path: str) -> tuple[list[bytes], list[bytes]]:
    """Ids and ends of a part of a batch; a long text comes alone."""
    if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
        ids, stops = ([x] for x in encode_whole(texts[0], path))
        return ids, stops
    return encode_texts(texts, path)


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Adds n_tokens, token_ids (packed little-endian uint32) and token_ends (packed int32 byte ends) to every row; `column` is dropped."""
    df = _free(df, "n_tokens", "token_ids", "token_ends")
    kept = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("token_ends", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, column):
            ids, stops = encode_part(texts, path)
            new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(stops, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=[*kept, "n_tokens", "token_ids", "token_ends"])

    return df.select(*kept, column).mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Replaces token_ids and token_ends by `decoded`, the bytes they stand for; token_ids stay if asked for."""
    df = _free(df, "decoded")
    kept = [c for c in df.columns if c != "token_ends" and (keep_ids or c != "token_ids")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "token_ids"):
                out = decode_ids(batch.column("token_ids").to_pylist(), batch.column("token_ends").to_pylist(), path)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return df.mapInArrow(lean(run), schema)


def encode_decode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """`encode`, then `decode` of its ids, part by part in one worker a task: adds n_tokens, token_ids and decoded; `column` is dropped."""
    df = _free(df, "n_tokens", "token_ids", "decoded")
    kept = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, column):
            ids, stops = encode_part(texts, path)
            new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decode_ids(ids, stops, path), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=[*kept, "n_tokens", "token_ids", "decoded"])

    return df.select(*kept, column).mapInArrow(lean(run), schema)


def roundtrip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes decoded from them, for every row."""
    coded = encode_decode(df.select("doc_id", "text"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
