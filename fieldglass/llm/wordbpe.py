"""Word BPE encoding and decoding with a given tokenizer file: NFC, lower case, words, merges with word ends.

A word's symbols are its bytes, the last one marked as the word's end. Its ids are found without merging. Every token
has one merge that makes it; a token lives from that merge on until its own is due. Two neighbouring tokens fit if no
merge joins a part at the right edge of the first with a part at the left edge of the second while both live. The only
row of tokens whose neighbours all fit is what the merges would give, so a word is covered from left to right: an
Aho-Corasick automaton gives the longest token at every place in one pass, the next shorter one is tried where it does
not fit, and a place from which nothing fits is never tried again. Time is linear in the word. Tokens that the merges
themselves never reach are left out of the automaton. Ids of words used last are kept.

Decoding gathers the bytes of all tokens from one table by offsets; tokens are joined by one space, as there is no
decoder in the file. Strings of added tokens in a text become their ids.

Null text counts as empty; an empty text, or one of white space alone, has no ids and decodes to an empty text. Texts of
any length are encoded whole: a long one goes through in pieces, cut at spaces before ASCII characters, where neither
normal forms nor words reach across. A row's result depends on its text alone: repeated rows give repeated rows, ties
don't exist, an empty table gives an empty one. Rows keep their other columns; columns named like an output (and the
text column, in encoding) are dropped first.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WHITE_SPACE
from .common import CACHES, Recent, categories, lean, slices, text_batches

#: Code points of a piece of a long text, about, and tokens decoded at a time.
PIECE, TOKENS = 1 << 18, 1 << 16
#: Pairs of tokens whose compatibility is kept at a time.
MOST_PAIRS = 1 << 18
WORD_END = "</w>"
NEVER = 1 << 30

# Letters and numbers assigned after the interpreter's tables (Unicode 16), as first and last.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Lower case of capitals that the interpreter's tables don't have (Unicode 16 and 17).
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Marks that were given a combining class, or a composition, after the normal forms that the merges were made with; they stay in place there.
STEADY = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
NEW_CAPITAL = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")
STANDS = re.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in STEADY) + "])")
# What is cut off as a word of its own after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _ranges(inside: np.ndarray) -> str:
    """Code points where `inside` holds, as the ranges of a character class."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2).tolist())


@functools.cache
def word_pattern(plane: int = 17) -> re.Pattern:
    """Contractions, runs of letters, single numbers, runs of what is none of these nor white space, for texts of the first planes (a class of one plane is one bitmap)."""
    letter, number = categories() == ord("L"), categories() == ord("N")
    for table, new in ((letter, NEW_LETTERS), (number, NEW_NUMBERS)):
        for first, last in new:
            table[first : last + 1] = True
    other = ~(letter | number)
    other[WHITE_SPACE] = False
    letters, numbers, others = (_ranges(x[: plane << 16]) for x in (letter, number, other))
    return re.compile(f"[{letters}]+|'(?:{'|'.join(CONTRACTIONS)})|[{numbers}]|[{others}]+")


HIGH_PLANE = re.compile("[\U00010000-\U0010ffff]")


def words(text: str) -> list[str]:
    """The words of a normal text."""
    return word_pattern(17 if HIGH_PLANE.search(text) else 1).findall(text)


def normal(text: str) -> str:
    """NFC, then the lower case of each code point by itself (a sigma at a word's end too)."""
    if text.isascii():
        return text.lower()
    text = "".join(unicodedata.normalize("NFC", x) for x in STANDS.split(text)) if STANDS.search(text) else unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ")
    if NEW_CAPITAL.search(text):
        text = text.translate(NEW_LOWER)
    return text.lower()


class Vocabulary:
    """Tokens by id, the merges that make them, and what encoding looks up."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: chr(b) for b, c in enumerate(byte_characters())}
        self.names: list[str] = [""] * (1 + max([*spec["model"]["vocab"].values(), *[x["id"] for x in spec["added_tokens"]]], default=-1))
        for name, i in spec["model"]["vocab"].items():
            self.names[i] = name
        for x in spec["added_tokens"]:
            self.names[x["id"]] = x["content"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        ids, rank = spec["model"]["vocab"], {}
        self.made: dict[int, tuple[int, int]] = {}  # token -> the two that are merged into it
        self.joined: dict[tuple[int, int], int] = {}  # pair -> token
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = ids[a + b]
            rank[token], self.made[token], self.joined[ids[a], ids[b]] = n, (ids[a], ids[b]), token
        self.rank = rank
        ordered = sorted(ids.values(), key=lambda t: rank.get(t, -1))
        self.symbols: dict[int, str] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}  # token -> its parts at the left edge, each with the rank of the merge that ends it
        self.right: dict[int, list[tuple[int, int]]] = {}
        reached: set[int] = set()
        for t in ordered:
            whole = [(t, NEVER)]
            if t in self.made:
                a, b = self.made[t]
                if a not in reached or b not in reached:
                    continue
                self.symbols[t] = self.symbols[a] + self.symbols[b]
                until = lambda edge: [(x, rank[t] if end == NEVER else end) for x, end in edge]
                self.left[t], self.right[t] = whole + until(self.left[a]), whole + until(self.right[b])
                if self.crossing(a, b) != t:
                    continue
            else:
                name, end = self.names[t], 0
                if name.endswith(WORD_END):
                    name, end = name.removesuffix(WORD_END), 256
                self.symbols[t], self.left[t], self.right[t] = chr(ord(byte_of[name]) + end), whole, whole
            reached.add(t)
        self.fit: dict[int, bool] = {}  # pair of tokens -> whether no merge goes across their border; cleared when full
        self.length = {t: len(self.symbols[t]) for t in reached}
        self.own = own = {self.symbols[t]: t for t in reached}
        self.shorter = {t: next((own[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in own), -1) for s, t in own.items()}
        self.automaton = ahocorasick.Automaton()
        for s, t in own.items():
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()

    def crossing(self, a: int, b: int) -> int:
        """The token that the first merge across the border of a and b makes, or -1. Of equal merges the one further left comes first."""
        best, at = -1, NEVER
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                token = self.joined.get((x, y))
                if token is not None and (n := self.rank[token]) < x_ends and n <= y_ends and n < at:
                    best, at = token, n
        return best

    def cover(self, word: str) -> list[int]:
        """Ids of a word."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        symbols = raw[:-1] + chr(ord(raw[-1]) + 256)
        whole = self.own.get(symbols)
        if whole is not None:
            return [whole]
        size, length, shorter, fit = len(symbols), self.length, self.shorter, self.fit
        longest = [-1] * size
        for end, token in self.automaton.iter(symbols):  # ends ascend, so the last one of a place is the longest
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        fruitless = bytearray(size + 1)
        place, last, token = 0, -1, longest[0]
        while True:
            if token < 0:  # nothing fits here: the token before must be a shorter one
                fruitless[place] = 1
                token = out.pop()
                place -= length[token]
                last = out[-1] if out else -1
            elif not fruitless[place + length[token]]:
                key = last << 32 | token
                fits = last < 0 or fit.get(key)
                if fits is None:
                    if len(fit) >= MOST_PAIRS:
                        fit.clear()
                    fits = fit[key] = self.crossing(last, token) < 0
                if fits:
                    out.append(token)
                    place += length[token]
                    if place == size:
                        return out
                    last, token = token, longest[place]
                    continue
            token = shorter[token]


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, after = [], 256
    for b in range(256):
        out.append(chr(b if b in visible else after))
        after += b not in visible
    return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def cache_of(path: str) -> Recent:
    """Word -> its ids as packed little-endian 32-bit integers."""
    return Recent(lambda word: struct.pack(f"<{len(ids := vocabulary(path).cover(word))}I", *ids))


@functools.cache
def offsets(path: str, numbers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens (or of their ids in decimals), each with a space after it, end to end; start and length of each by id."""
    names = vocabulary(path).names
    words = [f"{i} ".encode() if numbers else f"{x} ".encode() if x else b"" for i, x in enumerate(names)]
    length = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length


CACHES += [vocabulary.cache_clear, cache_of.cache_clear, offsets.cache_clear]


def encode_text(text: str, path: str) -> bytes:
    """Packed ids of one text or piece."""
    known, cache = vocabulary(path), cache_of(path)
    if known.split is None:
        return b"".join(map(cache.__getitem__, words(normal(text))))
    parts = known.split.split(text)  # texts at even places, added tokens at odd ones
    return b"".join(known.added[x].to_bytes(4, "little") if i % 2 else b"".join(map(cache.__getitem__, words(normal(x)))) for i, x in enumerate(parts))


CUT = re.compile(r"[ ](?=[\x00-\x7F])")


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces that can be encoded one by one."""
    begin = 0
    while len(text) - begin > 2 * PIECE and (cut := CUT.search(text, begin + PIECE)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def gathered(ids: bytes, path: str, numbers: bool = False) -> bytes:
    """The tokens of packed ids (or the ids in decimals) with one space between them; ids that the file doesn't have give nothing."""
    raw, start, length = offsets(path, numbers)
    out = []
    for i in range(0, len(ids), 4 * TOKENS):
        token = np.frombuffer(ids[i : i + 4 * TOKENS], "<u4")
        token = token[token < len(length)]
        size = length[token]
        source = np.repeat(start[token] - (np.cumsum(size) - size), size)
        source += np.arange(len(source))
        out.append(raw[source].tobytes())
    return b"".join(out)[:-1]


def _free(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Adds n_tokens and token_ids (packed little-endian uint32) to every row; `column` is dropped."""
    df = _free(df, *{"n_tokens", "token_ids"} - {column.lower()})
    kept = [c for c in df.columns if c.lower() != column.lower()]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, column):
            ids = [b"".join(encode_text(x, path) for x in pieces(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*kept, "n_tokens", "token_ids"])

    return df.select(*kept, column).mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, numbers: bool = False) -> DataFrame:
    """Replaces token_ids by `decoded`, the text that they stand for; with `numbers` also adds ids_text, the ids in decimals."""
    new = ["decoded", "ids_text"][: 1 + numbers]
    df = _free(df, *new)
    kept = [c for c in df.columns if c.lower() != "token_ids"]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "token_ids"):
                ids = [x or b"" for x in batch.column("token_ids").to_pylist()]
                made = [pa.array([gathered(x, path, bool(n)) for x in ids], pa.binary()).cast(pa.string()) for n in range(len(new))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=[*kept, *new])

    return df.mapInArrow(lean(run), schema)


def roundtrip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids in decimals and of the text decoded from them, for every row."""
    out = decode(encode(df.select("doc_id", "text"), path), path, numbers=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
