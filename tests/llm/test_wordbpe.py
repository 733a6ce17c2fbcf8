import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldglass.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = b"".join(wordbpe.encode_text(x, PATH) for x in wordbpe.pieces(text))
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert wordbpe.gathered(ids, PATH).decode() == library.decode(want.ids, skip_special_tokens=False)
        assert wordbpe.gathered(ids, PATH, True).decode() == " ".join(map(str, want.ids))


def check(rows, docs, library):
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))


def test_whole_table(docs, library):
    check(wordbpe.roundtrip(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)


def test_odd_rows(odd, none, library):
    check(wordbpe.roundtrip(odd, PATH).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], library)
    assert wordbpe.roundtrip(none, PATH).collect() == []


def test_clashing_columns_stay_or_go(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", "z", "w")], "doc_id bigint, text string, N_TOKENS string, token_ids string, decoded string, other string")
    out = wordbpe.decode(wordbpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "other", "n_tokens", "decoded"] and tuple(out.first()) == (1, "w", 2, "a</w> b</w>")


@pytest.mark.parametrize("alphabet", ["ab", "aA b'", "the in g", "abcdefghijklmnopqrstuvwxyz ", "'stremvld a1!", "".join(map(chr, range(1, 0x250))), "日本語のテ中文字 ", "ΣσΑα İi̇́e ", "\x1c\x1d\x85 \xa0 a"])
def test_random_texts(library, alphabet):
    rng = random.Random(4)
    same(library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)])


def test_all_of_unicode(library):
    rng = random.Random(5)
    same(library, ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(30)) for _ in range(4000)])
    new = [c for pair in wordbpe.NEW_LETTERS + wordbpe.NEW_NUMBERS + wordbpe.STEADY for c in pair] + list(wordbpe.NEW_LOWER) + [0x11935, 0x61, 0x301, 0x323]
    same(library, ["".join(chr(rng.choice(new)) for _ in range(8)) for _ in range(4000)])


def test_added_tokens_and_all_names(library):
    same(library, ["a<|endoftext|>b <|startoftext|><|endoftext|> e<|endoftext|>́", "<|endof", "<|ENDOFTEXT|>"])
    with open(PATH) as file:
        same(library, [x.replace("</w>", " ") for x in json.load(file)["model"]["vocab"]])


def test_very_long_texts(library, monkeypatch):
    same(library, ["x" * 5000, "ab" * 30000, "many words " * 60000])
    monkeypatch.setattr(wordbpe, "PIECE", 5)
    rng = random.Random(6)
    same(library, ["".join(rng.choice("ab ẹ́́ '1") for _ in range(400)) for _ in range(200)])


def test_neighbours_that_fit_are_the_merges(library):
    """Two tokens fit exactly if the library leaves the row of both as it is."""
    known = wordbpe.vocabulary(PATH)
    rng = random.Random(7)
    inner = [t for t in known.length if not known.names[t].endswith(wordbpe.WORD_END) and known.names[t].isascii() and known.names[t].isalpha() and known.names[t].islower()]
    ends = [t for t in known.length if known.names[t].endswith(wordbpe.WORD_END) and known.names[t][:-4].isascii() and known.names[t][:-4].isalpha() and known.names[t][:-4].islower()]
    for _ in range(5000):
        a, b = rng.choice(inner), rng.choice(ends)
        ids = library.encode(known.names[a] + known.names[b][:-4], add_special_tokens=False).ids
        assert (ids == [a, b]) == (known.crossing(a, b) < 0)


def test_pair_table_is_cleared_when_full(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "MOST_PAIRS", 3)
    wordbpe.cache_of(PATH).empty()
    same(library, ["unheard of combinations of lettergroups zzxqy"])


def test_unknown_ids_give_nothing():
    assert wordbpe.gathered(np.array([320, 1 << 20, 320], "<u4").tobytes(), PATH) == wordbpe.gathered(np.array([320, 320], "<u4").tobytes(), PATH)
