import math
import re
import zlib
from collections import Counter

import numpy as np

from fieldglass.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute(rows, order=lm.ORDER):
    """By id and text, (held_out, tokens, known, N, base, score), with dictionaries of n-grams."""
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    grams, contexts = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if train(i):
            s = ["<s>"] * (order - 1) + words(t) + ["</s>"]
            for j in range(order - 1, len(s)):
                for n in range(1, order + 1):
                    grams[n][tuple(s[j - n + 1 : j + 1])] += 1
                    contexts[n][tuple(s[j - n + 1 : j])] += 1
    total, kinds = sum(grams[1].values()), len(grams[1])
    out = {}
    for i, t in rows:
        s = ["<s>"] * (order - 1) + words(t) + ["</s>"]
        base = score = 0.0
        for j in range(order - 1, len(s)):
            p = (grams[1][(s[j],)] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                p = (grams[n][tuple(s[j - n + 1 : j + 1])] + lm.MU[n] * p) / (contexts[n][tuple(s[j - n + 1 : j])] + lm.MU[n])
            score += math.log10(p)
        out[i, t] = (not train(i), len(s) - order + 1, sum(grams[1][(w,)] > 0 for w in s[order - 1 :]), total, base, score)
    return out


def check(df, rows):
    texts = dict(rows)
    want = brute(rows)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"], texts[r["doc_id"]]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        np.testing.assert_allclose([r["base_score"], r["score"]], w[4:], rtol=1e-9)
    return got


def test_whole_table_against_brute_force(docs):
    got = check(lm.digest(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(odd, none):
    check(lm.digest(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert lm.digest(none).collect() == []


def test_many_blocks_and_pieces(odd, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm, "PIECE", 7)
    check(lm.digest(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_fewer_buckets_than_blocks(docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "SPREAD", 1)
    few = docs.where("doc_id < 150")
    check(lm.digest(few), [(r["doc_id"], r["text"]) for r in few.collect()])
