import hashlib

import numpy as np
from pyspark.sql import functions as F

from fieldglass.llm import fingerprints


def brute_slots(text):
    """The slots of a text by the definition, k-mer by k-mer."""
    x, place = fingerprints.numbered_kmers(fingerprints.points_of(text))
    out = []
    for s in range(fingerprints.SLOTS):
        hashed = [(int(np.uint32(int(v) * int(fingerprints.MULTIPLY[s, 0]) + int(fingerprints.ADD[s, 0]) & 0xFFFFFFFF)), i) for i, v in enumerate(x)]
        least = sorted(hashed)[: fingerprints.TUPLE]
        out.append(tuple(int(x[i]) for _, i in sorted(least, key=lambda h: place[h[1]])))
    return out


def check(df):
    hashed = df.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] or "", r["_h"]) for r in hashed.collect()), key=lambda r: (r[0], r[1] or 0, r[3]))
    got = {}
    for r in df.transform(fingerprints.digest).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    marks = {}
    for k, (_, doc, text, _) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(new.encode()).hexdigest()
        r = next(r for r in got[doc] if r["edited_sha256"] == sha and r["n_chars"] == len(text))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert marks.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if new == text:
            assert r["near_edited"] == 1 and r["edited_fingerprint"] == r["fingerprint"]
        if after == text:
            assert r["near_next"] == 1


def test_whole_table(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert fingerprints.digest(none).collect() == []


def test_small_ranges(docs, monkeypatch):
    monkeypatch.setattr(fingerprints.range_starts, "__defaults__", (3,))
    check(docs.where("doc_id < 100"))


def test_slots_are_the_least_numbered_kmers_in_text_order():
    texts = ["abcabcabcabcabcabc and more abcabcabc", "short", "0123456789" * 20]
    slots = {t: brute_slots(t) for t in texts}
    for a in texts:
        for b in texts:
            mine = fingerprints.likeness(fingerprints.fingerprint(fingerprints.points_of(a)), fingerprints.fingerprint(fingerprints.points_of(b)))
            assert mine == np.mean([x == y for x, y in zip(slots[a], slots[b])])


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghij "), 2000))
    mark = lambda t: fingerprints.fingerprint(fingerprints.points_of(t))
    little, much = text[:1000] + "X" + text[1000:], text[1000:] + text[:1000]
    assert fingerprints.likeness(mark(text), mark(little)) > 0.8
    assert fingerprints.likeness(mark(text), mark(little)) > fingerprints.likeness(mark(text), mark(much))


def test_one_law_for_texts_of_any_size():
    """Texts just below and above the size at which places no longer fit beside hashes."""
    rng = np.random.default_rng(8)
    points = rng.integers(97, 123, (1 << 24) + 150).astype(np.uint32)
    small, large = points[: 1 << 24], points
    assert len(small) - fingerprints.K + 1 <= 1 << 24 < len(large) - fingerprints.K + 1
    assert fingerprints.likeness(fingerprints.fingerprint(small), fingerprints.fingerprint(large)) > 0.95


def test_repeated_ids_and_rows_are_spread_over_ranges(spark):
    rows = [(None, f"text number {i} without an id") for i in range(300)] + [(5, "one and the same row")] * 300 + [(7, f"text {i} of one id") for i in range(300)] + [(i, f"document {i}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    starts = fingerprints.range_starts(fingerprints.keyed(df), 20)
    ids = [int(np.frombuffer(x.ljust(24, b"\0"), ">u8")[0]) for x in starts.tolist()]
    assert max(ids.count(x) for x in set(ids)) > 8 and len(ids) > 30
    check(df)


def test_repeated_ids_in_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints.range_starts, "__defaults__", (5,))
    rows = [(i % 4 or None, f"{i % 30:02d} is the number of this text") for i in range(100)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))
