import base64
import hashlib
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldglass.llm import bpe
from fieldglass.llm.queries import RANKS

PATH = public_tokenizers.path(RANKS)


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(coder, text):
    ids = coder.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table_is_as_the_library_has_it(docs):
    coder = library()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = bpe.roundtrip(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(coder, texts[r["doc_id"]])


def test_odd_rows(odd, none):
    coder = library()
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.roundtrip(odd, PATH).collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"], *want(coder, r["text"])) for r in odd.collect())
    assert bpe.roundtrip(none, PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sStTrReEvVlLdDmM.1٣a  é"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=4))
def test_boundaries_of_any_text(texts):
    coder = library()
    ids, stops = bpe.encode_texts(texts, PATH)
    for text, own in zip(texts, ids):
        assert list(struct.unpack(f"<{len(own) // 4}I", own)) == coder.encode_ordinary(text)
    assert bpe.decode_ids(ids, stops, PATH) == [t.encode() for t in texts]


def test_long_texts_in_pieces(spark, monkeypatch):
    """Pieces of a long text, with contractions, runs of space and no space at all around the cuts, give the ids of the whole."""
    monkeypatch.setattr(bpe, "PIECE", 40)
    monkeypatch.setattr(bpe, "TOKENS", 7)
    coder = library()
    texts = ["it's  a\n\n  text we've 12 345 cut ' s anywhere d' here — and é ٣ there " * 30, "x" * 500, " " * 500, "a  b " * 100, "ends with a space " * 20]
    for text in texts:
        ids, stops = bpe.encode_whole(text, PATH)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == coder.encode_ordinary(text)
        assert stops == bpe.encode_texts([text], PATH)[1][0]
        assert bpe.decode_ids([ids], [stops], PATH) == [text.encode()]
    assert len(bpe.cuts(texts[0])) > 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.roundtrip(df, PATH).collect()) == [(i, *want(coder, t)) for i, t in enumerate(texts)]


def test_one_worker_a_task_encodes_and_decodes(odd, capsys):
    """Two Python steps in a row are two workers a task, each with the tables of ranks and its caches."""
    bpe.roundtrip(odd, PATH).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    both = {r["doc_id"]: (r["n_tokens"], r["token_ids"], r["decoded"]) for r in bpe.decode(bpe.encode(odd, PATH), PATH, keep_ids=True).collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["token_ids"], r["decoded"]) for r in bpe.encode_decode(odd, PATH).collect()} == both
