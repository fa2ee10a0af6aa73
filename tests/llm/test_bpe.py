import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from declgraph.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = bpe.tokenizer(PATH, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def same(both, text):
    ids = both[1].encode_ordinary(text)
    packed = both[0].encode(text)
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert both[0].decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(["th", "ing", " ", "a", "aa", "é", "ü", "日本", "\n", "1", "²", "\x1c", "'ll", "%%", "  \n", "\xa0"]), max_size=40))
def test_mixed_pieces(both, parts):
    same(both, "".join(parts))


def test_long_pieces(both):
    for text in ("a" * 5000, "ab" * 4000, " " * 9000, "é" * 3000, "abcdefghijklmnopqrstuvwxyz" * 300):
        same(both, text)


def test_compatibility_is_what_the_merges_give(both):
    own = both[0]
    for left in range(0, 50000, 977):
        for right in range(0, 50000, 1499):
            a, b = own.tokens[left], own.tokens[right]
            assert own.compatible(left, right) == (bpe.merged(a + b, own.ranks) == [a, b])


def test_caches_may_run_over(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    same(both, "the quick brown fox jumps over the lazy dog, the quick brown fox " * 3)


def test_documents(spark, docs, both):
    rows = bpe.digests(docs((1, "Hello  wörld"), (2, None), (3, ""), (1, "Hello  wörld"), (None, "x")), PATH, P.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    found = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in rows}
    assert len(rows) == 5 and found[2, 0] == found[3, 0] == (empty, empty)
    assert found[1, len(both[1].encode_ordinary("Hello  wörld"))][1] == hashlib.sha256("Hello  wörld".encode()).hexdigest()
    assert bpe.digests(docs(), PATH, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs((1, "Hello  wörld")), PATH, P.PATTERN), PATH, P.PATTERN).first()
    assert bytes(back.data) == "Hello  wörld".encode()
