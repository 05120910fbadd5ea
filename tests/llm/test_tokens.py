"""Byte BPE against the library of the rank file, packing against the tokenizer, length sums."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import bpe, lengths, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MADE = bpe.coder(bpe.rank_file_bytes(RANKS), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=MADE.ranks, special_tokens={})
TOKENIZER = Tokenizer.from_file(WORD_BPE)
with open(WORD_BPE, "rb") as f:
    ENCODER = packing.word_encoder(f.read())
ODD = ["", " ", "  a  \n b", "a\n\nb \nc\n d", "▁a ▁▁", "\x00 \x00a", "it's 's  ''", "don't 12 345  …  \t\tq\r\n\r\nz ", "　全角 文字　", "a" * 3000, "🙂 👩‍👩‍👧", " a", "a ", "<|endoftext|> x", "a\x1cb", "é é ǅ"]


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_bpe_on_odd_texts(text):
    assert ids_of(MADE.encode(text)) == LIBRARY.encode_ordinary(text)
    assert MADE.decode(MADE.encode(text)) == text.encode()


@given(st.lists(st.text(st.sampled_from("ab eé\n\t.,'1 　s") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
@settings(max_examples=300)
def test_bpe_as_the_library(texts):
    for text, ids in zip(texts, MADE.encode_many(texts), strict=True):
        assert ids_of(ids) == LIBRARY.encode_ordinary(text)
        assert MADE.decode(ids) == text.encode()


def test_bpe_over_a_table(docs, nothing):
    got = bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = np.array(LIBRARY.encode_ordinary(texts[r.doc_id]), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.encode_decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    full = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in full)


@given(st.text(st.sampled_from("ab EÉ\n\t.,'12 　́Σİ-") | st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300)
def test_words_encode_as_texts(text):
    assert ids_of(ENCODER.encode_many([text])[0]) == TOKENIZER.encode(text, add_special_tokens=False).ids


def check_places(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing(docs, nothing):
    rows = packing.pack(docs, WORD_BPE, with_ids=True, capacity=512).collect()
    n = check_places(rows, 512)
    least = -(-sum(r.length for r in rows) // 512)  # not always reachable
    assert least <= n <= least + 1
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, text in texts.items():
        ids = [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows if r.doc_id == i})
        assert [x for p in own for x in ids_of(p[4])] == ids
        assert [(p[0], p[1]) for p in own] == [(k, k * 512) for k in range(len(own))]
        assert all(p[2] == len(p[4]) // 4 and p[3] == zlib.crc32(p[4]) for p in own)
    assert packing.pack(nothing, WORD_BPE).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 12), max_size=10))
@settings(max_examples=200)
def test_plan_takes_all_and_fills_each_bin_most(counts):
    plan = packing.plan_bins(counts, 60)
    left = dict(counts)
    for times, used in plan:
        assert times > 0 and sum(l * k for l, k in used) <= 60
        seed = max(l for l, n in left.items() if n)
        assert dict(used).get(seed)
        # the fullest combination with the longest piece left, by exhaustion
        reach, pool = {seed}, left | {seed: left[seed] - 1}
        for l, n in pool.items():
            reach |= {x + l * k for x in reach for k in range(1, n + 1) if x + l * k <= 60}
        assert sum(l * k for l, k in used) == max(reach)
        for l, k in used:
            left[l] -= times * k
    assert not any(left.values())


def test_length_sums(spark, nothing):
    values = [0, 3, 3, 10, 1024, 1025, 5000]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(v,) for v in values], "n_tokens long")))
    for r in sums.collect():
        assert r.n_docs == values.count(r.length)
        assert r.docs_at_most == sum(v <= r.length for v in values) and r.docs_longer == sum(v > r.length for v in values)
        assert r.tokens_at_most == sum(v for v in values if v <= r.length) and r.tokens_longer == sum(v for v in values if v > r.length)
        assert r.tokens_truncated == sum(min(v, r.length) for v in values) and r.quantile == r.docs_at_most / len(values)
    for r in lengths.at_limits(sums, [1, 3, 2048, 9000]).collect():
        assert r.tokens_truncated == sum(min(v, r.context) for v in values) and r.docs_longer == sum(v > r.context for v in values)
    assert lengths.length_at(sums, 0.5).first().length == 10
    counted = lengths.lengths(nothing, RANKS, public_tokenizers.PATTERN)
    assert lengths.suffix_sums(lengths.histogram(counted)).count() == 0
