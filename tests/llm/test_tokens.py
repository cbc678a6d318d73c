import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from haplomill.llm import byte_bpe, token_store
from haplomill.llm.common import new_folder

from .test_packing import PATH, library

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})


def expected(texts):
    out = []
    for i, t in texts:
        ids = ENCODING.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_chars", [4_000_000, 500])
def test_byte_bpe_as_the_library(docs, texts, block_chars):
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_chars=block_chars, buckets=7)
    rows = byte_bpe.decode(encoded, RANKS).collect()
    got = [(r["doc_id"], len(r["ids"]) // 4, hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r in rows]
    assert sorted(got, key=repr) == expected(texts)


def test_byte_bpe_digests(docs, texts, no_docs):
    got = sorted((tuple(r) for r in byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    assert got == expected(texts)
    assert byte_bpe.digests(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_round_trip(ids, a, b):
    ids = np.array(ids, "<u4")
    shard = token_store.Shard(b"".join(token_store.shard_bytes([1, None], [len(ids) // 2, len(ids) - len(ids) // 2], ids)))
    assert (shard.grammar.ids() == ids).all()
    assert (shard.grammar.ids(a, b) == ids[a:b]).all()
    assert np.array_equal(np.concatenate([shard.ids(0), shard.ids(1)]), ids)
    assert shard.doc_ids == [1, None]


def frequent_pairs(symbols):
    found, count = np.unique((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:], return_counts=True)
    return found[count >= token_store.MIN_COUNT]


def plain_repair(ids, min_count):
    """Symbols left and rules, when always the most frequent pair alone is replaced."""
    symbols, rules = list(ids), 0
    while len(symbols) > 1:
        count = {}
        for p in zip(symbols, symbols[1:]):
            count[p] = count.get(p, 0) + 1
        pair = max(count, key=count.get)
        if count[pair] < min_count:
            break
        out, k = [], 0
        while k < len(symbols):
            if tuple(symbols[k : k + 2]) == pair:
                out.append(("rule", rules))
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols, rules = out, rules + 1
    return len(symbols), rules


@pytest.mark.parametrize("seed", range(4))
def test_grammar_near_a_plain_one(seed):
    draw = np.random.default_rng(seed)
    words = [draw.integers(0, 60, draw.integers(1, 6)) for _ in range(40)]
    ids = np.concatenate([words[k] for k in np.minimum(draw.zipf(1.4, 900) - 1, 39)]).astype("<u4")
    rules = token_store.compress(ids)
    assert not len(frequent_pairs(rules.symbols))
    assert (token_store.Grammar(rules).ids() == ids).all()
    symbols, n = plain_repair(ids.tolist(), token_store.MIN_COUNT)
    assert len(rules.symbols) + 2 * len(rules.left) <= 1.15 * (symbols + 2 * n)


def test_no_pair_stays_frequent_in_many_copies_of_a_passage():
    draw = np.random.default_rng(3)
    passage = draw.integers(0, 49_000, 200)
    ids = np.concatenate([np.append(passage, draw.integers(0, 49_000, draw.integers(0, 9))) for _ in range(1000)]).astype("<u4")
    rules = token_store.compress(ids)
    assert not len(frequent_pairs(rules.symbols))
    assert rules.lengths.max() >= 128  # a rule for the most of the passage
    assert len(rules.symbols) < 8 * 1000
    grammar = token_store.Grammar(rules)
    assert (grammar.ids() == ids).all() and (grammar.ids(777, 5000) == ids[777:5000]).all()


def test_grammar_saves_space():
    ids = np.tile(np.arange(50, dtype="<u4"), 200)
    rules = token_store.compress(ids)
    assert len(rules.symbols) + 2 * len(rules.left) < len(ids) / 20


def test_bad_shards():
    data = b"".join(token_store.shard_bytes([1], [2], np.array([4, 5], "<u4")))
    with pytest.raises(ValueError):
        token_store.Shard(b"x" + data)
    with pytest.raises(ValueError):
        token_store.Shard(data + b"x")


@pytest.mark.parametrize("shard_ids", [1_000_000, 300])
def test_shards(spark, docs, texts, shard_ids):
    rows = token_store.read_shards(token_store.write_shards(docs, new_folder(spark, "t"), PATH, shard_ids=shard_ids)).collect()
    want, at = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode()), x[1] or "")):
        ids = library(t) + (2).to_bytes(4, "little")
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want


def test_no_shards(spark, no_docs):
    assert token_store.read_shards(token_store.write_shards(no_docs, new_folder(spark, "t"), PATH)).collect() == []
