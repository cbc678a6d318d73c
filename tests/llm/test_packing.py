import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from haplomill.llm import packing
from haplomill.llm.common import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBéÉß'’st .,!\n\t\x1c\x85 <|>endoftext12İΣσς́ﬁ中"), max_size=30), max_size=5))
def test_words_are_encoded_as_the_library_does(texts):
    assert list(WordEncoder(PATH, limit=5).encode_all(texts)) == [library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins_hold_everything_once(lengths):
    bins = packing.pack(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= len(packing.next_fit(lengths, 50))


def best_step(own, fill, others, capacity):
    """Largest gain of each kind of step by trying all of them; others: fills and documents."""
    gain = lambda d, f: max(0, d * (f + d - fill)) if 0 < d <= capacity - f else 0
    move = max((gain(x, f) for x in own for f, _ in others), default=0)
    one = max((gain(x - c, f) for x in own for f, docs in others for c in docs), default=0)
    two = max((gain(own[i] + own[j] - c, f) for i in range(len(own)) for j in range(i) for f, docs in others for c in docs), default=0)
    return move or one or two


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=4).filter(lambda b: sum(b) < 50), min_size=2, max_size=8))
def test_steps_gain_most_of_all(bins):
    lengths = [n for b in bins for n in b]
    at = iter(range(len(lengths)))
    search = packing.Search([[next(at) for _ in b] for b in bins], lengths, 50)
    search._leave(0)
    step = search._best(search.held[0], search.fill[0])
    got = 0
    if step:
        parts, gap, back = step
        d = sum(parts) - back
        got = d * (50 - gap + d - search.fill[0])
    assert got == best_step(bins[0], sum(bins[0]), [(sum(b), b) for b in bins[1:]], 50)


def test_search_does_the_packing():
    draw = np.random.default_rng(1)
    for sizes in (draw.integers(300, 900, 600), draw.integers(600, 1100, 900), np.minimum(2048, draw.lognormal(6, 1, 3000)).astype(int) + 1):
        lengths = np.minimum(sizes, 2048).tolist()
        search = packing.Search(start := packing.next_fit(lengths, 2048), lengths, 2048)
        squares = sum(f * f for f in search.fill)
        bins = search.run().bins()
        assert sum(f * f for f in search.fill) > squares
        assert len(bins) <= -(-sum(lengths) // 2048) * 1.02 + 1 or sizes.min() >= 600
        assert len(bins) < 0.95 * len(start) or sizes.min() >= 600
        assert sum(search.moves.values()) > len(start) / 10
        assert search.moves["one for one"] > 0


def test_nothing_fits_together():
    lengths = list(range(1100, 1400))
    assert len(packing.pack(lengths, 2048)) == len(lengths)


def check(rows, texts, capacity):
    pieces = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for i, t in texts:
        ids = library(t) + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            expected.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(expected, key=key)
    return len(by_sequence), -(-sum(x[3] for x in expected) // capacity)


def test_large_ids_beside_null(spark):
    rows = [(9007199254740993, "one two"), (None, "three"), (9007199254740993, "four")]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    check(got, rows, 2048)


def test_documents_are_packed(docs, texts):
    used, least = check(packing.best_fit_pack(docs, PATH).collect(), texts, 2048)
    assert used <= least + 1


def test_groups_share_their_rests(docs, texts):
    used, least = check(packing.best_fit_pack(docs, PATH, capacity=256, group_pieces=40).collect(), texts, 256)
    assert used <= least + 1


def test_no_documents(no_docs):
    assert packing.best_fit_pack(no_docs, PATH).collect() == []
