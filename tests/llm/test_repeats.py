import hashlib
import random

import numpy as np
import pytest

from haplomill.llm import repeats


def plain(rows, length=repeats.LENGTH):
    """Rows by looking up every string in a dictionary."""
    ordered = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0]))
    seen, out = set(), []
    for _, (doc_id, text) in ordered:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows, parts=3, **k):
    frame = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, m long, body binary").repartition(parts)
    got = [tuple(r) for r in repeats.without_repeats(frame, **k).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


@pytest.fixture(scope="module")
def mixed():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    rows = [(1000 - k, prose(draw.randint(5, 60)) + draw.choice(shared)[draw.randint(0, 40) :] + prose(draw.randint(0, 40))) for k in range(120)]
    rows += [(2000 + k, rows[k % 7][1]) for k in range(30)]
    near = prose(300)
    for k in range(25):
        at = draw.randrange(len(near))
        rows.append((3000 + k, near[:at] + prose(2) + near[at + draw.randint(0, 9) :]))
    rows += [(5, None), (6, ""), (7, "short"), (8, "x" * 99), (9, "x" * 100), (10, "x" * 101), (11, "ab" * 400), (12, "y" * 700), (13, "x" * 300 + "ab" * 90), (14, shared[0][:100]), (None, shared[1])]
    return rows


def test_against_dictionary(spark, mixed):
    compare(spark, mixed)


def test_crowded_anchors_are_taken_apart(spark, mixed):
    compare(spark, mixed, hot=3, bucket=11)


def test_other_anchor_lengths_and_many_buckets(spark, mixed):
    compare(spark, mixed[:90], gram=13, bucket=1)


def test_long_text_with_repeats_across_blocks(spark):
    draw = random.Random(2)
    base = "".join(draw.choice("abcdefgh \n") for _ in range(400_000))
    compare(spark, [(1, base + base[100_000:160_000]), (0, base[399_000:] + base[5:400])], parts=1)


def test_repeated_ids(spark, texts):
    rows = [(i, t) for i, t in texts if len(t or "") < 3000]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in repeats.without_repeats(frame).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_empty(spark, no_docs):
    assert repeats.without_repeats(no_docs).count() == 0


def test_columns_give_suffix_order_and_common_prefixes():
    draw = np.random.default_rng(3)
    symbols = draw.integers(97, 99, (9, 40)).astype(np.uint8)
    for c, inserted, order, differ in repeats.columns(symbols):
        suffix = [bytes(symbols[c:, k]) for k in order]
        assert suffix == sorted(suffix) and bytes(inserted) == bytes(s[0] for s in suffix)
        for k in range(1, 40):
            common = next((x for x in range(9 - c) if suffix[k][x] != suffix[k - 1][x]), 9 - c)
            assert differ[k] == c + common


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in repeats.op11_repeated_strings(spark, sf).collect()]
    want = plain(rows)
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 0
