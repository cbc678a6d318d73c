import hashlib
import math
import random

import numpy as np
import pytest

from haplomill.llm import vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) by comparing everything with everything."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = lambda v: [(v + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)]
    xs = [cut(v) for _, v, _ in kept]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda x, p: min((far(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(x[p], p)[1] for x in xs]
            books[p] = [[sum(c) // len(c) for c in zip(*mine, strict=True)] if (mine := [x[p] for x, k in zip(xs, of, strict=True) if k == e]) else old for e, old in enumerate(books[p])]
    found = [[near(x[p], p) for p in range(parts)] for x in xs]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, total[lab], sha) for (i, _, lab), f, e in zip(kept, found, error, strict=True)]


def same(spark, rows, **k):
    frame = spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(frame, **k).collect()]
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(got, key=repr) == sorted(plain(exact, **k), key=repr)


def test_against_plain_rounds(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(10**6), [draw.gauss(0, 0.3) for _ in range(32)], draw.choice([1, 2, None, 1, 1])) for _ in range(400)]
    rows += [(2**60 + 1, rows[0][1], 1), (rows[5][0], rows[5][1], 7), (rows[6][0], rows[7][1], 7), (None, rows[8][1], None), (-5, [0.0] * 32, 3)]
    rows += [(1, None, 1), (2, [], 1), (3, [float("nan")] * 32, 1), (4, [None, *[0.1] * 31], 1), (5, [float("inf"), *[0.1] * 31], 2), (10**7, [0.5] * 16, 2)]
    same(spark, rows)
    same(spark, rows, parts=8, entries=7, rounds=5)


def test_ties_and_few_rows(spark):
    draw = random.Random(4)
    grid = [(k, [draw.choice([-1.0, 0.0, 1.0]) for _ in range(18)], k % 2) for k in range(90)]  # 18 = 16 * 2 - 14
    same(spark, grid)
    same(spark, grid[:5])
    same(spark, [(k, [0.25] * 16, None) for k in range(70)])


def test_bounds_spare_scans():
    draw = np.random.default_rng(1)
    x = draw.integers(-300, 300, (2000, 4))
    book = x[:64].copy()
    code, upper, lower = vector_codes.scan(x, book)
    after = book + draw.integers(-3, 4, book.shape)
    moved = vector_codes.above(((after - book) ** 2).sum(axis=1))
    scans = vector_codes.reassign(x, code, upper, lower, after, moved)
    d = vector_codes.distances(x, after)
    assert (code == d.argmin(axis=1)).all() and scans < 1200
    second = np.partition(d, 1, axis=1)[:, 1]
    assert (upper >= np.sqrt(d.min(axis=1)) * vector_codes.GRAIN).all() and (lower <= np.sqrt(second) * vector_codes.GRAIN).all()


def test_no_rows(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<float>, label int")).collect()
