import io
import struct

import numpy as np
import pytest

from haplomill.llm import neighbours, warc
from haplomill.llm.common import new_folder

BIG = "<html>" + "payload " * 40 + "</html>"
PAGES = [(5, "http://a/\r\nx%0A", BIG), (3, "http://b", BIG), (9, None, BIG), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", BIG), (None, "v", "né"), (3, "http://b", BIG), (11, "u", "é" * 60), (10, "u", "é" * 60), (12, "long", "x" * 3_000_000)]


def decided():
    first = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, url, html in PAGES:
        raw = (html or "").encode()
        owner = first.get(raw)
        revisit = i is not None and owner is not None and i > owner
        import hashlib

        out.append((i, url, "revisit" if revisit else "response", owner if revisit else None, len(raw), hashlib.sha256(raw).hexdigest(), None if revisit else raw))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [64 << 20, 500])
def test_archives_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    frame = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, length long, digest string").repartition(3)
    rows = warc.read_archives(warc.write_archives(frame, new_folder(spark, "w"))).collect()
    got = [(*r[:6], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=repr) == decided()


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty, new_folder(spark, "w"))).collect() == []


def one(payload=b"hello"):
    import hashlib

    return warc.record_bytes(1, "http://x", "response", None, payload, len(payload), hashlib.sha256(payload).hexdigest())


def test_records_are_checked():
    good = one()
    assert warc.parse_record(good)[:5] == (1, "http://x", "response", None, 5)
    for bad in (good[:-1], good.replace(b"hello", b"jello"), good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date", b"WARC-Dato"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)


def test_archives_are_checked():
    data = b"".join(warc.archive_bytes([one(), one(b"x" * 5000)], [b"hello"]))
    assert list(warc.archive_records(io.BytesIO(data))) == [one(), one(b"x" * 5000)]
    for bad in (b"", data[:6], b"x" + data, data[:-3], data + b"junk", data[:10]):
        with pytest.raises(warc.BadArchive):
            list(warc.archive_records(io.BytesIO(bad)))
    import zstandard

    (length,) = struct.unpack_from("<I", data, 4)
    packed = zstandard.compress(data[8 : 8 + length])  # a dictionary that is compressed itself
    again = struct.pack("<II", warc.MAGIC, len(packed)) + packed + data[8 + length :]
    assert list(warc.archive_records(io.BytesIO(again)))[0] == one()


def test_trained_dictionary():
    samples = [(f"<html><title>{k}</title>" + "<p>common words of all pages</p>" * 30 + str(k * 7919) * 50).encode() for k in range(200)]
    data = b"".join(warc.archive_bytes([one(s) for s in samples], samples))
    assert list(warc.archive_records(io.BytesIO(data))) == [one(s) for s in samples]


def brute(ids, x, k):
    out = {}
    for i in sorted({i for i in ids if i % 20 == 0}):
        q = x[ids.index(i)]
        scores = sorted((-float((x[j] * q).sum()), ids[j]) for j in range(len(ids)) if ids[j] != i)
        out[i] = [(v, -s) for s, v in scores[:k]]
    return out


def test_neighbours_recall_and_ties(spark):
    draw = np.random.default_rng(0)
    centres = draw.standard_normal((30, 16))
    x = centres[draw.integers(0, 30, 1200)] + 0.3 * draw.standard_normal((1200, 16))
    x[100:400] = x[100]  # many equal vectors
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    rows += [(5000, None, 0, 1), (5020, [0.0] * 16, 0, 1), (5040, [float("nan")] * 16, 0, 1), (5060, [1.0, None] + [0.0] * 14, 0, 1), (5080, [], 0, 1), (5100, [1.0], 0, 1), (None, x[0].tolist(), 0, 1), rows[7]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int, tbl int").repartition(4)
    found = {}
    for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    truth = brute(list(range(1200)), x, 20)
    assert found.keys() == truth.keys()
    hits = sum(len({v for v, _ in truth[q]} & {v for v, _ in found[q]}) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)
    for q, got in found.items():
        assert len(got) == 20 and got == sorted(got, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(x[v] @ x[q]), abs=1e-12) for v, s in got)
    assert [v for v, _ in found[100]] == [v for v, _ in truth[100]]


@pytest.mark.parametrize("longest", [neighbours.K, 2048])
@pytest.mark.parametrize("norms", ["one long", "lognormal"])
def test_neighbours_recall_with_unequal_norms(spark, norms, longest):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "lognormal":
        x *= np.exp(0.3 * draw.standard_normal((3000, 1)))
    else:
        x[1234] *= 10
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    settings = {"longest": longest} if longest != 2048 else {}
    found = {}
    for r in neighbours.nearest(frame, **settings).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    truth = {q: set(np.argsort(-scores[q])[:20].tolist()) for q in range(0, 3000, 20)}
    assert all(len(found.get(q, ())) == 20 for q in truth)
    assert sum(len(truth[q] & found[q]) for q in truth) >= 0.93 * 20 * len(truth)


def test_recall_and_share_on_the_table(spark, sf):
    """On isotropic vectors: recall against brute force, and fewer rows visited than there are, the
    smaller a share the more rows."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("size(embedding) = 64").collect()
    pool = np.array([r["embedding"] for r in rows], float)
    draw = np.random.default_rng(2)
    shares = []
    for n in (3_000, 10_000):
        x = draw.standard_normal((n, 64)).astype(np.float32).astype(float)
        x[: len(pool)] = pool[:n]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
        found = {}
        for r in neighbours.nearest(frame, longest=20, query_every=60).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        asked = np.arange(0, n, 60)
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -np.inf
        truth = np.argpartition(-scores, 20, axis=1)[:, :20]
        recall = np.mean([len(found[q] & set(t)) / 20 for q, t in zip(asked.tolist(), truth.tolist(), strict=True)])
        hashes = neighbours.Hashes(64, functions=neighbours.functions_for(n))
        data = frame.withColumnRenamed("embedding", "v")
        n_probes = neighbours.fitted(data, data.where("vec_id % 60 = 0"), 20, hashes, neighbours.RECALL, neighbours.SAMPLE)
        own = neighbours.bucket_numbers(np.floor(hashes.places(x)))
        visited = np.zeros((len(asked), n), bool)
        for i, q in enumerate(asked):
            for t, buckets in enumerate(neighbours.bucket_numbers(neighbours.probes(hashes.places(x[[q]])[0], n_probes))):
                visited[i] |= np.isin(own[:, t], buckets)
        shares.append(visited.mean())
        print(f"{n} rows: {n_probes} probes, recall {recall:.3f}, share visited {shares[-1]:.3f}")
        assert recall >= 0.9
    assert shares[1] < shares[0] < 0.85


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(frame).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert neighbours.nearest(frame.where("false")).collect() == []


@pytest.mark.parametrize("n, longest", [(12, 2048), (15, 0), (30, 2048)])
def test_all_candidates_of_small_tables(spark, n, longest):
    x = np.random.default_rng(n).standard_normal((n, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    settings = {"longest": longest} if longest != 2048 else {}
    found = {}
    for r in neighbours.nearest(frame, **settings).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    truth = brute(list(range(n)), x, 20)
    assert {q: [v for v, _ in rows] for q, rows in truth.items()} == found


def test_short_queries_of_larger_tables(spark):
    # one bucket of one table holds far fewer than 20 rows
    x = np.random.default_rng(9).standard_normal((300, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(frame, longest=0, tables=1, width=0.5, n_probes=1).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    truth = brute(list(range(300)), x, 20)
    assert found == {q: [v for v, _ in rows] for q, rows in truth.items()}


def test_probes_come_in_order_of_cost():
    place = np.array([0.1, 0.6, 0.95])
    got = neighbours.probes(place[None, :], 12)[0]
    cell, part = np.floor(place), place - np.floor(place)
    cost = lambda c: sum((part[f] if s < 0 else 1 - part[f]) ** 2 for f, s in enumerate(c - cell) if s)
    costs = [cost(c) for c in got]
    assert (got[0] == cell).all() and costs == sorted(costs)
    assert len({tuple(c) for c in got}) == len(got)


@pytest.mark.parametrize("sf_name", ["sf0.001", "sf0.1"])
def test_given_tables_go_through_the_buckets(spark, sf, sf_name, monkeypatch):
    """No size is small enough to be compared as a whole, and recall holds."""
    searched = []
    whole = neighbours.search
    monkeypatch.setattr(neighbours, "search", lambda *a: searched.append(1) or whole(*a))
    path = sf.replace("sf0.001", sf_name)
    found = {}
    for r in neighbours.op4_nearest_neighbours(spark, path).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{path}/embeddings.parquet").collect() if r["embedding"]}
    ids, x = np.array(list(rows)), np.array(list(rows.values()), float)
    recall = []
    for q in [i for i in rows if i % 20 == 0]:
        scores = np.where(ids == q, -np.inf, x @ np.array(rows[q], float))
        recall.append(len(found[q] & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    print(f"{sf_name}: recall {np.mean(recall):.3f}")
    assert len(searched) == 2 and np.mean(recall) >= 0.9
