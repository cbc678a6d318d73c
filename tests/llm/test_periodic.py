import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from haplomill.llm import periodic


def plain_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(q % p == 0 and all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(words), len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(words) if i not in dropped)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_all_runs(w):
    assert periodic.all_runs(w) == plain_runs(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40), st.integers(1, 6), st.integers(1, 9))
def test_runs_without_least(w, q, times):
    w = [*w, *(w[:q] * times), *w[:3]]
    assert sorted(periodic.runs_of(w, 2)) == sorted(plain_runs(w, 2))


def test_long_repeats_take_linear_time():
    draw = random.Random(1)
    for w in ([0] * 200_000, [0, 1] * 100_000, [draw.randrange(3) for _ in range(500)] * 200, [0] * 50_000 + [1] + [0] * 50_000):
        assert periodic.all_runs(w)[0][1] in (len(w), 50_000)


def test_rows(spark, docs, texts):
    some = [(i, t) for i, t in texts if len(t or "") < 3000] + [(k, "a b c " * k + "x y z w " * 5) for k in range(900, 930)] + [(5, "p \n" * 40), (7, "a\x1cb \x85 a\x1cb " * 9)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in some], "doc_id long, text string, start string, period int")
    got = [tuple(r) for r in periodic.periodic_runs(frame).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t) for i, t in some), key=repr)
    assert periodic.periodic_runs(docs).count() == docs.count()


def test_empty(spark, no_docs):
    assert periodic.periodic_runs(no_docs).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in periodic.op12_periodic_runs(spark, sf).collect()]
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = {r["doc_id"]: r["text"] for r in texts if len(r["text"] or "") < 4000}
    got = [r for r in rows if r[0] in short]
    assert len(rows) == len(texts) and len(got) > 100
    assert sorted(got) == sorted(plain_row(i, t) for i, t in short.items())
