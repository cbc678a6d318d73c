"""Runs of words: maximal stretches with a period, by Lyndon arrays on an ordered alphabet.

The words of a text are numbered by first occurrence, an ordered alphabet that no hash or suffix
structure backs. For each of both orders of it the next smaller suffix of every place is found from
right to left (the longest Lyndon word at a place ends before it). A comparison starts from what the
suffixes compared last are known to share, and where two places as far apart have been matched
before, the stretch matched then is taken over instead of being read again. Every run is rooted at a
longest Lyndon word of one of the orders, so that the stretches of equal words around each of them,
extended to the left in the same way, hold all runs.

A place of a run has a neighbour with which it occurs as a pair twice; texts are therefore first cut
where neither pair of a word does, again and again, which leaves runs whole.

Defined cases: a null or empty text has no words; a document without id is left as it is written (the
rule that repeats words needs an id); repeated rows are judged each; no rows give no rows; other
columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

LEAST = 12  # words of a run
OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_stretches(w: list[int]) -> tuple[list[int], list[int]]:
    """(next smaller suffix, equal words of both suffixes) of every place; the end is the smallest."""
    n = len(w)
    after, shared = [n] * n, [0] * n
    low, high = [n + 1] * (n + 1), [n + 1] * (n + 1)  # by distance: the stretch matched last
    beside = 0  # equal words of this suffix and the next one
    for i in range(n - 2, -1, -1):
        beside = beside + 1 if w[i] == w[i + 1] else 0
        j, same = i + 1, beside
        # the suffix at j is larger: what follows it is compared next
        while j < n and i + same < j + same < n and w[i + same] < w[j + same]:
            following, known = after[j], shared[j]
            if same > known:
                j, same = following, known
                break
            j = following
            if same == known and j < n:
                d, x = j - i, i + same
                if low[d] <= x <= high[d]:
                    x = high[d]
                else:
                    first, last = low[d], high[d]
                    while x + d < n and w[x] == w[x + d]:
                        x += 1
                        if x == first:
                            x = last
                            break
                low[d], high[d] = i, x
                same = x - i
            elif same == known:
                same = 0
        after[i], shared[i] = j, same if j < n else 0
    return after, shared


def runs_of(w: list[int], least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least `least` words and two periods."""
    n, out = len(w), set()
    top = max(w, default=0)
    for words in (w, [top - x for x in w]):
        after, shared = lyndon_stretches(words)
        end = [-1] * (n + 1)  # by distance: where the last stretch of equal words ends
        for i in range(n):
            j = after[i]
            d, high = j - i, i + shared[i]
            if i <= end[d] and high <= end[d]:
                continue  # the stretch is known
            low, stop = i, end[d]
            while low > 0 and low - 1 > stop and words[low - 1] == words[low - 1 + d]:
                low -= 1
            end[d] = high
            length = high - low + d
            if high - low >= d and length >= least:
                out.add((low, length, d))
    return out


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of what is left when words go neither of whose pairs occurs twice in its stretch."""
    out, todo = [], [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        part = ids[low:high]
        if len(part) < least:
            continue
        pairs = part[:-1] * (int(part.max()) + 1) + part[1:]
        order = np.argsort(pairs, kind="stable")
        equal = np.zeros(len(pairs) + 1, bool)
        equal[1:-1] = pairs[order[1:]] == pairs[order[:-1]]
        twice = np.zeros(len(pairs) + 2, bool)
        twice[1 + order] = equal[:-1] | equal[1:]
        alive = np.zeros(len(part) + 2, np.int8)
        alive[1:-1] = twice[:-1] | twice[1:]
        edges = np.diff(alive)
        found = [(low + a, low + b) for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True) if b - a >= least]
        if found == [(low, high)]:
            out += found
        else:
            todo += found
    return sorted(out)


def all_runs(words: list) -> list[tuple[int, int, int]]:
    """Runs of a sequence by start, then period."""
    number: dict = {}
    ids = [number.setdefault(x, len(number)) for x in words]
    out = []
    for low, high in stretches(np.array(ids, np.int64)):
        part = ids[low:high]
        ranks = {x: k for k, x in enumerate(sorted(set(part)))}
        out += [(low + s, length, q) for s, length, q in runs_of([ranks[x] for x in part])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by the checksum of its id, goes on with a period from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return words[:a] + (head * (-(-(n - a) // len(head))))[: n - a]


def digest(words: list[bytes]) -> tuple:
    """What is reported of a document's words, from n_words on."""
    runs = all_runs(words)
    best: tuple = (None, None, None, None)
    if runs:
        start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        best = (start, length, q, 1000 * length // q)
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            drop[start + q] += 1
            drop[start + length] -= 1
        kept = np.cumsum(drop[:-1]) == 0
        words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def periodic_runs(docs: DataFrame, rewrite=repeated_tail) -> DataFrame:
    """One row a document; rewrite: (words, doc_id) -> words is applied first."""
    names = [c.split()[0] for c in OUT.split(", ")]

    @tidy
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                number = None if pd.isna(doc_id) else int(doc_id)
                words = rewrite(text.encode().split() if text else [], number)
                rows.append((number, len(words), *digest(words)))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[:7]})

    # ids go as texts, which keep whole numbers whole beside nulls
    return docs.selectExpr("cast(doc_id AS string) AS doc_id", "text").mapInPandas(task, OUT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
