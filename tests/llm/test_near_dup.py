import random

import numpy as np
import pytest

from haplomill.llm import common, near_dup


def groups(texts, size):
    """Sets and components by comparing all pairs."""
    sets = []
    for _, t in texts:
        words = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else []))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    name = {}
    for i, (doc, _) in enumerate(texts):
        name.setdefault(find(i), []).append(doc)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in name.items()}
    return sorted(((doc, len(sets[i]), smallest[find(i)], doc is not None and smallest[find(i)] == doc) for i, (doc, _) in enumerate(texts)), key=repr), len(name)


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("small", [True, False])
def test_against_all_pairs(docs, texts, size, small, monkeypatch):
    if small:
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(near_dup, "MEMBER_SHINGLES", 500)
    rows = near_dup.near_duplicates(docs, shingle_words=size).collect()
    want, n = groups(texts, size)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=repr) == want
    assert sum(r["first_of_group"] for r in rows) == n


def test_one_row_of_each_group_stays(docs, texts):
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == groups(texts, 5)[1]


def test_no_documents(no_docs):
    assert near_dup.near_duplicates(no_docs).collect() == []
    assert near_dup.keep_first(no_docs).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 260)] + [(250, 5)]
    got = dict(tuple(r) for r in near_dup.components(spark.createDataFrame([*chain, *star, (9, 9)], "a long, b long")).collect())
    assert {got[k] for k in range(100, 161)} == {100}
    assert {got[k] for k in [7, *range(200, 260)]} == {5}
    assert 9 not in got


def test_collisions_against_plain_sets():
    held = [np.array(x, np.uint64) for x in ([1, 5, 9], [5, 7], [11], [])]
    lists = near_dup.Postings(held)
    for values in ([0, 5, 9, 50], [99], [], [1, 5, 7, 9, 11], [11, 12, 13]):
        assert lists.collisions(np.array(values, np.uint64)).tolist() == [len(set(values) & set(x.tolist())) for x in held]
    assert near_dup.Postings([]).collisions(np.array([1], np.uint64)).tolist() == []


def test_lists_of_many_unlinked_members(spark):
    """One list holds groups that are copies of each other's parts: links among all but the first."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    texts = []
    for g in range(6):
        words = base[:200] + [f"g{g}x{k}" for k in range(60)]
        for c in range(5):
            own = list(words)
            for _ in range(c * 2):
                own[draw.randrange(len(own))] = f"c{draw.random()}"
            texts.append((10 * g + c, " ".join(own)))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = near_dup.near_duplicates(frame, shingle_words=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=repr) == groups(texts, 2)[0]


def test_tables_between_steps_are_removed(spark):
    """Only what the result reads is left, and full sets meet only where signatures are alike."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(260)]
    texts = [(k, " ".join(base[:200] + [f"{k // 3}x{i}" for i in range(40)] + [f"c{k}"])) for k in range(12)]
    since = common.mark()
    found = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), shingle_words=2)
    assert sorted(path.rpartition("/")[2].rpartition("-")[0] for _, path in common._temporary[since:]) == ["named", "rows"]
    assert sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == groups(texts, 2)[0]
