"""Panels that take and give up haplotypes, and mosaics of whole panels, against plain loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplomill.operators import panel, panel_path, pbwt

SITES, HAPS = 100, 30


def mosaic(draw, n, m, founders=4):
    """Haplotypes copied from few founders with errors, so that long matches and equal ones occur."""
    base = draw.integers(0, 2, (founders, m))
    out = np.empty((n, m), int)
    for k in range(n):
        who = draw.integers(founders)
        for j in range(m):
            if draw.random() < 0.04:
                who = draw.integers(founders)
            out[k, j] = base[who, j] ^ (draw.random() < 0.01)
    out[5] = out[2]
    out[n - 1] = out[3]
    return out


@pytest.fixture(scope="module")
def alleles():
    return mosaic(np.random.default_rng(11), HAPS, SITES)


@pytest.fixture(scope="module")
def geno(spark, alleles):
    rows = [(j, k, int(alleles[k, j])) for k in range(HAPS) for j in range(SITES)]
    return spark.createDataFrame(rows, "site int, hap int, g int").repartition(4).cache()


def plain_rows(alleles, haps):
    """(site, hap, rnk, above, since) by sorting reversed prefixes."""
    out = []
    for j in range(alleles.shape[1]):
        order = sorted(haps, key=lambda h: (tuple(alleles[h, j::-1]), h))
        for r, h in enumerate(order):
            above = order[r - 1] if r else None
            since = j + 1 if above is None else max((x + 1 for x in range(j + 1) if alleles[h, x] != alleles[above, x]), default=0)
            out.append((j, h, r, above, since))
    return sorted(out)


def rows_of(p):
    return sorted(tuple(r) for r in p.order.select("site", "hap", "rnk").join(p.since, ["site", "hap"]).select("site", "hap", "rnk", "above", "since").collect())


def test_insert_in_steps_remove_and_insert_again(spark, geno, alleles):
    some = panel.build(geno.where("hap < 20"), SITES)
    assert rows_of(some) == plain_rows(alleles, range(20))
    more = panel.insert(some, geno.where("hap BETWEEN 20 AND 24"))
    assert rows_of(more) == plain_rows(alleles, range(25))
    gone = spark.createDataFrame([(h,) for h in (0, 2, 3, 7, 8, 9, 21)], "hap int")
    left = [h for h in range(25) if h not in (0, 2, 3, 7, 8, 9, 21)]
    fewer = panel.remove(more, gone)
    assert rows_of(fewer) == plain_rows(alleles, left)
    whole = panel.insert(fewer, geno.where("hap >= 25"))
    assert rows_of(whole) == plain_rows(alleles, [*left, *range(25, HAPS)])


def test_levels_stay_true(geno, alleles):
    some = panel.insert(panel.build(geno.where("hap < 12"), SITES), geno.where("hap BETWEEN 12 AND 19"))
    built = panel.build(geno.where("hap < 20"), SITES)
    for d, ranks in some.levels.items():
        ours, theirs = (sorted(tuple(r) for r in x.select("block", "hap", "rank").collect()) for x in (ranks, built.levels[d]))
        assert ours == theirs


def plain_path(own, refs, costs):
    """(start, end, ref) and the cost; ties go on, then to the smallest id."""
    stay, switch, match, mismatch = costs
    ids, m = sorted(refs), len(own)
    here = lambda j, r: stay[j] + (match[j] if refs[r][j] == own[j] else mismatch[j])
    f = [{r: here(0, r) for r in ids}]
    for j in range(1, m):
        bound = min(f[-1].values()) + switch[j - 1] - stay[j - 1]
        f.append({r: min(f[-1][r], bound) + here(j, r) for r in ids})
    best = lambda j: min(ids, key=lambda r: (f[j][r], r))
    ref, end, out = best(m - 1), m, []
    for j in range(m - 1, -1, -1):
        if j == 0 or f[j - 1][ref] > min(f[j - 1].values()) + switch[j - 1] - stay[j - 1]:
            out.append((j, end, ref))
            end = j
            if j:
                ref = best(j - 1)
    return out[::-1], min(f[-1].values())


@pytest.mark.parametrize(("seed", "stretch", "cheap"), [(1, 100, False), (2, 7, False), (3, 33, True)])
def test_paths_against_all_references(spark, seed, stretch, cheap):
    draw = np.random.default_rng(seed)
    m = 60
    alleles = mosaic(draw, HAPS, m)
    rows = [(j, k, int(alleles[k, j])) for k in range(HAPS) for j in range(m)]
    geno = spark.createDataFrame(rows, "site int, hap int, g int").repartition(4)
    p = panel.build(geno.where("hap < 24"), m)
    # whole costs with many ties; a switch may be cheaper than going on
    stay, switch, match, mismatch = (draw.integers(*x, m) for x in ((0, 3), (0, 4) if cheap else (2, 9), (0, 2), (3, 6)))
    costs = spark.createDataFrame([(j, *(int(x[j]) for x in (stay, switch, match, mismatch))) for j in range(m)], "site int, stay long, switch long, match long, mismatch long")
    found = panel_path.paths(p, geno.where("hap >= 24"), costs, tasks=3, stretch=stretch).cache()
    refs = {k: alleles[k] for k in range(24)}
    near = panel_path.longest(panel_path.overlaps(p, geno.where("hap >= 24"), panel_path.members(p, found)), 5).collect()
    for t in range(24, HAPS):
        path, cost = plain_path(alleles[t], refs, (stay, switch, match, mismatch))
        got = sorted((r for r in found.collect() if r["target"] == t), key=lambda r: r["seg_idx"])
        assert [(r["start"], r["end"], r["ref"]) for r in got] == path and {r["cost"] for r in got} == {cost}
        for k, (start, end, ref) in enumerate(path):
            shared = [r for r in range(24) if (alleles[r, start:end] == alleles[ref, start:end]).all()]
            reach = {}
            for r in shared:
                low, high = start, end
                while low and alleles[r, low - 1] == alleles[t, low - 1]:
                    low -= 1
                while high < m and alleles[r, high] == alleles[t, high]:
                    high += 1
                reach[r] = (low, high)
            want = sorted(shared, key=lambda r: (reach[r][0] - reach[r][1], r))[:5]
            mine = [r for r in near if r["target"] == t and r["seg_idx"] == k]
            assert sorted((r["ref"], r["low"], r["high"]) for r in mine) == sorted((r, *reach[r]) for r in want)
            assert all(r["weight"] == pytest.approx(1 / len(want)) for r in mine)


def test_front_stays_small():
    """Dominated states go: on copies of few founders a front has a few dozen intervals, not a state a haplotype."""
    draw = np.random.default_rng(4)
    n, m = 800, 200
    alleles = mosaic(draw, n + 1, m)
    order, front = np.arange(n), panel_path.Front(None, n)
    for j in range(m):
        column = alleles[order, j]
        zeros = np.concatenate([[0], np.cumsum(1 - column)])
        order = np.concatenate([order[column == 0], order[column == 1]])
        front.site(zeros, int(alleles[n, j]), 1, 0, 300)
        front.switch(j + 1, n, 400, order)
    assert front.most < 80


def test_no_targets(geno, spark):
    p = panel.build(geno.where("hap < 5"), SITES)
    costs = spark.range(SITES).select(F.col("id").cast("int").alias("site"), *[F.lit(1).cast("long").alias(c) for c in ("stay", "switch", "match", "mismatch")])
    assert panel_path.paths(p, geno.where("hap < 0"), costs).count() == 0


@pytest.mark.parametrize(("seed", "stretch"), [(1, 100), (2, 5)])
def test_pairs_against_all_pairs(spark, seed, stretch):
    draw = np.random.default_rng(seed)
    n, m, people = 14, 30, 4
    alleles = mosaic(draw, n + 2 * people, m)
    rows = [(j, k, int(alleles[k, j])) for k in range(n) for j in range(m)]
    p = panel.build(spark.createDataFrame(rows, "site int, hap int, g int"), m)
    stay, switch, match, mismatch = (draw.integers(*x, m) for x in ((0, 3), (2, 9), (0, 2), (3, 6)))
    costs = spark.createDataFrame([(j, *(int(x[j]) for x in (stay, switch, match, mismatch))) for j in range(m)], "site int, stay long, switch long, match long, mismatch long")
    doses = {i: alleles[n + 2 * i] + alleles[n + 2 * i + 1] for i in range(people)}
    found = panel_path.pair_paths(p, spark.createDataFrame([(j, i, int(doses[i][j])) for i in doses for j in range(m)], "site int, ind int, dose int"), costs, tasks=2, stretch=stretch).collect()
    for i, dose in doses.items():
        s = np.zeros((n, n), int)
        for j in range(m):
            if j:
                ex = switch[j - 1] - stay[j - 1]
                s = np.minimum(np.minimum(s, np.minimum(s.min(0)[None, :], s.min(1)[:, None]) + ex), s.min() + 2 * ex)
            off = np.abs(alleles[:n, j][:, None] + alleles[:n, j][None, :] - dose[j])
            s = s + 2 * stay[j] + np.choose(off, [2 * match[j], match[j] + mismatch[j], 2 * mismatch[j]])
        mine = [r for r in found if r["ind"] == i]
        assert {r["cost"] for r in mine} == {s.min()}
        # the segments themselves cost as much
        refs, total = np.empty((2, m), int), 0
        for r in mine:
            refs[r["side"], r["start"] : r["end"]] = r["ref"]
        starts = {(r["side"], r["start"]) for r in mine if r["start"]}
        for j in range(m):
            off = abs(alleles[refs[0, j], j] + alleles[refs[1, j], j] - dose[j])
            total += 2 * stay[j] + [2 * match[j], match[j] + mismatch[j], 2 * mismatch[j]][off] + sum(switch[j - 1] - stay[j - 1] for side in (0, 1) if (side, j) in starts)
        assert total == s.min()


def test_domination_work_follows_the_pairs():
    draw = np.random.default_rng(5)
    n = 60_000
    low, low2 = draw.integers(0, 99_000, n), draw.integers(0, 99_000, n)
    state = {"low": low, "high": low + 1, "low2": low2, "high2": low2 + 1, "start": low, "start2": low2, "node": low, "score": draw.integers(10, 20, n)}
    front = panel_path.PairFront(None, 100_000)
    # the cheapest pair holds a part of the others, the dearest one all of them
    front.s = {c: np.append(x, y) for (c, x), y in zip(state.items(), ([0, 0], [50_000, 100_000], [0, 0], [50_000, 100_000], [0, 0], [0, 0], [0, 0], [1, 99]), strict=True)}
    began = time.process_time()
    front._dominated()
    assert time.process_time() - began < 15
    held = (low < 50_000) & (low2 < 50_000)
    assert 0 < held.sum() < n and len(front.s["score"]) == n - held.sum() + 2
    assert not ((front.s["score"] > 1) & (front.s["score"] < 99) & (front.s["low"] < 50_000) & (front.s["low2"] < 50_000)).any()


def test_removal_is_no_list_of_all_that_go(spark, geno):
    some = panel.build(geno.where("hap < 20"), SITES)
    seen, cut = [], panel.cut
    panel.cut = lambda df: (seen.append(df._jdf.queryExecution().analyzed().toString()), cut(df))[1]
    try:
        panel.remove(some, geno.select("hap").where("hap % 7 IN (2, 3)"))
    finally:
        panel.cut = cut
    # a row of the panel must not be held against each that goes
    assert not any("gone" in plan for plan in seen)


def test_columns_are_made_when_asked_for(geno, monkeypatch):
    """An insertion takes the columns of the panel before it alone."""
    made, plain = [], panel.in_columns
    monkeypatch.setattr(panel, "in_columns", lambda order: made.append(1) or plain(order))
    more = panel.insert(panel.build(geno.where("hap < 8"), SITES), geno.where("hap BETWEEN 8 AND 9"))
    assert len(made) == 1
    assert more.columns.count() == SITES and more.columns is more.columns and len(made) == 2


def test_ranks_of_whole_keys(geno):
    """The keys of whole blocks, the last one short, hold the order after every site."""
    ours, theirs = (sorted(tuple(r) for r in x.select("site", "hap", "g", "rnk").collect()) for x in (pbwt.ranks_of_keys(pbwt.whole_keys(geno), SITES), pbwt.prefix_ranks(geno, SITES)))
    assert ours == theirs


def test_a_search_takes_order_and_columns_alone(spark, geno, monkeypatch):
    """Since when neighbours are equal is nothing that a mosaic asks for."""
    made, levels, since = [], panel.level_ranks, pbwt.divergence
    monkeypatch.setattr(panel, "level_ranks", lambda *a: made.append("levels") or levels(*a))
    monkeypatch.setattr(pbwt, "divergence", lambda *a: made.append("since") or since(*a))
    p, targets = panel.build(geno.where("hap < 24"), SITES), geno.where("hap >= 28")
    costs = spark.createDataFrame([(j, 0, 3_000_000, 0, 2_000_000) for j in range(SITES)], "site int, stay long, switch long, match long, mismatch long")
    near = panel_path.longest(panel_path.overlaps(p, targets, panel_path.members(p, panel_path.paths(p, targets, costs))), 5)
    assert near.count() > 0 and made == []
    assert p.since.count() == 24 * SITES and p.since is p.since and made == ["levels", "since"]
