"""Sequential models against plain loops, and pinned values."""

import itertools
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haplomill.functions import intervals, lineage
from haplomill.functions.regions import parse_region
from haplomill.operators import ancestry, consistency, coordinates, copying, normalize, pbwt, psmc, trees
from haplomill.operators.demography import Demography
from haplomill.plans import panels
from haplomill.plans.catalogue import QUERIES
from haplomill.sources import fixtures


def test_demography_values():
    one = Demography([1e4], [0.0])
    assert [one.to_generations(t) for t in (0.001, 0.5, 1, 3)] == pytest.approx([10, 5000, 10000, 30000])
    assert one.branch_length(100) == pytest.approx(200)
    two = Demography([5000, 20000], [0, 200])
    assert [two.to_generations(t) for t in (0.02, 0.04, 0.05, 0.1)] == pytest.approx([100, 200, 400, 1400])
    three = Demography([1000, 5000, 20000], [0, 50, 100])
    assert three.std_times == pytest.approx([0, 0.05, 0.06])
    assert three.to_generations(0.07) == pytest.approx(300)


@pytest.mark.parametrize(("sizes", "times"), [([1], [0, 1]), ([1, 1], [0, -1]), ([0], [0]), ([1, 1], [0, 0]), ([1], [5]), ([], [])])
def test_bad_demographies(sizes, times):
    with pytest.raises(ValueError):
        Demography(sizes, times)


def test_negative_time():
    with pytest.raises(ValueError):
        Demography([1], [0]).to_generations(-1)


def test_hmm_times():
    assert psmc.times(Demography([1e4], [0.0]), 4) == pytest.approx([1335.31, 4700.04, 9808.29, 20794.42], rel=1e-3)


def test_regions():
    assert parse_region("chr1:400000-600000") == ("1", 400000, 600000)
    assert parse_region("5-10") == (None, 5, 10)
    for bad in ("x", "chr23:1-2", "1:5-4", "1:5"):
        with pytest.raises(ValueError):
            parse_region(bad)


def test_positions_are_repaired():
    frame = pd.DataFrame({"site": [0, 1, 2], "pos": [10, 10, 12], "cm": [0.0, 0.0, 0.1]})
    out = coordinates.repair_positions(frame)
    assert out["pos"].tolist() == [10, 11, 12]
    assert out["cm"].tolist() == pytest.approx([0, 1e-7, 0.1])
    with pytest.raises(ValueError):
        coordinates.repair_positions(frame.assign(pos=[10, 9, 12]))


def test_split_of_segments_with_many_mismatches(spark):
    demography, sites = Demography([2e4, 1e4], [0.0, 500.0]), range(400)
    steps = spark.createDataFrame([(s, 0.01, 2000.0) for s in sites], "site int, step double, bp double")
    # many mismatches from site 100 to 179, for a haplotype below 100, one above, one with ten
    paths = spark.createDataFrame([(h, s, h - 1) for h in (5, 50, 100) for s in (0, 200)], "hap int, site int, target int")
    mism = spark.createDataFrame([(h, s) for h in (5, 100) for s in range(100, 180, 2)] + [(50, s) for s in range(100, 110)] + [(5, 399)], "hap int, site int")
    got = sorted(tuple(r) for r in psmc.split(paths, mism, steps, demography, 1.4e-8).collect())
    observed = np.array([100 <= s < 180 and s % 2 == 0 for s in range(200)])
    expected = psmc.breakpoints(observed, np.full(200, 0.01), np.full(200, 2000.0), demography, 1.4e-8, 64)
    assert len(expected) > 1
    assert got == sorted([(5, s, 4) for s in [*expected, 200]] + [(50, 0, 49), (50, 200, 49), (100, 0, 99), (100, 200, 99)])


def slow_breakpoints(observed, cm, bp, demography, mu, n):
    t = psmc.times(demography, n)
    score = None
    back = []
    for j, het in enumerate(observed):
        l, m = 0.02 * cm[j] * t, 2 * mu * bp[j] * t
        trans = np.log1p(-np.exp(-l)) - np.log(n)
        stay = np.log(np.exp(-l) + np.exp(trans))
        emit = np.log1p(-np.exp(-m)) if het else -m
        if score is None:
            score = emit
            continue
        table = np.array([[score[k] + (stay[k] if k == i else trans[k]) for k in range(n)] for i in range(n)])
        back.append(table.argmax(axis=1))
        score = table.max(axis=1) + emit
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    return [0] + [j for j in range(1, len(path)) if path[j] != path[j - 1]]


def test_breakpoints_against_a_plain_loop():
    demography = Demography([1e4], [0.0])
    draw = np.random.default_rng(3)
    for _ in range(10):
        m = int(draw.integers(2, 60))
        observed = draw.random(m) < draw.choice([0.05, 0.5])
        cm, bp = draw.random(m) * 0.05, draw.random(m) * 5000 + 1
        assert psmc.breakpoints(observed, cm, bp, demography, 1.4e-8, 8) == slow_breakpoints(observed, cm, bp, demography, 1.4e-8, 8)


def path_cost(own, panel, path, cost):
    switch, stay, mismatch, match = cost
    total = 0.0
    for j, k in enumerate(path):
        if j:
            total += stay[j] if path[j - 1] == k else switch[j]
        else:
            total += min(stay[0], switch[0])
        total += match[j] if panel[k, j] == own[j] else mismatch[j]
    return total


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_best_path_is_the_cheapest(seed):
    draw = np.random.default_rng(seed)
    n, m = 3, 6
    panel, own = draw.integers(0, 2, (n, m)), draw.integers(0, 2, m)
    cost = tuple(np.full(m, x) for x in (2.1, 0.013, 3.07, 0.011))
    found = copying.best_path(own, panel, [0, 1, 2], [(0, [0, 1, 2])], cost)
    path = []
    for (start, k), end in zip(found, [*[s for s, _ in found[1:]], m], strict=True):
        path += [k] * (end - start)
    least = min(path_cost(own, panel, p, cost) for p in itertools.product(range(n), repeat=m))
    assert path_cost(own, panel, path, cost) == pytest.approx(least)


def test_best_path_changes_candidates():
    own = np.array([0, 0, 0, 1, 1, 1])
    panel = np.array([[0] * 6, [1] * 6])
    cost = tuple(np.full(6, x) for x in (1.0, 0.01, 3.0, 0.01))
    assert copying.best_path(own, panel, [4, 9], [(0, [4]), (3, [9])], cost) == [(0, 4), (3, 9)]
    assert copying.best_path(own, panel, [4, 9], [(0, [4, 9])], cost) == [(0, 4), (3, 9)]


def test_posterior_against_all_paths():
    draw = np.random.default_rng(5)
    n, m, mu = 3, 5, 0.02
    panel, query, r = draw.integers(0, 2, (n, m)), draw.integers(0, 2, m), draw.random(m) * 0.4
    e = copying.emissions(panel, query, mu)
    total = np.zeros((m, n))
    for path in itertools.product(range(n), repeat=m):
        p = e[path[0], 0] / n
        for j in range(1, m):
            p *= (r[j] / n + (1 - r[j]) * (path[j] == path[j - 1])) * e[path[j], j]
        for j, k in enumerate(path):
            total[j, k] += p
    expected = total / total.sum(axis=1, keepdims=True)
    assert copying.posterior(panel, query, r, mu) == pytest.approx(expected)
    with pytest.raises(ValueError):
        copying.posterior(panel, query, r[:-1], mu)


def test_neighbours_against_scanning(spark):
    draw = np.random.default_rng(2)
    n = 40
    rows, expected = [], set()
    for site in range(3):
        order = draw.permutation(n).tolist()
        rows += [(site, hap, k) for k, hap in enumerate(order)]
        for i in range(1, n):
            pos, found = order.index(i), []
            left, right = [x for x in order[:pos][::-1] if x < i], [x for x in order[pos + 1 :] if x < i]
            while len(found) < 4 and (left or right):
                for side in (left, right):
                    if side and len(found) < 4:
                        found.append(side.pop(0))
            expected |= {(site, i, c) for c in found}
    got = pbwt.neighbours(spark.createDataFrame(rows, "site int, hap int, rnk int"))
    assert {tuple(r) for r in got.collect()} == expected


def test_prefix_order_over_many_blocks(spark):
    draw = np.random.default_rng(4)
    g = draw.integers(0, 2, (37, 12))
    g[30:, :] = g[:7, :]
    rows = [(s, h, int(g[h, s])) for h in range(37) for s in range(12)]
    got = {(r.site, r.hap): r.rnk for r in pbwt.prefix_ranks(spark.createDataFrame(rows, "site int, hap int, g int"), 12, block=3).collect()}
    order = list(range(37))
    for s in range(12):
        order = [h for h in order if g[h, s] == 0] + [h for h in order if g[h, s] == 1]
        assert [got[s, h] for h in order] == list(range(37))


def walked(target, height, start):
    """Heights at which each haplotype meets the start, way by way."""
    out, at, largest = {start: 0.0}, start, 0.0
    while at > 0:
        largest, at = max(largest, float(height[at])), int(target[at])
        out[at] = largest
    for i in range(len(target)):
        if i not in out:
            out[i] = max(out[int(target[i])], float(height[i]))
    return [out[i] for i in range(len(target))]


def brute_clades(target, height, carrier):
    n = len(target)
    met = trees.meeting_times(target, height, np.arange(n)).T
    best = {}
    for i in np.flatnonzero(carrier):
        for t in sorted({0.0, *met[i]}, reverse=True):
            clade = tuple(np.flatnonzero(met[i] <= t).tolist())
            if all(carrier[j] for j in clade):
                outside = [met[i][j] for j in range(n) if j not in clade]
                best[clade] = (max(met[a][b] for a in clade for b in clade), min(outside, default=float("inf")))
                break
    return sorted((list(c), lo, hi) for c, (lo, hi) in best.items())


def test_branches_and_meeting_times(spark):
    draw = np.random.default_rng(6)
    rows, want = [], []
    for site in range(30):
        n = int(draw.integers(2, 12))
        target = np.array([-1] + [int(draw.integers(0, i)) for i in range(1, n)])
        height = np.append(0.0, draw.permutation(n - 1) + 1.0)
        carrier = draw.integers(0, 2, n) if site else np.ones(n, int)
        met = trees.meeting_times(target, height, np.arange(n))
        assert (met == met.T).all()
        for i in range(n):
            assert met[:, i].tolist() == walked(target, height, i)
        rows += [(site, i, int(carrier[i]), int(target[i]) if i else None, float(height[i]) if i else None) for i in range(n)]
        want += [(site, *c) for c in brute_clades(target, height, carrier)]
    state = spark.createDataFrame(rows, "site int, hap int, g int, target int, tmrca double")
    got = trees.branches(state).collect()
    assert sorted((r["site"], r["haps"], r["lower"], r["upper"]) for r in got) == sorted(want)
    assert all(r["node"] in r["haps"] for r in got)
    assert trees.branches(state.where("g = 0")).count() == 0


def test_equal_heights_merge_by_haplotype(spark):
    rows = [(0, 0, 1, None, None), (0, 1, 1, 0, 5.0), (0, 2, 0, 0, 5.0), (0, 3, 1, 0, 5.0)]
    got = trees.branches(spark.createDataFrame(rows, "site int, hap int, g int, target int, tmrca double")).collect()
    assert sorted((r["haps"], r["node"], r["lower"], r["upper"]) for r in got) == [([0, 1], 1, 5.0, 5.0), ([3], 3, 0.0, 5.0)]


def test_mapping_strings(spark):
    found = spark.createDataFrame([(1, [3, 4], 1.0, 2.5), (2, [3, 4], 1.0, 2.5), (2, [9], 0.0, float("inf"))], "site int, haps array<int>, lower double, upper double")
    assert {r["site"]: r["mapping"] for r in trees.mapping_strings(found).collect()} == {1: "-1,1.0000,2.5000", 2: "3.4,1.0000,2.5000;9,0.0000,inf"}


def test_inferred_paths_give_the_genotypes_back(spark, sf):
    geno = fixtures.genotypes(spark, sf).cache()
    paths = QUERIES["ls_viterbi_segments"](spark, sf).cache()
    sites = fixtures.sites(spark, sf)
    segments = ancestry.with_ends(paths.join(sites.select("site", sites.pos.alias("start_bp")), "site").selectExpr("hap", "start_bp", "target", "1.0D AS tmrca"))
    back = ancestry.reconstruct(segments, copying.mismatches(geno, paths), sites, geno.select("hap").distinct())
    assert back.exceptAll(geno).isEmpty()
    assert back.count() == geno.count()
    assert paths.where("target >= hap").isEmpty()


def test_consistent_segments_give_the_genotypes_back(spark, sf):
    fitted = QUERIES["consistency_pass"](spark, sf).cache()
    geno, sites = fixtures.genotypes(spark, sf), fixtures.sites(spark, sf)
    segments = ancestry.with_ends(fitted.where("hap > 0").select("hap", "start_bp", "target", "tmrca"))
    mism = fitted.selectExpr("hap", "explode(mismatches) AS site")
    assert ancestry.reconstruct(segments, mism, sites, geno.select("hap").distinct()).exceptAll(geno).isEmpty()


def _fit(segments, sites, n_haps):
    return consistency.fit_region(pd.DataFrame(segments, columns=["hap", "start_bp", "target", "tmrca"]), pd.DataFrame(sites, columns=["site", "pos", "age", "g"]), n_haps)


def test_consistency_moves_a_time_within_bounds():
    done, differ = _fit([(1, 0, 0, 500.0)], [(0, 0, 100.0, [1, 1]), (1, 50, 20.0, [1, 0])], 2)
    assert done[["hap", "start_bp", "target"]].values.tolist() == [[1, 0, 0]]
    assert 20 < done["tmrca"][0] < 100
    assert (1, 1) in set(zip(differ["hap"], differ["site"], strict=True))


def test_consistency_sends_carriers_to_carriers_and_breaks_at_conflicts():
    segments = [(1, 0, 0, 10.0), (2, 0, 1, 10.0), (2, 100, 0, 30.0), (3, 0, 2, 10.0)]
    sites = [(0, 0, 50.0, [0, 0, 0, 0]), (1, 60, 40.0, [0, 1, 0, 1]), (2, 100, 60.0, [0, 1, 1, 0]), (3, 200, 5.0, [0, 0, 0, 0])]
    done, differ = _fit(segments, sites, 4)
    rows = {(h, s): t for h, s, t in done[["hap", "start_bp", "target"]].values.tolist()}
    # at 60 haplotype 3 leaves 2, which carries nothing, for 1, and the times of 1 and 2 are above 40
    assert rows[3, 0] == 2 and rows[3, 60] == 1
    # at 100 a segment of haplotype 2 begins with the site: its target is swapped, not broken
    assert rows[2, 0] == 1 and rows[2, 100] == 1 and len([k for k in rows if k[0] == 2]) == 2
    assert (done[(done["hap"] == 1) & (done["start_bp"] == 0)]["tmrca"] > 60).all()
    assert (2, 1) in set(zip(differ["hap"], differ["site"], strict=True))


@pytest.mark.parametrize("text", ["chr", "1:", "1:5", "5-", "-5", "x1:1-2", "23:1-2", "0:1-2", "2-1", "1:2:3-4"])
def test_bad_regions(text):
    with pytest.raises(ValueError):
        parse_region(text)


def test_region_ignores_what_follows():
    assert parse_region("7:10-20:rest") == ("7", 10, 20)


def test_nested_and_flat(spark, sf):
    segments, mism = fixtures.segments(spark, sf).select("hap", "start_bp", "target", "tmrca"), fixtures.mismatches(spark, sf)
    back, marks = ancestry.flat(ancestry.nested(segments, mism))
    assert back.select("hap", "start_bp", "target", "tmrca").exceptAll(segments).isEmpty()
    assert marks.exceptAll(mism).isEmpty()


def test_simulated_times_have_the_right_mean(spark):
    rows = normalize.simulate(spark, 10, 2000, [1e4], [0.0], seed=3).toPandas()
    last = rows[rows["k"] == 2]["t"].mean()
    assert last == pytest.approx(2 * 1e4 * (1 - 1 / 10), rel=0.06)
    knots = normalize.expected_quantiles(normalize.simulate(spark, 5, 20, [1e4], [0.0], seed=3)).toPandas().sort_values("quantile")
    assert knots["quantile"].iloc[0] == 0 and knots["quantile"].iloc[-1] == 1
    assert knots["t"].is_monotonic_increasing


def test_phasing_prefers_near_relatives(spark):
    # haplotype 2 is near the carriers 0 and 1, haplotype 3 is not
    rows = [(0, 0, 1, None, None), (0, 1, 1, 0, 5.0), (0, 2, 1, 1, 8.0), (0, 3, 0, 0, 900.0)]
    out = trees.phase_distances(spark.createDataFrame(rows, "site int, hap int, g int, target int, tmrca double")).collect()
    assert [(r["ind"], r["phase"]) for r in out] == [(1, "1|0")]


def _instance(draw, n, m):
    panel, own = draw.integers(0, 2, (n, m)).astype(np.int8), draw.integers(0, 2, m).astype(np.int8)
    for k in range(n):  # copies of the target with a few differences, so that paths stay
        if draw.random() < 0.5:
            panel[k] = own ^ (draw.random(m) < 0.15)
    starts = sorted({0, *draw.integers(1, m, 3).tolist()})
    allowed = [(s, sorted(draw.choice(n, int(draw.integers(1, n)), replace=False).tolist())) for s in starts]
    return own, panel, allowed


def test_paths_over_stretches(spark):
    """Handed over from stretch to stretch, states give the path of one stretch."""
    draw = np.random.default_rng(8)
    m, n = 40, 9
    step, bp = draw.random(m) * 0.02, draw.random(m) * 4000
    geno, cands, want = [], [], []
    own, panel, allowed = _instance(draw, n, m)
    geno += [(s, k, int(panel[k, s])) for k in range(n) for s in range(m)]
    starts = {g: s for g, (s, _) in enumerate(allowed)}
    length = lambda k: 900.0 / k
    for hap in range(n, n + 6):
        own = panel[draw.integers(n)] ^ (draw.random(m) < 0.2)
        geno += [(s, hap, int(own[s])) for s in range(m)]
        mine = [(s, sorted(draw.choice(n, 4, replace=False).tolist())) for s, _ in allowed]
        cands += [(g, hap, c) for g, (_, ids) in enumerate(mine) for c in ids]
        path = copying.best_path(own.astype(np.int8), panel, list(range(n)), mine, copying.costs(step, bp, length(hap + 1), 1e-6, hap, False))
        want += [(hap, k, s, t) for k, (s, t) in enumerate(path)]
    geno, cands = spark.createDataFrame(geno, "site int, hap int, g int"), spark.createDataFrame(cands, "grp int, hap int, cand int")
    for stretch in (None, 40, 7, 1):
        got = copying.infer_paths(geno, cands, starts, step, bp, length, 1e-6, stretch=stretch).collect()
        assert sorted(tuple(r) for r in got) == want


def test_what_a_front_hands_over_is_bounded():
    """A row a candidate and the nodes that these rest on, however many sites went by."""
    draw = np.random.default_rng(9)
    n, m = 20, 600
    own, panel, _ = _instance(draw, n, m)
    front = copying.CandidateFront()
    front.enter(list(range(n)))
    for j in range(m):
        front.advance(j, own[j], panel[:, j], 2.0, 0.01, 2.5, 0.01)
    rows = front.rows(99, False)
    assert len(front.nodes) > 1000 and (rows["kind"] == copying.FRONT).sum() == n
    assert (rows["kind"] == copying.NODE).sum() < 200


def test_meetings_over_deep_trees(spark):
    """Doubling pointers against walking, on chains, bushes and in between; ages where nobody carries."""
    draw = np.random.default_rng(12)
    rows, want, ages = [], [], {}
    for site in range(6):
        n = 40
        target = np.array([-1] + [max(0, i - 1) if site == 0 else 0 if site == 1 else int(draw.integers(max(0, i - 5), i)) for i in range(1, n)])
        height = np.append(0.0, draw.permutation(n - 1) + 1.0)
        rows += [(site, i, 0, int(target[i]) if i else None, float(height[i]) if i else None) for i in range(n)]
        for start in (0, 7, 39):
            want += [(site, start, i, m) for i, m in enumerate(walked(target, height, start))]
        first = np.sort(walked(target, height, 0))
        ages[site] = (first[0] + first[1]) / 2
    state = spark.createDataFrame(rows, "site int, hap int, g int, target int, tmrca double")
    starts = spark.createDataFrame([(s, h) for s in range(6) for h in (0, 7, 39)], "site int, start int")
    assert sorted(tuple(r) for r in trees.meetings(state, starts).collect()) == sorted(want)
    assert {r["site"]: r["age"] for r in trees.allele_ages(state).collect()} == ages


def _phased_plainly(target, height, g):
    """(ind, d0, d1) from all meeting times."""
    n = len(target)
    met = trees.meeting_times(target, height, np.arange(n))
    dose = g[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    out = []
    for i in np.flatnonzero(dose == 1).tolist():
        d = []
        for s in (2 * i, 2 * i + 1):
            if g[: n // 2 * 2].sum() == 1:
                d.append(-min(met[x, s] for x in range(n) if x != s))
            else:
                d.append(sum(min(met[2 * j, s], met[2 * j + 1, s]) if dose[j] == 1 else met[2 * j, s] + met[2 * j + 1, s] for j in np.flatnonzero(dose)))
        out.append((i, *d))
    return out


def _aged_plainly(target, height, carrier):
    n = len(target)
    met, chain = trees.meeting_times(target, height, np.arange(n)), np.array(carrier)
    for i in range(1, n):
        chain[i] = chain[target[i]] + 1 if carrier[i] else 0
    heads = np.flatnonzero(chain == chain.max()) if chain.max() else [0]
    scored = []
    for h in heads:
        times = sorted(set(met[:, h].tolist()))
        for k, t in enumerate(times):
            low = met[:, h] <= t
            scored.append((-(carrier[low].sum() + (1 - carrier[~low]).sum()), h, t, (t + times[k + 1]) / 2 if k + 1 < len(times) else t + 1))
    return min(scored)[3]


def test_ages_and_phases_over_clusters(spark):
    draw = np.random.default_rng(21)
    rows, ages, phases = [], {}, []
    for site in range(60):
        n = int(draw.integers(2, 40))
        target = np.array([-1] + [int(draw.integers(0, i if draw.random() < 0.5 else min(i, 3))) for i in range(1, n)])
        height = np.append(0.0, draw.integers(0 if site % 5 == 0 else 1, 3 + site // 2, n - 1).astype(float))  # equal heights too
        g = (draw.random(n) < (0.5, 0.1, 0.95, 0.02)[site % 4]).astype(int)
        rows += [(site, i, int(g[i]), int(target[i]) if i else None, float(height[i]) if i else None) for i in range(n)]
        ages[site] = _aged_plainly(target, height, g)
        phases += [(site, *x) for x in _phased_plainly(target, height, g)]
    state = spark.createDataFrame(rows, "site int, hap int, g int, target int, tmrca double")
    assert {r["site"]: r["age"] for r in trees.allele_ages(state).collect()} == ages
    assert sorted((r["site"], r["ind"], r["d0"], r["d1"]) for r in trees.phase_distances(state).collect()) == sorted(phases)


def test_ages_of_many_equal_chains_are_quick():
    # every carrier copies the first haplotype, so that half of all are starts
    draw, n = np.random.default_rng(4), 60_000
    target, height, carrier = np.zeros(n, int), draw.integers(100, 1100, n).astype(float), draw.integers(0, 2, n)
    began = time.process_time()
    assert trees.allele_age(target, height, carrier) > 0
    assert time.process_time() - began < 15


def test_neighbours_of_a_large_site_take_little_memory():
    n = 100_000
    frame = pd.DataFrame({"site": 3, "hap": np.arange(n), "rnk": np.random.default_rng(2).permutation(n)}).astype("int32")
    tracemalloc.start()
    found = pbwt.neighbours_of_site(frame, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4 * n - 10 and most < 25e6  # some 60 bytes a neighbour; lists and pairs took 200
    assert len(pbwt.neighbours_of_site(frame.iloc[:1], 4)) == 0


def test_many_targets_are_no_frame_each(spark, monkeypatch):
    # a frame and its columns took longer than a target's work
    draw = np.random.default_rng(8)
    n, m = 400, 12
    alleles = draw.integers(0, 2, (n, m))
    geno = spark.createDataFrame([(j, k, int(alleles[k, j])) for k in range(n) for j in range(m)], "site int, hap int, g int")
    cands = spark.createDataFrame([(g, h, c) for g in (0, 1) for h in range(1, n) for c in {int(x) for x in draw.integers(0, h, 3)}], "grp int, hap int, cand int")
    kinds, by_target = [], copying.by_target
    monkeypatch.setattr(copying, "by_target", lambda *a: (kinds.append(by_target(*a)._jdf.queryExecution().analyzed().toString()), by_target(*a))[1])
    args = {0: 0, 1: 5}, np.full(m, 0.01), np.full(m, 100.0), lambda x: 1000.0 / x, 1e-6
    found = [sorted(tuple(r) for r in copying.infer_paths(geno, cands, *args, stretch=s).collect()) for s in (m, 5)]
    assert found[0] == found[1] and {r[0] for r in found[0]} == set(range(1, n))
    assert len(kinds) == 6 and all("MapInArrow" in x and "FlatMapGroups" not in x.split("MapInArrow")[0] for x in kinds)


def test_mapped_imputation_finds_the_near_references_once(spark, sf, monkeypatch):
    """Match sets and dated segments share them."""
    made, plain = [], panels.typed_near
    monkeypatch.setattr(panels, "typed_near", lambda *a: made.append(1) or plain(*a))
    assert QUERIES["imputed_dosage_mapped"](spark, sf).count() > 0
    assert len(made) == 1


def test_posteriors_pack_only_what_is_in_a_set(spark, monkeypatch):
    draw = np.random.default_rng(3)
    alleles = draw.integers(0, 2, (40, 6))
    geno = spark.createDataFrame([(j, k, int(alleles[k, j])) for k in range(40) for j in range(6)], "site int, hap int, g int")
    sets = spark.createDataFrame([(38, 3), (38, 7), (39, 3)], "target int, ref int")
    seen, plain = [], copying.packed
    monkeypatch.setattr(copying, "packed", lambda rows: seen.append(sorted(r["hap"] for r in rows.select("hap").distinct().collect())) or plain(rows))
    found = copying.posteriors(geno, sets, np.full(6, 0.1)).collect()
    assert seen == [[3, 7, 38, 39]] and len(found) == 18
    p = copying.posterior(alleles[[3, 7]].astype(np.int8), alleles[38].astype(np.int8), np.full(6, 0.1), 1e-4)
    assert {(r["site"], r["ref"]): round(r["p"], 12) for r in found if r["target"] == 38} == {(j, ref): round(p[j, k], 12) for j in range(6) for k, ref in enumerate((3, 7))}


@pytest.mark.parametrize("few", [1, 10])
def test_rows_among_few_and_many_keys(spark, monkeypatch, few):
    monkeypatch.setattr(lineage, "FEW", few)
    rows = spark.createDataFrame([(x, x % 5) for x in range(20)] + [(99, None)], "a int, k int")
    keys = spark.createDataFrame([(1,), (1,), (3,), (None,), (8,)], "k int")
    found = lineage.among(rows, keys, "k")
    assert found.columns == ["a", "k"] and sorted(r["a"] for r in found.collect()) == [x for x in range(20) if x % 5 in (1, 3)]


def test_open_intervals_alone_are_in_few_bins(spark):
    """As where every target copies one haplotype to the end."""
    points = spark.createDataFrame([(5.0,), (4e9,)], "at double")
    spans = spark.createDataFrame([(k, 10.0 * k, None) for k in range(3)], "k int, low double, high double")
    found = intervals.covering(points, "at", spans, "low", "high")
    assert sorted((r["at"], r["k"]) for r in found.collect()) == [(5.0, 0), (4e9, 0), (4e9, 1), (4e9, 2)]
    mixed = spans.unionByName(spark.createDataFrame([(3, 0.0, 5.0), (4, 1.0, 6.0), (5, None, None)], "k int, low double, high double"))
    found = intervals.covering(points, "at", mixed, "low", "high")
    assert sorted((r["at"], r["k"]) for r in found.collect()) == [(5.0, 0), (5.0, 4), (4e9, 0), (4e9, 1), (4e9, 2)]
    assert intervals.covering(points.limit(0), "at", mixed, "low", "high").isEmpty()
