"""Trees at single sites: times to common ancestors, allele ages, and branches of variants.

At a site each haplotype but the first has an edge to its target, of the height at which they meet;
two haplotypes meet at the largest height on their path. Trees are walked by joins on (site,
haplotype), pointers doubling. Where many starts a site are met with all haplotypes, a site is a
task's work: all that meet below a height are a cluster, the clusters form a tree too, and sums and
maxima along its ways up (pointers doubling in arrays) take the place of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, dealt


@dataclass(frozen=True)
class Clusters:
    """Haplotypes 0 to n - 1 and the clusters in which they meet, a larger number above a smaller one; the
    last is its own parent. height: at which a cluster's parts meet, 0 of haplotypes."""

    parent: np.ndarray
    height: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of haplotypes (or of these and clusters), over each cluster."""
        counts = np.pad(np.asarray(values, np.int64), (0, len(self.parent) - len(values))).tolist()
        for node, above in enumerate(self.parent[:-1].tolist()):
            counts[above] += counts[node]
        return np.array(counts, np.int64)

    def along(self, values: np.ndarray, of, none: float) -> np.ndarray:
        """`of` (maximum or add) over each cluster and all above it."""
        values, pointer, top = values.copy(), self.parent.copy(), len(self.parent) - 1
        first, values[top] = values[top], none  # the top is met by every way, and counts once
        while (pointer != top).any():
            values, pointer = of(values, values[pointer]), pointer[pointer]
        return of(values, first)

    def meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest cluster with both haplotypes of each pair. Steps twice as long each time, taken
        from the longest on while they lead to different clusters."""
        n, top = len(self.parent), len(self.parent) - 1
        steps, depth = [self.parent.astype(np.int32)], self.along(np.where(np.arange(n) == top, 0, 1), np.add, 0)
        while (steps[-1] != top).any():
            steps.append(steps[-1][steps[-1]])
        low, high = np.where(depth[a] >= depth[b], a, b), np.where(depth[a] >= depth[b], b, a)
        rest = depth[low] - depth[high]
        for k, step in enumerate(steps):
            low = np.where(rest >> k & 1, step[low], low)
        for step in reversed(steps):
            apart = step[low] != step[high]
            low, high = np.where(apart, step[low], low), np.where(apart, step[high], high)
        return np.where(low == high, low, self.parent[low])


def clusters(target: np.ndarray, height: np.ndarray) -> Clusters:
    """Edges from the lowest to the highest join what they meet; target[0] is not read. Edges of one
    height that meet make one cluster."""
    n = len(target)
    height = np.maximum(np.asarray(height, float), 0.0)
    order = np.argsort(height[1:], kind="stable") + 1
    parent, heights, root, top = list(range(n)), [0.0] * n, list(range(n)), list(range(n))
    for hap, other, at in zip(order.tolist(), np.maximum(np.asarray(target, np.int64), 0)[order].tolist(), height[order].tolist(), strict=True):
        while root[hap] != hap:
            root[hap] = hap = root[root[hap]]
        while root[other] != other:
            root[other] = other = root[root[other]]
        a, b = top[hap], top[other]
        above, below = max(a, b), min(a, b)  # the later one is at least as high
        if above < n or heights[above] != at:
            above = len(parent)
            parent.append(above)
            heights.append(at)
            parent[a] = parent[b] = above
        parent[below] = above
        root[hap], top[other] = other, above
    return Clusters(np.array(parent, np.int64), np.array(heights))


def meeting_times(target: np.ndarray, height: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """haplotypes x starts: heights at which they meet; target[0] is not read. Ways up from the starts
    are walked for all starts at once; others reach these by pointers that double."""
    n, columns = len(target), np.arange(len(starts))
    met, pointer = np.full((n, len(starts)), -1.0), np.empty((n, len(starts)), np.int64)
    at, largest, open_ = np.array(starts, np.int64), np.zeros(len(starts)), columns
    while len(open_):
        met[at[open_], open_] = largest[open_]
        open_ = open_[at[open_] > 0]
        largest[open_] = np.maximum(largest[open_], height[at[open_]])
        at[open_] = target[at[open_]]
    known = met >= 0
    pointer[:] = np.where(known, np.arange(n)[:, None], np.asarray(target, np.int64)[:, None])
    met = np.where(known, met, np.asarray(height, float)[:, None])
    while True:
        beyond = np.take_along_axis(met, pointer, axis=0)
        met = np.maximum(met, beyond)
        further = np.take_along_axis(pointer, pointer, axis=0)
        if (further == pointer).all():
            return met
        pointer = further


def allele_age(target: np.ndarray, height: np.ndarray, carrier: np.ndarray) -> float:
    """The time that best separates carriers from others, seen from the longest chains of carriers (from
    the first haplotype where there are none); of equally good ones the first by haplotype, then by
    time. Half-way to the next meeting, or one more than the last."""
    n = len(carrier)
    chain, pointer = (carrier > 0).astype(np.int64), np.where(np.asarray(target) >= 0, target, 0).astype(np.int64)
    going = (carrier > 0) & (np.arange(n) > 0)  # a chain goes on above its haplotype
    while going.any():
        more, further, on = chain[pointer], pointer[pointer], going[pointer] & (carrier[pointer] > 0)
        chain, pointer, going = np.where(going, chain + more, chain), np.where(going, further, pointer), going & on
    starts = np.flatnonzero(chain == chain.max()) if chain.max() else np.array([0])
    found = clusters(target, height)
    size, held = found.sums(np.ones(n)), found.sums(carrier > 0)
    m, nodes = len(found.parent), np.arange(len(found.parent))
    ends = (nodes == m - 1) | (found.height[found.parent] > found.height)  # a bin ends with its last member
    score = held + (n - held[-1]) - (size - held)
    # on a start's way up a smaller number is an earlier time
    best = found.along(np.where(ends, score * m + (m - 1 - nodes), -1), np.maximum, -1)[starts]
    node = m - 1 - int(best[(best // m).argmax()]) % m
    here = found.height[node]
    return float(here + 1) if node == m - 1 else float((here + found.height[found.parent[node]]) / 2)


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    frame = frame.sort_values("hap", ignore_index=True)
    return frame["target"].fillna(-1).to_numpy(np.int64), frame["tmrca"].fillna(0.0).to_numpy(float), frame["g"].to_numpy(np.int64)


def states(genotypes: DataFrame, at_sites: DataFrame) -> DataFrame:
    """site, hap, g, target, tmrca, the first haplotype without target."""
    return genotypes.join(at_sites, ["site", "hap"], "left")


def _up(state: DataFrame) -> DataFrame:
    """site, hap, next, way: each haplotype's target and the height at which they meet."""
    return cut(state.where("target IS NOT NULL").select("site", "hap", F.col("target").alias("next"), F.col("tmrca").cast("double").alias("way")))


def ways_up(up: DataFrame, starts: DataFrame) -> DataFrame:
    """site, start, at, met: each start (site, start), all above it, and the heights at which they meet:
    the largest on the way. Ways twice as long each time."""
    found = cut(starts.select("site", "start", F.col("start").alias("at"), F.lit(0.0).alias("met")))
    while not up.isEmpty():
        step = up.select("site", F.col("hap").alias("at"), "next", "way")
        more = found.join(step, ["site", "at"]).select("site", "start", F.col("next").alias("at"), F.greatest("met", "way").alias("met"))
        found = cut(found.unionByName(more))
        on = up.select("site", F.col("hap").alias("next"), F.col("next").alias("far"), F.col("way").alias("further"))
        up = cut(up.join(on, ["site", "next"]).select("site", "hap", F.col("far").alias("next"), F.greatest("way", "further").alias("way")))
    return found


def meetings(state: DataFrame, starts: DataFrame) -> DataFrame:
    """site, start, hap, met of all haplotypes with each start. What is not above the start leads up to
    something that is; pointers double until they reach what is known."""
    up = _up(state)
    known = ways_up(up, starts).withColumnRenamed("at", "hap")
    rest = cut(starts.join(up, "site").join(known, ["site", "start", "hap"], "left_anti").select("site", "start", "hap", "next", "way"))
    out = known
    while not rest.isEmpty():
        ends = known.select("site", "start", F.col("hap").alias("next"), "met")
        seen = cut(rest.join(ends, ["site", "start", "next"], "left"))
        known = seen.where("met IS NOT NULL").select("site", "start", "hap", F.greatest("way", "met").alias("met"))
        out = out.unionByName(known)
        left = seen.where("met IS NULL").drop("met")
        # a pointer's end that is known by now will be found among `known` next time
        on = left.select("site", "start", F.col("hap").alias("next"), F.col("next").alias("far"), F.col("way").alias("further"))
        rest = cut(left.join(on, ["site", "start", "next"], "left").select("site", "start", "hap", F.coalesce("far", "next").alias("next"), F.greatest("way", "further").alias("way")))
        known = out
    return out.select("site", "start", "hap", "met")


def allele_ages(state: DataFrame) -> DataFrame:
    """site, age. Many starts a site would be as many rows a haplotype, so a site is a task's work."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"site": [frame["site"].iloc[0]], "age": [allele_age(*_arrays(frame))]})

    return dealt(state, "site").groupBy("site").applyInPandas(one, "site int, age double")


def tmrca_to(state: DataFrame, start: int) -> DataFrame:
    """site, hap, tmrca with one haplotype."""
    starts = state.select("site").distinct().withColumn("start", F.lit(start))
    return meetings(state, starts).select("site", "hap", F.col("met").alias("tmrca"))


def _climbed(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, hap, at, way) from each carrier to all carriers above it that it reaches through carriers,
    with the last merge on the way, and (site, hap, way) to the first other haplotype above. Merges go
    by height, then by haplotype, whose edge it is. A level of the trees a join."""
    carriers = state.where("g = 1").select("site", "hap", "target", edge("tmrca", "hap").alias("edge"))
    pure = carriers.select("site", F.col("hap").alias("next"), F.lit(True).alias("pure"))
    step = cut(carriers.where("target IS NOT NULL").select("site", F.col("hap").alias("at"), F.col("target").alias("next"), "edge").join(pure, ["site", "next"], "left"))
    here = cut(carriers.select("site", "hap", F.col("hap").alias("at"), F.lit(None).cast(step.schema["edge"].dataType).alias("way")))
    reached, left = here, None
    while not here.isEmpty():
        up = cut(here.join(step, ["site", "at"]).select("site", "hap", F.col("next").alias("at"), F.greatest("way", "edge").alias("way"), "pure"))
        here = up.where("pure").drop("pure")
        out = up.where("pure IS NULL").select("site", "hap", "way")
        reached, left = reached.unionByName(here), out if left is None else left.unionByName(out)
    return reached, left if left is not None else here.select("site", "hap", "way")


def edge(height: str, hap: str) -> Column:
    return F.struct(F.col(height).cast("double").alias("height"), F.col(hap).alias("hap"))


def branches(state: DataFrame) -> DataFrame:
    """site, haps, node, lower, upper of the largest clades of carriers only, the fewest branches that
    explain a site: the clade's height and that of the branch above (infinite at the root). node: the
    haplotype whose edge closes the clade, or the only one in it, with its edge.

    A carrier's clade ends below the merge that first leads to another haplotype: the least, over the
    ways through carriers, of the last merge on each way. Carriers with one such merge are one clade."""
    reached, above = _climbed(state)
    edges = state.where("target IS NOT NULL").select("site", "hap", "target", "g", edge("tmrca", "hap").alias("edge"))
    outside = edges.where("g = 0").groupBy("site", F.col("target").alias("hap")).agg(F.min("edge").alias("own"))
    below = reached.join(outside, ["site", "hap"]).groupBy("site", "at").agg(F.min(F.greatest("way", "own")).alias("below"))
    ends = reached.join(below, ["site", "at"]).select("site", "hap", F.greatest("way", "below").alias("way")).unionByName(above)
    ends = ends.groupBy("site", "hap").agg(F.min("way").alias("end"))
    carriers = state.where("g = 1").select("site", "hap", "target", edge("tmrca", "hap").alias("edge"))
    placed = cut(carriers.join(ends, ["site", "hap"], "left"))
    of_target = placed.select("site", F.col("hap").alias("target"), F.col("end").alias("target_end"), F.lit(True).alias("held"))
    inner = F.when(F.col("held") & F.col("end").eqNullSafe(F.col("target_end")), F.col("edge"))
    rows = placed.join(of_target, ["site", "target"], "left").withColumn("inner", inner)
    found = rows.groupBy("site", "end").agg(F.sort_array(F.collect_list("hap")).alias("haps"), F.max("inner").alias("top"))
    node = F.coalesce(F.col("top.hap"), F.col("haps")[0])
    return found.select("site", "haps", node.alias("node"), F.coalesce("top.height", F.lit(0.0)).alias("lower"), F.coalesce("end.height", F.lit(float("inf"))).alias("upper"))


def mapping_strings(found: DataFrame) -> DataFrame:
    """site, mapping: `-1,lower,upper` for one branch, else `id.id,lower,upper` joined by `;`."""
    heights = F.format_string("%.4f,%.4f", "lower", "upper")
    finite = F.when(F.col("upper") == float("inf"), F.concat(F.format_string("%.4f", "lower"), F.lit(",inf"))).otherwise(heights)
    rows = found.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("haps", finite.alias("at")))).alias("b"))
    many = F.array_join(F.transform("b", lambda x: F.concat_ws(",", F.array_join(x["haps"].cast("array<string>"), "."), x["at"])), ";")
    return rows.select("site", F.when(F.size("b") == 1, F.concat(F.lit("-1,"), F.col("b")[0]["at"])).otherwise(many).alias("mapping"))


def map_variants(state: DataFrame, frequencies: DataFrame, maf: float) -> DataFrame:
    """site, flipped, mapping of the variants to be mapped: the rarer allele's branches, `NaN` without any."""
    wanted = frequencies.where((F.col("maf") <= maf) & (F.col("maf") > 0)).select("site", "flipped")
    rarer = state.join(wanted, "site").withColumn("g", F.abs(F.col("g") - F.col("flipped")))
    found = mapping_strings(branches(rarer))
    return wanted.join(found, "site", "left").select("site", "flipped", F.coalesce("mapping", F.lit("NaN")).alias("mapping"))


def phase_distances(state: DataFrame) -> DataFrame:
    """site, ind, d0, d1, phase of heterozygous individuals: to how recent relatives each of the two
    haplotypes leads among the carriers; the nearer one gets the ALT allele."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        target, height, g = _arrays(frame)
        dose = g[: len(g) // 2 * 2].reshape(-1, 2).sum(axis=1)
        het, hom = np.flatnonzero(dose == 1), np.flatnonzero(dose == 2)
        found = clusters(target, height)
        starts = np.stack([2 * het, 2 * het + 1], axis=1)
        if len(het) + 2 * len(hom) == 1:  # the branch above, the longer one first
            distance = -found.height[found.parent[starts]]
        else:
            # what each cluster meets: both haplotypes of some, the nearer one of others
            both = np.bincount(found.meeting(starts[:, 0], starts[:, 1]), minlength=len(found.parent))
            once, twice = np.repeat(dose == 1, 2), np.repeat(dose == 2, 2)
            met = found.sums(once.astype(np.int64) + twice) - found.sums(both)
            more = found.height[found.parent] * (met[found.parent] - met)
            distance = found.along(more, np.add, 0.0)[starts]
        out = [(ind, a, b, "1|0" if a <= b else "0|1") for ind, (a, b) in zip(het.tolist(), distance.tolist(), strict=True)]
        rows = pd.DataFrame(out, columns=["ind", "d0", "d1", "phase"])
        rows.insert(0, "site", frame["site"].iloc[0])
        return rows.astype({"ind": "int32"})

    return dealt(state, "site").groupBy("site").applyInPandas(one, "site int, ind int, d0 double, d1 double, phase string")
