"""The cheapest mosaic of a whole panel, and all haplotypes that share its segments.

All haplotypes that agree since the last switch are one state: they stand side by side in prefix
order, so that a state is an interval of ranks with a start and a cost. An allele cuts an interval in
two by the counts of zeros and ones before its ends. A state dearer than a switch from the best one
is dropped, as is one inside another that costs less. Costs are whole numbers, so that equal costs
are equal: a path goes on rather than switches, and of equal haplotypes the smallest id is copied.

A chromosome goes in stretches of sites: a task holds a stretch of the panel and the fronts of some
targets, and hands these over to the next stretch as rows, with the switches that they still rest on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, dealt
from . import coordinates, dating, penalties
from .demography import Demography
from .panel import BLOCK, Panel, whole_keys

UNIT = 1_000_000  # parts of a cost
ROWS = "target int, kind int, start int, prev int, ref int, low int, high int, score long"
FRONT, SWITCH = 0, 1
CELLS = 1 << 25  # alleles of a stretch that a task holds


def whole(cost: Column) -> Column:
    """A cost in whole parts."""
    return F.round(cost * UNIT).cast("long")


def whole_costs(sites: DataFrame, n: int, demography: Demography, rate: float, dense: bool) -> DataFrame:
    """site, stay, switch, match, mismatch in parts, for a panel of n; sites: site, pos, cm, numbered
    without gaps. dense: a switch picks one of n haplotypes."""
    span = sites.agg(((F.max("pos") - F.min("pos")) / F.count("*")).alias("span")).first()["span"]
    t = demography.branch_length(n + 1)
    mismatch, match = penalties.mutation(F.lit(span), rate, t)
    switch, stay = penalties.recombination(F.col("size"), t, F.lit(float(n)) if dense else None)
    return coordinates.site_sizes(sites, "cm").select("site", *[whole(c).alias(name) for name, c in (("stay", stay), ("switch", switch), ("match", match), ("mismatch", mismatch))])


class Front:
    """The states of one target: intervals of ranks, the site at which each began, and its cost."""

    def __init__(self, rows: pd.DataFrame | None, n: int) -> None:
        if rows is None:
            self.low, self.high, self.start, self.score = (np.array([x], np.int64) for x in (0, n, 0, 0))
        else:
            self.low, self.high, self.start, self.score = (rows[c].to_numpy(np.int64) for c in ("low", "high", "start", "score"))
        self.switches: list[tuple[int, int, int, int, int, int]] = []  # start, previous start, ref, low, high, score
        self.most = 0

    def site(self, zeros: np.ndarray, allele: int, stay: int, match: int, mismatch: int) -> None:
        """Every state with the target's allele and with the other one."""
        a, b = zeros[self.low], zeros[self.high]
        of = (a, b), (zeros[-1] + self.low - a, zeros[-1] + self.high - b)
        low, high = (np.concatenate([of[allele][k], of[1 - allele][k]]) for k in (0, 1))
        score = np.concatenate([self.score + (stay + match), self.score + (stay + mismatch)])
        there = high > low
        self.low, self.high, self.score, self.start = low[there], high[there], score[there], np.concatenate([self.start, self.start])[there]

    def best(self, haps: np.ndarray) -> tuple[int, int, int, int, int]:
        """(start, ref, low, high, cost) of the cheapest state: the smallest id, then the longest."""
        z = self.score.min()
        at = np.flatnonzero(self.score == z)
        k = min(at.tolist(), key=lambda i: (haps[self.low[i] : self.high[i]].min(), self.start[i]))
        return int(self.start[k]), int(haps[self.low[k] : self.high[k]].min()), int(self.low[k]), int(self.high[k]), int(z)

    def switch(self, site: int, n: int, extra: int, haps: np.ndarray) -> None:
        """What costs more than a switch from the best state goes; the switch is a new state of all."""
        start, ref, low, high, z = self.best(haps)
        bound = z + extra
        kept = self.score <= bound
        if kept.sum() > 1:
            inside = (self.low[:, None] >= self.low) & (self.high[:, None] <= self.high) & (self.score[:, None] > self.score)
            kept &= ~inside.any(axis=1)
        self.low, self.high, self.start, self.score = (np.append(x[kept], y) for x, y in ((self.low, 0), (self.high, n), (self.start, site), (self.score, bound)))
        self.switches.append((site, start, ref, low, high, bound))
        self.most = max(self.most, len(self.low))

    def rows(self, target: int) -> pd.DataFrame:
        """The front, and the switches that it rests on."""
        front = pd.DataFrame({"target": target, "kind": FRONT, "start": self.start, "prev": -1, "ref": -1, "low": self.low, "high": self.high, "score": self.score})
        needed, used = set(self.start.tolist()), []
        for x in reversed(self.switches):  # later ones rest on earlier ones
            if x[0] in needed:
                needed.add(x[1])
                used.append((target, SWITCH, *x))
        return pd.concat([front, pd.DataFrame(used, columns=front.columns)], ignore_index=True).astype("int64")


def _stretch(n: int):
    """A task's work: the fronts of its targets over a stretch of sites."""

    def task(key: tuple, sites: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sites, targets, fronts = sites.sort_values("site"), rows[rows["site"] >= 0], rows[rows["site"] < 0]
        before = dict(list(fronts[fronts["kind"] == FRONT].groupby("target"))) if len(fronts) else {}
        alleles = {int(t): dict(zip(x["site"].tolist(), x["g"].tolist(), strict=True)) for t, x in targets.groupby("target")}
        state = {t: Front(before.get(t), n) for t in alleles}
        for site, column, haps, stay, extra, match, mismatch, last in sites[["site", "alleles", "haps", "stay", "extra", "match", "mismatch", "last"]].itertuples(index=False):
            zeros = np.concatenate([[0], np.cumsum(1 - np.asarray(column, np.int64))])
            haps = np.asarray(haps, np.int64)
            for t, front in state.items():
                front.site(zeros, int(alleles[t][site]), stay, match, mismatch)
                if last:
                    start, ref, low, high, z = front.best(haps)
                    front.switches.append((site + 1, start, ref, low, high, z))
                    front.start = np.array([site + 1])
                    front.low, front.high, front.score = np.array([low]), np.array([high]), np.array([z])
                else:
                    front.switch(site + 1, n, extra, haps)
        return pd.concat([f.rows(t) for t, f in state.items()], ignore_index=True)

    return task


def paths(panel: Panel, targets: DataFrame, costs: DataFrame, tasks: int = 64, stretch: int | None = None) -> DataFrame:
    """target, seg_idx, start, end (exclusive), ref, low, high (ranks after the segment's last site of
    all that agree on it), cost (of the whole path, in parts). targets: site, hap, g; costs: site,
    stay, switch, match, mismatch, in parts, the switch being that from this site to the next."""
    n = panel.n_haps
    size = stretch or max(1, CELLS // max(n, 1))
    last = panel.n_sites - 1
    of = F.pmod(F.xxhash64("target"), F.lit(tasks)).cast("int")
    own = cut(targets.select(F.col("hap").alias("target"), "site", "g").withColumn("task", of))
    used = own.select("task").distinct()
    rows = cut(panel.columns.join(costs.select("site", "stay", (F.col("switch") - F.col("stay")).alias("extra"), "match", "mismatch"), "site").withColumn("last", F.col("site") == last))
    front = own.sparkSession.createDataFrame([], ROWS)
    every = []
    for low in range(0, panel.n_sites, size):
        here = F.col("site").between(low, low + size - 1)
        part, alleles = rows.where(here).crossJoin(F.broadcast(used)), own.where(here)  # at most `tasks` copies of the stretch
        # a cogroup takes two sides: alleles and fronts go as one, told apart by the site
        mine = alleles.select("task", "target", "site", "g", *[F.lit(None).cast("long").alias(c) for c in ("kind", "start", "low", "high", "score")])
        held = front.where(F.col("kind") == FRONT).withColumn("task", of).select("task", "target", F.lit(-1).alias("site"), F.lit(0).alias("g"), *[F.col(c).cast("long").alias(c) for c in ("kind", "start", "low", "high", "score")])
        part = part.select(*[F.col(c).alias(c) for c in part.columns])  # both sides may stem from one table
        front = cut(dealt(part, "task").groupBy("task").cogroup(dealt(mine.unionByName(held), "task").groupBy("task")).applyInPandas(_stretch(n), ROWS))
        every.append(front.where(F.col("kind") == SWITCH))
    switches = every[0]
    for x in every[1:]:
        switches = switches.unionByName(x)
    return _traced(switches, panel.n_sites)


def _traced(switches: DataFrame, n_sites: int) -> DataFrame:
    """From the end back through the switches of each target."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        by_start = {r.start: r for r in frame.itertuples(index=False)}
        at, out = n_sites, []
        cost = by_start[n_sites].score
        while at > 0:
            r = by_start[at]
            out.append((r.target, r.prev, at, r.ref, r.low, r.high, cost))
            at = r.prev
        out = pd.DataFrame(out[::-1], columns=["target", "start", "end", "ref", "low", "high", "cost"])
        out.insert(1, "seg_idx", range(len(out)))
        return out

    return switches.groupBy("target").applyInPandas(one, "target int, seg_idx int, start int, end int, ref int, low int, high int, cost long")


def members(panel: Panel, found: DataFrame) -> DataFrame:
    """target, seg_idx, start, end, ref: all haplotypes of the panel that agree with the one copied over
    the segment: those between its ranks after the last site, cut out of the site's column."""
    each = found.select("target", "seg_idx", "start", "end", "low", "high", (F.col("end") - 1).alias("site"))
    between = F.slice("haps", F.col("low") + 1, F.col("high") - F.col("low"))
    return each.join(panel.columns.select("site", "haps"), "site").select("target", "seg_idx", "start", "end", F.explode(between).alias("ref"))


def overlaps(panel: Panel, targets: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds low and high to members: how far beyond both ends of the segment they equal the target.
    Alleles are compared block by block as numbers, a row a pair."""
    listed = lambda keys, name: keys.groupBy("hap").agg(F.array_sort(F.collect_list(F.struct("block", "key"))).alias("k")).select(F.col("hap").alias(name), F.col("k.key").alias(f"{name}_k"))
    rows = shared.join(listed(panel.keys, "ref"), "ref").join(listed(whole_keys(targets), "target"), "target")
    rows = rows.withColumn("x", F.zip_with("ref_k", "target_k", lambda a, b: a.bitwiseXOR(b)))
    highest = lambda x: F.floor(F.log2(x.cast("double")))
    below = F.expr(f"shiftleft(1L, start % {BLOCK}) - 1")
    from_end = F.expr(f"shiftleft(-1L, end % {BLOCK})")
    sb, eb = F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK)
    before = lambda x, b: F.when(b < sb, x).when(b == sb, x.bitwiseAND(below)).otherwise(0)
    after = lambda x, b: F.when(b > eb, x).when(b == eb, x.bitwiseAND(from_end)).otherwise(0)
    last = F.array_max(F.transform("x", lambda x, b: F.when(before(x, b) != 0, b * BLOCK + highest(before(x, b)) + 1)))
    first = F.array_min(F.transform("x", lambda x, b: F.when(after(x, b) != 0, b * BLOCK + highest(after(x, b).bitwiseAND(-after(x, b))))))
    return rows.select("target", "seg_idx", "start", "end", "ref", F.coalesce(last, F.lit(0)).cast("int").alias("low"), F.coalesce(first, F.lit(panel.n_sites)).cast("int").alias("high"))


def longest(found: DataFrame, n: int) -> DataFrame:
    """The n longest overlaps of each segment, ties to the smaller id, and a weight of 1 / their number."""
    place = F.row_number().over(Window.partitionBy("target", "seg_idx").orderBy(F.desc(F.col("high") - F.col("low")), "ref"))
    best = found.withColumn("place", place).where(F.col("place") <= n)
    return best.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("target", "seg_idx"))).drop("place")


def dated(near: DataFrame, sites: DataFrame, demography: Demography) -> DataFrame:
    """target, seg_idx, start_bp, end_bp (null for the last), ref, age: segments for imputation, their
    ages from the genetic length alone. sites: site, pos, cm."""
    upto = Window.orderBy("site").rowsBetween(Window.unboundedPreceding, -1)  # the typed sites of one chromosome
    at = coordinates.site_sizes(sites, "cm").join(sites.select("site", "pos"), "site").select("site", "pos", "size", F.coalesce(F.sum("size").over(upto), F.lit(0.0)).alias("before"))
    first = at.select(F.col("site").alias("start"), F.col("pos").alias("start_bp"), F.col("before").alias("from_cm"))
    last = at.select((F.col("site") + 1).alias("end"), (F.col("before") + F.col("size")).alias("to_cm"))
    after = at.select(F.col("site").alias("end"), F.col("pos").alias("end_bp"))
    rows = near.join(first, "start").join(last, "end").join(after, "end", "left")
    age = dating.date_segment_sparse(F.col("to_cm") - F.col("from_cm"), demography)
    return rows.select("target", "seg_idx", "start_bp", "end_bp", "ref", age.alias("age"))


def threads(panel: Panel, targets: DataFrame, found: DataFrame, sites: DataFrame, demography: Demography, rate: float) -> DataFrame:
    """target, seg_idx, start, end, start_bp, ref, hets, age of the segments of paths: their mismatches,
    and ages from these and from the sizes of their sites. Mismatches meet as blocks of alleles."""
    upto = Window.orderBy("site").rowsBetween(Window.unboundedPreceding, -1)  # the sites of one chromosome
    sizes = coordinates.site_sizes(sites, "cm").select("site", F.col("size").alias("cm")).join(coordinates.site_sizes(sites).select("site", F.col("size").alias("bp")), "site")
    sizes = sizes.select("site", "cm", "bp", *[F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(f"{c}_before") for c in ("cm", "bp")])
    first = sizes.select(F.col("site").alias("start"), F.col("cm_before").alias("cm_from"), F.col("bp_before").alias("bp_from"))
    last = sizes.select((F.col("site") + 1).alias("end"), (F.col("cm_before") + F.col("cm")).alias("cm_to"), (F.col("bp_before") + F.col("bp")).alias("bp_to"))
    starts = coordinates.starts_in_bp(sites).withColumnRenamed("site", "start")
    each = found.select("target", "seg_idx", "start", "end", "ref", F.explode(F.sequence(F.floor(F.col("start") / BLOCK).cast("int"), F.floor((F.col("end") - 1) / BLOCK).cast("int"))).alias("block"))
    own = whole_keys(targets).select("block", F.col("hap").alias("target"), F.col("key").alias("own"))
    rows = each.join(own, ["block", "target"]).join(panel.keys.select("block", F.col("hap").alias("ref"), "key"), ["block", "ref"])
    low, high = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0)), F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK))
    rows = rows.withColumns({"low": low.cast("int"), "high": high.cast("int"), "x": F.col("own").bitwiseXOR(F.col("key"))})
    inside = F.expr("x & (shiftleft(1L, high) - shiftleft(1L, low))")
    hets = rows.groupBy("target", "seg_idx").agg(F.sum(F.bit_count(inside)).alias("hets"))
    dated_rows = found.join(hets, ["target", "seg_idx"]).join(first, "start").join(last, "end").join(starts, "start")
    age = dating.date_segment(F.col("hets"), F.col("cm_to") - F.col("cm_from"), F.col("bp_to") - F.col("bp_from"), rate, demography)
    return dated_rows.select("target", "seg_idx", "start", "end", "start_bp", "ref", "hets", age.alias("age"))


PAIRS = "ind int, kind int, node long, prev long, side int, start int, end int, ref int, low int, high int, start2 int, low2 int, high2 int, score long"
_STATE = ("low", "high", "start", "low2", "high2", "start2", "node", "score")
DOMINATORS = 256  # pairs that others are compared with


class PairFront:
    """The states of one individual's doses: pairs of intervals of ranks, lazily, instead of all pairs of
    haplotypes. A pair goes when it costs more than a switch of one side from the cheapest pair with the
    other side, or of both sides from the cheapest pair, or lies in one of the cheapest that costs less.
    Segments that end are nodes (node, node before, side, start, end, ref, low, high)."""

    def __init__(self, rows: pd.DataFrame | None, n: int) -> None:
        first = dict.fromkeys(_STATE, 0) | {"high": n, "high2": n, "node": -1}
        self.s = {c: np.array([first[c]], np.int64) if rows is None else rows[c].to_numpy(np.int64) for c in _STATE}
        self.nodes: dict[int, tuple[int, int, int, int, int, int, int, int]] = {}
        self.most = 0

    def _take(self, at: np.ndarray) -> dict[str, np.ndarray]:
        return {c: x[at] for c, x in self.s.items()}

    @staticmethod
    def _join(*parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([p[c] for p in parts]) for c in _STATE}

    def site(self, zeros: np.ndarray, dose: int, stay: int, match: int, mismatch: int) -> None:
        """Both sides with both alleles."""

        def cut_by(low: np.ndarray, high: np.ndarray, allele: int) -> tuple[np.ndarray, np.ndarray]:
            a, b = zeros[low], zeros[high]
            return (zeros[-1] + low - a, zeros[-1] + high - b) if allele else (a, b)

        parts = []
        for a in (0, 1):
            for b in (0, 1):
                (low, high), (low2, high2) = cut_by(self.s["low"], self.s["high"], a), cut_by(self.s["low2"], self.s["high2"], b)
                cost = (2 * match, match + mismatch, 2 * mismatch)[abs(a + b - dose)] + 2 * stay
                at = (high > low) & (high2 > low2)
                parts.append(self._take(at) | {"low": low[at], "high": high[at], "low2": low2[at], "high2": high2[at], "score": self.s["score"][at] + cost})
        self.s = self._join(*parts)
        self._reduce(None)

    def _reduce(self, extra: int | None) -> None:
        """Of equal pairs, also the other way round, the cheapest stays; then what is dominated goes."""
        s = self.s
        turned = (s["low2"] < s["low"]) | (s["low2"] == s["low"]) & (s["high2"] < s["high"])
        key = [np.where(turned, s[b], s[a]) for a, b in (("low", "low2"), ("high", "high2"), ("low2", "low"), ("high2", "high"))]
        order = np.lexsort((s["node"], s["start2"], s["start"], s["score"], *key))
        same = np.all([k[order[1:]] == k[order[:-1]] for k in key], axis=0)
        self.s = s = self._take(np.sort(order[np.concatenate([[True], ~same])]))
        if extra is not None and extra >= 0:
            kept = s["score"] <= s["score"].min() + 2 * extra
            for low, high in (("low", "high"), ("low2", "high2")):
                _, of = np.unique(s[low] << 32 | s[high], return_inverse=True)
                least = np.full(of.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, of, s["score"])
                kept &= s["score"] <= least[of] + extra
            self.s = self._take(kept)

    def _dominated(self) -> None:
        """Each pair against the cheapest ones, the widest of equal cost first, so that the work is in
        proportion to the pairs. One that is only dominated by a dearer pair stays, and loses in the end:
        all that comes of it costs more than what comes of the other."""
        s = self.s
        left, width = np.arange(len(s["score"])), (s["high"] - s["low"]).astype(float) * (s["high2"] - s["low2"])
        order = np.lexsort((-width, s["score"]))
        for k in range(0, min(len(order), DOMINATORS), DOMINATORS // 4):
            by = {c: s[c][order[k : k + DOMINATORS // 4]] for c in ("low", "high", "low2", "high2", "score")}
            parts = [left[i : i + 4096] for i in range(0, len(left), 4096)]
            left = np.concatenate([me[~self._under(me, by)] for me in parts])
        self.s = self._take(left)

    def _under(self, me: np.ndarray, by: dict[str, np.ndarray]) -> np.ndarray:
        """Which of these pairs lie in one of `by` that costs less, also the other way round."""
        s = self.s
        within = lambda a, b, c, d: (s[a][me, None] >= by[c]) & (s[b][me, None] <= by[d])
        straight = within("low", "high", "low", "high") & within("low2", "high2", "low2", "high2")
        crossed = within("low", "high", "low2", "high2") & within("low2", "high2", "low", "high")
        return ((straight | crossed) & (s["score"][me, None] > by["score"])).any(axis=1)

    def _close(self, k: int, side: int, site: int, haps: np.ndarray, prev: int) -> int:
        low, high, start = ("low", "high", "start") if side == 0 else ("low2", "high2", "start2")
        node = (site << 24) + len(self.nodes)
        low, high, start = int(self.s[low][k]), int(self.s[high][k]), int(self.s[start][k])
        self.nodes[node] = (node, prev, side, start, site, int(haps[low:high].min()), low, high)
        return node

    def switch(self, site: int, n: int, extra: int, haps: np.ndarray) -> None:
        """Either side or both may begin anew; extra is what a switch costs beyond staying."""
        self._reduce(extra)
        s, new = self.s, []
        z = int(s["score"].min())
        for side, (low, high, low2, high2) in enumerate((("low2", "high2", "low", "high"), ("low", "high", "low2", "high2"))):
            # the cheapest pair for each interval of the side that stays
            order = np.lexsort((s["node"], s[low2], s["score"], s[high], s[low]))
            first = np.concatenate([[True], (s[low][order[1:]] != s[low][order[:-1]]) | (s[high][order[1:]] != s[high][order[:-1]])])
            for k in order[first].tolist():
                if s["score"][k] + extra <= z + 2 * max(extra, 0):
                    row = {c: int(x[k]) for c, x in s.items()}
                    row |= {low2: 0, high2: n, ("start", "start2")[side]: site, "score": row["score"] + extra, "node": self._close(k, side, site, haps, row["node"])}
                    new.append(row)
        k = int(np.lexsort((s["node"], s["low2"], s["low"], s["score"]))[0])
        node = self._close(k, 1, site, haps, self._close(k, 0, site, haps, int(s["node"][k])))
        new.append({"low": 0, "high": n, "start": site, "low2": 0, "high2": n, "start2": site, "node": node, "score": z + 2 * extra})
        self.s = self._join(s, {c: np.array([r[c] for r in new], np.int64) for c in _STATE})
        self._reduce(None)
        self._dominated()
        self.most = max(self.most, len(self.s["score"]))

    def finish(self, site: int, haps: np.ndarray) -> None:
        k = int(np.lexsort((self.s["node"], self.s["low2"], self.s["low"], self.s["score"]))[0])
        node = self._close(k, 1, site, haps, self._close(k, 0, site, haps, int(self.s["node"][k])))
        self.s = self._take(np.array([k])) | {"node": np.array([node])}

    def rows(self, ind: int) -> pd.DataFrame:
        """The front, and the nodes of the stretch that it rests on."""
        front = pd.DataFrame({"ind": ind, "kind": FRONT, "prev": -1, "side": -1, "end": -1, "ref": -1, **self.s})
        todo, needed = set(self.s["node"].tolist()), {}
        while todo:
            x = todo.pop()
            if x in self.nodes and x not in needed:
                needed[x] = self.nodes[x]
                todo.add(needed[x][1])
        used = pd.DataFrame(list(needed.values()), columns=["node", "prev", "side", "start", "end", "ref", "low", "high"]).assign(ind=ind, kind=SWITCH, start2=0, low2=0, high2=0, score=0)
        names = [c.split()[0] for c in PAIRS.split(", ")]
        return pd.concat([front[names], used[names]], ignore_index=True).astype("int64")


def _pair_stretch(n: int):
    def task(key: tuple, sites: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sites, doses, fronts = sites.sort_values("site"), rows[rows["site"] >= 0], rows[rows["site"] < 0]
        before = dict(list(fronts.groupby("ind")))
        of = {int(i): dict(zip(x["site"].tolist(), x["g"].tolist(), strict=True)) for i, x in doses.groupby("ind")}
        state = {i: PairFront(before.get(i), n) for i in of}
        for site, column, haps, stay, extra, match, mismatch, last in sites[["site", "alleles", "haps", "stay", "extra", "match", "mismatch", "last"]].itertuples(index=False):
            zeros = np.concatenate([[0], np.cumsum(1 - np.asarray(column, np.int64))])
            haps = np.asarray(haps, np.int64)
            for i, front in state.items():
                front.site(zeros, int(of[i][site]), stay, match, mismatch)
                if last:
                    front.finish(site + 1, haps)
                else:
                    front.switch(site + 1, n, extra, haps)
        return pd.concat([f.rows(i) for i, f in state.items()], ignore_index=True)

    return task


def pair_paths(panel: Panel, doses: DataFrame, costs: DataFrame, tasks: int = 64, stretch: int | None = None) -> DataFrame:
    """ind, side, seg_idx, start, end, ref, cost: the cheapest pair of mosaics for doses (site, ind, dose)
    of 0, 1 or 2 over the whole panel. A dose off by one costs a match and a mismatch, by two twice a
    mismatch; each side stays or switches at its own cost."""
    n = panel.n_haps
    size = stretch or max(1, CELLS // max(n, 1))
    of = F.pmod(F.xxhash64("ind"), F.lit(tasks)).cast("int")
    own = cut(doses.select("ind", "site", F.col("dose").alias("g")).withColumn("task", of))
    used = own.select("task").distinct()
    rows = cut(panel.columns.join(costs.select("site", "stay", (F.col("switch") - F.col("stay")).alias("extra"), "match", "mismatch"), "site").withColumn("last", F.col("site") == panel.n_sites - 1))
    front, every = own.sparkSession.createDataFrame([], PAIRS), None
    for low in range(0, panel.n_sites, size):
        here = F.col("site").between(low, low + size - 1)
        part = rows.where(here).crossJoin(F.broadcast(used))  # at most `tasks` copies of the stretch
        part = part.select(*[F.col(c).alias(c) for c in part.columns])
        mine = own.where(here).select("task", "ind", "site", "g", *[F.lit(None).cast("long").alias(c) for c in _STATE])
        held = front.where(F.col("kind") == FRONT).withColumn("task", of).select("task", "ind", F.lit(-1).alias("site"), F.lit(0).alias("g"), *[F.col(c).cast("long").alias(c) for c in _STATE])
        front = cut(dealt(part, "task").groupBy("task").cogroup(dealt(mine.unionByName(held), "task").groupBy("task")).applyInPandas(_pair_stretch(n), PAIRS))
        found = front.where(F.col("kind") == SWITCH)
        every = found if every is None else every.unionByName(found)
    ends = front.where(F.col("kind") == FRONT)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        end = frame[frame["kind"] == FRONT].iloc[0]
        nodes, at, out = {r.node: r for r in frame[frame["kind"] == SWITCH].itertuples(index=False)}, int(end["node"]), []
        while at >= 0:
            out.append((end["ind"], nodes[at].side, nodes[at].start, nodes[at].end, nodes[at].ref, end["score"]))
            at = nodes[at].prev
        out = pd.DataFrame(out, columns=["ind", "side", "start", "end", "ref", "cost"]).sort_values(["side", "start"], ignore_index=True)
        out.insert(2, "seg_idx", out.groupby("side").cumcount())
        return out

    return every.unionByName(ends).groupBy("ind").applyInPandas(one, "ind int, side int, seg_idx int, start int, end int, ref int, cost long")
