"""The copying model: a haplotype as a mosaic of others.

Per target haplotype the candidates' alleles come as one row each, so that a task holds the targets of
a batch and their candidates. Recurrences run along the sites in numpy; everything before and after is joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import among, cut, dealt

UNPHASED = -7
PATHS = "hap int, seg_idx int, site int, target int"


def packed(genotypes: DataFrame, key: str = "hap") -> DataFrame:
    """hap and its alleles in site order, as an array of bytes."""
    listed = F.array_sort(F.collect_list(F.struct("site", F.col("g").cast("tinyint").alias("g"))))
    return genotypes.groupBy(key).agg(F.transform(listed, lambda x: x["g"]).alias("alleles"))


def costs(cm_steps: np.ndarray, bp_sizes: np.ndarray, t: float, rate: float, target: int, sparse: bool) -> tuple[np.ndarray, ...]:
    """(switch, stay, mismatch, match) of each site for one target with branch length t."""
    k, l = 0.02 * cm_steps * t, 2.0 * rate * bp_sizes * t  # noqa: E741
    with np.errstate(divide="ignore"):
        switch, mismatch = -np.log1p(-np.exp(-k)), -np.log1p(-np.exp(-l))
    return (switch if sparse else switch + np.log(target)), k, mismatch, l


class CandidateFront:
    """The states of one target over its candidates: a cost and the segment begun last for each. The
    segments begun are nodes (sample, site, node before) under the number site * 2^32 + sample.

    A path goes on where that costs no more than a switch from the best one; of equal scores the
    smaller id wins. The best one so far stays a candidate when a group ends. Only nodes that the front
    rests on are kept when a stretch ends, so that what is handed over is a row a candidate and, beside
    what is already written, the nodes of the stretch that the front rests on."""

    def __init__(self, ids: np.ndarray | None = None, score: np.ndarray | None = None, node: np.ndarray | None = None, best: int = -1, best_score: float = 0.0) -> None:
        """Without ids a front to be entered, else one that was handed over, by ascending id."""
        self.ids, self.score, self.node = (np.array([], kind) if x is None else x.astype(kind) for x, kind in ((ids, np.int64), (score, np.float64), (node, np.int64)))
        self.best, self.best_score, self.nodes = best, best_score, {}

    def _begin(self, samples: list[int], site: int, before: int) -> list[int]:
        out = [(site << 32) + x for x in samples]
        self.nodes.update((n, (x, site, before)) for n, x in zip(out, samples, strict=True))
        return out

    def enter(self, samples: list[int]) -> None:
        """The first group of candidates, at the first site."""
        self.ids = np.array(sorted(samples), np.int64)
        self.score, self.node = np.zeros(len(samples)), np.array(self._begin(self.ids.tolist(), 0, -1), np.int64)
        self.best = int(self.ids[0])

    def change(self, samples: list[int]) -> None:
        """The next group: others go, new ones come at the cost of a switch."""
        now = np.array(sorted({*samples, self.best}), np.int64)
        at = np.searchsorted(self.ids, now)
        held = (at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == now)
        at = np.where(held, at, 0)
        self.ids, self.score, self.node = now, np.where(held, self.score[at], np.inf), np.where(held, self.node[at], -1)

    def advance(self, site: int, own: int, alleles: np.ndarray, switch: float, stay: float, mismatch: float, match: float) -> None:
        """alleles: those of the candidates at the site, by id."""
        here = np.where(alleles == own, match, mismatch)
        here[(alleles == UNPHASED) | (own == UNPHASED)] = (match + mismatch) / 2
        bound, extended = self.best_score + switch, self.score + stay
        fresh = extended > bound
        if fresh.any():
            before = int(self.node[np.searchsorted(self.ids, self.best)])
            self.node[fresh] = self._begin(self.ids[fresh].tolist(), site, before)
        self.score = np.where(fresh, bound, extended) + here
        k = int(self.score.argmin())
        dearest = self.best_score + max(switch, stay) + max(mismatch, match)
        if self.score[k] < dearest:
            self.best, self.best_score = int(self.ids[k]), float(self.score[k])
        else:
            self.best_score = dearest

    def end(self) -> int:
        return int(self.node[np.searchsorted(self.ids, self.best)])

    def handed(self, hap: int, last: bool) -> list[tuple]:
        """The front (at the end its best state alone) and the nodes of the stretch that it rests on."""
        keep = self.ids == self.best if last else np.ones(len(self.ids), bool)
        out = [(hap, FRONT, x, s, n, -1, self.best, self.best_score) for x, s, n in zip(self.ids[keep].tolist(), self.score[keep].tolist(), self.node[keep].tolist(), strict=True)]
        todo, needed = [x for x in {r[4] for r in out} if x in self.nodes], set()
        while todo:
            x = todo.pop()
            if x not in needed:
                needed.add(x)
                todo += [y for y in [self.nodes[x][2]] if y in self.nodes]
        return out + [(hap, NODE, self.nodes[x][0], 0.0, x, self.nodes[x][2], -1, 0.0) for x in sorted(needed)]

    def rows(self, hap: int, last: bool) -> pd.DataFrame:
        """The same as a frame."""
        return pd.DataFrame(self.handed(hap, last), columns=list(HANDED_TYPES))


FRONT, NODE = 0, 1
HANDED_TYPES = {"hap": pa.int32(), "kind": pa.int32(), "sample": pa.int32(), "score": pa.float64(), "node": pa.int64(), "before": pa.int64(), "best": pa.int32(), "best_score": pa.float64()}
PATH_TYPES = dict.fromkeys(("hap", "seg_idx", "site", "target"), pa.int32())
HANDED = "hap int, kind int, sample int, score double, node long, before long, best int, best_score double"
ALLELES = 1 << 26  # of a target's candidates in one stretch


def by_target(rows: DataFrame, order: list[str], part: Callable[[pa.Table, list[int]], list[tuple]], types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows by hap, all of one in one task: part(table, edges) takes the targets of a batch at once, the
    k-th from edges[k] to edges[k + 1]; what a batch cuts off waits for the next one. Many targets with a
    few rows each would cost more as frames than their work."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(whole: bool) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            hap = table["hap"].to_numpy()
            edges = [0, *(np.flatnonzero(hap[1:] != hap[:-1]) + 1).tolist(), *([len(hap)] if whole else [])]
            held[:] = [] if whole else [table.slice(edges[-1])]
            found = part(table, edges) if len(edges) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types.values(), strict=True)], names=list(types))

        for batch in batches:
            if batch.num_rows:
                ends = held and held[0]["hap"][0] != batch.column("hap")[batch.num_rows - 1]
                held.append(pa.Table.from_batches([batch]))
                if ends or len(held) == 1:
                    yield from done(False)
        if held:
            yield from done(True)

    return dealt(rows, "hap").sortWithinPartitions(*order).mapInArrow(task, schema)


def traced(nodes: dict[int, tuple[int, int, int]], at: int) -> list[tuple[int, int]]:
    """(first site, id) of each segment on the way that ends in this node."""
    out = []
    while at >= 0:
        sample, site, before = nodes[at]
        if before < 0 or nodes[before][0] != sample:
            out.append((site, sample))
        at = before
    return out[::-1]


def best_path(own: np.ndarray, panel: np.ndarray, ids: list[int], allowed: list[tuple[int, list[int]]], cost: tuple[np.ndarray, ...]) -> list[tuple[int, int]]:
    """The cheapest path in one stretch. panel: a row a candidate of `ids` (ascending); allowed: (first
    site, ids) of each match group, the ids copied from there on."""
    front, switch_at = CandidateFront(), dict(allowed[1:])
    front.enter(allowed[0][1])
    for j in range(len(own)):
        if j in switch_at:
            front.change(switch_at[j])
        front.advance(j, own[j], panel[np.searchsorted(ids, front.ids), j], *(x[j] for x in cost))
    return traced(front.nodes, front.end())


def infer_paths(genotypes: DataFrame, candidates: DataFrame, group_sites: dict[int, int], cm_steps: np.ndarray, bp_sizes: np.ndarray, branch_lengths, rate: float, sparse: bool = False, stretch: int | None = None) -> DataFrame:
    """hap, seg_idx, site, target: the path of every haplotype with candidates (grp, hap, cand).
    group_sites: first site of each group; branch_lengths: n -> expected branch length. A task holds a
    target, its candidates and `stretch` sites; the states go on to the next stretch as rows."""
    n_sites = len(cm_steps)
    groups = sorted(group_sites.items(), key=lambda x: x[1])
    candidates = cut(candidates)  # read for each stretch
    # a target's first group of candidates holds from the first site
    if stretch is None:
        most = candidates.groupBy("hap").agg(F.count_distinct("cand").alias("n")).agg(F.max("n")).first()[0]
        stretch = max(1, ALLELES // max(most or 1, 1))
    front, nodes = None, None
    for low in range(0, n_sites, stretch):
        high = min(low + stretch, n_sites)
        part = genotypes.where(F.col("site").between(low, high - 1))
        alleles = packed(part)
        # groups that begin here; on the first stretch all, as a target's first one may begin late
        here = candidates if low == 0 else candidates.where(F.col("grp").isin([g for g, s in groups if low <= s < high]))
        sets = here.groupBy("hap", "cand").agg(F.array_sort(F.collect_list("grp")).alias("grps"))
        if front is not None:
            held = front.where(F.col("kind") == FRONT).select("hap", F.col("sample").alias("cand"), F.array().cast("array<int>").alias("grps"))
            sets = sets.unionByName(held).groupBy("hap", "cand").agg(F.array_sort(F.flatten(F.collect_list("grps"))).alias("grps"))
        rows = sets.join(alleles.select(F.col("hap").alias("cand"), "alleles"), "cand").select("hap", "cand", "grps", "alleles")
        own = alleles.select("hap", F.lit(-1).alias("cand"), F.array().cast("array<int>").alias("grps"), "alleles").join(candidates.select("hap").distinct(), "hap", "left_semi")
        # what is handed over comes beside the alleles, told apart by its kind
        none = {"kind": "int", "score": "double", "node": "long", "best": "int", "best_score": "double"}
        rows = rows.unionByName(own).select("hap", "cand", "grps", "alleles", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        if front is not None:
            states = front.where(F.col("kind") == FRONT).select("hap", F.col("sample").alias("cand"), F.lit(None).cast("array<int>").alias("grps"), F.lit(None).cast("array<tinyint>").alias("alleles"), *none)
            rows = rows.unionByName(states)
        front = cut(by_target(rows, ["hap", "cand"], _stretch(low, high, n_sites, groups, cm_steps, bp_sizes, branch_lengths, rate, sparse), HANDED_TYPES, HANDED))
        found = front.where(F.col("kind") == NODE)
        nodes = found if nodes is None else nodes.unionByName(found)
    ends = front.where(F.col("kind") == FRONT)

    def whole(table: pa.Table, edges: list[int]) -> list[tuple]:
        hap, kind, node, sample, before = (table[c].to_pylist() for c in ("hap", "kind", "node", "sample", "before"))
        out = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            known = {node[r]: (sample[r], node[r] >> 32, before[r]) for r in range(i, j) if kind[r] == NODE}
            path = traced(known, next(node[r] for r in range(i, j) if kind[r] == FRONT))
            out += [(hap[i], k, site, target) for k, (site, target) in enumerate(path)]
        return out

    return by_target(nodes.unionByName(ends), ["hap"], whole, PATH_TYPES, PATHS)


def _stretch(low: int, high: int, n_sites: int, groups: list[tuple[int, int]], cm_steps: np.ndarray, bp_sizes: np.ndarray, branch_lengths, rate: float, sparse: bool):
    """The states of targets over the sites of a stretch."""

    def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        column = table[name].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    def part(table: pa.Table, edges: list[int]) -> list[tuple]:
        haps, cands = table["hap"].to_numpy(), table["cand"].to_numpy().astype(np.int64)
        states = table["kind"].is_valid().to_numpy()
        score, node, best, best_score = (table[c].fill_null(0).to_numpy() for c in ("score", "node", "best", "best_score"))
        (grp_at, grps), (at, alleles) = lists(table, "grps"), lists(table, "alleles")
        out = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            hap, handed = int(haps[i]), states[i:j]
            ids = cands[i:j][~handed]
            panel = alleles[at[i] : at[j]].reshape(len(ids), -1)  # states have no alleles; the target's own come first
            own, ids, columns = panel[0], ids[1:], np.ascontiguousarray(panel[1:].T)
            of, given = np.repeat(cands[i:j], np.diff(grp_at[i : j + 1])), grps[grp_at[i] : grp_at[j]]
            allowed = [(start, of[given == g].tolist()) for g, start in groups if (given == g).any()]
            if handed.any():
                front = CandidateFront(*(x[i:j][handed] for x in (cands, score, node)), int(best[i:j][handed][0]), float(best_score[i:j][handed][0]))
            else:
                front = CandidateFront()
            if low == 0:
                front.enter(allowed[0][1])
                allowed = allowed[1:]
            switch_at = dict(allowed)
            cost = [x.tolist() for x in costs(cm_steps[low:high], bp_sizes[low:high], branch_lengths(hap + 1), rate, hap, sparse)]
            rows_of = np.searchsorted(ids, front.ids)
            for k in range(high - low):
                if low + k in switch_at:
                    front.change(switch_at[low + k])
                    rows_of = np.searchsorted(ids, front.ids)
                front.advance(low + k, own[k], columns[k][rows_of], *(x[k] for x in cost))
            out += front.handed(hap, high == n_sites)
        return out

    return part


def mismatches(genotypes: DataFrame, paths: DataFrame) -> DataFrame:
    """hap, site where a haplotype differs from what it copies; the first one's ALT sites."""
    from pyspark.sql import Window

    w = Window.partitionBy("hap").orderBy("site")
    spans = paths.select("hap", "target", F.col("site").alias("low"), F.coalesce(F.lead("site").over(w), F.lit(2**31 - 1)).alias("high"))
    last = genotypes.agg(F.max("site")).first()[0]
    placed = spans.select("hap", "target", F.explode(F.sequence("low", F.least(F.col("high") - 1, F.lit(last)))).alias("site"))
    both = genotypes.join(placed, ["hap", "site"], "left").join(genotypes.select("site", F.col("hap").alias("target"), F.col("g").alias("tg")), ["site", "target"], "left")
    return both.where(F.col("g") != F.coalesce("tg", F.lit(0))).select("hap", "site")


def emissions(panel: np.ndarray, query: np.ndarray, mu: float) -> np.ndarray:
    """Chance of the query's allele from each haplotype; where all agree nothing is learned."""
    same = panel == query[None, :]
    out = np.where(same, 1 - mu, mu)
    out[:, same.all(axis=0)] = 1.0
    return out


def default_mutation(n: int) -> float:
    """Watterson-style rate for n haplotypes."""
    theta = 1 / sum(1 / k for k in range(1, n))
    return 0.5 * theta / (n + theta)


def posterior(panel: np.ndarray, query: np.ndarray, r: np.ndarray, mu: float | None) -> np.ndarray:
    """sites x haplotypes: the chance to copy each haplotype, by forward and backward passes."""
    n, m = panel.shape
    if len(query) != m or len(r) != m:
        raise ValueError("panel, query and recombination rates differ in length")
    e = emissions(panel, query, default_mutation(n) if mu is None else mu).T
    forward, scale = np.empty((m, n)), np.empty(m)
    f = np.full(n, 1 / n)
    for j in range(m):
        f = (f * (1 - r[j]) + r[j] / n) * e[j] if j else f * e[0]
        scale[j] = f.sum()
        f = f / scale[j]
        forward[j] = f
    b = np.ones(n)
    out = np.empty((m, n))
    out[m - 1] = forward[m - 1]
    for j in range(m - 2, -1, -1):
        w = b * e[j + 1]
        b = ((1 - r[j + 1]) * w + r[j + 1] * w.sum() / n) / scale[j + 1]
        out[j] = forward[j] * b
    return out


def posteriors(genotypes: DataFrame, sets: DataFrame, switch: np.ndarray, mu: float | None = 1e-4, n_panel: int | None = None) -> DataFrame:
    """target, site, ref, p for match sets (target, ref) over the sites of the genotypes, numbered
    in order; switch: chance to switch before each of them. n_panel: what is no better than chance in
    a panel of so many never leaves the task, and the rest sums to one."""
    sets = cut(sets)
    # only haplotypes that are in some set are packed
    genotypes = cut(among(genotypes, sets.select(F.explode(F.array("target", "ref")).alias("hap")), "hap"))
    alleles = packed(genotypes)
    numbers = np.array([r["site"] for r in genotypes.select("site").distinct().orderBy("site").collect()])
    rows = sets.join(alleles.select(F.col("hap").alias("ref"), "alleles"), "ref").select("target", "ref", "alleles")
    rows = rows.unionByName(sets.select("target").distinct().join(alleles, F.col("target") == F.col("hap")).select("target", F.lit(-1).alias("ref"), "alleles"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ref", ignore_index=True)
        panel = np.array([list(x) for x in frame["alleles"].iloc[1:]], np.int8)
        p = posterior(panel, np.array(frame["alleles"].iloc[0], np.int8), switch, mu)
        refs = frame["ref"].iloc[1:].to_numpy()
        if n_panel is not None:
            p = np.where(p > 1 / n_panel, p, 0.0)
            total = p.sum(axis=1, keepdims=True)
            if (total == 0).any():
                raise ValueError("a posterior without anything above chance")
            at, k = np.nonzero(p)
            return pd.DataFrame({"target": frame["target"].iloc[0], "site": numbers[at], "ref": refs[k], "p": (p / total)[at, k]})
        return pd.DataFrame({"target": frame["target"].iloc[0], "site": np.repeat(numbers, len(refs)), "ref": np.tile(refs, len(numbers)), "p": p.ravel()})

    return dealt(rows, "target").groupBy("target").applyInPandas(one, "target int, site int, ref int, p double")
