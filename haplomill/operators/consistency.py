"""Segments made consistent with genotypes: carriers of a variant copy from carriers, and meet below
its age, while a carrier and another haplotype meet above it.

The state of a region is an interval of times for each haplotype's open segment, kept as arrays over
haplotypes. A variant gives each of them an interval too, (0, age) for two carriers, (age, inf) for
one, and everything for none; the open interval is intersected with it, and where nothing would be
left the segment ends there. All haplotypes take a site at once: who copies from whom changes for
carriers only, and the way up to the nearest carrier leads through others. Along the sites the state
is sequential, so a region is one task, and regions run side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YOUNGEST = 1e-3
CLEARANCE = 1e-3  # share of a bound by which a time that was beyond it clears it
RESULT = "region long, hap int, seg_idx int, start_bp int, target int, tmrca double, mismatches array<int>"


def inside(time: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Times moved into the open intervals (low, high), by a small step or half of a narrow one."""
    half = (high - low) / 2
    with np.errstate(invalid="ignore"):
        under, over = low + np.minimum(CLEARANCE * low, half), high - np.minimum(CLEARANCE * high, half)
    out = np.where(time >= high, over, np.where(time <= low, under, time))
    bad = ~((low < out) & (out < high))
    if bad.any():
        raise ValueError(f"no time between {low[bad][0]} and {high[bad][0]}")
    return out


def fit_region(segments: pd.DataFrame, sites: pd.DataFrame, n_haps: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(segments, mismatches) of haplotypes 0 to n_haps - 1. segments: hap, start_bp, target, tmrca,
    none of haplotype 0; sites in order: site, pos, age, g (alleles by haplotype)."""
    given = segments.sort_values(["hap", "start_bp"])
    starts, targets, times = (given[c].to_numpy() for c in ("start_bp", "target", "tmrca"))
    edge = np.searchsorted(given["hap"].to_numpy(), np.arange(n_haps + 1))
    if (np.diff(edge)[1:] == 0).any():
        raise ValueError("a haplotype without segments")
    now = edge[:-1].copy()  # the given segment that each open one belongs to
    starts, targets, times = np.append(starts, np.iinfo(np.int64).max), np.append(targets, -1), np.append(times, 0.0)
    copied = targets[now].astype(np.int64)
    copied[0] = -1
    low, high = np.zeros(n_haps), np.full(n_haps, np.inf)
    since = np.full(n_haps, int(sites["pos"].iloc[0]))
    closed, differ = [], []

    def end(which: np.ndarray, pos: int, to: np.ndarray, new_low: np.ndarray | float, new_high: np.ndarray | float) -> None:
        """Ends the open segments of `which`; new ones open at pos."""
        closed.append(pd.DataFrame({"hap": which, "start_bp": since[which], "target": copied[which], "tmrca": inside(times[now[which]], low[which], high[which])}))
        since[which], copied[which], low[which], high[which] = pos, to, new_low, new_high

    everyone = np.arange(1, n_haps)
    for site, pos, age, g in zip(sites["site"], sites["pos"], sites["age"], sites["g"], strict=True):
        g, age = np.asarray(g, bool), max(age, YOUNGEST)
        following = now[1:] + 1
        enters = everyone[(following < edge[2:]) & (starts[following] == pos)]
        if len(enters):
            end(enters, pos, targets[now[enters] + 1], 0.0, np.inf)
            now[enters] += 1
        carriers = np.flatnonzero(g)
        if len(carriers) > 1:
            first, rest = carriers[0], carriers[1:]
            source = copied[rest]
            while (lost := (source >= 0) & ~g[source]).any():
                source = np.where(lost, copied[source], source)
            source = np.where(source > 0, source, first)
            turns = source != copied[rest]
            breaks = turns & (since[rest] != pos)
            copied[rest[turns & ~breaks]] = source[turns & ~breaks]
            if breaks.any():
                end(rest[breaks], pos, source[breaks], 0.0, age)
        own, other = g[1:], g[copied[1:]]
        floor, ceiling = np.where(own ^ other, age, 0.0), np.where(own & other, age, np.inf)
        clash = np.maximum(low[1:], floor) >= np.minimum(high[1:], ceiling)
        if clash.any():
            end(everyone[clash], pos, copied[1:][clash], floor[clash], ceiling[clash])
        low[1:], high[1:] = np.maximum(low[1:], floor), np.minimum(high[1:], ceiling)
        off = np.append(np.flatnonzero(g[:1]), everyone[own ^ other])
        differ.append(pd.DataFrame({"hap": off, "site": np.full(len(off), site)}))
    if (now[1:] + 1 < edge[2:]).any():
        raise ValueError("segments after the last site")
    end(everyone, -1, -1, 0.0, np.inf)
    return pd.concat(closed, ignore_index=True), pd.concat(differ, ignore_index=True)


def fit(genotypes: DataFrame, segments: DataFrame, sites: DataFrame, ages: DataFrame, region: str | None = None) -> DataFrame:
    """Consistent segments and mismatches of every haplotype, by region (one, unless `region` names
    a column of sites)."""
    key = F.col(region).cast("long") if region else F.lit(0).cast("long")
    placed = sites.join(ages, "site", "left").select("site", "pos", F.coalesce("age", F.lit(0.0)).alias("age"), key.alias("region"))
    listed = genotypes.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("hap", "g"))), lambda x: x["g"]).alias("g"))
    ends = placed.groupBy(F.col("region").alias("part")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    until = F.lead("start_bp").over(Window.partitionBy("hap").orderBy("start_bp"))
    spans = segments.select("hap", "start_bp", "target", "tmrca", until.alias("until"))
    # a region takes what overlaps it, cut at its start
    overlaps = (F.col("start_bp") <= F.col("high")) & (F.col("until").isNull() | (F.col("until") > F.col("low")))
    within = spans.join(F.broadcast(ends), overlaps).select(F.col("part").alias("region"), "hap", F.greatest("start_bp", "low").alias("start_bp"), "target", "tmrca")

    def one(key: tuple, at: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        at = at.sort_values("site")
        done, differ = fit_region(rows, at, len(at["g"].iloc[0]))
        first = pd.DataFrame({"hap": [0], "start_bp": [int(at["pos"].iloc[0])], "target": [-1], "tmrca": [0.0]})
        done = pd.concat([first, done]).sort_values(["hap", "start_bp"], kind="stable", ignore_index=True)
        done["region"], done["seg_idx"] = key[0], done.groupby("hap").cumcount()
        lists = differ.groupby("hap")["site"].agg(list)
        done["mismatches"] = [lists.get(h, []) if k == 0 else [] for h, k in zip(done["hap"], done["seg_idx"], strict=True)]
        return done[["region", "hap", "seg_idx", "start_bp", "target", "tmrca", "mismatches"]]

    return placed.join(listed, "site").groupBy("region").cogroup(within.groupBy("region")).applyInPandas(one, RESULT)
