"""A panel of haplotypes in prefix order that takes haplotypes, gives them up, and is searched whole.

The panel keeps what its order was made of: the alleles of each block of sites as a number, and for
1, 2, 4, ... blocks the ranks of the haplotypes' alleles over that many blocks up to each one. A
newcomer descends through these ranks by binary search: twice the rank of what it equals, or the odd
number between those that it falls between. That gives its place at every block's start, whatever
the number of blocks, after a logarithm of joins; within a block it goes from site to site by the
counts of zeros and ones above it. Rows of the panel are only shifted.

Since when two haplotypes are equal is found in the same ranks by halving.

Sites are numbered 0, 1, ... without gaps; ids of newcomers exceed those of the panel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import pbwt
from .pbwt import BLOCK, equal_since, level_ranks, whole_keys


@dataclass(frozen=True)
class Panel:
    """genotypes: site, hap, g; keys: block, hap, key; order: site, hap, g, rnk. What not every use
    needs is made when first asked for, unless it is known from the panel that this one came from: levels:
    blocks -> block, hap, rank; since: site, hap, above, since; columns: site, alleles (in the order
    before the site), haps (in the order after it)."""

    genotypes: DataFrame
    keys: DataFrame
    order: DataFrame
    n_sites: int
    known_levels: dict[int, DataFrame] | None = None
    known_since: DataFrame | None = None

    @cached_property
    def n_haps(self) -> int:
        return self.keys.where("block = 0").count()

    @cached_property
    def levels(self) -> dict[int, DataFrame]:
        return self.known_levels or level_ranks(self.keys, -(-self.n_sites // BLOCK))

    @cached_property
    def since(self) -> DataFrame:
        return cut(pbwt.divergence(self.order, self.keys, self.levels)) if self.known_since is None else self.known_since

    @cached_property
    def columns(self) -> DataFrame:
        return cut(in_columns(self.order))


def in_columns(order: DataFrame) -> DataFrame:
    """site, alleles in the order before the site, haps in the order after it."""
    rows = order.withColumn("before", F.coalesce(F.lag("rnk").over(Window.partitionBy("hap").orderBy("site")), "hap"))
    listed = rows.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("before", "g"))).alias("a"), F.sort_array(F.collect_list(F.struct("rnk", "hap"))).alias("h"))
    return listed.select("site", F.transform("a", lambda x: x["g"].cast("tinyint")).alias("alleles"), F.col("h.hap").alias("haps"))


def build(genotypes: DataFrame, n_sites: int) -> Panel:
    """The panel of these haplotypes."""
    keys = cut(whole_keys(genotypes))
    return Panel(genotypes, keys, cut(pbwt.ranks_of_keys(keys, n_sites)), n_sites)


def _search(known: DataFrame, new: DataFrame) -> DataFrame:
    """block, hap, place of new codes (block, hap, code) among the panel's (block, code, rank)."""
    lists = known.groupBy("block").agg(F.sort_array(F.collect_set(F.struct("code", "rank"))).alias("k"))
    asked = new.groupBy("block").agg(F.collect_list(F.struct("hap", "code")).alias("a"))
    rows = asked.join(lists, "block").select("block", F.col("k.code").alias("codes"), F.col("k.rank").alias("ranks"), F.col("a.hap").alias("hap"), F.col("a.code").alias("code"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, codes, ranks, hap, code in frame.itertuples(index=False):
                codes, code, ranks = np.asarray(codes, np.int64), np.asarray(code, np.int64), np.asarray([0, *ranks], np.int64)
                at = np.searchsorted(codes, code)
                equal = codes[np.minimum(at, len(codes) - 1)] == code
                yield pd.DataFrame({"block": block, "hap": hap, "place": np.where(equal, 2 * ranks[np.minimum(at + 1, len(codes))], 2 * ranks[at] + 1)})

    return rows.mapInPandas(task, "block int, hap int, place long")


def descend(panel: Panel, keys: DataFrame) -> dict[int, DataFrame]:
    """For each level: block, hap, place of newcomers (block, hap, key) among the panel's ranks."""
    out = {1: cut(_search(panel.keys.join(panel.levels[1], ["block", "hap"]).select("block", F.col("key").alias("code"), "rank").distinct(), keys.select("block", "hap", F.col("key").alias("code"))))}
    for d in sorted(panel.levels)[:-1]:
        pair = lambda high, low: F.shiftleft(high.cast("long"), 32) + F.coalesce(low, F.lit(0))
        ranks, places = panel.levels[d], out[d]
        before = ranks.select((F.col("block") + d).alias("block"), "hap", (2 * F.col("rank")).alias("low"))
        after = panel.levels[2 * d].select("block", "hap", F.col("rank").alias("after"))
        known = ranks.join(before, ["block", "hap"], "left").join(after, ["block", "hap"])
        known = known.select("block", pair(2 * F.col("rank"), F.col("low")).alias("code"), F.col("after").alias("rank")).distinct()
        before = places.select((F.col("block") + d).alias("block"), "hap", F.col("place").alias("low"))
        new = places.join(before, ["block", "hap"], "left").select("block", "hap", pair(F.col("place"), F.col("low")).alias("code"))
        out[2 * d] = cut(_search(known, new))
    return out


def _sites_of_newcomers(panel: Panel, places: DataFrame, keys: DataFrame) -> DataFrame:
    """site, hap, g, pos: how many of the panel come before each newcomer after each site."""
    top = panel.levels[max(panel.levels)]
    above = top.groupBy("block", "rank").agg(F.count("*").alias("n"))
    above = above.select((F.col("block") + 1).alias("block"), (2 * F.col("rank")).alias("low"), F.sum("n").over(Window.partitionBy("block").orderBy("rank")).alias("upto"))
    starts = places.select((F.col("block") + 1).alias("block"), "hap", "place")
    # the panel's haplotypes that are equal up to the block's start come before the newcomer, too
    floor_place = (F.col("place") - F.col("place") % 2).alias("low")
    starts = starts.select("block", "hap", floor_place).join(above, ["block", "low"], "left")
    rows = keys.join(starts, ["block", "hap"], "left").select("block", "hap", "key", F.when(F.col("block") == 0, panel.n_haps).otherwise(F.coalesce("upto", F.lit(0))).alias("start"))

    def task(key: tuple, columns: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        hap, bits, r, out = new["hap"].to_numpy(), new["key"].to_numpy(np.int64), new["start"].to_numpy(np.int64), []
        for site, alleles in columns.sort_values("site")[["site", "alleles"]].itertuples(index=False):
            zeros = np.concatenate([[0], np.cumsum(1 - np.asarray(alleles, np.int64))])
            g = bits >> (site % BLOCK) & 1
            r = np.where(g == 0, zeros[r], zeros[-1] + r - zeros[r])
            out.append(pd.DataFrame({"site": site, "hap": hap, "g": g, "pos": r}))
        return pd.concat(out) if out else pd.DataFrame({"site": [], "hap": [], "g": [], "pos": []})

    columns = panel.columns.select(F.floor(F.col("site") / BLOCK).cast("int").alias("block"), F.col("site").alias("site"), F.col("alleles").alias("alleles"))
    return columns.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(task, "site int, hap int, g int, pos int")


def _identities(panel: Panel, places: dict[int, DataFrame], own: dict[int, DataFrame], d: int) -> DataFrame:
    """block, hap, id of all haplotypes, where equal ids mean equal alleles over d blocks."""
    new = places[d].join(own[d], ["block", "hap"])
    apart = -(F.shiftleft("place", 32) + F.col("rank"))
    new = new.select("block", "hap", F.when(F.col("place") % 2 == 0, F.col("place")).otherwise(apart).alias("id"))
    return panel.levels[d].select("block", "hap", (2 * F.col("rank")).cast("long").alias("id")).unionByName(new)


def _merged_levels(panel: Panel, places: dict[int, DataFrame], own: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """The ranks of all, those of the panel shifted by the newcomers' own strings below them."""
    out = {}
    for d, ranks in panel.levels.items():
        new = places[d].join(own[d].withColumnRenamed("rank", "own"), ["block", "hap"])
        odd = F.when(F.col("place") % 2 == 1, F.struct("place", "own"))
        lists = new.groupBy("block").agg(F.sort_array(F.collect_set(odd)).alias("odd"))
        below = lambda c: F.size(F.filter("odd", lambda x: x["place"] < c))
        shifted = ranks.join(lists, "block", "left").select("block", "hap", (F.col("rank") + F.coalesce(below(2 * F.col("rank")), F.lit(0))).alias("rank"))
        even = F.floor(F.col("place") / 2) + below(F.col("place"))
        mine = F.floor(F.col("place") / 2) + F.array_position("odd", F.struct("place", "own"))
        placed = new.join(lists, "block").select("block", "hap", F.when(F.col("place") % 2 == 0, even).otherwise(mine).alias("rank"))
        out[d] = cut(shifted.unionByName(placed).select("block", "hap", F.col("rank").cast("int").alias("rank")))
    return out


def insert(panel: Panel, newcomers: DataFrame) -> Panel:
    """The panel with newcomers (site, hap, g), as if it had been built with them."""
    newcomers = cut(newcomers.select("site", "hap", "g"))
    keys = cut(whole_keys(newcomers))
    places = descend(panel, keys)
    own = level_ranks(keys, -(-panel.n_sites // BLOCK))
    among = pbwt.prefix_ranks(newcomers, panel.n_sites).select("site", "hap", F.col("rnk").alias("own"))
    sited = cut(_sites_of_newcomers(panel, places[max(places)], keys).join(among, ["site", "hap"]))
    lists = cut(sited.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("pos", "own", "hap", "g"))).alias("new")))
    placed = lists.select("site", F.posexplode("new").alias("k", "x")).select("site", "x.hap", "x.g", (F.col("x.pos") + F.col("k")).cast("int").alias("rnk"))
    shift = F.size(F.filter("new", lambda x: x["pos"] <= F.col("rnk")))
    kept = panel.order.join(lists, "site").select("site", "hap", "g", (F.col("rnk") + shift).cast("int").alias("rnk"))
    order = cut(kept.unionByName(placed))
    # neighbours change for newcomers and for what stands right below one
    newest = F.filter("new", lambda x: x["pos"] == F.col("rnk"))
    under = panel.order.join(lists, "site").select("site", "hap", F.try_element_at(newest, F.lit(-1))["hap"].alias("above")).where("above IS NOT NULL")
    over = placed.select("site", "hap", (F.col("rnk") - 1).alias("rnk")).join(order.select("site", "rnk", F.col("hap").alias("above")), ["site", "rnk"], "left").select("site", "hap", "above")
    changed = cut(under.unionByName(over))
    all_keys = cut(panel.keys.unionByName(keys))
    found = equal_since(changed.where("above IS NOT NULL"), all_keys, {d: _identities(panel, places, own, d) for d in panel.levels})
    first = changed.where("above IS NULL").select("site", "hap", F.lit(None).cast("int").alias("above"), (F.col("site") + 1).cast("int").alias("since"))
    since = panel.since.join(changed.select("site", "hap"), ["site", "hap"], "left_anti").select("site", "hap", "above", "since").unionByName(found).unionByName(first)
    return Panel(panel.genotypes.unionByName(newcomers), all_keys, order, panel.n_sites, _merged_levels(panel, places, own), cut(since))


def remove(panel: Panel, haps: DataFrame) -> Panel:
    """The panel without these haplotypes (hap). Those right below a gap are equal to what now stands
    above them since the latest of the sites in the gap and their own."""
    gone = haps.select("hap").distinct()
    out = cut(panel.order.join(gone, "hap", "left_semi").join(panel.since.select("site", "hap", "since"), ["site", "hap"]).select("site", "hap", "rnk", "since"))
    # gaps: neighbouring ranks that go, from the removed rows alone
    start = F.col("rnk") - F.row_number().over(Window.partitionBy("site").orderBy("rnk"))
    gaps = out.withColumn("gap", start).groupBy("site", "gap").agg(F.min("rnk").alias("low"), F.max("rnk").alias("high"), F.max("since").alias("latest"))
    # how many go before each that stays; a count along the site, as many may go
    left = panel.order.join(gone, "hap", "left_anti")
    place = F.row_number().over(Window.partitionBy("site").orderBy("rnk")) - 1
    order = cut(left.select("site", "hap", "g", place.cast("int").alias("rnk")))
    by_rank = panel.order.select("site", "rnk", "hap")
    below = gaps.select("site", "low", "latest", (F.col("high") + 1).alias("rnk")).join(by_rank, ["site", "rnk"])
    above = by_rank.select("site", (F.col("rnk") + 1).alias("low"), F.col("hap").alias("new_above"))
    changed = below.join(above, ["site", "low"], "left").select("site", "hap", "new_above", "latest", F.lit(True).alias("moved"))
    rows = panel.since.join(gone, "hap", "left_anti").join(changed, ["site", "hap"], "left")
    at = F.when(F.col("moved").isNull(), F.col("since")).when(F.col("new_above").isNull(), F.col("site") + 1).otherwise(F.greatest("since", "latest"))
    since = rows.select("site", "hap", F.when(F.col("moved").isNull(), F.col("above")).otherwise(F.col("new_above")).alias("above"), at.cast("int").alias("since"))
    kept = lambda df: cut(df.join(gone, "hap", "left_anti").select(*df.columns))
    # ranks may have holes, which binary search and comparison do not mind
    levels = {d: kept(r) for d, r in panel.levels.items()}
    return Panel(panel.genotypes.join(gone, "hap", "left_anti").select("site", "hap", "g"), kept(panel.keys), order, panel.n_sites, levels, cut(since))
