"""Positional prefix order of haplotypes and what is read off it.

After a site, haplotypes are ordered by their alleles read backwards from it. Within a block of
sites the alleles read so are a number, a running sum of powers of two; what lies before the block
enters as a rank at its start. Ranks at block starts come from doubling: a rank over d blocks and
the rank d blocks earlier give one over 2 d blocks, so that a chromosome of any length takes a
number of joins that grows with its logarithm.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, dealt

BLOCK = 32
NEIGHBOURS = "site int, hap int, cand int"


def block_keys(genotypes: DataFrame, block: int = BLOCK) -> DataFrame:
    """site, hap, g, block, key: the alleles of the block up to the site, the last one weighing most."""
    rows = genotypes.withColumn("block", F.floor(F.col("site") / block).cast("int"))
    bit = F.expr(f"shiftleft(cast(g AS bigint), site % {block})")
    running = Window.partitionBy("hap", "block").orderBy("site")
    return rows.withColumn("key", F.sum(bit).over(running))


def block_ranks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block, hap, rank of everything up to the block's end (equal histories share one)."""
    w = Window.partitionBy("block")
    ranks = keys.groupBy("block", "hap").agg(F.max("key").alias("key"))
    ranks = ranks.select("block", "hap", F.dense_rank().over(w.orderBy("key")).alias("rank"))
    d = 1
    while d < n_blocks:
        earlier = ranks.select((F.col("block") + d).alias("block"), "hap", F.col("rank").alias("before"))
        ranks = ranks.join(earlier, ["block", "hap"], "left").select("block", "hap", F.dense_rank().over(w.orderBy("rank", F.coalesce("before", F.lit(0)))).alias("rank"))
        d *= 2
    return ranks


def prefix_ranks(genotypes: DataFrame, n_sites: int, block: int = BLOCK) -> DataFrame:
    """site, hap, g, rnk: the place of each haplotype in the order after each site."""
    keys = block_keys(genotypes, block)
    n_blocks = -(-n_sites // block)
    order = ["key", "hap"]
    if n_blocks > 1:
        before = block_ranks(keys, n_blocks).select((F.col("block") + 1).alias("block"), "hap", F.col("rank").alias("before"))
        keys = keys.join(before, ["block", "hap"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
        order = ["key", "before", "hap"]
    return keys.select("site", "hap", "g", (F.row_number().over(Window.partitionBy("site").orderBy(*order)) - 1).cast("int").alias("rnk"))


def whole_keys(genotypes: DataFrame) -> DataFrame:
    """block, hap, key: all alleles of a block as one number."""
    bit = F.expr(f"shiftleft(cast(g AS bigint), site % {BLOCK})")
    return genotypes.groupBy(F.floor(F.col("site") / BLOCK).cast("int").alias("block"), "hap").agg(F.sum(bit).alias("key"))


def ranks_of_keys(keys: DataFrame, n_sites: int) -> DataFrame:
    """The same as `prefix_ranks` from the keys of whole blocks (block, hap, key), for sites numbered
    without gaps: a running key is the lower bits of the whole one, so that no alleles are shuffled for it."""
    n_blocks, order = -(-n_sites // BLOCK), ["key", "hap"]
    if n_blocks > 1:
        before = block_ranks(keys, n_blocks).select((F.col("block") + 1).alias("block"), "hap", F.col("rank").alias("before"))
        keys = keys.join(before, ["block", "hap"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
        order = ["key", "before", "hap"]
    bits = F.sequence(F.lit(0), F.least(F.lit(BLOCK), n_sites - F.col("block") * BLOCK) - 1)
    rows = dealt(keys, "hap").withColumn("bit", F.explode(bits))  # a few numbers become many rows
    site = (F.col("block") * BLOCK + F.col("bit")).cast("int").alias("site")
    rows = rows.select(site, "hap", F.expr("cast(shiftright(key, bit) & 1 AS int)").alias("g"), F.expr("key & (shiftleft(2L, bit) - 1)").alias("key"), *order[1:-1])
    return rows.select("site", "hap", "g", (F.row_number().over(Window.partitionBy("site").orderBy(*order)) - 1).cast("int").alias("rnk"))


def level_ranks(keys: DataFrame, n_blocks: int) -> dict[int, DataFrame]:
    """For 1, 2, 4, ... blocks: block, hap, rank, where equal ranks mean equal alleles over so many blocks."""
    w = Window.partitionBy("block")
    out = {1: cut(keys.select("block", "hap", F.dense_rank().over(w.orderBy("key")).alias("rank")))}
    d = 1
    while d < n_blocks:
        earlier = out[d].select((F.col("block") + d).alias("block"), "hap", F.col("rank").alias("before"))
        both = out[d].join(earlier, ["block", "hap"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
        out[2 * d] = cut(both.select("block", "hap", F.dense_rank().over(w.orderBy("rank", "before")).alias("rank")))
        d *= 2
    return out


def equal_since(pairs: DataFrame, keys: DataFrame, identities: dict[int, DataFrame]) -> DataFrame:
    """Adds since to (site, hap, above): the first site from which on both are equal up to it."""
    of = lambda name: keys.select("block", F.col("hap").alias(name), F.col("key").alias(f"{name}_key"))
    last = lambda bits: F.floor(F.log2(bits.cast("double"))).cast("int") + 1
    mask = F.expr(f"shiftleft(2L, site % {BLOCK}) - 1")
    rows = pairs.withColumn("block", F.floor(F.col("site") / BLOCK).cast("int")).join(of("hap"), ["block", "hap"]).join(of("above"), ["block", "above"])
    rows = rows.withColumn("differ", F.col("hap_key").bitwiseXOR(F.col("above_key")).bitwiseAND(mask)).select("site", "hap", "above", "block", "differ")
    found = rows.where("differ <> 0").select("site", "hap", "above", (F.col("block") * BLOCK + last(F.col("differ"))).alias("since"))
    # pairs that are equal in their block: what they share before it does not depend on the site
    rest = rows.where("differ = 0").select("hap", "above", "block").distinct().withColumn("at", F.col("block") - 1)
    for d in sorted(identities, reverse=True):
        ids = identities[d]
        a = ids.select(F.col("block").alias("at"), "hap", F.col("id").alias("a"))
        b = ids.select(F.col("block").alias("at"), F.col("hap").alias("above"), F.col("id").alias("b"))
        rest = rest.join(a, ["at", "hap"], "left").join(b, ["at", "above"], "left")
        rest = rest.select("hap", "above", "block", F.when(F.col("a") == F.col("b"), F.greatest(F.col("at") - d, F.lit(-1))).otherwise(F.col("at")).alias("at"))
    at = lambda name: keys.select(F.col("block").alias("at"), F.col("hap").alias(name), F.col("key").alias(f"{name}_key"))
    rest = rest.join(at("hap"), ["at", "hap"], "left").join(at("above"), ["at", "above"], "left")
    before = F.col("at") * BLOCK + last(F.col("hap_key").bitwiseXOR(F.col("above_key")))
    rest = rest.select("hap", "above", "block", F.when(F.col("at") < 0, 0).otherwise(before).alias("since"))
    equal = rows.where("differ = 0").join(rest, ["hap", "above", "block"]).select("site", "hap", "above", "since")
    return found.unionByName(equal).select("site", "hap", "above", F.col("since").cast("int").alias("since"))


def divergence(ranks: DataFrame, keys: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """site, hap, above, since: from which site on a haplotype equals its upper neighbour. keys and
    levels: those of `whole_keys` and `level_ranks`."""
    pairs = cut(ranks.select("site", "hap", F.lag("hap").over(Window.partitionBy("site").orderBy("rnk")).alias("above")))
    found = equal_since(pairs.where("above IS NOT NULL"), keys, {d: r.select("block", "hap", F.col("rank").alias("id")) for d, r in levels.items()})
    first = pairs.where("above IS NULL").select("site", "hap", F.lit(None).cast("int").alias("above"), (F.col("site") + 1).cast("int").alias("since"))
    return found.unionByName(first)


def buckets(sites: DataFrame, interval: float, with_first: bool) -> DataFrame:
    """The first site of each stretch of genetic length `interval`, counted from the first site: one
    whose cm exceeds a multiple strictly. with_first: the first site starts a stretch too."""
    w = Window.orderBy("site")  # the sites of one chromosome
    off = F.col("cm") - F.first("cm").over(w)
    rows = sites.select("site", "cm", (F.ceil(off / interval) - 1).cast("int").alias("bucket"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("site"))).where("n = 1 AND bucket >= 1")
    if with_first:
        start = rows.orderBy("site").limit(1).select("site", "cm", F.lit(0).alias("bucket"))
        first = start.unionByName(first.select("site", "cm", "bucket"))
    return first.select("site", "cm", (F.row_number().over(w) - 1).cast("int").alias("idx"))


def group_of(query_sites: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds grp: the last match group that starts at or before the query site."""
    both = query_sites.select("site", F.lit(None).cast("int").alias("grp")).unionByName(groups.select("site", F.col("idx").alias("grp")))
    running = F.last("grp", ignorenulls=True).over(Window.orderBy("site", F.col("grp").isNull()))
    marked = both.select("site", "grp", running.alias("now")).where("grp IS NULL").select("site", F.col("now").alias("grp"))
    return query_sites.join(marked, "site")


def neighbours_of_site(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """site, hap, cand of one site (site, hap, rnk).
    Removing ids from the largest down leaves in a linked list just those that are smaller."""
    # haplotypes by their place among the site's ids, in arrays of four bytes; -1: none
    ids = np.sort(frame["hap"].to_numpy(np.int32))
    order, n = np.searchsorted(ids, frame.sort_values("rnk")["hap"].to_numpy()).astype(np.int32), len(ids)
    left, right = (np.full(n, -1, np.int32) for _ in range(2))
    left[order[1:]], right[order[:-1]] = order[:-1], order[1:]
    left, right, haps, cands = array("i", left.tobytes()), array("i", right.tobytes()), array("i"), array("i")
    for hap in range(n - 1, 0, -1):
        a, b, found = left[hap], right[hap], 0
        if a >= 0:
            right[a] = b
        if b >= 0:
            left[b] = a
        while found < k and (a >= 0 or b >= 0):
            if a >= 0:
                cands.append(a)
                a, found = left[a], found + 1
            if found < k and b >= 0:
                cands.append(b)
                b, found = right[b], found + 1
        haps.extend((hap,) * found)
    found = pd.DataFrame({"hap": ids[np.array(haps, np.int32)], "cand": ids[np.array(cands, np.int32)]})
    found.insert(0, "site", frame["site"].iloc[0])
    return found


def neighbours(ranks: DataFrame, k: int = 4) -> DataFrame:
    """site, hap, cand: the k nearest in the order among smaller ids, left and right in turn."""
    return dealt(ranks.select("site", "hap", "rnk"), "site").groupBy("site").applyInPandas(lambda frame: neighbours_of_site(frame, k), NEIGHBOURS)


def match_counts(found: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, hap, cand, cnt over the query sites of each group."""
    return found.join(F.broadcast(groups.select("site", "grp")), "site").groupBy("grp", "hap", "cand").agg(F.count("*").alias("cnt"))


def candidates(counts: DataFrame, haps: DataFrame, min_matches: int = 4, all_below: int = 100) -> DataFrame:
    """grp, hap, cand, cnt that pass a threshold which grows with the id; the first `all_below`
    haplotypes take all smaller ids; where none passes, the threshold falls until one does."""
    m = F.lit(min_matches)
    bound = F.when(F.col("hap") < 1000, F.least(F.lit(2), m)).when(F.col("hap") < 10000, m).otherwise(2 * m)
    best = F.max("cnt").over(Window.partitionBy("grp", "hap"))
    later = counts.where(F.col("hap") >= all_below).withColumns({"bound": bound, "best": best})
    needed = F.when(F.col("best") >= F.col("bound"), F.col("bound")).otherwise(F.greatest(F.lit(1), F.least(m, F.col("best"))))
    later = later.where(F.col("cnt") >= needed).select("grp", "hap", "cand", "cnt")
    early = counts.select("grp").distinct().withColumn("hap", F.explode(F.sequence(F.lit(1), F.lit(all_below - 1))))
    early = early.join(haps, "hap", "left_semi").withColumn("cand", F.explode(F.sequence(F.lit(0), F.col("hap") - 1)))
    early = early.join(counts, ["grp", "hap", "cand"], "left").select("grp", "hap", "cand", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return early.unionByName(later)


def top(counts: DataFrame, n: int = 4) -> DataFrame:
    """The n most frequent of each target in each group, ties to the smaller id."""
    place = F.row_number().over(Window.partitionBy("grp", "hap").orderBy(F.desc("cnt"), "cand"))
    return counts.withColumn("rnk", place).where(F.col("rnk") <= n).select("grp", "hap", "cand", "cnt", "rnk")


def propagate(found: DataFrame, tops: DataFrame) -> DataFrame:
    """Candidates and the most frequent ones of both adjacent groups."""
    known = found.select("grp").distinct()
    shifted = tops.withColumn("grp", F.explode(F.array(F.col("grp") - 1, F.col("grp") + 1))).join(F.broadcast(known), "grp", "left_semi")
    return found.select("grp", "hap", "cand").unionByName(shifted.select("grp", "hap", "cand")).distinct()


def imputation_window(ranks: DataFrame, n_reference: int, size: int = 8) -> DataFrame:
    """site, target, ref, place: the references around each target's place among them."""
    is_ref = F.col("hap") < n_reference
    w = Window.partitionBy("site").orderBy("rnk")
    place = F.sum(is_ref.cast("int")).over(w) - is_ref.cast("int")
    rows = ranks.select("site", "hap", is_ref.alias("is_ref"), place.cast("int").alias("place"))
    half, width = size // 2, min(size, n_reference)
    start = F.when(F.col("place") < half, 0).when(F.col("place") > n_reference - half, n_reference - width).otherwise(F.col("place") - half)
    targets = rows.where("NOT is_ref").select("site", F.col("hap").alias("target"), F.explode(F.sequence(start, start + width - 1)).alias("place"))
    refs = rows.where("is_ref").select("site", "place", F.col("hap").alias("ref"))
    return targets.join(refs, ["site", "place"]).select("site", "target", "ref", F.col("place").cast("int").alias("place"))


def match_sets(window: DataFrame) -> DataFrame:
    return window.select("target", "ref").distinct()


def matches_of(found: DataFrame, targets: DataFrame) -> DataFrame:
    """grp, hap, cands: the candidates of the given targets, as one ascending list each."""
    mine = found.join(targets.select("hap").distinct(), "hap", "left_semi")
    return mine.groupBy("grp", "hap").agg(F.array_sort(F.collect_set("cand")).alias("cands"))


def pareto(states: DataFrame, by: str = "target") -> DataFrame:
    """States that no more recent one beats: score below the least of all later sites."""
    later = F.min("score").over(Window.partitionBy(by).orderBy(F.desc("site")).rowsBetween(Window.unboundedPreceding, -1))
    return states.withColumn("later", later).where("later IS NULL OR score < later").drop("later")


def best_overlap(matches: DataFrame, n: int) -> DataFrame:
    """The n longest overlaps of each segment, ties to the one met later."""
    place = F.row_number().over(Window.partitionBy("seg").orderBy(F.desc("overlap"), F.desc("idx")))
    return matches.withColumn("rnk", place).where(F.col("rnk") <= n)


def extend_match(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """hap, other, site -> the stretch (low, high) of equal alleles around the site."""
    own = genotypes.join(pairs.select("hap", "other", F.col("site").alias("at")), "hap")
    differ = own.join(genotypes.select("site", F.col("hap").alias("other"), F.col("g").alias("og")), ["site", "other"])
    ends = differ.groupBy("hap", "other", "at").agg(
        F.max(F.when((F.col("g") != F.col("og")) & (F.col("site") <= F.col("at")), F.col("site") + 1)).alias("low"),
        F.min(F.when((F.col("g") != F.col("og")) & (F.col("site") >= F.col("at")), F.col("site") - 1)).alias("high"),
        F.max("site").alias("last"),
    )
    return ends.select("hap", "other", F.col("at").alias("site"), F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", "last").alias("high"))


def equal_in(genotypes: DataFrame, pairs: DataFrame, start: int, end: int) -> DataFrame:
    """Pairs (hap, other) without a difference in sites start to end (exclusive)."""
    part = genotypes.where(F.col("site").between(start, end - 1))
    differ = part.join(pairs, "hap").join(part.select("site", F.col("hap").alias("other"), F.col("g").alias("og")), ["site", "other"]).where("g <> og")
    return pairs.join(differ.select("hap", "other").distinct(), ["hap", "other"], "left_anti")
