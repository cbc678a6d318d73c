"""Copying paths: segments of copied ancestry and the mismatches that make them exact.

segments(hap, seg_idx, start_bp, end_bp, target, tmrca), end null for the last; mismatches(hap,
site); sites(site, pos). A target's id is smaller than the haplotype's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import covering
from ..functions.lineage import cut


def with_ends(segments: DataFrame) -> DataFrame:
    """A segment ends where the haplotype's next one starts."""
    w = Window.partitionBy("hap").orderBy("start_bp")
    return segments.withColumns({"end_bp": F.lead("start_bp").over(w), "seg_idx": (F.row_number().over(w) - 1).cast("int")})


def at_sites(segments: DataFrame, sites: DataFrame, lag: bool = False) -> DataFrame:
    """site, hap, target, tmrca of every haplotype with segments; lag: as of the site before."""
    when = sites.select("site", "pos")
    if lag:
        when = when.withColumn("pos", F.coalesce(F.lag("pos").over(Window.orderBy("site")), "pos"))
    found = covering(when, "pos", segments.select("hap", "start_bp", "end_bp", "target", "tmrca"), "start_bp", "end_bp")
    return found.select("site", "hap", "target", "tmrca")


def with_mismatches(states: DataFrame, mismatches: DataFrame) -> DataFrame:
    marked = mismatches.select("hap", "site", F.lit(1).alias("mism"))
    return states.join(marked, ["hap", "site"], "left").withColumn("mism", F.coalesce("mism", F.lit(0)))


def reconstruct(segments: DataFrame, mismatches: DataFrame, sites: DataFrame, haps: DataFrame) -> DataFrame:
    """site, hap, g: the parity of mismatches on the way to the root, by pointer doubling."""
    low = sites.agg(F.min("pos")).first()[0]
    # where a haplotype copies nobody, the first one everywhere, it has a segment without target
    starts = segments.groupBy("hap").agg(F.min("start_bp").alias("end_bp"))
    rest = haps.select("hap").join(starts, "hap", "left").where(F.col("end_bp").isNull() | (F.col("end_bp") > low))
    rest = rest.select("hap", F.lit(low).alias("start_bp"), "end_bp", F.lit(None).cast("int").alias("target"), F.lit(None).cast("double").alias("tmrca"))
    every = segments.join(haps.select("hap"), "hap", "left_semi").select(*rest.columns).unionByName(rest)
    states = at_sites(every, sites).select("site", "hap", F.col("target").alias("ptr"))
    rows = cut(with_mismatches(states, mismatches).select("site", "hap", "ptr", F.col("mism").alias("parity")))
    done, todo = rows.where("ptr IS NULL"), rows.where("ptr IS NOT NULL")
    while not todo.isEmpty():
        # what has reached the root is looked up but not written again
        above = done.unionByName(todo).select("site", F.col("hap").alias("ptr"), F.col("ptr").alias("next"), F.col("parity").alias("more"))
        rows = cut(todo.join(above, ["site", "ptr"], "left").select("site", "hap", F.col("next").alias("ptr"), (F.col("parity") + F.coalesce("more", F.lit(0))).alias("parity")))
        done, todo = done.unionByName(rows.where("ptr IS NULL")), rows.where("ptr IS NOT NULL")
    return done.select("site", "hap", (F.col("parity") % 2).cast("int").alias("g"))


def slice_region(segments: DataFrame, mismatches: DataFrame, sites: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lies in [start, end): segments clipped at the start, sites numbered anew."""
    kept = sites.where(F.col("pos").between(start, end - 1)).withColumn("new_site", (F.row_number().over(Window.orderBy("site")) - 1).cast("int"))
    inside = segments.where((F.col("start_bp") < end) & (F.col("end_bp").isNull() | (F.col("end_bp") > start)))
    inside = with_ends(inside.withColumn("start_bp", F.greatest("start_bp", F.lit(start))))
    moved = mismatches.join(F.broadcast(kept.select("site", "new_site")), "site").select("hap", F.col("new_site").alias("site"))
    return inside, moved, kept.select(F.col("new_site").alias("site"), "pos")


def sub_range(segments: DataFrame, sites: DataFrame, start: int, end: int) -> DataFrame:
    """Segments that meet the sites of [start, end]; both ends belong to it and nothing is clipped."""
    snapped = sites.agg(F.min(F.when(F.col("pos") >= start, F.col("pos"))).alias("low"), F.max(F.when(F.col("pos") <= end, F.col("pos"))).alias("high")).first()
    low, high = snapped["low"], snapped["high"]
    return segments.where((F.col("start_bp") <= high) & (F.col("end_bp").isNull() | (F.col("end_bp") >= low)))


def counts_in_segments(segments: DataFrame, mismatches: DataFrame, sites: DataFrame) -> DataFrame:
    """hap, seg_idx, hets: the mismatches in each segment."""
    placed = mismatches.join(F.broadcast(sites.select("site", "pos")), "site")
    found = covering(placed, "pos", segments.select("hap", "seg_idx", "start_bp", "end_bp"), "start_bp", "end_bp", by=("hap",))
    counts = found.groupBy("hap", "seg_idx").agg(F.count("*").alias("hets"))
    return segments.join(counts, ["hap", "seg_idx"], "left").select("hap", "seg_idx", F.coalesce("hets", F.lit(0)).alias("hets"))


def nested(segments: DataFrame, mismatches: DataFrame) -> DataFrame:
    """One row a haplotype: starts, targets, tmrcas and mismatches as arrays."""
    listed = segments.groupBy("hap").agg(F.array_sort(F.collect_list(F.struct("start_bp", "target", "tmrca"))).alias("s"))
    sites = mismatches.groupBy("hap").agg(F.array_sort(F.collect_list("site")).alias("mismatches"))
    return listed.join(sites, "hap", "full").select("hap", F.col("s.start_bp").alias("starts"), F.col("s.target").alias("targets"), F.col("s.tmrca").alias("tmrcas"), "mismatches")


def flat(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """segments and mismatches of nested rows; the arrays of a row must agree in length."""
    agree = (F.size("starts") == F.size("targets")) & (F.size("starts") == F.size("tmrcas"))
    checked = F.when(F.col("starts").isNull() | agree, F.arrays_zip("starts", "targets", "tmrcas")).otherwise(F.raise_error(F.lit("starts, targets and tmrcas differ in length")))
    exploded = rows.select("hap", F.explode(checked).alias("s")).select("hap", F.col("s.starts").alias("start_bp"), F.col("s.targets").alias("target"), F.col("s.tmrcas").alias("tmrca"))
    return with_ends(exploded), rows.select("hap", F.explode("mismatches").alias("site"))


def offsets(segments: DataFrame, mismatches: DataFrame) -> DataFrame:
    """hap and where its segments and mismatches start in flat arrays of all haplotypes."""
    n = segments.groupBy("hap").agg(F.count("*").alias("n")).join(mismatches.groupBy("hap").agg(F.count("*").alias("m")), "hap", "full")
    before = Window.orderBy("hap").rowsBetween(Window.unboundedPreceding, -1)  # a row a haplotype
    start = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0))
    return n.select("hap", start("n").alias("segment_offset"), start("m").alias("mismatch_offset"))


def tmrca_histogram(segments: DataFrame, last_pos: Column) -> DataFrame:
    """tmrca and the length over which it holds; the last segment ends at the last position."""
    span = F.coalesce("end_bp", last_pos) - F.col("start_bp")
    return segments.groupBy("tmrca").agg(F.sum(span).alias("span"))


def mid_quantiles(histogram: DataFrame) -> DataFrame:
    """Adds the quantile at the middle of each time's span."""
    w = Window.orderBy("tmrca")  # a row a distinct time
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return histogram.withColumn("quantile", (F.sum("span").over(w) - F.col("span") / 2) / F.sum("span").over(every))


def breaks(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows where a value differs from the one before, and the first of each."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return values.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def edges(segments: DataFrame) -> DataFrame:
    """Edges of the ancestry graph: start, end, hap, target, height, one for each run of segments with
    one target and height; end null for the last."""
    w = Window.partitionBy("hap").orderBy("start_bp")
    before = segments.withColumns({"_target": F.lag("target").over(w), "_height": F.lag("tmrca").over(w)})
    runs = before.where(F.col("_target").isNull() | (F.col("_target") != F.col("target")) | (F.col("_height") != F.col("tmrca")))
    return runs.select(F.col("start_bp").alias("start"), F.lead("start_bp").over(w).alias("end"), "hap", "target", F.col("tmrca").alias("height"))


def graph(segments: DataFrame, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ancestry as a graph: nodes (node, hap, height) with a leaf for each haplotype, edges as
    `edges` has them with the order of equal heights (by haplotype, so that no two merges of a site are
    at once), and, given the state of the sites, mutations (site, node, lower, upper, haps)."""
    from . import trees

    found = edges(segments)
    place = F.row_number().over(Window.partitionBy("start", "height").orderBy("hap")) - 1
    leaves = segments.select("hap").unionByName(segments.select(F.col("target").alias("hap"))).distinct()
    out = {"nodes": leaves.select("hap", F.lit(0.0).alias("height")), "edges": found.withColumn("place", place.cast("int"))}
    if state is not None:
        out["mutations"] = trees.branches(state).select("site", "node", "lower", "upper", "haps")
    return out
