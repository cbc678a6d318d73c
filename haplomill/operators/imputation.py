"""Imputation of untyped variants from posteriors at typed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import covering
from ..functions.lineage import among, cut


def sparsify(posteriors: DataFrame, n_panel: int) -> DataFrame:
    """Drops what is no better than chance and lets the rest sum to one again; a target and site with
    nothing better than chance is an error."""
    w = Window.partitionBy("target", "site")
    chance = F.lit(1.0 / n_panel)
    some = F.when(F.max("p").over(w) > chance, F.col("p")).otherwise(F.raise_error(F.lit("a posterior without anything above chance")).cast("double"))
    kept = posteriors.withColumn("p", some).where(F.col("p") > chance)
    return kept.withColumn("p", F.col("p") / F.sum("p").over(w))


def checked(doses: DataFrame) -> DataFrame:
    """Dosages to three decimals; one outside 0 to 1 is an error."""
    dose = F.bround("dose", 3)
    return doses.withColumn("dose", F.when(dose.between(0, 1), dose).otherwise(F.raise_error(F.lit("a dosage outside 0 to 1")).cast("double")))


def typed_or_imputed(panel: DataFrame, target: DataFrame) -> DataFrame:
    """Panel variants with a flag for those that the target has."""
    return panel.join(target.select("site", F.lit(True).alias("_t")).distinct(), "site", "left").withColumn("typed", F.coalesce("_t", F.lit(False))).drop("_t")


def flanks(sites: DataFrame, typed: DataFrame) -> DataFrame:
    """site, prev, next, prev_wt: the typed sites around each site; beyond the ends the last one.
    The weight of the previous one is the distance from it, as published results have it."""
    w = Window.orderBy("pos", "site").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("pos", "site").rowsBetween(1, Window.unboundedFollowing)
    t = F.struct(F.col("site").alias("site"), F.col("pos").alias("pos"))
    both = sites.join(typed.select("site", F.lit(True).alias("typed")), "site", "left")
    rows = both.withColumns({"p": F.last(F.when(F.col("typed"), t), ignorenulls=True).over(w), "n": F.first(F.when(F.col("typed"), t), ignorenulls=True).over(after)})
    gap = F.col("n.pos") - F.col("p.pos")
    weight = F.when(F.col("p").isNull(), 0.0).when(F.col("n").isNull() | (gap == 0), 1.0).otherwise((F.col("pos") - F.col("p.pos")) / gap)
    return rows.select("site", F.coalesce("p.site", "n.site").alias("prev"), F.coalesce("n.site", "p.site").alias("next"), weight.alias("prev_wt"))


def interpolate(posteriors: DataFrame, around: DataFrame) -> DataFrame:
    """target, site, ref, p at every site of `around`."""
    ends = around.select("site", F.explode(F.array(F.struct(F.col("prev").alias("at"), F.col("prev_wt").alias("w")), F.struct(F.col("next").alias("at"), (1 - F.col("prev_wt")).alias("w")))).alias("e")).where("e.w > 0")
    ends = ends.select(F.col("site").alias("new_site"), F.col("e.at").alias("site"), F.col("e.w").alias("w"))
    found = posteriors.join(F.broadcast(ends), "site")
    return found.groupBy("target", F.col("new_site").alias("site"), "ref").agg(F.sum(F.col("p") * F.col("w")).alias("p"))


def copied(panel: DataFrame, posteriors: DataFrame) -> DataFrame:
    """The panel's rows (site, hap, g) of the haplotypes that some posterior names; others change no dosage."""
    return cut(among(panel, posteriors.select(F.col("ref").alias("hap")), "hap"))


def dosages(posteriors: DataFrame, panel: DataFrame) -> DataFrame:
    """target, site, dose: the chance to copy a haplotype with the ALT allele; posteriors meet only
    the panel's carriers."""
    carriers = panel.where("g = 1").select("site", F.col("hap").alias("ref"))
    grid = posteriors.select("target", "site").distinct()
    active = posteriors.join(carriers, ["site", "ref"]).groupBy("target", "site").agg(F.sum("p").alias("dose"))
    return grid.join(active, ["target", "site"], "left").select("target", "site", F.coalesce("dose", F.lit(0.0)).alias("dose"))


def recent(lower: Column, upper: Column, age: Column) -> Column:
    """Chance that two coalescences at a segment of this age come before the mutation."""
    x = 2.0 / age * (lower + upper) / 2
    return 1 - F.exp(-x) * (1 + x)


def segment_before(sites: DataFrame, segments: DataFrame) -> DataFrame:
    """site, hap, target, tmrca of the segment that starts before the site, else the first one."""
    shifted = segments.withColumns({"low": F.when(F.col("seg_idx") == 0, F.lit(-1)).otherwise(F.col("start_bp")), "high": F.col("end_bp")})
    at = covering(sites.withColumn("_before", F.col("pos") - 1), "_before", shifted.select("hap", "target", "tmrca", "low", "high"), "low", "high")
    return at.select("site", "hap", "target", "tmrca")


def arg_delta(posteriors: DataFrame, panel: DataFrame, paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """target, site, delta: what a mapped variant's age takes off the dosage of each target.
    paths: site, hap, target (a panel haplotype), tmrca; mapping: site, lower, upper."""
    carriers = panel.where("g = 1").select("site", F.col("hap").alias("ref"))
    path = paths.select("site", F.col("hap").alias("target"), F.col("target").alias("ref"), "tmrca")
    rows = posteriors.where("p > 0").join(carriers, ["site", "ref"]).join(path, ["site", "target", "ref"]).join(F.broadcast(mapping), "site")
    return rows.groupBy("target", "site").agg(F.sum(F.col("p") * (recent(F.col("lower"), F.col("upper"), F.col("tmrca")) - 1)).alias("delta"))


def mapped_doses(doses: DataFrame, posteriors: DataFrame, panel: DataFrame, sites: DataFrame, segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Doses less what the ages of mapped variants take off; unmapped sites keep theirs. segments:
    target, seg_idx, start_bp, end_bp, ref, age; sites: site, pos; mapping: site, hap (null: any
    carrier), lower, upper, without the variants whose frequent allele was mapped."""
    named = segments.select(F.col("target").alias("hap"), F.col("ref").alias("target"), F.col("age").alias("tmrca"), "seg_idx", "start_bp", "end_bp")
    at = segment_before(cut(sites.join(mapping.select("site").distinct(), "site", "left_semi").select("site", "pos")), named)
    carriers = panel.where("g = 1").select("site", F.col("hap").alias("ref"))
    on_path = at.select("site", F.col("hap").alias("target"), F.col("target").alias("ref"), "tmrca")
    rows = cut(posteriors.where("p > 0").join(carriers, ["site", "ref"]).join(on_path, ["site", "target", "ref"]))
    one = rows.join(mapping.where("hap IS NULL").drop("hap"), "site")
    # of a mapping's branches those of haplotypes that are copied
    branches = among(mapping.where("hap IS NOT NULL").withColumnRenamed("hap", "ref"), rows, "ref")
    some = rows.join(branches, ["site", "ref"]).select(*one.columns)
    taken = F.sum(F.col("p") * (recent(F.col("lower"), F.col("upper"), F.col("tmrca")) - 1)).alias("delta")
    deltas = one.unionByName(some).groupBy("target", "site").agg(taken)
    return doses.join(deltas, ["target", "site"], "left").select("target", "site", (F.col("dose") + F.coalesce("delta", F.lit(0.0))).alias("dose"))


def imputation_segments(genotypes: DataFrame, paths: DataFrame, refs: DataFrame, last_site: int, n: int = 16) -> DataFrame:
    """target, seg_idx, start, end, ref, low, high, weight: for each segment of a target's path the n
    references that equal it there and around it the longest; paths: target, site, ref (what is
    copied from there on); refs: target, ref. The path's own reference counts even with mismatches."""
    w = Window.partitionBy("target").orderBy("site")
    spans = paths.select("target", (F.row_number().over(w) - 1).cast("int").alias("seg_idx"), F.col("site").alias("start"), F.coalesce(F.lead("site").over(w), F.lit(last_site + 1)).alias("end"), F.col("ref").alias("own"))
    own = genotypes.select("site", F.col("hap").alias("target"), "g")
    differ = refs.join(own, "target").join(genotypes.select("site", F.col("hap").alias("ref"), F.col("g").alias("rg")), ["site", "ref"]).where("g <> rg").select("target", "ref", F.col("site").alias("at"))
    pairs = spans.join(refs, "target").join(differ, ["target", "ref"], "left")
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    ends = pairs.groupBy("target", "seg_idx", "start", "end", "own", "ref").agg(
        F.count_if(inside).alias("hets"),
        F.coalesce(F.max(F.when(F.col("at") < F.col("start"), F.col("at") + 1)), F.lit(0)).alias("low"),
        F.coalesce(F.min(F.when(F.col("at") >= F.col("end"), F.col("at"))), F.lit(last_site + 1)).alias("high"),
    )
    kept = ends.where((F.col("hets") == 0) | (F.col("ref") == F.col("own")))
    place = F.row_number().over(Window.partitionBy("target", "seg_idx").orderBy(F.desc(F.col("high") - F.col("low")), "ref"))
    best = kept.withColumn("rnk", place).where(F.col("rnk") <= n)
    weight = 1.0 / F.count("*").over(Window.partitionBy("target", "seg_idx"))
    return best.withColumn("weight", weight).select("target", "seg_idx", "start", "end", "ref", "hets", "low", "high", "weight")


def trim_burn_in(segments: DataFrame, start: int, end: int) -> DataFrame:
    """Segments within [start, end): what ends before it goes, what begins before it begins there."""
    kept = segments.where((F.col("start_bp") < end) & (F.col("end_bp").isNull() | (F.col("end_bp") > start)))
    return kept.withColumn("start_bp", F.greatest("start_bp", F.lit(start))).withColumn("end_bp", F.least(F.coalesce("end_bp", F.lit(end)), F.lit(end)))
