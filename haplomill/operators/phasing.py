"""Phasing of variants by an ancestry, with a scaffold of variants whose phase is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ancestry, trees


def lockstep(records: DataFrame, scaffold: DataFrame) -> DataFrame:
    """site, other: the records (site, id) that the scaffold (site, id) has, both read in order side by
    side: the scaffold goes on only when its record has come. One that never comes, or comes before
    the one ahead of it, ends the scaffold. Ids that repeat pair off in order."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("site"))
    left = records.select("id", "site", nth.alias("n"))
    right = scaffold.select("id", F.col("site").alias("other"), nth.alias("n"))
    both = right.join(left, ["id", "n"], "left")
    w = Window.orderBy("other")  # two numbers a variant of one chromosome
    before = F.max("site").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bad = F.col("site").isNull() | F.coalesce(F.col("site") <= before, F.lit(False))
    marked = both.withColumn("bad", bad.cast("int")).withColumn("ended", F.max("bad").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("ended = 0").select("site", "other")


def phase(records: DataFrame, scaffold: DataFrame, segments: DataFrame) -> DataFrame:
    """site, hap, g of unphased records (site, pos, id, genotypes): those of the scaffold (site, id,
    genotypes) as they are there; of others each heterozygous individual's ALT allele on the haplotype
    with the more recent relatives among the carriers. Sites beyond the ancestry take its nearest end."""
    pairs = lockstep(records, scaffold)
    alleles = lambda rows: rows.select("site", F.posexplode("genotypes").alias("hap", "g")).select("site", "hap", F.col("g").cast("int").alias("g"))
    known = alleles(pairs.join(scaffold.select(F.col("site").alias("other"), "genotypes"), "other"))
    rest = records.join(pairs, "site", "left_anti")
    geno = alleles(rest)
    ends = segments.agg(F.min("start_bp").alias("low")).first()
    sites = rest.select("site", F.greatest("pos", F.lit(ends["low"])).alias("pos"))
    found = trees.phase_distances(trees.states(geno, ancestry.at_sites(segments, sites))).select("site", "ind", "phase")
    rows = geno.withColumn("ind", F.floor(F.col("hap") / 2).cast("int")).join(found, ["site", "ind"], "left")
    first = (F.col("hap") % 2 == 0) == (F.col("phase") == "1|0")
    turned = rows.select("site", "hap", F.when(F.col("phase").isNull(), F.col("g")).otherwise(first.cast("int")).alias("g"))
    return known.unionByName(turned)
