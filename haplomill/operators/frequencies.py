"""Allele counts and the filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_counts(genotypes: DataFrame) -> DataFrame:
    """site, ac, an: partial sums before the shuffle on the site."""
    return genotypes.groupBy("site").agg(F.sum("g").cast("long").alias("ac"), F.count("g").cast("long").alias("an"))


def with_frequencies(counts: DataFrame) -> DataFrame:
    """Adds af, mac, maf and flipped."""
    af = F.col("ac") / F.col("an")
    return counts.withColumns({"af": af, "mac": F.least(F.col("ac"), F.col("an") - F.col("ac")), "maf": F.least(af, 1 - af), "flipped": (af > 0.5).cast("int")})


def informative(counts: DataFrame) -> DataFrame:
    """Sites for matching: neither monomorphic nor with a single ALT allele (one REF is kept)."""
    return counts.where("ac > 1 AND ac < an")


def rare(frequencies: DataFrame, maf: float) -> DataFrame:
    return frequencies.where((F.col("maf") <= maf) & (F.col("maf") > 0))


def mapping_counters(frequencies: DataFrame, maf: float, mapped: DataFrame) -> DataFrame:
    """How many variants a mapping run tries, how many of these are very rare, and how many got one
    branch, several, or none, with percentages of those tried. mapped: site, mapping."""
    tried = (F.col("maf") <= maf) & (F.col("maf") > 0)
    rows = frequencies.join(mapped.select("site", "mapping"), "site", "left")
    one = F.coalesce(F.col("mapping").startswith("-1,"), F.lit(False))
    some = F.coalesce(F.col("mapping") != "NaN", F.lit(False))
    counts = rows.agg(F.count("*").alias("n_sites"), F.count_if(tried).alias("attempted"), F.count_if(tried & (F.col("mac") <= 4)).alias("mac_le_4"), F.count_if(tried & some).alias("mapped"), F.count_if(tried & one).alias("mapped_once"))
    share = lambda c: F.when(F.col("attempted") > 0, F.round(100.0 * F.col(c) / F.col("attempted"), 3)).alias(f"{c}_pct")
    return counts.select("*", share("mapped"), share("mapped_once"))


def check_biallelic(genotypes: DataFrame) -> DataFrame:
    """The same rows; any allele but 0 and 1 is an error."""
    checked = F.when(F.col("g").isin(0, 1), F.col("g")).otherwise(F.raise_error(F.lit("alleles must be 0 or 1")).cast("int"))
    return genotypes.withColumn("g", checked)


def diploid(genotypes: DataFrame) -> DataFrame:
    """site, ind, dose of individuals with haplotypes 2 ind and 2 ind + 1."""
    return genotypes.groupBy("site", F.floor(F.col("hap") / 2).cast("int").alias("ind")).agg(F.sum("g").cast("int").alias("dose"))
