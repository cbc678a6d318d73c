"""Products of the genotype matrix with vectors, and parts of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguous_parts(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.select(key, (F.ntile(n).over(Window.orderBy(key)) - 1).cast("int").alias("part"))


def units(genotypes: DataFrame, diploid: bool) -> DataFrame:
    """site, unit, x: haplotypes with their alleles or individuals with their doses."""
    if not diploid:
        return genotypes.select("site", F.col("hap").alias("unit"), F.col("g").cast("double").alias("x"))
    return genotypes.groupBy("site", F.floor(F.col("hap") / 2).cast("int").alias("unit")).agg(F.sum("g").cast("double").alias("x"))


def moments(values: DataFrame) -> DataFrame:
    """Mean and population deviation of each site."""
    return values.groupBy("site").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))


def multiply(values: DataFrame, vector: DataFrame, on: str, key: str, normalize: bool = False, drop_constant: bool = False) -> DataFrame:
    """sum over `on` of x * weight, for each `key`; normalize: columns of mean 0 and deviation 1."""
    rows = values.join(vector, on)
    if normalize or drop_constant:
        rows = rows.join(moments(values), "site").where("sd > 0")
    x = (F.col("x") - F.col("mu")) / F.col("sd") if normalize else F.col("x")
    return rows.groupBy(key).agg(F.sum(x * F.col("weight")).alias("product"))
