"""Genotypes, allele counts, filters, and products with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequencies, linear
from ..sources import fixtures
from .registry import query
from .sql import sql

FREQ = "SELECT site, ac, an, round(af, 9) AS af, mac, round(maf, 9) AS maf, flipped FROM freq"


def _freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.with_frequencies(frequencies.site_counts(fixtures.genotypes(spark, sf_dir)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("site", "ac", "an", F.round("af", 9).alias("af"), "mac", F.round("maf", 9).alias("maf"), "flipped")


@query(sql("SELECT site, hap, g FROM geno", "geno"))
def genotypes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan into long form."""
    return frequencies.check_biallelic(fixtures.genotypes(spark, sf_dir))


@query(sql("SELECT site, hap // 2 AS ind, CAST(sum(g) AS INT) AS dose FROM geno GROUP BY ALL", "geno"))
def diploid_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.diploid(fixtures.genotypes(spark, sf_dir))


@query(sql(FREQ, "freq"))
def site_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_freq(spark, sf_dir))


@query(sql("SELECT site, ac, an FROM freq WHERE ac > 1 AND ac < an", "freq"))
def ac_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies.informative(frequencies.site_counts(fixtures.genotypes(spark, sf_dir)))


@query(sql(FREQ + " WHERE maf <= 0.3 AND maf > 0", "freq"))
def maf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(frequencies.rare(_freq(spark, sf_dir), 0.3))


@query(sql("SELECT site, hap, CASE WHEN af > 0.5 THEN 1 - g ELSE g END AS carrier FROM geno JOIN freq USING (site)", "freq"))
def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers of the rarer allele."""
    flip = _freq(spark, sf_dir).select("site", "flipped")
    return fixtures.genotypes(spark, sf_dir).join(flip, "site").select("site", "hap", F.abs(F.col("g") - F.col("flipped")).alias("carrier"))


@query("SELECT CAST(vec_id AS INT) AS hap, CAST(ntile(7) OVER (ORDER BY vec_id) - 1 AS INT) AS part FROM embeddings")
def split_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous parts whose sizes differ by one at most, larger ones first."""
    haps = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("hap"))
    return linear.contiguous_parts(haps, "hap", 7)


MOMENTS = """m AS (SELECT site, avg(x) AS mu, stddev_pop(x) AS sd FROM u GROUP BY site)"""


def _product_sql(side: str, diploid: bool, normalize: bool) -> str:
    unit = "u AS (SELECT site, hap // 2 AS unit, CAST(sum(g) AS DOUBLE) AS x FROM geno GROUP BY ALL)" if diploid else "u AS (SELECT site, hap AS unit, CAST(g AS DOUBLE) AS x FROM geno)"
    value = "(x - mu) / sd" if normalize else "x"
    weight, key = ("(unit % 7 - 3) * 0.25", "site") if side == "left" else ("(site % 5 - 2) * 0.5", "unit")
    return sql("", "geno")[:-1] + f", {unit}, {MOMENTS} SELECT {key}, round(sum({value} * {weight}), 6) + 0.0 AS product FROM u JOIN m USING (site) WHERE sd > 0 GROUP BY {key}"


def _product(side: str, diploid: bool, normalize: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = linear.units(fixtures.genotypes(spark, sf_dir), diploid)
        left = side == "left"
        key, other, weight = ("site", "unit", (F.col("unit") % 7 - 3) * 0.25) if left else ("unit", "site", (F.col("site") % 5 - 2) * 0.5)
        vector = units.select(other).distinct().withColumn("weight", weight)
        return linear.multiply(units, vector, other, key, normalize, drop_constant=True).select(key, (F.round("product", 6) + F.lit(0.0)).alias("product"))

    run.__name__ = f"{side}_multiply_{'diploid' if diploid else 'haploid'}_{'normalized' if normalize else 'raw'}"
    return run


for _side in ("left", "right"):
    for _diploid in (False, True):
        for _normalize in (False, True):
            query(_product_sql(_side, _diploid, _normalize))(_product(_side, _diploid, _normalize))
