"""Genotypes, sites and ancestry segments derived from the tables of a folder.

The tables hold no genotypes, so the signs of embedding components serve as alleles: haplotype =
vector, site = component. Segments follow a fixed rule and the mismatches make them exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import coordinates

GENETIC_MAP = [(2000.0, 0.0), (15000.0, 0.02), (30000.0, 0.02), (60000.0, 0.09), (90000.0, 0.15)]
EPOCHS = ([0.0, 200.0], [5000.0, 20000.0])
BLOCK = 16
TYPED = 4  # every so many sites one is typed


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, hap, g in long form."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("hap"), F.posexplode("embedding").alias("site", "x"))
    return rows.select("site", "hap", (F.col("x").cast("double") * 1000 > (F.col("site") % 40 - 8) * 14).cast("int").alias("g"))


def typed_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of typed sites, numbered anew."""
    return genotypes(spark, sf_dir).where(F.col("site") % TYPED == 0).withColumn("site", (F.col("site") / TYPED).cast("int"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site and pos of all sites."""
    width = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.max(F.size("embedding")).alias("n"))
    rows = width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("site"))
    return rows.select("site", (1000 + 1500 * F.col("site") + F.col("site") * F.col("site") % 97).alias("pos"))


def genetic_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GENETIC_MAP, "pos double, cm double")


def sites_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, pos and cm, interpolated and made strictly increasing."""
    return coordinates.strictly_increasing(coordinates.interpolate(cut(sites(spark, sf_dir)), genetic_map(spark)))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap, seg_idx, start_bp, end_bp, target, tmrca of all haplotypes but the first."""
    n_blocks = F.ceil(F.size("embedding") / BLOCK).cast("int")
    haps = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("hap"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("seg_idx"))
    starts = sites(spark, sf_dir).where(F.col("site") % BLOCK == 0).select((F.col("site") / BLOCK).cast("int").alias("seg_idx"), F.col("pos").alias("start_bp"))
    ends = starts.select((F.col("seg_idx") - 1).alias("seg_idx"), F.col("start_bp").alias("end_bp"))
    rows = haps.where("hap > 0").join(starts.join(ends, "seg_idx", "left"), "seg_idx")
    return rows.select(
        "hap", "seg_idx", "start_bp", "end_bp",
        ((7 * F.col("hap") + 13 * F.col("seg_idx")) % F.col("hap")).alias("target"),
        (100 + (37 * F.col("hap") + 101 * F.col("seg_idx")) % 997).cast("double").alias("tmrca"),
    )


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap and site where a haplotype differs from its target; the first one's ALT sites."""
    g = genotypes(spark, sf_dir)
    placed = segments(spark, sf_dir).select("hap", F.col("seg_idx").alias("block"), "target")
    own = g.withColumn("block", (F.col("site") / BLOCK).cast("int")).join(placed, ["hap", "block"], "left")
    of_target = g.select("site", F.col("hap").alias("target"), F.col("g").alias("tg"))
    return own.join(of_target, ["site", "target"], "left").where(F.col("g") != F.coalesce("tg", F.lit(0))).select("hap", "site")
