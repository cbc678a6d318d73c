"""Segment times made to follow an expected distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import covering
from .demography import Demography


def simulate(spark: SparkSession, n: int, replicates: int, sizes: list[float], times: list[float], seed: int) -> DataFrame:
    """replicate, k, t: coalescence times of n haploids without recombination; k lineages wait an
    exponential time of rate k (k - 1) / 2. The law is fixed by the demography, the draws by the
    seed: each replicate and step hashes to its own uniform number."""
    demography = Demography(sizes, times)
    rows = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(n), F.lit(2), F.lit(-1))).alias("k"))
    uniform = (F.pmod(F.xxhash64("replicate", "k", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    waits = rows.withColumn("wait", -F.log(uniform) / (F.col("k") * (F.col("k") - 1) / 2.0))
    total = F.sum("wait").over(Window.partitionBy("replicate").orderBy(F.desc("k")))
    return waits.withColumn("std", total).select("replicate", "k", demography.generations(F.col("std")).alias("t"))


def expected_quantiles(simulated: DataFrame) -> DataFrame:
    """quantile, t of simulated times, from 0 to a little beyond the largest."""
    w = Window.orderBy("t")  # the simulated sample, whose size is a setting
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inner = simulated.select((F.row_number().over(w) / (n + 1)).alias("quantile"), "t")
    ends = simulated.agg(F.max("t").alias("most")).select(F.explode(F.array(F.struct(F.lit(0.0).alias("quantile"), F.lit(0.0).alias("t")), F.struct(F.lit(1.0).alias("quantile"), (1.05 * F.col("most")).alias("t")))).alias("e")).select("e.*")
    return inner.unionByName(ends)


def to_expected(quantiles: DataFrame, expected: DataFrame) -> DataFrame:
    """tmrca and the expected time of its quantile, by linear interpolation."""
    w = Window.orderBy("quantile")
    knots = expected.select(F.col("quantile").alias("q0"), F.col("t").alias("t0"), F.lead("quantile").over(w).alias("q1"), F.lead("t").over(w).alias("t1"))
    ends = expected.agg(F.min(F.struct("quantile", "t")), F.max(F.struct("quantile", "t"))).first()
    found = covering(quantiles, "quantile", knots.where("q1 IS NOT NULL"), "q0", "q1", how="left")
    inner = F.col("t0") + (F.col("quantile") - F.col("q0")) * (F.col("t1") - F.col("t0")) / (F.col("q1") - F.col("q0"))
    value = F.when(F.col("quantile") <= ends[0]["quantile"], F.lit(ends[0]["t"])).when(F.col("quantile") >= ends[1]["quantile"], F.lit(ends[1]["t"])).otherwise(inner)
    return found.withColumn("normalized", value).select("tmrca", "normalized")


def apply(segments: DataFrame, mapped: DataFrame) -> DataFrame:
    """Segments with their times replaced."""
    return segments.join(mapped, "tmrca").withColumn("tmrca", F.col("normalized")).select(*segments.columns)
