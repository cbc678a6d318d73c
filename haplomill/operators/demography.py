"""Piecewise-constant population sizes: conversions between generations and coalescent time."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Demography:
    """Haploid sizes from given times (generations) on; a setting of a few to some hundred epochs."""

    sizes: list[float]
    times: list[float]
    std_times: list[float] = field(init=False)

    def __post_init__(self) -> None:
        if len(self.sizes) != len(self.times) or not self.times:
            raise ValueError("a demography needs as many times as sizes")
        if any(t < 0 for t in self.times) or any(n <= 0 for n in self.sizes):
            raise ValueError("times must not be negative and sizes must be positive")
        if any(b <= a for a, b in pairwise(self.times)):
            raise ValueError("times must increase strictly")
        if self.times[0] > 0:
            raise ValueError("a demography must start at time 0")
        std = [0.0]
        for (a, b), n in zip(pairwise(self.times), self.sizes, strict=False):
            std.append(std[-1] + (b - a) / n)
        object.__setattr__(self, "std_times", std)

    def to_generations(self, t: float) -> float:
        if t < 0:
            raise ValueError("coalescent time must not be negative")
        k = bisect_right(self.std_times, t) - 1
        return self.times[k] + (t - self.std_times[k]) * self.sizes[k]

    @property
    def expected_time(self) -> float:
        return self.to_generations(1.0)

    def branch_length(self, n: int) -> float:
        """Expected length of the branch that an n-th sample adds."""
        return self.to_generations(2.0 / n)

    def epochs(self) -> Column:
        """The epochs as an array literal of structs t, ne, std, next_t."""
        after = [*self.times[1:], None]
        return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).alias("ne"), F.lit(s).alias("std"), F.lit(u).cast("double").alias("next_t")) for t, n, s, u in zip(self.times, self.sizes, self.std_times, after, strict=True)])

    def generations(self, t: Column) -> Column:
        """Generations of a column of coalescent times: the last epoch that began by then."""
        epoch = F.element_at(F.filter(self.epochs(), lambda e: e["std"] <= t), -1)
        return epoch["t"] + (t - epoch["std"]) * epoch["ne"]


def std_times(epochs: DataFrame) -> DataFrame:
    """t, ne and the coalescent time at which each epoch begins."""
    w = Window.orderBy("t")  # one row an epoch
    step = F.coalesce((F.col("t") - F.lag("t").over(w)) / F.lag("ne").over(w), F.lit(0.0))
    return epochs.withColumn("step", step).select("t", "ne", F.sum("step").over(w).alias("std_t"))


def frame(spark: SparkSession, demography: Demography) -> DataFrame:
    return spark.createDataFrame(list(zip(demography.times, demography.sizes, strict=True)), "t double, ne double")
