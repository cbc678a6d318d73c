"""The regularised upper incomplete gamma function of whole orders, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_q(order: Column, x: Column) -> Column:
    """Q(order, x) = exp(-x) * sum of x^k / k! for k < order."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    terms = F.when(order > 1, F.sequence(F.lit(1), order - 1)).otherwise(F.array().cast("array<int>"))
    fold = F.aggregate(terms, start, lambda a, k: F.struct((a["term"] * x / k).alias("term"), (a["total"] + a["term"] * x / k).alias("total")), lambda a: a["total"])
    return F.exp(-x) * fold
