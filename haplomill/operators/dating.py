"""Ages of shared segments: posterior means under a piecewise coalescent prior.

With T's prior density of rate 1/ne in each epoch and a likelihood in proportion to
T^(m+1) exp(-(rho+mu) T), m mutations and a segment's ends give sums over epochs of incomplete
gamma functions; beyond MANY mutations a single gamma prior is near enough.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.gamma import gamma_q
from .demography import Demography

MANY = 15


def _mean(epochs: Column, order: Column, rate: Column, weight: Column) -> Column:
    """order * sum w^(..) dQ(order + 1) / r^3 over sum dQ(order) / r^2; order = m + 2."""

    def add(a: Column, e: Column) -> Column:
        r = 1.0 / e["ne"] + rate
        prior = (1.0 / e["ne"]) * F.exp(e["t"] / e["ne"] - e["std"]) * F.pow(weight / r, order - 2)

        def mass(n: Column) -> Column:
            return gamma_q(n, r * e["t"]) - F.when(e["next_t"].isNull(), 0.0).otherwise(gamma_q(n, r * F.coalesce(e["next_t"], F.lit(0.0))))

        return F.struct((a["top"] + prior * order / F.pow(r, F.lit(3.0)) * mass(order + 1)).alias("top"), (a["bottom"] + prior / F.pow(r, F.lit(2.0)) * mass(order)).alias("bottom"))

    return F.aggregate(epochs, F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom")), add, lambda a: a["top"] / a["bottom"])


def date_segment(m: Column, cm: Column, bp: Column, mutation_rate: float, demography: Demography) -> Column:
    """Age in generations of a segment with m mismatches."""
    mu, rho = 2.0 * F.lit(mutation_rate) * bp, 0.02 * cm
    many = (m + 2) / (1.0 / F.lit(demography.expected_time) + rho + mu)
    return F.when(m > MANY, many).otherwise(_mean(demography.epochs(), F.least(m, F.lit(MANY)).cast("int") + 2, rho + mu, mu))


def date_segment_sparse(cm: Column, demography: Demography) -> Column:
    """Age in generations from the genetic length alone."""
    return _mean(demography.epochs(), F.lit(2), 0.02 * cm, F.lit(1.0))
