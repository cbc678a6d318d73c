"""Costs of mutation and recombination in the copying model, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STEP = 1e-6
IMPUTE_NE = 20_000
HOM_LOSS, HET_LOSS = 0.9999, 0.0001


def change(k: Column) -> Column:
    """-log of the chance of an event at rate k."""
    return -F.log1p(-F.exp(-k))


def mutation(mean_bp: Column, rate: float, t: float) -> tuple[Column, Column]:
    """(mismatch, match) costs for a mean site length and branch length t."""
    k = 2.0 * F.lit(rate) * mean_bp * F.lit(t)
    return change(k), k


def recombination(cm_size: Column, t: float, n: Column | None = None) -> tuple[Column, Column]:
    """(switch, stay) costs of a genetic step; n: dense mode, which picks one of n haplotypes."""
    k = 0.02 * cm_size * F.lit(t)
    k = F.when(k == 0, F.lit(NO_STEP)).otherwise(k)
    return (change(k) if n is None else change(k) + F.log(n)), k


def per_target(cm_step: Column, bp_size: Column, rate: float, t: Column, target: Column, sparse: bool) -> tuple[Column, Column, Column, Column]:
    """(switch, stay, mismatch, match) costs of one target, t its branch length."""
    k, l = 0.02 * cm_step * t, 2.0 * F.lit(rate) * bp_size * t  # noqa: E741
    switch = change(k) if sparse else change(k) + F.log(target.cast("double"))
    return switch, k, change(l), l


def imputation_mutation() -> tuple[Column, Column]:
    """(mismatch, match) costs of the imputation model."""
    return -F.log(F.lit(HET_LOSS)), -F.log(F.lit(HOM_LOSS))


def imputation_switch(cm_step: Column, n_panel: int) -> Column:
    """Chance to switch haplotypes over a step of the imputation model."""
    return 1 - F.exp(-4.0 * IMPUTE_NE * 0.01 * cm_step / n_panel)
