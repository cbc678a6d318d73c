"""All queries of the haplotype part, with their SQL."""

from . import ancestry, coordinates, dating, genotypes, imputation, matching, models, panels
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ancestry", "coordinates", "dating", "genotypes", "imputation", "matching", "models", "panels"]
