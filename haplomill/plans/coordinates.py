"""Coordinates of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regions import parse_region
from ..operators import coordinates
from ..sources import fixtures
from .registry import query
from .sql import sql


@query(sql("SELECT site, pos FROM sites WHERE pos BETWEEN 20000 AND 60000", "sites"))
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, start, end = parse_region("chr1:20000-60000")
    return fixtures.sites(spark, sf_dir).where(coordinates.in_region(F.col("pos"), start, end))


@query(sql("SELECT site, pos, round(cm, 9) AS cm FROM coords", "coords"))
def map_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sites_cm(spark, sf_dir).select("site", "pos", F.round("cm", 9).alias("cm"))


@query(sql("SELECT site, pos, round(cm, 9) AS cm FROM cm_raw", "cm_raw"))
def map_interpolate_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As imputation uses it: equal values stay."""
    found = coordinates.interpolate(fixtures.sites(spark, sf_dir), fixtures.genetic_map(spark))
    return found.select("site", "pos", F.round("cm", 9).alias("cm"))


@query(sql("SELECT site, pos, round(1.3e-8::DOUBLE * 100 * pos, 9) AS cm FROM sites", "sites"))
def constant_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coordinates.strictly_increasing(coordinates.constant_rate(fixtures.sites(spark, sf_dir), 1.3e-8))
    return rows.select("site", "pos", F.round("cm", 9).alias("cm"))


@query(
    """WITH RECURSIVE v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS site, floor(value) / 8 AS cm FROM events),
r AS (SELECT user_id, site, cm FROM v WHERE site = 0 UNION ALL SELECT v.user_id, v.site, CASE WHEN v.cm <= r.cm THEN r.cm + 1e-5 ELSE v.cm END FROM r JOIN v ON v.user_id = r.user_id AND v.site = r.site + 1)
SELECT user_id, site, round(cm, 9) AS cm FROM r"""
)
def monotone_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user's events taken for a chromosome's coordinates, each made to increase."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", place.alias("site"), (F.floor("value") / 8).alias("cm"))
    return coordinates.strictly_increasing(rows, by="user_id").select("user_id", "site", F.round("cm", 9).alias("cm"))


@query(
    sql(
        """SELECT site, round(coalesce(CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN (a - b) / 2 END,
  (max((pos + a) / 2) OVER () - min((pos + a) / 2) OVER ()) / (count(*) OVER () - 2)), 6) AS size, coalesce((pos + a) / 2, pos) AS boundary
FROM (SELECT *, lag(pos) OVER (ORDER BY site) AS b, lead(pos) OVER (ORDER BY site) AS a FROM sites)""",
        "sites",
    )
)
def site_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinates.site_sizes(fixtures.sites(spark, sf_dir)).select("site", F.round("size", 6).alias("size"), "boundary")


@query(
    sql(
        """SELECT site, round(coalesce(lead(cm) OVER w - cm, 1e-7), 9) AS step, round(coalesce(lead(cm) OVER w - cm, cm - lag(cm) OVER w), 9) AS impute_step
FROM coords WINDOW w AS (ORDER BY site)""",
        "coords",
    )
)
def cm_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinates.cm_steps(fixtures.sites_cm(spark, sf_dir)).select("site", F.round("step", 9).alias("step"), F.round("impute_step", 9).alias("impute_step"))


@query(
    sql(
        """SELECT round((max(pos) - min(pos)) / (count(*) - 1), 6) AS by_steps, round((max(pos) - min(pos)) / count(*), 6) AS by_sites, round((max(edge) - min(edge)) / (count(*) - 2), 6) AS by_inner
FROM (SELECT pos, (pos + lead(pos) OVER (ORDER BY site)) / 2 AS edge FROM sites)""",
        "sites",
    )
)
def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coordinates.mean_intervals(coordinates.check_increasing(fixtures.sites(spark, sf_dir)))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(sql("SELECT site, CAST(ceil(coalesce((pos + lead(pos) OVER (ORDER BY site)) / 2, pos)) AS INT) AS start_bp FROM sites", "sites"))
def boundary_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinates.starts_in_bp(fixtures.sites(spark, sf_dir))
