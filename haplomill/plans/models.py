"""Queries of the hidden Markov models; sequential, so tests hold them against plain loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import copying, dating, panel_path, pbwt, penalties, psmc
from ..sources import fixtures
from . import matching, panels
from .dating import DEMO, MU
from .registry import query
from .sql import define, sql


def coordinates_of(spark: SparkSession, sf_dir: str) -> pd.DataFrame:
    """site, pos, cm, step, bp: the coordinates of one region's sites, on the driver as settings."""
    rows = fixtures.sites_cm(spark, sf_dir).toPandas().sort_values("site", ignore_index=True)
    rows["step"] = np.append(np.diff(rows["cm"]), 1e-7)
    rows["bp"] = np.append(np.diff(rows["pos"]), np.diff(rows["pos"]).mean())
    return rows


@query()
def hmm_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of coalescence time along each haplotype against its segment targets."""
    at = coordinates_of(spark, sf_dir)[["site", "step", "bp"]]
    marked = fixtures.mismatches(spark, sf_dir).withColumn("het", F.lit(1))
    rows = fixtures.genotypes(spark, sf_dir).where("hap > 0").select("hap", "site").join(marked, ["hap", "site"], "left").join(F.broadcast(spark.createDataFrame(at)), "site")
    return psmc.break_points_of(rows.select("hap", F.col("site").cast("int").alias("site"), F.coalesce("het", F.lit(0)).alias("het"), "step", "bp"), DEMO, MU)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(matching._counts(spark, sf_dir))
    found = pbwt.propagate(matching._candidates(spark, sf_dir, counts), pbwt.top(counts))
    groups = pbwt.buckets(matching._kept(spark, sf_dir), matching.GROUP_INTERVAL, True).collect()
    at = coordinates_of(spark, sf_dir)
    return copying.infer_paths(fixtures.genotypes(spark, sf_dir), found, {r["idx"]: r["site"] for r in groups}, at["step"].to_numpy(), at["bp"].to_numpy(), DEMO.branch_length, MU)


@query()
def ls_viterbi_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From genotypes to the path of every haplotype through its candidates."""
    return _paths(spark, sf_dir)


@query()
def ls_dated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap, seg_idx, start_bp, target, hets, tmrca: paths with their ages, a segment of one site too.
    Segments of the first haplotypes with many mismatches are split before."""
    from pyspark.sql import Window

    geno = fixtures.genotypes(spark, sf_dir)
    whole = cut(_paths(spark, sf_dir))
    steps = spark.createDataFrame(coordinates_of(spark, sf_dir)[["site", "step", "bp"]])
    order = F.row_number().over(Window.partitionBy("hap").orderBy("site"))
    paths = cut(psmc.split(whole, copying.mismatches(geno, whole), steps, DEMO, MU).withColumn("seg_idx", (order - 1).cast("int")))
    sites = fixtures.sites_cm(spark, sf_dir).select("site", "pos", "cm")
    last = sites.agg(F.max("site")).first()[0]
    w = Window.partitionBy("hap").orderBy("site")
    spans = paths.withColumn("end", F.coalesce(F.lead("site").over(w), F.lit(last)))
    hets = copying.mismatches(geno, paths).join(spans.select("hap", "seg_idx", F.col("site").alias("low"), "end"), "hap")
    hets = hets.where("site >= low AND (site < end OR site = end AND end = " + str(last) + ")").groupBy("hap", "seg_idx").agg(F.count("*").alias("hets"))
    ends = [sites.select(F.col("site").alias(c), F.col("pos").alias(f"{c}_pos"), F.col("cm").alias(f"{c}_cm")) for c in ("site", "end")]
    rows = spans.join(hets, ["hap", "seg_idx"], "left").join(F.broadcast(ends[0]), "site").join(F.broadcast(ends[1]), "end")
    m = F.coalesce("hets", F.lit(0))
    age = dating.date_segment(m, F.col("end_cm") - F.col("site_cm"), (F.col("end_pos") - F.col("site_pos")).cast("double"), MU, DEMO)
    return rows.select("hap", "seg_idx", F.col("site_pos").alias("start_bp"), "target", m.alias("hets"), F.round(age, 4).alias("tmrca"))


def _posteriors(spark: SparkSession, sf_dir: str, sparse: bool = False, near: DataFrame | None = None) -> DataFrame:
    """near: what `panels.typed_near` gives, if it is at hand."""
    geno = fixtures.genotypes(spark, sf_dir).where("site % 4 = 0")
    at = coordinates_of(spark, sf_dir)
    cm = at.loc[at["site"] % 4 == 0, "cm"].to_numpy()
    step = np.append(np.diff(cm), np.diff(cm)[-1])
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() - matching.N_TARGETS
    switch = 1 - np.exp(-4.0 * penalties.IMPUTE_NE * 0.01 * step / n)
    # the neighbours at typed sites, and what the targets' mosaics copy
    sets = matching.typed_match_sets(spark, sf_dir).unionByName((panels.typed_near(spark, sf_dir) if near is None else near).select("target", "ref")).distinct()
    return copying.posteriors(geno, sets, switch, n_panel=n if sparse else None)


define("tsets", "SELECT target, ref FROM tiw UNION SELECT target, ref FROM tnear", "tiw", "tnear")


# the passes in SQL, each row scaled anew, over the numbers j of the typed sites
define("tstep", "SELECT site // 4 AS j, 1 - exp(-800.0::DOUBLE * coalesce(lead(cm) OVER w - cm, cm - lag(cm) OVER w) / n) AS r FROM coords, nref WHERE site % 4 = 0 WINDOW w AS (ORDER BY site)", "coords", "nref")
define(
    "emit",
    """SELECT target, ref, j, n, CASE WHEN bool_and(same) OVER (PARTITION BY target, j) THEN 1.0::DOUBLE WHEN same THEN 1 - 1e-4::DOUBLE ELSE 1e-4::DOUBLE END AS e FROM
  (SELECT m.target, m.ref, a.site // 4 AS j, a.g = b.g AS same, count(*) OVER (PARTITION BY m.target, a.site) AS n FROM tsets m JOIN geno a ON a.hap = m.target AND a.site % 4 = 0 JOIN geno b ON b.hap = m.ref AND b.site = a.site)""",
    "tsets", "geno",
)
define(
    "forward",
    """SELECT target, ref, j, e / sum(e) OVER (PARTITION BY target) AS f FROM emit WHERE j = 0
  UNION ALL SELECT target, ref, j, x / sum(x) OVER (PARTITION BY target) FROM (SELECT i.target, i.ref, i.j, (f.f * (1 - s.r) + s.r / i.n) * i.e AS x FROM forward f JOIN emit i ON i.target = f.target AND i.ref = f.ref AND i.j = f.j + 1 JOIN tstep s ON s.j = i.j)""",
    "emit", "tstep",
)
define(
    "backward",
    """SELECT target, ref, j, 1.0::DOUBLE AS b FROM emit WHERE j = (SELECT max(j) FROM tstep)
  UNION ALL SELECT target, ref, j - 1, ((1 - r) * w + r * (sum(w) OVER (PARTITION BY target)) / n) / sum(w) OVER (PARTITION BY target) FROM (SELECT i.target, i.ref, i.j, s.r, i.n, b.b * i.e AS w FROM backward b JOIN emit i ON i.target = b.target AND i.ref = b.ref AND i.j = b.j JOIN tstep s ON s.j = b.j WHERE b.j > 0)""",
    "emit", "tstep",
)
define("copied", "SELECT f.target, CAST(4 * f.j AS INT) AS site, f.ref, f.f * b.b / sum(f.f * b.b) OVER (PARTITION BY f.target, f.j) AS p FROM forward f JOIN backward b ON b.target = f.target AND b.ref = f.ref AND b.j = f.j", "forward", "backward")


@query(sql("SELECT target, site, ref, round(p, 6) AS p FROM copied", "copied"))
def fwbw_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of each target to copy each haplotype of its match set, at typed sites."""
    return _posteriors(spark, sf_dir).withColumn("p", F.round("p", 6))


@query()
def diploid_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest pairs of mosaics for the doses of the last individuals, over all references."""
    p, targets, n = panels._panel(spark, sf_dir)
    doses = targets.groupBy(F.floor(F.col("hap") / 2).cast("int").alias("ind"), "site").agg(F.sum("g").cast("int").alias("dose"))
    costs = panel_path.whole_costs(fixtures.sites_cm(spark, sf_dir), n, DEMO, MU, True)
    return panel_path.pair_paths(p, doses, costs, stretch=32)
