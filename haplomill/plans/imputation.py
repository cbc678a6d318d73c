"""Imputation from posteriors, and VCF lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import ancestry, frequencies, imputation, panel_path, phasing
from ..sources import fixtures, writers
from . import matching, models, panels
from .dating import _Q, DEMO
from .registry import query
from .sql import define, sql

# a posterior at typed sites that SQL can make too: weights by place in the neighbour window
define("post", "SELECT target, site, ref, (1 + place % 5) / sum(1 + place % 5) OVER (PARTITION BY target, site) AS p FROM iw", "iw")
define("around", """SELECT site, coalesce(p, n) AS prev, coalesce(n, p) AS next, CASE WHEN p IS NULL THEN 0.0::DOUBLE WHEN n IS NULL THEN 1.0 ELSE (pos - pp) / (np - pp) END AS prev_wt FROM
  (SELECT s.site, s.pos, max(t.site) FILTER (t.site <= s.site) AS p, min(t.site) FILTER (t.site > s.site) AS n, max(t.pos) FILTER (t.site <= s.site) AS pp, min(t.pos) FILTER (t.site > s.site) AS np
   FROM sites s CROSS JOIN (SELECT * FROM sites WHERE site % 8 = 7) t GROUP BY ALL)""", "sites")  # fmt: skip
define("spread", "SELECT target, site, ref, sum(p * w) AS p FROM (SELECT x.target, a.site, x.ref, x.p, a.prev_wt AS w FROM post x JOIN around a ON a.prev = x.site UNION ALL SELECT x.target, a.site, x.ref, x.p, 1 - a.prev_wt FROM post x JOIN around a ON a.next = x.site) WHERE w > 0 GROUP BY ALL", "post", "around")
define("dose", "SELECT target, site, coalesce(sum(p) FILTER (g = 1), 0) AS dose FROM spread s JOIN geno ON geno.site = s.site AND geno.hap = s.ref GROUP BY target, s.site".replace("target, site, coalesce", "target, s.site, coalesce"), "spread", "geno")


def _posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching._window(spark, sf_dir).withColumn("w", 1 + F.col("place") % 5)
    return rows.select("target", "site", "ref", (F.col("w") / F.sum("w").over(Window.partitionBy("target", "site"))).alias("p"))


def _around(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = fixtures.sites(spark, sf_dir)
    return imputation.flanks(sites, sites.where("site % 8 = 7"))


def _doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = imputation.interpolate(_posterior(spark, sf_dir), _around(spark, sf_dir))
    return imputation.dosages(spread, fixtures.genotypes(spark, sf_dir))


@query(sql("SELECT target, site, ref, round(p / sum(p) OVER (PARTITION BY target, site), 9) AS p FROM post WHERE p > 1.0 / 9", "post"))
def sparse_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imputation.sparsify(_posterior(spark, sf_dir), 9)
    return found.select("target", "site", "ref", F.round("p", 9).alias("p"))


@query(sql("SELECT site, prev, next, round(prev_wt, 9) AS prev_wt FROM around", "around"))
def posterior_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir).select("site", "prev", "next", F.round("prev_wt", 9).alias("prev_wt"))


@query(sql("SELECT target, site, ref, round(p, 9) AS p FROM spread", "spread"))
def posterior_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputation.interpolate(_posterior(spark, sf_dir), _around(spark, sf_dir)).select("target", "site", "ref", F.round("p", 9).alias("p"))


@query(sql("SELECT target, site, round(dose, 6) AS dose FROM dose", "dose"))
def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doses(spark, sf_dir).select("target", "site", F.round("dose", 6).alias("dose"))


@query(sql("SELECT i.site, s.hap, s.target, s.tmrca FROM sites i JOIN segs s ON (s.seg_idx = 0 OR s.start_bp < i.pos) AND (s.end_bp IS NULL OR s.end_bp >= i.pos)", "segs"))
def segment_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputation.segment_before(fixtures.sites(spark, sf_dir), fixtures.segments(spark, sf_dir))


@query(
    sql(
        """SELECT target, site, round(sum(p * (-exp(-l) * (1 + l))), 9) AS delta FROM
(SELECT x.target, x.site, x.p, 2.0::DOUBLE / (100 + (37 * x.ref + x.site) % 997) * (200 + 3 * x.site) / 2 AS l FROM post x JOIN geno g ON g.site = x.site AND g.hap = x.ref AND g.g = 1 WHERE x.ref % 3 = 0) GROUP BY ALL""",
        "post", "geno",
    )
)
def arg_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every third reference in the targets' paths."""
    found = _posterior(spark, sf_dir)
    copied = found.where("ref % 3 = 0").select("site", F.col("target").alias("hap"), F.col("ref").alias("target"), (100 + (37 * F.col("ref") + F.col("site")) % 997).cast("double").alias("tmrca"))
    mapping = fixtures.sites(spark, sf_dir).select("site", (50.0 + F.col("site")).alias("lower"), (150.0 + 2 * F.col("site")).alias("upper"))
    return imputation.arg_delta(found, fixtures.genotypes(spark, sf_dir), copied, mapping).select("target", "site", F.round("delta", 9).alias("delta"))


@query(sql("SELECT site, pos, site % 4 = 0 AS typed FROM sites", "sites"))
def typed_vs_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = fixtures.sites(spark, sf_dir)
    return imputation.typed_or_imputed(sites, sites.where("site % 4 = 0"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = frequencies.with_frequencies(frequencies.site_counts(fixtures.genotypes(spark, sf_dir)))
    rows = fixtures.sites(spark, sf_dir).join(freq.select("site", "af"), "site")
    fixed = {"chrom": "1", "ref": "A", "alt": "C", "qual": ".", "filter": "PASS"}
    return rows.select("site", "pos", F.concat(F.lit("v"), F.col("site").cast("string")).alias("id"), "af", (F.col("site") % 8 != 7).alias("imputed"), *[F.lit(v).alias(k) for k, v in fixed.items()])


_DS = "regexp_replace(printf('%.3f', {x}), '\\.?0+$', '')"


@query(
    sql(
        f"""SELECT s.site, concat_ws(chr(9), '1', s.pos, 'v' || s.site, 'A', 'C', '.', 'PASS', CASE WHEN s.site % 8 <> 7 THEN 'IMP;' ELSE '' END || 'AF=' || printf('%.4f', f.af), 'GT:DS', c.calls) AS line FROM
(SELECT site, string_agg(CAST(CAST(round_even(a, 0) AS INT) AS VARCHAR) || '|' || CAST(CAST(round_even(b, 0) AS INT) AS VARCHAR) || ':' || {_DS.format(x='a + b')}, chr(9) ORDER BY ind) AS calls FROM
  (SELECT site, target // 2 AS ind, max(round(dose, 3)) FILTER (target % 2 = 0) AS a, max(round(dose, 3)) FILTER (target % 2 = 1) AS b FROM dose GROUP BY ALL) GROUP BY site) c
JOIN sites s USING (site) JOIN freq f USING (site)""",
        "dose", "sites", "freq",
    )
)
def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    doses = _doses(spark, sf_dir).withColumn("dose", F.round("dose", 3))
    return writers.imputed_lines(_variants(spark, sf_dir), doses)


@query(
    sql(
        """SELECT site, concat_ws(chr(9), '1', pos, 'v' || site, 'A', 'C', '.', 'PASS', 'NS=' || count(*), 'GT', string_agg(a || '|' || b, chr(9) ORDER BY ind)) AS line
FROM (SELECT site, hap // 2 AS ind, max(g) FILTER (hap % 2 = 0) AS a, max(g) FILTER (hap % 2 = 1) AS b FROM geno GROUP BY ALL) JOIN sites USING (site) GROUP BY site, pos""",
        "geno", "sites",
    )
)
def instr_vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the genotypes that segments and mismatches give back."""
    haps = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("hap"))
    geno = ancestry.reconstruct(fixtures.segments(spark, sf_dir), fixtures.mismatches(spark, sf_dir), fixtures.sites(spark, sf_dir), haps)
    return writers.phased_lines(_variants(spark, sf_dir), geno)


@query(
    sql(
        """SELECT site, concat_ws(chr(9), '1', pos, 'v' || site, 'A', 'C', '.', 'PASS', 'NS=' || count(*), 'GT', string_agg(c, chr(9) ORDER BY ind)) AS line
FROM (SELECT x.site, x.ind, CASE WHEN x.site % 4 = 0 OR p.phase IS NULL THEN x.a || '|' || x.b ELSE p.phase END AS c FROM
  (SELECT site, hap // 2 AS ind, max(g) FILTER (hap % 2 = 0) AS a, max(g) FILTER (hap % 2 = 1) AS b FROM geno GROUP BY ALL) x LEFT JOIN phased p ON p.site = x.site AND p.ind = x.ind) JOIN sites USING (site) GROUP BY site, pos""",
        "geno", "sites", "phased",
    )
)
def phased_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of genotypes whose phase is forgotten but for every fourth site, and found again."""
    listed = F.array_sort(F.collect_list(F.struct("hap", "g")))
    rows = fixtures.genotypes(spark, sf_dir).groupBy("site").agg(F.transform(listed, lambda x: x["g"]).alias("genotypes"))
    records = cut(rows.join(fixtures.sites(spark, sf_dir), "site").withColumn("id", F.concat(F.lit("v"), F.col("site").cast("string"))))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("genotypes") / 2).cast("int") - 1), lambda k: F.array_sort(F.slice("genotypes", (2 * k + 1).cast("int"), 2)))
    found = phasing.phase(records.withColumn("genotypes", F.flatten(pairs)), records.where("site % 4 = 0"), fixtures.segments(spark, sf_dir))
    return writers.phased_lines(_variants(spark, sf_dir), found)


define("caround", """SELECT site, coalesce(p, n) AS prev, coalesce(n, p) AS next, CASE WHEN p IS NULL THEN 0.0::DOUBLE WHEN n IS NULL THEN 1.0 ELSE (pos - pp) / (np - pp) END AS prev_wt FROM
  (SELECT s.site, s.pos, max(t.site) FILTER (t.site <= s.site) AS p, min(t.site) FILTER (t.site > s.site) AS n, max(t.pos) FILTER (t.site <= s.site) AS pp, min(t.pos) FILTER (t.site > s.site) AS np
   FROM sites s CROSS JOIN (SELECT * FROM sites WHERE site % 4 = 0) t GROUP BY ALL)""", "sites")  # fmt: skip
define("csparse", "SELECT target, site, ref, p / sum(p) OVER (PARTITION BY target, site) AS p FROM copied, nref WHERE p > 1.0::DOUBLE / n", "copied", "nref")
define("cspread", "SELECT target, site, ref, sum(p * w) AS p FROM (SELECT x.target, a.site, x.ref, x.p, a.prev_wt AS w FROM csparse x JOIN caround a ON a.prev = x.site UNION ALL SELECT x.target, a.site, x.ref, x.p, 1 - a.prev_wt FROM csparse x JOIN caround a ON a.next = x.site) WHERE w > 0 GROUP BY ALL", "csparse", "caround")


define("cdose", "SELECT target, s.site, coalesce(sum(p) FILTER (g = 1), 0) AS dose FROM cspread s JOIN geno ON geno.site = s.site AND geno.hap = s.ref GROUP BY target, s.site", "cspread", "geno")


def _imputed(spark: SparkSession, sf_dir: str, sites: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Doses, the posteriors at all sites that they come from, and the panel's haplotypes that these name."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() - matching.N_TARGETS
    found = models._posteriors(spark, sf_dir, sparse=True, near=near)
    spread = cut(imputation.interpolate(found, imputation.flanks(sites, sites.where("site % 4 = 0"))))
    panel = imputation.copied(fixtures.genotypes(spark, sf_dir).where(F.col("hap") < n), spread)
    return imputation.dosages(spread, panel), spread, panel


@query(sql("SELECT target, site, round_even(dose, 3) AS dose FROM cdose", "cdose"))
def imputed_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputation from genotypes to dosages: match sets, posteriors, interpolation, sums."""
    return imputation.checked(_imputed(spark, sf_dir, cut(fixtures.sites(spark, sf_dir)))[0]).select("target", "site", "dose")


_mass = lambda n: f"({_Q.format(x='r * t', n=n)} - CASE WHEN next_t IS NULL THEN 0 ELSE {_Q.format(x='r * coalesce(next_t, 0)', n=n)} END)"
define(
    "tage",
    f"""SELECT target, seg_idx, start, "end", sum(prior * 2 / pow(r, 3) * {_mass(3)}) / sum(prior / pow(r, 2) * {_mass(2)}) AS age FROM
  (SELECT p.*, 1 / ne + 0.02 * cm AS r, t, next_t, (1 / ne) * exp(t / ne - std) AS prior FROM (SELECT p.target, p.seg_idx, p.start, p."end", sum(c.size) AS cm FROM tpath p JOIN tcmsize c ON c.site >= p.start AND c.site < p."end" GROUP BY ALL) p, epochs) GROUP BY ALL""",
    "tpath", "tcmsize", "epochs",
)
define("tsegs", """SELECT n.target, n.ref, n.seg_idx, s.pos AS start_bp, e.pos AS end_bp, a.age FROM tnear n JOIN tage a USING (target, seg_idx) JOIN tcm s ON s.site = n.start LEFT JOIN tcm e ON e.site = n."end" """, "tnear", "tage", "tcm")
# mappings of a kind: a third of the sites to one branch, a third to branches by haplotype, a third to none
define("mapped", "SELECT site, NULL::INT AS hap, 50.0::DOUBLE + site AS lower, 150.0::DOUBLE + 2 * site AS upper FROM sites WHERE site % 3 = 0 UNION ALL SELECT s.site, CAST(vec_id AS INT), 20.0::DOUBLE + vec_id % 50, 120.0::DOUBLE + vec_id % 50 FROM sites s, embeddings WHERE s.site % 3 = 1 AND vec_id % 2 = 0", "sites")
define(
    "delta",
    """SELECT x.target, x.site, sum(x.p * (-exp(-l) * (1 + l))) AS delta FROM (SELECT c.target, c.site, c.p, 2.0::DOUBLE / t.age * (m.lower + m.upper) / 2 AS l FROM cspread c JOIN geno g ON g.site = c.site AND g.hap = c.ref AND g.g = 1 JOIN sites s ON s.site = c.site
  JOIN tsegs t ON t.target = c.target AND t.ref = c.ref AND (t.seg_idx = 0 OR t.start_bp < s.pos) AND (t.end_bp IS NULL OR t.end_bp >= s.pos) JOIN mapped m ON m.site = c.site AND (m.hap IS NULL OR m.hap = c.ref)) x GROUP BY ALL""",
    "cspread", "geno", "sites", "tsegs", "mapped",
)


@query(sql("SELECT d.target, d.site, round_even(dose + coalesce(delta, 0), 3) AS dose FROM cdose d LEFT JOIN delta USING (target, site)", "cdose", "delta"))
def imputed_dosage_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputation where the ages of mapped variants and of the mosaics' segments take part."""
    sites, typed = cut(fixtures.sites(spark, sf_dir)), panels.typed_sites(spark, sf_dir)
    near = panels.typed_near(spark, sf_dir, typed)  # for the match sets and for the segments
    doses, spread, panel = _imputed(spark, sf_dir, sites, near)
    segments = panel_path.dated(near, typed, DEMO)
    one = sites.where("site % 3 = 0").select("site", F.lit(None).cast("int").alias("hap"), (50.0 + F.col("site")).alias("lower"), (150.0 + 2 * F.col("site")).alias("upper"))
    haps = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 2 = 0").select(F.col("vec_id").cast("int").alias("hap"), F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("site"))
    some = haps.where("site % 3 = 1").select("site", "hap", (20.0 + F.col("hap") % 50).alias("lower"), (120.0 + F.col("hap") % 50).alias("upper"))
    return imputation.checked(imputation.mapped_doses(doses, spread, panel, sites, segments, one.unionByName(some))).select("target", "site", "dose")


@query(sql("SELECT hap, seg_idx, CAST(greatest(start_bp, 24100) AS INT) AS start_bp, CAST(least(coalesce(end_bp, 61000), 61000) AS INT) AS end_bp FROM segs WHERE start_bp < 61000 AND (end_bp IS NULL OR end_bp > 24100)", "segs"))
def burn_in_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputation.trim_burn_in(fixtures.segments(spark, sf_dir), 24_100, 61_000).select("hap", "seg_idx", "start_bp", "end_bp")


define("tspans", "SELECT hap AS target, seg_idx, 16 * seg_idx AS start, CASE WHEN seg_idx = 3 THEN 64 ELSE 16 * (seg_idx + 1) END AS \"end\", target AS own FROM segs, nref WHERE hap >= n", "segs", "nref")
define("trefs", "SELECT DISTINCT target, ref FROM iw UNION SELECT target, own FROM tspans", "iw", "tspans")
define("tdiff", "SELECT r.target, r.ref, a.site AS at FROM trefs r JOIN geno a ON a.hap = r.target JOIN geno b ON b.hap = r.ref AND b.site = a.site AND b.g <> a.g", "trefs", "geno")


@query(
    sql(
        """SELECT target, seg_idx, start, "end", ref, hets, low, high, round(1.0 / count(*) OVER (PARTITION BY target, seg_idx), 9) AS weight FROM (
SELECT *, row_number() OVER (PARTITION BY target, seg_idx ORDER BY high - low DESC, ref) AS rnk FROM (
SELECT s.target, s.seg_idx, s.start, s."end", s.own, r.ref, count(*) FILTER (d.at >= s.start AND d.at < s."end") AS hets, coalesce(max(d.at + 1) FILTER (d.at < s.start), 0) AS low, coalesce(min(d.at) FILTER (d.at >= s."end"), 64) AS high
FROM tspans s JOIN trefs r USING (target) LEFT JOIN tdiff d ON d.target = s.target AND d.ref = r.ref GROUP BY ALL) WHERE hets = 0 OR ref = own) WHERE rnk <= 16""",
        "tspans", "trefs", "tdiff",
    )
)
def imputation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest references of each segment of the targets' paths."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() - matching.N_TARGETS
    paths = fixtures.segments(spark, sf_dir).where(F.col("hap") >= n).select(F.col("hap").alias("target"), (16 * F.col("seg_idx")).alias("site"), F.col("target").alias("ref"))
    refs = matching._window(spark, sf_dir).select("target", "ref").unionByName(paths.select("target", "ref")).distinct()
    found = imputation.imputation_segments(fixtures.genotypes(spark, sf_dir), paths, refs, 63)
    return found.select("target", "seg_idx", "start", "end", "ref", "hets", "low", "high", F.round("weight", 9).alias("weight"))
