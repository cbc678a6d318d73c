"""Queries of a panel in prefix order: insertion, removal, the cheapest mosaic and its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import panel, panel_path
from ..sources import fixtures
from . import matching
from .dating import _Q, DEMO, MU, _gen
from .registry import query
from .sql import CTE, define, sql

N = matching.N_TARGETS

ORDER_SQL = """SELECT p.site, p.hap, CAST(p.rnk AS INT) AS rnk, p.above, CAST(CASE WHEN p.above IS NULL THEN p.site + 1 ELSE coalesce(max(x.site) + 1, 0) END AS INT) AS since
FROM (SELECT site, hap, rnk, lag(hap) OVER (PARTITION BY site ORDER BY rnk) AS above FROM {ranks}) p
LEFT JOIN (SELECT a.site, a.hap, b.hap AS above FROM geno a JOIN geno b ON a.site = b.site AND a.g <> b.g) x ON x.hap = p.hap AND x.above = p.above AND x.site <= p.site
GROUP BY p.site, p.hap, p.rnk, p.above"""


def _count(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def _panel(spark: SparkSession, sf_dir: str) -> tuple[panel.Panel, DataFrame, int]:
    """The panel of all but the last haplotypes, these, and their first id."""
    n = _count(spark, sf_dir) - N
    geno = cut(fixtures.genotypes(spark, sf_dir))
    return panel.build(geno.where(F.col("hap") < n), matching._n_sites(spark, sf_dir)), geno.where(F.col("hap") >= n), n


def _rows(p: panel.Panel) -> DataFrame:
    return p.order.select("site", "hap", "rnk").join(p.since, ["site", "hap"]).select("site", "hap", "rnk", "above", "since")


@query(sql(ORDER_SQL.format(ranks="ranks"), "ranks"))
def panel_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last haplotypes inserted into the panel of the others."""
    p, newcomers, _ = _panel(spark, sf_dir)
    return _rows(panel.insert(p, newcomers))


define("restranks", "SELECT site, hap, row_number() OVER (PARTITION BY site ORDER BY key, hap) - 1 AS rnk FROM prefix WHERE hap % 7 NOT IN (2, 3)", "prefix")


@query(sql(ORDER_SQL.format(ranks="restranks"), "restranks"))
def panel_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of all, after two of each seven haplotypes have left it (the choice is the feature)."""
    geno = cut(fixtures.genotypes(spark, sf_dir))
    p = panel.build(geno, matching._n_sites(spark, sf_dir))
    return _rows(panel.remove(p, geno.select("hap").where("hap % 7 IN (2, 3)")))


# Whole costs of the dense model, whose genetic sizes reach half-way to the neighbours.
define(
    "cmsize",
    """SELECT site, coalesce((after - before) / 2, (max(edge) OVER () - min(edge) OVER ()) / (n - 2)) AS size FROM
  (SELECT site, lag(cm) OVER w AS before, lead(cm) OVER w AS after, (cm + lead(cm) OVER w) / 2 AS edge, count(*) OVER () AS n FROM coords WINDOW w AS (ORDER BY site))""",
    "coords",
)


def _cost_sql(sites: str, dense: bool) -> str:
    t = _gen("(2.0::DOUBLE / (n + 1))")
    more = " + ln(n)" if dense else ""
    unit = panel_path.UNIT
    return f"""SELECT site, CAST(round(k * {unit}) AS BIGINT) AS stay, CAST(round((-ln(1 - exp(-k)){more}) * {unit}) AS BIGINT) AS switch, CAST(round(l * {unit}) AS BIGINT) AS match, CAST(round(-ln(1 - exp(-l)) * {unit}) AS BIGINT) AS mismatch
  FROM (SELECT site, n, CASE WHEN size = 0 THEN 1e-6 ELSE 0.02 * size * {t} END AS k, 2 * {MU}::DOUBLE * span * {t} AS l FROM {sites}, nref)"""


define("tcm", "SELECT CAST(site // 4 AS INT) AS site, pos, cm FROM coords WHERE site % 4 = 0", "coords")
define("tcmsize", CTE["cmsize"].partition(" AS (")[2][:-1].replace("FROM coords", "FROM tcm"), "tcm")
define("psites", "SELECT site, size, (SELECT (max(pos) - min(pos)) / count(*) FROM sites) AS span FROM cmsize", "cmsize", "sites")
define("pcost", _cost_sql("psites", True), "psites", "nref")
define("pgeno", "SELECT site, hap, g FROM geno", "geno")


def _path_sql(prefix: str, cost: str, geno: str) -> None:
    """Forward costs of every reference, the best one of each site, and the way back."""
    define(
        f"{prefix}fw",
        f"""SELECT t.hap AS target, r.hap AS ref, 0 AS site, c.stay + CASE WHEN t.g = r.g THEN c.match ELSE c.mismatch END AS f FROM {geno} t JOIN {geno} r ON r.site = 0 JOIN {cost} c ON c.site = 0, nref WHERE t.site = 0 AND t.hap >= nref.n AND r.hap < nref.n
  UNION ALL SELECT x.target, x.ref, x.site + 1, least(x.f, x.z + b.switch - b.stay) + c.stay + CASE WHEN t.g = r.g THEN c.match ELSE c.mismatch END
  FROM (SELECT *, min(f) OVER (PARTITION BY target) AS z FROM {prefix}fw) x JOIN {cost} b ON b.site = x.site JOIN {cost} c ON c.site = x.site + 1 JOIN {geno} t ON t.hap = x.target AND t.site = x.site + 1 JOIN {geno} r ON r.hap = x.ref AND r.site = x.site + 1""",
        geno, cost, "nref",
    )
    define(f"{prefix}best", f"SELECT target, site, min(f) AS z, arg_min(ref, {{'f': f, 'ref': ref}}) AS ref FROM {prefix}fw GROUP BY target, site", f"{prefix}fw")
    define(
        f"{prefix}back",
        f"""SELECT target, site, ref, z AS cost, 0 AS switches FROM {prefix}best WHERE site = (SELECT max(site) FROM {cost})
  UNION ALL SELECT y.target, y.site - 1, CASE WHEN f.f <= b.z + c.switch - c.stay THEN y.ref ELSE b.ref END, y.cost, y.switches + CASE WHEN f.f <= b.z + c.switch - c.stay THEN 0 ELSE 1 END
  FROM {prefix}back y JOIN {prefix}fw f ON f.target = y.target AND f.ref = y.ref AND f.site = y.site - 1 JOIN {prefix}best b ON b.target = y.target AND b.site = y.site - 1 JOIN {cost} c ON c.site = y.site - 1""",
        f"{prefix}best",
    )
    define(
        f"{prefix}path",
        f"SELECT target, CAST(max(switches) OVER (PARTITION BY target) - switches AS INT) AS seg_idx, CAST(min(site) AS INT) AS start, CAST(max(site) + 1 AS INT) AS \"end\", CAST(min(ref) AS INT) AS ref, min(cost) AS cost FROM {prefix}back GROUP BY target, switches",
        f"{prefix}back",
    )
    define(
        f"{prefix}members",
        f"""SELECT p.target, p.seg_idx, p.start, p."end", r.hap AS ref FROM {prefix}path p JOIN {geno} a ON a.hap = p.ref AND a.site >= p.start AND a.site < p."end" JOIN {geno} r ON r.site = a.site, nref WHERE r.hap < nref.n
  GROUP BY ALL HAVING bool_and(a.g = r.g)""",
        f"{prefix}path", geno, "nref",
    )
    define(
        f"{prefix}near",
        f"""SELECT target, seg_idx, start, "end", ref, low, high FROM (SELECT m.*, coalesce(max(a.site) FILTER (a.g <> r.g AND a.site < m.start) + 1, 0) AS low, coalesce(min(a.site) FILTER (a.g <> r.g AND a.site >= m."end"), (SELECT max(site) + 1 FROM {cost})) AS high
  FROM {prefix}members m JOIN {geno} a ON a.hap = m.target JOIN {geno} r ON r.hap = m.ref AND r.site = a.site GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY target, seg_idx ORDER BY high - low DESC, ref) <= 16""",
        f"{prefix}members", geno, cost,
    )


_path_sql("p", "pcost", "pgeno")
# the typed sites alone, numbered anew, and the sparse model
define("tgeno", "SELECT CAST(site // 4 AS INT) AS site, hap, g FROM geno WHERE site % 4 = 0", "geno")
define("ttsites", "SELECT site, size, (SELECT (max(pos) - min(pos)) / count(*) FROM tcm) AS span FROM tcmsize", "tcmsize")
define("tcost", _cost_sql("ttsites", False), "ttsites", "nref")
_path_sql("t", "tcost", "tgeno")


def _paths(spark: SparkSession, sf_dir: str) -> tuple[panel.Panel, DataFrame, DataFrame]:
    p, targets, n = _panel(spark, sf_dir)
    costs = cut(panel_path.whole_costs(fixtures.sites_cm(spark, sf_dir), n, DEMO, MU, True))
    return p, targets, panel_path.paths(p, targets, costs, stretch=32)


@query(sql('SELECT target, seg_idx, start, "end", ref, cost FROM ppath', "ppath"))
def panel_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest mosaic of each of the last haplotypes over all others, and its cost in parts."""
    return _paths(spark, sf_dir)[2].select("target", "seg_idx", "start", "end", "ref", "cost")


@query(sql('SELECT target, seg_idx, start, "end", ref FROM pmembers', "pmembers"))
def panel_path_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All haplotypes that agree with the one copied over each segment."""
    p, _, found = _paths(spark, sf_dir)
    return panel_path.members(p, found)


@query(sql('SELECT target, seg_idx, start, "end", ref, low, high, round(1.0 / count(*) OVER (PARTITION BY target, seg_idx), 9) AS weight FROM pnear', "pnear"))
def imputation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of each segment that equal the target the longest around it."""
    p, targets, found = _paths(spark, sf_dir)
    near = panel_path.longest(panel_path.overlaps(p, targets, panel_path.members(p, found)), 16)
    return near.withColumn("weight", F.round("weight", 9))


define("bpsize", CTE["cmsize"].partition(" AS (")[2][:-1].replace("(cm)", "(pos)").replace("cm", "pos").replace("FROM coords", "FROM sites"), "sites")
define("pedge", "SELECT site, CAST(ceil(coalesce((pos + lead(pos) OVER (ORDER BY site)) / 2, pos)) AS INT) AS start_bp FROM sites", "sites")
define("phets", """SELECT p.target, p.seg_idx, count(*) FILTER (a.g <> b.g) AS m FROM ppath p JOIN geno a ON a.hap = p.target AND a.site >= p.start AND a.site < p."end" JOIN geno b ON b.hap = p.ref AND b.site = a.site GROUP BY ALL""", "ppath", "geno")
_MASS = lambda n: f"({_Q.format(x='r * t', n=n)} - CASE WHEN next_t IS NULL THEN 0 ELSE {_Q.format(x='r * coalesce(next_t, 0)', n=n)} END)"


@query(
    sql(
        f"""SELECT target, seg_idx, e.start_bp, ref, m AS hets, round(CASE WHEN m > 15 THEN (m + 2) / (1 / {DEMO.expected_time}::DOUBLE + 0.02 * cm + 2 * {MU}::DOUBLE * bp) ELSE age END, 3) AS age FROM (
SELECT target, seg_idx, start, ref, any_value(m) AS m, any_value(cm) AS cm, any_value(bp) AS bp, sum(prior * (mm + 2) / pow(r, 3) * {_MASS('mm + 3')}) / sum(prior / pow(r, 2) * {_MASS('mm + 2')}) AS age FROM (
  SELECT x.*, least(m, 15) AS mm, t, next_t, 1 / ne + 0.02 * cm + 2 * {MU}::DOUBLE * bp AS r, (1 / ne) * exp(t / ne - std) * pow(2 * {MU}::DOUBLE * bp / (1 / ne + 0.02 * cm + 2 * {MU}::DOUBLE * bp), least(m, 15)) AS prior FROM
    (SELECT p.target, p.seg_idx, p.start, p.ref, h.m, sum(c.size) AS cm, sum(b.size) AS bp FROM ppath p JOIN phets h ON h.target = p.target AND h.seg_idx = p.seg_idx JOIN cmsize c ON c.site >= p.start AND c.site < p."end" JOIN bpsize b ON b.site = c.site GROUP BY ALL) x, epochs)
  GROUP BY target, seg_idx, start, ref) JOIN pedge e ON e.site = start""",
        "ppath", "phets", "cmsize", "bpsize", "pedge", "epochs",
    )
)
def panel_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaics of newcomers with mismatches and ages."""
    p, targets, found = _paths(spark, sf_dir)
    rows = panel_path.threads(p, targets, found, fixtures.sites_cm(spark, sf_dir), DEMO, MU)
    return rows.select("target", "seg_idx", "start_bp", "ref", "hets", F.round("age", 3).alias("age"))


def typed_near(spark: SparkSession, sf_dir: str, sites: DataFrame | None = None) -> DataFrame:
    """The references closest to the targets by the typed sites, on their mosaics; sites are typed ones."""
    n = _count(spark, sf_dir) - N
    geno = fixtures.typed_genotypes(spark, sf_dir)
    sites = typed_sites(spark, sf_dir) if sites is None else sites
    p, targets = panel.build(geno.where(F.col("hap") < n), sites.count()), geno.where(F.col("hap") >= n)
    costs = cut(panel_path.whole_costs(sites, n, DEMO, MU, False))
    return cut(panel_path.longest(panel_path.overlaps(p, targets, panel_path.members(p, panel_path.paths(p, targets, costs))), 16))


def typed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(fixtures.sites_cm(spark, sf_dir).where("site % 4 = 0").withColumn("site", (F.col("site") / 4).cast("int")))
