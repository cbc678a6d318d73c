"""Prefix order, neighbours and match candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import frequencies, pbwt
from ..sources import fixtures
from .registry import query
from .sql import define, sql

QUERY_INTERVAL, GROUP_INTERVAL, K, MIN_MATCHES, N_TARGETS = 0.01, 0.05, 4, 4, 50

for _name, _interval in (("query_site", QUERY_INTERVAL), ("group_site", GROUP_INTERVAL)):
    define(f"{_name}_all", f"SELECT site, cm, CAST(ceil(off / {_interval}::DOUBLE) - 1 AS INT) AS bucket FROM kept", "kept")
    define(f"{_name}_first", f"SELECT site, cm, bucket FROM {_name}_all WHERE bucket >= 1 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY site) = 1", f"{_name}_all")
define("qs", "SELECT site, cm, CAST(row_number() OVER (ORDER BY site) - 1 AS INT) AS idx FROM query_site_first", "query_site_first")
define("gs", "SELECT site, cm, CAST(row_number() OVER (ORDER BY site) - 1 AS INT) AS idx FROM (SELECT site, cm FROM group_site_first UNION (SELECT site, cm FROM kept ORDER BY site LIMIT 1))", "group_site_first")
define("qg", "SELECT site, max(gs.idx) AS grp FROM qs JOIN gs ON gs.site <= qs.site GROUP BY qs.site".replace("SELECT site", "SELECT qs.site"), "qs", "gs")
# the matcher sees only sites that are kept
define("kgeno", "SELECT g.* FROM geno g JOIN kept USING (site)", "geno", "kept")
define("kprefix", "SELECT site, hap, reverse(string_agg(CAST(g AS VARCHAR), '') OVER (PARTITION BY hap ORDER BY site)) AS key FROM kgeno", "kgeno")
define("kranks", "SELECT site, hap, row_number() OVER (PARTITION BY site ORDER BY key, hap) - 1 AS rnk FROM kprefix WHERE site IN (SELECT site FROM qs)", "kprefix", "qs")
define(
    "sided",
    """SELECT a.site, a.hap, b.hap AS cand, CASE WHEN b.rnk < a.rnk THEN 2 * row_number() OVER (PARTITION BY a.site, a.hap, b.rnk < a.rnk ORDER BY abs(b.rnk - a.rnk)) - 1
  ELSE 2 * row_number() OVER (PARTITION BY a.site, a.hap, b.rnk < a.rnk ORDER BY abs(b.rnk - a.rnk)) END AS turn
  FROM kranks a JOIN kranks b ON a.site = b.site AND b.hap < a.hap""",
    "kranks",
)
define("nb", f"SELECT site, hap, cand FROM sided QUALIFY row_number() OVER (PARTITION BY site, hap ORDER BY turn) <= {K}", "sided")
define("mc", "SELECT grp, hap, cand, count(*) AS cnt FROM nb JOIN qg USING (site) GROUP BY ALL", "nb", "qg")
define(
    "cands",
    f"""SELECT g.grp, h.hap, c.hap AS cand, coalesce(mc.cnt, 0) AS cnt FROM (SELECT DISTINCT grp FROM mc) g
  JOIN (SELECT DISTINCT hap FROM geno) h ON h.hap BETWEEN 1 AND 99 JOIN (SELECT DISTINCT hap FROM geno) c ON c.hap < h.hap LEFT JOIN mc ON mc.grp = g.grp AND mc.hap = h.hap AND mc.cand = c.hap
  UNION ALL SELECT grp, hap, cand, cnt FROM (SELECT *, max(cnt) OVER (PARTITION BY grp, hap) AS best,
    CASE WHEN hap < 1000 THEN 2 WHEN hap < 10000 THEN {MIN_MATCHES} ELSE {2 * MIN_MATCHES} END AS bound FROM mc WHERE hap >= 100)
  WHERE cnt >= CASE WHEN best >= bound THEN bound ELSE greatest(1, least({MIN_MATCHES}, best)) END""",
    "mc", "geno",
)
define("tops", "SELECT grp, hap, cand, cnt, CAST(row_number() OVER (PARTITION BY grp, hap ORDER BY cnt DESC, cand) AS INT) AS rnk FROM mc QUALIFY rnk <= 4", "mc")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = frequencies.informative(frequencies.site_counts(fixtures.genotypes(spark, sf_dir))).select("site")
    return fixtures.sites_cm(spark, sf_dir).join(mask, "site", "left_semi")


def _n_sites(spark: SparkSession, sf_dir: str) -> int:
    return fixtures.sites(spark, sf_dir).count()


def _query_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cut(_kept(spark, sf_dir))
    return pbwt.group_of(pbwt.buckets(kept, QUERY_INTERVAL, False), pbwt.buckets(kept, GROUP_INTERVAL, True))


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Neighbours at the query sites, and the sites' groups."""
    kept = _kept(spark, sf_dir).select("site")
    geno = fixtures.genotypes(spark, sf_dir).join(F.broadcast(kept), "site", "left_semi")
    groups = _query_groups(spark, sf_dir)
    ranks = pbwt.prefix_ranks(geno, _n_sites(spark, sf_dir))
    return pbwt.neighbours(ranks.join(F.broadcast(groups.select("site")), "site", "left_semi"), K), groups


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.match_counts(*_neighbours(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    haps = fixtures.genotypes(spark, sf_dir).select("hap").distinct()
    return pbwt.candidates(counts, haps, MIN_MATCHES)


@query(sql("SELECT site, hap, rnk FROM ranks", "ranks"))
def pbwt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.prefix_ranks(fixtures.genotypes(spark, sf_dir), _n_sites(spark, sf_dir)).select("site", "hap", "rnk")


@query(sql("SELECT site, idx FROM qs", "qs"))
def query_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.buckets(_kept(spark, sf_dir), QUERY_INTERVAL, False).select("site", "idx")


@query(sql("SELECT site, idx FROM gs", "gs"))
def match_group_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.buckets(_kept(spark, sf_dir), GROUP_INTERVAL, True).select("site", "idx")


@query(sql("SELECT site, grp FROM qg", "qg"))
def query_site_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_groups(spark, sf_dir).select("site", "grp")


@query(sql("SELECT site, hap, cand FROM nb", "nb"))
def pbwt_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir)[0]


@query(sql("SELECT grp, hap, cand, cnt FROM mc", "mc"))
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(sql("SELECT grp, hap, cand, cnt FROM cands", "cands"))
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, _counts(spark, sf_dir))


@query(sql("SELECT grp, hap, cand, cnt, rnk FROM tops", "tops"))
def match_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.top(_counts(spark, sf_dir))


@query(sql("SELECT grp, hap, cand FROM cands UNION SELECT t.grp + s.d, t.hap, t.cand FROM tops t, (VALUES (-1), (1)) s(d) WHERE t.grp + s.d IN (SELECT grp FROM cands)", "cands", "tops"))
def match_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(_counts(spark, sf_dir))
    return pbwt.propagate(_candidates(spark, sf_dir, counts), pbwt.top(counts))


define("nref", f"SELECT CAST(count(*) - {N_TARGETS} AS INT) AS n FROM embeddings")
define(
    "iw",
    """SELECT t.site, t.hap AS target, r.hap AS ref, CAST(r.place AS INT) AS place FROM
  (SELECT *, CASE WHEN place < 4 THEN 0 WHEN place > n - 4 THEN n - 8 ELSE place - 4 END AS low FROM
    (SELECT site, hap, n, hap < n AS is_ref, sum(CAST(hap < n AS INT)) OVER (PARTITION BY site ORDER BY rnk) - CAST(hap < n AS INT) AS place FROM ranks, nref WHERE site % 8 = 7) WHERE NOT is_ref) t
  JOIN (SELECT site, hap, sum(1) OVER (PARTITION BY site ORDER BY rnk) - 1 AS place FROM ranks, nref WHERE hap < n AND site % 8 = 7) r
  ON r.site = t.site AND r.place BETWEEN t.low AND t.low + 7""",
    "ranks", "nref",
)


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = pbwt.prefix_ranks(fixtures.genotypes(spark, sf_dir), _n_sites(spark, sf_dir)).where("site % 8 = 7")
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return pbwt.imputation_window(ranks, n - N_TARGETS)


# what imputation may see: the order of haplotypes by typed sites alone, around each of these
define("tprefix", "SELECT site, hap, reverse(string_agg(CAST(g AS VARCHAR), '') OVER (PARTITION BY hap ORDER BY site)) AS key FROM geno WHERE site % 4 = 0", "geno")
define("tranks", "SELECT site, hap, row_number() OVER (PARTITION BY site ORDER BY key, hap) AS rnk FROM tprefix", "tprefix")
define("tplace", "SELECT site, hap, rnk, n, hap < n AS is_ref, CAST(sum(CAST(hap < n AS INT)) OVER (PARTITION BY site ORDER BY rnk) - CAST(hap < n AS INT) AS INT) AS place FROM tranks, nref", "tranks", "nref")
define(
    "tiw",
    """SELECT DISTINCT t.hap AS target, r.hap AS ref FROM
  (SELECT *, CASE WHEN place < 4 THEN 0 WHEN place > n - 4 THEN n - 8 ELSE place - 4 END AS low FROM tplace WHERE NOT is_ref) t
  JOIN (SELECT * FROM tplace WHERE is_ref) r ON r.site = t.site AND r.place BETWEEN t.low AND t.low + 7""",
    "tplace",
)


def typed_match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, ref of all typed sites; alleles at other sites, which are to be imputed, have no part."""
    typed = fixtures.typed_genotypes(spark, sf_dir)
    ranks = pbwt.ranks_of_keys(cut(pbwt.whole_keys(typed)), -(-_n_sites(spark, sf_dir) // fixtures.TYPED))
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return pbwt.match_sets(pbwt.imputation_window(ranks, n - N_TARGETS))


@query(sql("SELECT site, target, ref, place FROM iw", "iw"))
def imputation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(spark, sf_dir)


@query(sql("SELECT DISTINCT target, ref FROM iw", "iw"))
def imputation_match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.match_sets(_window(spark, sf_dir))


@query(
    sql(
        """SELECT p.site, p.hap, p.above, CAST(CASE WHEN p.above IS NULL THEN p.site + 1 ELSE coalesce(max(x.site) + 1, 0) END AS INT) AS since
FROM (SELECT site, hap, lag(hap) OVER (PARTITION BY site ORDER BY rnk) AS above FROM ranks) p
LEFT JOIN (SELECT a.site, a.hap, b.hap AS above FROM geno a JOIN geno b ON a.site = b.site AND a.g <> b.g) x ON x.hap = p.hap AND x.above = p.above AND x.site <= p.site
GROUP BY p.site, p.hap, p.above""",
        "ranks",
    )
)
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    geno = fixtures.genotypes(spark, sf_dir)
    n_sites = _n_sites(spark, sf_dir)
    keys = cut(pbwt.whole_keys(geno))
    return pbwt.divergence(pbwt.prefix_ranks(geno, n_sites), keys, pbwt.level_ranks(keys, -(-n_sites // pbwt.BLOCK)))


PAIRS = "(SELECT CAST(vec_id AS INT) AS hap, CAST(vec_id * 7 % (SELECT count(*) FROM embeddings) AS INT) AS other FROM embeddings)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("hap"))
    return rows.select("hap", (F.col("hap") * 7 % rows.count()).cast("int").alias("other"))


@query(
    sql(
        f"""SELECT p.hap, p.other, 30 AS site, CAST(coalesce(max(CASE WHEN a.g <> b.g AND a.site <= 30 THEN a.site + 1 END), 0) AS INT) AS low,
CAST(coalesce(min(CASE WHEN a.g <> b.g AND a.site >= 30 THEN a.site - 1 END), max(a.site)) AS INT) AS high
FROM {PAIRS} p JOIN geno a ON a.hap = p.hap JOIN geno b ON b.hap = p.other AND b.site = a.site GROUP BY ALL""",
        "geno",
    )
)
def extend_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.extend_match(fixtures.genotypes(spark, sf_dir), _pairs(spark, sf_dir).withColumn("site", F.lit(30)))


@query(sql(f"SELECT hap, other FROM {PAIRS} p WHERE NOT EXISTS (SELECT 1 FROM geno a JOIN geno b ON b.site = a.site AND a.g <> b.g WHERE a.hap = p.hap AND b.hap = p.other AND a.site BETWEEN 28 AND 31)", "geno"))
def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pbwt.equal_in(fixtures.genotypes(spark, sf_dir), _pairs(spark, sf_dir), 28, 32)


@query(sql("SELECT grp, hap, string_agg(cand, ',' ORDER BY cand) AS cands FROM (SELECT DISTINCT grp, hap, cand FROM cands WHERE hap % 10 = 3) GROUP BY grp, hap", "cands"))
def matches_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of some targets (the selection is the feature), a list each."""
    found = _candidates(spark, sf_dir, cut(_counts(spark, sf_dir)))
    targets = found.select("hap").where("hap % 10 = 3")
    return pbwt.matches_of(found, targets).select("grp", "hap", F.array_join(F.col("cands").cast("array<string>"), ",").alias("cands"))


STATES = "SELECT user_id AS target, event_id AS site, value AS score FROM events"


@query(f"SELECT target, site, score FROM (SELECT *, min(score) OVER (PARTITION BY target ORDER BY site DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM ({STATES})) WHERE later IS NULL OR score < later")
def state_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto front of states by recency and score, on events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("target"), F.col("event_id").alias("site"), F.col("value").alias("score"))
    return pbwt.pareto(rows)


@query("SELECT seg, idx, overlap, CAST(row_number() OVER (PARTITION BY seg ORDER BY overlap DESC, idx DESC) AS INT) AS rnk FROM (SELECT l_orderkey AS seg, l_linenumber AS idx, CAST(l_quantity AS INT) % 5 AS overlap FROM lineitem) QUALIFY rnk <= 3")
def best_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("seg"), F.col("l_linenumber").alias("idx"), (F.col("l_quantity").cast("int") % 5).alias("overlap"))
    return pbwt.best_overlap(rows, 3)
