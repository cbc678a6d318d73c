"""Segments of copied ancestry and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import ancestry, consistency, frequencies, normalize, trees
from ..sources import fixtures, text
from .registry import query
from .sql import define, sql

START, END = 24_100, 61_000

define("atsite", "SELECT s.site, g.hap, g.target, g.tmrca FROM sites s JOIN segs g ON s.pos >= g.start_bp AND (g.end_bp IS NULL OR s.pos < g.end_bp)", "sites", "segs")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = ancestry.at_sites(fixtures.segments(spark, sf_dir), fixtures.sites(spark, sf_dir))
    return trees.states(fixtures.genotypes(spark, sf_dir), at)


@query(sql("SELECT a.site, a.hap, a.target, a.tmrca, CAST(m.hap IS NOT NULL AS INT) AS mism FROM atsite a LEFT JOIN mism m ON m.hap = a.hap AND m.site = a.site", "atsite", "mism"))
def instructions_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = ancestry.at_sites(fixtures.segments(spark, sf_dir), fixtures.sites(spark, sf_dir))
    return ancestry.with_mismatches(at, fixtures.mismatches(spark, sf_dir)).select("site", "hap", "target", "tmrca", "mism")


@query(sql("SELECT hap, site FROM mism", "mism"))
def het_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.mismatches(spark, sf_dir)


@query(sql("SELECT hap, seg_idx, start_bp, target, tmrca FROM segs WHERE start_bp <= (SELECT max(pos) FROM sites WHERE pos <= 61000) AND (end_bp IS NULL OR end_bp >= (SELECT min(pos) FROM sites WHERE pos >= 24100))", "segs"))
def instructions_subrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.sub_range(fixtures.segments(spark, sf_dir), fixtures.sites(spark, sf_dir), START, END).select("hap", "seg_idx", "start_bp", "target", "tmrca")


@query(
    sql(
        """SELECT hap, CAST(row_number() OVER (PARTITION BY hap ORDER BY start_bp) - 1 AS INT) AS seg_idx, CAST(greatest(start_bp, 24100) AS INT) AS start_bp, target, tmrca
FROM segs WHERE start_bp < 61000 AND (end_bp IS NULL OR end_bp > 24100)""",
        "segs",
    )
)
def region_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside, _, _ = ancestry.slice_region(fixtures.segments(spark, sf_dir), fixtures.mismatches(spark, sf_dir), fixtures.sites(spark, sf_dir), START, END)
    return inside.select("hap", "seg_idx", F.col("start_bp").cast("int").alias("start_bp"), "target", "tmrca")


@query(sql("SELECT m.hap, CAST(m.site - (SELECT min(site) FROM sites WHERE pos >= 24100) AS INT) AS site FROM mism m JOIN sites s USING (site) WHERE s.pos >= 24100 AND s.pos < 61000", "mism"))
def region_slice_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, moved, _ = ancestry.slice_region(fixtures.segments(spark, sf_dir), fixtures.mismatches(spark, sf_dir), fixtures.sites(spark, sf_dir), START, END)
    return moved


@query(sql("SELECT site, hap, g FROM geno", "geno"))
def genotype_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the genotypes, from segments and mismatches alone."""
    haps = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("hap"))
    return ancestry.reconstruct(fixtures.segments(spark, sf_dir), fixtures.mismatches(spark, sf_dir), fixtures.sites(spark, sf_dir), haps)


@query(sql("SELECT g.hap, g.seg_idx, count(m.site) AS hets FROM segs g LEFT JOIN (mism m JOIN sites s USING (site)) ON m.hap = g.hap AND s.pos >= g.start_bp AND (g.end_bp IS NULL OR s.pos < g.end_bp) GROUP BY ALL", "segs", "mism"))
def segment_hets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.counts_in_segments(fixtures.segments(spark, sf_dir), fixtures.mismatches(spark, sf_dir), fixtures.sites(spark, sf_dir))


@query(
    sql(
        """SELECT coalesce(n.hap, m.hap) AS hap, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS segment_offset, CAST(coalesce(sum(m) OVER w, 0) AS BIGINT) AS mismatch_offset
FROM (SELECT hap, count(*) AS n FROM segs GROUP BY hap) n FULL JOIN (SELECT hap, count(*) AS m FROM mism GROUP BY hap) m ON n.hap = m.hap
WINDOW w AS (ORDER BY coalesce(n.hap, m.hap) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "mism",
    )
)
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.offsets(fixtures.segments(spark, sf_dir), fixtures.mismatches(spark, sf_dir))


# from one haplotype: the way to the root, then down to all others
START_HAP = 137
define("way", f"SELECT site, hap, target, tmrca AS run, 0.0::DOUBLE AS met FROM atsite WHERE hap = {START_HAP} UNION ALL SELECT a.site, a.hap, a.target, greatest(w.run, a.tmrca), w.run FROM way w JOIN atsite a ON a.site = w.site AND a.hap = w.target", "atsite")
define("onway", "SELECT site, hap, met FROM way UNION ALL SELECT site, 0, max(run) FROM way GROUP BY site", "way")
define("met", "SELECT site, hap, met FROM onway UNION ALL SELECT a.site, a.hap, greatest(m.met, a.tmrca) FROM met m JOIN atsite a ON a.site = m.site AND a.target = m.hap WHERE NOT EXISTS (SELECT 1 FROM onway o WHERE o.site = a.site AND o.hap = a.hap)", "onway")


@query(sql("SELECT site, hap, met AS tmrca FROM met", "met"))
def pairwise_tmrca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one haplotype, of all others at all sites."""
    return trees.tmrca_to(_states(spark, sf_dir), START_HAP)


# chains of carriers down the targets, the longest ones' starts, and times met from each of these
define("chain", "SELECT site, hap, g AS len FROM geno WHERE hap = 0 UNION ALL SELECT a.site, a.hap, CASE WHEN g.g = 1 THEN c.len + 1 ELSE 0 END FROM chain c JOIN atsite a ON a.site = c.site AND a.target = c.hap JOIN geno g ON g.site = a.site AND g.hap = a.hap", "geno", "atsite")
define("heads", "SELECT site, hap AS head FROM chain QUALIFY len = max(len) OVER (PARTITION BY site) AND len > 0", "chain")
define("hway", "SELECT a.site, head, a.hap, a.target, a.tmrca AS run, 0.0::DOUBLE AS met FROM heads h JOIN atsite a ON a.site = h.site AND a.hap = h.head UNION ALL SELECT a.site, w.head, a.hap, a.target, greatest(w.run, a.tmrca), w.run FROM hway w JOIN atsite a ON a.site = w.site AND a.hap = w.target", "heads", "atsite")
define("hon", "SELECT site, head, hap, met FROM hway UNION ALL SELECT site, head, 0, max(run) FROM hway GROUP BY site, head UNION ALL SELECT site, head, 0, 0 FROM heads WHERE head = 0", "hway", "heads")
define("hmet", "SELECT site, head, hap, met FROM hon UNION ALL SELECT a.site, m.head, a.hap, greatest(m.met, a.tmrca) FROM hmet m JOIN atsite a ON a.site = m.site AND a.target = m.hap WHERE NOT EXISTS (SELECT 1 FROM hon o WHERE o.site = a.site AND o.head = m.head AND o.hap = a.hap)", "hon")
define("scored", """SELECT site, head, met, lead(met) OVER (PARTITION BY site, head ORDER BY met) AS next,
  sum(c) OVER (PARTITION BY site, head ORDER BY met) + sum(o) OVER (PARTITION BY site, head) - sum(o) OVER (PARTITION BY site, head ORDER BY met) AS score
  FROM (SELECT h.site, head, met, sum(g) AS c, sum(1 - g) AS o FROM hmet h JOIN geno g USING (site, hap) GROUP BY ALL)""", "hmet", "geno")  # fmt: skip


@query(sql("SELECT site, round(coalesce((met + next) / 2, met + 1), 6) AS age FROM scored QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, head, met) = 1", "scored"))
def allele_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sites with carriers."""
    carried = fixtures.genotypes(spark, sf_dir).groupBy("site").agg(F.max("g").alias("any")).where("any = 1").select("site")
    state = _states(spark, sf_dir).join(F.broadcast(carried), "site", "left_semi")
    return trees.allele_ages(state).select("site", F.round("age", 6).alias("age"))


# Merges as numbers of a site (by height, then haplotype); from each carrier up through carriers, then
# the first merge that leads to another haplotype.
define("merge", "SELECT site, hap, target, tmrca, row_number() OVER (PARTITION BY site ORDER BY tmrca, hap) AS o FROM atsite", "atsite")
for _name, _carrier in (("rare", "SELECT site, hap, CASE WHEN flipped = 1 THEN 1 - g ELSE g END AS g, flipped FROM geno JOIN freq USING (site) WHERE maf <= 0.3 AND maf > 0"), ("alt", "SELECT site, hap, g, 0 AS flipped FROM geno")):
    define(f"{_name}g", _carrier, "geno", "freq")
    define(
        f"{_name}up",
        f"""SELECT site, hap, hap AS at, 0 AS way, true AS pure FROM {_name}g WHERE g = 1
  UNION ALL SELECT u.site, u.hap, m.target, greatest(u.way, m.o), p.g = 1 FROM {_name}up u JOIN merge m ON m.site = u.site AND m.hap = u.at JOIN {_name}g p ON p.site = m.site AND p.hap = m.target WHERE u.pure""",
        f"{_name}g", "merge",
    )
    define(f"{_name}side", f"SELECT m.site, m.target AS hap, min(m.o) AS own FROM merge m JOIN {_name}g c ON c.site = m.site AND c.hap = m.hap WHERE c.g = 0 GROUP BY ALL", f"{_name}g", "merge")
    define(f"{_name}below", f"SELECT u.site, u.at, min(greatest(u.way, s.own)) AS below FROM {_name}up u JOIN {_name}side s ON s.site = u.site AND s.hap = u.hap WHERE u.pure GROUP BY ALL", f"{_name}up", f"{_name}side")
    define(
        f"{_name}end",
        f"""SELECT site, hap, min(way) AS e FROM (SELECT u.site, u.hap, greatest(u.way, b.below) AS way FROM {_name}up u LEFT JOIN {_name}below b ON b.site = u.site AND b.at = u.at WHERE u.pure AND b.below IS NOT NULL
  UNION ALL SELECT site, hap, way FROM {_name}up WHERE NOT pure UNION ALL SELECT site, hap, 1000000000 FROM {_name}g WHERE g = 1) GROUP BY ALL""",
        f"{_name}below",
    )
    define(
        f"{_name}clade",
        f"""SELECT e.site, e.e, list(e.hap ORDER BY e.hap) AS haps, coalesce(max(i.tmrca), 0) AS lower, coalesce(any_value(t.tmrca), 'inf'::DOUBLE) AS upper, coalesce(arg_max(i.hap, i.o), min(e.hap)) AS node
  FROM {_name}end e LEFT JOIN (SELECT m.*, b.e FROM merge m JOIN {_name}end a ON a.site = m.site AND a.hap = m.hap JOIN {_name}end b ON b.site = m.site AND b.hap = m.target AND b.e = a.e) i ON i.site = e.site AND i.hap = e.hap
  LEFT JOIN merge t ON t.site = e.site AND t.o = e.e GROUP BY e.site, e.e""",
        f"{_name}end", "merge",
    )


@query(sql("SELECT site, node, lower, upper, array_to_string(haps, '.') AS haps FROM altclade", "altclade"))
def mutation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches that carry the ALT alleles of each site."""
    found = ancestry.graph(fixtures.segments(spark, sf_dir), _states(spark, sf_dir))["mutations"]
    return found.select("site", "node", "lower", "upper", F.array_join(F.col("haps").cast("array<string>"), ".").alias("haps"))


_AT = "printf('%.4f', lower) || ',' || CASE WHEN isinf(upper) THEN 'inf' ELSE printf('%.4f', upper) END"


@query(
    sql(
        f"""SELECT w.site, w.flipped, coalesce(CASE WHEN n = 1 THEN single ELSE several END, 'NaN') AS mapping FROM (SELECT DISTINCT site, flipped FROM rareg) w
LEFT JOIN (SELECT site, count(*) AS n, any_value('-1,' || {_AT}) AS single, string_agg(array_to_string(haps, '.') || ',' || {_AT}, ';' ORDER BY haps) AS several FROM rareclade GROUP BY site) USING (site)""",
        "rareclade",
    )
)
def mutation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = frequencies.with_frequencies(frequencies.site_counts(fixtures.genotypes(spark, sf_dir)))
    return trees.map_variants(_states(spark, sf_dir), freq, 0.3)


# times that both haplotypes of heterozygous individuals meet all others, and the distances from these
define("udose", "SELECT site, hap // 2 AS ind, sum(g) AS dose FROM geno GROUP BY ALL", "geno")
define("pheads", "SELECT g.site, g.hap AS head FROM geno g JOIN udose d ON d.site = g.site AND d.ind = g.hap // 2 WHERE d.dose = 1", "udose")
define("pway", "SELECT a.site, head, a.hap, a.target, a.tmrca AS run, 0.0::DOUBLE AS met FROM pheads h JOIN atsite a ON a.site = h.site AND a.hap = h.head UNION ALL SELECT a.site, w.head, a.hap, a.target, greatest(w.run, a.tmrca), w.run FROM pway w JOIN atsite a ON a.site = w.site AND a.hap = w.target", "pheads", "atsite")
define("pon", "SELECT site, head, hap, met FROM pway UNION ALL SELECT site, head, 0, max(run) FROM pway GROUP BY site, head UNION ALL SELECT site, head, 0, 0 FROM pheads WHERE head = 0", "pway", "pheads")
define("pmet", "SELECT site, head, hap, met FROM pon UNION ALL SELECT a.site, m.head, a.hap, greatest(m.met, a.tmrca) FROM pmet m JOIN atsite a ON a.site = m.site AND a.target = m.hap WHERE NOT EXISTS (SELECT 1 FROM pon o WHERE o.site = a.site AND o.head = m.head AND o.hap = a.hap)", "pon")
define("pcount", "SELECT site, count(*) FILTER (dose = 1) + 2 * count(*) FILTER (dose = 2) AS n FROM udose GROUP BY site", "udose")
define(
    "pdist",
    """SELECT x.site, x.head, CASE WHEN any_value(c.n) = 1 THEN -min(x.near) ELSE sum(CASE WHEN dose = 1 THEN x.least WHEN dose = 2 THEN x.both ELSE 0 END) END AS d FROM
  (SELECT site, head, hap // 2 AS ind, min(met) AS least, sum(met) AS both, min(met) FILTER (hap <> head) AS near FROM pmet GROUP BY ALL) x JOIN udose USING (site, ind) JOIN pcount c ON c.site = x.site GROUP BY x.site, x.head""",
    "pmet", "udose", "pcount",
)
define("phased", "SELECT a.site, a.head // 2 AS ind, a.d AS d0, b.d AS d1, CASE WHEN a.d <= b.d THEN '1|0' ELSE '0|1' END AS phase FROM pdist a JOIN pdist b ON b.site = a.site AND b.head = a.head + 1 WHERE a.head % 2 = 0", "pdist")


@query(sql("SELECT site, ind, d0, d1, phase FROM phased", "phased"))
def phase_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.phase_distances(_states(spark, sf_dir))


@query(sql("SELECT tmrca, CAST(sum(coalesce(end_bp, (SELECT max(pos) FROM sites)) - start_bp) AS BIGINT) AS span FROM segs GROUP BY tmrca", "segs"))
def tmrca_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = fixtures.sites(spark, sf_dir).agg(F.max("pos")).first()[0]
    return ancestry.tmrca_histogram(fixtures.segments(spark, sf_dir), F.lit(last))


EXPECTED = [(0.0, 0.0), (0.2, 150.0), (0.5, 600.0), (0.9, 2000.0), (1.0, 5000.0)]


@query(
    sql(
        """SELECT DISTINCT q.tmrca, round(CASE WHEN q <= 0 THEN 0 WHEN q >= 1 THEN 5000 ELSE k.t + (q - k.q0) * (k.t1 - k.t) / (k.q1 - k.q0) END, 4) AS normalized FROM
(SELECT tmrca, (sum(span) OVER (ORDER BY tmrca) - span / 2) / sum(span) OVER () AS q FROM (SELECT tmrca, sum(coalesce(end_bp, (SELECT max(pos) FROM sites)) - start_bp) AS span FROM segs GROUP BY tmrca)) q
LEFT JOIN (VALUES (0.0::DOUBLE, 0.2::DOUBLE, 0.0::DOUBLE, 150.0::DOUBLE), (0.2, 0.5, 150.0, 600.0), (0.5, 0.9, 600.0, 2000.0), (0.9, 1.0, 2000.0, 5000.0)) k(q0, q1, t, t1) ON q >= q0 AND q < q1""",
        "segs",
    )
)
def quantile_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times mapped to those of the same quantiles of an expected distribution."""
    last = fixtures.sites(spark, sf_dir).agg(F.max("pos")).first()[0]
    found = ancestry.mid_quantiles(ancestry.tmrca_histogram(fixtures.segments(spark, sf_dir), F.lit(last)))
    expected = spark.createDataFrame(EXPECTED, "quantile double, t double")
    return normalize.to_expected(found, expected).select("tmrca", F.round("normalized", 4).alias("normalized"))


@query()
def simulated_node_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coalescence times of simulated samples, in generations."""
    return normalize.simulate(spark, 50, 20, fixtures.EPOCHS[1], fixtures.EPOCHS[0], seed=1)


@query(
    sql(
        """SELECT start_bp AS start, CAST(lead(start_bp) OVER (PARTITION BY hap ORDER BY start_bp) AS INT) AS "end", hap, target, tmrca AS height FROM
(SELECT *, lag(target) OVER w AS bt, lag(tmrca) OVER w AS bh FROM segs WINDOW w AS (PARTITION BY hap ORDER BY start_bp)) WHERE bt IS NULL OR bt <> target OR bh <> tmrca""",
        "segs",
    )
)
def arg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.edges(fixtures.segments(spark, sf_dir)).select("start", F.col("end").cast("int").alias("end"), "hap", "target", "height")


@query()
def consistency_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments made consistent with the genotypes and allele ages of their sites."""
    state = _states(spark, sf_dir)
    ages = trees.allele_ages(state)
    return consistency.fit(fixtures.genotypes(spark, sf_dir), fixtures.segments(spark, sf_dir), fixtures.sites(spark, sf_dir), ages)


@query(sql("SELECT user_id, ts, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type"))
def run_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return ancestry.breaks(rows, "user_id", "event_id", "event_type")


@query(
    sql(
        """SELECT n_sites, attempted, mac_le_4, mapped, mapped_once, round(100.0::DOUBLE * mapped / attempted, 3) AS mapped_pct, round(100.0::DOUBLE * mapped_once / attempted, 3) AS mapped_once_pct FROM
(SELECT count(*) AS n_sites, count(*) FILTER (maf <= 0.3 AND maf > 0) AS attempted, count(*) FILTER (maf <= 0.3 AND maf > 0 AND mac <= 4) AS mac_le_4, count(c.n) AS mapped, count(*) FILTER (c.n = 1) AS mapped_once
FROM freq f LEFT JOIN (SELECT site, count(*) AS n FROM rareclade GROUP BY site) c USING (site))""",
        "freq", "rareclade",
    )
)
def mapping_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = frequencies.with_frequencies(frequencies.site_counts(fixtures.genotypes(spark, sf_dir)))
    return frequencies.mapping_counters(freq, 0.3, mutation_mapping(spark, sf_dir))


# branches by haplotype, from the mapping strings of the rare variants
define("parsed", """SELECT site, flipped, hap, lower, upper, n = 1 AS is_unique FROM (SELECT DISTINCT site, flipped FROM rareg) JOIN
  (SELECT c.site, unnest(CASE WHEN n = 1 THEN [-1] ELSE haps END) AS hap, lower, upper, n FROM rareclade c JOIN (SELECT site, count(*) AS n FROM rareclade GROUP BY site) k ON k.site = c.site) USING (site)""", "rareclade")  # fmt: skip


@query(sql("SELECT 'v' || site AS variant, site AS pos, flipped, hap, lower, upper, is_unique FROM parsed", "parsed"))
def mut_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of mapping strings; a mapping to one branch has haplotype -1."""
    mapped = mutation_mapping(spark, sf_dir)
    return text.parse_mapping(mapped.select(F.concat(F.lit("v"), F.col("site").cast("string")).alias("variant"), F.col("site").alias("pos"), "flipped", "mapping"))


@query(sql("SELECT site, flipped, hap, lower, upper, is_unique FROM parsed", "parsed"))
def mapping_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, from SQL."""
    tables.register(spark)
    mutation_mapping(spark, sf_dir).createOrReplaceTempView("mapped_variants")
    return spark.sql("SELECT * FROM parse_mapping(TABLE(mapped_variants))")


@query("SELECT user_id, event_type, first, length FROM (SELECT user_id, event_type, min(k) AS first, count(*) AS length FROM (SELECT *, k - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)) GROUP BY user_id, event_type, run)")
def runs_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind of event of each user, by the table function with a partition and an order."""
    tables.register(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type").createOrReplaceTempView("user_events")
    return spark.sql("SELECT user_id, event_type, first, length FROM runs(TABLE(user_events) PARTITION BY user_id ORDER BY (event_id), 'event_type')")
