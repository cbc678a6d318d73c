"""Demography, penalties, model scores and segment ages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coordinates, demography, penalties, psmc
from ..operators import dating as ages
from ..sources import fixtures
from .registry import query
from .sql import define, sql

SIZES, TIMES = fixtures.EPOCHS[1], fixtures.EPOCHS[0]
DEMO = demography.Demography(SIZES, TIMES)
MU = 1.4e-8
STATES = psmc.STATES


def _gen(t: str) -> str:
    """SQL for generations of coalescent time t under the two epochs."""
    return f"(CASE WHEN {t} < 0.04::DOUBLE THEN {t} * 5000 ELSE 200 + ({t} - 0.04::DOUBLE) * 20000 END)"


# a demography of the customers by nation
define("nsizes", "SELECT 40.0::DOUBLE * n_nationkey AS t, 1000.0::DOUBLE + 10 * count(c_custkey) AS ne FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
define("nepochs", "SELECT t, ne, sum(step) OVER (ORDER BY t) AS std FROM (SELECT t, ne, coalesce((t - lag(t) OVER (ORDER BY t)) / lag(ne) OVER (ORDER BY t), 0) AS step FROM nsizes)", "nsizes")


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    counts = nations.join(customers, "n_nationkey", "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    return counts.select((40.0 * F.col("n_nationkey")).alias("t"), (1000.0 + 10 * F.col("n")).alias("ne"))


@query(sql("SELECT t, ne, round(std, 9) AS std_t FROM nepochs", "nepochs"))
def demography_std_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demography.std_times(_by_nation(spark, sf_dir)).select("t", "ne", F.round("std_t", 9).alias("std_t"))


@query(f"SELECT o_orderkey, round({_gen('o_totalprice / 1000000::DOUBLE')}, 6) AS generations, round({_gen('2.0::DOUBLE / (o_orderkey + 1)')}, 6) AS branch FROM orders")
def std_to_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of coalescent times, and expected branch lengths, over orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 1_000_000).alias("t"))
    return rows.select("o_orderkey", F.round(DEMO.generations(F.col("t")), 6).alias("generations"), F.round(DEMO.generations(2.0 / (F.col("o_orderkey") + 1)), 6).alias("branch"))


define("steps", "SELECT site, pos, coalesce(lead(cm) OVER w - cm, 1e-7) AS step, coalesce(lead(pos) OVER w - pos, 1500) AS bp, coalesce(lead(cm) OVER w - cm, cm - lag(cm) OVER w) AS istep FROM coords WINDOW w AS (ORDER BY site)", "coords")
_T = _gen("(2.0::DOUBLE / 501)")


@query(
    sql(
        f"""SELECT site, round(-ln(1 - exp(-k)), 5) AS mu, round(k, 9) AS mu_c, round(-ln(1 - exp(-r)), 5) AS rho, round(r, 9) AS rho_c, round(-ln(1 - exp(-r)) + ln(500.0), 5) AS rho_dense,
round(1 - exp(-4.0 * 20000 * 0.01 * istep / 450), 9) AS switch
FROM (SELECT site, istep, 2 * {MU}::DOUBLE * span * {_T} AS k, CASE WHEN step = 0 THEN 1e-6 ELSE 0.02 * step * {_T} END AS r FROM steps, (SELECT (max(pos) - min(pos)) / count(*) AS span FROM steps))""",
        "steps",
    )
)
def ls_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the copying model for 500 haplotypes and a panel of 450."""
    sites = fixtures.sites_cm(spark, sf_dir)
    steps = coordinates.cm_steps(sites)
    span = sites.agg(((F.max("pos") - F.min("pos")) / F.count("*")).alias("span")).first()["span"]
    t = DEMO.branch_length(501)
    mu, mu_c = penalties.mutation(F.lit(span), MU, t)
    rho, rho_c = penalties.recombination(F.col("step"), t)
    dense, _ = penalties.recombination(F.col("step"), t, F.lit(500.0))
    columns = {"mu": (mu, 5), "mu_c": (mu_c, 9), "rho": (rho, 5), "rho_c": (rho_c, 9), "rho_dense": (dense, 5), "switch": (penalties.imputation_switch(F.col("impute_step"), 450), 9)}
    return steps.select("site", *[F.round(c, n).alias(name) for name, (c, n) in columns.items()])


@query(
    sql(
        f"""SELECT site, target, round(-ln(1 - exp(-k)) + ln(target), 5) AS rho, round(k, 12) AS rho_c, round(-ln(1 - exp(-l)), 5) AS mu, round(l, 12) AS mu_c
FROM (SELECT site, target, 0.02 * step * t AS k, 2 * {MU}::DOUBLE * bp * t AS l FROM steps, (SELECT target, {_gen('(2.0::DOUBLE / (target + 1))')} AS t FROM (SELECT CAST(vec_id AS INT) AS target FROM embeddings WHERE vec_id > 0)))""",
        "steps",
    )
)
def lowmem_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of each site for every target, whose branch lengths differ."""
    sites = fixtures.sites_cm(spark, sf_dir)
    steps = coordinates.cm_steps(sites).join(sites.select("site", "pos"), "site")
    after = sites.select((F.col("site") - 1).alias("site"), F.col("pos").alias("next_pos"))
    steps = steps.join(after, "site", "left").withColumn("bp", F.coalesce(F.col("next_pos") - F.col("pos"), F.lit(1500)))
    targets = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id > 0").select(F.col("vec_id").cast("int").alias("target"), F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("site"))
    rows = targets.join(F.broadcast(steps), "site")
    rho, rho_c, mu, mu_c = penalties.per_target(F.col("step"), F.col("bp"), MU, DEMO.generations(2.0 / (F.col("target") + 1)), F.col("target"), sparse=False)
    return rows.select("site", "target", F.round(rho, 5).alias("rho"), F.round(rho_c, 12).alias("rho_c"), F.round(mu, 5).alias("mu"), F.round(mu_c, 12).alias("mu_c"))


@query(sql("SELECT site, round(CASE WHEN site % 3 = 0 THEN -ln(0.0001::DOUBLE) ELSE -ln(0.9999::DOUBLE) END, 9) AS cost FROM sites", "sites"))
def impute_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the imputation model, were every third site a mismatch."""
    mismatch, match = penalties.imputation_mutation()
    return fixtures.sites(spark, sf_dir).select("site", F.round(F.when(F.col("site") % 3 == 0, mismatch).otherwise(match), 9).alias("cost"))


define("states", f"SELECT CAST(i AS INT) AS state, {_gen(f'(-ln(1 - (i - 0.5) / {STATES}))')} AS t FROM range(1, {STATES + 1}) r(i)")


@query(
    sql(
        f"""SELECT state, round(arg_max(e.t + (x - e.std) * e.ne, e.t), 6) AS t FROM (SELECT CAST(i AS INT) AS state, -ln(1 - (i - 0.5) / {STATES}) AS x FROM range(1, {STATES + 1}) r(i)) JOIN nepochs e ON e.std <= x GROUP BY state""",
        "nepochs",
    )
)
def hmm_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected times of the model's states under the demography of the nations."""
    epochs = _by_nation(spark, sf_dir).orderBy("t").collect()  # an epoch a nation
    found = demography.Demography([r["ne"] for r in epochs], [r["t"] for r in epochs])
    return psmc.state_times(spark, found, STATES).select("state", F.round("t", 6).alias("t"))


@query(
    sql(
        f"""SELECT site, state, round(ln(1 - exp(-l)) - ln({STATES}), 5) + 0.0 AS trans, round(ln(exp(-l) + (1 - exp(-l)) / {STATES}), 5) + 0.0 AS stay, round(-m, 9) + 0.0 AS hom, round(ln(1 - exp(-m)), 5) + 0.0 AS het
FROM (SELECT site, state, 0.02 * step * t AS l, 2 * {MU}::DOUBLE * bp * t AS m FROM steps, states)""",
        "steps", "states",
    )
)
def hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = fixtures.sites_cm(spark, sf_dir)
    after = sites.select((F.col("site") - 1).alias("site"), F.col("pos").alias("next_pos"))
    steps = coordinates.cm_steps(sites).join(sites.select("site", "pos"), "site").join(after, "site", "left")
    steps = steps.select("site", "step", F.coalesce(F.col("next_pos") - F.col("pos"), F.lit(1500)).alias("bp"))
    scored = psmc.scores(steps, DEMO, STATES, MU)
    return scored.select("site", "state", *[(F.round(c, 9 if c == "hom" else 5) + F.lit(0.0)).alias(c) for c in ("trans", "stay", "hom", "het")])


INPUT = "SELECT l_orderkey, count(*) AS m, sum(l_quantity) * 0.001::DOUBLE AS cm, sum(l_quantity) * 1000::DOUBLE AS bp FROM lineitem GROUP BY l_orderkey"
_Q = "(exp(-({x})) * list_sum(list_transform(range(0, {n}), lambda k: pow({x}, k) / factorial(CAST(k AS INT)))))"


def _dating_sql(rate: str, m: str, weight: str, many: str) -> str:
    mass = lambda n: f"({_Q.format(x='r * t', n=n)} - CASE WHEN next_t IS NULL THEN 0 ELSE {_Q.format(x='r * coalesce(next_t, 0)', n=n)} END)"
    return sql(
        f"""SELECT l_orderkey, round({many}, 3) AS age FROM (
SELECT l_orderkey, any_value(m) AS m, any_value(cm) AS cm, any_value(bp) AS bp, sum(prior * (mm + 2) / pow(r, 3) * {mass('mm + 3')}) / sum(prior / pow(r, 2) * {mass('mm + 2')}) AS age FROM (
  SELECT *, {m} AS mm, 1 / ne + {rate} AS r, (1 / ne) * exp(t / ne - std) * pow({weight} / (1 / ne + {rate}), {m}) AS prior FROM ({INPUT}) s, epochs) GROUP BY l_orderkey)""",
        "epochs",
    )


@query(_dating_sql(f"(0.02 * cm + 2 * {MU}::DOUBLE * bp)", "least(m, 15)", f"(2 * {MU}::DOUBLE * bp)", f"CASE WHEN m > 15 THEN (m + 2) / (1 / {DEMO.expected_time}::DOUBLE + 0.02 * cm + 2 * {MU}::DOUBLE * bp) ELSE age END"))
def segment_dating_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("l_orderkey", F.round(ages.date_segment(F.col("m"), F.col("cm"), F.col("bp"), MU, DEMO), 3).alias("age"))


@query(_dating_sql("(0.02 * cm)", "0", "1.0::DOUBLE", "age"))
def segment_dating_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("l_orderkey", F.round(ages.date_segment_sparse(F.col("cm"), DEMO), 3).alias("age"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatches and lengths of segments, derived from line items."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("m"), F.sum("l_quantity").alias("q"))
    return rows.select("l_orderkey", "m", (F.col("q") * 0.001).alias("cm"), (F.col("q") * 1000.0).alias("bp"))
