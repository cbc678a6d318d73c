"""A hidden Markov model of coalescence times along a pair of haplotypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .demography import Demography

STATES = 64
HAPS, HETS = 100, 10  # the haplotypes whose segments are split, when they have more mismatches


def times(demography: Demography, n: int = STATES) -> np.ndarray:
    """Expected time of each of n equally likely states."""
    return np.array([demography.to_generations(float(-np.log(1 - (i - 0.5) / n))) for i in range(1, n + 1)])


def state_times(spark: SparkSession, demography: Demography, n: int = STATES) -> DataFrame:
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("state"))
    return rows.withColumn("t", demography.generations(-F.log(1 - (F.col("state") - 0.5) / n)))


def scores(steps: DataFrame, demography: Demography, n: int, mutation_rate: float) -> DataFrame:
    """site, state and the log scores trans, stay, hom, het; steps: site, step (cM), bp."""
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("state"), F.lit(float(t)).alias("t")) for k, t in enumerate(times(demography, n))]))
    rows = steps.withColumn("s", each)
    l, m = 0.02 * F.col("step") * F.col("s.t"), 2.0 * mutation_rate * F.col("bp") * F.col("s.t")  # noqa: E741
    trans = F.log1p(-F.exp(-l)) - float(np.log(n))
    return rows.select("site", F.col("s.state").alias("state"), trans.alias("trans"), F.log(F.exp(-l) + F.exp(trans)).alias("stay"), (-m).alias("hom"), F.log1p(-F.exp(-m)).alias("het"))


def breakpoints(observed: np.ndarray, cm_steps: np.ndarray, bp_sizes: np.ndarray, demography: Demography, mutation_rate: float, n: int = STATES) -> list[int]:
    """Where the most likely path of states changes; the first entry is 0."""
    t = times(demography, n)
    l, m = 0.02 * cm_steps[:, None] * t, 2.0 * mutation_rate * bp_sizes[:, None] * t  # noqa: E741
    with np.errstate(divide="ignore"):
        trans, hom, het = np.log1p(-np.exp(-l)) - np.log(n), -m, np.log1p(-np.exp(-m))
    stay = np.log(np.exp(-l) + np.exp(trans))
    emit = np.where(np.asarray(observed, bool)[:, None], het, hom)
    score, back = emit[0], np.zeros((len(emit), n), np.int16)
    own = np.arange(n)
    for j in range(1, len(emit)):
        # switching pays what the state that is left pays; ties go to the first state
        leave = score + trans[j]
        best = int(leave.argmax())
        back[j] = best
        value = np.full(n, leave[best])
        remain = score + stay[j]
        better = (remain > value) | ((remain == value) & (own < best))
        # staying always costs less than leaving for oneself, so the best state keeps itself
        back[j][better] = own[better]
        value = np.where(better, remain, value)
        score = value + emit[j]
    state = int(score.argmax())
    path = [state]
    for j in range(len(emit) - 1, 0, -1):
        state = int(back[j][state])
        path.append(state)
    path.reverse()
    return [0] + [j for j in range(1, len(path)) if path[j] != path[j - 1]]


def split(paths: DataFrame, mismatches: DataFrame, steps: DataFrame, demography: Demography, mutation_rate: float, n: int = STATES) -> DataFrame:
    """hap, site, target of paths, where a segment of one of the first `HAPS` haplotypes with more
    than `HETS` mismatches is cut at its breakpoints; steps: site, step (cM), bp of all sites.

    The last segment ends at the last site, whose mismatch counts for it but is not observed.
    """
    last = steps.agg(F.max("site")).first()[0]
    w = Window.partitionBy("hap").orderBy("site")
    spans = paths.where((F.col("hap") > 0) & (F.col("hap") < HAPS)).select("hap", "target", F.col("site").alias("low"), F.coalesce(F.lead("site").over(w), F.lit(last)).alias("high"))
    marked = mismatches.select("hap", "site", F.lit(1).alias("het"))
    inside = (F.col("site") >= F.col("low")) & ((F.col("site") < F.col("high")) | (F.col("high") == last) & (F.col("site") == last))
    long = spans.join(marked, "hap").where(inside).groupBy("hap", "target", "low", "high").agg(F.count("*").alias("hets")).where(F.col("hets") > HETS).where("high > low")
    seen = long.select("hap", "target", "low", F.explode(F.sequence("low", F.col("high") - 1)).alias("site"))
    seen = seen.join(marked, ["hap", "site"], "left").join(F.broadcast(steps.select("site", "step", "bp")), "site").select("hap", "target", "low", "site", F.coalesce("het", F.lit(0)).alias("het"), "step", "bp")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("site", ignore_index=True)
        found = breakpoints(frame["het"].to_numpy(), frame["step"].to_numpy(float), frame["bp"].to_numpy(float), demography, mutation_rate, n)
        # the first is where the segment starts already
        return pd.DataFrame({"hap": frame["hap"].iloc[0], "site": frame["site"].iloc[found[1:]].to_numpy(), "target": frame["target"].iloc[0]})

    kinds = {f.name: f.dataType.simpleString() for f in paths.schema}
    cut = seen.groupBy("hap", "low").applyInPandas(one, f"hap {kinds['hap']}, site {kinds['site']}, target {kinds['target']}")
    return paths.select("hap", "site", "target").unionByName(cut)


def break_points_of(observations: DataFrame, demography: Demography, mutation_rate: float, n: int = STATES) -> DataFrame:
    """hap, site: breakpoints of each haplotype; observations: hap, site, het, step, bp."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("site", ignore_index=True)
        found = breakpoints(frame["het"].to_numpy(), frame["step"].to_numpy(float), frame["bp"].to_numpy(float), demography, mutation_rate, n)
        return pd.DataFrame({"hap": frame["hap"].iloc[0], "site": frame["site"].iloc[found].to_numpy()})

    return observations.groupBy("hap").applyInPandas(one, "hap int, site int")
