"""Sites as a stream: rows come in order of position, late ones are refused, counts are kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "region string, site long, ac long, an long, kept boolean, n_sites long"
STATE = "last long, n_sites long"


def site_stream(stream: DataFrame) -> DataFrame:
    """From rows (region, site, alleles array) the counts of each site, whether matching keeps it, and
    how many sites its region has had. A site at or before the last one of its region is an error:
    what was computed from the order can't be taken back."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (-1, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("site")
        for site, alleles in zip(rows["site"], rows["alleles"], strict=True):
            if site <= last:
                raise ValueError(f"site {site} of region {key[0]} comes after site {last}")
            last, seen = int(site), seen + 1
            ac, an = int(sum(alleles)), len(alleles)
            out.append((key[0], last, ac, an, 1 < ac < an, seen))
        state.update((last, seen))
        yield pd.DataFrame(out, columns=["region", "site", "ac", "an", "kept", "n_sites"])

    return stream.groupBy("region").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, interval: float) -> DataFrame:
    """Sites and carriers in each stretch of genetic length, kept up to date; cm in column cm."""
    bucket = F.floor(F.col("cm") / interval).alias("stretch")
    return stream.groupBy("region", bucket).agg(F.count("*").alias("n_sites"), F.sum(F.aggregate("alleles", F.lit(0), lambda a, x: a + x)).alias("carriers"))
