"""As-of and interval joins as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covering(left: DataFrame, at: str, right: DataFrame, start: str, end: str, by: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Joins each left row to the right rows with start <= at < end; a null end is open. Intervals
    are posted in every bin that they touch, the bins as wide as a mean interval, so that the join
    is an equi-join on (by, bin) whose size follows the inputs."""
    is_open = F.col(end).isNull() & F.col(start).isNotNull()
    closed, n, n_open, open_starts, most = right.agg(F.sum(F.col(end) - F.col(start)), F.count(start), F.count_if(is_open), F.sum(F.when(is_open, F.col(start))), F.max(start)).first()
    last = left.agg(F.max(at)).first()[0]
    # open intervals count up to the last point: were they left out, a table of them alone would get bins of length 1
    reach = max([float(x) for x in (last, most) if x is not None], default=0.0)
    total = float(closed or 0) + n_open * reach - float(open_starts or 0)
    width = total / n if total > 0 else 1.0
    number = lambda c: F.floor(c / F.lit(width))
    # an open end reaches just past the last point
    beyond = F.lit(reach + width)
    posted = right.withColumn("_end", F.coalesce(F.col(end).cast("double"), beyond))
    posted = posted.withColumn("_bin", F.explode(F.sequence(number(F.col(start)), number(F.col("_end")))))
    points = left.withColumn("_bin", number(F.col(at)))
    on = (F.col("l._bin") == F.col("r._bin")) & (F.col(f"r.{start}") <= F.col(f"l.{at}")) & (F.col(f"l.{at}") < F.col("r._end"))
    for c in by:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    columns = [F.col(f"r.{c}") for c in right.columns if c not in by]
    return points.alias("l").join(posted.alias("r"), on, how).select(*[F.col(f"l.{c}") for c in left.columns], *columns)
