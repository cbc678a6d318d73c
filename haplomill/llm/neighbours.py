"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every norm is a band of its own with its own scale: vectors and queries are hashed at length 1, so
that the chance to meet depends on their angle alone, whatever other lengths the table holds, and
all bands share the probes of a query. The nearest of one norm in Euclidean distance has the largest
inner product; across norms a long vector may win at a wide angle, so the `LONGEST` vectors among
those that exceed the median length by `LONGER` are compared with every query exactly; where all are
of one length there are none. A table hashes a vector by some random projections, each cut into
cells of `WIDTH`; the more rows, the more projections, so that buckets stay small. A query visits its
own bucket and those that moving some projections by a cell reaches, in the order of their estimated
success: the sum of squared distances to the cell borders crossed. All rows are in every table;
candidates of all tables are reranked by exact inner products. Only a table of no more
than `k` rows is compared as a whole; queries that meet no more than `k` rows in any group of buckets
are compared with all rows.

How many buckets a query visits is measured, not guessed: `SAMPLE` queries, drawn by a hash of their
id, are compared with all rows, and the fewest probes that bring `RECALL` of their true neighbours
are used for all queries. Where `MOST_PROBES` don't, the tables get fewer projections, and
where the fewest don't, hashing tells nothing apart and all rows are compared. The more rows
there are, the nearer the neighbours and the smaller the share of the rows that so many probes visit.
Isotropic vectors have no near neighbours to speak of (the 20th is hardly nearer than the 200th):
with these about half of 51,000 rows are visited, fewer with structure.

Buckets of a table are dealt to groups of about `GROUP_ROWS` rows; a group with more than twice as
many is cut into blocks by a hash of the row, each of which meets all queries of the group. A task
takes a block and the queries that probe it, multiplies bucket by bucket with the queries that visit
it and keeps the best `k` of each query, which loses nothing: the best of all groups are among the
best of each. The first table is searched alone; the k-th best score that is known then bounds what
tasks of the other tables give out, so that their output follows the queries, not queries x groups.

Defined cases: vectors that are null, empty, zero, of another length than most or with null or
non-finite components take no part, as query or as candidate; ties go to the smaller id; rows that
repeat id and vector count once; of an id with several vectors all are candidates and the smallest
is the query; a null id takes no part;
with fewer candidates than k all are returned; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, tidy

K = 20
QUERY_EVERY = 20
TABLES = 8
WIDTH = 2.4
LEAST_FUNCTIONS, MOST_FUNCTIONS = 4, 24
SAMPLE = 128
RECALL = 0.95
MOST_PROBES = 1024
BLOCK = 2048  # rows multiplied at once
GROUP_ROWS = 16_384
QUERY_ROWS = 4_096  # queries of a task that compares exactly
TOGETHER = 128  # queries multiplied at once
HELD = 200_000  # scores that a task holds before it keeps the best
LONGEST, LONGER = 2_048, 1.01
SEED = 77
FOUND = "query_id long, vec_id long, score double"


class Hashes:
    """The projections of all tables, the same wherever they are made."""

    def __init__(self, dimensions: int, tables: int = TABLES, functions: int = 12, width: float = WIDTH) -> None:
        draw = np.random.default_rng(SEED)
        self.tables, self.functions = tables, functions
        self.directions = draw.standard_normal((dimensions, tables * functions))
        self.cell = width
        self.shift = draw.uniform(0, self.cell, tables * functions)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Place along each projection in cells, one row of tables x functions for each vector."""
        return ((vectors @ self.directions + self.shift) / self.cell).reshape(len(vectors), self.tables, self.functions)


def bucket_numbers(cells: np.ndarray) -> np.ndarray:
    """A 64-bit number of each row of cells."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    for k in range(cells.shape[-1]):
        out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


@functools.cache
def patterns(functions: int, n: int = 2 * MOST_PROBES) -> np.ndarray:
    """The n sets of moves that are cheapest on average, none first. A set is a row over the places of
    the 2 x functions moves in ascending order of distance; the move at place r and the one as far
    from the end are the two of one function, of which a set has at most one."""
    m = functions
    r = np.arange(1, 2 * m + 1)
    mirrored = 2 * m + 1 - r
    # expected squared distances of sorted places that are uniform in a cell
    cost = np.where(r <= m, r * (r + 1) / (4 * (m + 1) * (m + 2)), 1 - mirrored / (m + 1) + mirrored * (mirrored + 1) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:  # sets grow by shifting or adding the last move
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        if not any(2 * m - 1 - x in chosen for x in chosen):
            out.append(chosen)
    rows = np.zeros((len(out), 2 * m), np.int8)
    for k, chosen in enumerate(out):
        rows[k, list(chosen)] = 1
    return rows


def probes(places: np.ndarray, n: int) -> np.ndarray:
    """For each row of places the n sets of cells most likely to hold near vectors, the own one first:
    the sets of `patterns` in ascending order of the squared distances that this row crosses."""
    m = places.shape[-1]
    sets = patterns(m)
    cell = np.floor(places)
    part = places - cell
    near = np.minimum(part, 1 - part)
    order = np.argsort(near, axis=1, kind="stable")
    ranked = np.take_along_axis(near, order, axis=1)
    squares = np.concatenate([ranked**2, ((1 - ranked) ** 2)[:, ::-1]], axis=1)
    first = np.argsort(squares @ sets.T.astype(float), axis=1, kind="stable")[:, :n]
    # +1: over the near border, -1: over the far one, of the functions in order of distance
    signed = sets[:, :m] - sets[:, m:][:, ::-1]
    moves = np.take_along_axis(signed[first], np.argsort(order, axis=1)[:, None, :], axis=2)
    return cell[:, None, :] + moves * np.where(part <= 0.5, -1, 1)[:, None, :]


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length 1; squares of the largest and smallest numbers stay in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (of floats or doubles, as they come) of the rows that take part."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col) if single else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def fitted(data: DataFrame, queries: DataFrame, k: int, hashes: Hashes, recall: float, sample: int) -> int | None:
    """The fewest probes that bring `recall` of the true neighbours of some queries; None if
    MOST_PROBES don't. At most sample x k vectors come to the driver."""
    some = materialize(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample), "sample")
    truth = ranked(scan_all(data, some, k), k).select("query_id", "vec_id")
    pairs = truth.join(data.select("vec_id", "v"), "vec_id").join(some.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    pairs = pairs.dropDuplicates(["query_id", "vec_id"]).toPandas()
    if not len(pairs):
        return 1
    place = np.full(len(pairs), MOST_PROBES)
    own = bucket_numbers(np.floor(hashes.places(unit(matrix(pairs["v"])))))
    for _, at in pairs.reset_index(drop=True).groupby("query_id").indices.items():
        q = hashes.places(unit(matrix(pairs["q"].iloc[at[:1]])))[0]
        visited = bucket_numbers(probes(q, MOST_PROBES))  # tables x probes
        same = visited[None, :, :] == own[at][:, :, None]
        place[at] = np.where(same.any(axis=2), same.argmax(axis=2), MOST_PROBES).min(axis=1)
    needed = int(np.sort(place)[int(np.ceil(recall * len(place))) - 1]) + 1
    return needed if needed <= MOST_PROBES else None


def nearest(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, width: float = WIDTH, n_probes: int | None = None, longest: int = LONGEST, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id query_every divides."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = int(lengths["d"])
    rows = rows.where(F.size("v") == d)
    kind = rows.schema["v"].dataType.simpleString()

    def hashed(query: bool, functions: int, groups: int, some_tables: range):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            hashes = Hashes(d, tables, functions, width)
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(at, TOGETHER)
                    x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    places = hashes.places(unit(x))
                    for t in some_tables:
                        if query:  # a row for each query and group, with the buckets to visit there
                            buckets = bucket_numbers(probes(places[:, t], n_probes))
                            place = np.arange(len(x))[:, None] * groups + group_of(buckets, groups)
                            order = np.argsort(place, axis=None, kind="stable")
                            place, first = np.unique(place.ravel()[order], return_index=True)
                            take = place // groups
                            lists = pa.ListArray.from_arrays(pa.array(np.append(first, buckets.size).astype(np.int32)), pa.array(buckets.ravel()[order]))
                            yield pa.RecordBatch.from_arrays([pa.array(t * groups + place % groups), some.column(0).take(pa.array(take)), lists], ["grp", "vec_id", "keys"])
                        else:
                            buckets = bucket_numbers(np.floor(places[:, t]))
                            yield pa.RecordBatch.from_arrays([pa.array(t * groups + group_of(buckets, groups)), some.column(0), pa.array(buckets), some.column(1)], ["grp", "vec_id", "key", "v"])

        return run

    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # written with the rows: a sort would compute it for each comparison
    data = materialize(rows.dropDuplicates(["vec_id", "v"]).withColumn("norm2", norm2), "vectors")
    queries = materialize(data.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n = data.count()
    if n <= k:
        return ranked(scan_all(data, queries, k), k)
    middle = data.agg(F.percentile_approx("norm2", 0.5)).first()[0]
    head = data.where(F.col("norm2") > middle * LONGER**2).orderBy(F.desc("norm2"), "vec_id", "v").limit(longest)
    found = scan_all(materialize(head.select("vec_id", "v"), "longest"), queries, k)
    functions = functions_for(n)
    while n_probes is None:
        n_probes = fitted(data, queries, k, Hashes(d, tables, functions, width), recall, sample)
        if n_probes is None:
            if functions <= LEAST_FUNCTIONS:  # nothing to tell the rows apart by
                return ranked(scan_all(data, queries, k), k)
            functions = max(functions - 2, LEAST_FUNCTIONS)
    groups = -(-n // GROUP_ROWS)
    index = data.select("vec_id", "v").mapInArrow(tidy(hashed(False, functions, groups, range(tables))), f"grp long, vec_id long, key long, v {kind}")
    index, markers = materialize(index, "index"), []
    # what the first table finds bounds what any later one may add: few rows pass from task to task
    for first, last in ((0, 1), (1, tables)):
        if first < last:
            visits = spread(queries, spark).mapInArrow(tidy(hashed(True, functions, groups, range(first, last))), "grp long, vec_id long, keys array<long>")
            part = index.where((F.col("grp") >= first * groups) & (F.col("grp") < last * groups))
            near, enough = search(part, visits, bounded(queries, found, k), k)
            found, markers = materialize(found.unionByName(near).distinct(), "found"), [*markers, enough]
    short = materialize(queries.join(functools.reduce(DataFrame.unionByName, markers), "vec_id", "left_anti"), "short")
    if short.count():
        found = found.unionByName(scan_all(data, short, k))
    return ranked(found, k)


def group_of(buckets: np.ndarray, groups: int) -> np.ndarray:
    return ((buckets.view(np.uint64) >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)


def bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Adds the score of the k-th best that is known, which a better one must reach."""
    least = ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    return materialize(queries.join(least, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))), "bounded")


def functions_for(n: int) -> int:
    """Projections of a table of n rows: buckets hold some tens of rows."""
    return min(max(int(np.log2(n)) - 5, LEAST_FUNCTIONS), MOST_FUNCTIONS)


def spread(queries: DataFrame, spark: SparkSession) -> DataFrame:
    """The few queries over all cores: each makes many probes."""
    return queries.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; what was found on several ways counts once."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best rows of each of some queries, ties to the smaller id. Matrix products, which may
    differ in the last bits for equal vectors, only sift; the sums that decide do not."""

    def __init__(self, asked: np.ndarray, x: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bound: np.ndarray | None = None) -> None:
        self.asked, self.x, self.ids, self.vectors, self.k = asked, x, ids, vectors, k
        with np.errstate(over="ignore"):
            longest = np.sqrt((vectors * vectors).sum(axis=1).max(initial=0))
            self.slack = 1e-12 * np.sqrt((x * x).sum(axis=1)) * longest
        self.bound = np.full(len(x), -np.inf) if bound is None else bound - self.slack
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, which: np.ndarray, first: int, last: int) -> None:
        """Some queries meet the rows from first to last."""
        scores = self.x[which] @ self.vectors[first:last].T
        other = self.asked[which][:, None] != self.ids[None, first:last]
        q, r = np.nonzero(other & (scores >= self.bound[which][:, None]))
        self.parts.append((which[q], first + r))
        self.held += len(q)
        if self.held > HELD + 2 * self.k * len(self.x):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, np.int64) for i in (0, 1))
        exact = np.empty(len(q))
        for at in range(0, len(q), HELD):
            some = slice(at, at + HELD)
            exact[some] = (self.vectors[r[some]] * self.x[q[some]]).sum(axis=1)
        order = np.lexsort((self.ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], exact[last] - self.slack[q[last]])
        kept = place < self.k
        q, r, exact = q[kept], r[kept], exact[kept]
        self.parts, self.held = [(q, r)], len(q)
        return q, r, exact

    def rows(self) -> pd.DataFrame:
        q, r, exact = self.settle()
        return pd.DataFrame({"query_id": self.asked[q], "vec_id": self.ids[r], "score": exact})


NONE_FOUND = {"query_id": "int64", "vec_id": "int64", "score": "float64"}


def search(index: DataFrame, visits: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best candidates that reach the bounds, of the buckets that each query probes; and the
    queries that meet more than k rows in some group. index: grp, vec_id, key, v; visits: grp, vec_id,
    keys; queries: vec_id, v, bound."""
    blocks = index.groupBy("grp").agg(F.ceil(F.count("*") / (2 * GROUP_ROWS)).alias("blocks"))
    blocks = materialize(blocks, "blocks")
    rows = index.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), "blocks")).select("grp", "block", "key", "vec_id", "v")
    visits = visits.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    visits = visits.select("grp", "block", F.col("vec_id").alias("query_id"), "keys").join(queries.select(F.col("vec_id").alias("query_id"), "v", "bound"), "query_id")

    def scan(rows: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(visits):
            return pd.DataFrame(columns=[*NONE_FOUND, "marks"]).astype({**NONE_FOUND, "marks": "bool"})
        rows = rows.sort_values("key", kind="stable")
        keys, starts = np.unique(rows["key"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(rows))
        queries = visits["query_id"].to_numpy()
        best = Best(queries, matrix(visits["v"]), rows["vec_id"].to_numpy(), matrix(rows["v"]), k, visits["bound"].to_numpy())
        # which queries visit each bucket
        asked = np.repeat(np.arange(len(visits)), visits["keys"].str.len().to_numpy())
        probed = np.concatenate(visits["keys"].to_numpy())
        order = np.argsort(probed, kind="stable")
        asked, probed = asked[order], probed[order]
        low, high = np.searchsorted(probed, keys), np.searchsorted(probed, keys, side="right")
        met = np.zeros(len(visits), np.int64)
        for b in np.flatnonzero(low < high).tolist():
            met[asked[low[b] : high[b]]] += ends[b] - starts[b]
            for at in range(low[b], high[b], 16 * TOGETHER):
                for first in range(starts[b], ends[b], BLOCK):
                    best.add(asked[at : min(at + 16 * TOGETHER, high[b])], first, min(first + BLOCK, ends[b]))
        # beside what is found, the queries that met more than k
        return pd.concat([best.rows().assign(marks=False), pd.DataFrame({"query_id": queries[met > k], "vec_id": -1, "score": 0.0, "marks": True})])

    found = rows.groupBy("grp", "block").cogroup(visits.groupBy("grp", "block")).applyInPandas(scan, f"{FOUND}, marks boolean")
    found = materialize(found, "near")
    return found.where("NOT marks").drop("marks"), found.where("marks").select(F.col("query_id").alias("vec_id")).distinct()


def scan_all(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of all rows for each query, by blocks of rows and of queries: query_id, vec_id, score."""
    some, many = (max(1, -(-x.count() // n)) for x, n in ((rows, GROUP_ROWS), (queries, QUERY_ROWS)))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select(place(some).alias("a"), each(many).alias("b"), "vec_id", "v")
    queries = queries.select(each(some).alias("a"), place(many).alias("b"), F.col("vec_id").alias("query_id"), "v")

    def scan(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame(columns=list(NONE_FOUND)).astype(NONE_FOUND)
        best = Best(queries["query_id"].to_numpy(), matrix(queries["v"]), rows["vec_id"].to_numpy(), matrix(rows["v"]), k)
        for at in range(0, len(queries), TOGETHER):
            for first in range(0, len(rows), BLOCK):
                best.add(np.arange(at, min(at + TOGETHER, len(queries))), first, min(first + BLOCK, len(rows)))
        return best.rows()

    return rows.groupBy("a", "b").cogroup(queries.groupBy("a", "b")).applyInPandas(scan, FOUND)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
