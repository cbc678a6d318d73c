"""Codes of vectors: parts, a codebook for each part position, and Lloyd rounds with bounds.

Components become whole numbers, so that sums, distances and ties are exact. A vector's row keeps for
each of its parts the entry assigned, an upper bound of its distance from it and one lower bound of
its distance from any other. After entries have moved, the bounds move by as much, and only a part
whose upper bound is not strictly below the lower one is looked at: its own distance first, then all
entries, the smallest index of equal ones. Bounds are whole multiples of 1 / `GRAIN`, rounded outwards.

Each round reads the rows of the round before and writes them anew in the shared folder; sums of
parts by entry are added in each task, then by Spark, and at most `PARTS * ENTRIES` of them reach the
driver. Errors are summed over labels in two steps, as one label may hold most rows.

Defined cases: rows with a null vector, a null or non-finite component, no components, or another
number of components than the first kept row by id take no part; a length that is no multiple of
`PARTS` is filled up with zeros; null ids come last, rows of one id by their components; with fewer
rows than entries there are as many entries as rows; no rows give no rows. Components beyond +-2^19
are an error, as squared distances would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mark, materialize, settle, table, tidy

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LARGEST = 1 << 27
GRAIN = 1 << 10
SALTS = 64
STATE = "vec_id long, label string, v binary, code binary, upper binary, lower binary"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v: the rows that take part, their components as whole numbers."""
    kept = rows.where("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> coalesce(NOT isnan(x) AND abs(x) < double('Infinity'), false))")
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.expr(f"transform(embedding, x -> floor(cast(x AS double) * {SCALE}))").alias("v"))
    first = kept.agg(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "v")).alias("n")).first()["n"]
    fits = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))
    return kept.where(F.size("v") == F.lit(first if first is not None else 0)).withColumn("v", checked)


def first_entries(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, in order: a row each."""
    first = vectors.select("v", "vec_id").orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(entries).collect()
    return np.array([r["v"] for r in first], np.int64) if first else np.zeros((0, 0), np.int64)


def split(v: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x components, filled up with zeros."""
    width = -(-v.shape[1] // parts)
    return np.pad(v, ((0, 0), (0, parts * width - v.shape[1]))).reshape(len(v), parts, width)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x from each entry of a book, as whole numbers."""
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - book[None, :, k]) ** 2
    return out


def above(squared: np.ndarray) -> np.ndarray:
    return (np.ceil(np.sqrt(squared.astype(np.float64)) * GRAIN) + 1).astype(np.int64)


def below(squared: np.ndarray) -> np.ndarray:
    return (np.floor(np.sqrt(squared.astype(np.float64)) * GRAIN) - 1).astype(np.int64)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of parts that are compared with all entries."""
    d = distances(x, book)
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = above(d[rows, code])
    if len(book) > 1:
        d[rows, code] = np.iinfo(np.int64).max
        return code, upper, below(d.min(axis=1))
    return code, upper, np.full(len(x), np.iinfo(np.int64).max // 2)


def reassign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, moved: np.ndarray) -> int:
    """Brings entries and bounds of one part position up to date in place; the number of full scans."""
    farthest = int(moved.argmax())
    others = np.where(code == farthest, np.delete(moved, farthest).max(initial=0), moved[farthest])
    upper += moved[code]
    lower -= others
    open_ = np.flatnonzero(upper >= lower)
    own = ((x[open_] - book[code[open_]]) ** 2).sum(axis=1)
    upper[open_] = above(own)
    open_ = open_[upper[open_] >= lower[open_]]
    for k in range(0, len(open_), 4096):
        at = open_[k : k + 4096]
        code[at], upper[at], lower[at] = scan(x[at], book)
    return len(open_)


def _array(frame: pd.Series, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(frame), kind).reshape(len(frame), *shape)


def _bytes(a: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in a]


def assigned(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Every part compared with all entries. books: parts x entries x components."""
    parts = len(books)

    @tidy
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            v = np.array(frame["v"].tolist(), np.int64)
            x = split(v, parts)
            code, upper, lower = np.empty(x.shape[:2], np.uint16), np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
            for p in range(parts):
                for k in range(0, len(x), 4096):
                    rows = slice(k, k + 4096)
                    code[rows, p], upper[rows, p], lower[rows, p] = scan(x[rows, p], books[p])
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "v": _bytes(x.astype(np.int32)), "code": _bytes(code), "upper": _bytes(upper), "lower": _bytes(lower)})

    return _whole_ids(vectors).mapInPandas(task, STATE)


def _whole_ids(df: DataFrame) -> DataFrame:
    """Ids as texts on their way to Python, where whole numbers beside nulls would become floats."""
    return df.withColumn("vec_id", F.col("vec_id").cast("string"))


def _read(frame: pd.DataFrame, parts: int) -> tuple[np.ndarray, ...]:
    x = _array(frame["v"], np.int32, parts, -1).astype(np.int64)
    return x, *(_array(frame[c], kind, parts).astype(np.int64) for c, kind in (("code", np.uint16), ("upper", np.int64), ("lower", np.int64)))


def improved(state: DataFrame, books: np.ndarray, before: np.ndarray) -> DataFrame:
    """The rows with entries and bounds for the books, of those for the books before."""
    parts = len(books)
    moved = np.array([above(((a - b) ** 2).sum(axis=1)) * (a != b).any(axis=1) for a, b in zip(books, before, strict=True)])

    @tidy
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, code, upper, lower = _read(frame, parts)
            for p in range(parts):
                c, u, lo = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                reassign(x[:, p], c, u, lo, books[p], moved[p])
                code[:, p], upper[:, p], lower[:, p] = c, u, lo
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "v": frame["v"], "code": _bytes(code.astype(np.uint16)), "upper": _bytes(upper), "lower": _bytes(lower)})

    return _whole_ids(state).mapInPandas(task, STATE)


def means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books with each entry replaced by the rounded-down mean of its parts; unused ones stay."""
    parts, entries, width = books.shape

    @tidy
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for frame in frames:
            if not len(frame):
                continue
            x, code = _read(frame, parts)[:2]
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pd.DataFrame({"part": p, "entry": e, "n": count[p, e], "total": total[p, e].tolist()})

    found = state.mapInPandas(sums, "part int, entry int, n long, total array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)])
    out = books.copy()
    for r in added.collect():  # a row an entry at most
        out[r["part"], r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(width)]
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256. rows: vec_id,
    embedding, label. The books are read off `vector_codes_and_books`."""
    return vector_codes_and_books(rows, parts, entries, rounds)[0]


def vector_codes_and_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The coded rows, and the books: parts x entries x components."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    since = mark()
    vectors = materialize(whole_vectors(rows), "vectors")
    first = first_entries(vectors, entries)
    books = split(first, parts).transpose(1, 0, 2).copy() if len(first) else np.zeros((parts, 0, 1), np.int64)
    if not len(first):
        empty = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return _with_totals(empty, books), books
    state = settle(assigned(vectors, books), "codes", since)
    for _ in range(rounds):
        before, books = books, means(state, books)
        state = settle(improved(state, books, before), "codes", since)

    @tidy
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, code = _read(frame, parts)[:2]
            error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "code": [r.tobytes().hex() for r in code.astype(np.uint8)], "error": error})

    coded = _whole_ids(state).mapInPandas(task, "vec_id long, label string, code string, error long")
    return _with_totals(coded, books), books


def _with_totals(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Errors summed over labels go back to the rows by label and salt, so that no label is one task."""
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))
    rows = coded.withColumns({"_key": key, "_salt": salt})
    totals = rows.groupBy("_key").agg(F.sum("error").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(totals, ["_key", "_salt"]).select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def _op13_sql() -> str:
    """Every part against every entry, in three assignments and two means."""
    out = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, CAST(p AS INT) AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) r(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM parts JOIN first USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        out.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, min(d).d AS d, min(d).entry AS entry FROM
  (SELECT vec_id, label, p.part, x, {{'d': CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'entry': entry}} AS d FROM parts p JOIN b{k} b ON b.part = p.part) GROUP BY ALL)"""
        )
        if k < ROUNDS:
            mean = f"SELECT part, entry, list(m ORDER BY k) AS c FROM (SELECT part, entry, k, CAST(floor_div(sum(x[k]), count(*)) AS BIGINT) AS m FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS k) GROUP BY part, entry, k) GROUP BY part, entry"
            mean = mean.replace("floor_div(sum(x[k]), count(*))", "(sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*)) // count(*)")
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN ({mean}) m ON m.part = b.part AND m.entry = b.entry)")
    out.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)")
    out.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, sha"


OP13_SQL = _op13_sql()
