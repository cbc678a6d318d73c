"""Removal of byte strings that occur earlier, by a column-wise Burrows-Wheeler transform.

Every string of `LENGTH` bytes has an anchor, the `GRAM`-byte piece in it with the smallest hash
(the leftmost of equal ones), so that equal strings have equal anchors at equal distances. The texts
are cut into stretches of neighbouring strings with one anchor. Only anchors that come twice matter;
of equal stretches the earliest stands for all, as whatever else they are is a repeat of it.

The stretches left are the documents of a collection whose symbols bear their distance from the
anchor, so that only equal distances ever meet. Its Burrows-Wheeler transform is built column by
column from the right: each round inserts one symbol of every stretch, sorts the suffixes by it
(they are in order by all that follows), and derives common prefixes from those of the round before,
as minima over the suffixes in between. Rounds are written one after the other to a file in the
shared folder; a second, sequential reading of it gives for each column the classes of suffixes that
share `LENGTH` bytes, of which all but the earliest are removed.

Anchors are dealt to tasks by hash, some `BUCKET` stretches each. One with more than `HOT` different
stretches (a passage with ever other surroundings) is taken apart: its single strings are their own
anchors, whose stretches are equal or apart, and go the same way. Texts equal as a whole go first.

Order is that of doc_id, then of start. Defined cases: null and empty texts have no bytes; null ids
come last; rows that share an id come in the order in which they were read; matches never cross rows;
no rows give no rows; other columns are ignored. Hashes decide only what is compared; whole texts and
stretches are told apart by digests of 256 and 128 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mark, materialize, new_folder, open_fs, table, tidy

LENGTH = 100
GRAM = 32
BUCKET = 4_000
HOT = 1 << 16  # 11 MB of symbols, which a task holds
BLOCK = 1 << 18  # bytes hashed at once
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
NO_ID = 2**63 - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each piece of `gram` bytes, from those of pieces half as long."""
    part, size, out, have = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    while size <= gram:
        if gram & size:
            if out is None:
                out, have = part, size
            else:  # part is left of what there is
                n = len(x) - have - size + 1
                out = part[:n] * np.uint64(pow(BASE, have, 2**64)) + out[size : size + n]
                have += size
        if 2 * size <= gram:
            part = part[:-size] * np.uint64(pow(BASE, size, 2**64)) + part[size:]
        size *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(MIX)
    return out ^ (out >> np.uint64(32))


def anchors(x: np.ndarray, gram: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of pieces, place of the anchor of the string that starts at each place)."""
    h = gram_hashes(x, gram)
    bits = np.uint64((1 << 20) - 1)
    least, width, whole = (h & ~bits) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while 2 * width <= whole:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < whole:
        least = np.minimum(least[: len(least) - (whole - width)], least[whole - width :])
    return h, (least & bits).astype(np.int64)


def stretches_of(bodies: list[bytes], gram: int, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, hash of the anchor, digest of the stretch, anchor, strings before the anchor, strings) of
    the stretches of many texts. A stretch is as long as two strings at most: its first and its last one
    and their distance tell it from others with its anchor."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    for low in range(0, len(raw) - length + 1, BLOCK):
        x = raw[low : low + BLOCK + length - 1]
        h, at = anchors(x, gram, length)
        start = np.arange(low, low + len(at))
        row = np.searchsorted(ends, start, side="right")
        inside = start + length <= ends[np.minimum(row, len(ends) - 1)]
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        of, whole = row[first], h if gram == length else gram_hashes(x, length)
        s = (whole[first] * np.uint64(BASE) ^ whole[last]) * np.uint64(MIX) + (last - first).astype(np.uint64)
        yield of, h[at[first]].astype(np.int64), (s ^ (s >> np.uint64(31))).astype(np.int64), low + at[first] - begin[of], at[first] - first, last - first + 1


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose texts have about four blocks of bytes together, a longer text alone."""
    for frame in frames:
        bounds = np.cumsum(frame["body"].map(len).to_numpy(np.int64)) // (4 * BLOCK)
        for _, part in frame.groupby(bounds, sort=True):
            yield part


def postings(store: DataFrame, gram: int) -> DataFrame:
    """v, s, d, m, at, place: the stretches of all texts by the hash of their anchor, equal ones with
    equal s. place holds the anchor's position in the document, the strings before it, and their number."""

    @tidy
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames):
            d, m, at = (frame[c].to_numpy(np.int64) for c in ("d", "m", "at"))
            for row, v, s, anchor, before, n in stretches_of(frame["body"].tolist(), gram):
                yield pd.DataFrame({"v": v, "s": s, "d": d[row], "m": m[row], "at": at[row], "place": (at[row] + anchor) << 16 | before << 8 | n})

    return store.select("d", "m", "at", "body").mapInPandas(task, "v long, s long, d long, m long, at long, place long")


def cut_out(store: DataFrame, kept: DataFrame) -> DataFrame:
    """v, d, m, place, piece: the bytes of the stretches kept (v, m, at, place)."""
    listed = kept.groupBy("m", "at").agg(F.collect_list(F.struct("v", "place")).alias("s"))
    rows = store.join(listed, ["m", "at"]).select("d", "m", "at", "body", F.col("s.v").alias("vs"), F.col("s.place").alias("places"))

    @tidy
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c) for c in batch.schema.names}
            bodies = column["body"].to_pylist()
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            ends = np.cumsum([len(b) for b in bodies])
            v, place = (column[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vs", "places"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(column["vs"].offsets.to_numpy()))
            d, m, at = (column[c].to_numpy(zero_copy_only=False).astype(np.int64)[row] for c in ("d", "m", "at"))
            low = np.concatenate([[0], ends[:-1]])[row] + (place >> 16) - (place >> 8 & 255) - at
            length = (place & 255) + LENGTH - 1
            for k in range(0, len(v), 1 << 14):
                some = slice(k, k + (1 << 14))
                ends_here = np.cumsum(length[some])
                # the places of all bytes of these stretches, one after the other
                inner = np.arange(ends_here[-1]) - np.repeat(ends_here - length[some], length[some])
                data = raw[np.repeat(low[some], length[some]) + inner]
                offsets = np.concatenate([[0], ends_here]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*map(pa.array, (v[some], d[some], m[some], place[some])), binary], names=["v", "d", "m", "place", "piece"])

    return rows.mapInArrow(task, "v long, d long, m long, place long, piece binary")


def least_table(values: np.ndarray) -> np.ndarray:
    """Minima over stretches of 1, 2, 4, ... values from each place on, a row a length."""
    n = len(values)
    out = np.empty((max(1, n.bit_length()), n), values.dtype)
    out[0] = values
    for k in range(1, len(out)):
        half = 1 << (k - 1)
        out[k] = out[k - 1]
        np.minimum(out[k - 1, : n - half], out[k - 1, half:], out=out[k, : n - half])
    return out


def columns(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, transform, suffix order, column of the first difference from the suffix above) of each
    round, from the last column on. symbols: columns x documents."""
    width, n = symbols.shape
    order, differ = np.arange(n, dtype=np.int32), np.full(n, width, np.uint8)
    log = np.zeros(n + 2, np.int8)
    for k in range(1, n.bit_length() + 1):
        log[1 << k :] = k
    for c in range(width - 1, -1, -1):
        seen = symbols[c][order]
        moved = np.argsort(seen, kind="stable")
        inserted = seen[moved]
        after = np.full(n, c, np.uint8)
        same = np.flatnonzero(inserted[1:] == inserted[:-1])
        low, high = moved[same] + 1, moved[same + 1]
        level = log[high - low + 1]
        least = least_table(differ)
        after[same + 1] = np.minimum(least[level, low], least[level, high - (1 << level.astype(np.int64)) + 1])
        order, differ = order[moved], after
        yield c, inserted, order, differ


def collection(places: np.ndarray, pieces: list[bytes], gram: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols by column and stretch, first column of each stretch's strings, number of strings)."""
    anchor_column = length - gram
    before, n = places >> 8 & 255, places & 255
    first = anchor_column - before
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    inner = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols = np.zeros((anchor_column + length, len(pieces)), np.uint8)
    symbols[inner + np.repeat(first, sizes), np.repeat(np.arange(len(pieces)), sizes)] = raw
    return symbols, first, n


def repeated_strings(symbols: np.ndarray, first: np.ndarray, n: np.ndarray, rank: np.ndarray, folder: str, length: int = LENGTH) -> np.ndarray:
    """columns x documents: whether the string that starts there starts earlier elsewhere, too. The
    rounds go through a file of the folder, written and read front to back."""
    size, starts = symbols.shape[1], symbols.shape[0] - length + 1
    fs, path = open_fs(f"{folder}/rounds-{uuid.uuid4().hex}")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    out = np.zeros((starts, size), bool)
    try:
        with fs.open_output_stream(path) as stream:
            for c, inserted, order, differ in columns(symbols):
                stream.write(inserted.tobytes() + differ.tobytes() + (order.tobytes() if c < starts else b""))
        with fs.open_input_stream(path) as stream:
            for c in range(len(symbols) - 1, -1, -1):
                differ = np.frombuffer(stream.read(2 * size), np.uint8)[size:]
                if c >= starts:
                    continue
                order = np.frombuffer(stream.read(4 * size), np.int32)
                group = np.cumsum(differ < c + length)
                whole = (first[order] <= c) & (c < first[order] + n[order])  # strings that start here
                mine, group = order[whole], group[whole]
                if not len(mine):
                    continue
                at = np.flatnonzero(np.diff(group, prepend=-1))
                earliest = np.repeat(np.minimum.reduceat(rank[mine], at), np.diff(at, append=len(mine)))
                out[c, mine] = rank[mine] != earliest
    finally:
        try:
            fs.delete_file(path)
        except OSError:
            pass
    return out


def compared(stretches: DataFrame, buckets: int, gram: int, folder: str) -> DataFrame:
    """m, low, high: what is to go of the earliest of equal stretches (v, d, m, place, piece)."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        place = frame["place"].to_numpy(np.int64)
        symbols, first, n = collection(place, frame["piece"].tolist(), gram)
        rank = np.empty(len(frame), np.int64)
        rank[np.lexsort((place >> 16, frame["m"], frame["d"]))] = np.arange(len(frame))
        gone = repeated_strings(symbols, first, n, rank, folder)
        edge = np.diff(np.pad(gone, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        origin = (place >> 16) - (LENGTH - gram)
        return pd.DataFrame({"m": frame["m"].to_numpy(np.int64)[row], "low": origin[row] + low, "high": origin[row] + high - 1 + LENGTH})

    dealt = stretches.select("v", "d", "m", "place", "piece", F.pmod(F.xxhash64("v"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(task, "m long, low long, high long")


def covered(store: DataFrame, gram: int, folder: str, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """m, low, high: bytes of the texts (d, m, at, body) under strings that start earlier, too."""
    since = mark()
    found = postings(store, gram)  # made anew for each use: cheaper than to keep them
    twice = materialize(found.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"), "repeats-twice")
    every = materialize(found.join(twice, "v", "left_semi"), "repeats-stretches")
    discard(since, "repeats-twice")
    head = every.groupBy("v", "s").agg(F.min(F.struct("d", "m", "place", "at")).alias("h"), F.count("*").alias("copies"))
    distinct = materialize(head.select("v", "s", "h.*", "copies"), "repeats-distinct")
    # whatever equals an earlier stretch goes as a whole
    first = distinct.where("copies > 1").select("v", "s", F.col("m").alias("m0"), F.col("place").alias("place0"))
    later = every.select("v", "s", "m", "place").join(first, ["v", "s"]).where("m <> m0 OR place <> place0")
    low = F.shiftright("place", 16) - (F.shiftright("place", 8).bitwiseAND(255))
    out = materialize(later.select("m", low.alias("low"), (low + F.col("place").bitwiseAND(255) + LENGTH - 1).alias("high")), "repeats-later")
    crowded = materialize(distinct.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("v"), "repeats-crowded")
    discard(since, "repeats-stretches")
    rest = distinct
    if gram < LENGTH and not crowded.isEmpty():
        rest = distinct.join(crowded, "v", "left_anti")
        apart = cut_out(store, distinct.join(crowded, "v", "left_semi")).select("d", "m", low.alias("at"), F.col("piece").alias("body"))
        out = out.unionByName(covered(materialize(apart, "repeats-apart"), LENGTH, folder, hot, bucket))
    buckets = max(1, -(-distinct.count() // bucket))
    return out.unionByName(materialize(compared(cut_out(store, rest), buckets, gram, folder), "repeats-compared"))


def _shortened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stays of texts once the stretches listed are gone."""
    for frame in frames:
        rows = []
        for m, body, lows, highs in frame.itertuples(index=False):
            removed, spans, kept, at, end = 0, 0, [], 0, -1
            for low, high in sorted(zip(lows.tolist(), highs.tolist(), strict=True)):
                if low > end:
                    kept.append(body[at:low])
                    spans, removed, end = spans + 1, removed + high - low, high
                elif high > end:
                    removed, end = removed + high - end, high
                at = end
            kept.append(body[at:])
            rows.append((m, removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pd.DataFrame(rows, columns=["m", "removed", "spans", "kept"])


def without_repeats(docs: DataFrame, gram: int = GRAM, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    spark, since = docs.sparkSession, mark()
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    order = F.coalesce("doc_id", F.lit(NO_ID)).alias("d")
    whole = materialize(rows.select(F.monotonically_increasing_id().alias("m"), order, "doc_id", "body", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("digest")), "repeats-texts")
    first = whole.where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min(F.struct("d", "m")).alias("f")).select(F.col("f.m").alias("m"))
    first = materialize(first, "repeats-first")
    store = materialize(whole.join(first, "m", "left_semi").select("d", "m", F.lit(0).cast("long").alias("at"), "body"), "repeats-store")
    ids = materialize(whole.select("m", "doc_id", "n_bytes", "digest").join(first.withColumn("single", F.lit(True)), "m", "left"), "repeats-ids")
    discard(since, "repeats-texts", "repeats-first")
    gone = covered(store, gram, new_folder(spark, "repeats-rounds"), hot, bucket)
    discard(since, "repeats-distinct", "repeats-crowded", "repeats-apart")
    listed = gone.groupBy("m").agg(F.collect_list(F.struct("low", "high")).alias("s")).select("m", F.col("s.low").alias("lows"), F.col("s.high").alias("highs"))
    cut = store.select("m", "body").join(listed, "m").mapInPandas(tidy(_shortened), "m long, removed long, spans long, kept string")
    copy = F.col("single").isNull() & (F.col("n_bytes") >= LENGTH)
    pick = lambda of_copy, found, other: F.when(copy, of_copy).otherwise(F.coalesce(found, other))
    return ids.join(cut, "m", "left").select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(EMPTY), F.col("kept"), F.col("digest")).alias("kept_sha256"),
    )


def op11_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
