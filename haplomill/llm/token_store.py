"""Token ids in binary shards under a Re-Pair grammar.

Documents are dealt to ranges of their id and encoded in order; a shard ends after `shard_ids`
ids. In a shard frequent pairs of neighbouring symbols are replaced by new symbols, all pairs of a
round at once and the more frequent one where two overlap, round by round until no pair comes
`min_count` times. A shard stores the rules, how many ids each of them expands to, the documents'
lengths and the remaining symbols, so that any document or range of ids is decoded without the
rest; so the query reads it. A manifest names the shards that finished; files of lost tasks are
never read.

File: the magic bytes, then unsigned 32-bit counts (documents, rules, symbols, ids of the alphabet,
bytes per symbol), then arrays: id known (u8), document ids (i64), ids per document (u32), the ids
that symbols below the first rule stand for (u32), left and right parts of rules (u16 or u32), ids
per rule (u32), symbols (u16 or u32). All little-endian.

Defined cases: null text is an empty document of one id, the end; null ids come first; rows with
one id are kept in the order of their texts' crc32, then of their texts; of equally frequent pairs
that overlap the first, the third and so on are replaced, from the left; no rows make no shards and
give no rows; other columns are ignored. A document longer than a shard stays whole in a shard of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, read_file, table, tidy, word_encoder, write_file

MAGIC = b"RPAIR002"
END_ID = 2
SHARD_IDS = 1_000_000
MIN_COUNT = 8
SLOTS = 1 << 18
WORDS = 800_000  # kept by a worker from task to task
MANIFEST = "partition int, shard int, path string, n_docs long, n_ids long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(14)).astype(np.int64)


def _places(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of the ascending places of frequent pairs are replaced: none beside another. Of a run of
    neighbours with one count every other one stands; of two that touch the more frequent one."""
    out = np.ones(len(at), bool)
    first = np.flatnonzero(at[1:] - at[:-1] == 1)  # the left ones of all places that touch
    if not len(first):
        return out
    left, right = count[first], count[first + 1]
    run = first[left == right]
    if len(run):
        order = np.arange(len(run))
        begins = np.append(True, run[1:] != run[:-1] + 1)
        out[run[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0] + 1] = False
    clash = out[first] & out[first + 1]
    loses = np.where(left < right, first, first + 1)[clash]
    out[loses] = False
    return out


class Rules(NamedTuple):
    """A grammar: symbols below len(alphabet) stand for ids, the others for pairs of symbols."""

    symbols: np.ndarray
    alphabet: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> Rules:
    """Replaces all pairs that come min_count times, round by round, until there are none.

    After a round only a pair with a new symbol, or one that had to stand back, can be frequent:
    a round counts those places alone. Pairs are sifted by slots of a hash; of two that share one
    the more frequent has it, the other waits for the next round."""
    present = np.bincount(ids) > 0 if len(ids) else np.zeros(0, bool)
    alphabet = np.flatnonzero(present).astype(np.uint32)
    symbols = (np.cumsum(present) - 1).astype(np.uint32)[ids]
    left, right, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], np.ones(len(alphabet), np.int64)
    at = np.arange(max(len(symbols) - 1, 0))
    while len(at):
        slot = _slots(symbols[at], symbols[at + 1])
        often = np.bincount(slot, minlength=SLOTS)[slot] >= min_count
        at, slot = at[often], slot[often]
        pairs = (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1]
        found, count = np.unique(pairs, return_counts=True)
        found, count = found[count >= min_count], count[count >= min_count]
        if not len(found):
            break
        a, b = (found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32)
        by_slot, waits = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, bool)
        rank, of = np.argsort(count, kind="stable"), _slots(a, b)
        by_slot[of[rank]] = rank  # the last one written is the most frequent
        waits[of[by_slot[of] != np.arange(len(found))]] = True
        rule = by_slot[slot]
        hit = found[rule] == pairs
        where, rule = at[hit], rule[hit]
        take = _places(where, count[rule])
        used = np.bincount(rule[take], minlength=len(found)) >= 2
        take &= used[rule]
        if not take.any():
            break
        number = (np.cumsum(used) - 1 + len(lengths)).astype(np.uint32)
        a, b = a[used], b[used]
        left.append(a)
        right.append(b)
        lengths = np.append(lengths, lengths[a] + lengths[b])
        symbols[where[take]] = number[rule[take]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[where[take] + 1] = False
        moved = np.cumsum(keep, dtype=np.int32) - np.int32(1)
        symbols = symbols[keep]
        again = np.zeros(len(symbols) + 1, dtype=bool)
        rest = np.concatenate([where[~take], at[~hit][waits[slot[~hit]]]])
        again[moved[rest[keep[rest]]]] = True
        new = moved[where[take]]
        again[new] = again[new - 1] = True  # before the first stands the last, which is dropped
        at = np.flatnonzero(again[: max(len(symbols) - 1, 0)])
    return Rules(symbols, alphabet, np.concatenate(left), np.concatenate(right), lengths[len(alphabet) :].astype(np.uint32))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `length` of them."""
    ends = lengths.cumsum()
    return np.arange(int(ends[-1]) if len(ends) else 0) + (starts - ends + lengths).repeat(lengths)


class Grammar:
    """Expansions of a shard's symbols."""

    def __init__(self, rules: Rules) -> None:
        symbols, alphabet, left, right, lengths = rules
        first_new = len(alphabet)
        self.symbols, self.alphabet = symbols, alphabet
        self.lengths = np.asarray(lengths, np.int64)
        self.offsets = np.r_[0, np.cumsum(self.lengths)]
        self.flat = np.empty(int(self.offsets[-1]), np.uint32)
        depth = self._depths(left, right, first_new)
        for d in range(1, int(depth.max(initial=0)) + 1):  # rules of parts that are expanded already
            some = np.flatnonzero(depth == d)
            at = self.offsets[some]
            for part in (left[some], right[some]):
                old = part < first_new
                self.flat[at[old]] = alphabet[part[old]]
                inner = part[~old].astype(np.int64) - first_new
                self.flat[_spread(at[~old], self.lengths[inner])] = self.flat[_spread(self.offsets[inner], self.lengths[inner])]
                size = np.ones(len(part), np.int64)
                size[~old] = self.lengths[inner]
                at = at + size
        # every symbol is a stretch of one array: an id of the alphabet, or what a rule expands to
        new = symbols >= first_new
        rule = np.where(new, symbols.astype(np.int64) - first_new, 0)
        self.spans = np.where(new, self.lengths[rule] if len(left) else 1, 1)
        self.places = np.where(new, first_new + self.offsets[rule], symbols)
        self.flat = np.concatenate([alphabet, self.flat])
        self.ends = np.cumsum(self.spans)

    @staticmethod
    def _depths(left: np.ndarray, right: np.ndarray, first_new: int) -> np.ndarray:
        """1 for a rule of two ids, else one more than its deeper part."""
        depth = np.zeros(len(left), np.int64)
        parts = [np.where(x >= first_new, x.astype(np.int64) - first_new, -1) for x in (left, right)]
        while True:
            new = 1 + np.maximum(*(np.where(p >= 0, depth[p], 0) for p in parts)) if len(left) else depth
            if (new == depth).all():
                return depth
            depth = new

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop, by expanding only the symbols that hold them."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = self.ends.searchsorted((start, stop - 1), side="right").tolist()
        spans = self.spans[a : b + 1]
        before = int(self.ends[a] - spans[0])
        return self.flat[_spread(self.places[a : b + 1], spans)[start - before : stop - before]]


def shard_bytes(doc_ids: list[int | None], n_tokens: list[int], ids: np.ndarray) -> list[bytes]:
    """A shard's file."""
    rules = compress(ids)
    width = 2 if len(rules.alphabet) + len(rules.left) <= 1 << 16 else 4
    head = struct.pack("<5I", len(doc_ids), len(rules.left), len(rules.symbols), len(rules.alphabet), width)
    arrays = [
        np.array([x is not None for x in doc_ids], "u1"), np.array([x or 0 for x in doc_ids], "<i8"), np.array(n_tokens, "<u4"), rules.alphabet.astype("<u4"),
        rules.left.astype(f"<u{width}"), rules.right.astype(f"<u{width}"), rules.lengths.astype("<u4"), rules.symbols.astype(f"<u{width}"),
    ]
    return [MAGIC, head, *(x.tobytes() for x in arrays)]


class Shard:
    """A shard read back: documents, and ids of any document or range."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, rules, n_symbols, n_alphabet, width = struct.unpack_from("<5I", data, 8)
        at = 28
        arrays = []
        for kind, n in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", n_alphabet), (f"<u{width}", rules), (f"<u{width}", rules), ("<u4", rules), (f"<u{width}", n_symbols)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        if at != len(data):
            raise ValueError(f"a shard of {len(data)} bytes should have {at}")
        known, ids, self.n_tokens, alphabet, left, right, lengths, symbols = arrays
        self.doc_ids = [x if k else None for x, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.starts = np.cumsum(self.n_tokens, dtype=np.int64) - self.n_tokens
        self.grammar = Grammar(Rules(symbols, alphabet, left, right, lengths))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, decoded without the others."""
        return self.grammar.ids(int(self.starts[k]), int(self.starts[k]) + int(self.n_tokens[k]))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards and returns the manifest, with each shard's place among all ids."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        encoder, end = word_encoder(tokenizer, limit=WORDS, keep=WORDS, chunk=4_000_000), end_id.to_bytes(4, "little")
        docs, lengths, held, n, made = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            path = write_file(folder, f"shard-{partition:06d}-{made:06d}", shard_bytes(docs, lengths, ids))
            row = (partition, made, path, len(docs), len(ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["partition", "shard", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(x.as_py() for x in batch.column(1)), strict=True):
                ids += end
                if docs and n + len(ids) // 4 > shard_ids:
                    yield flush()
                    docs, lengths, held, n, made = [], [], [], 0, made + 1
                docs.append(doc)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += len(ids) // 4
        if docs:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("check", F.crc32(F.col("text").cast("binary")))  # so that rows of one id are split, too
    ordered = rows.repartitionByRange("doc_id", "check").sortWithinPartitions("doc_id", "check", "text").select("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    # the running sum over partitions takes a row of each; within one, over its shards
    totals = manifest.groupBy("partition").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("partition", (F.sum("ids").over(Window.orderBy("partition")) - F.col("ids")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("partition").orderBy("shard")) - F.col("n_ids")
    return manifest.join(before, "partition").withColumn("start", F.col("base") + within).drop("base")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: id, place among all ids, number of ids, and their crc32."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_file(path))
                crcs = [zlib.crc32(shard.ids(k)) for k in range(len(shard.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts + base), pa.array(shard.n_tokens.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    tasks = 4 * max(spark.sparkContext.defaultParallelism, 1)
    return manifest.select("path", "start").repartition(tasks).mapInArrow(tidy(read), RECORDS)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_shards(write_shards(docs, new_folder(spark, "shards"), public_tokenizers.path("word_bpe_49k.json")))
