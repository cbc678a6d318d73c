"""Byte-level BPE by a global shuffle of distinct words.

A block is a run of whole documents. Its pre-tokens are exploded with their positions into a
dictionary-coded relation: the distinct words of the block, and for each position the number of
its word. All words are shuffled into buckets by their hash, so that a bucket has every occurrence
of its words among the blocks: there they are made distinct, each distinct word of the whole input
is encoded once, and the ids are joined back to each block's words. The ids go to their blocks and
are joined to the positions again. Decoding joins each id with the table of token bytes, which has
as many rows as there are ranks, a fixed number, and is ordered by rank, so that a join is a place.

A word comes to its bucket once for each block that has it, however often it occurs there: no word
is hot. Buckets are as many as shuffle partitions, which are set by the input's size.

Blocks are named by a hash of what they hold, and a block is put together only from all words that
its positions count: should a repeated task ever see other rows, it fails, and nothing goes wrong
in silence.

Defined cases: null text is an empty document without ids; a null document id stays null; repeated
rows are encoded each, equal blocks too; no rows give no rows; other columns are ignored; a document
larger than a block is a block of its own.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

BLOCK_CHARS = 4_000_000
LEAST_BUCKETS = 32
TOGETHER = 2_000_000  # ids decoded at once
ENCODED = "doc_id long, ids binary"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def space_class(pattern: str) -> str:
    """The pattern for Python's regex, in which \\s would also take \\x1c to \\x1f."""
    return pattern.replace(r"\s", r"\p{White_Space}")


def word_encoder(path: str):
    """A function of one word that gives its ids as little-endian bytes."""
    import tiktoken

    # the word is one match already: its own pattern takes it whole
    encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(path), special_tokens={}).encode_ordinary
    return lambda word: np.array(encode(word), "<u4").tobytes()


def token_table(path: str):
    """The bytes of each token at the place of its rank; null where there is none."""
    import pyarrow as pa

    ranks = ranks_of(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    return pa.array(table, pa.large_binary())


def joined(values, at: np.ndarray, counts: np.ndarray):
    """values (large_binary) at the places `at`, `counts` of them put together in each row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    found = pc.take(values, pa.array(at))
    if found.null_count:
        raise ValueError("an id that the table of tokens does not have")
    # the bytes found lie one after another: longer rows are a matter of fewer offsets
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int64)[found.offset :]
    edges = np.ascontiguousarray(ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges), data]).cast(pa.binary())


def _packed(parts: list[bytes]) -> bytes:
    """Byte strings of any content in one, compressed."""
    import zstandard

    return zstandard.compress(struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts), 1)


def _unpacked(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    ends = list(accumulate(struct.unpack_from(f"<{n}I", raw, 4), initial=4 * n + 4))
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def blocks(docs: DataFrame, pattern: str, part: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, buckets: int | None = None) -> DataFrame:
    """With part "words" a row of each block and bucket with its words; with part "positions" one
    (bucket -1) of each block with the positions. Both parts cut the same scan into the same blocks
    and number a block's words by bucket, then by first occurrence; to split the texts twice takes
    less disk than to keep what one pass over them gives."""
    buckets = buckets or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_BUCKETS)

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex
        import xxhash

        find = regex.compile(space_class(pattern)).findall
        docs, texts, chars = [], [], 0

        def flush() -> pa.RecordBatch:
            found = [find(text) for text in texts]
            words = list(dict.fromkeys(chain.from_iterable(found)))
            raw = [w.encode() for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(bucket, kind="stable")
            counts = np.fromiter(map(len, found), "<u4", len(found))
            name = xxhash.xxh3_64(repr(docs).encode())
            for text in texts:
                name.update(text.encode())
            block = int(np.array(name.intdigest(), np.uint64).view(np.int64))
            if part == "words":
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                rows = [(block, b, _packed([raw[i] for i in order[edges[b] : edges[b + 1]]])) for b in range(buckets) if edges[b] < edges[b + 1]]
            else:
                number = dict(zip([words[i] for i in order], range(len(words)), strict=True)).__getitem__
                at = np.fromiter(map(number, chain.from_iterable(found)), "<u4", int(counts.sum()))
                known = np.array([x is not None for x in docs], "u1")
                head = [len(words).to_bytes(4, "little"), known.tobytes(), np.array([x or 0 for x in docs], "<i8").tobytes(), counts.tobytes()]
                # bytes of equal weight together compress best
                rows = [(block, -1, _packed([*head, np.ascontiguousarray(at.view("u1").reshape(-1, 4).T).tobytes()]))]
            kinds = (pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["block", "bucket", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if docs and chars + len(text) > block_chars:
                    yield flush()
                    docs, texts, chars = [], [], 0
                docs.append(doc)
                texts.append(text)
                chars += len(text)
        if docs:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(split), "block long, bucket int, data binary")


def encode_words(words: DataFrame, ranks: str) -> DataFrame:
    """The ids of each block's words; a bucket's group has all words of the bucket from all blocks."""

    def encode(rows):
        import pyarrow as pa

        number: dict[bytes, int] = {}  # the distinct words
        of_block = [np.fromiter((number.setdefault(w, len(number)) for w in _unpacked(x.as_py())), np.int64) for x in rows["data"]]
        one = word_encoder(ranks)
        ids = [one(w.decode()) for w in number]
        out = [_packed([ids[k] for k in at.tolist()]) for at in of_block]
        return pa.table([rows["block"], rows["bucket"], pa.array(out, pa.binary())], ["block", "bucket", "data"])

    return words.groupBy("bucket").applyInArrow(encode, "block long, bucket int, data binary")


def reassemble(positions: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids of every document, from the blocks' positions and the ids of their words."""

    def join(block):
        import pyarrow as pa

        # equal blocks bring equal rows: one of each bucket is enough, but the documents of all count
        data = {b: x for b, x in zip(block["bucket"].to_pylist(), block["data"], strict=True) if b >= 0}
        words = [w for b in sorted(data) for w in _unpacked(data[b].as_py())]
        values = pa.array(words, pa.large_binary())
        out = []
        for b, x in zip(block["bucket"].to_pylist(), block["data"], strict=True):
            if b >= 0:
                continue
            n, known, docs, counts, planes = _unpacked(x.as_py())
            if int.from_bytes(n, "little") != len(words):
                raise ValueError("a block whose words are not those of its positions: its rows came otherwise when they were read again")
            at = np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(4, -1).T).view("<u4").ravel()
            doc_ids = pa.array(np.frombuffer(docs, "<i8"), mask=np.frombuffer(known, "u1") == 0)
            out.append(pa.table([doc_ids, joined(values, at, np.frombuffer(counts, "<u4"))], ["doc_id", "ids"]))
        return pa.concat_tables(out)

    return positions.unionByName(ids).groupBy("block").applyInArrow(join, ENCODED)


def encode(docs: DataFrame, ranks: str, pattern: str, **options) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every document."""
    return reassemble(blocks(docs, pattern, "positions", **options), encode_words(blocks(docs, pattern, "words", **options), ranks))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds the decoded bytes by joining each id to the table of token bytes."""

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = token_table(ranks)
        for batch in batches:
            raw = [x.as_py() for x in batch.column(1)]
            # rows of about TOGETHER ids at a time, a longer one alone
            ends = np.cumsum([len(x) // 4 for x in raw])
            cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), len(raw)]
            for first, last in zip(cuts, cuts[1:]):
                if first < last:
                    some = raw[first:last]
                    decoded = joined(table, np.frombuffer(b"".join(some), "<u4"), np.fromiter((len(x) // 4 for x in some), np.int64, len(some)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns), decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(join), f"{ENCODED}, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded bytes."""
    decoded = decode(encode(docs, ranks, pattern), ranks)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
