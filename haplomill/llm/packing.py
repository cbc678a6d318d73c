"""Packing of documents into sequences by a swap-based local search.

Documents become pieces of at most `capacity` ids. Pieces are dealt by a hash to groups of about
`group_pieces`. A group starts with its pieces in bins as they come (next fit); all the rest is local
search: the emptiest underfull bin gives documents to others, by moving one, or where none fits by
exchanging one for one, or else two for one, always what gains most in the sum of squared fills,
until it is empty or nothing gains; then the next one, until no bin gives anything or the
ids left fill all bins but one. What lies in underfull bins of all groups is dealt anew to fewer
groups, whole bins at a time, and the search goes on there, as long as it empties bins; so a group
costs no bin of its own, and no round makes anything worse.

Defined cases: a document of a size that another one has, too, may take its place (ties go to the
bin of smallest number); null text is an empty document (one piece, the end id only); a null id stays null;
repeated rows are packed each; no rows give no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidy, word_encoder

CAPACITY = 2048
GROUP_PIECES = 16_384
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin int, offset long, fill long"


def next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes in order of arrival, each closed by the first document that it can't take."""
    bins: list[list[int]] = []
    left = 0
    for i, n in enumerate(lengths):
        if n > left:
            bins.append([])
            left = capacity
        bins[-1].append(i)
        left -= n
    return bins


class Search:
    """The local search over the underfull bins of one arrangement.

    Bins are indexed by the gap that they have left, and for each gap the sizes of the documents in
    its bins are a set of bits: the document that must come back for a bin to be filled best is the
    lowest bit from a place on, so that a step looks at gaps, not at bins or documents. Gaps are
    tried from the widest on, which bound what narrower ones can gain.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.held: list[dict[int, list[int]]] = []  # of each bin: size -> its documents
        for members in bins:
            own: dict[int, list[int]] = {}
            for i in members:
                own.setdefault(lengths[i], []).append(i)
            self.held.append(own)
        self.fill = [sum(lengths[i] for i in members) for members in bins]
        self.with_size: dict[int, dict[int, set[int]]] = {}  # gap -> size -> bins
        self.sizes: dict[int, int] = {}  # gap -> bits of those sizes
        self.gaps: list[int] = []  # ascending
        self.moves = {"move": 0, "one for one": 0, "two for one": 0}
        for b in range(len(bins)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if not gap or not self.held[b]:
            return
        if gap not in self.with_size:
            self.with_size[gap], self.sizes[gap] = {}, 0
            insort(self.gaps, gap)
        bins = self.with_size[gap]
        for size in self.held[b]:
            bins.setdefault(size, set()).add(b)
            self.sizes[gap] |= 1 << size

    def _leave(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        bins = self.with_size[gap]
        for size in self.held[b]:
            bins[size].discard(b)
            if not bins[size]:
                del bins[size]
                self.sizes[gap] &= ~(1 << size)
        if not bins:
            del self.with_size[gap], self.sizes[gap]
            self.gaps.remove(gap)

    def _best(self, own: dict[int, list[int]], fill: int) -> tuple[tuple[int, ...], int, int] | None:
        """(sizes given, gap of the bin that takes them, size that comes back or 0): the move with the
        largest gain in the sum of squared fills, half of which is d * (new fill of the taker - fill);
        where nothing fits, the best exchange for one, else of two for one."""
        best, found = 0, None
        for size in own:
            at = bisect_left(self.gaps, size)
            if at < len(self.gaps):  # the narrowest gap that takes it ends fullest
                gain = size * (self.capacity - self.gaps[at] + size - fill)
                if gain > best:
                    best, found = gain, ((size,), self.gaps[at], 0)
        if found:
            return found
        mine = list(own)
        one = {size: (size,) for size in mine}
        return self._exchange(one, fill) or self._exchange({x + y: (x, y) for k, x in enumerate(mine) for y in mine[k if len(own[x]) > 1 else k + 1 :]}, fill)

    def _exchange(self, given: dict[int, tuple[int, ...]], fill: int) -> tuple[tuple[int, ...], int, int] | None:
        capacity, gaps, sizes = self.capacity, self.gaps, self.sizes
        best, found, room = 0, None, capacity - fill
        for total, parts in given.items():
            for gap in reversed(gaps):
                if gap * room <= best:
                    break
                low = total - gap if total > gap else 1
                rest = sizes[gap] >> low
                if rest:
                    back = low + (rest & -rest).bit_length() - 1
                    d = total - back
                    if d > 0 and (gain := d * (capacity - gap + d - fill)) > best:
                        best, found = gain, (parts, gap, back)
        return found

    def empty(self, donor: int) -> bool:
        """Gives documents of one bin to others, the largest gain first; whether any went."""
        own, ever = self.held[donor], False
        if not own or self.fill[donor] == self.capacity:
            return False
        self._leave(donor)
        while own and (step := self._best(own, self.fill[donor])):
            parts, gap, back = step
            bins = self.with_size[gap]
            taker = min(bins[back] if back else next(iter(bins.values())))
            self._leave(taker)
            taken = self.held[taker]
            for size in parts:
                self._pass(own, taken, size)
            if back:
                self._pass(taken, own, back)
            d = sum(parts) - back
            self.fill[donor] -= d
            self.fill[taker] += d
            self._enter(taker)
            self.moves["move" if not back else "one for one" if len(parts) == 1 else "two for one"] += 1
            ever = True
        self._enter(donor)
        return ever

    @staticmethod
    def _pass(source: dict[int, list[int]], to: dict[int, list[int]], size: int) -> None:
        to.setdefault(size, []).append(source[size].pop())
        if not source[size]:
            del source[size]

    def run(self) -> Search:
        """Until no bin gives anything, or no bin can be saved as the rest fills all but one."""
        open_bins = [b for b, own in enumerate(self.held) if own and self.fill[b] < self.capacity]
        needed = -(-sum(self.fill[b] for b in open_bins) // self.capacity)
        left, moved = len(open_bins), True
        while moved and left > needed:
            moved = False
            open_bins = sorted((b for b in open_bins if self.held[b]), key=lambda b: (self.fill[b], b))
            for donor in open_bins:
                if left <= needed:
                    break
                moved |= self.empty(donor)
                left -= not self.held[donor]
        return self

    def bins(self) -> list[list[int]]:
        return [[i for some in own.values() for i in some] for own in self.held if own]


def pack(lengths: list[int], capacity: int = CAPACITY, start: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of indexes into lengths, each of at most `capacity`; start: an arrangement to begin with."""
    return Search(next_fit(lengths, capacity) if start is None else start, lengths, capacity).run().bins()


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        encoder, end = word_encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(x.as_py() for x in batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), xxhash.xxh3_64_intdigest(f"{doc} {piece}") >> 1)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(pieces), PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Gives each piece its sequence and its place there."""

    def packed(key, rows):
        import pyarrow as pa

        # in a first round all pieces come in the order of a hash, later ones bin by bin
        rows = rows.sort_by([(c, "ascending") for c in ("deal", "doc_id", "piece", "ids_crc32", "length")])
        lengths, came = rows["length"].to_pylist(), rows["bin"].to_pylist()
        start = None
        if came and came[0] is not None:
            by_bin: dict[tuple, list[int]] = {}
            for i, at in enumerate(zip(rows["old"].to_pylist(), came, strict=True)):
                by_bin.setdefault(at, []).append(i)
            start = list(by_bin.values())
        place = np.empty((3, len(lengths)), dtype=np.int64)
        for b, members in enumerate(pack(lengths, capacity, start)):
            at = 0
            for i in members:
                place[:2, i] = b, at
                at += lengths[i]
            place[2, members] = at
        new = {"grp": pa.array(np.full(len(lengths), key[0].as_py()), pa.int64()), "bin": pa.array(place[0], pa.int32()), "offset": pa.array(place[1]), "fill": pa.array(place[2])}
        return pa.table({**{c: rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, **new})

    done, k, before = [], 0, None
    pending = pieces.select(*PIECE, "deal", F.lit(None).cast("long").alias("old"), F.lit(None).cast("int").alias("bin"))
    while True:
        groups = max(1, -(-pending.count() // group_pieces))
        # a number of the round above the group: sequences of different rounds differ
        grouped = pending.withColumn("grp", F.lit(k << 24) + F.pmod(F.hash("deal", F.lit(k)), F.lit(groups)).cast("long"))
        result = materialize(grouped.groupBy("grp").applyInArrow(packed, PACKED), "packed")
        rest = result.where(F.col("fill") < capacity)
        bins = rest.where("offset = 0").count()
        if groups == 1 or bins == before:
            done.append(result)
            break
        done.append(result.where(F.col("fill") == capacity))
        # whole bins go on, and are dealt together
        pending, before, k = rest.select(*PIECE, F.xxhash64("grp", "bin").alias("deal"), F.col("grp").alias("old"), "bin"), bins, k + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*PIECE, F.shiftleft("grp", 32).bitwiseOR(F.col("bin").cast("long")).alias("sequence_id"), "offset")


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    return pack_pieces(materialize(cut(docs, tokenizer, capacity=capacity), "pieces"), capacity, **options)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
