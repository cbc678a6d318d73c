"""A data source of lines of an indexed block-compressed VCF: `spark.read.format("indexed_vcf")`.

The index beside the file (.tbi) lists, for bins of positions, chunks of virtual offsets: where a
compressed block starts and where in it. A region's chunks, joined where they touch and cut where
they are long, are the partitions; a task reads its chunk's blocks only and gives the lines whose
position lies in the region. Without a region the chunks of the contig or of the whole file are read.

Options: path; region ([chr][number:]start-end, or contig and start and end); chunk, the compressed
bytes of a task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import opened

# Fixed values of the formats: the index's first bytes, the smallest bins' width, the levels of bins
# and the number of a bin beyond all that holds counts; a block's longest content.
MAGIC, SMALLEST, LEVELS, COUNTS = b"TBI\x01", 14, 5, 37450
LONGEST = 1 << 16
CHUNK = 64 << 20


def block_at(file, at: int) -> tuple[bytes, int]:
    """(content, compressed size) of the block that starts here; nothing at the file's end."""
    file.seek(at)
    head = file.read(18)
    if not head:
        return b"", 0
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError(f"no block at {at}")
    extra = struct.unpack("<H", head[10:12])[0]
    fields, size, k = head[12:] + file.read(max(0, extra - 6)), None, 0
    while k + 4 <= extra:
        length = struct.unpack("<H", fields[k + 2 : k + 4])[0]
        if fields[k : k + 2] == b"BC":
            size = struct.unpack("<H", fields[k + 4 : k + 6])[0] + 1
        k += 4 + length
    if size is None:
        raise ValueError(f"the block at {at} has no size")
    file.seek(at + 12 + extra)
    body = file.read(size - 12 - extra)
    if len(body) < size - 12 - extra:
        raise ValueError(f"the block at {at} is cut short")
    return zlib.decompress(body[:-8], -15), size


def blocks(path: str) -> bytes:
    """All content of a block-compressed file, such as an index."""
    out, at = [], 0
    with opened(path) as file:
        while True:
            content, size = block_at(file, at)
            if not size:
                return b"".join(out)
            out.append(content)
            at += size


def bins_of(low: int, high: int) -> set[int]:
    """All bins that may hold positions from low to before high, counted from 0."""
    out, first = {0}, 1
    for level in range(1, LEVELS + 1):
        shift = SMALLEST + 3 * (LEVELS - level)
        out.update(range(first + (low >> shift), first + (high - 1 >> shift) + 1))
        first += 8**level
    return out


class Index:
    """Chunks by contig and bin, and the least offset for each stretch of positions."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("this is no .tbi index")
        n, _, _, _, _, self.mark, self.skipped, length = struct.unpack("<8i", raw[4:36])
        names = raw[36 : 36 + length].split(b"\0")[:n]
        at, self.contigs = 36 + length, {}
        for name in names:
            bins, (count,) = {}, struct.unpack_from("<i", raw, at)
            at += 4
            for _ in range(count):
                number, chunks = struct.unpack_from("<Ii", raw, at)
                offsets = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
                at += 8 + 16 * chunks
                if number != COUNTS:
                    bins[number] = list(zip(offsets[::2], offsets[1::2], strict=True))
            (count,) = struct.unpack_from("<i", raw, at)
            linear = struct.unpack_from(f"<{count}Q", raw, at + 4)
            at += 4 + 8 * count
            self.contigs[name.decode()] = (bins, linear)

    def chunks(self, contig: str, start: int, end: int) -> list[tuple[int, int]]:
        """Chunks of the positions from start to end, both counted from 1, without overlaps."""
        if contig not in self.contigs:
            return []
        (bins, linear), low = self.contigs[contig], max(start - 1, 0)
        least = linear[min(low >> SMALLEST, len(linear) - 1)] if linear else 0
        last = min(end, 1 << SMALLEST + 3 * LEVELS)
        found = sorted(c for b in bins_of(low, last) for c in bins.get(b, []) if c[1] > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out


def lines_of(file, low: int, high: int) -> Iterator[bytes]:
    """The lines that begin between two virtual offsets; the last one may go on beyond the end."""
    at, skip = low >> 16, low & 0xFFFF
    rest, content = b"", None
    while True:
        content, size = block_at(file, at)
        if not size:
            if rest:
                yield rest
            return
        limit = high & 0xFFFF if at == high >> 16 else (len(content) if at < high >> 16 else 0)
        begin = skip
        skip = 0
        while True:
            # a line that began before the end is read on, whatever the offset
            if not rest and begin >= limit:
                break
            stop = content.find(b"\n", begin)
            if stop < 0:
                rest += content[begin:]
                break
            yield rest + content[begin:stop]
            rest, begin = b"", stop + 1
        if not rest and at >= high >> 16:
            return
        at += size


class Part(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.contig, self.start, self.end = options.get("contig"), int(options.get("start", 1)), int(options.get("end", 2**29))

    def partitions(self) -> list[Part]:
        index = Index(blocks(f"{self.path}.tbi"))
        contigs = [self.contig] if self.contig else list(index.contigs)
        out = []
        for contig in contigs:
            for low, high in index.chunks(contig, self.start, self.end):
                out += self._cut(low, high)
        return out or [Part(0, 0)]

    def _cut(self, low: int, high: int) -> list[Part]:
        """A long chunk in parts that begin with blocks, each of which starts with a line's remainder
        that belongs to the part before."""
        if (high >> 16) - (low >> 16) <= self.chunk:
            return [Part(low, high)]
        cuts, at, next_cut = [low], low >> 16, (low >> 16) + self.chunk
        with opened(self.path) as file:
            while at < high >> 16:
                content, size = block_at(file, at)
                at += size
                if at >= next_cut and at < high >> 16:
                    # the first line that begins in the block here
                    after, skipped = block_at(file, at)[0], content[-1:] == b"\n"
                    first = 0 if skipped else after.find(b"\n") + 1
                    if skipped or first:
                        cuts.append(at << 16 | first)
                        next_cut = at + self.chunk
        return [Part(a, b) for a, b in zip(cuts, [*cuts[1:], high], strict=True)]

    def read(self, partition: Part):
        if partition.low == partition.high:
            return
        with opened(self.path) as file:
            for line in lines_of(file, partition.low, partition.high):
                if line.startswith(b"#"):
                    continue
                chrom, pos, _ = line.split(b"\t", 2)
                if (self.contig is None or chrom.decode() == self.contig) and self.start <= int(pos) <= self.end:
                    yield (line.decode(),)


class IndexedVcf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed_vcf"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexedVcf)
