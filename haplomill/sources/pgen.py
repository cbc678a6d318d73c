"""A data source of .pgen genotypes: `spark.read.format("pgen").option("path", ...)`.

A row is a variant: its number and its haplotypes' alleles, two a sample. A task reads one stretch of
variants: the file's header gives the kind and length of each record, so that it seeks to its own
ones and, where the first of them refers to an earlier record, to that. Records are decoded with
numpy: packed genotypes, one bit a sample with exceptions, exceptions from the record before (also
turned), and exceptions from one genotype. Heterozygous calls must be phased; missing ones, several
ALT alleles and dosages are errors, as are files that are cut short.

Options: path; start and end (exclusive) of the variants wanted; batch, the alleles of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import opened

# Fixed values of the format: first bytes, how records are kept, and parts of a record's kind.
MAGIC, VARIABLE, FIXED = b"\x6c\x1b", 0x10, 0x02
BLOCK, GROUP = 1 << 16, 64
PACKED, ONE_BIT, FROM_LAST, FROM_LAST_TURNED = 0, 1, 2, 3
MULTIALLELIC, PHASED, DOSAGE = 0x08, 0x10, 0x60
BATCH = 40_000_000


@dataclass
class Header:
    variants: int
    samples: int
    kinds: np.ndarray
    starts: np.ndarray  # a place more than variants: where records begin and end


def read_header(file) -> Header:
    """Kinds and places of all records, a few bytes a variant."""
    head = file.read(12)
    if head[:2] != MAGIC:
        raise ValueError("this is no .pgen file")
    n, samples = (int.from_bytes(head[k : k + 4], "little") for k in (3, 7))
    if head[2] == FIXED:  # every record packed, at equal distances
        size = -(-samples // 4)
        return Header(n, samples, np.zeros(n, np.uint8), 12 + size * np.arange(n + 1, dtype=np.int64))
    if head[2] != VARIABLE:
        raise ValueError(f"records kept in way {head[2]} are not read")
    flags = head[11]
    wide, length_bytes, allele_bytes, nonref = flags & 4, 1 + (flags & 3), flags >> 4 & 3, flags >> 6
    blocks = -(-n // BLOCK)
    first = np.frombuffer(file.read(8 * blocks), "<u8").astype(np.int64)
    kinds, starts = np.empty(n, np.uint8), np.empty(n + 1, np.int64)
    for b in range(blocks):
        m = min(BLOCK, n - b * BLOCK)
        at = slice(b * BLOCK, b * BLOCK + m)
        raw = np.frombuffer(file.read(m if wide else -(-m // 2)), np.uint8)
        kinds[at] = raw if wide else np.stack([raw & 15, raw >> 4], axis=1).ravel()[:m]
        lengths = np.frombuffer(file.read(m * length_bytes), np.uint8).reshape(m, length_bytes).astype(np.int64) @ (256 ** np.arange(length_bytes))
        file.read(m * allele_bytes + (-(-m // 8) if nonref == 3 else 0))
        starts[at] = first[b] + np.cumsum(lengths) - lengths
        starts[b * BLOCK + m] = first[b] + lengths.sum()
    return Header(n, samples, kinds, starts)


def unpacked(raw: bytes, n: int, bits: int) -> np.ndarray:
    """n numbers of so many bits each, the lowest ones first."""
    per = 8 // bits
    a = np.frombuffer(raw, np.uint8)
    return (a[:, None] >> (bits * np.arange(per, dtype=np.uint8)) & ((1 << bits) - 1)).ravel()[:n]


class Record:
    """A cursor over one record."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a record ends too early")
        self.at += n
        return out

    def number(self) -> int:
        """Seven bits a byte, the lowest first, while the eighth is set."""
        out = shift = 0
        while True:
            (b,) = self.take(1)
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    def exceptions(self, samples: int) -> tuple[np.ndarray, np.ndarray]:
        """(samples, their genotypes): the first sample of each group of 64, the steps to the others."""
        n = self.number()
        if not n:
            return np.array([], np.int64), np.array([], np.uint8)
        width, groups = (samples.bit_length() + 7) // 8, -(-n // GROUP)
        first = np.frombuffer(self.take(groups * width), np.uint8).reshape(groups, width).astype(np.int64) @ (256 ** np.arange(width))
        self.take(groups - 1)  # lengths of groups, for readers that skip some
        values = unpacked(self.take(-(-n // 4)), n, 2)
        steps = np.array([self.number() if k % GROUP else 0 for k in range(n)], np.int64)
        total = np.cumsum(steps)
        group = np.arange(n) // GROUP
        return first[group] + total - total[group * GROUP], values


def genotypes(record: Record, kind: int, samples: int, last: np.ndarray | None) -> np.ndarray:
    """0, 1, 2 ALT alleles or 3 for none of each sample. last: those of the record referred to."""
    main = kind & 7
    if main == PACKED:
        return unpacked(record.take(-(-samples // 4)), samples, 2).copy()
    if main == ONE_BIT:
        (code,) = record.take(1)
        out = (code >> 2) + (code & 3) * unpacked(record.take(-(-samples // 8)), samples, 1)
    elif main in (FROM_LAST, FROM_LAST_TURNED):
        if last is None:
            raise ValueError("a record refers to one before the first")
        out = last.copy()
    else:
        out = np.full(samples, main & 3, np.uint8)
    who, values = record.exceptions(samples)
    out[who] = values
    if main == FROM_LAST_TURNED:
        out = np.where(out == 3, 3, 2 - out)
    return out.astype(np.uint8)


def alleles(record: Record, kind: int, g: np.ndarray) -> np.ndarray:
    """Two alleles a sample from its genotype and phase."""
    if kind & (MULTIALLELIC | DOSAGE):
        raise ValueError("several ALT alleles or dosages are not read")
    if (g == 3).any():
        raise ValueError("missing calls")
    hets = np.flatnonzero(g == 1)
    first = np.zeros(len(g), np.int8)
    if len(hets):
        if not kind & PHASED:
            raise ValueError("unphased calls")
        bits = unpacked(record.take(-(-(len(hets) + 1) // 8)), len(hets) + 1, 1)
        if bits[0]:  # some are unphased, else these bits are the phases themselves
            if not bits[1:].all():
                raise ValueError("unphased calls")
            first[hets] = unpacked(record.take(-(-len(hets) // 8)), len(hets), 1)
        else:
            first[hets] = bits[1:]
    a = np.where(g == 1, first, g // 2)
    return np.stack([a, g - a], axis=1).ravel().astype(np.int8)


def read_range(file, header: Header, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(variant, alleles) of a stretch of variants."""
    refers = np.isin(header.kinds & 7, (FROM_LAST, FROM_LAST_TURNED))
    last = None
    if low < high and refers[low]:
        base = np.flatnonzero(~refers[:low])
        if not len(base):
            raise ValueError("a record refers to one before the first")
        k = int(base[-1])
        file.seek(int(header.starts[k]))
        last = genotypes(Record(file.read(int(header.starts[k + 1] - header.starts[k]))), int(header.kinds[k]), header.samples, None)
    if low < high:
        file.seek(int(header.starts[low]))
    for k in range(low, high):
        record = Record(file.read(int(header.starts[k + 1] - header.starts[k])))
        g = genotypes(record, int(header.kinds[k]), header.samples, last)
        if not refers[k]:
            last = g
        try:
            yield k, alleles(record, int(header.kinds[k]), g)
        except ValueError as error:
            raise ValueError(f"variant {k}: {error}") from None


class Stretch(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.options = options["path"], dict(options)

    def partitions(self) -> list[Stretch]:
        with opened(self.path) as file:
            header = read_header(file)
        low, high = int(self.options.get("start", 0)), min(int(self.options.get("end", header.variants)), header.variants)
        size = max(1, int(self.options.get("batch", BATCH)) // max(2 * header.samples, 1))
        return [Stretch(k, min(k + size, high)) for k in range(low, high, size)] or [Stretch(0, 0)]

    def read(self, partition: Stretch):
        import pyarrow as pa

        with opened(self.path) as file:
            header = read_header(file)
            for low in range(partition.low, partition.high, 256):
                rows = list(read_range(file, header, low, min(low + 256, partition.high)))
                flat = np.concatenate([g for _, g in rows])
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * 2 * header.samples
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int8()))], names=["variant", "genotypes"])


class PgenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgen"

    def schema(self) -> str:
        return "variant int, genotypes array<tinyint>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PgenSource)
