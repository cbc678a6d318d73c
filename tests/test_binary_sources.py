"""Files of binary formats, written here by their published layouts and read back by the data sources."""

import struct
import zlib

import numpy as np
import pytest

from haplomill.sources import indexed, pgen, text


# -- .pgen


def packed(values, bits):
    per = 8 // bits
    out = bytearray(-(-len(values) // per))
    for k, v in enumerate(values):
        out[k // per] |= int(v) << bits * (k % per)
    return bytes(out)


def number(x):
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def exceptions(who, values, samples):
    if not len(who):
        return number(0)
    width = (samples.bit_length() + 7) // 8
    steps = [[int(b - a) for a, b in zip(who[g : g + 64], who[g + 1 : g + 64])] for g in range(0, len(who), 64)]
    coded = [b"".join(map(number, s)) for s in steps]
    first = b"".join(int(who[g]).to_bytes(width, "little") for g in range(0, len(who), 64))
    return number(len(who)) + first + bytes(len(c) - 63 & 255 for c in coded[:-1]) + packed(values, 2) + b"".join(coded)


def record(haps, last, kind, explicit=False):
    """A record's bytes and kind for haplotypes, its genotypes kept in this way."""
    g = haps.reshape(-1, 2).sum(axis=1)
    n = len(g)
    if kind == pgen.PACKED:
        raw = packed(g, 2)
    elif kind == pgen.ONE_BIT:  # 0 and 1 in bits, 2 as exceptions
        odd = np.flatnonzero(g == 2)
        raw = b"\x01" + packed(g == 1, 1) + exceptions(odd, g[odd], n)
    elif kind in (pgen.FROM_LAST, pgen.FROM_LAST_TURNED):
        want = 2 - g if kind == pgen.FROM_LAST_TURNED else g
        odd = np.flatnonzero(want != last)
        raw = exceptions(odd, want[odd], n)
    else:
        odd = np.flatnonzero(g != (kind & 3))
        raw = exceptions(odd, g[odd], n)
    het = g == 1
    if het.any():
        kind |= pgen.PHASED
        phase = haps.reshape(-1, 2)[het, 0]
        raw += packed([1] * (1 + len(phase)), 1) + packed(phase, 1) if explicit else packed([0, *phase], 1)
    return raw, kind, g


def write_pgen(path, haps, kinds, length_bytes=2, wide=True):
    """haps: variants x haplotypes."""
    records, last = [], None
    for k, (row, kind) in enumerate(zip(haps, kinds, strict=True)):
        raw, whole, g = record(row, last, kind, explicit=k % 3 == 0)
        if kind not in (pgen.FROM_LAST, pgen.FROM_LAST_TURNED):
            last = g
        records.append((raw, whole))
    n, blocks = len(records), -(-len(records) // pgen.BLOCK)
    head = pgen.MAGIC + bytes([pgen.VARIABLE]) + struct.pack("<II", n, haps.shape[1] // 2) + bytes([(4 if wide else 0) | length_bytes - 1])
    tables, sizes = b"", []
    for b in range(blocks):
        part = records[b * pgen.BLOCK : (b + 1) * pgen.BLOCK]
        tables += bytes(k for _, k in part) if wide else packed([k for _, k in part], 4)
        tables += b"".join(len(r).to_bytes(length_bytes, "little") for r, _ in part)
        sizes.append(sum(len(r) for r, _ in part))
    at, firsts = len(head) + 8 * blocks + len(tables), []
    for s in sizes:
        firsts.append(at)
        at += s
    path.write_bytes(head + struct.pack(f"<{blocks}Q", *firsts) + tables + b"".join(r for r, _ in records))


@pytest.fixture(scope="module")
def haps():
    draw = np.random.default_rng(2)
    base = draw.random((60, 1)) ** 3
    out = (draw.random((60, 2 * 331)) < base).astype(np.int8)
    for k in range(1, 60, 4):  # some are like the one before, some its opposite
        out[k] = out[k - 1] ^ (draw.random(662) < 0.02)
        out[k + 1] = 1 - out[k - 1]
    out[7], out[8] = 0, 1
    return out


@pytest.fixture(scope="module")
def pgen_path(haps, tmp_path_factory):
    cycle = [pgen.PACKED, pgen.FROM_LAST, pgen.FROM_LAST_TURNED, pgen.ONE_BIT, 4, 6, pgen.FROM_LAST, pgen.ONE_BIT, 6]
    path = tmp_path_factory.mktemp("pgen") / "a.pgen"
    write_pgen(path, haps, [cycle[k % len(cycle)] for k in range(len(haps))])
    return path


def test_pgen_by_stretches(spark, haps, pgen_path):
    pgen.register(spark)
    whole = spark.read.format("pgen").option("path", str(pgen_path)).load()
    assert np.array([r["genotypes"] for r in whole.orderBy("variant").collect()]).tolist() == haps.tolist()
    # seven variants a task, some of whose first ones refer to a record of the task before
    small = spark.read.format("pgen").option("path", str(pgen_path)).option("batch", 7 * 662).option("start", 5).option("end", 41).load()
    assert small.rdd.getNumPartitions() == 6
    rows = small.orderBy("variant").collect()
    assert [r["variant"] for r in rows] == list(range(5, 41)) and np.array([r["genotypes"] for r in rows]).tolist() == haps[5:41].tolist()


def test_pgen_layouts_and_errors(spark, haps, tmp_path):
    pgen.register(spark)
    load = lambda path: spark.read.format("pgen").option("path", str(path)).load().orderBy("variant").collect()
    same = haps[:, ::2].repeat(2, axis=1)  # no heterozygous calls: kinds fit in four bits
    write_pgen(tmp_path / "n.pgen", same, [pgen.PACKED] * 60, length_bytes=3, wide=False)
    assert np.array([r["genotypes"] for r in load(tmp_path / "n.pgen")]).tolist() == same.tolist()
    g = same.reshape(60, -1, 2).sum(axis=2)
    (tmp_path / "f.pgen").write_bytes(pgen.MAGIC + bytes([pgen.FIXED]) + struct.pack("<II", 60, 331) + b"\x40" + b"".join(packed(x, 2) for x in g))
    assert np.array([r["genotypes"] for r in load(tmp_path / "f.pgen")]).tolist() == same.tolist()
    g[3, 5] = 1
    (tmp_path / "u.pgen").write_bytes(pgen.MAGIC + bytes([pgen.FIXED]) + struct.pack("<II", 60, 331) + b"\x40" + b"".join(packed(x, 2) for x in g))
    with pytest.raises(Exception, match="variant 3: unphased"):
        load(tmp_path / "u.pgen")
    g[3, 5] = 3
    (tmp_path / "m.pgen").write_bytes(pgen.MAGIC + bytes([pgen.FIXED]) + struct.pack("<II", 60, 331) + b"\x40" + b"".join(packed(x, 2) for x in g))
    with pytest.raises(Exception, match="missing"):
        load(tmp_path / "m.pgen")
    (tmp_path / "x.pgen").write_bytes(b"other bytes than those")
    with pytest.raises(Exception, match="no .pgen"):
        load(tmp_path / "x.pgen")


def test_reading_through_the_command_reader(spark, haps, pgen_path):
    from haplomill import cli

    stem = str(pgen_path).removesuffix(".pgen")
    with open(f"{stem}.pvar", "w") as out:
        out.write("#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"2\t{100 + 10 * k}\tv{k}\tA\tC\n" for k in range(60)))
    rows = cli.read_sites(spark, str(pgen_path), (200, 290)).orderBy("site").collect()
    assert [(r["pos"], r["chrom"], r["site"]) for r in rows] == [(100 + 10 * k, "2", k - 10) for k in range(10, 20)]
    assert [list(r["genotypes"]) for r in rows] == haps[10:20].tolist()
    assert rows[0]["af"] == pytest.approx(haps[10].mean())


# -- indexed VCF


def block(content):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


def bin_of(low, high):
    high -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if low >> shift == high >> shift:
            return first + (low >> shift)
    return 0


def write_indexed(path, lines, size):
    """Lines in blocks of `size` bytes of content, which cut lines anywhere, and the index beside it."""
    content = "".join(x + "\n" for x in lines).encode()
    places, out, at = [], b"", 0
    for k in range(0, len(content), size):
        places.append(at)
        raw = block(content[k : k + size])
        out, at = out + raw, at + len(raw)
    end = at << 16
    path.write_bytes(out + block(b""))
    virtual = lambda k: places[k // size] << 16 | k % size if k < len(content) else end
    contigs, k = {}, 0
    for x in lines:
        if not x.startswith("#"):
            chrom, pos = x.split("\t")[:2]
            bins, linear = contigs.setdefault(chrom, ({}, {}))
            low = int(pos) - 1
            chunks = bins.setdefault(bin_of(low, low + 1), [])
            here = (virtual(k), virtual(k + len(x) + 1))
            if chunks and chunks[-1][1] == here[0]:
                chunks[-1] = (chunks[-1][0], here[1])
            else:
                chunks.append(here)
            linear.setdefault(low >> 14, here[0])
        k += len(x) + 1
    names = b"".join(c.encode() + b"\0" for c in contigs)
    raw = b"TBI\x01" + struct.pack("<8i", len(contigs), 2, 1, 2, 0, 35, 0, len(names)) + names
    for bins, linear in contigs.values():
        raw += struct.pack("<i", len(bins))
        for b, chunks in bins.items():
            raw += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        n = max(linear) + 1
        filled, before = [], 0
        for w in range(n):
            before = linear.get(w, before)
            filled.append(before)
        raw += struct.pack("<i", n) + struct.pack(f"<{n}Q", *filled)
    path.with_name(path.name + ".tbi").write_bytes(block(raw) + block(b""))
    return places


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    draw = np.random.default_rng(5)
    lines = ["##fileformat=VCFv4.2", "##contig=<ID=1>", "##contig=<ID=2>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"]
    for chrom in "12":
        for pos in np.sort(draw.choice(400_000, 800, replace=False)) + 1:
            lines.append(f"{chrom}\t{pos}\tv{chrom}_{pos}\tA\tC\t.\t.\tAC=1;AN=4\tGT\t{draw.integers(2)}|{draw.integers(2)}\t0|1")
    path = tmp_path_factory.mktemp("vcf") / "a.vcf.gz"
    return path, lines, write_indexed(path, lines, 1500)


@pytest.mark.parametrize(("contig", "start", "end"), [("1", 1, 400_000), ("2", 100_000, 150_000), ("1", 16_384, 16_385), ("2", 399_000, 10**6), ("1", 10**8, 10**8 + 5), ("3", 1, 10)])
@pytest.mark.parametrize("chunk", [1 << 26, 700])
def test_regions(spark, vcf, contig, start, end, chunk):
    path, lines, _ = vcf
    indexed.register(spark)
    rows = spark.read.format("indexed_vcf").options(path=str(path), contig=contig, start=start, end=end, chunk=chunk).load()
    want = [x for x in lines if not x.startswith("#") and x.split("\t")[0] == contig and start <= int(x.split("\t")[1]) <= end]
    assert sorted(r["value"] for r in rows.collect()) == sorted(want)


def test_a_region_reads_only_its_chunks(vcf, monkeypatch):
    path, lines, places = vcf
    read = []
    whole = indexed.block_at
    monkeypatch.setattr(indexed, "block_at", lambda file, at: read.append(at) or whole(file, at))
    reader = indexed.Reader({"path": str(path), "contig": "2", "start": "200000", "end": "210000"})
    parts = reader.partitions()
    read.clear()
    found = [line for p in parts for (line,) in reader.read(p)]
    assert len(found) > 5 and len(set(read)) < len(places) / 8


def test_whole_file_and_command_reader(spark, vcf):
    from haplomill import cli

    path, lines, _ = vcf
    indexed.register(spark)
    assert spark.read.format("indexed_vcf").options(path=str(path), chunk=2000).load().count() == 1600
    rows = text.read_vcf(spark, str(path), 50_000, 90_000, contig="1")
    want = [x.split("\t") for x in lines if x.startswith("1\t") and 50_000 <= int(x.split("\t")[1]) <= 90_000]
    assert sorted(r["id"] for r in rows.collect()) == sorted(f[2] for f in want)
    assert text.read_vcf_header(spark, str(path)) == (["a", "b"], ["1", "2"])
    assert cli.read_sites(spark, str(path), (50_000, 90_000), contig="1").count() == len(want)


def test_damaged_files(tmp_path, vcf):
    path, _, _ = vcf
    (tmp_path / "x").write_bytes(b"plain text, longer than a header")
    with pytest.raises(ValueError, match="no block"):
        indexed.blocks(str(tmp_path / "x"))
    (tmp_path / "y").write_bytes(path.read_bytes()[:300])
    with pytest.raises(ValueError, match="cut short"):
        indexed.blocks(str(tmp_path / "y"))
    with pytest.raises(ValueError, match="no .tbi"):
        indexed.Index(b"something else")
