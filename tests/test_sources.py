"""Readers, writers, commands and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplomill import cli
from haplomill.sources import fixtures, text, writers
from haplomill.streaming.sites import site_stream, windowed_counts


def put(path, content):
    path.write_text(content)
    return str(path)


def test_map(spark, tmp_path):
    path = put(tmp_path / "a.map", "pos\tchr\tcM\n100\t1\t0.0\n200\t1\t0.5\n")
    assert [tuple(r) for r in text.read_map(spark, path, "chr1").orderBy("pos").collect()] == [(100.0, 0.0), (200.0, 0.5)]
    with pytest.raises(ValueError):
        text.read_map(spark, path, "2")
    with pytest.raises(ValueError):
        text.read_map(spark, put(tmp_path / "b.map", "pos chr cM\n1 1 0\n2 2 0\n"))


def test_demography(spark, tmp_path):
    path = put(tmp_path / "x.demo", "0\t1000\n50 5000\n")
    assert [tuple(r) for r in text.read_demography(spark, path).orderBy("t").collect()] == [(0.0, 1000.0), (50.0, 5000.0)]


def test_variants_and_samples(spark, tmp_path):
    stem = str(tmp_path / "g")
    put(tmp_path / "g.pvar", "##x\n#CHROM\tPOS\tID\tREF\tALT\tFILTER\n1\t10\t'1:10:A:C'\tA\tC\tq10\n")
    assert tuple(text.read_variants(spark, stem).first()) == ("1", 10, "'1:10:A:C'", "A", "C", ".", "q10")
    put(tmp_path / "g.bim", "1 rs1 0 20 C A\n")
    assert tuple(text.read_variants(spark, stem).first()) == ("1", 20, "rs1", "A", "C", ".", "PASS")
    put(tmp_path / "g.psam", "#IID SEX\ntsk_0 NA\ntsk_1 NA\n")
    assert sorted(r["name"] for r in text.read_samples(spark, stem).collect()) == ["tsk_0", "tsk_1"]
    put(tmp_path / "g.fam", "f a 0 0 0 -9\n")
    assert [r["name"] for r in text.read_samples(spark, stem).collect()] == ["a"]


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n"


def test_vcf(spark, tmp_path):
    path = put(tmp_path / "a.vcf", VCF + "1\t10\tv1\tA\tC\t.\tPASS\tAC=3;AN=4\tGT\t0|1\t1|1\n1\t90\tv2\tA\tC\t.\tPASS\tAC=1;AN=4\tGT:DS\t0|1:1\t0|0:0\n")
    rows = text.read_vcf(spark, path, 5, 50).collect()
    assert [(r["pos"], r["id"], r["af"], list(r["genotypes"])) for r in rows] == [(10, "v1", 0.75, [0, 1, 1, 1])]
    bad = put(tmp_path / "b.vcf", VCF + "1\t10\tv1\tA\tC\t.\tPASS\tAC=3;AN=4\tGT\t0/1\t1|1\n")
    with pytest.raises(Exception, match="unphased"):
        text.read_vcf(spark, bad).collect()


def test_last_record_wins_at_the_first_place(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], "id string, rec int, v int")
    assert {(r["id"], r["rec"], r["v"]) for r in text.last_by_id(rows, "rec").collect()} == {("a", 0, 3), ("b", 1, 2)}


def test_calls_round_half_to_even(spark):
    rows = spark.createDataFrame([(0.5, 1.5), (0.123, 0.9), (0.0, 0.0), (1.0, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(writers.call(rows.a, rows.b)).collect()] == ["0|2:2", "0|1:1.023", "0|0:0", "1|1:2"]


def test_ancestry_tables(spark, sf, tmp_path):
    path = str(tmp_path / "arg")
    writers.write_ancestry(path, {"segments": fixtures.segments(spark, sf), "mismatches": fixtures.mismatches(spark, sf), "sites": fixtures.sites(spark, sf)})
    back = writers.read_ancestry(spark, path)
    assert back["segments"].exceptAll(fixtures.segments(spark, sf)).isEmpty()
    assert tuple(back["range"].first()) == (1000.0, 95501.0 + 63 * 63 % 97 + 0.0)
    with pytest.raises(ValueError):
        writers.write_ancestry(path, {"other": back["sites"]})


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """A VCF of 12 individuals, a map and a demography."""
    folder = tmp_path_factory.mktemp("small")
    draw = np.random.default_rng(11)
    base = draw.integers(0, 2, (4, 40))
    haps = np.array([base[draw.integers(0, 4)] for _ in range(24)])
    haps ^= draw.random(haps.shape) < 0.03
    names = "\t".join(f"s{k}" for k in range(12))
    lines = ["##fileformat=VCFv4.2", f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{names}"]
    for s in range(40):
        calls = "\t".join(f"{haps[2 * k, s]}|{haps[2 * k + 1, s]}" for k in range(12))
        lines.append(f"1\t{1000 + 700 * s}\tv{s}\tA\tC\t.\tPASS\tAC={haps[:, s].sum()};AN=24\tGT\t{calls}")
    (folder / "a.vcf").write_text("\n".join(lines) + "\n")
    typed = [x for k, x in enumerate(lines) if k < 2 or k % 3 == 0]
    (folder / "t.vcf").write_text("\n".join(typed) + "\n")
    (folder / "a.map").write_text("pos chr cM\n1 1 0\n40000 1 0.4\n")
    (folder / "a.demo").write_text("0 10000\n")
    return folder, haps


@pytest.mark.parametrize("extra", [[], ["--normalize"], ["--fit_to_data"]])
def test_infer_and_write_back(spark, small, tmp_path, extra):
    folder, haps = small
    out = str(tmp_path / "arg")
    cli.main(["infer", "--genotypes", f"{folder}/a.vcf", "--map", f"{folder}/a.map", "--demography", f"{folder}/a.demo", "--match_group_interval", "0.1", "--save_metadata", "--out", out, *extra])
    cli.main(["vcf", "--ancestry", out, "--out", str(tmp_path / "back")])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "back")).collect()]
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert len(body) == 40
    for f in body:
        s = (int(f[1]) - 1000) // 700
        assert f[9:] == [f"{haps[2 * k, s]}|{haps[2 * k + 1, s]}" for k in range(12)]


def test_other_commands(spark, small, tmp_path, capsys):
    folder, haps = small
    out = str(tmp_path / "arg")
    cli.main(["infer", "--genotypes", f"{folder}/a.vcf", "--demography", f"{folder}/a.demo", "--out", out, "--region", "1:1000-20000"])
    cli.main(["allele_ages", "--ancestry", out, "--out", str(tmp_path / "ages")])
    assert text.read_ages(spark, str(tmp_path / "ages")).count() == 28
    cli.main(["convert", "--ancestry", out, "--out", str(tmp_path / "edges")])
    assert spark.read.parquet(str(tmp_path / "edges/edges")).where("target >= hap").isEmpty()
    cli.main(["convert", "--ancestry", out, "--add_mutations", "--out", str(tmp_path / "graph")])
    held = spark.read.parquet(str(tmp_path / "graph/mutations")).select("site", F.explode("haps").alias("hap")).collect()
    assert sorted((r["site"], r["hap"]) for r in held) == [(s, h) for s in range(28) for h in range(24) if haps[h, s]]
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).count() == 24
    cli.main(["map", "--ancestry", out, "--input", f"{folder}/a.vcf", "--region", "1:1000-20000", "--maf", "0.5", "--out", str(tmp_path / "mut")])
    mapped = text.read_mapping(spark, str(tmp_path / "mut"))
    assert mapped.count() > 0 and text.parse_mapping(mapped).where("upper < lower").isEmpty()
    capsys.readouterr()
    cli.main(["impute", "--panel", f"{folder}/a.vcf", "--target", f"{folder}/t.vcf", "--map", f"{folder}/a.map", "--demography", f"{folder}/a.demo", "--region", "1:1-100000", "--stdout"])
    body = [x.split("\t") for x in capsys.readouterr().out.splitlines() if x and not x.startswith("#")]
    assert body[0][0] == "1"
    calls = np.array([[[int(a) for a in c.split(":")[0].split("|")] for c in f[9:]] for f in body]).reshape(40, 24).T
    assert (calls == haps).mean() > 0.95
    with pytest.raises(SystemExit):
        cli.main(["impute", "--panel", "p", "--target", "t", "--map", "m", "--demography", "d", "--region", "1-2"])


def test_mappings_change_imputed_lines(spark, small, tmp_path, capsys):
    folder, _ = small
    (folder / "m.mut").write_text("v1\t1700\t0\t-1,5000.0,9000.0\nv2\t2400\t0\t0.1.2,4000.0,8000.0;5,100.0,inf\nv4\t3800\t0\tNaN\n")
    lines = []
    for more in ([], ["--mut", f"{folder}/m.mut"]):
        capsys.readouterr()
        cli.main(["impute", "--panel", f"{folder}/a.vcf", "--target", f"{folder}/t.vcf", "--map", f"{folder}/a.map", "--demography", f"{folder}/a.demo", "--region", "1:1-100000", "--stdout", *more])
        lines.append([x for x in capsys.readouterr().out.splitlines() if x])
    header = [x for x in lines[0] if x.startswith("#CHROM")][0].split("\t")[9:]
    assert header == [f"s{k}" for k in range(12)]
    changed = [x.split("\t")[2] for x, y in zip(*lines, strict=True) if x != y]
    assert "v1" in changed and set(changed) <= {"v1", "v2"}


def test_phase(spark, small, tmp_path):
    """Scaffold variants as they are, others by relatives; doses stay what they were."""
    folder, haps = small
    head = [x for x in (folder / "a.vcf").read_text().splitlines() if x.startswith("#")]
    body = [x.split("\t") for x in (folder / "a.vcf").read_text().splitlines() if not x.startswith("#")]
    turned = [f[:9] + ["/".join(sorted(c.split("|"))) for c in f[9:]] for f in body]
    (folder / "u.vcf").write_text("\n".join([*head, *("\t".join(f) for f in turned)]) + "\n")
    out = str(tmp_path / "arg")
    cli.main(["infer", "--genotypes", f"{folder}/a.vcf", "--map", f"{folder}/a.map", "--demography", f"{folder}/a.demo", "--match_group_interval", "0.1", "--out", out])
    cli.main(["phase", "--scaffold", f"{folder}/t.vcf", "--ancestry", out, "--unphased", f"{folder}/u.vcf", "--out", str(tmp_path / "phased")])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "phased")).collect()]
    assert [x for x in lines if x.startswith("#CHROM")][0].split("\t")[9:] == [f"s{k}" for k in range(12)]
    right = hets = 0
    typed = {x.split("\t")[2] for x in (folder / "t.vcf").read_text().splitlines() if not x.startswith("#")}
    for f, own in zip([x.split("\t") for x in lines if not x.startswith("#")], body, strict=True):
        assert f[2] == own[2] and [sorted(c.split("|")) for c in f[9:]] == [sorted(c.split("|")) for c in own[9:]]
        if f[2] in typed:
            assert f[9:] == own[9:]
        else:
            hets += sum(c in ("0|1", "1|0") for c in own[9:])
            right += sum(c == d and c in ("0|1", "1|0") for c, d in zip(f[9:], own[9:], strict=True))
    assert right > 0.5 * hets > 0


def test_scaffold_goes_on_only_in_order(spark):
    from haplomill.operators import phasing

    numbered = lambda ids: spark.createDataFrame(list(enumerate(ids)), "site int, id string")
    pairs = lambda a, b: sorted(tuple(r) for r in phasing.lockstep(numbered(a), numbered(b)).collect())
    assert pairs("abcdef", "bdf") == [(1, 0), (3, 1), (5, 2)]
    assert pairs("abcdef", "bxd") == [(1, 0)]
    assert pairs("abcdef", "dbe") == [(3, 0)]
    assert pairs("aabcb", "abb") == [(0, 0), (2, 1), (4, 2)]
    assert pairs("abc", "") == []


def test_contigs_and_unphased_calls(spark, tmp_path):
    line = "{}\t5\tx\tA\tC\t.\t.\tAC=1;AN=2\tGT\t{}\n"
    path = tmp_path / "two.vcf"
    path.write_text("##contig=<ID=7,length=9>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tme\n" + line.format("7", "0/1") + line.format("8", "1|0"))
    assert text.read_vcf_header(spark, str(path)) == (["me"], ["7"])
    with pytest.raises(ValueError, match="one contig"):
        text.one_contig(text.read_vcf(spark, str(path), phased=False))
    assert [list(r["genotypes"]) for r in text.read_vcf(spark, str(path), phased=False).orderBy("chrom").collect()] == [[0, 1], [1, 0]]
    with pytest.raises(Exception, match="unphased"):
        text.read_vcf(spark, str(path)).collect()


def test_site_stream(spark, tmp_path):
    schema = "region string, site long, cm double, alleles array<int>"
    folder = tmp_path / "in"
    rows = [("1", s, s * 0.01, [int(s > 1), 1, 0]) for s in range(4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    for name, query, mode in (("counts", site_stream(stream), "append"), ("stretches", windowed_counts(stream, 0.02), "complete")):
        run = query.writeStream.format("memory").queryName(name).outputMode(mode).start()
        run.processAllAvailable()
        run.stop()
    out = sorted(tuple(r) for r in spark.table("counts").collect())
    assert out == [("1", s, 1 + int(s > 1), 3, s > 1, s + 1) for s in range(4)]
    assert spark.table("stretches").count() == 2
