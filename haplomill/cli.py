"""Commands: infer, convert, allele_ages, map, impute, phase, vcf.

Genotypes are read from phased VCF files (of a region only its part, where an index stands beside
the file), from .pgen files, or from Parquet with one row a site (site, pos, id, ref,
alt, af, genotypes); what is inferred is kept as a folder of Parquet tables.
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import cut
from .functions.regions import parse_region
from .operators import ancestry, consistency, coordinates, copying, dating, frequencies, imputation, normalize, panel, panel_path, pbwt, penalties, phasing, psmc, trees
from .operators.demography import Demography
from .sources import text, writers

K, MIN_MATCHES = 4, 4


VCF = (".vcf", ".vcf.gz", ".vcf.bgz")


def read_sites(spark: SparkSession, path: str, region: tuple[int, int] | None = None, phased: bool = True, contig: str | None = None) -> DataFrame:
    """Variants numbered by position, their haplotypes' alleles in `genotypes`."""
    start, end = region or (None, None)
    if path.endswith(VCF):
        rows = text.read_vcf(spark, path, start, end, phased, contig)
    elif path.endswith(".pgen"):
        rows = text.read_pgen(spark, path, start, end)
    else:
        rows = spark.read.parquet(path)
        rows = rows if region is None else rows.where(F.col("pos").between(start, end))
    from pyspark.sql import Window

    # positions and ids alone are numbered; records that repeat both keep the order in which they came
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    number = rows.select("_row", (F.row_number().over(Window.orderBy("pos", "id", "_row")) - 1).cast("int").alias("site"))
    return rows.join(number, "_row").drop("_row")


def names_of(spark: SparkSession, path: str) -> list[str] | None:
    """The sample names of a VCF."""
    return text.read_vcf_header(spark, path)[0] if path.endswith(VCF) else None


def long(sites: DataFrame) -> DataFrame:
    return sites.select("site", F.posexplode("genotypes").alias("hap", "g")).select("site", "hap", F.col("g").cast("int").alias("g"))


def demography_of(spark: SparkSession, path: str) -> Demography:
    rows = text.read_demography(spark, path).orderBy("t").collect()
    return Demography([r["ne"] for r in rows], [r["t"] for r in rows])


def with_cm(spark: SparkSession, sites: DataFrame, map_path: str | None, rho: float) -> DataFrame:
    found = coordinates.interpolate(sites, text.read_map(spark, map_path)) if map_path else coordinates.constant_rate(sites, rho)
    return coordinates.strictly_increasing(found)


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    records = cut(read_sites(spark, a.genotypes))
    demography = demography_of(spark, a.demography)
    sites = cut(with_cm(spark, records.select("site", "pos"), a.map, a.recombination_rate))
    geno = cut(frequencies.check_biallelic(long(records)))
    keep = frequencies.informative(frequencies.site_counts(geno)).select("site")
    kept = cut(sites.join(keep, "site", "left_semi"))
    groups = pbwt.buckets(kept, a.match_group_interval, True)
    queries = pbwt.group_of(pbwt.buckets(kept, a.query_interval, False), groups)
    n_sites = sites.count()
    ranks = pbwt.prefix_ranks(geno.join(F.broadcast(keep), "site", "left_semi"), n_sites).join(F.broadcast(queries.select("site")), "site", "left_semi")
    counts = cut(pbwt.match_counts(pbwt.neighbours(ranks, K), queries))
    found = pbwt.propagate(pbwt.candidates(counts, geno.select("hap").distinct(), MIN_MATCHES), pbwt.top(counts))
    at = sites.toPandas().sort_values("site")
    step, bp = np.append(np.diff(at["cm"]), coordinates.LAST_CM_STEP), np.append(np.diff(at["pos"]), np.diff(at["pos"]).mean())
    paths = cut(copying.infer_paths(geno, found, {r["idx"]: r["site"] for r in groups.collect()}, step, bp, demography.branch_length, a.mutation_rate, a.mode == "array"))
    mism = cut(copying.mismatches(geno, paths))
    steps = spark.createDataFrame([(int(s), float(c), float(b)) for s, c, b in zip(at["site"], step, bp, strict=True)], "site int, step double, bp double")
    paths = cut(psmc.split(paths, mism, steps, demography, a.mutation_rate))
    segments = ancestry.with_ends(paths.join(sites.select("site", F.col("pos").alias("start_bp")), "site").select("hap", "start_bp", "target"))
    last = at.iloc[-1]
    hets = ancestry.counts_in_segments(segments, mism, sites)
    cms = sites.select(F.col("pos").alias("start_bp"), F.col("cm").alias("start_cm"))
    ends = sites.select(F.col("pos").alias("end_bp"), F.col("cm").alias("end_cm"))
    dated = segments.join(hets, ["hap", "seg_idx"]).join(cms, "start_bp").join(ends, "end_bp", "left")
    span = (F.coalesce("end_bp", F.lit(int(last["pos"]))) - F.col("start_bp")).cast("double")
    age = dating.date_segment(F.col("hets"), F.coalesce("end_cm", F.lit(float(last["cm"]))) - F.col("start_cm"), span, a.mutation_rate, demography)
    segments = dated.select("hap", "seg_idx", "start_bp", "end_bp", "target", age.alias("tmrca"))
    if a.normalize:
        histogram = ancestry.mid_quantiles(ancestry.tmrca_histogram(segments, F.lit(int(last["pos"]))))
        n = geno.agg(F.max("hap")).first()[0] + 1
        expected = normalize.expected_quantiles(normalize.simulate(spark, n, 1000, demography.sizes, demography.times, seed=1))
        segments = normalize.apply(segments, normalize.to_expected(histogram, expected))
    if a.fit_to_data:
        coordinates.check_increasing(sites)
        state = trees.states(geno, ancestry.at_sites(segments, sites))
        ages = text.read_ages(spark, a.allele_ages).join(records.select("id", "site"), "id").select("site", "age") if a.allele_ages else trees.allele_ages(state)
        fitted = cut(consistency.fit(geno, segments, sites.select("site", "pos"), ages))
        mism = fitted.select("hap", F.explode("mismatches").alias("site"))
        segments = ancestry.with_ends(fitted.where("hap > 0").select("hap", "start_bp", "target", "tmrca"))
    sites = sites.select("site", "pos")
    if a.region:
        _, start, end = parse_region(a.region)
        segments, mism, sites = ancestry.slice_region(segments, mism, sites, start, end + 1)
    tables = {"segments": segments, "mismatches": mism, "sites": sites, "range": sites.agg(F.min("pos").cast("double").alias("start"), (F.max("pos") + 1).cast("double").alias("end"))}
    if a.save_metadata:
        named = records.select("pos", "id", "ref", "alt", *[c for c in ("chrom",) if c in records.columns])
        tables["variants"] = named.join(sites.select("pos", "site"), "pos")
    names = names_of(spark, a.genotypes)
    if names:
        tables["samples"] = spark.createDataFrame([(2 * k + side, name) for k, name in enumerate(names) for side in (0, 1)], "hap int, name string")
    writers.write_ancestry(a.out, tables)


def _load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables and everyone's genotypes."""
    tables = writers.read_ancestry(spark, path)
    haps = tables["segments"].select("hap").distinct().unionByName(spark.createDataFrame([(0,)], "hap int")).distinct()
    return tables, ancestry.reconstruct(tables["segments"], tables["mismatches"], tables["sites"], haps)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """The graph's tables in one folder each: nodes, edges and, on request, mutations."""
    tables, state = writers.read_ancestry(spark, a.ancestry), None
    if a.add_mutations:
        tables, geno = _load(spark, a.ancestry)
        state = cut(trees.states(geno, ancestry.at_sites(tables["segments"], tables["sites"])))
    for name, rows in ancestry.graph(tables["segments"], state).items():
        rows.write.mode("overwrite").parquet(f"{a.out}/{name}")


def phase(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The unphased records with the scaffold's phase or that of the ancestry."""
    records = cut(read_sites(spark, a.unphased, phased=False))
    contig = text.one_contig(records)
    found = phasing.phase(records, cut(read_sites(spark, a.scaffold)), writers.read_ancestry(spark, a.ancestry)["segments"])
    variants = records.select("site", "chrom", "pos", "id", "ref", "alt", F.lit(".").alias("qual"), F.lit("PASS").alias("filter"))
    a.contig, a.names = contig, names_of(spark, a.unphased)
    return writers.phased_lines(variants, found)


def allele_ages(spark: SparkSession, a: argparse.Namespace) -> None:
    tables, geno = _load(spark, a.ancestry)
    ages = trees.allele_ages(trees.states(geno, ancestry.at_sites(tables["segments"], tables["sites"])))
    writers.ages_lines(ages.join(tables["sites"], "site")).write.mode("overwrite").text(a.out)


def map_variants(spark: SparkSession, a: argparse.Namespace) -> None:
    tables = writers.read_ancestry(spark, a.ancestry)
    _, start, end = parse_region(a.region)
    records = cut(read_sites(spark, a.input, (start, end), contig=a.region.rpartition(":")[0] or None))
    geno = long(records)
    state = trees.states(geno, ancestry.at_sites(tables["segments"], records.select("site", "pos")))
    freq = frequencies.with_frequencies(frequencies.site_counts(geno))
    mapped = trees.map_variants(state, freq, a.maf).join(records.select("site", "pos", F.col("id").alias("variant")), "site")
    writers.mapping_lines(mapped).write.mode("overwrite").text(a.out)


def impute(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    _, start, end = parse_region(a.region)
    contig = a.region.rpartition(":")[0] or None
    panel_sites, target = cut(read_sites(spark, a.panel, (start, end), contig=contig)), read_sites(spark, a.target, (start, end), contig=contig)
    a.contig, a.names = text.one_contig(panel_sites), names_of(spark, a.target)
    n = panel_sites.agg(F.max(F.size("genotypes"))).first()[0]
    typed = cut(panel_sites.select("site", "pos", "id").join(target.select("id", F.col("genotypes").alias("t")), "id"))
    if typed.count() != target.count():
        raise ValueError("not every variant of the targets is in the panel")
    both = cut(long(panel_sites).join(typed.select("site"), "site", "left_semi").unionByName(typed.select("site", F.posexplode("t").alias("hap", "g")).select("site", (F.col("hap") + n).alias("hap"), F.col("g").cast("int").alias("g"))))
    at = cut(coordinates.interpolate(typed.select("site", "pos"), text.read_map(spark, a.map)))
    cms = at.toPandas().sort_values("site")
    step = np.append(np.diff(cms["cm"]), np.diff(cms["cm"])[-1:])
    last = panel_sites.agg(F.max("site")).first()[0] + 1
    window = pbwt.imputation_window(pbwt.prefix_ranks(both, last), n)
    # the targets' mosaics over the typed sites, numbered anew
    from pyspark.sql import Window

    number = cut(at.select("site", (F.row_number().over(Window.orderBy("site")) - 1).cast("int").alias("k")))
    numbered = at.join(number, "site").select(F.col("k").alias("site"), "pos", "cm")
    geno = cut(both.join(number, "site").select(F.col("k").alias("site"), "hap", "g"))
    whole, own = panel.build(geno.where(F.col("hap") < n), len(cms)), geno.where(F.col("hap") >= n)
    demography = demography_of(spark, a.demography)
    costs = panel_path.whole_costs(numbered, n, demography, a.mutation_rate, False)
    near = cut(panel_path.longest(panel_path.overlaps(whole, own, panel_path.members(whole, panel_path.paths(whole, own, costs))), 16))
    sets = pbwt.match_sets(window).unionByName(near.select("target", "ref")).distinct()
    found = copying.posteriors(both, sets, 1 - np.exp(-4.0 * penalties.IMPUTE_NE * 0.01 * step / n), n_panel=n)
    spread = cut(imputation.interpolate(found, imputation.flanks(panel_sites.select("site", "pos"), typed.select("site"))))
    copied = imputation.copied(long(panel_sites), spread)
    doses = imputation.dosages(spread, copied)
    if a.mut:
        branches = text.parse_mapping(text.read_mapping(spark, a.mut)).withColumnRenamed("variant", "id")
        # what carries the frequent allele of a turned variant takes no part
        mapping = branches.join(panel_sites.where("NOT coalesce(af > 0.5, false)").select("id", "site"), "id")
        mapping = mapping.select("site", F.when(~F.col("is_unique"), F.col("hap")).alias("hap"), "lower", "upper")
        doses = imputation.mapped_doses(doses, spread, copied, panel_sites.select("site", "pos"), panel_path.dated(near, numbered, demography), mapping)
    known = typed.select("site", F.posexplode("t").alias("target", "g")).select((F.col("target") + n).alias("target"), "site", F.col("g").cast("double").alias("known"))
    doses = doses.join(known, ["target", "site"], "left").select((F.col("target") - n).alias("target"), "site", F.coalesce("known", "dose").alias("dose"))
    doses = imputation.checked(doses)
    variants = imputation.typed_or_imputed(panel_sites.select("site", "chrom", "pos", "id", "ref", "alt", "af"), typed).withColumn("imputed", ~F.col("typed"))
    return writers.imputed_lines(variants, doses)


def vcf(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tables, geno = _load(spark, a.ancestry)
    variants = text.read_variants(spark, a.variants) if a.variants else tables.get("variants")
    if variants is None:
        raise SystemExit("the ancestry holds no variants; name them with --variants")
    for name, value in {"chrom": "1", "qual": ".", "filter": "PASS"}.items():
        if name not in variants.columns:
            variants = variants.withColumn(name, F.lit(value))
    a.contig = text.one_contig(variants)
    if not a.samples and "samples" in tables:
        a.names = [r["name"] for r in tables["samples"].orderBy("hap").where("hap % 2 = 0").collect()]
    return writers.phased_lines(variants.join(tables["sites"].select("pos", F.col("site").alias("_s")), "pos").withColumn("site", F.col("_s")), geno)


def parser() -> argparse.ArgumentParser:
    # Names of commands and options and their defaults are the contract with users.
    top = argparse.ArgumentParser(prog="haplomill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name: commands.add_parser(name).add_argument
    x = add("infer")
    for option, value in (("--genotypes", None), ("--demography", None), ("--out", None)):
        x(option, required=True, default=value)
    x("--map"), x("--allele_ages"), x("--region")
    x("--recombination_rate", type=float, default=1.3e-8), x("--mutation_rate", type=float, default=1.4e-8)
    x("--query_interval", type=float, default=0.01), x("--match_group_interval", type=float, default=0.5)
    x("--mode", choices=("array", "wgs"), default="wgs")
    for flag in ("--fit_to_data", "--normalize", "--save_metadata"):
        x(flag, action="store_true")
    for name in ("convert", "allele_ages"):
        x = add(name)
        x("--ancestry", required=True), x("--out", required=True)
        if name == "convert":
            x("--add_mutations", action="store_true")
    x = add("phase")
    for option in ("--scaffold", "--ancestry", "--unphased", "--out"):
        x(option, required=True)
    x = add("map")
    for option in ("--ancestry", "--input", "--region", "--out"):
        x(option, required=True)
    x("--maf", type=float, default=0.02)
    x = add("impute")
    for option in ("--panel", "--target", "--map", "--region", "--demography"):
        x(option, required=True)
    x("--mut"), x("--mutation_rate", type=float, default=1.4e-8)
    x("--out"), x("--stdout", action="store_true")
    x = add("vcf")
    x("--ancestry", required=True), x("--variants"), x("--samples"), x("--out")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "impute" and bool(a.out) == a.stdout:
        raise SystemExit("impute takes one of --out and --stdout")
    spark = SparkSession.builder.appName("haplomill").getOrCreate()
    run = {"infer": infer, "convert": convert, "allele_ages": allele_ages, "map": map_variants, "impute": impute, "phase": phase, "vcf": vcf}[a.command]
    lines = run(spark, a)
    if lines is None:
        return
    columns = len(lines.first()["line"].split("\t")) - 9
    samples = getattr(a, "samples", None)
    names = [r["name"] for r in text.read_names(spark, samples).collect()] if samples else getattr(a, "names", None) or [f"sample_{k}" for k in range(columns)]
    if len(names) != columns:
        raise SystemExit(f"{len(names)} sample names for {columns} samples")
    head = writers.header(a.contig, names, a.command == "impute")
    if a.out:
        writers.write_lines(spark, lines, head, a.out)
        return
    for line in head:
        print(line)
    for row in lines.orderBy("site").toLocalIterator():
        print(row["line"])


if __name__ == "__main__":
    main()
