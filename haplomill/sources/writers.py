"""Lines of the text formats, and ancestry tables as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def trimmed(x: Column) -> Column:
    """Three decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")


def call(a: Column, b: Column) -> Column:
    """GT:DS of two haplotype dosages, rounded half to even."""
    gt = lambda x: F.bround(x, 0).cast("int").cast("string")
    return F.concat(gt(a), F.lit("|"), gt(b), F.lit(":"), trimmed(a + b))


def imputed_lines(variants: DataFrame, doses: DataFrame) -> DataFrame:
    """site, line of an imputed VCF. variants: site, chrom, pos, id, ref, alt, af, imputed; doses:
    site, target, dose of each haplotype, two in a row an individual."""
    people = doses.groupBy("site", F.floor(F.col("target") / 2).alias("ind")).agg(F.array_sort(F.collect_list(F.struct("target", "dose"))).alias("h"))
    calls = people.select("site", F.struct("ind", call(F.col("h")[0]["dose"], F.col("h")[1]["dose"]).alias("c")).alias("c"))
    rows = calls.groupBy("site").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["c"]).alias("calls"))
    info = F.concat(F.when(F.col("imputed"), "IMP;").otherwise(""), F.lit("AF="), F.format_string("%.4f", "af"))
    fixed = [F.col(c).cast("string") for c in ("chrom", "pos", "id", "ref", "alt")]
    return variants.join(rows, "site").select("site", F.concat_ws("\t", *fixed, F.lit("."), F.lit("PASS"), info, F.lit("GT:DS"), F.array_join("calls", "\t")).alias("line"))


def phased_lines(variants: DataFrame, genotypes: DataFrame) -> DataFrame:
    """site, line of a phased VCF of whole individuals."""
    people = genotypes.groupBy("site", F.floor(F.col("hap") / 2).alias("ind")).agg(F.array_sort(F.collect_list(F.struct("hap", "g"))).alias("h")).where("size(h) = 2")
    calls = people.select("site", F.struct("ind", F.concat(F.col("h")[0]["g"].cast("string"), F.lit("|"), F.col("h")[1]["g"].cast("string")).alias("c")).alias("c"))
    rows = calls.groupBy("site").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["c"]).alias("calls"))
    fixed = [F.col(c).cast("string") for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter")]
    return variants.join(rows, "site").select("site", F.concat_ws("\t", *fixed, F.concat(F.lit("NS="), F.size("calls").cast("string")), F.lit("GT"), F.array_join("calls", "\t")).alias("line"))


def header(contig: str, samples: list[str], imputed: bool) -> list[str]:
    """Lines before the records; descriptions are free text."""
    described = {
        True: [("INFO", "IMP", "0", "Flag", "not among the variants of the targets"), ("INFO", "AF", "A", "Float", "share of ALT alleles in the panel"), ("FORMAT", "DS", "A", "Float", "expected count of ALT alleles")],
        False: [("INFO", "NS", "1", "Integer", "individuals with a call")],
    }[imputed] + [("FORMAT", "GT", "1", "String", "alleles of both haplotypes, phase known")]
    lines = [f'##{kind}=<ID={name},Number={number},Type={of},Description="{text}">' for kind, name, number, of, text in described]
    # Fixed values of the VCF standard: version line, meaning of PASS, names of the columns.
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
    return ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', f"##contig=<ID={contig}>", *lines, "\t".join([*columns, *samples])]


def write_lines(spark: SparkSession, lines: DataFrame, head: list[str], path: str) -> None:
    """Text files under path that, read in the order of their names, are the whole file."""
    first = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "site long, line string")
    first.unionByName(lines.select(F.col("site").cast("long").alias("site"), "line")).repartitionByRange("site").sortWithinPartitions("site").select("line").write.text(path)


def mapping_lines(mapped: DataFrame) -> DataFrame:
    return mapped.select(F.concat_ws("\t", "variant", F.col("pos").cast("string"), F.col("flipped").cast("string"), "mapping").alias("line"))


def ages_lines(ages: DataFrame) -> DataFrame:
    """Lines with made-up names snp_0, snp_1, ..."""
    return ages.select(F.concat_ws("\t", F.concat(F.lit("snp_"), F.col("site").cast("string")), F.col("pos").cast("string"), F.col("age").cast("string")).alias("line"))


TABLES = ("segments", "mismatches", "sites", "range", "samples", "variants")


def write_ancestry(path: str, tables: dict[str, DataFrame]) -> None:
    """segments, mismatches and sites, and, where given, range, samples and variants."""
    for name, rows in tables.items():
        if name not in TABLES:
            raise ValueError(f"no table {name} in an ancestry")
        if name in ("segments", "mismatches"):
            rows = rows.repartitionByRange("hap").sortWithinPartitions("hap")
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_ancestry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that are there; a missing range is that of the sites."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [name for name in TABLES if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))]
    out = {name: spark.read.parquet(f"{path}/{name}") for name in there}
    if "range" not in out and "sites" in out:
        out["range"] = out["sites"].agg(F.min("pos").cast("double").alias("start"), (F.max("pos") + 1).cast("double").alias("end"))
    return out
