"""Readers of the text formats of genetics: maps, demographies, variant and sample lists, VCF, mappings.

All schemas are stated; columns are cut out of lines by expressions, so that what is not used is
never parsed further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import indexed, pgen


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _fields(column: str = "value", separator: str = r"\s+") -> Column:
    return F.split(F.trim(column), separator)


def read_map(spark: SparkSession, path: str, chromosome: str | None = None) -> DataFrame:
    """pos, cm of a genetic map with a header that names pos, chr and cM; one chromosome, the expected one."""
    lines = _lines(spark, path)
    header = lines.first()["value"].split()
    at = {name: header.index(name) for name in ("pos", "chr", "cM")}
    rows = lines.where(F.col("value") != "\t".join(header)).where(~F.trim("value").startswith(header[0])).select(_fields().alias("f"))
    rows = rows.select(F.get("f", F.lit(at["pos"])).cast("double").alias("pos"), F.get("f", F.lit(at["chr"])).alias("chrom"), F.get("f", F.lit(at["cM"])).cast("double").alias("cm"))
    found = sorted(r["chrom"] for r in rows.select("chrom").distinct().limit(2).collect())
    if len(found) != 1:
        raise ValueError("a genetic map must hold one chromosome")
    if chromosome is not None and found[0].removeprefix("chr") != chromosome.removeprefix("chr"):
        raise ValueError(f"the map holds chromosome {found[0]}, not {chromosome}")
    return rows.select("pos", "cm")


def read_demography(spark: SparkSession, path: str) -> DataFrame:
    """t, ne of a demography without header."""
    return _lines(spark, path).select(_fields().alias("f")).select(F.get("f", F.lit(0)).cast("double").alias("t"), F.get("f", F.lit(1)).cast("double").alias("ne"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    f = _lines(spark, path).select(_fields().alias("f"))
    names = (("chrom", 0), ("pos", 3), ("id", 1), ("ref", 5), ("alt", 4))
    return f.select(*[(F.get("f", F.lit(k)).cast("int") if c == "pos" else F.get("f", F.lit(k))).alias(c) for c, k in names], F.lit(".").alias("qual"), F.lit("PASS").alias("filter"))


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a .pvar file; QUAL and FILTER where its header names them."""
    lines = _lines(spark, path)
    header = lines.where(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError(f"{path} has no #CHROM line")
    names = header["value"].lstrip("#").split()
    f = lines.where(~F.col("value").startswith("#")).select(_fields().alias("f"))
    column = lambda c, other: F.get("f", F.lit(names.index(c))) if c in names else F.lit(other)
    return f.select(column("CHROM", None).alias("chrom"), column("POS", None).cast("int").alias("pos"), column("ID", ".").alias("id"), column("REF", None).alias("ref"), column("ALT", None).alias("alt"), column("QUAL", ".").alias("qual"), column("FILTER", "PASS").alias("filter"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_variants(spark: SparkSession, stem: str) -> DataFrame:
    """Variants beside genotypes: .bim before .pvar."""
    if _exists(spark, f"{stem}.bim"):
        return read_bim(spark, f"{stem}.bim")
    return read_pvar(spark, f"{stem}.pvar")


def read_samples(spark: SparkSession, stem: str) -> DataFrame:
    """name of each sample: .fam before .psam, whose header may be missing."""
    if _exists(spark, f"{stem}.fam"):
        return _lines(spark, f"{stem}.fam").select(F.get(_fields(), F.lit(1)).alias("name"))
    lines = _lines(spark, f"{stem}.psam")
    first = lines.first()["value"].split()
    names = [x.lstrip("#") for x in first]
    if "IID" in names:
        return lines.where(~F.col("value").startswith("#") & ~F.trim("value").startswith("IID")).select(F.get(_fields(), F.lit(names.index("IID"))).alias("name"))
    return lines.select(F.get(_fields(), F.lit(1)).alias("name"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").alias("name"))


def read_vcf_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(sample names, contigs that the header declares) of a VCF."""
    lines = spark.read.text(path).where(F.col("value").startswith("#CHROM") | F.col("value").startswith("##contig"))
    lines = [r["value"] for r in lines.collect()]  # header lines: a name a sample, a line a contig
    names = next((x.split("\t")[9:] for x in lines if x.startswith("#CHROM")), None)
    if names is None:
        raise ValueError(f"{path} has no #CHROM line")
    return names, [x.partition("ID=")[2].split(",")[0].rstrip(">") for x in lines if x.startswith("##contig")]


def one_contig(records: DataFrame) -> str:
    """The contig of all records; another number of them than one is an error."""
    found = sorted(r["chrom"] for r in records.select("chrom").distinct().limit(2).collect())
    if len(found) != 1:
        raise ValueError(f"records of one contig are needed, not of {found or 'none'}")
    return found[0]


def _vcf_lines(spark: SparkSession, path: str, start: int | None, end: int | None, contig: str | None) -> DataFrame:
    """Lines of a VCF; of a region only its chunks where an index stands beside the file."""
    if not path.endswith((".gz", ".bgz")) or not _exists(spark, f"{path}.tbi"):
        return spark.read.text(path)
    indexed.register(spark)
    options = {"path": path, "contig": contig, "start": start, "end": end}
    return spark.read.format("indexed_vcf").options(**{k: v for k, v in options.items() if v is not None}).load()


def read_vcf(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, phased: bool = True, contig: str | None = None) -> DataFrame:
    """chrom, pos, id, ref, alt, af, genotypes (alleles of haplotypes in order) of the records with one
    ALT allele; the filter on positions comes before genotypes are cut. Unphased calls are an error
    unless phased is false; missing ones are one."""
    # the optimizer may try later filters on header lines first: these have no fields
    body = ~F.col("value").startswith("#") & (F.col("value") != "")
    rows = _vcf_lines(spark, path, start, end, contig).select(F.when(body, F.split("value", "\t")).alias("f")).where(F.col("f").isNotNull())
    if contig is not None:
        rows = rows.where(F.get("f", F.lit(0)) == contig)
    rows = rows.withColumn("pos", F.get("f", F.lit(1)).try_cast("int"))
    if start is not None:
        rows = rows.where(F.col("pos").between(start, end))
    number = lambda name: F.regexp_extract(F.get("f", F.lit(7)), rf"(?:^|;){name}=(\d+)", 1).cast("double")
    calls = F.transform(F.slice("f", 10, F.size("f")), lambda c: F.split(c, ":")[0])
    right = F.forall(calls, lambda c: c.rlike(r"^[01]\|[01]$" if phased else r"^[01][|/][01]$"))
    alleles = F.flatten(F.transform(calls, lambda c: F.transform(F.split(c, r"[|/]"), lambda a: a.cast("tinyint"))))
    checked = F.when(F.col("f").isNull(), None).when(right, alleles).otherwise(F.raise_error(F.concat(F.lit("unphased or missing calls at "), F.col("pos").cast("string"))))
    single = F.when(F.coalesce(F.get("f", F.lit(4)).contains(","), F.lit(False)), F.raise_error(F.lit("a record with several ALT alleles"))).otherwise(F.get("f", F.lit(4)))
    return rows.select(F.get("f", F.lit(0)).alias("chrom"), "pos", F.get("f", F.lit(2)).alias("id"), F.get("f", F.lit(3)).alias("ref"), single.alias("alt"), (number("AC") / number("AN")).alias("af"), checked.alias("genotypes"))


def read_pgen(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """chrom, pos, id, ref, alt, af, genotypes of a .pgen file and the variants beside it."""
    variants = read_variants(spark, path.removesuffix(".pgen"))
    # the n-th line is the n-th record: lines alone are numbered
    numbered = variants.withColumn("_row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("variant", (F.row_number().over(Window.orderBy("_row")) - 1).cast("int")).drop("_row", "qual", "filter")
    wanted = numbered if start is None else numbered.where(F.col("pos").between(start, end))
    ends = wanted.agg(F.min("variant").alias("low"), F.max("variant").alias("high")).first()
    pgen.register(spark)
    rows = spark.read.format("pgen").option("path", path).option("start", ends["low"] or 0).option("end", -1 if ends["high"] is None else ends["high"] + 1).load()
    af = F.aggregate("genotypes", F.lit(0), lambda a, g: a + g) / F.size("genotypes")
    return rows.join(wanted, "variant").select("chrom", "pos", "id", "ref", "alt", af.alias("af"), "genotypes")


def last_by_id(records: DataFrame, order: str) -> DataFrame:
    """One record an id: the last one's values at the first one's place."""
    kept = records.groupBy("id").agg(F.max_by(F.struct(*[c for c in records.columns if c not in ("id", order)]), order).alias("r"), F.min(order).alias(order))
    return kept.select("id", order, "r.*")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """variant, pos, flipped, mapping of a mapping file without header."""
    f = _lines(spark, path).select(_fields().alias("f"))
    return f.select(F.get("f", F.lit(0)).alias("variant"), F.get("f", F.lit(1)).cast("int").alias("pos"), F.get("f", F.lit(2)).cast("int").alias("flipped"), F.get("f", F.lit(3)).alias("mapping"))


def parse_mapping(rows: DataFrame) -> DataFrame:
    """variant, pos, flipped, hap, lower, upper, is_unique: a row a haplotype and branch."""
    # what each row keeps is cut out before its branches and haplotypes become rows: afterwards the whole
    # string would be split again for each of them
    listed = rows.where("mapping <> 'NaN'").select("variant", "pos", "flipped", F.split("mapping", ";").alias("branches"))
    listed = listed.select("variant", "pos", "flipped", "branches", (F.size("branches") == 1).alias("is_unique"))
    each = listed.select("variant", "pos", "flipped", "is_unique", F.explode("branches").alias("branch"))
    part = each.select("variant", "pos", "flipped", "is_unique", F.split("branch", ",").alias("p"))
    part = part.select("variant", "pos", "flipped", "is_unique", F.split(F.col("p")[0], r"\.").alias("haps"), F.col("p")[1].cast("double").alias("lower"), F.col("p")[2].cast("double").alias("upper"))
    found = part.select("variant", "pos", "flipped", F.explode("haps").alias("hap"), "lower", "upper", "is_unique")
    return found.withColumn("hap", F.col("hap").cast("int"))


def read_ages(spark: SparkSession, path: str) -> DataFrame:
    """id, pos, age of a table without header."""
    return spark.read.csv(path, sep="\t", schema="id string, pos int, age double")
