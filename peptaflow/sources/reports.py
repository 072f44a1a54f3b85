"""Predictor reports, annotations, variants and tables as typed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.missing import na_to_null
from ..functions.sequences import mask_residues, norm_mhc, strip_version

#: Header of stability reports.
STABILITY = ["pos", "HLA", "peptide", "Identity", "Pred", "Thalf(h)", "%Rank_Stab", "1-log50k", "Aff(nM)", "%Rank_aff", "Combined", "Combined_%rank", "BindLevel"]
#: Columns of alignment output and of junction tables.
BLAST = ["qseqid", "sseqid", "qseq", "qstart", "qend", "sseq", "sstart", "send", "length", "mismatch", "pident", "evalue", "bitscore"]
JUNCTION = ["chrom", "intron_start", "intron_stop", "strand", "intron_motif", "annotated", "unique_junction_reads", "multimap_junction_reads", "max_overhang"]
#: Chromosomes kept from junction tables.
CHROMOSOMES = [f"chr{c}" for c in [*range(1, 23), "X", "Y"]]


def _place() -> list[Column]:
    """Columns that put the rows of a file source in their physical order: file, split, and row within the split."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, value). Files are split as usual; numbers come from counts per split, so a large file needs no single task."""
    raw = spark.read.option("lineSep", "\n").text(path).select(*_place(), F.regexp_replace("value", r"\r$", "").alias("value"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("file", "block", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").startswith(" ")).withColumn("t", F.split(F.trim("value"), r"\s+"))


def read_affinity(spark: SparkSession, path: str) -> DataFrame:
    """Affinity report: indented lines, the header line starts with Pos and has 15 or 17 columns, all headers agree.

    Rows have one token less than the header (no bind level: NB) or one more (an arrow before the level); the
    column HLA becomes MHC; file and line_no tell where a row stood."""
    rows = _tokens(numbered_lines(spark, path))
    headers = [r["t"] for r in rows.filter(F.col("t")[0] == "Pos").select("t").distinct().limit(2).collect()]
    if len(headers) != 1 or len(headers[0]) not in (15, 17):
        raise ValueError(f"one header of 15 or 17 columns is expected, found {headers}")
    names, n = [h.replace("HLA", "MHC") for h in headers[0]], len(headers[0])
    data = rows.filter(F.col("t")[0] != "Pos")
    good = F.size("t").isin(n - 1, n + 1)
    cell = lambda i: F.when(good, F.try_element_at("t", F.lit(i + 1))).otherwise(F.raise_error(F.concat(F.lit("invalid line: "), "value")).cast("string"))
    cols = [(mask_residues(cell(i)) if i == 2 else cell(i)).alias(c) for i, c in enumerate(names[:-1])]
    level = F.when(F.size("t") == n - 1, "NB").otherwise(F.try_element_at("t", F.lit(n + 1)))
    return data.select(*cols, level.alias(names[-1]), "file", "line_no")


def affinity_lookup(report: DataFrame) -> DataFrame:
    """(pep, mhc, aff): the last row of a key counts."""
    rows = report.select("file", "line_no", F.col("Peptide").alias("pep"), F.col("MHC").alias("mhc"), F.col("`Aff(nM)`").cast("double").alias("aff"))
    return last_wins(rows, ["pep", "mhc"], ["file", "line_no"])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    values = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def read_stability(spark: SparkSession, path: str) -> DataFrame:
    """(pep, mhc, half_life, rank_stab): the last row of a key counts."""
    rows = _tokens(numbered_lines(spark, path)).filter(~F.lower(F.col("t")[0]).isin("pos"))
    out = rows.filter(F.size("t").isin(len(STABILITY) - 1, len(STABILITY) + 1)).select("file", "line_no", mask_residues(F.col("t")[2]).alias("pep"), F.col("t")[1].alias("mhc"), F.col("t")[5].try_cast("double").alias("half_life"), F.col("t")[6].try_cast("double").alias("rank_stab"))
    return last_wins(out, ["pep", "mhc"], ["file", "line_no"])


def read_immunogenicity(spark: SparkSession, path: str) -> DataFrame:
    """Wide report to (pep, mhc, rank, score, ba_rank): triples from the sixth column on, the allele is the last ``_`` part of a column's name."""
    rows = numbered_lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("t", F.split(F.trim("value"), r"\s+"))
    header = rows.filter(F.col("value").startswith("Peptide")).select("t").distinct().limit(2).collect()
    if len(header) != 1 or len(header[0]["t"]) % 3 != 2:
        raise ValueError("one header of 5 columns and triples is expected")
    names = [c.split("_")[-1] for c in header[0]["t"]]
    triples = [F.struct(norm_mhc(F.lit(names[i])).alias("mhc"), *[F.col("t")[i + j].try_cast("double").alias(v) for j, v in enumerate(("rank", "score", "ba_rank"))]) for i in range(5, len(names), 3)]
    long = rows.filter(~F.col("value").startswith("Peptide")).select("file", "line_no", F.col("t")[0].alias("pep"), F.explode(F.array(*triples)).alias("x")).select("file", "line_no", "pep", "x.*")
    return last_wins(long, ["pep", "mhc"], ["file", "line_no"])


def read_presentation(spark: SparkSession, path: str) -> DataFrame:
    """(pep, mhc, aff_percentile, presentation_percentile) of a CSV; the last row of a key counts."""
    d = spark.read.csv(path, header=True).select(*_place(), F.col("peptide").alias("pep"), norm_mhc(F.col("best_allele")).alias("mhc"), F.col("affinity_percentile").try_cast("double").alias("aff_percentile"), F.col("presentation_percentile").try_cast("double").alias("presentation_percentile"))
    return last_wins(d, ["pep", "mhc"], ["file", "block", "at"])


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"qstart", "qend", "sstart", "send", "length", "mismatch"}
    schema = ", ".join(f"{c} {'int' if c in kinds else 'double' if c in ('pident', 'evalue', 'bitscore') else 'string'}" for c in BLAST)
    return spark.read.csv(path, schema=schema)


def sniff_separator(line: str) -> str:
    """The first of tab, comma and blank that comes more than three times."""
    for sep in ("\t", ",", " "):
        if line.count(sep) > 3:
            return sep
    raise ValueError(f"no separator found in {line[:80]!r}")


def read_table(spark: SparkSession, path: str, sep: str | None = None, null: str = "NA") -> DataFrame:
    """Delimited table with header; the separator is sniffed from its first line unless given."""
    if sep is None:
        sep = sniff_separator(spark.read.text(path).first()["value"])
    return spark.read.csv(path, header=True, sep=sep, nullValue=null)


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, tpm): versions are cut; of repeated transcripts the first row counts."""
    d = spark.read.csv(path, header=True, sep="\t").select(*_place(), "target_id", F.col("tpm").try_cast("double").alias("tpm"))
    return d.groupBy(strip_version(F.col("target_id")).alias("transcript")).agg(F.min_by(F.struct("tpm"), F.struct("file", "block", "at")).alias("v")).select("transcript", F.col("v.tpm").alias("tpm"))


def read_junctions(spark: SparkSession, path: str, reads: int = 0) -> DataFrame:
    """Splice junctions on known chromosomes with more unique reads than the cut-off."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter(F.col("t")[0] != JUNCTION[0])
    d = t.select(*[(F.col("t")[i] if i in (0, 3, 4) else F.col("t")[i].try_cast("long")).alias(c) for i, c in enumerate(JUNCTION)])
    return d.filter(F.col("chrom").isin(*CHROMOSOMES) & (F.col("unique_junction_reads") > reads))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos 0-based, ref, alts, qual, info map, ref_depth, alt_depth): depths from tAD, else from diRDm and diADm."""
    t = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("t"))
    info = F.str_to_map(F.col("t")[7], F.lit(";"), F.lit("="))
    num = lambda key, i: F.try_element_at(F.split(F.try_element_at("info", F.lit(key)), ","), F.lit(i)).try_cast("int")
    d = t.select(F.col("t")[0].alias("chrom"), (F.col("t")[1].cast("long") - 1).alias("pos"), F.col("t")[3].alias("ref"), F.split(F.col("t")[4], ",").alias("alts"), F.col("t")[5].try_cast("double").alias("qual"), info.alias("info"))
    return d.withColumns({"ref_depth": F.coalesce(num("tAD", 1), num("diRDm", 1)), "alt_depth": F.coalesce(num("tAD", 2), num("diADm", 1))})


def passing_variants(vcf: DataFrame, qual: float, depth: int, fraction: float, normal_fraction: float | None = None) -> DataFrame:
    """Variants with enough quality, alternative depth and allele fraction, and with a low fraction in the normal sample."""
    ad = lambda key, i: F.try_element_at(F.split(F.try_element_at("info", F.lit(key)), ","), F.lit(i)).try_cast("int")
    ok = (F.col("qual") >= qual) & (F.col("alt_depth") >= depth) & (F.col("alt_depth") >= (F.col("ref_depth") + F.col("alt_depth")) * fraction)
    if normal_fraction is not None:
        ok = ok & (ad("nAD", 2) <= (ad("nAD", 1) + ad("nAD", 2)) * normal_fraction)
    return vcf.filter(ok)


def read_hla_types(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct sorted alleles of the typing table's columns: ``None`` skipped, ``HLA-`` in front, ``*`` cut."""
    long = table.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("a")).filter(F.col("a").isNotNull() & ~F.col("a").isin("None", ""))
    return long.select(F.concat(F.lit("HLA-"), F.regexp_replace("a", r"\*", "")).alias("allele")).distinct().orderBy("allele")


def read_motif_pairs(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter((F.size("t") >= 2) & (F.col("t")[0] != "Allele"))
    return t.select(F.col("t")[0].alias("allele"), F.col("t")[1].alias("peptide"))


def read_clonotypes(spark: SparkSession, path: str) -> DataFrame:
    """(v_gene, j_gene, cdr3) by position (columns 5, 7 and 32); allele marks after ``*`` are cut."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("t"))
    cell = lambda i: F.try_element_at("t", F.lit(i + 1))
    return t.filter(F.size("t") > 32).select(F.substring_index(cell(5), "*", 1).alias("v_gene"), F.substring_index(cell(7), "*", 1).alias("j_gene"), cell(32).alias("cdr3"))


def read_tcr_scores(spark: SparkSession, path: str) -> DataFrame:
    """(peptide, score): the best score of each peptide; a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "peptide string, score double")
    t = spark.read.csv(path)
    return t.groupBy(F.col("_c7").alias("peptide")).agg(F.max(F.col("_c9").try_cast("double")).alias("score")).filter("score IS NOT NULL")


def read_blocks(spark: SparkSession, path: str, every: int = 4, offset: int = 2) -> DataFrame:
    """Rows of reports whose parts are divided by dashed rulers: the parts at ``offset`` of each ``every``, as token arrays."""
    parts = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^-{5,}\s*$")).alias("i", "part"))
    lines = parts.filter(F.col("i") % every == offset).select("i", F.posexplode(F.split("part", "\n")).alias("j", "line")).filter(F.trim("line") != "")
    return lines.select("i", "j", F.split(F.trim("line"), r"\s+").alias("t"))


def key_values(spark: SparkSession, path: str, sep: str = "=") -> DataFrame:
    t = spark.read.text(path).filter(F.col("value").contains(sep)).select(F.trim(F.substring_index("value", sep, 1)).alias("key"), F.trim(F.expr(f"substr(value, instr(value, '{sep}') + {len(sep)})")).alias("value"))
    return t


def read_transcripts_by_region(spark: SparkSession, path: str) -> DataFrame:
    """Isoform catalogue: (chrom, tx_start, tx_end, isoform, protein, strand, cds_start, cds_end, gene, exon_lens, exon_starts)."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("t"))
    ints = lambda i: F.transform(F.filter(F.split(F.col("t")[i], ","), lambda x: x != ""), lambda x: x.cast("int"))
    return t.select(*[F.col("t")[i].alias(c) if c in ("chrom", "isoform", "protein", "strand", "gene") else F.col("t")[i].cast("long").alias(c) for i, c in enumerate(["chrom", "tx_start", "tx_end", "isoform", "protein", "strand", "cds_start", "cds_end", "gene"])], ints(10).alias("exon_lens"), ints(11).alias("exon_starts"))


def cleaned(table: DataFrame, numeric: dict[str, object], required: Sequence[str]) -> tuple[DataFrame, Column]:
    """Casts columns (NA tokens to null, then the default), drops rows without the required ones; and a column expression of completeness."""
    d = table.withColumns({c: F.coalesce(na_to_null(F.col(c)).try_cast("double"), F.lit(v).cast("double")) for c, v in numeric.items()})
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return d.dropna(subset=list(required)), complete


def write_table(df: DataFrame, path: str, null: str = "NA", gzip: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue=null, compression="gzip" if gzip else "none")


def write_top(df: DataFrame, path: str, order: Sequence[Column | str], n: int = 1000) -> None:
    write_table(df.orderBy(*order).limit(n).coalesce(1), path, gzip=True)


def formatted(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.format_string(p, F.col(c)) for c, p in patterns.items()})


def missed_lookups(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti").select(*on).distinct()


def row_numbers(df: DataFrame, order: Sequence[str], prefix: str) -> DataFrame:
    """Adds ids ``prefix<n>`` in the given order (small tables of helper records)."""
    return df.withColumn("fid", F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(*order)).cast("string")))
