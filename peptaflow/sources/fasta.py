"""FASTA scans and sinks: one row a record, header attributes as a map."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(header, fid, attrs, seq): lines of a sequence are joined; text before the first header is an error in the data and left out."""
    raw = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.regexp_replace("value", r"\r", "").alias("value"))
    first = F.regexp_replace("value", r"^>", "")
    parts = raw.filter(F.trim("value") != "").select(F.split(first, "\n", 2).alias("p"))
    out = parts.select(F.trim(F.col("p")[0]).alias("header"), F.regexp_replace(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), r"\s", "").alias("seq"))
    return out.select("header", F.regexp_extract("header", r"^(\S*)", 1).alias("fid"), S.header_attributes(F.col("header")).alias("attrs"), "seq")


def typed_attributes(fasta: DataFrame) -> DataFrame:
    """Adds the usual attributes as columns: WT, ST, MT, TPM (0), HLA (array), helper and self flags (0), distances."""
    a = lambda k: F.try_element_at("attrs", F.lit(k))
    na = lambda k: F.when(~a(k).isin("NA", "N/A", "", "None", "none", ".", "Na"), a(k))
    return fasta.withColumns({
        "WT": na("WT"), "ST": na("ST"), "MT": na("MT"), "TPM": F.coalesce(a("TPM").try_cast("double"), F.lit(0.0)), "HLA": F.when(a("HLA").isNotNull(), F.split(a("HLA"), ",")),
        "IsHelperPeptide": F.coalesce(a("IsHelperPeptide").try_cast("int"), F.lit(0)), "IsSearchedFromSelfProteome": F.coalesce(a("IsSearchedFromSelfProteome").try_cast("int"), F.lit(0)),
        "SOURCE": a("SOURCE"), "MAX_BIT_DIST": a("MAX_BIT_DIST").try_cast("double"), "EDIT_DIST": a("EDIT_DIST").try_cast("double"),
    })


def read_proteome(spark: SparkSession, *paths: str) -> DataFrame:
    """(transcript, seq): transcript of the ``transcript:`` token, without version."""
    f = read_fasta(spark, *paths)
    return f.select(F.regexp_extract("header", r"transcript:([^. ]+)", 1).alias("transcript"), "seq").filter("transcript <> ''")


def read_genome_blocks(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """(chrom, block, bases): sequences cut in blocks, so that no row is a whole chromosome downstream."""
    f = read_fasta(spark, path).select(F.col("fid").alias("chrom"), "seq")
    return f.select("chrom", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / block)), lambda i: F.substring("seq", (i * block + 1).cast("int"), F.lit(block)))).alias("block", "bases"))


def genome_slices(regions: DataFrame, blocks: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Adds ``bases`` of each region (chrom, start, end; 0-based, half open), read from the blocks that it touches."""
    keyed = regions.withColumn("_id", F.xxhash64("chrom", "start", "end"))
    need = keyed.select("_id", "chrom", "start", "end").distinct().withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("int"), F.floor((F.col("end") - 1) / block).cast("int"))))
    cut = need.join(blocks, ["chrom", "block"]).select("_id", "block", F.substring("bases", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)) + 1, F.least(F.col("end") - F.col("block") * block, F.lit(block)) - F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).alias("part"))
    whole = cut.groupBy("_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda s: s["part"])).alias("bases"))
    return keyed.join(whole, "_id", "left").drop("_id")


def keep_expressed(fasta: DataFrame, tpm: float, hla: str | None = None) -> DataFrame:
    """Records with enough TPM (0 if absent) and canonical residues only; ``hla`` is appended to their headers."""
    kept = fasta.filter((F.coalesce(F.try_element_at("attrs", F.lit("TPM")).try_cast("double"), F.lit(0.0)) >= tpm) & S.is_peptide(F.col("seq")))
    return with_attribute(kept, "HLA", hla, always=True) if hla else kept


def with_attribute(fasta: DataFrame, key: str, value: str, always: bool = False) -> DataFrame:
    """Appends ``key=value`` to headers that lack the key (or to all)."""
    lacks = F.lit(True) if always else ~F.map_contains_key("attrs", F.lit(key))
    return fasta.withColumns({"header": F.when(lacks, F.concat("header", F.lit(f" {key}={value}"))).otherwise(F.col("header")), "attrs": F.when(lacks, F.map_concat(F.map_filter("attrs", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col("attrs"))})


def duplicate_ids(fasta: DataFrame) -> DataFrame:
    return fasta.groupBy("fid").count().filter("count > 1")


def duplicate_keys(fasta: DataFrame) -> DataFrame:
    """Headers that give a key twice."""
    keys = F.transform(F.filter(F.slice(F.split("header", r"\s+"), 2, 1 << 30), lambda t: F.size(F.split(t, "=")) == 2), lambda t: F.split(t, "=")[0])
    return fasta.filter(F.size(keys) != F.size(F.array_distinct(keys)))


def write_fasta(fasta: DataFrame, path: str) -> None:
    fasta.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_fasta_by(fasta: DataFrame, key: Column, path: str) -> None:
    """One folder a value of ``key``, named by it with other characters as underscores, and a mapping table beside them."""
    keyed = fasta.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"), key.alias("raw"), S.safe_file_name(key).alias("part"))
    keyed.select("value", "part").write.mode("overwrite").partitionBy("part").text(path)
    keyed.select("part", "raw").distinct().write.mode("overwrite").json(f"{path.rstrip('/')}_mapping")


def fasta_row(identity: str, seq: str, **attrs: object) -> str:
    """Header text of one record."""
    if re.search(r"\s", identity):
        raise ValueError("an id has no blanks")
    return " ".join([identity, *(f"{k}={v}" for k, v in attrs.items())])
