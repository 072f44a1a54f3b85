"""Mutant and wild-type peptide windows from annotated variants, fusions and splice junctions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S

#: Variant consequences that yield peptides, and the residues on each side of a change.
CONSEQUENCES = ("missense_variant", "frameshift_variant", "inframe_insertion", "inframe_deletion")
FLANK = 10
#: Geometry of novel introns and exons; least protein length.
MIN_INTRON, MIN_EXON, MAX_EXON, MIN_PROTEIN = 50, 2, 250, 30


def annotated_variants(lines: DataFrame, abundance: DataFrame, tpm: float = 0.0) -> DataFrame:
    """Variant annotation lines (line_no, value; tab separated, 14 columns) to typed records of expressed transcripts."""
    t = lines.filter(~F.col("value").startswith("#") & F.col("value").rlike("|".join(CONSEQUENCES))).withColumn("t", F.split("value", "\t"))
    c, first = (lambda i: F.col("t")[i]), F.split(F.col("t")[6], ",")[0]
    alleles, aa = F.split(F.split(c(0), "_")[2], "/"), F.split(c(10), "/")
    rec = t.filter((F.length(c(10)) > 1) & (first.isin(*CONSEQUENCES[1:]) | first.contains(CONSEQUENCES[0]))).select(
        "line_no", first.alias("consequence"), F.substring_index(c(1), ":", 1).alias("chrom"), F.substring_index(c(1), ":", -1).alias("span"), S.strip_version(c(4)).alias("transcript"),
        F.split(F.split(c(9), "/")[0], "-")[0].try_cast("int").alias("protein_pos"), aa[0].alias("ref_aa"), aa[1].alias("alt_aa"), alleles[0].alias("ref"), alleles[1].alias("alt"),
        F.split(F.split(c(7), "/")[0], "-")[0].try_cast("long").alias("cdna_start"), F.try_element_at(F.split(c(7), "/"), F.lit(2)).try_cast("long").alias("cdna_end"), F.split(F.split(c(8), "/")[0], "-").alias("cds"),
    )
    placed = rec.withColumns({"start": F.split("span", "-")[0].cast("long"), "end": F.coalesce(F.try_element_at(F.split("span", "-"), F.lit(2)), F.split("span", "-")[0]).cast("long"), "cds_pos": F.element_at("cds", -1).try_cast("long")}).drop("span", "cds")
    return placed.join(abundance.filter(F.col("tpm") > tpm), "transcript")


def _info_field(key: str) -> Column:
    """Value of one key of a variant line's eighth column."""
    return F.regexp_extract(F.split("value", "\t")[7], rf"(?:^|;){key}=([^;]*)", 1)


def ann_variants(lines: DataFrame, abundance: DataFrame) -> DataFrame:
    """Variant lines (line_no, value) whose INFO has ``ANN`` sub-records to the same records as ``annotated_variants``.

    Sub-records are apart by commas, their fields by bars. Kept are expressed transcripts with a protein position that
    the protein change names, and one residue on either side of it."""
    v = F.split("value", "\t")
    sub = lines.filter(~F.col("value").startswith("#")).select("line_no", v[0].alias("chrom"), v[1].cast("long").alias("start"), v[3].alias("ref"), v[4].alias("alt"), F.explode(F.split(_info_field("ANN"), ",")).alias("a")).withColumn("a", F.split("a", r"\|")).filter(F.size("a") > 13)
    cell = lambda i: F.col("a")[i]
    number = lambda i: F.substring_index(cell(i), "/", 1)
    change = F.regexp_extract_all(cell(10), F.lit(r"^p\.([A-Za-z]{3})(\d+)([A-Za-z]{3})$"), F.lit(0))
    part = lambda g: F.regexp_extract(cell(10), r"^p\.([A-Za-z]{3})(\d+)([A-Za-z]{3})$", g)
    wanted = (cell(1) == "frameshift_variant") | cell(1).rlike("inframe_insertion|inframe_deletion|missense_variant")
    d = sub.filter(wanted & (F.size(change) == 1) & (part(2) == number(13)))
    rec = d.select(
        "line_no", cell(1).alias("consequence"), "chrom", S.strip_version(cell(6)).alias("transcript"), number(13).cast("int").alias("protein_pos"), S.shorten_residues(part(1)).alias("ref_aa"), S.shorten_residues(part(3)).alias("alt_aa"),
        "ref", "alt", number(11).try_cast("long").alias("cdna_start"), number(11).try_cast("long").alias("cdna_end"), "start", F.col("start").alias("end"), number(12).try_cast("long").alias("cds_pos"),
    )
    return rec.join(abundance, "transcript")


def funcotated_missense(lines: DataFrame, abundance: DataFrame) -> DataFrame:
    """Variant lines whose INFO has a bracketed bar-separated ``FUNCOTATION`` with a missense class, to the same records.

    Transcripts are matched with their versions, so ``abundance`` must keep them."""
    body = F.split(F.regexp_extract(_info_field("FUNCOTATION"), r"\[([^\]]*)", 1), r"\|")
    d = lines.filter(~F.col("value").startswith("#") & F.col("value").contains("MISSENSE")).select("line_no", body.alias("a")).filter(F.size("a") > 18)
    cell = lambda i: F.col("a")[i]
    part = lambda g: F.regexp_extract(cell(18), r"^p\.([A-Za-z*]+)(\d+)(.*)$", g)
    coding = F.regexp_extract(cell(16), r"^c\.(\d+)", 1).try_cast("long")
    rec = d.filter((cell(5) == "MISSENSE") & (part(2) != "")).select(
        "line_no", F.lit("missense_variant").alias("consequence"), cell(2).alias("chrom"), cell(12).alias("transcript"), part(2).cast("int").alias("protein_pos"), part(1).alias("ref_aa"), part(3).alias("alt_aa"),
        cell(8).alias("ref"), cell(10).alias("alt"), coding.alias("cdna_start"), coding.alias("cdna_end"), cell(3).cast("long").alias("start"), cell(4).cast("long").alias("end"), coding.alias("cds_pos"),
    )
    return rec.join(abundance, "transcript")


def missense_windows(records: DataFrame, proteome: DataFrame) -> DataFrame:
    """Adds mt_pep and wt_pep: 10 residues on either side of the change, cut at the protein's ends.

    Near the start the mutant window reaches 21 residues beyond the change while the wild type has 21 in all, so
    these are of unequal length unless the protein is short (``usable`` then drops them)."""
    d = records.filter(F.col("consequence").contains("missense")).join(proteome, "transcript")
    seq, pos, n, alt = F.col("seq"), F.col("protein_pos"), F.length("seq"), F.col("alt_aa")
    head, tail = pos <= FLANK, n - pos <= FLANK
    width = 2 * FLANK + 1
    begin = F.when(head, F.lit(0)).when(tail, n - width).otherwise(pos - FLANK - 1)
    end_mt = F.when(head, pos + width).when(tail, n).otherwise(pos + FLANK)
    end_wt = F.when(head, F.lit(width)).when(tail, n).otherwise(pos + FLANK)
    return d.withColumns({"mt_pep": F.concat(S.clamped(seq, begin, pos - 1), alt, S.clamped(seq, pos, end_mt)), "wt_pep": S.clamped(seq, begin, end_wt), "vtype": F.lit("SNV")})


def inframe_windows(records: DataFrame, proteome: DataFrame) -> DataFrame:
    """Adds mt_pep and wt_pep of in-frame insertions and deletions; the wild-type window begins one residue after the mutant's prefix."""
    d = records.filter(F.col("consequence").startswith("inframe")).join(proteome, "transcript")
    seq, pos, alt = F.col("seq"), F.col("protein_pos"), F.col("alt_aa")
    prefix = S.clamped(seq, pos - FLANK - 1, pos - 1)
    deletion = F.col("consequence") == "inframe_deletion"
    at = F.when(deletion, pos + F.length(alt)).otherwise(pos)
    middle = F.when(deletion & (alt == "-"), "").otherwise(alt)
    mt = F.concat(prefix, middle, S.clamped(seq, at, at + FLANK))
    return d.withColumn("mt_pep", mt).withColumns({"wt_pep": S.clamped(seq, pos - FLANK, pos - FLANK + F.length("mt_pep")), "vtype": F.when(deletion, "DEL").otherwise("INS")})


def frameshift_regions(records: DataFrame) -> DataFrame:
    """Adds the genome regions (lead and tail, 0-based half open) whose bases, with the inserted ones between, are translated.

    Deletions and insertions only: records that replace bases by as many others shift no frame and are left out."""
    d = records.filter(F.col("consequence") == "frameshift_variant").withColumn("phase", F.pmod(F.col("cds_pos") - 1, F.lit(3)))
    deletion = (F.length("ref") > F.length("alt")) | (F.col("alt") == "-")
    d = d.filter(deletion | (F.length("ref") < F.length("alt")) | (F.col("ref") == "-"))
    reach = F.coalesce("cdna_end", "cdna_start") - F.col("cdna_start")
    tail = F.when(deletion, F.col("end")).otherwise(F.col("start"))
    return d.withColumns({"lead_start": F.greatest(F.col("start") - F.col("phase"), F.lit(0)), "lead_end": F.col("start"), "tail_start": tail, "tail_end": F.greatest(F.col("start") + reach - F.col("phase"), tail), "insert": F.when(deletion, "").otherwise(F.col("alt"))})


def frameshift_windows(regions: DataFrame, proteome: DataFrame) -> DataFrame:
    """Adds mt_pep and wt_pep; ``regions`` also has ``lead`` and ``tail`` bases."""
    d = regions.join(proteome, "transcript")
    prefix = S.clamped(F.col("seq"), F.col("protein_pos") - FLANK - 1, F.col("protein_pos") - 1)
    mt = F.concat(prefix, S.translate_codons(F.concat("lead", "insert", "tail")))
    return d.withColumn("mt_pep", mt).withColumns({"wt_pep": S.clamped(F.col("seq"), F.col("protein_pos") - FLANK - 1, F.col("protein_pos") - FLANK - 1 + F.length("mt_pep")), "vtype": F.lit("FSV")})


def usable(peptides: DataFrame, least: int = 8, equal: bool = True) -> DataFrame:
    """Distinct peptides of enough length, without stops, and (for variants) as long as their wild type."""
    ok = (F.length("mt_pep") >= least) & ~F.col("mt_pep").contains("*")
    if equal:
        ok = ok & (F.length("mt_pep") == F.length("wt_pep")) & ~F.col("wt_pep").contains("*")
    return peptides.filter(ok).dropDuplicates()


def variant_headers(peptides: DataFrame, moltype: str) -> DataFrame:
    """(header, seq) of mutant peptides."""
    ident = F.concat(F.col("vtype"), F.lit(f"_{moltype}"), F.col("line_no").cast("string"), F.when(F.col("vtype") == "SNV", "_B").otherwise(""))
    return peptides.select(F.concat(ident, F.lit(" WT="), "wt_pep", F.lit(" MT="), "mt_pep", F.lit(" TPM="), F.col("tpm").cast("string")).alias("header"), F.col("mt_pep").alias("seq"))


def fusion_windows(lines: DataFrame, abundance: DataFrame, tpm: float = 0.0) -> DataFrame:
    """Fusion prediction lines (line_no from 1 with the header, value; tab separated) to mutant peptides around the break."""
    t = lines.filter(F.col("line_no") > 1).withColumn("t", F.split("value", "\t")).filter(F.size("t") > 23)
    cell = lambda i: F.col("t")[i]
    d = t.filter((F.length(cell(23)) > 1) & cell(21).isin("FRAMESHIFT", "INFRAME")).select("line_no", cell(21).alias("frame"), cell(17).alias("left_id"), cell(19).alias("right_id"), F.split(F.trim(cell(18)), "-")[1].cast("int").alias("left_len"), cell(23).alias("cds"))
    side = lambda k, v: abundance.select(F.col("transcript").alias(k), F.col("tpm").alias(v))
    both = d.join(side("left_id", "t1"), "left_id").join(side("right_id", "t2"), "right_id").withColumn("tpm", (F.col("t1") + F.col("t2")) / 2).filter(F.col("tpm") >= tpm)
    short, frame = F.col("left_len") <= 30, F.col("frame") == "FRAMESHIFT"
    start = F.when(short, 0).otherwise((F.floor(F.col("left_len") / 3) - 9) * 3)
    end = F.when(frame, F.length("cds")).when(short, F.col("left_len") + 30).otherwise(start + 60)
    part = F.substring_index(F.trim(S.clamped(F.col("cds"), start.cast("int"), end.cast("int"))), "_", 1)
    return both.withColumns({"mt_pep": S.translate_codons(part), "vtype": F.lit("FUS")})


def novel_isoforms(junctions: DataFrame, isoforms: DataFrame) -> DataFrame:
    """Coding exons of the isoforms that a novel junction implies.

    A junction belongs to the isoforms whose transcript strictly contains it (joined by bins). Its class is the best
    over them: known (0, dropped), both sites known (1), one known (2), none (3); isoforms of that class are kept
    if the junction is inside the coding region and the changed exons have sound sizes."""
    from ..operators.joins import contained

    j = junctions.select("chrom", (F.col("intron_start") - 1).alias("js"), F.col("intron_stop").alias("je"))
    pairs = contained(j, isoforms.withColumnRenamed("chrom", "iso_chrom"), "js", "je", "tx_start", "tx_end", 65536.0).filter(F.col("chrom") == F.col("iso_chrom"))
    starts = F.transform("exon_starts", lambda s: s + F.col("tx_start"))
    d = pairs.withColumns({"starts": starts, "ends": F.zip_with(starts, F.col("exon_lens"), lambda s, n: s + n)})
    u, v = F.array_position("ends", F.col("js")), F.array_position("starts", F.col("je"))
    tag = F.when((u > 0) & (v > 0), F.when(v - u == 1, 0).otherwise(1)).when((u > 0) | (v > 0), 2).otherwise(3)
    d = d.withColumn("tag", tag)
    best = d.groupBy("chrom", "js", "je").agg(F.min("tag").alias("best"))
    d = d.join(best, ["chrom", "js", "je"]).filter((F.col("tag") == F.col("best")) & (F.col("best") > 0) & (F.col("js") > F.col("cds_start")) & (F.col("je") < F.col("cds_end")))
    d = d.withColumns({"up": F.size(F.filter("starts", lambda s: s < F.col("js"))), "down": F.size(F.filter("ends", lambda e: e <= F.col("je"))) + 1})
    d = d.filter((F.col("up") > 0) & (F.col("down") <= F.size("ends")))
    us, ue, ds, de = (F.element_at(c, F.col(i).cast("int")) for c, i in (("starts", "up"), ("ends", "up"), ("starts", "down"), ("ends", "down")))
    grow_up, grow_down = F.col("js") - ue, ds - F.col("je")
    sound = (F.col("je") - F.col("js") > MIN_INTRON) & (grow_up < MAX_EXON) & (grow_down < MAX_EXON) & (F.abs(grow_up) > MIN_EXON) & (F.abs(grow_down) > MIN_EXON) & (F.col("js") - us > MIN_EXON) & (de - F.col("je") > MIN_EXON)
    d = d.filter(sound)
    new_starts = F.concat(F.slice("starts", F.lit(1), F.col("up")), F.array(F.col("je")), F.slice("starts", F.col("down") + 1, F.size("starts")))
    new_ends = F.concat(F.slice("ends", F.lit(1), F.col("up") - 1), F.array(F.col("js")), F.slice("ends", F.col("down"), F.size("ends")))
    inside = lambda a: F.transform(F.filter(a, lambda x: (x > F.col("cds_start")) & (x < F.col("cds_end"))), lambda x: x - F.col("cds_start"))
    zero = F.array(F.lit(0).cast("long"))
    return d.select("chrom", "js", "je", "isoform", "protein", "gene", "strand", "cds_start", "cds_end", "tag", F.concat(zero, inside(new_starts)).alias("cds_starts"), F.concat(inside(new_ends), F.array(F.col("cds_end") - F.col("cds_start"))).alias("cds_ends"))


def exon_regions(isoforms: DataFrame) -> DataFrame:
    """(isoform key columns, exon, chrom, start, end) of coding exons, for genome slices."""
    e = F.arrays_zip(F.col("cds_starts").alias("s"), F.col("cds_ends").alias("e"))
    return isoforms.select("chrom", "isoform", "js", "je", "strand", "cds_start", F.posexplode(e).alias("exon", "x")).select("chrom", "isoform", "js", "je", "strand", "exon", (F.col("cds_start") + F.col("x.s")).alias("start"), (F.col("cds_start") + F.col("x.e")).alias("end"))


def isoform_proteins(exons: DataFrame) -> DataFrame:
    """(isoform, js, je, protein) from exon bases: joined in order, reversed on the minus strand, translated to the first stop; longer than 30."""
    g = exons.groupBy("chrom", "isoform", "js", "je", "strand").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("exon", "bases"))), lambda s: s["bases"])).alias("dna"))  # exons of one isoform
    dna = F.when(F.col("strand") == "-", S.reverse_complement(F.upper("dna"))).otherwise(F.upper("dna"))
    return g.select("chrom", "isoform", "js", "je", S.translate_codons(dna).alias("protein")).filter(F.length("protein") > MIN_PROTEIN)


def novel_kmers(proteins: DataFrame, normal: DataFrame, lengths: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """K-mers of novel proteins that no normal protein has; of repeated ones the row that is smallest by ``keep`` stays."""
    own = proteins.select(*keep, F.explode(F.flatten(F.array(*[S.kmers(F.col("protein"), k) for k in lengths]))).alias("kmer"))
    known = normal.select(F.explode(F.flatten(F.array(*[S.kmers(F.col("seq"), k) for k in lengths]))).alias("kmer"))
    return own.groupBy("kmer").agg(F.min(F.struct(*keep)).alias("b")).join(known, "kmer", "left_anti").select("kmer", "b.*")


def rpkm(counts: Column, exon_length: Column, library: Column) -> Column:
    return counts / exon_length / library * 1e9


def helper_peptides(fasta: DataFrame, attribute: str, prefix: str) -> DataFrame:
    """Self or wild-type helper records: each distinct peptide once, numbered in order, with the union of its alleles, sorted."""
    d = fasta.filter(F.col(attribute).isNotNull()).select(F.explode(F.split(attribute, r"\|")).alias("seq"), F.coalesce("HLA", F.array().cast("array<string>")).alias("HLA")).filter("seq <> ''")
    g = d.groupBy("seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("HLA")))).alias("HLA"))
    from ..sources.reports import row_numbers

    return row_numbers(g, ["seq"], prefix)


def expand_mutations(fasta: DataFrame, max_bits: float, skip: tuple[int, ...] = ()) -> DataFrame:
    """One record a neighbour within one substitution and ``max_bits``: (source, fid, seq, bits, edit); the peptide itself comes first."""
    from ..operators.align import substitution_loss

    n = fasta.select(F.col("fid").alias("source"), F.col("seq").alias("origin"), F.explode(S.neighbours(F.col("seq"), skip)).alias("seq"))
    d = n.withColumns({"bits": substitution_loss(F.col("origin"), F.col("seq")) * 0.5, "edit": S.overlap_hamming(F.col("origin"), F.col("seq"))}).filter(F.col("bits") <= max_bits)
    order = F.array_sort(F.collect_list(F.struct("edit", "bits", "seq")))
    g = d.groupBy("source", "origin").agg(order.alias("all"))  # at most 20 neighbours a residue
    return g.select("source", "origin", F.posexplode("all").alias("i", "x")).select("source", F.concat("source", F.lit("_"), F.col("i").cast("string")).alias("fid"), "x.*")


def expand_closure(fasta: DataFrame, max_bits: float, edits: int) -> DataFrame:
    """Substitution closure up to ``edits`` steps, by one expansion join a step and a distinct after each."""
    seen = fasta.select(F.col("fid").alias("source"), F.col("seq").alias("origin"), "seq").distinct()
    front = seen
    from ..operators.align import substitution_loss

    for _ in range(edits):
        step = front.select("source", "origin", F.explode(S.neighbours(F.col("seq"))).alias("seq")).filter((substitution_loss(F.col("origin"), F.col("seq")) * 0.5 <= max_bits) & (S.overlap_hamming(F.col("origin"), F.col("seq")) <= edits))
        front = step.distinct()
        seen = seen.union(front).distinct()
    return seen
