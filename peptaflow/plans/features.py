"""Relations between peptides, feature gathering, and the ranked result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.missing import BIG_INT, ieee_div
from ..functions.sequences import mark_changes, norm_mhc, wildcard
from ..operators import joins
from ..operators.align import aligned_pairs
from ..operators.statistics import average_precision, auroc, top_hits
from ..operators.windows import running


def relation_edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Edges with hamming and bit distances of the placement of ``left`` in ``right``."""
    return aligned_pairs(pairs.select(left, right).distinct().dropna(), left, right)


def quantification(et_fid: DataFrame, tpm: DataFrame) -> DataFrame:
    """(ET_pep, Quantification): the larger of the sums over records that are not of DNA and not of RNA; each record counts once.

    ``et_fid``: (ET_pep, fid); ``tpm``: (fid, TPM)."""
    mol = F.substring(F.split("fid", "_")[1], 1, 1)
    once = et_fid.select("ET_pep", "fid").distinct().join(tpm, "fid").withColumn("mol", F.coalesce(mol, F.lit("")))
    part = lambda m: F.sum(F.when(F.col("mol") != m, F.col("TPM")).otherwise(0.0))
    return once.groupBy("ET_pep").agg(F.greatest(part("D"), part("R")).alias("Quantification"))


def best_partner(candidates: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """The least of (hamming, bits, affinity, peptide) a key, as ``<name>_pep`` and ``<name>_BindAff``."""
    best = F.min(F.struct("hamming", "bits", "aff", F.col("pep"))).alias("b")
    return candidates.groupBy(*key).agg(best).select(*key, F.col("b.pep").alias(f"{name}_pep"), F.col("b.aff").alias(f"{name}_BindAff"))


def with_affinity(df: DataFrame, lookup: DataFrame, pep: str, mhc: str) -> DataFrame:
    """Adds ``aff`` of (peptide, allele), 2^30 where unknown."""
    keyed = lookup.select(F.col("pep").alias("_p"), F.col("mhc").alias("_m"), "aff")
    return df.join(keyed, (F.col(pep) == F.col("_p")) & (F.col(mhc) == F.col("_m")), "left").drop("_p", "_m").withColumn("aff", F.coalesce("aff", F.lit(float(BIG_INT))))


def best_matches(report: DataFrame, et_mt: DataFrame, mt_st: DataFrame, mt_wt: DataFrame, lookup: DataFrame) -> DataFrame:
    """The fact table (ET_pep, MHC, ET_BindAff, best MT, and that MT's best ST and WT with their affinities).

    ``report``: (Peptide, MHC, aff); edges: (left peptide, right peptide, hamming, bits). Rows whose peptide is no known ET are left out."""
    base = report.join(et_mt.select(F.col("ET_pep").alias("Peptide")).distinct(), "Peptide", "left_semi").select(F.col("Peptide").alias("ET_pep"), "MHC", F.col("aff").alias("ET_BindAff"))
    mt = with_affinity(base.join(et_mt, "ET_pep"), lookup, "MT_pep", "MHC")
    fact = base.join(best_partner(mt.withColumn("pep", F.col("MT_pep")), ["ET_pep", "MHC"], "MT"), ["ET_pep", "MHC"])
    for name, edges in (("ST", mt_st), ("WT", mt_wt)):
        keys = fact.select("MT_pep", "MHC").distinct()
        side = with_affinity(keys.join(edges.withColumnRenamed(f"{name}_pep", "pep"), "MT_pep"), lookup, "pep", "MHC")
        fact = fact.join(best_partner(side, ["MT_pep", "MHC"], name), ["MT_pep", "MHC"], "left").withColumn(f"{name}_BindAff", F.coalesce(f"{name}_BindAff", F.lit(float(BIG_INT))))
    return fact


def filter_candidates(fact: DataFrame, affinity: float, lengths: Sequence[int], keep_wt: bool = False) -> DataFrame:
    """Affinity at most the threshold, wanted lengths, and (unless kept) MT and ET other than WT; a missing WT differs from everything."""
    ok = (F.col("ET_BindAff") <= affinity) & F.length("ET_pep").isin(*lengths)
    if not keep_wt:
        ok = ok & ~F.col("MT_pep").eqNullSafe(F.col("WT_pep")) & ~F.col("ET_pep").eqNullSafe(F.col("WT_pep"))
    return fact.filter(ok)


def prune_peptides(kmers: DataFrame, lookup: DataFrame, pep: str, affinity: float, rescued: DataFrame | None = None) -> DataFrame:
    """Drops peptides whose least affinity over alleles exceeds the threshold; unknown and rescued ones stay."""
    weak = lookup.groupBy("pep").agg(F.min("aff").alias("least")).filter(F.col("least") > affinity).select(F.col("pep").alias(pep))
    if rescued is not None:
        weak = weak.join(rescued.select(pep), pep, "left_anti")
    return kmers.join(weak, pep, "left_anti")


def agretopicity(fact: DataFrame) -> DataFrame:
    """Ratios of affinities, to five digits."""
    r = lambda a, b: numbers.half_even(ieee_div(F.col(a), F.col(b)))
    return fact.withColumns({"ET_MT_Agretopicity": r("ET_BindAff", "MT_BindAff"), "ST_Agretopicity": r("MT_BindAff", "ST_BindAff"), "Agretopicity": r("MT_BindAff", "WT_BindAff")})


def gather(fact: DataFrame, stability: DataFrame, immunogenicity: DataFrame, presentation: DataFrame) -> DataFrame:
    """Looks up stability (must be known), immunogenicity (lengths 8 to 14) and presentation (5 to 15) of (ET_pep, MHC)."""
    d = fact.withColumn("_n", norm_mhc(F.col("MHC")))
    st = stability.select(F.col("pep").alias("ET_pep"), F.col("mhc").alias("MHC"), F.col("half_life").alias("BindStab"))
    d = d.join(st, ["ET_pep", "MHC"], "left").withColumn("BindStab", F.when(F.col("BindStab").isNull(), F.raise_error(F.concat(F.lit("no stability of "), "ET_pep", F.lit(" "), "MHC")).cast("double")).otherwise(F.col("BindStab")))
    n = F.length("ET_pep")
    im = immunogenicity.select(F.col("pep").alias("ET_pep"), F.col("mhc").alias("_n"), F.col("rank").alias("PRIME_rank"), F.col("score").alias("PRIME_score"), F.col("ba_rank").alias("PRIME_BArank"))
    d = joins.lookup(d, im, ["ET_pep", "_n"], {"PRIME_rank": None, "PRIME_score": None, "PRIME_BArank": None}, n.between(8, 14))
    pr = presentation.select(F.col("pep").alias("ET_pep"), F.col("mhc").alias("_n"), F.col("aff_percentile").alias("mhcflurry_aff_percentile"), F.col("presentation_percentile").alias("mhcflurry_presentation_percentile"))
    return joins.lookup(d, pr, ["ET_pep", "_n"], {"mhcflurry_aff_percentile": None, "mhcflurry_presentation_percentile": None}, n.between(5, 15)).drop("_n")


def variant_evidence(records: DataFrame, vcf: DataFrame, window: int = 6) -> DataFrame:
    """Adds to (chrom, pos, ref, alts) the greatest quality and depths over leniently equal variants of the same trimmed position, 0 if none.

    Positions are 0-based. Only variants count whose bases reach into the ``window`` positions around the record."""
    trim = lambda df, p: df.select("*", numbers.trimmed_alleles(F.col("pos"), F.col("ref"), F.col("alts")).alias("_v")).select(*[c for c in df.columns if c not in ("pos", "ref", "alts")], *[F.col(f"_v.{k}").alias(f"{p}{k}") for k in ("pos", "ref", "alts")])
    a = trim(records.withColumn("_at", F.col("pos")).withColumn("_id", F.xxhash64("chrom", "pos", "ref", F.concat_ws(",", "alts"))), "_a_")
    b = trim(vcf.select("chrom", "pos", "ref", "alts", "qual", "ref_depth", "alt_depth", F.col("pos").alias("_from"), (F.col("pos") + F.length("ref")).alias("_to")), "_b_").withColumnRenamed("chrom", "_c")
    same = (F.col("chrom") == F.col("_c")) & (F.col("_a_pos") == F.col("_b_pos")) & numbers.lenient_equal(F.col("_a_ref"), F.col("_a_alts"), F.col("_b_ref"), F.col("_b_alts")) & (F.col("_from") < F.col("_at") + 1 + window) & (F.col("_to") > F.col("_at") + 1 - window)
    met = a.select("_id", "_at", "chrom", "_a_pos", "_a_ref", "_a_alts").distinct().join(b, same)
    top = met.groupBy("_id").agg(*[F.greatest(F.lit(0.0), F.max(F.col(c).cast("double"))).alias(c) for c in ("qual", "ref_depth", "alt_depth")])
    out = records.withColumn("_id", F.xxhash64("chrom", "pos", "ref", F.concat_ws(",", "alts"))).join(top, "_id", "left").drop("_id")
    return out.fillna(0.0, ["qual", "ref_depth", "alt_depth"])


def annotation_lines(fact: DataFrame, dna: DataFrame, rna: DataFrame) -> DataFrame:
    """Joins rows (moltype, lineno) to the annotation line of their source, by physical line number."""
    tagged = dna.select(F.lit("D").alias("moltype"), F.col("line_no").alias("lineno"), F.col("value").alias("annotation")).unionByName(rna.select(F.lit("R").alias("moltype"), F.col("line_no").alias("lineno"), F.col("value").alias("annotation")))
    return fact.join(tagged, ["moltype", "lineno"], "left")


def foreignness(alignments: DataFrame) -> DataFrame:
    """(pep, Foreignness): recognition of the scores of each peptide's alignments. ``alignments``: (pep, score)."""
    s = F.sum(F.exp(-4.86936 * (26.0 - F.col("score"))))
    return alignments.groupBy("pep").agg((s / (1 + s)).alias("Foreignness"))


def presentation_information(fact: DataFrame, motifs: DataFrame, pep: str, mhc: str) -> DataFrame:
    """(peptide, allele, info): motif bits summed over the positions. ``motifs``: long (mhc, len, pos, letter, bits); unknown letters count 0."""
    keys = fact.select(pep, mhc).distinct().withColumn("len", F.length(pep))
    spread = keys.select(pep, mhc, "len", F.posexplode(F.filter(F.split(pep, ""), lambda x: x != "")).alias("pos", "letter"))
    m = motifs.select(F.col("mhc").alias(mhc), "len", "pos", "letter", "bits")
    return spread.join(m, [mhc, "len", "pos", "letter"], "left").groupBy(pep, mhc).agg(F.sum(F.coalesce("bits", F.lit(0.0))).alias("info"))


def counts_below(values: DataFrame, marks: DataFrame, group: str, value: str, mark: str, less: str, rest: str) -> DataFrame:
    """Adds to ``marks`` how many ``values`` of the group are below the mark, and how many are not; by a running count, so no group is paired with itself."""
    v = values.select(group, F.col(value).cast("double").alias("_x"), F.lit(1).alias("_v"))
    levels = v.groupBy(group, "_x").agg(F.sum("_v").alias("_n"))
    asked = marks.select(group, F.col(mark).cast("double").alias("_x")).distinct().withColumn("_n", F.lit(0))
    # one row a level: the levels of a group are summed in order, not the rows
    steps = levels.select(group, "_x", "_n").unionByName(asked.select(group, "_x", F.col("_n").cast("long"))).groupBy(group, "_x").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(group).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    below = steps.withColumn(less, F.coalesce(F.sum("_n").over(w), F.lit(0)))
    total = levels.groupBy(group).agg(F.sum("_n").alias("_all"))
    met = marks.join(below.drop("_n"), (marks[group].eqNullSafe(below[group])) & (F.col(mark).cast("double") == F.col("_x"))).drop(below[group], "_x")
    return met.join(total, group).withColumn(rest, F.col("_all") - F.col(less)).drop("_all")


def expansion(fact: DataFrame) -> DataFrame:
    """Rows whose ET differs from MT, with the changes marked and the wildcard form, and how it compares within its wildcard.

    NmAff: mean of the least affinities of the wildcard's ET peptides; n_less, n_not_less: how many of them bind
    below the MT peptide's least affinity and how many do not; n_less_et, n_not_less_et: the same for the ET peptide's."""
    d = fact.filter(F.col("ET_pep") != F.col("MT_pep")).withColumn("EXpep", mark_changes(F.col("ET_pep"), F.col("MT_pep")))
    d = d.withColumn("wild", wildcard(F.col("EXpep")))
    et = d.groupBy("wild", "ET_pep").agg(F.min("ET_BindAff").alias("least"))
    w = et.groupBy("wild").agg(F.avg("least").alias("NmAff"))
    mt = d.groupBy("wild", "MT_pep").agg(F.min("MT_BindAff").alias("mt_least"))
    versus_mt = counts_below(et, mt, "wild", "least", "mt_least", "n_less", "n_not_less").drop("mt_least")
    versus_et = counts_below(et, et.withColumnRenamed("least", "et_least"), "wild", "least", "et_least", "n_less_et", "n_not_less_et").drop("et_least")
    return d.join(w, "wild").join(versus_mt, ["wild", "MT_pep"]).join(versus_et, ["wild", "ET_pep"])


def tested_flags(df: DataFrame) -> Column:
    """1 for rows that count: tested ones, else strong binders, else all."""
    if "VALIDATED" in df.columns:
        return F.coalesce((F.col("VALIDATED") >= 0).cast("int"), F.lit(0))
    if "MT_BindAff" in df.columns:
        return F.coalesce((F.col("MT_BindAff") < 500).cast("int"), F.lit(0))
    return F.lit(1)


def with_tested_count(df: DataFrame) -> DataFrame:
    """Adds ln_NumTested of the whole frame (0 if none counts)."""
    total = df.agg(F.sum(tested_flags(df)).alias("_n"))
    return df.join(F.broadcast(total)).withColumn("ln_NumTested", F.when(F.col("_n") > 0, F.log("_n")).otherwise(0.0)).drop("_n")  # one row


def patient_tested_count(df: DataFrame, patient: str, label: str) -> DataFrame:
    n = F.count_if(F.col(label) >= 0)
    per = df.groupBy(patient).agg(F.log(F.greatest(F.lit(1), n)).alias("ln_NumTested"))
    return df.join(per, patient)


def prepare(df: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Drops rows without trace (where there is such a column), fills agretopicity, keeps lengths."""
    if "PepTrace" in df.columns:
        df = df.dropna(subset=["PepTrace"]).fillna({"Agretopicity": 1e-9})
    return df.filter(F.length("ET_pep").isin(*lengths))


def drop_sources(df: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Drops RNA-only small variants, fusions and splicing by the prefix of Identity, unless allowed."""
    out = F.lit(False)
    for name, prefixes in {"rna": ("SNV_R", "FSV_R", "INS_R", "DEL_R"), "fusion": ("FUS_",), "splicing": ("SP_",)}.items():
        if name not in allowed:
            for p in prefixes:
                out = out | F.col("Identity").startswith(p)
    return df.filter(~F.coalesce(out, F.lit(False)))


def ranked(scored: DataFrame, tie: Sequence[Column | str], probability: str = "PredictedProbability") -> DataFrame:
    """The result table: Rank, counts of tested rows and running sums in rank order."""
    flags = tested_flags(scored)
    valid = F.coalesce(F.col("VALIDATED"), F.lit(0)) * F.col("_in") if "VALIDATED" in scored.columns else F.lit(-1)
    d = scored.withColumn("_in", flags).withColumn("_p", F.when(~F.isnan(probability), F.col(probability)))
    specs = {"Rank": ("count", F.lit(1)), "PROBA_CUMSUM": ("sum", F.coalesce("_p", F.lit(0.0)) * F.col("_in"))}
    if "VALIDATED" in scored.columns:
        specs["VALID_CUMSUM"] = ("sum", valid)
    out = running(d, [F.desc_nulls_last("_p"), *tie], specs).withColumn("Rank", F.when(F.col("_p").isNull(), F.lit(BIG_INT)).otherwise(F.col("Rank")).cast("int"))
    if "VALIDATED" in scored.columns:
        total = d.agg(F.sum("_in").alias("VALID_N_TESTED"))
        out = out.join(F.broadcast(total))  # one row
    else:
        out = out.withColumns({"VALID_N_TESTED": F.lit(-1), "VALID_CUMSUM": F.lit(-1)})
    return out.withColumn("ML_pipeline", F.lit("default_ML_pipe")).drop("_in", "_p")


def evaluation(result: DataFrame) -> DataFrame:
    """One row of metrics of a ranked table with labels 0 and 1."""
    d = result.filter(F.col("VALIDATED").isin(0, 1))
    y = F.col("VALIDATED")
    return top_hits(d, ["Rank"], y).crossJoin(auroc(d, -F.col("Rank"), y)).crossJoin(average_precision(d, -F.col("Rank"), y))  # single rows


def validation_join(truth: DataFrame, features: DataFrame, patient: str | None = None) -> DataFrame:
    """Truth rows of a patient (or of ids that begin with it), joined to their features by peptide and allele."""
    t = truth.filter(F.col("PatientID").startswith(patient)) if patient else truth
    key = lambda d, p: d.withColumn("_k", F.concat(F.col(p), F.lit("/"), norm_mhc(F.col("HLA_type"))))
    f = key(features, "ET_pep").drop("HLA_type", "MT_pep")
    return key(t, "MT_pep").join(f, "_k", "left").drop("_k")


def best_row_join(truth: DataFrame, features: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Truth joined to the best feature row of its MT peptide."""
    w = Window.partitionBy("MT_pep").orderBy(*order)
    best = features.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return truth.join(best.drop(*[c for c in best.columns if c in truth.columns and c != "MT_pep"]), "MT_pep", "left")


def tcr_pairs(alpha: DataFrame, beta: DataFrame, peptides: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Every alpha with every beta chain and peptide (peptides that equal their wild type are left out).

    The chains are those of one sample; their pairs are counted first, and more than ``most`` are refused."""
    n = alpha.limit(most + 1).count() * beta.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{n} or more pairs of chains, at most {most} are paired with every peptide")
    p = peptides.filter(~F.col("ET_pep").eqNullSafe(F.col("WT_pep"))).select("ET_pep", "MHC")
    a = alpha.select(*[F.col(c).alias(f"a_{c}") for c in alpha.columns])
    b = beta.select(*[F.col(c).alias(f"b_{c}") for c in beta.columns])
    return p.crossJoin(F.broadcast(a.crossJoin(F.broadcast(b))))  # at most ``most`` rows
