import itertools
import random

import pytest
from pyspark.sql import functions as F

from peptaflow.operators import align
from peptaflow.plans import candidates as C
from peptaflow.plans import features as P


def test_matrix_is_symmetric_and_complete():
    s = align.scores()
    assert len(s) == 20 * 20 + 41 and s["W", "W"] == 11 and s["A", "R"] == s["R", "A"] == -1 and s["V", "I"] == 3 and s["Y", "F"] == 3


def slow_local(a, b):
    s, best = align.scores(), 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        for n in range(1, min(len(a) - i, len(b) - j) + 1):
            best = max(best, sum(s[x, y] for x, y in zip(a[i : i + n], b[j : j + n], strict=True)))
    return best


def test_local_score():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ("".join(rng.choices("ACDWY", k=7)) for _ in range(2))
        assert align.local_score(a, b) >= slow_local(a, b)
    assert align.local_score("ACDEFGHIK", "ACDEFGHIK") == sum(align.scores()[r, r] for r in "ACDEFGHIK")
    assert align.local_score("WWWWWWAWWWWWW", "WWWWWWWWWWWW") == 12 * 11 - 11


def test_placement():
    assert align.place("CDE", "AACDEAA") == ("CDE", "CDE")
    assert align.place("CDE", "AACWEAA") == ("CDE", "CWE")
    a, b = align.place("KWWWWCDEFGH", "AAKWWWWACDEFGHAA")
    assert (a, b) == ("KWWWW-CDEFGH", "KWWWWACDEFGH")
    assert align.bit_distance("W-H", "WAH") == 8 and align.bit_distance("W--H", "WAAH") == 8.5 and align.bit_distance("A", "R") == 2.5


def test_substitution_columns(spark):
    df = spark.createDataFrame([("ACD", "ARD")], "a string, b string").select(align.substitution_loss(F.col("a"), F.col("b")).alias("d"), align.self_score(F.col("a")).alias("s"))
    assert tuple(df.first()) == (9 + 3, 4 + 9 + 6)


def lines(spark, rows):
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(rows)], "line_no long, value string")


PROTEIN = "".join(itertools.islice(itertools.cycle("ACDEFGHIKLMNPQRSTVWY"), 60))


def vep(pos, aa, consequence, allele="A/T", location="chr1:100", cdna="100/400", cds="30"):
    return "\t".join([f"chr1_100_{allele}", location, "T", "g", "T1.2", "Transcript", consequence, cdna, cds, str(pos), aa, "c", "-", "x"])


def test_missense_and_inframe(spark):
    ab = spark.createDataFrame([("T1", 5.0), ("T2", 1.0)], "transcript string, tpm double")
    prot = spark.createDataFrame([("T1", PROTEIN)], "transcript string, seq string")
    rows = ["#h", vep(30, f"{PROTEIN[29]}/W", "missense_variant"), vep(55, f"{PROTEIN[54]}/W", "missense_variant,x"), vep(5, f"{PROTEIN[4]}/W", "missense_variant"), vep(20, "-/WW", "inframe_insertion"), vep(20, "M/-", "inframe_deletion"), vep(30, "A", "synonymous_variant missense_variant")]
    rec = C.annotated_variants(lines(spark, rows), ab)
    m = {r["line_no"]: r for r in C.missense_windows(rec, prot).collect()}
    assert m[2]["mt_pep"] == PROTEIN[19:29] + "W" + PROTEIN[30:40] and m[2]["wt_pep"] == PROTEIN[19:40]
    assert m[3]["mt_pep"] == PROTEIN[39:54] + "W" + PROTEIN[55:] and m[3]["wt_pep"] == PROTEIN[39:]
    assert len(m[4]["mt_pep"]) == 26 and m[4]["wt_pep"] == PROTEIN[:21]
    assert {r["line_no"] for r in C.usable(C.missense_windows(rec, prot)).collect()} == {2, 3}
    i = {r["line_no"]: r for r in C.inframe_windows(rec, prot).collect()}
    assert i[5]["mt_pep"] == PROTEIN[9:19] + "WW" + PROTEIN[20:30]
    assert i[6]["mt_pep"] == PROTEIN[9:19] + PROTEIN[21:31] and i[6]["wt_pep"] == PROTEIN[10:30]
    head = C.variant_headers(C.missense_windows(rec, prot).filter("line_no = 2"), "D").first()["header"]
    assert head.startswith("SNV_D2_B WT=") and head.endswith("TPM=5.0")


def test_other_annotations(spark):
    ab = spark.createDataFrame([("T1", 5.0), ("T1.2", 6.0)], "transcript string, tpm double")
    ann = "|".join(["T", "missense_variant", "M", "g", "G", "transcript", "T1.2", "b", "1/2", "c.88A>T", "p.Ala30Trp", "100/400", "88/300", "30/100", "", ""])
    rows = ["#x", f"chr1\t100\t.\tA\tT\t9\tPASS\tDP=3;ANN={ann},{ann.replace('T1.2', 'T9.1')},{ann.replace('30/100', '31/100')},{ann.replace('missense', 'synonymous')}"]
    r = C.ann_variants(lines(spark, rows), ab).collect()
    assert [(x["line_no"], x["transcript"], x["protein_pos"], x["ref_aa"], x["alt_aa"], x["cds_pos"], x["tpm"]) for x in r] == [(2, "T1", 30, "A", "W", 88, 5.0)]
    f = [""] * 20
    f[2], f[3], f[4], f[5], f[8], f[10], f[12], f[16], f[18] = "chr1", "100", "100", "MISSENSE", "A", "T", "T1.2", "c.88A>T", "p.A30W"
    rows = [f"chr1\t100\t.\tA\tT\t9\tPASS\tDP=3;FUNCOTATION=[{'|'.join(f)}]", "chr1\t1\t.\tA\tT\t9\tPASS\tDP=3"]
    r = C.funcotated_missense(lines(spark, rows), ab).collect()
    assert [(x["line_no"], x["transcript"], x["protein_pos"], x["alt_aa"], x["tpm"]) for x in r] == [(1, "T1.2", 30, "W", 6.0)]
    prot = spark.createDataFrame([("T1.2", PROTEIN)], "transcript string, seq string")
    assert C.missense_windows(C.funcotated_missense(lines(spark, rows), ab), prot).first()["mt_pep"][10] == "W"


def test_frameshift(spark):
    ab = spark.createDataFrame([("T1", 5.0)], "transcript string, tpm double")
    prot = spark.createDataFrame([("T1", PROTEIN)], "transcript string, seq string")
    rec = C.annotated_variants(lines(spark, [vep(15, "A/X", "frameshift_variant", "-/G", "chr1:100-101", "100/112", "30")]), ab)
    reg = C.frameshift_regions(rec)
    r = reg.first()
    assert (r["phase"], r["lead_start"], r["lead_end"], r["tail_start"], r["tail_end"], r["insert"]) == (2, 98, 100, 100, 110, "G")
    out = C.frameshift_windows(reg.withColumns({"lead": F.lit("AT"), "tail": F.lit("GCCTAAGCC")}), prot).first()
    assert out["mt_pep"] == PROTEIN[4:14] + "MA" and len(out["wt_pep"]) == 12


def test_fusion(spark):
    ab = spark.createDataFrame([("L", 4.0), ("R", 8.0)], "transcript string, tpm double")
    cds = "atg" * 30
    row = [""] * 24
    row[17], row[18], row[19], row[21], row[23] = "L", "1-45", "R", "INFRAME", cds
    short = list(row)
    short[18], short[21], short[23] = "1-12", "FRAMESHIFT", "atg" * 12 + "_xx"
    out = {r["line_no"]: r for r in C.fusion_windows(lines(spark, ["h", "\t".join(row), "\t".join(short)]), ab, 6.0).collect()}
    assert out[2]["mt_pep"] == "M" * 20 and out[2]["tpm"] == 6.0 and out[3]["mt_pep"] == "M" * 12
    assert C.fusion_windows(lines(spark, ["h", "\t".join(row)]), ab, 6.5).count() == 0


def test_junctions_to_proteins(spark):
    iso = spark.createDataFrame([("chr1", 1000, 3000, "i1", "p1", "+", 1010, 2900, "g", [100, 100, 400], [0, 500, 1600])], "chrom string, tx_start long, tx_end long, isoform string, protein string, strand string, cds_start long, cds_end long, gene string, exon_lens array<int>, exon_starts array<int>")
    known = (("chr1", 1101, 1500), ("chr1", 1101, 2610), ("chr1", 1200, 1550), ("chr9", 1101, 1700))
    j = spark.createDataFrame(known, "chrom string, intron_start long, intron_stop long")
    out = C.novel_isoforms(j, iso).collect()
    assert {(r["js"], r["je"], r["tag"]) for r in out} == {(1199, 1550, 3)} | {(r["js"], r["je"], r["tag"]) for r in out if r["je"] == 2610}
    r = next(r for r in out if r["je"] == 1550)
    assert r["cds_starts"] == [0, 540, 1590] and r["cds_ends"] == [189, 590, 1890]
    regions = C.exon_regions(C.novel_isoforms(j, iso).filter("je = 1550"))
    prot = C.isoform_proteins(regions.withColumn("bases", F.repeat(F.lit("ATG"), 20))).first()
    assert prot["protein"] == "M" * 60
    nk = C.novel_kmers(spark.createDataFrame([("a", "ABCDEF"), ("b", "ABCDXX")], "id string, protein string"), spark.createDataFrame([("ZABCD",)], "seq string"), [4], ["id"])
    assert {(r["kmer"], r["id"]) for r in nk.collect()} == {("BCDE", "a"), ("CDEF", "a"), ("BCDX", "b"), ("CDXX", "b")}


def test_helpers_and_expansion(spark):
    f = spark.createDataFrame([("p1", "ACD", "WWW|YYY", ["B", "A"]), ("p2", "ACE", "YYY", ["C"]), ("p3", "ACE", None, None)], "fid string, seq string, ST string, HLA array<string>")
    h = {r["seq"]: (r["fid"], r["HLA"]) for r in C.helper_peptides(f, "ST", "SELF_").collect()}
    assert h == {"WWW": ("SELF_1", ["A", "B"]), "YYY": ("SELF_2", ["A", "B", "C"])}
    e = C.expand_mutations(f.filter("fid = 'p1'"), 2.0).orderBy("fid").collect()
    assert e[0]["fid"] == "p1_0" and e[0]["seq"] == "ACD" and all(r["bits"] <= 2.0 and r["edit"] <= 1 for r in e)
    one = {r["seq"] for r in C.expand_closure(f.filter("fid = 'p1'"), 2.0, 1).collect()}
    assert one == {r["seq"] for r in e}
    assert one < {r["seq"] for r in C.expand_closure(f.filter("fid = 'p1'"), 4.0, 2).collect()}


def test_best_matches_and_gather(spark):
    look = spark.createDataFrame([("E1", "A", 50.0), ("M1", "A", 20.0), ("M2", "A", 10.0), ("W1", "A", 400.0)], "pep string, mhc string, aff double")
    report = spark.createDataFrame([("E1", "A", 50.0), ("Z", "A", 1.0)], "Peptide string, MHC string, aff double")
    em = spark.createDataFrame([("E1", "M1", 1, 2.0), ("E1", "M2", 1, 2.0)], "ET_pep string, MT_pep string, hamming long, bits double")
    mw = spark.createDataFrame([("M2", "W1", 1, 1.0), ("M2", "W0", 0, 0.0), ("M1", "W9", 0, 0.0)], "MT_pep string, WT_pep string, hamming long, bits double")
    ms = spark.createDataFrame([], "MT_pep string, ST_pep string, hamming long, bits double")
    fact = P.best_matches(report, em, ms, mw, look)
    r = fact.first()
    assert fact.count() == 1 and (r["MT_pep"], r["MT_BindAff"], r["WT_pep"], r["WT_BindAff"], r["ST_pep"]) == ("M2", 10.0, "W0", 2.0**30, None)
    a = P.agretopicity(fact).first()
    assert a["ET_MT_Agretopicity"] == 5.0 and a["Agretopicity"] == 0.0
    assert P.filter_candidates(fact, 60, [2]).count() == 1 and P.filter_candidates(fact, 40, [2]).count() == 0
    same = fact.withColumn("WT_pep", F.col("MT_pep"))
    assert P.filter_candidates(same, 60, [2]).count() == 0 and P.filter_candidates(same, 60, [2], True).count() == 1
    stab = spark.createDataFrame([("E1", "A", 2.5, 1.0)], "pep string, mhc string, half_life double, rank_stab double")
    im = spark.createDataFrame([("E1", "A", 1.0, 2.0, 3.0)], "pep string, mhc string, rank double, score double, ba_rank double")
    pr = spark.createDataFrame([("E1", "A", 1.0, 2.0)], "pep string, mhc string, aff_percentile double, presentation_percentile double")
    g = P.gather(fact, stab, im, pr).first()
    assert g["BindStab"] == 2.5 and g["PRIME_rank"] is None and g["mhcflurry_aff_percentile"] is None  # too short for both
    with pytest.raises(Exception, match="no stability"):
        P.gather(fact, stab.limit(0), im, pr).collect()
    q = P.quantification(spark.createDataFrame([("E", "SNV_D1"), ("E", "SNV_D1"), ("E", "SNV_R1"), ("E", "FUS_R2")], "ET_pep string, fid string"), spark.createDataFrame([("SNV_D1", 3.0), ("SNV_R1", 4.0), ("FUS_R2", 2.0)], "fid string, TPM double"))
    assert q.first()["Quantification"] == 6.0


def test_variant_evidence(spark):
    rec = spark.createDataFrame([("c1", 10, "GA", ["G"]), ("c1", 50, "A", ["T"])], "chrom string, pos long, ref string, alts array<string>")
    vcf = spark.createDataFrame([("c1", 10, "GA", ["G"], 60.0, 5, 9), ("c1", 11, "A", ["-"], 70.0, 4, 3), ("c2", 50, "A", ["T"], 99.0, 1, 1)], "chrom string, pos long, ref string, alts array<string>, qual double, ref_depth int, alt_depth int")
    out = {r["pos"]: (r["qual"], r["ref_depth"], r["alt_depth"]) for r in P.variant_evidence(rec, vcf).collect()}
    assert out == {10: (70.0, 5.0, 9.0), 50: (0.0, 0.0, 0.0)}


def test_ranking(spark):
    rows = [(i, p, v) for i, (p, v) in enumerate([(0.9, 1), (0.8, 0), (float("nan"), 1), (0.95, None), (0.1, 1), (0.7, -1)])]
    d = spark.createDataFrame(rows, "id long, PredictedProbability double, VALIDATED int")
    out = {r["id"]: r for r in P.ranked(d, ["id"]).collect()}
    assert [out[i]["Rank"] for i in (3, 0, 1, 5, 4, 2)] == [1, 2, 3, 4, 5, 2**30]
    assert [out[i]["VALID_CUMSUM"] for i in (3, 0, 1, 5, 4)] == [0, 1, 1, 1, 2] and out[0]["VALID_N_TESTED"] == 4
    assert abs(out[4]["PROBA_CUMSUM"] - (0.9 + 0.8 + 0.1)) < 1e-12
    e = P.evaluation(P.ranked(d, ["id"])).first()
    assert e["top20"] == 3 and 0 <= e["auroc"] <= 1
    assert P.drop_sources(spark.createDataFrame([("SNV_D1",), ("SNV_R1",), ("FUS_R2",), ("SP_1",), (None,)], "Identity string")).count() == 2
    assert abs(P.with_tested_count(d).first()["ln_NumTested"] - 1.3862943611) < 1e-9
    assert P.tcr_pairs(spark.createDataFrame([("a",)], "x string"), spark.createDataFrame([("b",), ("c",)], "x string"), spark.createDataFrame([("P", "W", "M"), ("Q", "Q", "M")], "ET_pep string, WT_pep string, MHC string")).count() == 2


def test_base36_of_ids_with_more_than_four_digits(spark, tmp_path):
    from peptaflow.queries import QUERIES

    ids = [0, 35, 36, 1295, 1296, 46656, 36**4 - 1, 36**4, 36**5 + 7, 10**12]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["code"] for r in QUERIES["base36_ordinal"](spark, str(tmp_path)).collect()}
    assert set(got) == set(ids) and all(int(code, 36) == i for i, code in got.items())


def test_probability_of_tiers(spark):
    """Against a plain reading of the rules, row by row."""
    import itertools
    import math

    from peptaflow.plans import scores

    rows = []
    for i, (et, stab, q, f, a, level, kind, alt) in enumerate(itertools.product((10.0, 100.0, 500.0), (0.1, 2.0), (0.5, 20.0, 50.0), (0.0, 1e-9, 1.0), (0.05, 0.2, 0.5), ("SB", "WB", "NB"), ("SNV_D1", "FUS_R2"), (2, 30))):
        rows.append((i, et, et / 2, stab, q, f, a, level, kind, 10, alt))
    d = spark.createDataFrame(rows, "i long, ET_BindAff double, MT_BindAff double, BindStab double, Quantification double, Foreignness double, Agretopicity double, BindLevel string, Identity string, DNA_refDP int, DNA_altDP int")
    for strength, passed in ((0, 0), (-1, 1), (1, 0)):
        got = {r["i"]: r for r in scores.immunogenic_probability(d, strength, passed=passed).collect()}
        for i, et, mt, stab, q, f, a, level, kind, ref, alt in rows:
            small = kind.startswith("SNV_")
            unforeign = f <= 1e-16 and a >= 0.1
            t2, t1 = (et >= 231) + (stab <= 0.13) + (q <= 1), (et >= 21) + (stab <= 1.4) + (q <= 11)
            t0 = (et >= 21) + (stab <= 1.4) + (q <= 33) + unforeign
            dna = ((alt < 5) + (alt < (ref + alt) * 0.1)) * small * (1 - (passed & 1))
            bind = {"SB": 0, "WB": 3, "NB": 6}[level]
            x = 21 / (21 + mt) + max(int(t0 == 0), strength) - (f <= 1e-16) * (strength < 0) * 3 - t1
            x -= 4 * (et >= 231) + 3 * (stab <= 0.13) + 5 * (q <= 1) + (dna > 0) * 3 + bind
            x -= (f <= 1e-8 and a >= math.sqrt(0.1)) * (t2 > 0 or bind > 0 or dna > 0)
            x += -1.5 if small else -4.5
            r = got[i]
            assert (r["PresentationPreFilters"], r["PresentationFilters"], r["RecognitionalFilters"]) == (t2, t1, t0)
            assert abs(r["Probability"] - 1 / (1 + 2.0**-x)) < 1e-12


def test_immuno_strength(spark):
    from peptaflow.plans import scores

    schema = "ET_BindAff double, MT_BindAff double, BindStab double, Quantification double, Foreignness double, Agretopicity double, BindLevel string, Identity string, DNA_refDP int, DNA_altDP int, RNA_normAD double"
    made = lambda known, foreign: spark.createDataFrame([(10.0, 10.0, 2.0, 50.0, 0.0 if k else 1.0, 0.5, "SB", "SNV_D1", 1, 9, v) for k, part in ((True, known), (False, foreign)) for v in part], schema)
    low, high = [float(i) for i in range(20)], [100.0 + i for i in range(20)]
    assert [scores.immuno_strength(made(*x)) for x in ((low, high), (high, low), (low, low), (low, []))] == [-1, 1, 0, 0]


def test_expansion_counts(spark):
    rows = [("ACD", "AKD", 5.0, 7.0), ("AWD", "AKD", 9.0, 7.0), ("AYD", "AKD", 7.0, 7.0), ("AKD", "AKD", 1.0, 7.0), ("ACD", "AKD", 6.0, 7.0)]
    e = P.expansion(spark.createDataFrame(rows, "ET_pep string, MT_pep string, ET_BindAff double, MT_BindAff double")).collect()
    assert len(e) == 4 and {r["NmAff"] for r in e} == {7.0}
    assert {(r["ET_pep"], r["n_less"], r["n_not_less"], r["n_less_et"], r["n_not_less_et"]) for r in e} == {("ACD", 1, 2, 0, 3), ("AWD", 1, 2, 2, 1), ("AYD", 1, 2, 1, 2)}


def test_evidence_window_and_replacements(spark):
    rec = spark.createDataFrame([("c1", 10, "A" * 30 + "G", ["A" * 30 + "T"])], "chrom string, pos long, ref string, alts array<string>")
    vcf = spark.createDataFrame([("c1", 40, "G", ["T"], 60.0, 5, 9)], "chrom string, pos long, ref string, alts array<string>, qual double, ref_depth int, alt_depth int")
    assert P.variant_evidence(rec, vcf).first()["qual"] == 0.0
    assert P.variant_evidence(rec, vcf, 100).first()["qual"] == 60.0
    ab = spark.createDataFrame([("T1", 5.0)], "transcript string, tpm double")
    same = C.annotated_variants(lines(spark, [vep(15, "A/X", "frameshift_variant", "A/G", "chr1:100-101", "100/112", "30")]), ab)
    assert C.frameshift_regions(same).count() == 0


def test_windows_of_a_text(spark):
    from peptaflow.functions import sequences as S

    texts = ["abcdef", "ab", "", None, "a\nb\r🙂c🙂d", "漢字かな"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(S.kmers(F.col("t"), 3)).collect()] == [[t[i : i + 3] for i in range(len(t) - 2)] if t else [] for t in texts]


def test_seed_pairs_either_way(spark):
    from peptaflow.operators import joins

    q = spark.createDataFrame([(1, "abcabcabc"), (2, "zzzz"), (3, None)], "q long, t string")
    s = spark.createDataFrame([(i, x) for i, x in enumerate(["xxabcab", "bca", "zz", "", None, "abcabc"])], "s long, t string")
    want = {(1, 0, 3), (1, 1, 1), (1, 5, 3)}
    for most in (10**6, 0):
        p = joins.seed_pairs(q, s, "q", "t", "s", "t", 3, broadcast_rows=most)
        assert {(r["q"], r["s"], r["seeds"]) for r in p.collect()} == want
        assert [tuple(r) for r in joins.best_subject(p, "q", "s").collect()] == [(1, 0, 3)]
