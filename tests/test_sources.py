import pytest
from pyspark.sql import functions as F

from peptaflow.sources import fasta, reports


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


FASTA = ">p1 WT=AAA TPM=3 HLA=A,B\nACD\nEFG\n>p2 x=y=z TPM=0.5\nACDU\n>p3 TPM=1 TPM=2\nACD*\n>p2\nKLM"


def test_fasta(spark, put, tmp_path):
    f = fasta.read_fasta(spark, put("a.fa", FASTA))
    rows = {(r["fid"], r["seq"]): r["attrs"] for r in f.filter("fid <> 'p3'").select("fid", "seq", "attrs").collect()}
    assert rows == {("p1", "ACDEFG"): {"WT": "AAA", "TPM": "3", "HLA": "A,B"}, ("p2", "ACDU"): {"TPM": "0.5"}, ("p2", "KLM"): {}}
    f = f.filter("fid <> 'p3'")
    assert [r["fid"] for r in fasta.duplicate_ids(f).collect()] == ["p2"]
    t = {r["seq"]: r for r in fasta.typed_attributes(f).collect()}
    assert t["ACDEFG"]["HLA"] == ["A", "B"] and t["KLM"]["TPM"] == 0.0 and t["KLM"]["WT"] is None
    kept = fasta.keep_expressed(f, 0.4, "C")
    assert [(r["fid"], r["attrs"]["HLA"]) for r in kept.collect()] == [("p1", "C")]
    filled = {r["seq"]: r["header"] for r in fasta.with_attribute(f, "HLA", "Z").collect()}
    assert filled["KLM"] == "p2 HLA=Z" and filled["ACDEFG"].endswith("HLA=A,B")
    fasta.write_fasta(f, str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).count() == 3
    fasta.write_fasta_by(f, F.coalesce(F.try_element_at("attrs", F.lit("HLA")), F.lit("none")), str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"part=A_B", "part=none"}


def test_genome_slices(spark, put):
    blocks = fasta.read_genome_blocks(spark, put("g.fa", ">c1\nACGTACGTAC\nGTTT\n>c2\nGG"), 4)
    want = {("c1", 2, 11): "GTACGTACG", ("c1", 0, 4): "ACGT", ("c2", 0, 2): "GG", ("c1", 12, 14): "TT"}
    regions = spark.createDataFrame(list(want), "chrom string, start long, end long")
    assert {(r["chrom"], r["start"], r["end"]): r["bases"] for r in fasta.genome_slices(regions, blocks, 4).collect()} == want


HEAD15 = " Pos HLA Peptide Core Of Gp Gl Ip Il Icore Identity Score_EL %Rank_EL Aff(nM) BindLevel"


def test_affinity_report(spark, put):
    row = " 1 HLA-A02:01 ACDUF c 0 0 0 0 0 i SNV_D1 0.5 1.0 33.5"
    path = put("r.txt", "\n".join(["# note", HEAD15, "---", row, row.replace("ACDUF", "KLMNP") + " <= SB", HEAD15, "Protein x"]))
    r = {x["Peptide"]: x for x in reports.read_affinity(spark, path).collect()}
    assert set(r) == {"ACDXF", "KLMNP"} and r["ACDXF"]["BindLevel"] == "NB" and r["KLMNP"]["BindLevel"] == "SB" and r["KLMNP"]["MHC"] == "HLA-A02:01"
    assert reports.affinity_lookup(reports.read_affinity(spark, path)).filter("aff = 33.5").count() == 2
    with pytest.raises(ValueError):
        reports.read_affinity(spark, put("bad.txt", HEAD15 + "\n" + HEAD15.replace("Core", "Other")))
    with pytest.raises(Exception, match="invalid line"):
        reports.read_affinity(spark, put("bad2.txt", HEAD15 + "\n 1 2 3")).collect()


def test_other_reports(spark, put):
    head = " " + " ".join(reports.STABILITY)
    line = " 1 HLA-A ACD x p {} 2.5 a b c d e"
    s = reports.read_stability(spark, put("s.txt", "\n".join([head, line.format("1.0"), line.format("7.5"), "other"]))).collect()
    assert [(r["pep"], r["mhc"], r["half_life"], r["rank_stab"]) for r in s] == [("ACD", "HLA-A", 7.5, 2.5)]
    p = reports.read_immunogenicity(spark, put("p.txt", "# c\nPeptide a b c d %Rank_A0201 Score_A0201 BA_A0201 %Rank_B0702 Score_B0702 BA_B0702\n\nACD 1 2 3 4 .1 .2 .3 .4 .5 .6\n")).collect()
    assert {(r["mhc"], r["rank"], r["score"], r["ba_rank"]) for r in p} == {("A0201", 0.1, 0.2, 0.3), ("B0702", 0.4, 0.5, 0.6)}
    f = reports.read_presentation(spark, put("f.csv", "peptide,best_allele,affinity_percentile,presentation_percentile\nACD,HLA-A*02:01,1,2\n")).collect()
    assert [tuple(r) for r in f] == [("ACD", "A0201", 1.0, 2.0)]
    b = reports.read_alignments(spark, put("b.csv", "q,s,AC,1,2,AC,3,4,2,0,100,0.1,20.5\n")).first()
    assert b["bitscore"] == 20.5 and b["qstart"] == 1
    j = reports.read_junctions(spark, put("j.txt", "chrom a b c d e f g h\nchr1 5 9 + 1 0 12 0 3\nchrUn 5 9 + 1 0 12 0 3\nchr2\t5\t9\t+\t1\t0\t2\t0\t3\n"), 5).collect()
    assert [(r["chrom"], r["intron_start"]) for r in j] == [("chr1", 5)]
    v = reports.read_vcf(spark, put("v.vcf", "##h\n#C\nchr1\t10\t.\tGAT\tGA,<DEL>\t70\tPASS\ttAD=10,5;nAD=9,0\nchr1\t11\t.\tA\tT\t10\tPASS\tdiRDm=4;diADm=6\n"))
    assert [(r["pos"], r["alts"], r["ref_depth"], r["alt_depth"]) for r in v.orderBy("pos").collect()] == [(9, ["GA", "<DEL>"], 10, 5), (10, ["T"], 4, 6)]
    assert [r["pos"] for r in reports.passing_variants(v, 63, 5, 0.1, 0.05).collect()] == [9]
    h = spark.createDataFrame([("A*01", "A*01", "None"), ("B*07", None, "C*1")], "A1 string, A2 string, B1 string")
    assert [r[0] for r in reports.read_hla_types(h, ["A1", "A2", "B1"]).collect()] == ["HLA-A01", "HLA-B07", "HLA-C1"]
    a = reports.read_abundance(spark, put("k.tsv", "target_id\tlen\ttpm\nT1.12\t5\t2.5\nT1.9\t5\t9\nT2\t1\tx\n"))
    assert {(r["transcript"], r["tpm"]) for r in a.collect()} == {("T1", 2.5), ("T2", None)}
    assert reports.read_tcr_scores(spark, "/nowhere/at/all.csv").collect() == []
    assert reports.read_tcr_scores(spark, put("t.csv", "0,1,2,3,4,5,6,PEP,M,0.5\n0,1,2,3,4,5,6,PEP,M,0.9\n")).first()["score"] == 0.9
    m = reports.read_motif_pairs(spark, put("m.txt", "Allele Peptide\nA AC\nB\tCD\n")).collect()
    assert {tuple(r) for r in m} == {("A", "AC"), ("B", "CD")}
    n = reports.numbered_lines(spark, put("n.txt", "#a\nb\r\nc")).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in n] == [(1, "#a"), (2, "b"), (3, "c")]


def test_tables(spark, put, tmp_path):
    assert reports.sniff_separator("a,b,c,d,e") == "," and reports.sniff_separator("a\tb\tc\td\te") == "\t"
    with pytest.raises(ValueError):
        reports.sniff_separator("a;b")
    t = reports.read_table(spark, put("t.csv", "a,b,c,d,e\n1,NA,3,4,5\n"))
    assert t.first()["b"] is None
    reports.write_table(t, str(tmp_path / "o"))
    assert reports.read_table(spark, str(tmp_path / "o"), "\t").first()["b"] is None
    reports.write_top(t, str(tmp_path / "top"), ["a"])
    assert list((tmp_path / "top").glob("*.gz"))
    assert reports.formatted(spark.createDataFrame([(0.123456789,)], "x double"), {"x": "%.5f"}).first()["x"] == "0.12346"
    assert reports.missed_lookups(t, t.filter("a > 5"), ["a"]).count() == 1


def test_last_and_first_rows(spark, put):
    row = " 1 HLA-A02:01 ACDUF c 0 0 0 0 0 i SNV_D1 0.5 1.0 {}"
    path = put("r2.txt", "\n".join([HEAD15, row.format("90.0"), row.format("20.0")]))
    assert [r["aff"] for r in reports.affinity_lookup(reports.read_affinity(spark, path)).collect()] == [20.0]
    f = reports.read_presentation(spark, put("f2.csv", "peptide,best_allele,affinity_percentile,presentation_percentile\nACD,HLA-A*02:01,9,9\nACD,HLA-A*02:01,1,2\n")).collect()
    assert [tuple(r) for r in f] == [("ACD", "A0201", 1.0, 2.0)]
    a = reports.read_abundance(spark, put("k2.tsv", "target_id\tlen\ttpm\nT1.9\t5\t9\nT1.12\t5\t2.5\nT3.1\t1\tx\nT3.2\t1\t4\n"))
    assert {(r["transcript"], r["tpm"]) for r in a.collect()} == {("T1", 9.0), ("T3", None)}


def test_line_numbers_over_splits(spark, put):
    path = put("long.txt", "".join(f"line {i}\n" for i in range(1, 5001)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        n = reports.numbered_lines(spark, path)
        assert n.count() == 5000 and n.filter("value <> concat('line ', line_no)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
