import math

import pytest
from pyspark.sql import functions as F

from peptaflow.functions import numbers as N
from peptaflow.functions import sequences as S
from peptaflow.functions.missing import ieee_div, to_number


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,want", [("NA", None), ("N/A", None), (".", None), ("", None), ("1.5", 1.5), ("x", None), (None, None)])
def test_numbers_from_text(spark, text, want):
    assert one(spark, to_number(F.lit(text).cast("string"))) == want


def test_ieee_division(spark):
    assert one(spark, ieee_div(F.lit(1.0), F.lit(0.0))) == math.inf
    assert one(spark, ieee_div(F.lit(-1.0), F.lit(0.0))) == -math.inf
    assert math.isnan(one(spark, ieee_div(F.lit(0.0), F.lit(0.0))))
    assert one(spark, ieee_div(F.lit(3.0), F.lit(2.0))) == 1.5


def test_header(spark):
    h = F.lit("id1 WT=AAA x=y=z TPM=2.5 flag  MT=CCC")
    assert one(spark, S.header_attributes(h)) == {"WT": "AAA", "TPM": "2.5", "MT": "CCC"}
    assert one(spark, S.header_value(h, "absent")) is None


def test_peptides(spark):
    assert one(spark, S.canonical(F.lit("acuO"))) == "ACXX"
    assert one(spark, S.mask_residues(F.lit("ACBzU"))) == "ACXXX"
    assert one(spark, S.norm_mhc(F.lit("HLA-A*02:01"))) == "A0201"
    assert one(spark, S.norm_hla_workflow(F.lit("H-2-Kb"))) == "H2-Kb"
    assert one(spark, S.clamped(F.lit("ABCDEF"), F.lit(-2), F.lit(3))) == "ABC"
    assert one(spark, S.clamped(F.lit("ABCDEF"), F.lit(4), F.lit(30))) == "EF"
    assert one(spark, S.shorten_residues(F.lit("AlaXyzTrp"))) == "AW"
    assert one(spark, S.shorten_residues(F.lit("Al"))) is None
    assert one(spark, S.reverse_complement(F.lit("ATTC"))) == "GAAT"
    assert one(spark, S.mark_changes(F.lit("ACDE"), F.lit("ACXE"))) == "ACdE"
    assert one(spark, S.mark_changes(F.lit("ACDE"), F.lit("AC"))) == "acde"
    assert one(spark, S.wildcard(F.lit("ACdE"))) == "ACxE"
    assert one(spark, S.strip_version(F.lit("ENST1.12"))) == "ENST1"
    assert one(spark, S.identity_parts(F.lit("SNV_D12_B"))).asDict() == {"vtype": "SNV", "moltype": "D", "lineno": 12}
    assert one(spark, S.uri_parts(F.lit("ssh://me@host/x/y"))).asDict() == {"user": "me", "host": "host", "port": 22, "path": "/x/y"}


def test_translation(spark):
    assert one(spark, S.translate_codons(F.lit("ATGGCCTAAGGG"))) == "MA"
    assert one(spark, S.translate_codons(F.lit("atggcctg"))) == "MA"
    assert S.CODONS["TGG"] == "W" and S.CODONS["ATG"] == "M" and len(S.CODONS) == 64


@pytest.mark.parametrize("a,b,want", [("ABC", "ABD", 1), ("", "ABC", 3), (None, "AB", 2), ("AB", "ABC", None)])
def test_hamming(spark, a, b, want):
    assert one(spark, S.hamming(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


def test_kmers_and_neighbours(spark):
    assert one(spark, S.kmers(F.lit("ABCDE"), 3)) == ["ABC", "BCD", "CDE"]
    assert one(spark, S.kmers(F.lit("AB"), 3)) == []
    n = one(spark, S.neighbours(F.lit("ACD")))
    assert len(n) == 3 * 19 + 1 and "ACD" in n
    assert len(one(spark, S.neighbours(F.lit("ACD"), skip=(1,)))) == 2 * 19 + 1


def test_numbers(spark):
    assert abs(one(spark, N.recognition(F.array(F.lit(26.0)))) - 0.5) < 1e-12
    assert one(spark, N.recognition(F.array().cast("array<double>"))) == 0
    assert one(spark, N.power_mean(F.array(F.lit(1.0), F.lit(3.0)), 1.0)) == 2
    v = one(spark, N.trimmed_alleles(F.lit(10), F.lit("GAT"), F.array(F.lit("GA"), F.lit("<DEL>"))))
    assert v.asDict() == {"pos": 12, "ref": "T", "alts": ["-"]}
    assert one(spark, N.lenient_equal(F.lit("A"), F.array(F.lit("TC")), F.lit("AG"), F.array(F.lit("C"), F.lit("T"))))
