"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ieee_div


def bits(p: Column) -> Column:
    """-p log2 p, with 0 at p = 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def power_mean(values: Column, p: float) -> Column:
    """(mean of x^p)^p, the arithmetic mean at p = 1."""
    n = F.size(values)
    return F.pow(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(p))) / n, F.lit(p))


def agretopicity(mt: Column, other: Column) -> Column:
    """Ratio of two affinities by IEEE rules."""
    return ieee_div(mt, other)


def logistic2(x: Column) -> Column:
    """1 / (1 + 2^-x)"""
    return 1 / (1 + F.pow(F.lit(2.0), -x))


def half_even(x: Column, digits: int = 5) -> Column:
    """Rounding half to even."""
    return F.bround(x, digits)


def joined_floats(values: Column, pattern: str = "%.3f") -> Column:
    return F.array_join(F.transform(values, lambda x: F.format_string(pattern, x)), ",")


def recognition(scores: Column, a: float = 26.0, k: float = 4.86936) -> Column:
    """Probability that any of the alignment scores is recognised: s / (1 + s), s the sum of exp(-k (a - score)); 0 for none."""
    s = F.aggregate(F.coalesce(scores, F.array().cast("array<double>")), F.lit(0.0), lambda z, x: z + F.exp(-k * (a - x)))
    return s / (1 + s)


def common_prefix(texts: Column) -> Column:
    """Length of the prefix that all texts of an array share."""
    n = F.array_min(F.transform(texts, F.length))
    same = lambda i: F.size(F.array_distinct(F.transform(texts, lambda t: F.substring(t, F.lit(1), i)))) == 1
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | same(i))), F.lit(0))


def trimmed_alleles(pos: Column, ref: Column, alts: Column) -> Column:
    """Struct (pos, ref, alts): symbolic alternatives dropped, the common prefix of all alleles cut, ``-`` for nothing left."""
    real = F.filter(alts, lambda a: ~a.startswith("<"))
    n = common_prefix(F.concat(F.array(ref), real))
    cut = lambda t: F.when(F.length(t) > n, F.substring(t, n + 1, F.length(t))).otherwise("-")
    return F.struct((pos + n).alias("pos"), cut(ref).alias("ref"), F.transform(real, cut).alias("alts"))


def lenient_equal(ref_a: Column, alts_a: Column, ref_b: Column, alts_b: Column) -> Column:
    """Whether any pair of alternatives agrees in the first characters of reference and alternative."""
    first = lambda t: F.substring(t, 1, 1)
    return (first(ref_a) == first(ref_b)) & F.exists(alts_a, lambda a: F.exists(alts_b, lambda b: first(a) == first(b)))
