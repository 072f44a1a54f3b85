"""Heuristic scores of candidates: the tiered probability and two published linear scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators.statistics import mwu_test

#: Intercept and coefficients of log10 abundance + 0.1, log10 affinity, and stability.
NEO_SCORE = {"intercept": -4.1922, "abundance": 2.2958, "affinity": -1.8478, "stability": 0.7698}
SHORT_SCORE = {"intercept": -1.2364, "affinity": -1.2146, "stability": 0.9903}
#: Kinds of small variants, as an identity begins.
SMALL_VARIANTS = ("SNV_", "INS_", "DEL_", "INDEL_", "FSV_")


@dataclass(frozen=True)
class Limit:
    """Bounds of affinity (nM), stability (hours) and abundance; a candidate fails where it is not strictly on the good side."""

    affinity: float
    stability: float
    abundance: float

    def failed(self) -> list[Column]:
        return [F.col("ET_BindAff") >= self.affinity, F.col("BindStab") <= self.stability, F.col("Quantification") <= self.abundance]


@dataclass(frozen=True)
class Heuristic:
    """Fixed values of the tiered probability; all may be chosen."""

    hard: Limit = field(default_factory=lambda: Limit(231.0, 0.13, 1.0))
    soft: Limit = field(default_factory=lambda: Limit(21.0, 1.4, 11.0))
    recognised_abundance: float = 33.0
    agretopicity: float = 0.1
    foreignness: float = 1e-16
    small_location: float = -1.5
    other_location: float = -4.5
    p_value: float = 0.02
    effect_size: float = 1.5
    depth: int = 5
    fraction: float = 0.1


def _one(condition: Column) -> Column:
    """1 where true, else 0, also for null and for not-a-number comparisons."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def _count(conditions: list[Column]) -> Column:
    total = _one(conditions[0])
    for c in conditions[1:]:
        total = total + _one(c)
    return total


def neo_scores(df: DataFrame, abundance: str = "Quantification", affinity: str = "ET_BindAff", stability: str = "BindStab") -> DataFrame:
    """Adds NeoScore and AbbrevNeoScore. In NeoScore the natural logarithm is of the stability over ln 10, as published."""
    a, s, ten = F.log10(F.col(affinity)), F.col(stability), F.log(F.lit(10.0))
    long = NEO_SCORE["intercept"] + NEO_SCORE["abundance"] * F.log10(F.col(abundance) + 0.1) + NEO_SCORE["affinity"] * a + NEO_SCORE["stability"] * F.log(s / ten)
    short = SHORT_SCORE["intercept"] + SHORT_SCORE["affinity"] * a + SHORT_SCORE["stability"] * F.log10(s)
    return df.withColumns({"NeoScore": long, "AbbrevNeoScore": short})


def _tiers(rules: Heuristic, passed: int) -> dict[str, Column]:
    small = F.coalesce(F.greatest(*[F.col("Identity").startswith(k).cast("int") for k in SMALL_VARIANTS]), F.lit(0))
    unforeign = _one((F.col("Foreignness") <= rules.foreignness) & (F.col("Agretopicity") >= rules.agretopicity))
    few = [F.col("DNA_altDP") < rules.depth, F.col("DNA_altDP") < (F.col("DNA_refDP") + F.col("DNA_altDP") + 2.0**-52) * rules.fraction]
    return {
        "_small": small,
        "_unforeign": unforeign,
        "PresentationPreFilters": _count(rules.hard.failed()),
        "PresentationFilters": _count(rules.soft.failed()),
        "RecognitionalFilters": _count([*rules.soft.failed()[:2], F.col("Quantification") <= rules.recognised_abundance]) + unforeign,
        "_dna": F.lit(0) if passed & 1 else _count(few) * small,
    }


def immuno_strength(df: DataFrame, rules: Heuristic | None = None, passed: int = 0) -> int:
    """1, 0 or -1: whether presented small variants that are not recognised are expressed higher, alike, or lower than recognised ones.

    One rank test and two medians over RNA_normAD of the presented small variants; the driver sees single rows."""
    rules = rules or Heuristic()
    d = df.withColumns(_tiers(rules, passed)).filter("PresentationFilters = 0 AND _small = 1 AND RNA_normAD IS NOT NULL AND NOT isnan(RNA_normAD)").select("RNA_normAD", "_unforeign")
    test = mwu_test(d, "RNA_normAD", F.col("_unforeign") == 0)
    if not test["n1"] or not test["n2"] or test["p"] >= rules.p_value:
        return 0
    m = d.agg(*[F.median(F.when(F.col("_unforeign") == v, F.col("RNA_normAD"))).alias(k) for k, v in (("known", 1), ("foreign", 0))]).first()
    if rules.effect_size * m["known"] < m["foreign"]:
        return -1
    return 1 if rules.effect_size * m["foreign"] < m["known"] else 0


def immunogenic_probability(df: DataFrame, strength: int = 0, rules: Heuristic | None = None, passed: int = 0) -> DataFrame:
    """Adds the filter counts of each tier, and Probability = 1 / (1 + 2^-x) of a sum of rewards and penalties.

    ``strength``: of the sample's immune system, see ``immuno_strength``; ``passed``: bit 1 if variants have
    passed the limits of DNA reads already. Comparisons with null fail no tier."""
    rules = rules or Heuristic()
    d = df.withColumns(_tiers(rules, passed))
    bind = _one(F.col("BindLevel") == "WB") * 3 + _one(F.col("BindLevel") == "NB") * 6
    weakly = _one((F.col("Foreignness") <= rules.foreignness**0.5) & (F.col("Agretopicity") >= rules.agretopicity**0.5))
    trouble = _one((F.col("PresentationPreFilters") > 0) | (bind > 0) | (F.col("_dna") > 0))
    hard = rules.hard.failed()
    rewards = [
        rules.soft.affinity / (rules.soft.affinity + F.col("MT_BindAff")),
        F.greatest(_one(F.col("RecognitionalFilters") == 0), F.lit(strength)),
        F.col("_small") * rules.small_location + (1 - F.col("_small")) * rules.other_location,
    ]
    penalties = [
        _one(F.col("Foreignness") <= rules.foreignness) * (3 if strength < 0 else 0),
        F.col("PresentationFilters"),
        4 * _one(hard[0]) + 3 * _one(hard[1]) + 5 * _one(hard[2]),
        3 * _one(F.col("_dna") > 0),
        bind,
        weakly * trouble,
    ]
    return d.withColumn("Probability", numbers.logistic2(sum(rewards[1:], rewards[0]) - sum(penalties[1:], penalties[0]))).drop("_small", "_unforeign", "_dna")
