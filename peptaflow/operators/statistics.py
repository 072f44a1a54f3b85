"""Rank statistics, screening tests, ranking metrics and encodings, from counts per distinct value."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .windows import midranks, running

#: Effect sizes of the screening tables.
EFFECT_SIZES = tuple(round(0.01 * i, 2) for i in range(21))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def student_sf(t: float, df: float) -> float:
    """Upper tail of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d, h = 1.0, 1 - (a + b) * x / (a + 1), 0.0
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    beta = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return beta / 2 if t > 0 else 1 - beta / 2


@lru_cache(maxsize=64)
def _u_counts(n1: int, n2: int) -> tuple[int, ...]:
    """How many orderings give each U, by adding one observation of either group at a time."""
    if not n1 or not n2:
        return (1,)
    with_first, with_second = _u_counts(n1 - 1, n2), _u_counts(n1, n2 - 1)
    out = [0] * (n1 * n2 + 1)
    for u, c in enumerate(with_first):
        out[u + n2] += c
    for u, c in enumerate(with_second):
        out[u] += c
    return tuple(out)


def mwu_summary(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row: n1, n2, u1 (positives above negatives, ties half), ties (sum of t^3 - t over equal values)."""
    v = df.select(F.col(value).cast("double").alias("v"), positive.cast("int").alias("y")).filter("v IS NOT NULL AND y IS NOT NULL AND NOT isnan(v)")
    m = midranks(v, "v", {"k": F.col("y")})
    t = F.col("n").cast("double")
    out = m.agg(F.sum("k").alias("n1"), F.sum(F.col("n") - F.col("k")).alias("n2"), F.sum(F.col("midrank") * F.col("k")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    return out.select("n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u1"), "ties")


def mwu_z(summary: DataFrame) -> DataFrame:
    """Adds mean, sd with tie correction, z with continuity, and the rank-biserial effect."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    diff = F.abs(F.col("u1") - n1 * n2 / 2)
    return summary.withColumns({"sd": sd, "z": F.try_divide(F.greatest(diff - 0.5, F.lit(0.0)), sd), "effect": 1 - F.try_divide(2 * F.col("u1"), n1 * n2)})


def mwu_test(df: DataFrame, value: str, positive: Column) -> dict[str, float]:
    """U1, two-sided p (exact for a group of 8 or fewer without ties, else normal), z and effect, on the driver from one row."""
    r = mwu_z(mwu_summary(df, value, positive)).first()
    n1, n2, u = int(r["n1"] or 0), int(r["n2"] or 0), r["u1"]
    if not n1 or not n2:
        return {"u1": math.nan, "p": 1.0, "z": 0.0, "effect": 0.0, "n1": n1, "n2": n2}
    if min(n1, n2) <= 8 and not r["ties"]:
        counts = _u_counts(n1, n2)
        top = int(max(u, n1 * n2 - u))
        p = min(1.0, 2 * sum(counts[top:]) / math.comb(n1 + n2, n1))
    else:
        p = min(1.0, 2 * normal_sf(r["z"])) if r["z"] is not None else 1.0
    return {"u1": u, "p": p, "z": r["z"] or 0.0, "effect": r["effect"], "n1": n1, "n2": n2}


def effect_table(effect: float, sd: float, sizes: Sequence[float] = EFFECT_SIZES) -> list[float]:
    """One-sided p-values that the absolute effect exceeds each size."""
    return [normal_sf((abs(effect) - s) / sd) if sd > 0 else (1.0 if abs(effect) <= s else 0.0) for s in sizes]


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and the correlation of midranks."""
    base = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).dropna()
    rx = midranks(base, "_x").select("_x", F.col("midrank").alias("rx"))
    ry = midranks(base, "_y").select("_y", F.col("midrank").alias("ry"))
    pairs = base.groupBy("_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("w")).join(rx, "_x").join(ry, "_y")
    s = pairs.agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * a * b).alias(k) for k, a, b in (("sx", F.col("rx"), F.lit(1)), ("sy", F.col("ry"), F.lit(1)), ("xx", F.col("rx"), F.col("rx")), ("yy", F.col("ry"), F.col("ry")), ("xy", F.col("rx"), F.col("ry")))])
    cov = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    var = (F.col("xx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"))
    return s.select(F.col("n").cast("long").alias("n"), F.try_divide(cov, F.sqrt(var)).alias("r"))


def spearman_test(df: DataFrame, x: str, y: str) -> dict[str, float]:
    r = spearman(df, x, y).first()
    n, rho = r["n"] or 0, r["r"]
    if rho is None or math.isnan(rho) or n < 3:
        return {"r": math.nan, "p": 0.5, "n": n}
    if abs(rho) >= 1:
        return {"r": rho, "p": 0.0, "n": n}
    return {"r": rho, "p": 2 * student_sf(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2), "n": n}


def fisher_z_p(rho: float, n: int, threshold: float = 0.0) -> float:
    """One-sided p-value that the absolute correlation exceeds a threshold."""
    if n <= 3:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    return normal_sf((math.atanh(abs(rho)) - math.atanh(threshold)) * math.sqrt(n - 3))


def auroc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """One row: auroc, n_pos, n_neg."""
    s = mwu_summary(df.select(score.alias("s"), positive.alias("y")), "s", F.col("y"))
    return s.select(F.try_divide(F.col("u1"), F.col("n1") * F.col("n2")).alias("auroc"), F.col("n1").alias("n_pos"), F.col("n2").alias("n_neg"))


def average_precision(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """One row: step-wise average precision over distinct thresholds."""
    g = df.select(score.cast("double").alias("s"), positive.cast("long").alias("y")).dropna().groupBy("s").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    r = running(g, [F.desc("s")], {"tp": ("sum", F.col("k")), "all": ("sum", F.col("n"))})
    return r.agg(F.try_divide(F.sum(F.col("k") * F.col("tp") / F.col("all")), F.sum("k")).alias("average_precision"))


def bh_adjust(df: DataFrame, p: str, tie: Sequence[Column | str], name: str = "q") -> DataFrame:
    """Adjusted p-values: the least p m / rank over this and higher ranks, 1 at most."""
    ranked = running(df.filter(F.col(p).isNotNull()), [p, *tie], {"_rk": ("count", F.lit(1))})
    m = ranked.agg(F.max("_rk").alias("_m"))
    scaled = ranked.join(F.broadcast(m)).withColumn("_q", F.col(p) * F.col("_m") / F.col("_rk"))  # one row
    return running(scaled, [F.desc("_rk")], {name: ("min", F.col("_q"))}).withColumn(name, F.least(F.col(name), F.lit(1.0))).drop("_rk", "_m", "_q")


def top_hits(df: DataFrame, order: Sequence[Column | str], positive: Column, cuts: Sequence[int] = (20, 50, 100)) -> DataFrame:
    """One row: hits among the first 20, 50, 100 ranks; fraction ranked (hits in 100 of all positives); tested among the first 20."""
    r = running(df.select("*", positive.cast("int").alias("_y")), list(order), {"_rk": ("count", F.lit(1))})
    hit = lambda n: F.sum(F.when(F.col("_rk") <= n, F.coalesce("_y", F.lit(0))).otherwise(0))
    total = F.sum(F.coalesce("_y", F.lit(0)))
    out = r.agg(*[hit(n).alias(f"top{n}") for n in cuts], F.try_divide(F.sum(F.when((F.col("_rk") <= 20) & F.col("_y").isNotNull(), F.col("_y"))).cast("double"), F.count(F.when((F.col("_rk") <= 20) & F.col("_y").isNotNull(), 1))).alias("ttif"), F.try_divide(hit(100).cast("double"), total).alias("fr"))
    return out


def woe(df: DataFrame, category: str, positive: Column, pseudo: float = 1.0) -> DataFrame:
    """One row a category: n0, n1 and the rate with ``pseudo`` positives and as many negatives as the whole has for each."""
    g = df.select(F.col(category), positive.cast("int").alias("y")).filter("y IS NOT NULL").groupBy(category).agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    whole = g.agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    npc = pseudo * F.try_divide(F.col("all0").cast("double"), F.col("all1"))
    return g.join(F.broadcast(whole)).select(category, "n0", "n1", ((F.col("n1") + pseudo) / (F.col("n0") + F.col("n1") + pseudo + npc)).alias("encoded"))  # one row


def woe_encode(df: DataFrame, encoding: DataFrame, category: str, prior: float, name: str) -> DataFrame:
    """Encodes a category; unseen and missing ones take the prior."""
    return df.join(encoding.select(category, F.col("encoded").alias(name)), category, "left").withColumn(name, F.coalesce(name, F.lit(prior)))


def resampled_woe(encoding: DataFrame, category: str, seed: int, pseudo: float = 1.0) -> DataFrame:
    """Encodings with n1 drawn anew from a binomial of the category's own counts (normal approximation), seeded by a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(category), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    v = (F.shiftrightunsigned(F.xxhash64(F.col(category), F.lit(seed + 1)), 11) + 0.5) / float(1 << 53)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    n = F.col("n0") + F.col("n1")
    k = F.greatest(F.lit(0.0), F.least(n.cast("double"), F.round(n * F.col("encoded") + z * F.sqrt(n * F.col("encoded") * (1 - F.col("encoded"))))))
    return encoding.withColumn("encoded", (k + pseudo * F.col("encoded")) / (n + pseudo))


def entropy_bits(df: DataFrame, symbols: Column) -> DataFrame:
    """One row a symbol: n, share and its bits -p log2 p."""
    g = df.select(F.explode(symbols).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return g.join(F.broadcast(total)).select("symbol", "n", p.alias("share"), (-p * F.log2(p)).alias("bits"))  # one row


def position_counts(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Long weight matrix: counts of each letter at each 0-based position, by keys and length."""
    spread = df.select(*keys, F.length(seq).alias("len"), F.posexplode(F.filter(F.split(seq, ""), lambda x: x != "")).alias("pos", "letter"))
    return spread.groupBy(*keys, "len", "pos", "letter").agg(F.count(F.lit(1)).alias("n"))


def motif_bits(df: DataFrame, keys: Sequence[str], seq: str, background: DataFrame) -> DataFrame:
    """Long motif matrix (keys, len, pos, letter, bits): -p log2 p of each letter's count over its background share; letter X has the mean of the bits.

    ``background``: (letter), one row an occurrence. Letters that are not in it are left out; letters that a position lacks have no row (0 bits)."""
    g = background.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("all"))
    share = g.join(F.broadcast(total)).select("letter", (F.col("n") / F.col("all")).alias("share"))  # one row
    counts = position_counts(df, keys, seq).join(share, "letter").withColumn("w", F.col("n") / F.col("share"))
    at = [*keys, "len", "pos"]
    p = counts.join(counts.groupBy(*at).agg(F.sum("w").alias("sum")), at).withColumn("p", F.col("w") / F.col("sum")).withColumn("bits", -F.col("p") * F.log2("p"))
    mean = p.groupBy(*at).agg(F.sum(F.col("bits") * F.col("p")).alias("bits")).withColumn("letter", F.lit("X"))
    return p.select(*at, "letter", "bits").unionByName(mean.select(*at, "letter", "bits"))


def impute_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(means[c])) for c in columns})


def _greedy(histogram: dict[int, int], folds: int) -> list[tuple[int, list[int]]]:
    """(first rank, cycle of folds) of runs of groups in falling size, each group going to the fold that is smallest so far.

    Within one size the folds that are smallest take turns, until their loads reach that of a further fold, which then joins them."""
    load, out, rank = [0] * folds, [], 0
    for n in sorted(histogram, reverse=True):
        left, active = histogram[n], []
        waiting = sorted(range(folds), key=lambda i: (load[i], i))
        while left:
            active.append(waiting.pop(0))
            active.sort(key=lambda i: (load[i], i))
            turns = left
            if waiting:
                f = waiting[0]
                turns = min(left, sum(-(-(load[f] + (i < f) - load[i]) // n) for i in active))
            if turns:
                out.append((rank, list(active)))
            for k, i in enumerate(active):
                load[i] += n * len(range(k, turns, len(active)))
            rank, left = rank + turns, left - turns
    return out


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): the largest groups first, each to the fold that is smallest so far.

    The driver sees one row for each distinct size; groups are ranked by size in a distributed way."""
    sizes = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    runs = _greedy({r["n"]: r["many"] for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()}, folds)
    shared = df.sparkSession.sparkContext.broadcast(([r[0] for r in runs], [r[1] for r in runs]))

    def deal(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, cycles = shared.value
        for x in frames:
            at = [bisect_right(starts, r) - 1 for r in x["rank"]]
            yield x.assign(fold=[cycles[i][(r - starts[i]) % len(cycles[i])] for i, r in zip(at, x["rank"], strict=True)])[["rank", "fold"]]

    ranked = cut(running(sizes, [F.desc("n"), group], {"rank": ("count", F.lit(1))}).withColumn("rank", F.col("rank") - 1))
    return ranked.join(ranked.select("rank").mapInPandas(deal, "rank long, fold int").hint("merge"), "rank").select(group, "n", "fold")
