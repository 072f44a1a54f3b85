"""Peptide alignment: semi-global placement and local scores, by dynamic programming in Arrow-batched UDFs.

Use distinct pairs: ``aligned_pairs`` and ``local_scores`` do so before they call the UDFs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import RESIDUES

#: BLOSUM62, lower triangle, residues in the order of RESIDUES.
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: Costs of the two alignments.
PLACE_OPEN, PLACE_EXTEND, LOCAL_OPEN, LOCAL_EXTEND = 16, 1, 11, 1


@lru_cache(maxsize=1)
def scores() -> dict[tuple[str, str], int]:
    """Scores of both orders; X scores -1 with everything."""
    out = {}
    for a, line in zip(RESIDUES, BLOSUM62.split("\n")[1:], strict=False):
        for b, v in zip(RESIDUES, line.split(), strict=False):
            out[a, b] = out[b, a] = int(v)
    for a in RESIDUES + "X":
        out[a, "X"] = out["X", a] = -1
    return out


def bit_distance(a: str, b: str, gap_open: int = PLACE_OPEN, gap_extend: int = PLACE_EXTEND) -> float:
    """Half of the score lost by the differences between two aligned texts; adjoining gap columns cost the extension."""
    s, lost, last = scores(), 0, -2
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            continue
        if "-" in (x, y):
            lost += gap_extend if last == i - 1 else gap_open
            last = i
        else:
            lost += s.get((x, x), -1) - s.get((x, y), -1)
    return lost / 2


def place(inner: str, outer: str) -> tuple[str, str]:
    """Best placement of ``inner`` within ``outer`` (ends of ``outer`` are free), both cut to the placed stretch.

    Of equally good placements the one with matches latest in the traceback, that is the leftmost end, counts."""
    s, n, m, low = scores(), len(inner), len(outer), -(10**9)
    best = [[0] * (m + 1)] + [[low] * (m + 1) for _ in range(n)]
    gap_in = [[low] * (m + 1) for _ in range(n + 1)]  # outer residue against a gap
    gap_out = [[low] * (m + 1) for _ in range(n + 1)]  # inner residue against a gap
    for i in range(1, n + 1):
        for j in range(m + 1):
            gap_out[i][j] = max(best[i - 1][j] - PLACE_OPEN, gap_out[i - 1][j] - PLACE_EXTEND)
            if j:
                gap_in[i][j] = max(best[i][j - 1] - PLACE_OPEN, gap_in[i][j - 1] - PLACE_EXTEND)
                best[i][j] = best[i - 1][j - 1] + s.get((inner[i - 1], outer[j - 1]), -1)
            best[i][j] = max(best[i][j], gap_out[i][j], gap_in[i][j])
    j = max(range(m + 1), key=lambda j: (best[n][j], -j))
    i, a, b, state = n, [], [], "m"
    while i:
        here = {"m": best, "o": gap_out, "i": gap_in}[state][i][j]
        if state == "m" and j and here == best[i - 1][j - 1] + s.get((inner[i - 1], outer[j - 1]), -1):
            i, j = i - 1, j - 1
            a.append(inner[i])
            b.append(outer[j])
        elif state == "o" or (state == "m" and here == gap_out[i][j]):
            state = "m" if gap_out[i][j] == best[i - 1][j] - PLACE_OPEN else "o"
            i -= 1
            a.append(inner[i])
            b.append("-")
        else:
            state = "m" if gap_in[i][j] == best[i][j - 1] - PLACE_OPEN else "i"
            j -= 1
            a.append("-")
            b.append(outer[j])
    return "".join(reversed(a)), "".join(reversed(b))


def local_score(a: str, b: str) -> int:
    """Best local alignment score with affine gaps."""
    s, best = scores(), 0
    row, up = [0] * (len(b) + 1), [-math.inf] * (len(b) + 1)
    for x in a:
        diagonal, left, new = 0, -math.inf, [0]
        for j, y in enumerate(b, 1):
            up[j] = max(row[j] - LOCAL_OPEN, up[j] - LOCAL_EXTEND)
            left = max(new[j - 1] - LOCAL_OPEN, left - LOCAL_EXTEND)
            v = max(0, diagonal + s.get((x, y), -1), up[j], left)
            diagonal = row[j]
            new.append(v)
            best = max(best, v)
        row = new
    return int(best)


@F.pandas_udf(T.StructType([T.StructField("aln1", T.StringType()), T.StructField("aln2", T.StringType()), T.StructField("hamming", T.LongType()), T.StructField("bits", T.DoubleType())]))
def place_udf(inner: pd.Series, outer: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(inner, outer, strict=True):
        if not a or not b:
            rows.append(("", "", 2**30, float(2**30)))
        else:
            x, y = place(a, b)
            rows.append((x, y, sum(p != q for p, q in zip(x, y, strict=True)), bit_distance(x, y)))
    return pd.DataFrame(rows, columns=["aln1", "aln2", "hamming", "bits"])


@F.pandas_udf(T.LongType())
def local_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([local_score(x, y) if x and y else 0 for x, y in zip(a, b, strict=True)], dtype="int64")


def aligned_pairs(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """Adds aln1, aln2, hamming and bits; each distinct pair is aligned once."""
    pairs = df.select(F.col(inner).alias("_a"), F.col(outer).alias("_b")).distinct().withColumn("_r", place_udf("_a", "_b")).select("_a", "_b", "_r.*")
    return df.join(pairs, F.col(inner).eqNullSafe(F.col("_a")) & F.col(outer).eqNullSafe(F.col("_b"))).drop("_a", "_b")


def local_scores(df: DataFrame, a: str, b: str, name: str = "score") -> DataFrame:
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct().withColumn(name, local_udf("_a", "_b"))
    return df.join(pairs, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b"))).drop("_a", "_b")


def self_score(seq: Column) -> Column:
    """Sum of each residue's score with itself."""
    table = F.create_map(*[F.lit(x) for r in RESIDUES for x in (r, scores()[r, r])])
    return F.aggregate(F.split(seq, ""), F.lit(0), lambda acc, r: acc + F.coalesce(F.try_element_at(table, r), F.lit(0)))


def substitution_loss(a: Column, b: Column) -> Column:
    """Sum over positions of self score minus substitution score (texts of one length)."""
    table = F.create_map(*[F.lit(x) for p in ((x, y) for x in RESIDUES for y in RESIDUES) for x in ("".join(p), scores()[p[0], p[0]] - scores()[p])])
    pairs = F.zip_with(F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != ""), lambda x, y: F.coalesce(F.try_element_at(table, F.concat(x, y)), F.lit(0)))
    return F.aggregate(pairs, F.lit(0), lambda acc, v: acc + v)
