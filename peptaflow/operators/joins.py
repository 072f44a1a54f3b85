"""Joins beyond plain equality: intervals by bins, defaults, first and best matches, shared seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import kmers


def _bin(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def point_in_interval(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, on: Sequence[str] = (), how: str = "inner", strict: bool = False) -> DataFrame:
    """Points with the intervals that hold them, as an equality join on bins of ``width``.

    Each interval is listed once for every bin it covers, each point has one bin, so no pair comes twice.
    Choose ``width`` near the usual interval length. Null bounds match nothing. ``how``: inner, or right to keep intervals without points."""
    lo, hi = F.col(low), F.col(high)
    spread = intervals.withColumn("_bin", F.explode_outer(F.when(lo <= hi, F.sequence(_bin(lo, width), _bin(hi, width)))))
    p = points.withColumn("_bin", _bin(F.col(at), width))
    inside = (p[at] > spread[low]) & (p[at] < spread[high]) if strict else (p[at] >= spread[low]) & (p[at] <= spread[high])
    cond = (p["_bin"] == spread["_bin"]) & inside
    for k in on:
        cond = cond & (p[k] == spread[k])
    out = p.join(spread, cond, how)
    return out.drop(p["_bin"]).drop(spread["_bin"])


def contained(inner: DataFrame, outer: DataFrame, inner_low: str, inner_high: str, outer_low: str, outer_high: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs in which the outer range strictly contains the inner one."""
    out = point_in_interval(inner, outer, inner_low, outer_low, outer_high, width, on, strict=True)
    return out.filter(F.col(inner_high) < F.col(outer_high))


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], values: dict[str, object], guard: Column | None = None) -> DataFrame:
    """Left join of unique keys with defaults for missing values; ``guard`` decides on the left row whether to look up at all."""
    keyed = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *values)
    cond = F.lit(True) if guard is None else guard
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    out = left.join(keyed, cond, "left").drop(*[f"_r_{k}" for k in on])
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(d)) for v, d in values.items() if d is not None})


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given total order (limits are pushed below the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rk") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column | str], how: str = "left") -> DataFrame:
    """Joins each left row to the first right row of its key."""
    return left.join(first_by(right, on, order), list(on), how)


#: Rows up to which the seeds of a query side are broadcast; larger sides are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def seed_pairs(queries: DataFrame, subjects: DataFrame, query_id: str, query_text: str, subject_id: str, subject_text: str, k: int, frequent: int | None = None, broadcast_rows: int = BROADCAST_SEEDS) -> DataFrame:
    """(query id, subject id, seeds): pairs that share k-mers, with the number of distinct shared ones.

    ``frequent``: leave out seeds found in more subjects than this (null: none are left out).

    Subjects' windows are met with the queries' seeds before anything is shuffled, so only shared seeds travel;
    they are dealt by subject, and counting pairs needs no second shuffle. The query side is counted first and
    broadcast only up to ``broadcast_rows`` rows."""
    q = queries.select(query_id, F.explode(kmers(F.col(query_text), k)).alias("seed")).distinct()
    hint = (lambda d: F.broadcast(d)) if q.limit(broadcast_rows + 1).count() <= broadcast_rows else (lambda d: d.hint("merge"))
    s = subjects.select(subject_id, F.explode(kmers(F.col(subject_text), k)).alias("seed"))
    s = s.join(hint(q.select("seed").distinct()), "seed", "left_semi").repartition(subject_id).distinct()
    if frequent is not None:
        s = s.join(s.groupBy("seed").count().filter(F.col("count") <= frequent).select("seed"), "seed", "left_semi")
    return s.join(hint(q), "seed").groupBy(query_id, subject_id).agg(F.count(F.lit(1)).alias("seeds"))


def best_subject(pairs: DataFrame, query_id: str, subject_id: str, score: str = "seeds") -> DataFrame:
    """The pair of each query with the highest score, then the smallest subject; combined map-side."""
    best = F.min(F.struct((-F.col(score)).alias("neg"), F.col(subject_id)))
    return pairs.groupBy(query_id).agg(best.alias("b")).select(query_id, F.col(f"b.{subject_id}").alias(subject_id), (-F.col("b.neg")).alias(score))


def unseen(keys: DataFrame, seen: DataFrame, key: str, broadcast_rows: int = BROADCAST_SEEDS) -> DataFrame:
    """Rows of ``keys`` whose key is not among ``seen``. The keys are counted and, if they are few, meet ``seen`` before its shuffle."""
    if keys.limit(broadcast_rows + 1).count() <= broadcast_rows:
        seen = seen.join(F.broadcast(keys.select(key)), key, "left_semi")
    return keys.join(seen.distinct(), key, "left_anti")


def unique_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def conflicting_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that come with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")
