"""Order-dependent operators that stay distributed.

A global running value is computed in two steps: rows are range-partitioned and summed up
per partition, then each partition continues from the totals of those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

_JOIN = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def running(df: DataFrame, order: Sequence[Column | str], specs: dict[str, tuple[str, Column]], partitions: int | None = None) -> DataFrame:
    """Adds running values over the whole frame in a total order, without gathering it in one task.

    ``specs``: name -> (sum, count, min or max; column). The ranged rows are checkpointed, since their
    partition numbers must be the same in both passes; the carried totals are one row a partition."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[_AGG[kind](c).alias(f"_t_{name}") for name, (kind, c) in specs.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_pid").alias("_at"), *[_AGG["sum" if kind == "count" else kind](f"_t_{name}").over(before).alias(f"_b_{name}") for name, (kind, _) in specs.items()])
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({name: _AGG[kind](c).over(w) for name, (kind, c) in specs.items()})
    out = own.join(F.broadcast(carried), F.col("_pid") == F.col("_at"))  # at most ``partitions`` rows

    def joined(name: str, kind: str) -> Column:
        a, b = F.col(name), F.col(f"_b_{name}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(_JOIN[kind](a, b))

    return out.withColumns({name: joined(name, kind) for name, (kind, _) in specs.items()}).select(*df.columns, *specs)


def rank_first(df: DataFrame, score: Column, tie: Sequence[Column | str], name: str = "Rank") -> DataFrame:
    """Rank 1 for the highest score, ties in the order of ``tie``; NaN and null come last, in the same order."""
    clean = F.when(~F.isnan(score.cast("double")), score)
    return running(df.withColumn("_s", clean), [F.desc_nulls_last("_s"), *tie], {name: ("count", F.lit(1))}).drop("_s")


def midranks(df: DataFrame, value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value: n, the midrank, and sums of ``extra``; in two distributed passes."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (extra or {}).items()])
    ranked = running(counts, [value], {"upto": ("sum", F.col("n"))})
    return ranked.withColumn("midrank", F.col("upto") - (F.col("n") - 1) / 2)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str = "run") -> DataFrame:
    """Numbers the stretches of equal adjacent values within each key, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_neighbours(lengths: DataFrame, keys: Sequence[str], run: str = "run", n: str = "n") -> DataFrame:
    """Adds the lengths of the runs one and two before and after; beyond an edge the nearest known one counts."""
    w = Window.partitionBy(*keys).orderBy(run)
    p1, n1 = F.coalesce(F.lag(n, 1).over(w), F.col(n)), F.coalesce(F.lead(n, 1).over(w), F.col(n))
    return lengths.withColumns({"prev1": p1, "next1": n1, "prev2": F.coalesce(F.lag(n, 2).over(w), p1), "next2": F.coalesce(F.lead(n, 2).over(w), n1)})


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, width: int, name: str = "avg") -> DataFrame:
    """Means of full windows only: the last width - 1 rows of each key are left out."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, width - 1)
    return df.withColumns({name: F.avg(value).over(w), "_k": F.count(F.lit(1)).over(w)}).filter(F.col("_k") == width).drop("_k")


def centre_runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], x: str, y: str) -> DataFrame:
    """One row per stretch of equal y: means of x and y, and its length."""
    return runs(df, keys, order, y).groupBy(*keys, "run").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n"))


def seeded_sample(df: DataFrame, key: str, ident: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each class, chosen by a seeded hash of the row's id."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
