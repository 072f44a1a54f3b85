"""Queries that fit models or need tails of distributions, and the streaming window; compared by tests instead of SQL where SQL has no equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ml.isotonic_logistic import IsotonicLogistic, isotonic_knots
from ..operators import statistics
from ..streaming.windows import tumbling
from .registry import Tables, query


def _train(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^!]", "")).alias("marks"), F.size(F.split("text", " ")).alias("words")).join(t.labels, "doc_id")


@query()
def iso_fit(t: Tables) -> DataFrame:
    x, y = isotonic_knots(_train(t).select(F.col("n_chars").cast("double").alias("x"), F.col("toxic").cast("double").alias("y")), True)
    return t.spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")


@query()
def ilr_predict(t: Tables) -> DataFrame:
    d = _train(t)
    m = IsotonicLogistic(["n_chars", "marks", "words"], "quality", "doc_id", effect_size=0.0, drop_weak=False).fit(d)
    return m.predict(d).select("doc_id", "quality", F.round("PredictedProbability", 6).alias("p"))


@query()
def mannwhitney_effect_table(t: Tables) -> DataFrame:
    r = statistics.mwu_test(t.lineitem, "l_extendedprice", F.col("l_returnflag") == "R")
    sd = ((r["n1"] + r["n2"] + 1) / (3.0 * r["n1"] * r["n2"])) ** 0.5
    table = statistics.effect_table(r["effect"], sd)
    return t.spark.createDataFrame([(float(s), float(p)) for s, p in zip(statistics.EFFECT_SIZES, table, strict=True)], "effect_size double, p double")


@query()
def group_kfold(t: Tables) -> DataFrame:
    return statistics.group_folds(t.orders, "o_custkey", 5)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    w = tumbling(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "event_type", F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))
