"""Isotonic-logistic model: each feature becomes a monotone log-odds curve, then a logistic (or linear) fit weighs the curves.

All features are fitted together in long form (feature, row, x, y). Order-dependent steps use
distributed ranks and equality joins on neighbouring ranks, so no feature is gathered in one
task; only the knots of the fitted curves reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics
from ..operators.lineage import cut
from ..operators.windows import running

#: Most points of a curve with a turning point that are fitted as they are; beyond it they are averaged in equal-count groups first.
CONVEX_POINTS = 200_000


def long_form(df: DataFrame, features: Sequence[str], label: str, row_id: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(features)])
    return df.select(F.col(row_id).alias("row"), F.col(label).cast("double").alias("y"), F.explode(pairs).alias("p")).select("p.feature", "row", "p.x", "y")


def spread_ties(points: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``xo``: x moved inside the half-way marks to its neighbouring distinct values, in the order of a seeded hash."""
    distinct = cut(running(points.select("feature", "x").distinct(), ["feature", "x"], {"r": ("count", F.lit(1))}))
    step = lambda d, v: distinct.select((F.col("r") + d).alias("r"), F.col("feature").alias("_f"), F.col("x").alias(v))
    around = distinct
    for d, v in ((1, "below"), (-1, "above")):
        side = step(d, v)
        around = around.join(side, (around["r"] == side["r"]) & (around["feature"] == side["_f"]), "left").drop(side["r"]).drop("_f")
    below = F.coalesce("below", 2 * F.col("x") - F.col("above"), F.col("x"))
    above = F.coalesce("above", 2 * F.col("x") - F.col("below"), F.col("x"))
    marks = around.select("feature", "x", ((below + F.col("x")) / 2).alias("lo"), ((above + F.col("x")) / 2).alias("hi"))
    u = (F.shiftrightunsigned(F.xxhash64("row", "feature", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return points.join(marks, ["feature", "x"]).select("feature", "row", "x", "y", (F.col("lo") + (F.col("hi") - F.col("lo")) * u).alias("xo"))


def label_runs(points: DataFrame) -> DataFrame:
    """(feature, run, y, x, n): stretches of one label in the order of xo, with their mean x; runs are numbered over all features."""
    ranked = cut(running(points, ["feature", "xo", "row"], {"r": ("count", F.lit(1))}))
    before = ranked.select((F.col("r") + 1).alias("r"), F.col("feature").alias("_f"), F.col("y").alias("_y"))
    new = F.when(F.col("_f").eqNullSafe(F.col("feature")) & F.col("_y").eqNullSafe(F.col("y")), 0).otherwise(1)
    flagged = ranked.join(before, "r", "left").withColumn("new", new)
    return running(flagged, ["r"], {"run": ("sum", F.col("new"))}).groupBy("run").agg(F.min("feature").alias("feature"), F.min("y").alias("y"), F.avg("xo").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))


def run_log_odds(runs: DataFrame, power: float = 1.0) -> DataFrame:
    """(feature, x, y): the log-odds around each run, from its own length, the next runs of its label and those of the other label."""

    def mean(a: Column, b: Column) -> Column:
        return (a + b) / 2 if power == 1.0 else F.pow((F.pow(a, F.lit(power)) + F.pow(b, F.lit(power))) / 2, F.lit(power))

    runs = cut(runs)
    base, out = runs, runs
    for d in (1, -1, 2, -2):
        side = base.select((F.col("run") + d).alias("run"), F.col("feature").alias("_f"), F.col("n").alias(f"n{d}".replace("-", "m")))
        out = out.join(side, "run", "left").withColumn(f"n{d}".replace("-", "m"), F.when(F.col("_f") == F.col("feature"), F.col(f"n{d}".replace("-", "m")))).drop("_f")
    prev, nxt = F.coalesce("n1", "nm1"), F.coalesce("nm1", "n1")
    own = mean(F.col("n"), mean(F.coalesce("n2", "n"), F.coalesce("nm2", "n")))
    odds = own / mean(prev, nxt)
    return out.select("feature", "x", F.when(F.col("y") == 1, F.log(odds)).otherwise(-F.log(odds)).alias("y")).filter("y IS NOT NULL")


def isotonic_knots(points: DataFrame, increasing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone fit of y on x (columns x and y)."""
    m = IsotonicRegression(featuresCol="x", labelCol="y", isotonic=increasing).fit(points.select("x", "y", F.lit(1.0).alias("weight")))
    return np.array(m.boundaries.toArray()), np.array(m.predictions.toArray())


def interpolate(x: Column, knots: tuple[np.ndarray, np.ndarray]) -> Column:
    """Linear interpolation between knots, constant beyond them."""
    kx, ky = np.asarray(knots[0], float), np.asarray(knots[1], float)
    if len(kx) == 0:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v.to_numpy(float), kx, ky), index=v.index)

    return at(x.cast("double"))


def centred(points: DataFrame, knots: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One knot a level of the fitted curve, at the mean x of its points."""
    level = points.withColumn("v", interpolate(F.col("x"), knots)).groupBy(F.round("v", 6).alias("k")).agg(F.avg("x").alias("x"), F.avg("v").alias("v")).orderBy("x").toPandas()
    return level["x"].to_numpy(), level["v"].to_numpy()


def inverse_knots(knots: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(knots[1], kind="stable")
    y, x = knots[1][order], knots[0][order]
    _, first = np.unique(y, return_index=True)
    return y[first], x[first]


def pooled(x: np.ndarray, y: np.ndarray, increasing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Monotone least squares of y on sorted x, in memory."""
    s = 1.0 if increasing else -1.0
    blocks: list[list[float]] = []
    for v in s * y:
        blocks.append([v, 1.0])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2 = blocks.pop()
            v1, w1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2]
    return x, s * np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])


def turning_knots(points: DataFrame, shape: str = "auto") -> tuple[np.ndarray, np.ndarray]:
    """A curve with one turning point: two monotone halves that overlap around the extreme of a moving average and are averaged there."""
    n = points.count()
    if n > CONVEX_POINTS:
        ranked = running(points.select("x", "y"), ["x", "y"], {"r": ("count", F.lit(1))})
        points = ranked.groupBy(F.floor(F.col("r") * CONVEX_POINTS / n).alias("g")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    p = points.select("x", "y").toPandas().sort_values(["x", "y"], kind="stable")
    x, y = p["x"].to_numpy(), p["y"].to_numpy()
    if len(x) < 3:
        return x, y
    width = math.ceil(math.sqrt(len(x)))
    smooth = np.convolve(y, np.ones(width) / width, "valid")
    valley = (smooth[0] + smooth[-1]) / 2 > smooth.mean()
    middle = int(smooth.argmin() if valley else smooth.argmax()) + width // 2
    half = (width + 1) // 2
    clip = lambda i: min(max(i, 0), len(x) - 1)
    a, b, c, d = x[clip(middle - width)], x[clip(middle + width)], x[clip(middle - half)], x[clip(middle + half)]
    left, right = x <= b, x >= a

    def direction(mask: np.ndarray, convex_rises: bool) -> bool:
        if shape == "auto":
            r = np.corrcoef(pd.Series(x[mask]).rank(), pd.Series(y[mask]).rank())[0, 1] if mask.sum() > 1 else 0.0
            return not r < 0
        return convex_rises if shape == "convex" else not convex_rises

    lo, hi = pooled(x[left], y[left], direction(left, False)), pooled(x[right], y[right], direction(right, True))
    low, high = np.interp(x, *lo), np.interp(x, *hi)
    return x, np.where(x < c, low, np.where(x > d, high, (low + high) / 2))


@dataclass
class Curve:
    feature: str
    knots: tuple[np.ndarray, np.ndarray]
    inverse: tuple[np.ndarray, np.ndarray]
    increasing: bool
    offset: float = 0.0
    dropped: bool = False
    tests: dict[str, float] = field(default_factory=dict)


class IsotonicLogistic:
    """Fits on a DataFrame; every result is a DataFrame or plain data."""

    def __init__(self, features: Sequence[str], label: str = "label", row_id: str = "id", excluded: Sequence[str] = (), convex: Sequence[str] = (), task: str = "classification", centre: bool = True, effect_size: float = 0.15, p_drop: float = 0.01, drop_weak: bool = True, c: float = 1.0, seed: int = 0, power: float = 1.0, nan_policy: str = "mean"):
        self.features, self.label, self.row_id, self.excluded, self.convex = list(features), label, row_id, list(excluded), set(convex)
        self.task, self.centre, self.effect_size, self.p_drop, self.drop_weak, self.c, self.seed, self.power, self.nan_policy = task, centre, effect_size, p_drop, drop_weak, c, seed, power, nan_policy
        self.curves: dict[str, Curve] = {}
        self.means: dict[str, float] = {}
        self.coefficients: dict[str, float] = {}
        self.intercept = 0.0

    def _clean(self, df: DataFrame) -> DataFrame:
        cols = [*self.features, *self.excluded]
        finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        if self.nan_policy == "mean":
            return df.withColumns({c: F.coalesce(finite(c), F.lit(self.means.get(c))) for c in cols})
        return df.withColumns({c: F.when(F.isnan(F.col(c).cast("double")) | F.col(c).isNull(), F.raise_error(F.lit(f"missing value in {c}")).cast("double")).otherwise(F.col(c).cast("double")) for c in cols})

    def fit(self, df: DataFrame) -> IsotonicLogistic:
        cols = [*self.features, *self.excluded]
        self.means = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in cols]).first().asDict()
        data = self._clean(df).persist()
        points = long_form(data, self.features, self.label, self.row_id)
        binary = self.task == "classification"
        n_pos, n_all = data.agg(F.sum(F.col(self.label).cast("double")), F.count(F.lit(1))).first()
        if binary:
            if not n_pos or n_pos == n_all:
                raise ValueError("both labels are needed")
            base = math.log(n_pos / (n_all - n_pos))
            odds = cut(run_log_odds(label_runs(spread_ties(points, self.seed)), self.power).withColumn("y", F.col("y") - base))
        else:
            base, odds = 0.0, points.select("feature", "x", "y")
        for i, name in enumerate(self.features):
            own = odds.filter(F.col("feature") == i)
            test = statistics.spearman(own, "x", "y").first()
            rising = not (test["r"] is not None and test["r"] < 0)
            if name in self.convex:
                knots = turning_knots(own)
            else:
                knots = isotonic_knots(own, rising)
                if self.centre:
                    knots = centred(own, knots)
            self.curves[name] = Curve(name, knots, inverse_knots(knots), rising, base)
        self._screen(data, binary)
        shaped = self.transform(data, clean=False)
        vec = VectorAssembler(inputCols=[f"_t_{c}" for c in self.features] + self.excluded, outputCol="_v").transform(shaped).select("_v", F.col(self.label).cast("double").alias("_y"))
        reg = 1.0 / (self.c * n_all)
        est = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9) if binary else LinearRegression(featuresCol="_v", labelCol="_y")
        m = est.fit(vec)
        self.coefficients = dict(zip([*self.features, *self.excluded], m.coefficients.toArray().tolist(), strict=True))
        self.intercept = float(m.intercept)
        self.spread = shaped.agg(*[F.avg(F.abs(F.col(f"_t_{c}"))).alias(c) for c in self.features]).first().asDict()
        data.unpersist()
        return self

    def _screen(self, data: DataFrame, binary: bool) -> None:
        tests = {}
        for c in self.features:
            if binary:
                t = statistics.mwu_test(data, c, F.col(self.label) == 1)
                sd = math.sqrt((t["n1"] + t["n2"] + 1) / (3.0 * t["n1"] * t["n2"])) if t["n1"] and t["n2"] else 0.0
                effect = t["effect"]
            else:
                t = statistics.spearman_test(data, c, self.label)
                effect, sd = (t["r"] if not math.isnan(t["r"]) else 0.0), 1 / math.sqrt(max(1, t["n"] - 3))
            size = self.effect_size
            weak = statistics.normal_sf((size - abs(effect)) / sd) if sd else 1.0
            tests[c] = {"p": t["p"], "effect": effect, "p_weak": weak, "table": statistics.effect_table(effect, sd)}
        for kind in ("p", "p_weak"):
            ordered = sorted(tests, key=lambda c: tests[c][kind])
            least = 1.0
            for i in range(len(ordered) - 1, -1, -1):
                least = min(least, tests[ordered[i]][kind] * len(ordered) / (i + 1))
                tests[ordered[i]]["q" + kind[1:]] = least
        for c in self.features:
            weak = tests[c]["q"] > self.p_drop if self.effect_size == 0 else tests[c]["q_weak"] < self.p_drop
            self.curves[c].tests = tests[c]
            self.curves[c].dropped = bool(weak and self.drop_weak)

    def _curve(self, name: str, x: Column) -> Column:
        return F.lit(0.0) if self.curves[name].dropped else interpolate(x, self.curves[name].knots)

    def transform(self, df: DataFrame, clean: bool = True) -> DataFrame:
        """Adds ``_t_<feature>``: relative log-odds (0 for dropped features)."""
        d = self._clean(df) if clean else df
        return d.withColumns({f"_t_{c}": self._curve(c, F.col(c)) for c in self.features})

    def inverse_transform(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Maps log-odds columns back: feature -> column that holds its transformed value; replaces ``_x_<feature>``."""
        return df.withColumns({f"_x_{f}": interpolate(F.col(c), self.curves[f].inverse) for f, c in columns.items()})

    def predict(self, df: DataFrame, name: str = "PredictedProbability") -> DataFrame:
        shaped = self.transform(df)
        z = F.lit(self.intercept)
        for c in self.features:
            z = z + F.col(f"_t_{c}") * self.coefficients[c]
        for c in self.excluded:
            z = z + F.col(c) * self.coefficients[c]
        out = shaped.withColumn(name, 1 / (1 + F.exp(-z)) if self.task == "classification" else z)
        return out.select(*df.columns, name)

    def importances(self) -> dict[str, dict[str, float]]:
        """By feature: mean absolute log-odds, coefficient, their product, tests and trend."""
        return {c: {"f2l": self.spread[c], "f2f": self.coefficients[c], "f2l2f": self.spread[c] * self.coefficients[c], "trend": 1.0 if self.curves[c].increasing else -1.0, "dropped": float(self.curves[c].dropped), **{k: v for k, v in self.curves[c].tests.items() if k != "table"}} for c in self.features}

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as a table: one row a feature with its knots, and one for the intercept."""
        rows = [(c, k.knots[0].tolist(), k.knots[1].tolist(), k.increasing, k.offset, k.dropped, float(self.coefficients[c]), float(self.means[c] or 0.0), "curve") for c, k in self.curves.items()]
        rows += [(c, [], [], True, 0.0, False, float(self.coefficients[c]), float(self.means[c] or 0.0), "excluded") for c in self.excluded]
        rows.append((self.label, [], [], True, 0.0, False, float(self.intercept), 0.0, self.task))
        spark.createDataFrame(rows, "feature string, x array<double>, y array<double>, increasing boolean, offset double, dropped boolean, coefficient double, mean double, kind string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsotonicLogistic:
        rows = spark.read.parquet(path).collect()  # one row a feature
        last = next(r for r in rows if r["kind"] not in ("curve", "excluded"))
        m = cls([r["feature"] for r in rows if r["kind"] == "curve"], label=last["feature"], excluded=[r["feature"] for r in rows if r["kind"] == "excluded"], task=last["kind"])
        m.intercept = last["coefficient"]
        for r in rows:
            if r["kind"] == "curve":
                knots = (np.array(r["x"]), np.array(r["y"]))
                m.curves[r["feature"]] = Curve(r["feature"], knots, inverse_knots(knots), r["increasing"], r["offset"], r["dropped"])
            if r["kind"] != m.task:
                m.coefficients[r["feature"]], m.means[r["feature"]] = r["coefficient"], r["mean"]
        return m


__all__ = ["Curve", "IsotonicLogistic"]
