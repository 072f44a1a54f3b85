"""Baseline grid: scalers by classifiers, closed-form discriminants, grouped folds and their score tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import statistics


def scalers() -> dict[str, object | None]:
    io = {"inputCol": "raw", "outputCol": "features"}
    return {"none": None, "maxabs": MaxAbsScaler(**io), "minmax": MinMaxScaler(**io), "norm": Normalizer(**io), "robust": RobustScaler(withCentering=True, **io), "standard": StandardScaler(withMean=True, **io)}


def classifiers(n_features: int, seed: int = 0) -> dict[str, object]:
    io = {"featuresCol": "features", "labelCol": "label"}
    return {
        "tree": DecisionTreeClassifier(seed=seed, **io), "forest": RandomForestClassifier(seed=seed, **io), "boosted": GBTClassifier(seed=seed, **io), "logistic": LogisticRegression(**io),
        "gaussian_nb": NaiveBayes(modelType="gaussian", **io), "mlp": MultilayerPerceptronClassifier(layers=[n_features, 16, 2], seed=seed, **io), "lda": Discriminant(False), "qda": Discriminant(True),
    }


class Discriminant:
    """Linear or quadratic discriminant from grouped moments: one aggregation, and a score by matrix products."""

    def __init__(self, quadratic: bool, ridge: float = 1e-6):
        self.quadratic, self.ridge = quadratic, ridge

    def fit(self, df: DataFrame) -> Discriminant:
        def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for y, g in b.groupby("label"):
                    x = np.vstack(g["v"].to_numpy())
                    yield pd.DataFrame({"label": [float(y)], "n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

        got = df.select("label", vector_to_array("features").alias("v")).mapInPandas(moments, "label double, n long, s array<double>, q array<double>")
        d = df.select(F.size(vector_to_array("features"))).first()[0]
        add = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)])
        rows = {r["label"]: r for r in got.groupBy("label").agg(F.sum("n").alias("n"), add("s", d).alias("s"), add("q", d * d).alias("q")).collect()}  # one row a class
        n = sum(r["n"] for r in rows.values())
        mean = {y: np.array(r["s"]) / r["n"] for y, r in rows.items()}
        scatter = {y: np.array(r["q"]).reshape(d, d) - r["n"] * np.outer(mean[y], mean[y]) for y, r in rows.items()}
        shared = sum(scatter.values()) / max(1, n - len(rows))
        self.classes = {}
        for y, r in rows.items():
            cov = (scatter[y] / max(1, r["n"] - 1) if self.quadratic else shared) + self.ridge * np.eye(d)
            self.classes[y] = (np.log(r["n"] / n), mean[y], np.linalg.inv(cov), np.linalg.slogdet(cov)[1])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        classes = self.classes

        @F.pandas_udf("array<double>")
        def score(v: pd.Series) -> pd.Series:
            x = np.vstack(v.to_numpy())
            z = np.stack([p - 0.5 * s - 0.5 * np.einsum("ij,jk,ik->i", x - m, c, x - m) for _, (p, m, c, s) in sorted(classes.items())], axis=1)
            e = np.exp(z - z.max(1, keepdims=True))
            return pd.Series((e / e.sum(1, keepdims=True)).tolist())

        return df.withColumn("probs", score(vector_to_array("features")))


def scored(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out if "probs" in out.columns else out.withColumn("probs", vector_to_array("probability"))


def bad_probabilities(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Rows whose probabilities are not two numbers in [0, 1] that add up to 1."""
    p = F.col(probs)
    return df.filter((F.size(p) != 2) | F.exists(p, lambda x: (x < 0) | (x > 1) | F.isnan(x)) | (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9))


def grid(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, which: Sequence[tuple[str, str]] | None = None, variance: float | None = None) -> DataFrame:
    """One row a pipeline: scaler, classifier, auroc, average_precision."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="all")
    first = [assemble, VarianceThresholdSelector(featuresCol="all", outputCol="raw", varianceThreshold=variance or 0.0)]
    named = train.select(*features, F.col(label).cast("double").alias("label"))
    held = test.select(*features, F.col(label).cast("double").alias("label"))
    prep: PipelineModel = Pipeline(stages=first).fit(named)
    a, b = prep.transform(named).select("raw", "label").persist(), prep.transform(held).select("raw", "label").persist()
    n = a.select(F.size(vector_to_array("raw"))).first()[0]
    rows = []
    for s, scaler in scalers().items():
        for c, clf in classifiers(n).items():
            if which is not None and (s, c) not in which:
                continue
            if scaler is None:
                x, y = a.withColumn("features", F.col("raw")), b.withColumn("features", F.col("raw"))
            else:
                fitted = scaler.fit(a) if hasattr(scaler, "fit") else scaler
                x, y = fitted.transform(a), fitted.transform(b)
            out = scored(clf.fit(x), y)
            score = F.col("probs")[1]
            rows.append((s, c, statistics.auroc(out, score, F.col("label")).first()["auroc"], statistics.average_precision(out, score, F.col("label")).first()["average_precision"]))
    return train.sparkSession.createDataFrame(rows, "scaler string, classifier string, auroc double, average_precision double")


def score_table(results: DataFrame, metric: str = "auroc") -> DataFrame:
    """Scalers down, classifiers across, means over folds."""
    return results.groupBy("scaler").pivot("classifier").agg(F.avg(metric))
