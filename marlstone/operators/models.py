"""Estimators whose fits are aggregations, and wrappers of Spark's own library.

Fits gather sums over the rows (normal equations, class moments, covariances);
small systems are solved on the driver. Where the reference trains another
algorithm under the same name, the wrapper's docstring says what it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_equations(df: DataFrame, columns: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X and X'y with a leading column of ones, and the number of rows, in one aggregation."""
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    d = len(xs)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(xs[i] * xs[j]).alias(f"x{i}_{j}") for i in range(d) for j in range(i, d)], *[F.sum(x * F.col(target)).alias(f"y{i}") for i, x in enumerate(xs)]).first()
    xx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    return xx, np.array([row[f"y{i}"] or 0.0 for i in range(d)]), row["n"]


def linear_regression(df: DataFrame, columns: Sequence[str], target: str, ridge: float = 0.0) -> dict[str, float]:
    """Coefficients of least squares, with an unpenalised intercept; ridge > 0 is ridge regression."""
    xx, xy, _ = normal_equations(df, columns, target)
    penalty = ridge * np.eye(len(xx))
    penalty[0, 0] = 0
    return dict(zip(["intercept", *columns], np.linalg.lstsq(xx + penalty, xy, rcond=None)[0].tolist()))


def lasso(df: DataFrame, columns: Sequence[str], target: str, alpha: float, l1_ratio: float = 1.0, passes: int = 200) -> dict[str, float]:
    """Coordinate descent for (1 / 2n) |y - Xb|^2 + alpha (l1 |b| + (1 - l1) b^2 / 2), on the normal equations."""
    xx, xy, n = normal_equations(df, columns, target)
    b = np.zeros(len(xx))
    for _ in range(passes):
        for j in range(len(b)):
            rest = (xy[j] - xx[j] @ b + xx[j, j] * b[j]) / n
            if j == 0:
                b[j] = rest / (xx[j, j] / n)
            else:
                b[j] = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0) / (xx[j, j] / n + alpha * (1 - l1_ratio))
    return dict(zip(["intercept", *columns], b.tolist()))


def predict_linear(coefficients: Mapping[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(coefficients["intercept"]), *[F.lit(v) * F.col(c) for c, v in coefficients.items() if c != "intercept"]])


def logistic_gradient_descent(df: DataFrame, columns: Sequence[str], target: str, rate: float = 0.1, epochs: int = 20, l2: float = 0.0) -> dict[str, float]:
    """Batch gradient descent; each epoch is one aggregation of the gradient."""
    w = dict.fromkeys(["intercept", *columns], 0.0)
    for _ in range(epochs):
        e = 1 / (1 + F.exp(-predict_linear(w))) - F.col(target)
        g = df.agg(F.avg(e).alias("intercept"), *[F.avg(e * F.col(c)).alias(c) for c in columns]).first()
        w = {k: v - rate * ((g[k] or 0.0) + (l2 * v if k != "intercept" else 0.0)) for k, v in w.items()}
    return w


def gaussian_nb_fit(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """label, prior and per-class means and population variances."""
    groups = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.var_pop(c).alias(f"{c}_var"))])
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return groups.crossJoin(F.broadcast(total)).withColumn("prior", F.col("n") / F.col("_t")).drop("_t")


def gaussian_nb_predict(df: DataFrame, key: str, columns: Sequence[str], model: DataFrame, label: str, smoothing: float = 1e-9) -> DataFrame:
    """key, predicted: the class with the largest log density; the model has one row per class."""
    terms = [-0.5 * F.log(2 * pi * (F.col(f"{c}_var") + smoothing)) - F.pow(F.col(c) - F.col(f"{c}_mean"), 2) / (2 * (F.col(f"{c}_var") + smoothing)) for c in columns]
    scored = df.select(key, *columns).crossJoin(F.broadcast(model)).select(key, label, (F.log("prior") + reduce(lambda a, b: a + b, terms)).alias("_s"))
    return scored.groupBy(key).agg(F.max_by(label, F.struct("_s", label)).alias("predicted"))


def multinomial_nb_fit(df: DataFrame, columns: Sequence[str], label: str, alpha: float = 1.0) -> DataFrame:
    """label and smoothed log probabilities of each count column."""
    sums = df.groupBy(label).agg(*[F.sum(c).alias(c) for c in columns])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return sums.select(label, *[F.log((F.col(c) + alpha) / (total + alpha * len(columns))).alias(f"{c}_logp") for c in columns])


def bernoulli_nb_fit(df: DataFrame, columns: Sequence[str], label: str, alpha: float = 1.0, binarize: float = 0.0) -> DataFrame:
    """label and smoothed probabilities that each column exceeds a bound."""
    return df.groupBy(label).agg(*[((F.count_if(F.col(c) > binarize) + alpha) / (F.count(F.lit(1)) + 2 * alpha)).alias(f"{c}_p") for c in columns])


def soft_kmeans_step(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], temperature: float = 1.0) -> DataFrame:
    """cluster and new centre: means weighted by softmax(-d^2 / T) assignments, in one aggregation."""
    d2 = [reduce(lambda a, b: a + b, [F.pow(F.col(c) - float(v), 2) for c, v in zip(columns, centre)]) for centre in centres]
    least = F.least(*d2) if len(d2) > 1 else d2[0]
    weights = [F.exp(-(d - least) / temperature) for d in d2]
    total = reduce(lambda a, b: a + b, weights)
    row = df.agg(*[F.struct(*[(F.sum(w / total * F.col(c)) / F.sum(w / total)).alias(c) for c in columns]).alias(f"c{k}") for k, w in enumerate(weights)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("cluster"), *[F.col(f"c{k}.{c}").alias(c) for c in columns]) for k in range(len(centres))])).alias("s")).select("s.*")


def pca_covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, cov (n - 1) for every pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def pca(df: DataFrame, columns: Sequence[str], components: int) -> tuple[np.ndarray, np.ndarray]:
    """Explained variances and components; the covariance of few columns is decomposed on the driver."""
    cov = np.zeros((len(columns), len(columns)))
    for r in pca_covariance(df, columns).collect():
        cov[columns.index(r["a"]), columns.index(r["b"])] = cov[columns.index(r["b"]), columns.index(r["a"])] = r["cov"]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    return values[order], vectors[:, order].T


def hard_vote(df: DataFrame, key: str, voters: Sequence[str]) -> DataFrame:
    """key, vote: the most frequent prediction, the smallest on ties."""
    return df.select(key, F.explode(F.array(*voters)).alias("p")).groupBy(key).agg(F.mode("p", True).alias("vote"))


def weighted_vote(df: DataFrame, voters: Mapping[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [w * F.col(c) for c, w in voters.items()]) / sum(voters.values())


def isotonic(df: DataFrame, x: str, y: str):
    """Spark's isotonic regression (pool adjacent violators) of y on x."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=x, labelCol=y, predictionCol="fitted").fit(df).transform(df)


def fit_ml(df: DataFrame, kind: str, columns: Sequence[str], target: str | None = None, **params):
    """A Spark ML model by name, with its features assembled: trees are CART, k-means is hard, the mixture is full EM.

    The reference's models of these names use other algorithms, so numbers differ.
    """
    from pyspark.ml import Pipeline, classification, clustering, feature, regression

    made = {
        "decision_tree": classification.DecisionTreeClassifier, "random_forest": classification.RandomForestClassifier, "gradient_boosting": classification.GBTClassifier, "logistic": classification.LogisticRegression, "linear_svm": classification.LinearSVC, "mlp": classification.MultilayerPerceptronClassifier,
        "tree_regressor": regression.DecisionTreeRegressor, "forest_regressor": regression.RandomForestRegressor, "boosting_regressor": regression.GBTRegressor, "elastic_net": regression.LinearRegression,
        "kmeans": clustering.KMeans, "gaussian_mixture": clustering.GaussianMixture, "bisecting_kmeans": clustering.BisectingKMeans,
    }[kind]
    stage = made(featuresCol="_features", **({"labelCol": target} if target else {}), **params)
    return Pipeline(stages=[feature.VectorAssembler(inputCols=list(columns), outputCol="_features"), stage]).fit(df)


def multi_label_indicators(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """An indicator for each class of an array of labels."""
    return df.withColumns({f"{column}_{c}": F.array_contains(column, c).cast("int") for c in classes})


def stump_cuts(df: DataFrame, columns: Sequence[str], cuts: int = 32) -> dict[str, list[float]]:
    """Quantiles of the columns, at which stumps may cut."""
    edges = df.agg(*[F.percentile_approx(c, [k / cuts for k in range(1, cuts)], 10_000).alias(f"_{c}") for c in columns]).first()
    return {c: [float(t) for t in sorted(set(edges[f"_{c}"] or []))] for c in columns}


def best_stump(df: DataFrame, cuts: Mapping[str, Sequence[float]], label: str, weight: Column) -> dict | None:
    """feature, threshold, polarity, error and total weight of the best stump, in one aggregation; None without cuts."""
    tests = [(c, float(t)) for c, at in cuts.items() for t in at]
    if not tests:
        return None
    wrong = [F.sum(F.when((F.col(c) > t).cast("int") != F.col(label), F.col("_w")).otherwise(0.0)).alias(f"e{k}") for k, (c, t) in enumerate(tests)]
    row = df.withColumn("_w", weight).agg(F.sum("_w").alias("total"), *wrong).first()
    total = row["total"] or 0.0
    found = [(min(e := row[f"e{k}"] or 0.0, total - e), c, t, 1 if e <= total / 2 else -1) for k, (c, t) in enumerate(tests)]
    return dict(zip(["error", "feature", "threshold", "polarity"], min(found))) | {"total": total}


def decision_stump(df: DataFrame, columns: Sequence[str], label: str, weight: Column, cuts: int = 32) -> DataFrame:
    """feature, threshold, polarity, error of the best weighted stump over quantile cuts. Labels are 0 and 1."""
    best = best_stump(df, stump_cuts(df, columns, cuts), label, weight)
    rows = [(best["error"], best["feature"], best["threshold"], best["polarity"])] if best else []
    return df.sparkSession.createDataFrame(rows, "error double, feature string, threshold double, polarity int")
