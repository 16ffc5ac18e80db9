"""Cross-validation, grid search and feature elimination of linear models from sums.

One aggregation gives the normal equations of every fold. A model is fitted on
the sums of the other folds and scored on its own fold's, so the number of
parameter sets does not bear on the number of passes over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fitting import block_sums, numeric
from .ordering import row_numbers


#: Sums of products that one aggregation takes as expressions; more are added up in blocks of rows.
MOST_EXPRESSIONS = 256


def weighted_products(df: DataFrame, columns: Sequence[str], weights: Sequence[Column]) -> list[np.ndarray]:
    """For each weight (null counts as 0) the products of (1, columns) with each other, summed over the rows without a gap in a column, in one pass."""
    d = len(columns) + 1
    names, shares = [f"_c{k}" for k in range(d - 1)], [f"_w{k}" for k in range(len(weights))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], *[F.coalesce(w.cast("double"), F.lit(0.0)).alias(n) for w, n in zip(weights, shares)])
    rows = numeric(rows, names, *shares)  # the weights come first
    if len(weights) * d * (d + 1) // 2 > MOST_EXPRESSIONS:

        def step(v):
            z = np.column_stack([np.ones(len(v)), v[:, len(shares) :]])
            return np.concatenate([((z * v[:, k, None]).T @ z).ravel() for k in range(len(shares))])

        return list(block_sums(rows, step, len(weights) * d * d).reshape(-1, d, d))
    v = [F.lit(1.0), *[F.col(n) for n in names]]
    row = rows.agg(*[F.sum(F.col(w) * v[i] * v[j]).alias(f"s{k}_{i}_{j}") for k, w in enumerate(shares) for i in range(d) for j in range(i, d)]).first()
    return [np.array([[row[f"s{k}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]) for k in range(len(weights))]


def fold_equations(df: DataFrame, columns: Sequence[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """For each fold the products of (1, columns, target) with each other, summed over its rows without a gap; folds are few, and a row without one is left out."""
    folds = [r["_fold"] for r in df.select(F.col(fold).alias("_fold")).filter("_fold IS NOT NULL").distinct().collect()]
    if not folds:
        return {}
    return dict(zip(folds, weighted_products(df, [*columns, target], [F.when(F.col(fold) == k, 1.0) for k in folds])))


def solve(sums: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Intercept and coefficients; the intercept is not penalised."""
    penalty = ridge * np.eye(len(sums) - 1)
    penalty[0, 0] = 0
    return np.linalg.lstsq(sums[:-1, :-1] + penalty, sums[:-1, -1], rcond=None)[0]


def scores(sums: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """mse and r2 of coefficients over the rows behind the sums; r2 is 0 where the target does not vary."""
    full = np.append(-b, 1.0)
    n, sse = sums[0, 0], float(full @ sums @ full)
    spread = sums[-1, -1] - sums[0, -1] ** 2 / n
    return {"mse": float(sse / n), "r2": float(1 - sse / spread) if spread else 0.0}


def cross_validate(df: DataFrame, columns: Sequence[str], target: str, fold: str, ridge: float = 0.0) -> DataFrame:
    """fold, n, mse, r2 of a linear model that is fitted on the other folds."""
    return grid_search(df, columns, target, fold, [ridge]).drop("ridge")


def grid_search(df: DataFrame, columns: Sequence[str], target: str, fold: str, ridges: Sequence[float]) -> DataFrame:
    """ridge, fold, n, mse, r2 for every penalty and fold."""
    parts = fold_equations(df, columns, target, fold)
    total = sum(parts.values(), np.zeros((len(columns) + 2,) * 2))
    rows = []
    for ridge in ridges:
        for k, own in sorted(parts.items()):
            found = scores(own, solve(total - own, ridge))
            rows.append((float(ridge), int(k), int(own[0, 0]), found["mse"], found["r2"]))
    return df.sparkSession.createDataFrame(rows, "ridge double, fold int, n long, mse double, r2 double")


def best_ridge(found: DataFrame) -> DataFrame:
    """ridge, mse: the penalty with the least mean error over the folds."""
    return found.groupBy("ridge").agg(F.avg("mse").alias("mse")).orderBy("mse", "ridge").limit(1)


def leave_one_out(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """fold: the place of each row, which is the fold that it alone tests."""
    return row_numbers(df, order, "fold")


def _scaled(sums: np.ndarray) -> np.ndarray:
    """Absolute coefficients times the columns' deviations."""
    n = sums[0, 0]
    deviation = np.sqrt(np.maximum(np.diag(sums)[1:-1] / n - (sums[0, 1:-1] / n) ** 2, 0))
    return np.abs(solve(sums)[1:]) * deviation


def select_from_model(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """feature, importance of the columns whose scaled coefficient is at least the mean one."""
    sums = sum(fold_equations(df.withColumn("_all", F.lit(0)), columns, target, "_all").values())
    found = _scaled(sums)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, found) if v >= found.mean()], "feature string, importance double")


def recursive_elimination(df: DataFrame, columns: Sequence[str], target: str, keep: int) -> DataFrame:
    """feature, rank: 1 for the columns that stay, then in the reverse order in which the weakest went; one pass over the rows."""
    sums = sum(fold_equations(df.withColumn("_all", F.lit(0)), columns, target, "_all").values())
    left, gone = list(range(1, len(columns) + 1)), []
    while len(left) > keep:
        at = [0, *left, len(columns) + 1]
        gone.append(left.pop(int(np.argmin(_scaled(sums[np.ix_(at, at)])))))
    rank = {k: 1 for k in left} | {k: 2 + i for i, k in enumerate(reversed(gone))}
    return df.sparkSession.createDataFrame([(c, rank[k + 1]) for k, c in enumerate(columns)], "feature string, rank int")


def function_transform(df: DataFrame, functions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Columns replaced by functions of column expressions, which stay in the JVM."""
    return df.withColumns({c: f(F.col(c)) for c, f in functions.items()})


def parameter_samples(spark: SparkSession, grid: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """n draws from the product of parameter values, without repeats while there are enough."""
    rng, size = np.random.default_rng(seed), int(np.prod([len(v) for v in grid.values()]))
    picked = rng.choice(size, n, replace=n > size)
    return [{k: v[i] for (k, v), i in zip(grid.items(), np.unravel_index(p, [len(v) for v in grid.values()]))} for p in picked]
