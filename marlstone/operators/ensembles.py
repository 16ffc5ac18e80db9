"""Ensembles, calibration and many-target estimators whose fits are sums over the rows.

Linear members are fitted from weighted products of columns, so bags, folds and
targets share one aggregation. Boosting and calibration keep a row's weight or
probability as an expression of its columns; no round writes the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import exp, factorial, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import hash_uniform
from .model_selection import fold_equations, solve, weighted_products
from .models import best_stump, stump_cuts


def poisson_count(u: Column, most: int = 12) -> Column:
    """How often a bootstrap draws a row: Poisson(1) from a uniform number."""
    steps = [exp(-1) * sum(1 / factorial(i) for i in range(k + 1)) for k in range(most)]
    return sum((F.when(u > s, 1).otherwise(0) for s in steps[1:]), F.when(u > steps[0], 1).otherwise(0))


def bagged_linear(df: DataFrame, key: str, columns: Sequence[str], target: str, bags: int = 10, seed: int = 0, uniform: Callable[[int], Column] | None = None, ridge: float = 0.0) -> DataFrame:
    """bag, intercept and coefficients of linear models on bootstraps; the mean over the bags predicts.

    A row's count in a bag is a function of its key, so bags need no copies of rows.
    """
    draw = uniform or (lambda b: hash_uniform(F.col(key), seed + b))
    found = [solve(s, ridge) for s in weighted_products(df, [*columns, target], [poisson_count(draw(b)) for b in range(bags)])]
    return df.sparkSession.createDataFrame([(b, *map(float, w)) for b, w in enumerate(found)], "bag int, intercept double, " + ", ".join(f"`{c}` double" for c in columns))


def stacked_linear(df: DataFrame, members: Mapping[str, Sequence[str]], target: str, fold: str, ridge: float = 0.0) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Weights of a linear meta model over the members' out-of-fold predictions, and the members fitted on all rows.

    A member's prediction is linear in the columns, so the meta model's sums follow
    from those of the folds: one pass over the rows, after one for the means, which are
    subtracted first so that large sums do not cancel.
    """
    columns = list(dict.fromkeys(c for cs in members.values() for c in cs))
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).cast("double").alias(c) for c in [*columns, target]]).first()
    parts = fold_equations(df.withColumns({c: F.col(c) - means[c] for c in [*columns, target]}), columns, target, fold)
    total = sum(parts.values())
    at = {m: [0, *[1 + columns.index(c) for c in cs], len(columns) + 1] for m, cs in members.items()}

    def member(sums: np.ndarray, where: Sequence[int]) -> np.ndarray:
        row = np.zeros(len(sums))
        row[where[:-1]] = solve(sums[np.ix_(where, where)], ridge)
        return row

    ends = np.eye(len(total))
    meta = np.zeros((len(members) + 2,) * 2)
    for own in parts.values():
        rows = np.array([ends[0], *[member(total - own, where) for where in at.values()], ends[-1]])
        meta += rows @ own @ rows.T
    weights = dict(zip(["intercept", *members], solve(meta).tolist()))
    weights["intercept"] += means[target] * (1 - sum(weights[m] for m in members))
    final = {m: dict(zip(["intercept", *members[m]], member(total, where)[where[:-1]].tolist())) for m, where in at.items()}
    for coefficients in final.values():
        coefficients["intercept"] += means[target] - sum(v * means[c] for c, v in coefficients.items() if c != "intercept")
    return weights, final


def stacked_prediction(weights: Mapping[str, float], members: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(weights["intercept"])
    for m, coefficients in members.items():
        out = out + weights[m] * sum((F.col(c) * v for c, v in coefficients.items() if c != "intercept"), F.lit(coefficients["intercept"]))
    return out


def adaboost(df: DataFrame, columns: Sequence[str], label: str, rounds: int = 50, rate: float = 1.0, cuts: Mapping[str, Sequence[float]] | None = None) -> list[dict]:
    """Stumps with their votes (feature, threshold, polarity, error, alpha); each round is one aggregation.

    A row's weight is the exponential of the votes against and for it so far, an
    expression of its columns. Stops where no stump is better than chance, and after a
    stump without error. Labels are 0 and 1.
    """
    tests = cuts or stump_cuts(df, columns)
    margin, stumps = F.lit(0.0), []
    for _ in range(rounds):
        best = best_stump(df, tests, label, F.exp(margin))
        if best is None or not best["total"] or best["error"] / best["total"] >= 0.5:
            break
        error = best["error"] / best["total"]
        stump = {**best, "error": error, "alpha": rate * 0.5 * log((1 - error) / error) if error > 0 else rate}
        stumps.append(stump)
        if error <= 0:
            break
        margin = margin + F.when(stump_says(stump) != F.col(label), stump["alpha"]).otherwise(-stump["alpha"])
    return stumps


def stump_says(stump: Mapping) -> Column:
    above = F.col(stump["feature"]) > stump["threshold"]
    return (above if stump["polarity"] > 0 else ~above).cast("int")


def adaboost_prediction(stumps: Sequence[Mapping]) -> Column:
    """1 where the votes for label 1 outweigh those for 0."""
    return (sum((s["alpha"] * (2 * stump_says(s) - 1) for s in stumps), F.lit(0.0)) > 0).cast("int")


def sigmoid_calibration(df: DataFrame, score: str, label: str, iterations: int = 20, tol: float = 1e-9) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a score + b))) with smoothed targets; each Newton step is one aggregation."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    target = F.when(F.col(label) == 1, (counts["p"] + 1) / (counts["p"] + 2)).otherwise(1 / (counts["n"] + 2))
    at, x = np.zeros(2), F.col(score).cast("double")
    for _ in range(iterations if counts["p"] + counts["n"] else 0):
        p = 1 / (1 + F.exp(-(float(at[0]) * x + float(at[1]))))
        e, w = p - target, p * (1 - p)
        r = df.agg(F.sum(e * x).alias("gx"), F.sum(e).alias("g"), F.sum(w * x * x).alias("xx"), F.sum(w * x).alias("x"), F.sum(w).alias("w")).first()
        step = np.linalg.lstsq(np.array([[r["xx"], r["x"]], [r["x"], r["w"]]]), np.array([r["gx"], r["g"]]), rcond=None)[0]
        at = at - step
        if np.abs(step).max() < tol:
            break
    return float(at[0]), float(at[1])


def temperature(df: DataFrame, logits: Sequence[str], label: str, iterations: int = 100, rate: float = 0.01) -> float:
    """The T of softmax(logits / T), by steps down the mean log loss; each step is one aggregation, label is the class's index."""
    t, z = 1.0, F.array(*[F.col(c).cast("double") for c in logits])
    top = F.array_max(z)
    for _ in range(iterations):
        e = F.transform(z, lambda v: F.exp((v - top) / t))  # noqa: B023
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        expected = add(F.zip_with(e, z, lambda a, b: a * b)) / add(e)
        slope = df.agg(F.avg(F.element_at(z, F.col(label).cast("int") + 1) - expected).alias("g")).first()["g"]
        t = max(0.01, t - rate * (slope or 0.0) / t**2)
    return t


def multi_output_linear(df: DataFrame, columns: Sequence[str], targets: Sequence[str], ridge: float = 0.0) -> dict[str, dict[str, float]]:
    """A linear model of every target, from one aggregation."""
    return _chained(df, columns, targets, ridge, chain=False)


def regressor_chain(df: DataFrame, columns: Sequence[str], targets: Sequence[str], ridge: float = 0.0) -> dict[str, dict[str, float]]:
    """Linear models in a chain: each sees the columns and the targets before it (predict in the order of targets)."""
    return _chained(df, columns, targets, ridge, chain=True)


def _chained(df, columns, targets, ridge, chain):
    sums = weighted_products(df, [*columns, *targets], [F.lit(1.0)])[0]
    out, d = {}, len(columns) + 1
    for k, target in enumerate(targets):
        seen = [*range(d), *(range(d, d + k) if chain else [])]
        where = [*seen, d + k]
        out[target] = dict(zip(["intercept", *columns, *targets[:k]], solve(sums[np.ix_(where, where)], ridge).tolist()))
    return out


def chain_predictions(df: DataFrame, models: Mapping[str, Mapping[str, float]], suffix: str = "_pred") -> DataFrame:
    """Predictions of every target; earlier targets enter as predicted."""
    out: dict[str, Column] = {}
    for target, coefficients in models.items():
        out[target] = sum((out.get(c, F.col(c)) * v for c, v in coefficients.items() if c != "intercept"), F.lit(coefficients["intercept"]))
    return df.withColumns({f"{t}{suffix}": v for t, v in out.items()})


def ridge_classifier(df: DataFrame, columns: Sequence[str], label: str, alpha: float = 1.0) -> dict[str, float]:
    """Coefficients of ridge regression on labels of -1 and 1; positive values predict 1. Labels are 0 and 1."""
    signed = df.select(*columns, (2 * F.col(label) - 1).alias("_signed"))
    sums = weighted_products(signed, [*columns, "_signed"], [F.lit(1.0)])[0]
    return dict(zip(["intercept", *columns], solve(sums, alpha).tolist()))


def transformed_target(df: DataFrame, columns: Sequence[str], target: str, forward: Callable[[Column], Column], backward: Callable[[Column], Column]) -> Column:
    """The prediction of a linear model of forward(target), turned back."""
    sums = weighted_products(df.select(*columns, forward(F.col(target)).alias("_forward")), [*columns, "_forward"], [F.lit(1.0)])[0]
    b = solve(sums).tolist()
    return backward(sum((F.col(c) * v for c, v in zip(columns, b[1:])), F.lit(b[0])))


class IncrementalLinear:
    """A linear model that batches add to (a foreachBatch sink's state): only sums are kept."""

    def __init__(self, columns: Sequence[str], target: str) -> None:
        self.columns, self.target = list(columns), target
        self.sums = np.zeros((len(self.columns) + 2,) * 2)

    def partial_fit(self, batch: DataFrame) -> IncrementalLinear:
        self.sums = self.sums + weighted_products(batch, [*self.columns, self.target], [F.lit(1.0)])[0]
        return self

    def coefficients(self, ridge: float = 0.0) -> dict[str, float]:
        return dict(zip(["intercept", *self.columns], solve(self.sums, ridge).tolist()))


def loss(kind: str, y: Column, p: Column, delta: float = 1.0) -> tuple[Column, Column]:
    """A boosting loss and its negative gradient: squared, absolute, huber, log (p a log-odds, y 0 or 1), exponential (y -1 or 1)."""
    r = y - p
    small = F.abs(r) <= delta
    odds = 1 / (1 + F.exp(-p))
    return {
        "squared": lambda: (0.5 * r * r, r),
        "absolute": lambda: (F.abs(r), F.signum(r)),
        "huber": lambda: (F.when(small, 0.5 * r * r).otherwise(delta * (F.abs(r) - 0.5 * delta)), F.when(small, r).otherwise(delta * F.signum(r))),
        "log": lambda: (F.log1p(F.exp(-F.abs(p))) + F.greatest(p, F.lit(0.0)) - y * p, y - odds),
        "exponential": lambda: (F.exp(-y * p), y * F.exp(-y * p)),
    }[kind]()
