"""Any estimator in folds, bags, stacks, chains and searches, all members fitted in the same passes.

An estimator says which sums over weighted rows it needs and what it makes of them.
A pass over the rows gives the sums of every (member, fold) or (member, bag) at once:
a member is a set of weights of rows, never a copy of them, so the number of passes
is that of the slowest member's rounds. Only sums of the models' size reach the driver.

Labels are 0 and 1 and predictions of classifiers are probabilities of 1. Rows with
a gap in a column, target or fold are left out of fits and predicted as null. Folds are
whole numbers from 0; a row of another fold trains every member and is predicted
as null out of fold.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import hash_uniform
from ..sources.shared import discard, materialize
from .ensembles import poisson_count
from .fitting import MOST_NUMBERS, block_sums, numeric, with_values
from .ordering import free_name

Scorer = Callable[[Column, Column], Column]


class Estimator:
    """What fitting asks of a model; derive from it to plug in one of your own.

    Sums are added up over blocks of rows, in tasks; update() turns them into the next
    state on the driver and says whether the model is done. A class of a module that the
    workers lack must be sent to them (addPyFile); one defined within a function goes along.
    """

    def start(self, width: int) -> Any:
        """The state before the first round, for so many columns."""
        raise NotImplementedError

    def sums(self, state: Any, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The numbers that rows x with targets y and weights w add; of a length that the state alone decides."""
        raise NotImplementedError

    def update(self, state: Any, sums: np.ndarray) -> tuple[Any, bool]:
        raise NotImplementedError

    def predict(self, state: Any, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def importance(self, state: Any) -> np.ndarray:
        """A number for each column, for elimination."""
        raise NotImplementedError(f"{type(self).__name__} does not weigh its columns")


@dataclass(frozen=True)
class Linear(Estimator):
    """Least squares with an intercept that is not penalised: a round for the means, one for the centred products."""

    ridge: float = 0.0

    def start(self, width):
        return {"mean": None, "width": width}

    def sums(self, state, x, y, w):
        z = np.column_stack([x, y])
        if state["mean"] is None:
            return np.append(w @ z, w.sum())
        z = z - state["mean"]
        return ((z * w[:, None]).T @ z).ravel()

    def update(self, state, sums):
        d = state["width"]
        if state["mean"] is None:
            return {**state, "mean": sums[:-1] / max(sums[-1], 1e-300), "n": sums[-1]}, False
        s = sums.reshape(d + 1, d + 1)
        b = np.linalg.lstsq(s[:d, :d] + self.ridge * np.eye(d), s[:d, d], rcond=None)[0]
        spread = np.sqrt(np.maximum(np.diag(s)[:d], 0) / max(state["n"], 1e-300))
        return {"coefficients": b, "intercept": state["mean"][d] - state["mean"][:d] @ b, "spread": spread}, True

    def predict(self, state, x):
        return state["intercept"] + x @ state["coefficients"]

    def importance(self, state):
        return np.abs(state["coefficients"]) * state["spread"]


@dataclass(frozen=True)
class Logistic(Estimator):
    """Logistic regression with a ridge penalty (not on the intercept), by Newton steps; one round for each."""

    ridge: float = 1.0
    most_rounds: int = 30
    tolerance: float = 1e-8

    def start(self, width):
        return {"b": np.zeros(width + 1), "round": 0}

    def sums(self, state, x, y, w):
        z = np.column_stack([np.ones(len(x)), x])
        p = _logistic(z @ state["b"])
        return np.concatenate([z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

    def update(self, state, sums):
        b = state["b"]
        d = len(b)
        penalty = self.ridge * np.append(0.0, np.ones(d - 1))
        step = np.linalg.lstsq(sums[d:].reshape(d, d) + np.diag(penalty), sums[:d] + penalty * b, rcond=None)[0]
        after = {"b": b - step, "round": state["round"] + 1}
        return after, bool(np.abs(step).max() < self.tolerance or after["round"] >= self.most_rounds)

    def predict(self, state, x):
        return _logistic(state["b"][0] + x @ state["b"][1:])

    def importance(self, state):
        return np.abs(state["b"][1:])


@dataclass(frozen=True)
class Bayes(Estimator):
    """Gaussian naive Bayes of two classes: a round for counts and means, one for variances. Without rows of a class the other is certain."""

    smoothing: float = 1e-9

    def start(self, width):
        return {"n": None, "width": width}

    def sums(self, state, x, y, w):
        each = np.stack([w * (y != 1), w * (y == 1)])
        if state["n"] is None:
            return np.append(each.sum(axis=1), each @ x)
        return np.concatenate([each[k] @ (x - state["mean"][k]) ** 2 for k in (0, 1)])

    def update(self, state, sums):
        d = state["width"]
        if state["n"] is None:
            n = sums[:2]
            return {**state, "n": n, "mean": sums[2:].reshape(2, d) / np.maximum(n, 1e-300)[:, None]}, False
        return {**state, "variance": sums.reshape(2, d) / np.maximum(state["n"], 1e-300)[:, None] + self.smoothing}, True

    def predict(self, state, x):
        with np.errstate(divide="ignore"):
            prior = np.log(state["n"])
        if np.isinf(prior).any():
            return np.full(len(x), float(state["n"][1] > 0))
        fit = [prior[k] - 0.5 * (np.log(state["variance"][k]) + (x - state["mean"][k]) ** 2 / state["variance"][k]).sum(axis=1) for k in (0, 1)]
        return _logistic(fit[1] - fit[0])


@dataclass(frozen=True)
class Sigmoid(Estimator):
    """1 / (1 + exp(-(a score + b))) of one column, with targets smoothed by the classes' counts: a round for these, then Newton steps."""

    most_rounds: int = 30
    tolerance: float = 1e-9

    def start(self, width):
        if width != 1:
            raise ValueError("a calibration has one column")
        return {"counts": None, "ab": np.zeros(2), "round": 0}

    def sums(self, state, x, y, w):
        if state["counts"] is None:
            return np.array([(w * (y != 1)).sum(), (w * (y == 1)).sum()])
        z = np.column_stack([x[:, 0], np.ones(len(x))])
        none, some = state["counts"]
        p = _logistic(z @ state["ab"])
        target = np.where(y == 1, (some + 1) / (some + 2), 1 / (none + 2))
        return np.concatenate([z.T @ (w * (p - target)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

    def update(self, state, sums):
        if state["counts"] is None:
            return {**state, "counts": sums}, not sums.sum()
        step = np.linalg.lstsq(sums[2:].reshape(2, 2), sums[:2], rcond=None)[0]
        after = {**state, "ab": state["ab"] - step, "round": state["round"] + 1}
        return after, bool(np.abs(step).max() < self.tolerance or after["round"] >= self.most_rounds)

    def predict(self, state, x):
        return _logistic(state["ab"][0] * x[:, 0] + state["ab"][1])


@dataclass(frozen=True)
class SoftTree(Estimator):
    """A complete tree whose nodes send a row to both sides in shares 1 - s and s, s = logistic(sharpness * (x - threshold)).

    Columns of the nodes are drawn by seed, thresholds and leaves begin near 0 and near
    the targets' mean (a round of its own); both move down the mean squared error. Columns
    should be scaled.
    """

    depth: int = 3
    rounds: int = 30
    rate: float = 0.5
    sharpness: float = 4.0
    l2: float = 0.0
    seed: int = 0

    def start(self, width):
        rng, nodes = np.random.default_rng(self.seed), 2**self.depth - 1
        return {"column": rng.integers(0, width, nodes), "threshold": rng.normal(0, 0.1, nodes), "leaf": rng.normal(0, 0.1, nodes + 1), "round": -1}

    def _pass(self, state, x):
        """Shares of going right at each node, of reaching each node or leaf, and the value below each."""
        nodes = len(state["column"])
        right = _logistic(self.sharpness * (x[:, state["column"]] - state["threshold"]))
        reach, value = np.ones((len(x), 2 * nodes + 1)), np.empty((len(x), 2 * nodes + 1))
        for k in range(nodes):
            reach[:, 2 * k + 1] = reach[:, k] * (1 - right[:, k])
            reach[:, 2 * k + 2] = reach[:, k] * right[:, k]
        value[:, nodes:] = state["leaf"]
        for k in reversed(range(nodes)):
            value[:, k] = (1 - right[:, k]) * value[:, 2 * k + 1] + right[:, k] * value[:, 2 * k + 2]
        return right, reach, value

    def sums(self, state, x, y, w):
        if state["round"] < 0:
            return np.array([w @ y, w.sum()])
        nodes = len(state["column"])
        right, reach, value = self._pass(state, x)
        error = 2 * w * (value[:, 0] - y)
        gain = value[:, 2 : 2 * nodes + 1 : 2] - value[:, 1 : 2 * nodes : 2]
        turn = -self.sharpness * reach[:, :nodes] * right * (1 - right) * gain
        return np.concatenate([error @ turn, error @ reach[:, nodes:], [w.sum()]])

    def update(self, state, sums):
        if state["round"] < 0:
            return {**state, "leaf": state["leaf"] + sums[0] / max(sums[1], 1e-300), "round": 0}, self.rounds < 1
        nodes, slope = len(state["column"]), sums[:-1] / max(sums[-1], 1e-300)
        after = {**state, "threshold": state["threshold"] - self.rate * slope[:nodes], "leaf": state["leaf"] - self.rate * (slope[nodes:] + self.l2 * state["leaf"]), "round": state["round"] + 1}
        return after, after["round"] >= self.rounds

    def predict(self, state, x):
        return self._pass(state, x)[2][:, 0]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# --- members


@dataclass(frozen=True)
class Member:
    """An estimator with its columns and target, and the weight of each row (1 if none is given; null counts as 0)."""

    estimator: Estimator
    columns: Sequence[str]
    target: str
    weight: Column | None = None


@dataclass
class Model:
    """A function of blocks of columns; one value for a row, or one for each of names."""

    columns: list[str]
    function: Callable[[np.ndarray], np.ndarray]
    names: list[str] = field(default_factory=list)
    state: Any = None

    def predict(self, df: DataFrame, alias: str = "predicted") -> DataFrame:
        """df with the prediction; with several outputs, one column for each, ending in alias."""
        return with_values(df, self.columns, self.function, [f"{n}_{alias}" for n in self.names] or alias)


class Rows:
    """Rows written once, with the columns, targets and weights of members, for any number of fits. Use as a context: the table is deleted at the end."""

    def __init__(self, df: DataFrame, members: Sequence[Member]) -> None:
        self.at = {c: k for k, c in enumerate(dict.fromkeys(c for m in members for c in [*m.columns, m.target]))}
        weights = {id(m.weight): m.weight for m in members}
        self.weight_at = {i: len(self.at) + k for k, i in enumerate(weights)}
        self._held = list(weights.values())  # so that no other column takes an id
        named = df.select(*[F.col(c).alias(f"_v{k}") for c, k in self.at.items()], *[F.lit(1.0).alias(f"_v{self.weight_at[i]}") if w is None else F.coalesce(w.cast("double"), F.lit(0.0)).alias(f"_v{self.weight_at[i]}") for i, w in weights.items()])
        self.table = materialize(numeric(named, named.columns), "members")

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        discard(self.table)

    def fit(self, members: Mapping[Hashable, Member]) -> dict[Hashable, Model]:
        """Every member fitted; a round of all members that are not done is one pass (more only if their sums exceed MOST_NUMBERS)."""
        plan = {name: (m.estimator, [self.at[c] for c in m.columns], self.at[m.target], self.weight_at[id(m.weight)]) for name, m in members.items()}
        state = {name: m.estimator.start(len(m.columns)) for name, m in members.items()}
        left = list(members)
        while left:
            sizes = {n: len(plan[n][0].sums(state[n], np.zeros((0, len(plan[n][1]))), np.zeros(0), np.zeros(0))) for n in left}
            now, size = [], 0
            for n in left:
                if now and size + sizes[n] > MOST_NUMBERS:
                    break
                now.append(n)
                size += sizes[n]
            tasks = [(*plan[n], state[n]) for n in now]

            def step(v, tasks=tasks):
                return np.concatenate([e.sums(s, v[:, x], v[:, y], v[:, w]) for e, x, y, w, s in tasks])

            sums, a, done = block_sums(self.table, step, size), 0, set()
            for n in now:
                state[n], end = plan[n][0].update(state[n], sums[a : a + sizes[n]])
                a += sizes[n]
                if end:
                    done.add(n)
            left = [*[n for n in left if n not in now], *[n for n in now if n not in done]]
        return {n: _model(m.estimator, m.columns, state[n]) for n, m in members.items()}


def _model(estimator: Estimator, columns: Sequence[str], state: Any) -> Model:
    return Model(list(columns), lambda x: estimator.predict(state, x), state=state)


def fit(df: DataFrame, members: Mapping[Hashable, Member]) -> dict[Hashable, Model]:
    with Rows(df, list(members.values())) as rows:
        return rows.fit(members)


def _others(fold: str, folds: int) -> list[Column]:
    return [F.when(F.col(fold) == k, 0.0).when(F.col(fold).isNotNull(), 1.0) for k in range(folds)]


def _by_fold(models: Mapping[tuple[str, int], Model], names: Sequence[str], folds: int, fold: str) -> tuple[list[str], Callable[[np.ndarray], np.ndarray]]:
    """Columns and function that predict each row by the models that did not see its fold."""
    columns = list(dict.fromkeys(c for m in models.values() for c in m.columns))
    parts = [[([columns.index(c) for c in models[n, k].columns], models[n, k].function) for n in names] for k in range(folds)]

    def function(x):
        out = np.full((len(x), len(names)), np.nan)
        for k in range(folds):
            mine = x[:, -1] == k
            if mine.any():
                for j, (at, f) in enumerate(parts[k]):
                    out[mine, j] = f(x[mine][:, at])
        return out

    return [*columns, fold], function


def _null_for_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def out_of_fold(df: DataFrame, members: Mapping[str, tuple[Estimator, Sequence[str]]], target: str, fold: str, folds: int, suffix: str = "_pred") -> tuple[DataFrame, dict[str, Model], dict[tuple[str, int], Model]]:
    """df with each member's prediction from the other folds' rows, the members fitted on all rows, and those of each fold."""
    keep = _others(fold, folds)
    every = F.when(F.col(fold).isNotNull(), 1.0)
    asked = {(n, k): Member(e, cs, target, keep[k]) for n, (e, cs) in members.items() for k in range(folds)}
    asked |= {(n, None): Member(e, cs, target, every) for n, (e, cs) in members.items()}
    found = fit(df, asked)
    whole = {n: found.pop((n, None)) for n in members}
    columns, function = _by_fold(found, list(members), folds, fold)
    names = [f"{n}{suffix}" for n in members]
    return _null_for_nan(with_values(df, columns, function, names), names), whole, found


# --- scores and searches


def accuracy(y: Column, p: Column) -> Column:
    return F.avg(((p > 0.5).cast("int") == y).cast("double"))


def mean_squared_error(y: Column, p: Column) -> Column:
    return F.avg(F.pow(y - p, 2))


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))


def r2(y: Column, p: Column) -> Column:
    """0 where the target does not vary."""
    spread = F.var_pop(y)
    return F.when(spread > 0, 1 - F.avg(F.pow(y - p, 2)) / spread).otherwise(0.0)


def search(df: DataFrame, candidates: Mapping[str, Estimator], columns: Sequence[str], target: str, fold: str, folds: int, scorers: Mapping[str, Scorer]) -> DataFrame:
    """candidate, fold, n and each score of every candidate on the folds that it was not fitted on.

    A scorer is an aggregate of the target and the prediction. All candidates are
    fitted together, predicted together and scored in one aggregation.
    """
    names = list(candidates)
    scored, _, _ = out_of_fold(df.select(*dict.fromkeys([*columns, target, fold])), {f"_m{i}": (candidates[c], columns) for i, c in enumerate(names)}, target, fold, folds, "")
    used = scored.filter(F.col("_m0").isNotNull() & F.col(target).isNotNull())
    y = F.col(target)
    each = [F.struct(F.lit(c).alias("candidate"), F.count(F.lit(1)).alias("n"), *[s(y, F.col(f"_m{i}")).alias(k) for k, s in scorers.items()]) for i, c in enumerate(names)]
    found = used.groupBy(F.col(fold).cast("int").alias("fold")).agg(F.array(*each).alias("_e"))
    return found.select("fold", F.explode("_e").alias("_e")).select("_e.candidate", "fold", "_e.n", *[f"_e.{k}" for k in scorers])


def cross_validate(df: DataFrame, estimator: Estimator, columns: Sequence[str], target: str, fold: str, folds: int, scorers: Mapping[str, Scorer]) -> DataFrame:
    """fold, n and each score of an estimator that is fitted on the other folds."""
    return search(df, {"": estimator}, columns, target, fold, folds, scorers).drop("candidate")


def best_candidate(found: DataFrame, score: str, greater: bool = True) -> DataFrame:
    """candidate and its mean score over the folds; the best one, the first by name on ties."""
    means = found.groupBy("candidate").agg(F.avg(score).alias(score))
    return means.orderBy(F.col(score).desc() if greater else F.col(score), "candidate").limit(1)


# --- ensembles


def bagging(df: DataFrame, key: str, estimator: Estimator | Callable[[int], Estimator], columns: Sequence[str], target: str, bags: int = 10, seed: int = 0, uniform: Callable[[int], Column] | None = None) -> Model:
    """The mean prediction of estimators on bootstraps; a row's count in a bag is Poisson, from its key. With a function of the bag's number, members differ: a forest is a bagging of trees of other seeds."""
    draw = uniform or (lambda b: hash_uniform(F.col(key), seed + b))
    make = estimator if callable(estimator) else lambda _: estimator
    models = list(fit(df, {b: Member(make(b), columns, target, poisson_count(draw(b))) for b in range(bags)}).values())
    return Model(list(columns), lambda x: np.mean([m.function(x) for m in models], axis=0), state=[m.state for m in models])


def stacking(df: DataFrame, members: Mapping[str, tuple[Estimator, Sequence[str]]], final: Estimator, target: str, fold: str, folds: int, passthrough: Sequence[str] = ()) -> Model:
    """A final estimator on the members' out-of-fold predictions (and columns passed through); members are fitted on all rows for later predictions."""
    suffix = free_name(df, "_stacked")
    scored, whole, _ = out_of_fold(df, members, target, fold, folds, suffix)
    last = fit(scored, {"final": Member(final, [*[f"{n}{suffix}" for n in members], *passthrough], target)})["final"]
    columns = list(dict.fromkeys([c for m in whole.values() for c in m.columns] + list(passthrough)))
    parts = [([columns.index(c) for c in m.columns], m.function) for m in whole.values()]
    through = [columns.index(c) for c in passthrough]
    return Model(columns, lambda x: last.function(np.column_stack([*[f(x[:, at]) for at, f in parts], x[:, through]])), state=last.state)


def calibrated(df: DataFrame, estimator: Estimator, columns: Sequence[str], target: str, fold: str, folds: int, ensemble: bool = True) -> Model:
    """Probabilities calibrated by a sigmoid on rows that the estimator did not see.

    As an ensemble, each fold's estimator is calibrated on its own fold and the mean
    predicts; otherwise one sigmoid, fitted to all predictions out of fold, follows the
    estimator that saw all rows.
    """
    score = free_name(df, "_score")
    scored, whole, parts = out_of_fold(df, {score: (estimator, columns)}, target, fold, folds, "")
    if not ensemble:
        turn, base = fit(scored, {"all": Member(Sigmoid(), [score], target)})["all"], whole[score]
        return Model(list(columns), lambda x: turn.function(base.function(x)[:, None]), state=turn.state)
    own = fit(scored, {k: Member(Sigmoid(), [score], target, F.when(F.col(fold) == k, 1.0)) for k in range(folds)})
    pairs = [(parts[score, k], own[k]) for k in range(folds) if own[k].state["counts"].sum()]
    return Model(list(columns), lambda x: np.mean([turn.function(base.function(x)[:, None]) for base, turn in pairs], axis=0), state=[turn.state for _, turn in pairs])


def multi_output(df: DataFrame, estimator: Estimator, columns: Sequence[str], targets: Sequence[str]) -> Model:
    """A model of every target, fitted in the same passes."""
    models = fit(df, {t: Member(estimator, columns, t) for t in targets})
    return Model(list(columns), lambda x: np.column_stack([models[t].function(x) for t in targets]), list(targets))


def chain(df: DataFrame, estimator: Estimator, columns: Sequence[str], targets: Sequence[str], classes: bool = True, fold: str | None = None, folds: int = 0) -> Model:
    """Models in a chain: each sees the columns and the targets before it, which enter as predicted (as classes or as they come).

    Models are fitted on the true earlier targets, all in the same passes; with folds,
    on what the earlier models predict out of fold, one target after the other.
    """
    turn = (lambda p: (p > 0.5).astype(float)) if classes else (lambda p: p)
    if fold is None:
        models = fit(df, {t: Member(estimator, [*columns, *targets[:k]], t) for k, t in enumerate(targets)})
    else:
        models, seen = {}, list(columns)
        for t in targets:
            name = free_name(df, f"_{t}_before")
            df, whole, _ = out_of_fold(df, {name: (estimator, list(seen))}, t, fold, folds, "")
            if classes:
                df = df.withColumn(name, (F.col(name) > 0.5).cast("double"))
            models[t] = whole[name]
            seen.append(name)

    def function(x):
        out = []
        for t in targets:
            out.append(models[t].function(np.column_stack([x, *map(turn, out)])))
        return np.column_stack(out)

    return Model(list(columns), function, list(targets))


def eliminate(df: DataFrame, estimator: Estimator, columns: Sequence[str], target: str, fold: str, folds: int, scorer: Scorer, greater: bool = True, least: int = 1, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """Recursive elimination with the number of columns chosen by cross-validation.

    Columns of least importance go, step at a time, in each fold's training rows and in
    all rows alike. Gives (n_features, score: mean over the folds) and (feature, rank: 1
    for those that stay at the best number, then in the reverse order in which they went).
    On ties of scores the fewer columns win, on ties of importance the later column goes.
    """
    keep = _others(fold, folds)
    weights = dict(enumerate(keep)) | {None: F.when(F.col(fold).isNotNull(), 1.0)}
    left = {k: list(columns) for k in weights}
    path, scored = [], {}
    df = df.select(*dict.fromkeys([*columns, target, fold]))
    with Rows(df, [Member(estimator, columns, target, w) for w in weights.values()]) as rows:
        while True:
            models = rows.fit({k: Member(estimator, left[k], target, w) for k, w in weights.items()})
            inputs, function = _by_fold({("_p", k): models[k] for k in range(folds)}, ["_p"], folds, fold)
            each = _null_for_nan(with_values(df, inputs, function, "_p"), ["_p"]).filter(F.col("_p").isNotNull() & F.col(target).isNotNull())
            size = len(left[None])
            scored[size] = each.groupBy(fold).agg(scorer(F.col(target), F.col("_p")).alias("s")).agg(F.avg("s").alias("s")).first()["s"]
            path.append((size, list(left[None])))
            if size <= least:
                break
            drop = min(step, size - least)
            for k in weights:
                value = estimator.importance(models[k].state)
                gone = set(np.argsort(-value, kind="stable")[size - drop :].tolist())
                left[k] = [c for i, c in enumerate(left[k]) if i not in gone]
    best = min(scored, key=lambda n: (-scored[n] if greater else scored[n], n))
    stay = next(names for size, names in path if size == best)
    ranks, rank = dict.fromkeys(stay, 1), 1
    for size, names in sorted(path):
        if size > best:
            rank += 1
            ranks |= {c: rank for c in names if c not in ranks}
    spark = df.sparkSession
    return spark.createDataFrame(sorted(scored.items()), "n_features int, score double"), spark.createDataFrame([(c, ranks[c]) for c in columns], "feature string, rank int")
