"""Estimators whose steps are sums over blocks of rows: kernel machines, networks, gradient descent and mini-batch means.

A step is a function of a block of rows that gives a vector; tasks add it up over
their Arrow batches and Spark adds up the tasks, so what reaches the driver has the
size of the model and not of the data. Models are small (at most MOST_NUMBERS) and
go to the tasks with the functions. Rows with a null or NaN in a column that is
used are left out of fits, and predicted as null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import present
from ..sources.shared import materialize
from ..sources.ship import send_package
from .ordering import free_name, order_statistics

#: Numbers of a model or of a sum; more are refused, since they meet on the driver.
MOST_NUMBERS = 1 << 20


def numeric(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """The columns as doubles, after those to keep; rows with a gap are left out."""
    rows = df.select(*keep, *[present(df, c).cast("double").alias(c) for c in columns])
    return rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def _block(batch, first: int = 0) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]], axis=1)


def block_sums(rows: DataFrame, step: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows (numeric columns without gaps) of what step makes of blocks of them."""
    if size > MOST_NUMBERS:
        raise ValueError(f"a sum of {size} numbers")
    send_package(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                total += step(_block(b.slice(a, 4096)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "x"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # size rows at most
        out[r["k"]] = r["x"]
    return out


def with_values(df: DataFrame, columns: Sequence[str], function: Callable[[np.ndarray], np.ndarray], alias: str | Sequence[str]) -> DataFrame:
    """df with a double that function makes of blocks of its columns, or one for each name of a list; null for rows with a gap."""
    aliases = [alias] if isinstance(alias, str) else list(alias)
    x = free_name(df, "_x")
    packed = df.withColumn(x, F.array(*[F.coalesce(present(df, c).cast("double"), F.lit(float("nan"))) for c in columns]))
    at, width, names = packed.columns.index(x), len(columns), df.columns
    send_package(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for a in range(0, b.num_rows, 4096):
                some = b.slice(a, 4096)
                v = some.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                good = ~np.isnan(v).any(axis=1)
                out = np.zeros((len(v), len(aliases)))
                if good.any():
                    out[good] = function(v[good]).reshape(-1, len(aliases))
                columns_ = [c for k, c in enumerate(some.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns_, *[pa.array(out[:, k], mask=~good) for k in range(len(aliases))]], [*names, *aliases])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return packed.mapInArrow(run, ", ".join([schema, *[f"`{a}` double" for a in aliases]]))


# --- kernels as features


def feature_map(kernel: str, width: int, gamma: float = 1.0, degree: int = 3, coef0: float = 1.0, n_features: int = 256, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """A map whose inner products are the kernel: x.y, or (gamma x.y + coef0) ** degree, exactly; exp(-gamma |x - y|^2) by random Fourier features, off by about 1 / sqrt(n_features)."""
    if kernel == "linear":
        return lambda x: x
    if kernel in ("poly", "polynomial", "quadratic"):
        degree = 2 if kernel == "quadratic" else degree
        # of the degree factors, some take coef0 and the others one column each
        terms = [t for k in range(degree + 1) for t in combinations_with_replacement(range(width), k)]
        if len(terms) ** 2 > MOST_NUMBERS:
            raise ValueError(f"{len(terms)} features")

        def scale(t):
            counts = [t.count(c) for c in set(t)]
            ways = factorial(degree) // factorial(degree - len(t)) // int(np.prod([factorial(c) for c in counts]))
            return np.sqrt(ways * gamma ** len(t) * coef0 ** (degree - len(t)))

        scales = [scale(t) for t in terms]
        return lambda x: np.stack([s * np.prod(x[:, list(t)], axis=1) for s, t in zip(scales, terms)], axis=1)
    if kernel == "rbf":
        rng = np.random.default_rng(seed)
        ways, shift = rng.normal(0, np.sqrt(2 * gamma), (width, n_features)), rng.uniform(0, 2 * np.pi, n_features)
        return lambda x: np.sqrt(2 / n_features) * np.cos(x @ ways + shift)
    raise ValueError(f"no kernel {kernel}")


def scale_gamma(rows: DataFrame, columns: Sequence[str]) -> float:
    """1 / (columns * variance of all their values)."""
    d = len(columns)
    # shifted by the first moments, so that the variance keeps its digits
    n, *sums = block_sums(rows.select(*columns), lambda x: np.array([len(x), *x.sum(axis=0)]), d + 1)
    mean = np.sum(sums) / max(1, n * d)
    square = block_sums(rows.select(*columns), lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0]
    return 1 / (d * square / (n * d)) if square else 1.0


@dataclass
class KernelMachine:
    """A linear function of kernel features, less a threshold."""

    columns: list[str]
    features: Callable[[np.ndarray], np.ndarray]
    weights: np.ndarray
    threshold: float = 0.0

    def predict(self, df: DataFrame, alias: str = "predicted") -> DataFrame:
        features, weights, threshold = self.features, self.weights, self.threshold
        return with_values(df, self.columns, lambda x: features(x) @ weights - threshold, alias)


def one_class_svm(df: DataFrame, columns: Sequence[str], nu: float = 0.1, kernel: str = "rbf", gamma: float | str = "scale", degree: int = 3, n_features: int = 256, seed: int = 0) -> KernelMachine:
    """The mean kernel to the rows that lie best inside, less its nu-quantile over all rows; negative predictions are outliers.

    Inside are the share 1 - nu of rows with the greatest mean kernel to all rows;
    rows that tie at the limit are all inside.
    """
    rows = materialize(numeric(df, columns), "rows")
    width = len(columns)
    gamma = scale_gamma(rows, columns) if gamma == "scale" else 1 / width if gamma == "auto" else float(gamma)
    features = feature_map(kernel, width, gamma, degree, 1.0, n_features, seed)
    size = features(np.zeros((1, width))).shape[1]
    n = rows.count()
    if not n:
        raise ValueError("no rows")
    centre = block_sums(rows, lambda x: features(x).sum(axis=0), size) / n
    score = with_values(rows, columns, lambda x: features(x) @ centre, "_score")
    score = materialize(score, "scores")
    inside = max(1, int(n * (1 - nu)))
    least = order_statistics(score, {"s": F.col("_score")}, ((n - inside) / max(1, n - 1),))["s"][0]
    least -= 1e-12 * max(1.0, abs(least))  # a quantile is found by interpolation
    held = score.filter(F.col("_score") >= F.lit(least))
    support = block_sums(held.select(*columns), lambda x: np.append(features(x).sum(axis=0), len(x)), size + 1)
    machine = KernelMachine(list(columns), features, support[:-1] / support[-1])
    raw = machine.predict(rows, "_score")
    machine.threshold = order_statistics(raw, {"s": F.col("_score")}, (nu,))["s"][0]
    return machine


def svm_regressor(df: DataFrame, columns: Sequence[str], target: str, c: float = 1.0, kernel: str = "polynomial", degree: int = 2, gamma: float | str = "scale", coef0: float = 1.0, n_features: int = 256, seed: int = 0) -> KernelMachine:
    """Ridge in the kernel's features with penalty 1 / (2 c) and no intercept, from one Gram matrix that is summed in blocks."""
    rows = materialize(numeric(df, [*columns, target]), "rows")
    width = len(columns)
    gamma = scale_gamma(rows, columns) if gamma == "scale" else 1 / width if gamma == "auto" else float(gamma)
    features = feature_map(kernel, width, gamma, degree, coef0, n_features, seed)
    size = features(np.zeros((1, width))).shape[1]

    def gram(x):
        z = features(x[:, :-1])
        return np.concatenate([(z.T @ z).ravel(), z.T @ x[:, -1]])

    sums = block_sums(rows, gram, size * size + size)
    weights = np.linalg.solve(sums[: size * size].reshape(size, size) + np.eye(size) / (2 * c), sums[size * size :])
    return KernelMachine(list(columns), features, weights)


# --- stochastic gradients


_GRADIENTS = {
    "squared_error": lambda e: e,
    "huber": lambda e: min(1.35, max(-1.35, e)),
    "epsilon_insensitive": lambda e: 0.0 if abs(e) <= 0.1 else (1.0 if e > 0 else -1.0),
}


def sgd_regressor(df: DataFrame, key: str, columns: Sequence[str], target: str, loss: str = "squared_error", penalty: str = "l2", alpha: float = 0.0001, l1_ratio: float = 0.15, eta0: float = 0.01, power_t: float = 0.25, learning_rate: str = "invscaling", max_iter: int = 10, shards: int = 8, seed: int = 0) -> dict[str, float]:
    """Coefficients after max_iter epochs, one row at a time within each shard.

    Rows are dealt to shards by a hash of the key; in every epoch a shard goes
    through its rows in the order of another hash, starting from the coefficients of
    the epoch before, and the results are averaged with the shards' numbers of rows
    as weights. With one shard this is plain stochastic descent. Steps of a shard
    count on through the epochs.
    """
    gradient = _GRADIENTS[loss]
    l1 = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty] * alpha
    l2 = {"l2": 1.0, "l1": 0.0, "elasticnet": 1 - l1_ratio}[penalty] * alpha
    rate = {"constant": lambda t: eta0, "adaptive": lambda t: eta0, "optimal": lambda t: 1 / (alpha * (t + 1)), "invscaling": lambda t: eta0 / (t + 1) ** power_t}[learning_rate]
    d = len(columns)
    names = [f"_c{k}" for k in range(d)]
    send_package(df.sparkSession)
    rows = numeric(df, [*columns, target], key)
    shard = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shards)).cast("int")
    rows = materialize(rows.select(shard.alias("_shard"), F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in zip(columns, names)], F.col(target).alias("_y")), "rows")
    sizes = {r["_shard"]: r["n"] for r in rows.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    w = np.zeros(d + 1)
    for epoch in range(max_iter):
        dealt = rows.withColumn("_turn", F.xxhash64("_key", F.lit(seed), F.lit(epoch))).repartition("_shard").sortWithinPartitions("_shard", "_turn", "_key", *names, "_y")

        def run(batches, start=w, epoch=epoch):
            import pyarrow as pa

            at, n, out = None, 0, []
            for b in batches:
                values = _block(b.select([*names, "_y"]))
                for part, row in zip(b.column(b.schema.get_field_index("_shard")).to_pylist(), values):
                    if part != at:
                        if n:
                            out.append((n, now))
                        at, n, now = part, 0, start.copy()
                        held = sizes[part]
                    n += 1
                    x, y = row[:-1], row[-1]
                    eta = rate(epoch * held + n)
                    g = gradient(x @ now[1:] + now[0] - y)
                    now[1:] = (1 - eta * l2) * now[1:] - eta * g * x
                    if l1:
                        now[1:] = np.sign(now[1:]) * np.maximum(np.abs(now[1:]) - eta * l1, 0)
                    now[0] -= eta * g
            if n:
                out.append((n, now))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([list(v) for _, v in out], pa.list_(pa.float64()))], ["n", "w"])

        found = dealt.select("_shard", *names, "_y").mapInArrow(run, "n long, w array<double>").collect()  # a row for each shard
        if not found:
            break
        found = sorted(found, key=lambda r: (r["n"], r["w"]))
        w = sum(r["n"] * np.array(r["w"]) for r in found) / sum(r["n"] for r in found)
    return dict(zip(["intercept", *columns], w.tolist()))


# --- networks


_ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda z: (z > 0).astype(float)),
    "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))) * (1 - 1 / (1 + np.exp(-np.clip(z, -500, 500))))),
    "identity": (lambda z: z, np.ones_like),
}


@dataclass
class Network:
    """Layers of weights; training is whole-batch gradient descent with the gradients summed in blocks."""

    columns: list[str]
    layers: Sequence[int]
    activation: str = "tanh"
    output: str = "identity"
    rate: float = 0.1
    momentum: float = 0.9
    l2: float = 0.0
    clip: float | None = None
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        sizes = list(self.layers)
        if len(self.columns) != sizes[0]:
            raise ValueError("the first layer has a unit for each column")
        self.weights = [np.vstack([rng.normal(0, np.sqrt(2 / (a + b)), (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]  # biases last

    def _kinds(self) -> list[str]:
        return [self.activation] * (len(self.weights) - 1) + [self.output]

    def fit(self, df: DataFrame, targets: Sequence[str], epochs: int = 50, tolerance: float | None = None) -> Network:
        """Mean squared error over rows and outputs; stops early once an epoch gains less than tolerance."""
        rows = materialize(numeric(df.select(*[F.col(c).alias(f"_x{k}") for k, c in enumerate(self.columns)], *[F.col(c).alias(f"_y{k}") for k, c in enumerate(targets)]), [f"_x{k}" for k in range(len(self.columns))] + [f"_y{k}" for k in range(len(targets))]), "rows")
        kinds, d = self._kinds(), len(self.columns)
        speed = [np.zeros_like(w) for w in self.weights]
        for _ in range(epochs):
            weights = self.weights

            def step(block, weights=weights):
                x, y = block[:, :d], block[:, d:]
                inputs, sums = [x], []
                for w, kind in zip(weights, kinds):
                    sums.append(inputs[-1] @ w[:-1] + w[-1])
                    inputs.append(_ACTIVATIONS[kind][0](sums[-1]))
                error = inputs[-1] - y
                back, grads = 2 * error, []
                for k in range(len(weights) - 1, -1, -1):
                    back = back * _ACTIVATIONS[kinds[k]][1](sums[k])
                    grads.append(np.vstack([inputs[k].T @ back, back.sum(axis=0)]).ravel())
                    back = back @ weights[k][:-1].T
                return np.concatenate([*grads[::-1], [(error**2).sum(), error.size]])

            total = block_sums(rows, step, sum(w.size for w in weights) + 2)
            if not total[-1]:
                raise ValueError("no rows")
            self.losses.append(total[-2] / total[-1] + 0.5 * self.l2 * sum((w[:-1] ** 2).sum() for w in weights))
            at, following = 0, []
            for k, w in enumerate(weights):
                g = total[at : at + w.size].reshape(w.shape) / total[-1]
                at += w.size
                g[:-1] += self.l2 * w[:-1]
                if self.clip is not None and (norm := np.linalg.norm(g)) > self.clip:
                    g *= self.clip / norm
                speed[k] = self.momentum * speed[k] - self.rate * g
                following.append(w + speed[k])
            self.weights = following
            if tolerance is not None and len(self.losses) > 1 and self.losses[-2] - self.losses[-1] < tolerance:
                break
        return self

    def forward(self, x: np.ndarray) -> np.ndarray:
        for w, kind in zip(self.weights, self._kinds()):
            x = _ACTIVATIONS[kind][0](x @ w[:-1] + w[-1])
        return x

    def predict(self, df: DataFrame, alias: str = "predicted", k: int = 0) -> DataFrame:
        """Output k; with a sigmoid output, a probability."""
        return with_values(df, self.columns, lambda x: self.forward(x)[:, k], alias)

    def reconstruction_error(self, df: DataFrame, alias: str = "error") -> DataFrame:
        """Of an autoencoder (a network fitted to its own columns): the mean squared difference of a row to what comes out."""
        return with_values(df, self.columns, lambda x: ((self.forward(x) - x) ** 2).mean(axis=1), alias)


# --- mini-batches


def mini_batch_kmeans(df: DataFrame, key: str, columns: Sequence[str], k: int, batches: int = 10, epochs: int = 2, seed: int = 0) -> np.ndarray:
    """Centres, moved by one batch after the other: each to the mean of all rows it was given so far.

    The first centre is the row whose key hashes lowest, each further one the row
    that is furthest from those before (the smallest key on ties). Batches are dealt
    by a hash of the key.
    """
    rows = numeric(df, columns, key)
    dealt = rows.select(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(batches)).cast("int").alias("_batch"), F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    dealt = materialize(dealt, "batches")
    names = [f"_c{i}" for i in range(len(columns))]
    at = _far_apart(dealt, names, k, seed)
    seen = np.zeros(len(at))
    for _ in range(epochs):
        for b in range(batches):
            now = at

            def step(x, now=now):
                to = ((x[:, None] - now[None]) ** 2).sum(axis=2).argmin(axis=1)
                one = np.eye(len(now))[to]
                return np.concatenate([one.sum(axis=0), (one.T @ x).ravel()])

            total = block_sums(dealt.filter(F.col("_batch") == b).select(*names), step, at.size + len(at))
            n, sums = total[: len(at)], total[len(at) :].reshape(at.shape)
            seen += n
            at = np.where(n[:, None] > 0, at + (sums - n[:, None] * at) / np.maximum(seen, 1)[:, None], at)
    return at


def _far_apart(rows: DataFrame, names: Sequence[str], k: int, seed: int) -> np.ndarray:
    """The row whose _key hashes lowest, then k - 1 times the row that is furthest from those before."""
    first = rows.orderBy(F.xxhash64("_key", F.lit(seed), F.lit("first")), "_key").limit(1).collect()
    centres = [[r[n] for n in names] for r in first]
    while centres and len(centres) < k:
        gap = F.least(*[_square(names, c) for c in centres]) if len(centres) > 1 else _square(names, centres[0])
        r = rows.agg(F.max(F.struct(gap.alias("d"), (-F.col("_key")).alias("k"), F.array(*names).alias("v"))).alias("m")).first()["m"]
        centres.append(list(r["v"]))
    return np.array(centres).reshape(-1, len(names))


def kmeans(df: DataFrame, key: str, columns: Sequence[str], k: int, most_rounds: int = 100, tolerance: float = 1e-8, seed: int = 0) -> np.ndarray:
    """Centres that start far apart, as mini_batch_kmeans()'s do, and move to the means of the rows nearest to them until none moves by more than tolerance. A centre that no row is nearest to stays."""
    rows = numeric(df, columns, key).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    rows, names = materialize(rows, "rows"), [f"_c{i}" for i in range(len(columns))]
    at = _far_apart(rows, names, k, seed)
    for _ in range(most_rounds if len(at) else 0):

        def step(x, now=at):
            one = np.eye(len(now))[((x[:, None] - now[None]) ** 2).sum(axis=2).argmin(axis=1)]
            return np.concatenate([one.sum(axis=0), (one.T @ x).ravel()])

        total = block_sums(rows.select(*names), step, at.size + len(at))
        n, sums = total[: len(at), None], total[len(at) :].reshape(at.shape)
        to = np.where(n > 0, sums / np.maximum(n, 1), at)
        moved, at = np.abs(to - at).max(), to
        if moved <= tolerance:
            break
    return at


def _square(names: Sequence[str], centre: Sequence[float]):
    return reduce(lambda a, b: a + b, [F.pow(F.col(n) - F.lit(float(v)), 2) for n, v in zip(names, centre)])


def assign_nearest(df: DataFrame, columns: Sequence[str], centres: np.ndarray, alias: str = "cluster") -> DataFrame:
    """df with the number of the nearest centre, the first of equal ones."""
    return with_values(df, columns, lambda x: ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1).astype(float), alias).withColumn(alias, F.col(alias).cast("int"))
