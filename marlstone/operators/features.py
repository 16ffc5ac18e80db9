"""Feature preprocessing as fit and transform.

fit() computes the parameters of all columns in one aggregation, a one-row
DataFrame; transform() broadcasts that row and evaluates plain expressions, so no
row leaves the JVM. Missing values are ignored by fits and stay null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import box_cox, clip, interpolate, normal_quantile, present, yeo_johnson
from ..sources.shared import discard, materialize
from .neighbors import Cells, Kernel
from .ordering import most_frequent, order_statistics


class ColumnwiseTransformer:
    """Base of the scalers: statistics of a column and an expression over value and statistics."""

    def __init__(self, columns: Sequence[str]) -> None:
        self.columns = list(columns)
        self.params: DataFrame | None = None

    #: Percentiles that stats() needs, found exactly without moving a column to one task.
    fractions: Sequence[float] = ()

    def stats(self, c: Column, q: Column | None = None) -> dict[str, Column]:
        """Statistics of a column; q is the array of its percentiles at fractions."""
        return {}

    def forward(self, c: Column, s: dict[str, Column]) -> Column:
        raise NotImplementedError

    def backward(self, c: Column, s: dict[str, Column]) -> Column:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> ColumnwiseTransformer:
        found = order_statistics(df, {c: present(df, c) for c in self.columns}, self.fractions) if self.fractions else {}
        q = {c: F.array(*map(F.lit, found[c])).cast("array<double>") if found else None for c in self.columns}
        self.params = df.agg(*[F.struct(*[v.alias(k) for k, v in self.stats(present(df, c).cast("double"), q[c]).items()] or [F.lit(0).alias("none")]).alias(f"_{c}") for c in self.columns])
        return self

    def _apply(self, df: DataFrame, how: Callable) -> DataFrame:
        fields = {c: list(self.stats(F.col(c))) for c in self.columns}
        joined = df.crossJoin(F.broadcast(self.params))
        changed = {c: how(present(df, c).cast("double"), {k: F.col(f"_{c}")[k] for k in fields[c]}) for c in self.columns}
        return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self.forward)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self.backward)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_params(self) -> dict:
        """Fitted parameters by column (one row is collected)."""
        return {c: v.asDict() for c, v in zip(self.columns, self.params.first())}


def _or_one(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(c)


class StandardScaler(ColumnwiseTransformer):
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""

    def __init__(self, columns: Sequence[str], with_mean: bool = True, with_std: bool = True) -> None:
        super().__init__(columns)
        self.with_mean, self.with_std = with_mean, with_std

    def stats(self, c, q=None):
        return {"mean": F.avg(c) if self.with_mean else F.lit(0.0), "scale": _or_one(F.stddev_pop(c)) if self.with_std else F.lit(1.0)}

    def forward(self, c, s):
        return (c - s["mean"]) / s["scale"]

    def backward(self, c, s):
        return c * s["scale"] + s["mean"]


class MinMaxScaler(ColumnwiseTransformer):
    """To a range; the two families of the API differ in its default, (-1, 1) and (0, 1)."""

    def __init__(self, columns: Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0)) -> None:
        super().__init__(columns)
        self.low, self.high = feature_range

    def stats(self, c, q=None):
        return {"least": F.min(c), "width": _or_one(F.max(c) - F.min(c))}

    def forward(self, c, s):
        return (c - s["least"]) / s["width"] * (self.high - self.low) + self.low

    def backward(self, c, s):
        return (c - self.low) / (self.high - self.low) * s["width"] + s["least"]


class MaxAbsScaler(ColumnwiseTransformer):
    def stats(self, c, q=None):
        return {"scale": _or_one(F.max(F.abs(c)))}

    def forward(self, c, s):
        return c / s["scale"]

    def backward(self, c, s):
        return c * s["scale"]


class RobustScaler(ColumnwiseTransformer):
    """(x - median) / (quantile range), with exact linear percentiles."""

    def __init__(self, columns: Sequence[str], quantile_range: tuple[float, float] = (25.0, 75.0)) -> None:
        super().__init__(columns)
        self.fractions = [quantile_range[0] / 100, 0.5, quantile_range[1] / 100]

    def stats(self, c, q=None):
        return {"q": q}

    def forward(self, c, s):
        return (c - s["q"][1]) / _or_one(s["q"][2] - s["q"][0])

    def backward(self, c, s):
        return c * _or_one(s["q"][2] - s["q"][0]) + s["q"][1]


class OutlierHandler(ColumnwiseTransformer):
    """Clip values to IQR or z bounds, or make them null."""

    def __init__(self, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5, strategy: str = "clip") -> None:
        super().__init__(columns)
        self.method, self.threshold, self.strategy = method, threshold, strategy
        self.fractions = (0.25, 0.75) if method == "iqr" else ()

    def stats(self, c, q=None):
        if self.method == "iqr":
            return {"q": q}
        return {"q": F.array(F.avg(c) - self.threshold * F.stddev_pop(c), F.avg(c) + self.threshold * F.stddev_pop(c))}

    def forward(self, c, s):
        low, high = s["q"][0], s["q"][1]
        if self.method == "iqr":
            low, high = low - self.threshold * (high - low), high + self.threshold * (high - low)
        return clip(c, low, high) if self.strategy == "clip" else F.when((c >= low) & (c <= high), c)


class QuantileTransformer(ColumnwiseTransformer):
    """Position among n_quantiles percentiles, uniform or mapped to the normal distribution."""

    def __init__(self, columns: Sequence[str], n_quantiles: int = 100, output: str = "uniform") -> None:
        super().__init__(columns)
        self.fractions, self.output = [k / (n_quantiles - 1) for k in range(n_quantiles)], output

    def stats(self, c, q=None):
        return {"q": q}

    def forward(self, c, s):
        u = interpolate(c, s["q"], F.array(*map(F.lit, self.fractions)))
        return u if self.output == "uniform" else normal_quantile(u)


class PowerTransformer(ColumnwiseTransformer):
    """Yeo-Johnson or Box-Cox with the exponent of a grid of 41 that maximises -ln(variance) / 2, then standardised."""

    GRID = [k / 10 - 2 for k in range(41)]

    def __init__(self, columns: Sequence[str], method: str = "yeo-johnson", standardize: bool = True) -> None:
        super().__init__(columns)
        self.power, self.standardize = (yeo_johnson if method == "yeo-johnson" else box_cox), standardize

    def stats(self, c, q=None):
        tried = [(F.struct(F.var_pop(self.power(c, F.lit(g))).alias("v"), F.lit(k).alias("k"), F.avg(self.power(c, F.lit(g))).alias("m"))) for k, g in enumerate(self.GRID)]
        best = F.array_min(F.filter(F.array(*tried), lambda x: x["v"] > 0))
        return {"lam": F.element_at(F.array(*map(F.lit, self.GRID)), best["k"] + 1), "mean": best["m"], "scale": _or_one(F.sqrt(best["v"]))}

    def forward(self, c, s):
        out = self.power(c, s["lam"])
        return (out - s["mean"]) / s["scale"] if self.standardize else out


class SimpleImputer(ColumnwiseTransformer):
    """mean, median, most_frequent (ties: smallest) or constant; a column without values becomes 0."""

    def __init__(self, columns: Sequence[str], strategy: str = "mean", fill_value: float | None = None) -> None:
        super().__init__(columns)
        self.strategy, self.fill_value = strategy, fill_value
        self.fractions = (0.5,) if strategy == "median" else ()

    def fit(self, df: DataFrame) -> SimpleImputer:
        if self.strategy != "most_frequent":
            return super().fit(df)
        modes = {c: most_frequent(df, present(df, c).cast("double")).first() for c in self.columns}
        self.params = df.sparkSession.range(1).select(*[F.struct(F.lit(m[0] if (m := modes[c]) else 0.0).alias("fill")).alias(f"_{c}") for c in self.columns])
        return self

    def stats(self, c, q=None):
        made = {"mean": lambda: F.avg(c), "median": lambda: q[0] if q is not None else F.lit(None), "constant": lambda: F.lit(float(self.fill_value or 0)), "most_frequent": lambda: F.lit(None)}
        return {"fill": F.coalesce(made[self.strategy](), F.lit(0.0))}

    def forward(self, c, s):
        return F.coalesce(c, s["fill"])


class KBinsDiscretizer(ColumnwiseTransformer):
    """Ordinal bin of equal width or equal frequency; the right edge belongs to the last bin."""

    def __init__(self, columns: Sequence[str], n_bins: int = 5, strategy: str = "quantile") -> None:
        super().__init__(columns)
        self.n_bins, self.strategy = n_bins, strategy
        self.fractions = [k / n_bins for k in range(n_bins + 1)] if strategy == "quantile" else ()

    def stats(self, c, q=None):
        if self.strategy == "quantile":
            return {"edges": q}
        return {"edges": F.transform(F.sequence(F.lit(0), F.lit(self.n_bins)), lambda k: F.min(c) + k * (F.max(c) - F.min(c)) / self.n_bins)}

    def forward(self, c, s):
        at = F.size(F.filter(s["edges"], lambda e: e <= c)) - 1
        return F.when(c.isNotNull(), clip(at, 0, self.n_bins - 1).cast("double"))


def binarize(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: (F.col(c) > threshold).cast("double") for c in columns})


def normalize_rows(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Each row divided by its L1, L2 or maximum norm; a norm of 0 counts as 1."""
    values = F.array(*[F.abs(F.col(c).cast("double")) for c in columns])
    add = lambda f: F.aggregate(values, F.lit(0.0), f)
    size = {"l1": lambda: add(lambda a, x: a + x), "l2": lambda: F.sqrt(add(lambda a, x: a + x * x)), "max": lambda: F.array_max(values)}[norm]()
    return df.withColumn("_norm", _or_one(size)).withColumns({c: F.col(c) / F.col("_norm") for c in columns}).drop("_norm")


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct values; they name columns or codes, so they are few and are collected."""
    return [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def one_hot(df: DataFrame, column: str, values: Sequence, drop: str | None = None, unknown: str = "ignore") -> DataFrame:
    """An indicator column for each category; drop: None, first or if_binary; unknown values raise or give zeros."""
    kept = list(values)[1:] if drop == "first" or (drop == "if_binary" and len(values) == 2) else list(values)
    c = F.col(column)
    check = F.when(c.isNotNull() & ~c.isin(*values), F.raise_error(F.lit(f"unknown category in {column}"))) if unknown == "error" else None
    flags = {f"{column}_{v}": (F.coalesce(c == v, F.lit(False)) if check is None else F.coalesce(check.cast("boolean"), c == v)).cast("double") for v in kept}
    return df.withColumns(flags)


def ordinal(df: DataFrame, column: str, values: Sequence, unknown_value: int = -1) -> Column:
    """Index of the category in sorted order."""
    return (F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0)), F.lit(unknown_value + 1)) - 1).cast("int")


def target_encoding(df: DataFrame, column: str, target: str, form: str = "m", smoothing: float = 1.0, min_leaf: int = 1) -> DataFrame:
    """Encoding of each category: form m blends by counts, form sigmoid by 1 / (1 + exp(-(n - min_leaf) / smoothing))."""
    groups = df.groupBy(column).agg(F.count(target).alias("n"), F.avg(target).alias("mean"))
    groups = groups.crossJoin(F.broadcast(df.agg(F.avg(target).alias("overall"))))
    n, mean, overall = F.col("n"), F.col("mean"), F.col("overall")
    if form == "m":
        blend = (n * mean + smoothing * overall) / (n + smoothing)
    else:
        w = 1 / (1 + F.exp(-(n - min_leaf) / smoothing))
        blend = w * mean + (1 - w) * overall
    return groups.select(column, F.when(n < min_leaf, overall).otherwise(blend).alias("encoding"))


def encode_target(df: DataFrame, encoding: DataFrame, column: str, overall: float | Column) -> DataFrame:
    """Categories replaced by their encodings, unseen ones by the overall mean; Spark picks the join from the table's size."""
    fill = overall if isinstance(overall, Column) else F.lit(overall)
    return df.join(encoding, column, "left").withColumn("encoding", F.coalesce("encoding", fill))


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2, interaction_only: bool = False, include_bias: bool = True) -> DataFrame:
    """Monomials up to a degree, in graded order, named like x0^2*x1."""
    choose = combinations if interaction_only else combinations_with_replacement
    out = {"bias": F.lit(1.0)} if include_bias else {}
    for d in range(1, degree + 1):
        for picked in choose(columns, d):
            name = "*".join(c if (k := picked.count(c)) == 1 else f"{c}^{k}" for c in dict.fromkeys(picked))
            product = F.col(picked[0]).cast("double")
            for c in picked[1:]:
                product = product * F.col(c)
            out[name] = product
    return df.select(*[c for c in df.columns if c not in columns], *[v.alias(k) for k, v in out.items()])


def interaction_features(df: DataFrame, columns: Sequence[str], include_self: bool = False) -> DataFrame:
    """The columns followed by their pairwise products."""
    pairs = combinations_with_replacement(columns, 2) if include_self else combinations(columns, 2)
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs})


def missing_indicator(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*df.columns, *[present(df, c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


class _Donors(Kernel):
    """The k donors nearest to each held row over the columns that both have, and the weighted means of their values."""

    def __init__(self, k: int, weighted: bool) -> None:
        super().__init__()
        self.k, self.weighted = k, weighted

    def start(self, site, v, has):
        n, width = v.shape
        self.d, self.key = np.full((n, self.k), np.inf), np.full((n, self.k), np.iinfo(np.int64).max)
        self.value, self.given = np.zeros((n, self.k, width)), np.zeros((n, self.k, width), bool)

    def visit(self, site, v, has):
        if not self._parts:
            return
        _, mine, own = self.held
        bits = np.arange(v.shape[1])
        owns, gives = (own[:, None] >> bits) & 1 == 1, (has[:, None] >> bits) & 1 == 1
        step = max(1, (1 << 20) // max(1, len(mine)))
        for a in range(0, len(site), step):
            some = slice(a, a + step)
            total, met = np.zeros((len(mine), len(site[some]))), np.zeros((len(mine), len(site[some])), bool)
            for c in bits:
                both = owns[:, c, None] & gives[None, some, c]
                diff = mine[:, c, None] - v[None, some, c]
                total += np.where(both, diff * diff, 0.0)
                met |= both
            d = np.concatenate([self.d, np.where(met, np.sqrt(total), np.inf)], axis=1)
            key = np.concatenate([self.key, np.broadcast_to(site[some], total.shape)], axis=1)
            first = np.lexsort((key, d), axis=1)[:, : self.k]
            pick = lambda old, new: np.take_along_axis(np.concatenate([old, np.broadcast_to(new, (len(mine), *new.shape))], axis=1), first[:, :, None], 1)  # noqa: E731, B023
            self.value, self.given = pick(self.value, v[some]), pick(self.given, gives[some])
            self.d, self.key = np.take_along_axis(d, first, 1), np.take_along_axis(key, first, 1)

    def result(self):
        w = (1 / (self.d + 1e-10) if self.weighted else np.ones_like(self.d))[:, :, None] * self.given
        total = w.sum(axis=1)
        means = np.where(total > 0, (w * self.value).sum(axis=1) / np.where(total > 0, total, 1.0), np.nan)
        return {"site": self.held[0], "means": list(means)}

    def nothing(self):
        import pyarrow as pa

        return {"site": pa.array([], pa.int64()), "means": pa.array([], pa.list_(pa.float64()))}


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], k: int = 5, weights: str = "uniform") -> DataFrame:
    """Missing values from the k nearest rows by the distance over features that both rows have; keys are integers.

    Ties go by key; rows that share no feature are infinitely far. Such distances
    bound nothing, so blocks of rows with gaps meet all rows, and k donors of each
    are held.
    """
    rows = materialize(df.select(key, *[present(df, c).cast("double").alias(c) for c in columns]), "rows")
    has = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns)])
    coded = rows.select(F.col(key).cast("long").alias("site"), F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns]).alias("v"), has.alias("has"))
    gaps = materialize(coded.filter(F.col("has") != (1 << len(columns)) - 1), "gaps")
    cells = Cells(gaps)
    means = cells.sweep(cells.housed(gaps), coded, "double('infinity')", lambda: _Donors(k, weights != "uniform"), "site long, means array<double>")
    overall = rows.agg(*[F.avg(c).alias(f"_{c}_mean") for c in columns])
    filled = rows.join(means, F.col(key) == F.col("site"), "left").crossJoin(F.broadcast(overall))
    donor = lambda i: F.nanvl(F.get("means", F.lit(i)), F.lit(None).cast("double"))
    return filled.select(key, *[F.coalesce(c, donor(i), f"_{c}_mean").alias(c) for i, c in enumerate(columns)])


class Pipeline:
    """Named steps with column subsets; each step is fitted on the output of the one before."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, ColumnwiseTransformer]] = []

    def add_step(self, name: str, step: ColumnwiseTransformer) -> Pipeline:
        self.steps.append((name, step))
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.fit_transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Fitted parameters as JSON lines."""
        rows = [(name, type(step).__name__, json.dumps(step.get_params(), default=str)) for name, step in self.steps]
        spark.createDataFrame(rows, "name string, kind string, params string").coalesce(1).write.mode("overwrite").json(path)


def standard_pipeline(columns: Sequence[str], outliers: bool = False, scaling: str = "standard") -> Pipeline:
    """Mean imputation, optional clipping, scaling."""
    out = Pipeline().add_step("missing", SimpleImputer(columns))
    if outliers:
        out.add_step("outliers", OutlierHandler(columns))
    scalers = {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler, "maxabs": MaxAbsScaler}
    return out.add_step("scale", scalers[scaling](columns))


def _named(df: DataFrame, name: str, make: Callable[[Sequence[str]], ColumnwiseTransformer], columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with the transformer's output beside its columns, as name__column."""
    made = {f"{name}__{c}": F.col(c) for c in columns}
    return make(list(made)).fit_transform(df.withColumns(made)), list(made)


def column_transform(df: DataFrame, steps: Sequence[tuple[str, Callable[[Sequence[str]], ColumnwiseTransformer], Sequence[str]]], remainder: str = "drop") -> DataFrame:
    """Each transformer over its own columns, as name__column; other columns are dropped or passed through."""
    used = {c for _, _, columns in steps for c in columns}
    kept = [c for c in df.columns if c not in used] if remainder == "passthrough" else []
    out: list[str] = []
    for name, make, columns in steps:
        df, names = _named(df, name, make, columns)
        out += names
    return df.select(*kept, *out)


def feature_union(df: DataFrame, columns: Sequence[str], makers: dict[str, Callable[[Sequence[str]], ColumnwiseTransformer]], weights: dict[str, float] | None = None) -> DataFrame:
    """All transformers over the same columns, side by side as name__column, times their weights; other columns stay."""
    for name, make in makers.items():
        df, names = _named(df, name, make, columns)
        df = df.withColumns({c: F.col(c) * (weights or {}).get(name, 1.0) for c in names})
    return df.drop(*columns)


def categorical_pipeline(df: DataFrame, columns: Sequence[str], encoding: str = "onehot", scaling: str | None = "standard") -> DataFrame:
    """Categories as indicators (onehot) or codes (ordinal) in place of their columns, then scaled."""
    made: list[str] = []
    for c in columns:
        values = categories(df, c)
        df = one_hot(df, c, values) if encoding == "onehot" else df.withColumn(f"{c}_code", ordinal(df, c, values).cast("double"))
        made += [f"{c}_{v}" for v in values] if encoding == "onehot" else [f"{c}_code"]
    scalers = {"standard": StandardScaler, "minmax": MinMaxScaler}
    df = df.drop(*columns)
    return scalers[scaling](made).fit_transform(df) if scaling else df


def iterative_impute(df: DataFrame, columns: Sequence[str], rounds: int = 10, tol: float = 1e-3, linear: bool = True) -> DataFrame:
    """Missing values from a linear model of each column on the others, column by column, until fills settle.

    Fills start as means (and stay means with linear=False). A step fits one column on
    the rows that have it, by one aggregation, and writes the rows that lack any
    column; complete rows are summed once and never written. Stops after a round whose
    largest change is below tol times the largest value. A column without any value stays null.
    """
    values = {c: present(df, c).cast("double") for c in columns}
    means = df.agg(*[F.avg(v).alias(c) for c, v in values.items()]).first()
    if not linear:
        return df.withColumns({c: F.coalesce(v, F.lit(means[c])) for c, v in values.items()})
    used = [c for c in columns if means[c] is not None]
    if not used:
        return df.withColumns(values)
    lacking = F.lit(False)
    for c in used:
        lacking = lacking | values[c].isNull()
    complete = _sums(df.filter(~lacking).select(*[values[c].alias(c) for c in used]), used)
    gaps = df.filter(lacking).withColumns({f"_lack_{c}": values[c].isNull() for c in used})
    gaps = written = materialize(gaps.withColumns({c: F.coalesce(values[c], F.lit(means[c])) for c in used}), "impute")
    lacks = gaps.agg(*[F.max(f"_lack_{c}").alias(c) for c in used], *[F.max(F.abs(F.col(c))).alias(f"top_{c}") for c in used]).first()
    for _ in range(rounds):
        most = 0.0
        for c in [c for c in used if lacks[c]]:
            sums = complete + _sums(gaps.filter(~F.col(f"_lack_{c}")), used)
            at, k = [0, *[1 + used.index(o) for o in used if o != c]], 1 + used.index(c)
            b = np.linalg.lstsq(sums[np.ix_(at, at)], sums[at, k], rcond=None)[0].tolist()
            guess = F.lit(b[0])
            for o, v in zip([o for o in used if o != c], b[1:]):
                guess = guess + F.col(o) * v
            step = materialize(gaps.withColumn("_was", F.col(c)).withColumn(c, F.when(F.col(f"_lack_{c}"), guess).otherwise(F.col(c))), "impute")
            most = max(most, step.agg(F.max(F.abs(F.col(c) - F.col("_was")))).first()[0] or 0.0)
            discard(written)
            written, gaps = step, step.drop("_was")
        if most < tol * max([lacks[f"top_{c}"] or 0.0 for c in used], default=0.0):
            break
    return df.filter(~lacking).withColumns({c: values[c] for c in used}).unionByName(gaps.select(*df.columns))


def _sums(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Products of (1, columns) with each other, summed over the rows."""
    v = [F.lit(1.0), *map(F.col, columns)]
    row = df.agg(*[F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i in range(len(v)) for j in range(i, len(v))]).first()
    return np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(v))] for i in range(len(v))])
