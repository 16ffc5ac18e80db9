"""Forecasts of series of any length: seasonal smoothing and ARIMA over chunks of a series.

No series has to fit into a row or a task. Its rows are numbered (ordering.py) and
dealt to chunks. Smoothing with additive parts is linear in its state, so a chunk
is a matrix, whatever comes before it, and its squared errors are a quadratic form of
the state at its start: chunks are worked on apart and then put together in order.
Differences and lags reach into the chunk before by copies of its last rows.

Rows with a null or NaN value are left out; rows that tie in order are taken in an
arbitrary but fixed order. Series of too few rows give nulls. A null key is a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import present
from ..sources.shared import materialize
from ..sources.ship import send_package
from .ordering import row_numbers

#: Rows of a chunk.
CHUNK = 1 << 16


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the columns of right, a row for each key, where keys are equal or both null."""
    named = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys])).drop(*[f"_r{k}" for k in keys])


def numbered(df: DataFrame, by: Sequence[str], order: str, value: str) -> tuple[DataFrame, list[str]]:
    """_k0.. (the keys), _t (place in the series, from 0), _n (its length) and _y, and the names of the keys."""
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(order).alias("_order"), present(df, value).cast("double").alias("_y")).filter("_y IS NOT NULL")
    placed = materialize(row_numbers(rows, [*keys, "_order"], "_at"), "series")
    spans = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return _same(placed, spans, keys).select(*keys, (F.col("_at") - F.col("_first")).alias("_t"), "_n", "_y"), keys


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


# --- seasonal smoothing


class _Chunk:
    """Level, trend and seasons after some rows as affine functions of those before them, for all settings at once."""

    def __init__(self, settings: np.ndarray, period: int, phi: float, trend: bool) -> None:
        self.alpha, self.beta, self.gamma = (settings[:, i, None] for i in range(3))
        self.period, self.phi, self.trend = period, phi, trend
        self.seasons = period if period > 1 else 0
        d = 2 + self.seasons
        self.state = np.zeros((len(settings), d, d + 1))
        self.state[:, range(d), range(d)] = 1.0
        self.errors = np.zeros((len(settings), d + 1, d + 1))

    def add(self, t: np.ndarray, y: np.ndarray, last: np.ndarray) -> None:
        for a in range(0, len(y), 256):
            self._add(t[a : a + 256], y[a : a + 256], last[a : a + 256])

    def _add(self, t, y, last):
        s, miss = self.state, np.empty((len(y), *self.errors.shape[:2]))
        for i, (at, value, end) in enumerate(zip(t.tolist(), y.tolist(), last.tolist())):
            base = s[:, 0] + self.phi * s[:, 1]
            where = 2 + at % self.period
            season = s[:, where] if self.seasons else 0.0
            miss[i] = -(base + season)
            miss[i, :, -1] += value
            if end:  # the last value of a series is compared, not learned from
                break
            level = self.alpha * -season + (1 - self.alpha) * base
            level[:, -1] += self.alpha[:, 0] * value
            if self.trend:
                s[:, 1] = self.beta * (level - s[:, 0]) + (1 - self.beta) * self.phi * s[:, 1]
            if self.seasons:
                season = -self.gamma * level + (1 - self.gamma) * season
                season[:, -1] += self.gamma[:, 0] * value
                s[:, where] = season
            s[:, 0] = level
        self.errors += np.einsum("tci,tcj->cij", miss, miss, optimize=True)


def holt_winters(df: DataFrame, by: Sequence[str], order: str, value: str, steps: int, period: int = 1, alphas: Sequence[float] = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9), betas: Sequence[float] | None = (0.1, 0.2, 0.3), gammas: Sequence[float] = (0.1, 0.2, 0.3), phi: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """by, n, alpha, beta, gamma, mse, level, trend, seasons and forecast of additive smoothing for each series.

    Of all settings the one with the least mean squared error one step ahead is taken (the
    first on ties, gamma turning fastest). With betas None there is no trend, with a period
    of 1 no season. Level and seasons begin with the first period's mean and what its
    values differ from it by, the trend with the mean step to the value a period later. A
    phi below 1 damps the trend. Series of at most a period give nulls.
    """
    trend, seasonal = betas is not None, period > 1
    settings = np.array(list(product(alphas, betas if trend else (0.0,), gammas if seasonal else (0.0,))))
    rows, keys = numbered(df, by, order, value)
    send_package(df.sparkSession)
    lead = F.sort_array(F.collect_list(F.when(F.col("_t") <= period, F.struct("_t", "_y"))))  # period + 1 values at most
    begin = rows.groupBy(*keys).agg(F.transform(lead, lambda r: r["_y"]).alias("_lead"), F.max("_n").alias("_n"))
    begin = begin.withColumn("_base", F.aggregate(F.slice("_lead", 1, period), F.lit(0.0), lambda a, v: a + v) / F.least(F.size("_lead"), F.lit(period)))
    begin = materialize(begin, "starts")
    shifted = _same(rows, begin.select(*keys, "_base"), keys).withColumns({"_chunk": F.floor(F.col("_t") / chunk), "_y": F.col("_y") - F.col("_base"), "_last": F.col("_t") == F.col("_n") - 1})
    dealt = shifted.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_t").select(*keys, "_chunk", "_t", "_y", "_last")

    def in_chunks(batches):
        import pyarrow as pa

        now = head = None

        def give():
            return pa.RecordBatch.from_arrays([*head.columns, pa.array([now.state.ravel().tolist()], pa.list_(pa.float64())), pa.array([now.errors.ravel().tolist()], pa.list_(pa.float64()))], [*keys, "_chunk", "_map", "_errors"])

        for b in batches:
            t, y, last = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_t", "_y", "_last"))
            heads = np.flatnonzero(t % chunk == 0).tolist()  # a chunk is whole, so it begins there
            for a, z in zip([0, *heads], [*heads, len(t)]):
                if a in heads and z > a:
                    if now is not None:
                        yield give()
                    now, head = _Chunk(settings, period, phi, trend), b.slice(a, 1).select([*keys, "_chunk"])
                if z > a:
                    now.add(t[a:z], y[a:z], last[a:z])
        if now is not None:
            yield give()

    types = _key_types(rows, keys)
    maps = materialize(dealt.mapInArrow(in_chunks, f"{types}, _chunk long, _map array<double>, _errors array<double>"), "maps")
    joined = _same(maps, begin, keys).repartition(*keys).sortWithinPartitions(*keys, "_chunk")
    c, d = len(settings), 2 + (period if seasonal else 0)

    def put_together(batches):
        import pyarrow as pa

        at = head = None

        def give():
            n, base = head["_n"], head["_base"]
            out = [n, *[None] * 8]
            if at is not None:
                x, sums = at
                k = int(np.argmin(sums))
                level, slope, season = x[k, 0] + base, x[k, 1], x[k, 2:]
                ahead = np.cumsum(phi ** np.arange(steps))
                forecast = level + slope * ahead + (season[(n + np.arange(steps)) % period] if seasonal else 0.0)
                out = [n, *settings[k].tolist(), sums[k] / n, level, slope, season.tolist(), forecast.tolist()]
            kinds = [pa.int64(), *[pa.float64()] * 6, pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([*keyed.columns, *[pa.array([v], kind) for v, kind in zip(out, kinds)]], [*keys, *names])

        for b in batches:
            plain = b.select([f for f in b.schema.names if f not in keys])
            for i in range(b.num_rows):
                row = plain.slice(i, 1).to_pylist()[0]
                if row["_chunk"] == 0:
                    if head is not None:
                        yield give()
                    head, keyed, lead = row, b.slice(i, 1).select(keys), np.array(row["_lead"])
                    at = None
                    if len(lead) > period:
                        first = np.concatenate([[0.0, (lead[period] - lead[0]) / period if trend else 0.0], (lead[:period] - row["_base"]) if seasonal else []])
                        at = np.tile(first, (c, 1)), np.zeros(c)
                if at is not None:
                    v = np.concatenate([at[0], np.ones((c, 1))], axis=1)
                    sums = at[1] + np.einsum("ci,cij,cj->c", v, np.array(row["_errors"]).reshape(c, d + 1, d + 1), v)
                    at = np.einsum("cij,cj->ci", np.array(row["_map"]).reshape(c, d, d + 1), v), sums
        if head is not None:
            yield give()

    names = ["n", "alpha", "beta", "gamma", "mse", "level", "trend", "seasons", "forecast"]
    found = joined.mapInArrow(put_together, f"{types}, n long, alpha double, beta double, gamma double, mse double, level double, trend double, seasons array<double>, forecast array<double>")
    return found.select(*[F.col(k).alias(c_) for k, c_ in zip(keys, by)], *names)


# --- ARIMA


def difference_weights(d: int, seasonal_d: int = 0, period: int = 1) -> list[float]:
    """The weights of y now, one ago, ... in its d-th and seasonal_d-th seasonal difference."""
    out = np.ones(1)
    for k in [*[1] * d, *[period] * seasonal_d]:
        out = np.convolve(out, [1.0, *[0.0] * (k - 1), -1.0])
    return out.tolist()


def arima(df: DataFrame, by: Sequence[str], order: str, value: str, steps: int, p: int = 1, d: int = 1, q: int = 1, seasonal_d: int = 0, period: int = 1, z: float = 1.96, ridge: float = 1e-6, chunk: int = CHUNK) -> DataFrame:
    """by, n, coefficients, intercept, moving, sigma2, forecast, lower and upper for each series.

    The differenced series is fitted to its p last values by least squares without an
    intercept column (the intercept is the mean residual). The moving-average weights
    are the residuals' autocorrelations, held within 0.99. Forecasts turn the differences
    back; limits are z sigma sqrt(h) away. Series with no residual give nulls. A difference
    and its lags must reach no further than a chunk.
    """
    weights = difference_weights(d, seasonal_d, period)
    reach, back = len(weights) - 1, len(weights) - 1 + p + q
    if back >= chunk:
        raise ValueError(f"lags of {back} rows in chunks of {chunk}")
    rows, keys = numbered(df, by, order, value)
    own = F.floor(F.col("_t") / chunk)
    spread = rows.withColumn("_chunk", F.explode(F.when(F.col("_t") % chunk >= chunk - back, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_t")
    change = reduce(lambda a, b: a + b, [F.lag("_y", k).over(w) * v if k else F.col("_y") for k, v in enumerate(weights) if v])
    wide = spread.withColumns({"_z0": F.when(F.col("_t") >= reach, change), **{f"_y{k}": F.lag("_y", k).over(w) if k else F.col("_y") for k in range(max(1, reach))}})
    wide = wide.withColumns({f"_z{k}": F.lag("_z0", k).over(w) for k in range(1, p + q + 1)})
    wide = materialize(wide.filter((own == F.col("_chunk")) & (F.col("_t") >= reach)).drop("_chunk"), "lags")
    fitted = _least_squares(wide.filter(F.col("_t") >= reach + p), keys, p, ridge)
    known = _same(wide, fitted, keys)

    def residual(i: int) -> Column:
        return reduce(lambda a, b: a - b, [F.element_at("_a", j) * F.col(f"_z{i + j}") for j in range(1, p + 1)], F.col(f"_z{i}") - F.col("_c"))

    tail = F.max_by(F.struct(*[F.array(*[F.col(f"_{n}{k}") for k in range(m)]).alias(n) for n, m in (("y", max(1, reach)), ("z", max(1, p)))], F.array(*[F.when(F.col("_t") >= reach + p + i, residual(i)) for i in range(q)]).cast("array<double>").alias("r")), "_t")
    enough = F.col("_t") >= reach + p
    sums = known.groupBy(*keys).agg(F.max("_n").alias("_n"), F.first("_a").alias("_a"), F.first("_c").alias("_c"), F.var_pop(F.when(enough, residual(0))).alias("_s"), F.array(*[F.avg(F.when(F.col("_t") >= reach + p + i, residual(0) * residual(i))) for i in range(1, q + 1)]).cast("array<double>").alias("_r"), tail.alias("_tail"))

    def forecast(batches):
        for pdf in batches:
            out = []
            for n, a, c, s2, r, tail in zip(pdf["_n"], pdf["_a"], pdf["_c"], pdf["_s"], pdf["_r"], pdf["_tail"]):
                moving = [0.0 if v is None or np.isnan(v) else float(np.clip(v / (s2 + 1e-10), -0.99, 0.99)) for v in r]
                ys, zs = list(tail["y"]), list(tail["z"])  # the latest first
                rs = [0.0 if v is None or np.isnan(v) else v for v in tail["r"]]
                ahead = []
                for _ in range(steps):
                    step = c + sum(v * x for v, x in zip(a, zs)) + sum(v * x for v, x in zip(moving, rs))
                    zs, rs = [step, *zs], [0.0, *rs]
                    ys = [step - sum(v * x for v, x in zip(weights[1:], ys)), *ys]
                    ahead.append(float(ys[0]))
                wide_ = [z * np.sqrt(s2 * h) for h in range(1, steps + 1)]
                out.append((n, list(a), c, moving, s2, ahead, [f - v for f, v in zip(ahead, wide_)], [f + v for f, v in zip(ahead, wide_)]))
            result = pdf[keys].copy()
            for k, name in enumerate(names):
                result[name] = [o[k] for o in out]
            yield result

    names = ["n", "coefficients", "intercept", "moving", "sigma2", "forecast", "lower", "upper"]
    kinds = ["long", "array<double>", "double", "array<double>", "double", *["array<double>"] * 3]
    found = sums.mapInPandas(forecast, f"{_key_types(rows, keys)}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    every = rows.groupBy(*keys).agg(F.max("_n").alias("_rows"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys])
    joined = every.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_rows").join(found, match, "left")
    return joined.select(*[F.col(f"_r{k}").alias(c) for k, c in zip(keys, by)], F.col("_rows").alias("n"), *names[1:])


def _least_squares(lagged: DataFrame, keys: Sequence[str], p: int, ridge: float) -> DataFrame:
    """keys, _a, _c: coefficients on _z1.._zp and the mean residual."""
    if not p:
        return lagged.groupBy(*keys).agg(F.array().cast("array<double>").alias("_a"), F.avg("_z0").alias("_c"))
    xs = [f"_z{k}" for k in range(1, p + 1)]
    products = [F.sum(F.col(a) * F.col(b)) for a in xs for b in [*xs, "_z0"]]
    sums = lagged.groupBy(*keys).agg(F.array(*products).alias("_s"), F.array(*[F.avg(c) for c in [*xs, "_z0"]]).alias("_m"))

    def solve(batches):
        for pdf in batches:
            s = np.stack(pdf["_s"].to_list()).reshape(-1, p, p + 1)
            m = np.stack(pdf["_m"].to_list())
            a = np.linalg.solve(s[:, :, :p] + ridge * np.eye(p), s[:, :, p:])[..., 0]
            out = pdf[list(keys)].copy()
            out["_a"], out["_c"] = list(a), m[:, p] - (a * m[:, :p]).sum(axis=1)
            yield out

    return sums.mapInPandas(solve, f"{_key_types(lagged, keys)}, _a array<double>, _c double")
