"""Time series as ordered columns: windows per series, folds over a series' sorted values."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, window: int = 5) -> DataFrame:
    """Mean of the last window values; null until there are enough."""
    w = _w(by, order)
    mean = F.avg(value).over(w.rowsBetween(1 - window, 0))
    return df.withColumn("moving_average", F.when(F.row_number().over(w) >= window, mean))


def difference(df: DataFrame, by: Sequence[str], order: str, value: str, lag: int = 1, times: int = 1) -> DataFrame:
    out = df.withColumn("difference", F.col(value))
    for _ in range(times):
        out = out.withColumn("difference", F.col("difference") - F.lag("difference", lag).over(_w(by, order)))
    return out


def autoregression(df: DataFrame, by: Sequence[str], order: str, value: str, p: int = 1, ridge: float = 1e-6) -> DataFrame:
    """by, coefficients, intercept: least squares on p lags without an intercept column; the intercept is the mean residual.

    One aggregation gives every series' normal equations; those (p by p) are solved in Arrow batches of series.
    """
    import numpy as np

    w = _w(by, order)
    lagged = df.select(*by, F.col(value).alias("_y"), *[F.lag(value, k).over(w).alias(f"_x{k}") for k in range(1, p + 1)]).na.drop()
    xs = [f"_x{k}" for k in range(1, p + 1)]
    sums = lagged.groupBy(*by).agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in xs for b in xs]).alias("_xx"), F.array(*[F.sum(F.col(a) * F.col("_y")) for a in xs]).alias("_xy"), F.avg("_y").alias("_my"), F.array(*[F.avg(a) for a in xs]).alias("_mx"))

    def solve(batches):
        for pdf in batches:
            xx = np.stack(pdf["_xx"].to_list()).reshape(-1, p, p) + ridge * np.eye(p)
            coef = np.linalg.solve(xx, np.stack(pdf["_xy"].to_list())[..., None])[..., 0]
            pdf["coefficients"] = list(coef)
            pdf["intercept"] = pdf["_my"] - (coef * np.stack(pdf["_mx"].to_list())).sum(axis=1)
            yield pdf[[*by, "coefficients", "intercept"]]

    keys = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(solve, f"{keys}, coefficients array<double>, intercept double")


def series(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """by, ys: the values of each series in order; a series must fit into a row."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("y")))), lambda s: s["y"]).alias("ys"))


def simple_smoothing(ys: Column, alpha: float) -> Column:
    """Level after all but the last observation, beginning at the first one."""
    seen = F.slice(ys, 2, F.greatest(F.size(ys) - 2, F.lit(0)))
    return F.aggregate(seen, F.element_at(ys, 1), lambda level, y: alpha * y + (1 - alpha) * level)


def holt_forecast(ys: Column, alpha: float, beta: float, steps: int, damping: float = 1.0) -> Column:
    """Forecasts of additive-trend smoothing; level and trend begin with the first two values."""
    start = F.struct(F.element_at(ys, 1).alias("l"), (F.element_at(ys, 2) - F.element_at(ys, 1)).alias("b"))

    def step(s: Column, y: Column) -> Column:
        level = alpha * y + (1 - alpha) * (s["l"] + damping * s["b"])
        return F.struct(level.alias("l"), (beta * (level - s["l"]) + (1 - beta) * damping * s["b"]).alias("b"))

    seen = F.slice(ys, 2, F.greatest(F.size(ys) - 2, F.lit(0)))
    return F.aggregate(seen, start, step, lambda s: F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda h: s["l"] + h * s["b"]))


def linear_trend(df: DataFrame, by: Sequence[str], t: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"))


def fourier_features(df: DataFrame, t: str, period: float, harmonics: int) -> DataFrame:
    angle = lambda k: 2 * pi * k * F.col(t) / period
    return df.withColumns({f"{name}{k}": f(angle(k)) for k in range(1, harmonics + 1) for name, f in (("sin", F.sin), ("cos", F.cos))})
