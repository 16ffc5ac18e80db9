"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a column that can hold it."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) if is_float(df, column) else c.isNull()


def present(df: DataFrame, column: str) -> Column:
    """The value, null where it is missing."""
    return F.when(~is_missing(df, column), F.col(column))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def nulls_for_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: present(df, c) for c in df.columns if is_float(df, c)})


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """df with the columns of a one-row aggregate of itself."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in stats.items()])))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """The value held between two bounds; null stays null."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def interpolate(value: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear interpolation through sorted points, constant outside, as numpy.interp."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda x: x <= value))
    inside = F.element_at(ys, k) + (value - F.element_at(xs, k)) * F.try_divide(F.element_at(ys, k + 1) - F.element_at(ys, k), F.element_at(xs, k + 1) - F.element_at(xs, k))
    return F.when(value.isNull(), None).when(k == 0, F.element_at(ys, 1)).when(k >= n, F.element_at(ys, -1)).otherwise(inside)


#: Coefficients of the rational approximation of the inverse normal distribution (Acklam).
PPF_A = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239]
PPF_B = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1]
PPF_C = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
PPF_D = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416]


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda a, c: a * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function; p is held within (1e-7, 1 - 1e-7)."""
    p = clip(p, 1e-7, 1 - 1e-7)
    tail = lambda q: _polynomial(q, PPF_C) / _polynomial(q, [*PPF_D, 1.0])
    r = (p - 0.5) * (p - 0.5)
    middle = _polynomial(r, PPF_A) * (p - 0.5) / _polynomial(r, [*PPF_B, 1.0])
    low = tail(F.sqrt(-2 * F.log(p)))
    high = -tail(F.sqrt(-2 * F.log(1 - p)))
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(middle)


def sigmoid(x: Column, form: str = "exact") -> Column:
    """The logistic function or one of its polynomial stand-ins."""
    forms = {"exact": lambda: 1 / (1 + F.exp(-x)), "linear": lambda: 0.5 + 0.25 * x, "deg3": lambda: 0.5 + 0.197 * x - 0.004 * x * x * x}
    return clip(forms[form](), 0.0, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def yeo_johnson(x: Column, lam: Column) -> Column:
    near = lambda a, b: F.abs(a - b) < 1e-12
    up = F.when(near(lam, 0.0), F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.when(near(lam, 0.0), 1.0).otherwise(lam))
    down = F.when(near(lam, 2.0), -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / F.when(near(lam, 2.0), 1.0).otherwise(2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: Column) -> Column:
    small = F.abs(lam) < 1e-12
    return F.when(small, F.log(x)).otherwise((F.pow(x, lam) - 1) / F.when(small, 1.0).otherwise(lam))


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and seed only, so recomputed rows get the same noise."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
