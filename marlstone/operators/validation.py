"""Constraints as column predicates, schemas that emit violation rows, dataset checks.

A constraint is a function from a column to a boolean column that is true where
the value breaks it. A schema evaluates all constraints of all columns in one
pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_float, numeric_columns

#: Patterns of the e-mail and URL constraints.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"


@dataclass(frozen=True)
class Constraint:
    """A named predicate; broken(column) is true where the value violates it."""

    name: str
    broken: Callable[[Column], Column]


def not_null() -> Constraint:
    """Null, NaN and blank text break it."""
    return Constraint("not_null", lambda c: c.isNull() | c.cast("string").isin("NaN") | (F.trim(c.cast("string")) == ""))


def not_empty() -> Constraint:
    return Constraint("not_empty", lambda c: F.length(F.trim(c)) == 0)


def in_range(low: float | None = None, high: float | None = None, inclusive: bool = True) -> Constraint:
    """Nulls pass, text that is no number fails."""

    def broken(c: Column) -> Column:
        v = c.try_cast("double")
        bad = F.lit(False)
        if low is not None:
            bad = bad | ((v < low) if inclusive else (v <= low))
        if high is not None:
            bad = bad | ((v > high) if inclusive else (v >= high))
        return c.isNotNull() & (v.isNull() | bad)

    return Constraint("in_range", broken)


def in_set(values: Sequence, case_sensitive: bool = True) -> Constraint:
    if case_sensitive:
        return Constraint("in_set", lambda c: ~c.isin(*values))
    return Constraint("in_set", lambda c: ~F.lower(c).isin(*[str(v).lower() for v in values]))


def matches(pattern: str) -> Constraint:
    """The pattern must match from the start of the text."""
    return Constraint("matches", lambda c: ~c.rlike(f"^(?:{pattern})"))


def min_length(n: int) -> Constraint:
    return Constraint("min_length", lambda c: F.length(c) < n)


def max_length(n: int) -> Constraint:
    return Constraint("max_length", lambda c: F.length(c) > n)


def is_type(kind: str) -> Constraint:
    """Text that cannot be read as int, float, numeric, bool or datetime fails."""
    spark_type = {"int": "long", "float": "double", "numeric": "double", "bool": "boolean", "datetime": "timestamp", "str": "string"}[kind]
    return Constraint("is_type", lambda c: c.isNotNull() & c.try_cast(spark_type).isNull())


def is_positive(allow_zero: bool = False) -> Constraint:
    return Constraint("is_positive", lambda c: c.try_cast("double") < 0 if allow_zero else c.try_cast("double") <= 0)


def is_email() -> Constraint:
    return Constraint("is_email", lambda c: ~c.rlike(EMAIL))


def is_url() -> Constraint:
    return Constraint("is_url", lambda c: ~c.rlike(URL))


def custom(name: str, holds: Callable[[Column], Column]) -> Constraint:
    return Constraint(name, lambda c: ~holds(c))


@dataclass
class ColumnSchema:
    name: str
    dtype: str | None = None
    nullable: bool = True
    constraints: Sequence[Constraint] = field(default_factory=list)

    def all_constraints(self) -> list[Constraint]:
        first = [] if self.nullable else [Constraint("nullable", lambda c: c.isNull())]
        return [*first, *([is_type(self.dtype)] if self.dtype else []), *self.constraints]


@dataclass
class DataSchema:
    """Columns with constraints; unknown columns are warnings under strict, missing ones errors."""

    columns: Sequence[ColumnSchema]
    strict: bool = True
    min_rows: int | None = None
    max_rows: int | None = None

    def violations(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """key, column, constraint, value of every broken constraint."""
        tests = []
        for spec in self.columns:
            if spec.name in df.columns:
                c = F.col(spec.name)
                tests += [F.when(k.broken(c), F.struct(F.lit(spec.name).alias("column"), F.lit(k.name).alias("constraint"), c.cast("string").alias("value"))) for k in spec.all_constraints()]
        broken = F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))
        return df.select(*key, broken.alias("_v")).select(*key, "_v.*")

    def structure(self, df: DataFrame) -> list[tuple[str, str, str]]:
        """(column, severity, message) of columns that are missing or unknown."""
        known = {c.name for c in self.columns}
        missing = [(c, "error", "missing column") for c in sorted(known - set(df.columns))]
        return missing + [(c, "warning", "unknown column") for c in df.columns if c not in known and self.strict]

    def row_counts(self, df: DataFrame) -> DataFrame:
        """n_rows and whether it lies within the bounds."""
        n = F.count(F.lit(1))
        good = (n >= (self.min_rows or 0)) & (n <= self.max_rows if self.max_rows is not None else F.lit(True))
        return df.agg(n.alias("n_rows"), good.alias("within"))


def dataset_checks(df: DataFrame, finite: Sequence[str] = (), custom_checks: Mapping[str, Column] | None = None) -> DataFrame:
    """check, passed: no_missing, no_duplicates, finite and custom aggregates that must be true."""
    floats = [c for c in df.columns if is_float(df, c)]
    missing = F.count_if(F.exists(F.array(*[F.col(c).isNull() for c in df.columns]), lambda x: x))
    infinite = F.count_if(F.exists(F.array(*[F.isnan(c) | (F.abs(c) == float("inf")) for c in (finite or floats)]), lambda x: x)) if (finite or floats) else F.lit(0)
    named = {"no_missing": missing == 0, "finite": infinite == 0, **(custom_checks or {})}
    row = df.agg(*[c.alias(n) for n, c in named.items()])
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.max("_n") <= 1, F.lit(True)).alias("no_duplicates"))
    names = [*named, "no_duplicates"]
    return row.crossJoin(groups).select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in names])).alias("s")).select("s.*")


def feature_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_nan, n_inf, is_constant of numeric features."""
    row = df.agg(*[x for c in columns for x in (F.count_if(F.isnan(F.col(c).cast("double"))).alias(f"{c}|n"), F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(f"{c}|i"), (F.min(c) == F.max(c)).alias(f"{c}|c"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|n`").alias("n_nan"), F.col(f"`{c}|i`").alias("n_inf"), F.col(f"`{c}|c`").alias("is_constant")) for c in columns])).alias("s")).select("s.*")


def label_check(df: DataFrame, label: str, allowed: Sequence | None = None) -> DataFrame:
    """n, n_classes and the number of labels outside the allowed set."""
    outside = F.count_if(~F.col(label).isin(*allowed)) if allowed is not None else F.lit(0).cast("long")
    return df.agg(F.count(label).alias("n"), F.count_distinct(label).alias("n_classes"), outside.alias("n_outside"))


def weight_check(df: DataFrame, weight: str) -> DataFrame:
    """Numbers of negative and non-finite weights."""
    w = F.col(weight).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(w < 0).alias("n_negative"), F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))).alias("n_not_finite"))


def infer_schema(df: DataFrame) -> DataFrame:
    """column, dtype, nullable, low, high: types from the schema, observed nulls and ranges."""
    numeric = set(numeric_columns(df))
    none = F.lit(None).cast("double")
    row = df.agg(*[x for c in df.columns for x in (F.bool_or(F.col(c).isNull()).alias(f"{c}|u"), (F.min(c).cast("double") if c in numeric else none).alias(f"{c}|l"), (F.max(c).cast("double") if c in numeric else none).alias(f"{c}|h"))])
    kinds = dict(df.dtypes)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"`{c}|u`").alias("nullable"), F.col(f"`{c}|l`").alias("low"), F.col(f"`{c}|h`").alias("high")) for c in df.columns])).alias("s")).select("s.*")


def shape_check(df: DataFrame, columns: Sequence[str], min_samples: int = 1, min_features: int = 1, max_features: int | None = None) -> DataFrame:
    """n_samples, n_features, valid: whether the numbers of rows and feature columns lie within bounds."""
    width = len(columns)
    fits = width >= min_features and (max_features is None or width <= max_features)
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_samples"), F.lit(width).alias("n_features"), ((n >= min_samples) & F.lit(fits)).alias("valid"))


def range_check(df: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """lowest, highest, valid over all the columns; a zero has no sign."""
    lowest = F.array_min(F.array(*[F.min(F.col(c).cast("double")) for c in columns])) + 0.0
    highest = F.array_max(F.array(*[F.max(F.col(c).cast("double")) for c in columns])) + 0.0
    good = F.coalesce(lowest >= low if low is not None else F.lit(True), F.lit(True)) & F.coalesce(highest <= high if high is not None else F.lit(True), F.lit(True))
    return df.agg(lowest.alias("lowest"), highest.alias("highest"), good.alias("valid"))


def target_check(df: DataFrame, target: str, n_samples: int, task: str = "regression") -> DataFrame:
    """n, n_classes, valid: as many targets as rows, none missing, and for classification whole numbers of two classes or more."""
    c = F.col(target)
    n, classes = F.count(F.lit(1)), F.count_distinct(c)
    good = (n == n_samples) & (F.count(c) == n)
    if task != "regression":
        good = good & (classes >= 2) & F.coalesce(F.bool_and(c.cast("double") == F.floor(c.cast("double"))), F.lit(True))
    return df.agg(n.alias("n"), classes.alias("n_classes"), good.alias("valid"))
