"""Data-quality profiles and scores: one aggregation over all columns, then arithmetic on one row."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import is_missing, numeric_columns, present, total
from .ordering import percentile_row


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_duplicates (all but the first of equal rows)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def profile(df: DataFrame) -> DataFrame:
    """Shape of a frame: rows, columns, numeric and other columns, duplicate rows."""
    numeric = len(numeric_columns(df))
    return duplicate_rows(df).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(numeric).alias("n_numeric"), F.lit(len(df.columns) - numeric).alias("n_other"), "n_duplicates")


def _long(row: DataFrame, columns: Sequence[str], make) -> DataFrame:
    """A one-row aggregate as a row for each column; make(name) is a struct."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *make(c)) for c in columns])).alias("s")).select("s.*")


def missing_analysis(df: DataFrame) -> DataFrame:
    """column, n_missing, pct_missing for every column."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    return _long(row, df.columns, lambda c: [F.col(c).alias("n_missing"), F.round(F.coalesce(F.try_divide(100.0 * F.col(c), F.col("_n")), F.lit(0.0)), 4).alias("pct_missing")])


def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str, threshold: float) -> DataFrame:
    """One row with <column>_low and <column>_high: IQR fences, or mean and population deviations.

    A z threshold of 2 or less means 3.
    """
    if method == "iqr":
        row = percentile_row(df, {c: present(df, c) for c in columns}, (0.25, 0.75))
        width = lambda c: F.col(c)[1] - F.col(c)[0]
        return row.select(*[x for c in columns for x in ((F.col(c)[0] - threshold * width(c)).alias(f"{c}_low"), (F.col(c)[1] + threshold * width(c)).alias(f"{c}_high"))])
    threshold = 3.0 if threshold <= 2 else threshold
    row = df.agg(*[x for c in columns for x in (F.avg(present(df, c)).alias(f"{c}_m"), F.stddev_pop(present(df, c)).alias(f"{c}_s"))])
    return row.select(*[x for c in columns for x in ((F.col(f"{c}_m") - threshold * F.col(f"{c}_s")).alias(f"{c}_low"), (F.col(f"{c}_m") + threshold * F.col(f"{c}_s")).alias(f"{c}_high"))])


def outlier_counts(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """column, n_outliers, low, high; missing values are never outliers."""
    bounds = outlier_bounds(df, columns, method, threshold)
    joined = df.crossJoin(F.broadcast(bounds))
    out = lambda c: (present(df, c) < F.col(f"{c}_low")) | (present(df, c) > F.col(f"{c}_high"))
    row = joined.agg(*[F.count_if(out(c)).alias(c) for c in columns], *[F.first(f"{c}_{e}").alias(f"{c}_{e}") for c in columns for e in ("low", "high")])
    return _long(row, columns, lambda c: [F.col(c).alias("n_outliers"), F.round(f"{c}_low", 6).alias("low"), F.round(f"{c}_high", 6).alias("high")])


def outlier_rows(df: DataFrame, key: Sequence[str], column: str, method: str = "iqr", threshold: float = 1.5, most: int = 100) -> DataFrame:
    """The first rows (by key) that lie outside a column's bounds."""
    bounds = outlier_bounds(df, [column], method, threshold)
    outside = (present(df, column) < F.col(f"{column}_low")) | (present(df, column) > F.col(f"{column}_high"))
    return df.crossJoin(F.broadcast(bounds)).filter(outside).select(*key, column).orderBy(*key).limit(most)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for every pair of columns, over the rows that have both; one aggregation."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b: present(df, a).isNotNull() & present(df, b).isNotNull()
    row = df.agg(*[F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])).alias("s")).select("s.*")


def strong_correlations(df: DataFrame, columns: Sequence[str], least: float = 0.8) -> DataFrame:
    return correlations(df, columns).filter(F.abs("r") > least).orderBy(F.abs("r").desc())


def completeness(df: DataFrame) -> DataFrame:
    """1 - missing cells / cells, 1 for an empty frame."""
    missing = total([F.count_if(is_missing(df, c)) for c in df.columns])
    return df.agg(F.round(1 - F.coalesce(F.try_divide(missing.cast("double"), F.count(F.lit(1)) * len(df.columns)), F.lit(0.0)), 4).alias("completeness"))


def consistency(df: DataFrame) -> DataFrame:
    """1 - (duplicate ratio + ratio of string columns that mix numbers and other text) / 2."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    number = lambda c: F.col(c).try_cast("double").isNotNull()
    mixed = [(F.bool_or(number(c)) & F.bool_or(F.col(c).isNotNull() & ~number(c))).alias(c) for c in strings]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *mixed)
    n_mixed = total([F.coalesce(F.col(c), F.lit(False)).cast("int") for c in strings]) if strings else F.lit(0)
    dups = F.coalesce(F.try_divide(F.col("n_duplicates").cast("double"), F.col("n_rows")), F.lit(0.0))
    score = 1 - (0.5 * dups + 0.5 * n_mixed / len(df.columns))
    return duplicate_rows(df).crossJoin(row).select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("consistency"))


def quality_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0.4 completeness + 0.3 consistency + 0.3 max(0, 1 - 5 * outlier ratio)."""
    outliers = outlier_counts(df, columns).agg(F.sum("n_outliers").alias("_o"))
    cells = df.agg((F.count(F.lit(1)) * len(columns)).alias("_cells"))
    row = completeness(df).crossJoin(consistency(df)).crossJoin(outliers).crossJoin(cells)
    clean = F.greatest(F.lit(0.0), 1 - 5 * F.coalesce(F.try_divide(F.col("_o").cast("double"), F.col("_cells")), F.lit(0.0)))
    return row.select("completeness", "consistency", F.col("_o").alias("n_outliers"), F.round(0.4 * F.col("completeness") + 0.3 * F.col("consistency") + 0.3 * clean, 6).alias("score"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _percent(bad: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 * (1 - bad))


def quality_score_v1(counts: DataFrame) -> DataFrame:
    """Equal weights, nulls by records, duplicates as timeliness; no records score 0.

    counts has records, nulls, duplicates, outliers and violations of schema, format and range.
    """
    part = lambda bad: F.when(F.col("records") > 0, _percent(_ratio(bad, F.col("records")))).otherwise(0.0)
    c = F.col
    parts = {"completeness": part(c("nulls")), "consistency": part(c("schema_violations") + c("format_violations")), "accuracy": part(c("range_violations") + c("outliers")), "timeliness": part(c("duplicates"))}
    return _scored(counts.withColumns(parts), {k: 0.25 for k in parts})


#: Days and scores between which timeliness falls along straight lines.
TIMELINESS = [(1, 100.0), (7, 90.0), (30, 70.0), (90, 50.0), (180, 0.0)]


def timeliness(age_days: Column) -> Column:
    out = F.when(age_days < TIMELINESS[0][0], TIMELINESS[0][1])
    for (a, fa), (b, fb) in zip(TIMELINESS, TIMELINESS[1:]):
        out = out.when(age_days < b, fa + (age_days - a) * ((fb - fa) / (b - a)))
    return out.otherwise(TIMELINESS[-1][1])


def quality_score_v2(counts: DataFrame) -> DataFrame:
    """Weights .30, .25, .25, .20; nulls by cells, duplicates and format share consistency, timeliness by age_days."""
    n, c = F.col("records"), F.col
    part = lambda bad: F.when(n > 0, _percent(_ratio(bad, n))).otherwise(0.0)
    cells = n * c("features")
    parts = {"completeness": F.when(cells > 0, _percent(_ratio(c("nulls"), cells))).otherwise(0.0), "consistency": part((c("duplicates") + c("format_violations")) / 2), "accuracy": part(c("outliers") + c("schema_violations") + c("range_violations")), "timeliness": timeliness(c("age_days"))}
    return _scored(counts.withColumns(parts), {"completeness": 0.30, "consistency": 0.25, "accuracy": 0.25, "timeliness": 0.20})


def quality_score_v3(counts: DataFrame) -> DataFrame:
    """Weights .25, .20, .20, .20, .15 of completeness, consistency, uniqueness, validity and freshness; no records score 0."""
    n = F.col("records")
    some = lambda c: F.when(n > 0, c).otherwise(0.0)
    parts = {"completeness": some(_percent(_ratio(F.col("nulls"), n * F.col("features")))), "consistency": some(_percent(_ratio(F.col("schema_violations") + F.col("format_violations") + F.col("range_violations"), 3 * n))), "uniqueness": some(_percent(_ratio(F.col("duplicates"), n))), "validity": some(_percent(_ratio(F.col("outliers"), n))), "freshness": some(F.greatest(F.lit(0.0), 100 * (1 - F.col("age_days") / 30)))}
    return _scored(counts.withColumns(parts), {"completeness": 0.25, "consistency": 0.20, "uniqueness": 0.20, "validity": 0.20, "freshness": 0.15})


def _scored(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumn("overall", F.round(total([w * F.col(k) for k, w in weights.items()]), 6)).withColumns({k: F.round(k, 6) for k in weights})
