"""Feature scores and selection, splits and folds, parameter grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import total
from .ordering import row_numbers


def _long(row: DataFrame, columns: Sequence[str], value) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("score")) for c in columns])).alias("s")).select("s.*")


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long(df.agg(*[F.var_pop(c).alias(c) for c in columns]), columns, F.col)


def variance_threshold(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    return variances(df, columns).filter(F.col("score") > threshold)


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, score (F), p (1 / (1 + F)): between over within variance of the classes."""
    groups = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.var_pop(c).alias(f"{c}_v"))])
    overall = df.agg(F.count(F.lit(1)).alias("_all"), *[F.avg(c).alias(f"{c}_g") for c in columns])
    joined = groups.crossJoin(F.broadcast(overall))
    row = joined.agg(F.count(F.lit(1)).alias("_k"), F.first("_all").alias("_all"), *[x for c in columns for x in (F.sum(F.col("_n") * F.pow(F.col(f"{c}_m") - F.col(f"{c}_g"), 2)).alias(f"{c}_b"), F.sum(F.col("_n") * F.col(f"{c}_v")).alias(f"{c}_w"))])
    f = lambda c: (F.col(f"{c}_b") / (F.col("_k") - 1)) / (F.col(f"{c}_w") / (F.col("_all") - F.col("_k")) + 1e-10)
    return _long(row, columns, f).withColumn("p", 1 / (1 + F.col("score")))


def f_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """r2 * (n - 2) / (1 - r2 + 1e-10)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(c, target).alias(c) for c in columns])
    return _long(row, columns, lambda c: F.pow(F.col(c), 2) * (F.col("_n") - 2) / (1 - F.pow(F.col(c), 2) + 1e-10))


def chi2_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Observed against expected class sums of values held at 0 or above; expected = class total * feature total / total."""
    held = [F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    sums = df.groupBy(label).agg(*[F.sum(h).alias(c) for c, h in zip(columns, held)])
    sums = sums.withColumn("_class", total([F.col(c) for c in columns]))
    totals = sums.agg(*[F.sum(c).alias(f"{c}_t") for c in columns], F.sum("_class").alias("_total"))
    joined = sums.crossJoin(F.broadcast(totals))
    expected = lambda c: F.col("_class") * F.col(f"{c}_t") / F.col("_total")
    return _long(joined.agg(*[F.sum(F.pow(F.col(c) - expected(c), 2) / (expected(c) + 1e-10)).alias(c) for c in columns]), columns, F.col)


def mutual_information(df: DataFrame, column: str, label: str, bins: int = 10) -> DataFrame:
    """feature, score: mutual information of a label and equal-width bins, natural logarithm, at least 0."""
    edges = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = df.crossJoin(F.broadcast(edges)).select(label, "_n", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_lo")) / width))).otherwise(0).alias("_b"))
    joint = binned.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    by_bin = joint.groupBy("_b").agg(F.sum("_c").alias("_cb"))
    by_label = joint.groupBy(label).agg(F.sum("_c").alias("_cl"))
    p = F.col("_c") / F.col("_n")
    parts = joint.join(by_bin, "_b").join(by_label, label).select((p * F.log(p / (F.col("_cb") / F.col("_n") * F.col("_cl") / F.col("_n")) + 1e-10)).alias("t"))
    return parts.agg(F.lit(column).alias("feature"), F.greatest(F.lit(0.0), F.sum("t")).alias("score"))


def variance_ratio(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(variance - mean class variance) / variance, at least 0."""
    groups = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.var_pop(c).alias(c) for c in columns])
    within = groups.agg(*[(F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(f"{c}_w") for c in columns])
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).crossJoin(within)
    return _long(row, columns, lambda c: F.greatest(F.lit(0.0), (F.col(c) - F.col(f"{c}_w")) / (F.col(c) + 1e-10)))


def mutual_information_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """0.5 (r2 + r4 / 2 + r6 / 3), r2 at most 0.999."""
    row = df.agg(*[F.least(F.pow(F.corr(c, target), 2), F.lit(0.999)).alias(c) for c in columns])
    return _long(row, columns, lambda c: 0.5 * (F.col(c) + F.pow(F.col(c), 2) / 2 + F.pow(F.col(c), 3) / 3))


def k_best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "feature").limit(k)


def percentile_best(scores: DataFrame, n_features: int, percent: float) -> DataFrame:
    return k_best(scores, max(1, int(n_features * percent / 100)))


def fold_of(row: Column, n: Column, k: int) -> Column:
    """Contiguous folds; the first n % k hold one row more."""
    small, extra = F.floor(n / k), n % k
    edge = extra * (small + 1)
    return F.when(row < edge, F.floor(row / (small + 1))).otherwise(extra + F.floor((row - edge) / F.greatest(small, F.lit(1)))).cast("int")


def k_fold(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    return row_numbers(df, order).crossJoin(F.broadcast(n)).withColumn("fold", fold_of(F.col("_row"), F.col("_total"), k)).drop("_row", "_total")


def stratified_k_fold(df: DataFrame, label: str, order: Sequence[str], k: int = 5) -> DataFrame:
    """Contiguous folds within each class; classes are cut where their numbered rows begin."""
    numbered = row_numbers(df, [label, *order])
    classes = numbered.groupBy(label).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_total"))
    return numbered.join(classes, label).withColumn("fold", fold_of(F.col("_row") - F.col("_first"), F.col("_total"), k)).drop("_row", "_first", "_total")


def train_test_split(df: DataFrame, key: str, test: float = 0.25, seed: int = 0) -> DataFrame:
    """is_test: exactly floor(n * test) rows, those with the smallest hash of key and seed."""
    turn = F.md5(F.concat_ws(":", F.lit(seed), key))
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    numbered = row_numbers(df.withColumn("_turn", turn), ["_turn", key])
    return numbered.crossJoin(F.broadcast(n)).withColumn("is_test", F.col("_row") < F.floor(F.col("_total") * test)).drop("_row", "_total", "_turn")


def shuffle_split(df: DataFrame, key: str, n_splits: int, test: float, seed: int = 0) -> DataFrame:
    """key, split, is_test: repeated random splits of hash-drawn rows (sizes are exact in expectation)."""
    splits = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"))
    return splits.withColumn("is_test", F.pmod(F.xxhash64(key, "split", F.lit(seed)), F.lit(1_000_000)) < int(test * 1_000_000))


def parameter_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """The product of parameter values, one row each; a grid is small by nature."""
    out = None
    for name, values in grid.items():
        part = spark.createDataFrame([(v,) for v in values], [name])
        out = part if out is None else out.crossJoin(part)
    return out
