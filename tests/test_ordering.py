"""Positions, running sums and percentiles over tables that span many partitions."""

import numpy as np
import pytest

from marlstone.operators import ordering, selection
from pyspark.sql import functions as F

INF = float("inf")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_rows_keep_one_number_each_over_many_partitions(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        n = 20_000
        df = spark.range(0, n, 1, 11).select(F.xxhash64("id").alias("id"), (F.col("id") % 3).alias("label"), (F.col("id") % 7).alias("tie"))
        got = [r["_row"] for r in ordering.row_numbers(df, ["id"]).orderBy("id").collect()]
        assert got == list(range(n))
        ties = sorted(r["_row"] for r in ordering.row_numbers(df, ["tie"]).collect())
        assert ties == list(range(n))
        folds = selection.k_fold(df, ["id"], 5).collect()
        assert len({r["id"] for r in folds}) == len(folds) == n and {sum(r["fold"] == k for r in folds) for k in range(5)} == {n // 5}
        strata = selection.stratified_k_fold(df, "label", ["id"], 4).collect()
        assert len({r["id"] for r in strata}) == len(strata) == n
        for k in range(4):
            for label in range(3):
                assert abs(sum(r["fold"] == k and r["label"] == label for r in strata) - n / 12) <= 1
        split = selection.train_test_split(df, "id", 0.3).collect()
        assert len({r["id"] for r in split}) == len(split) == n and sum(r["is_test"] for r in split) == int(0.3 * n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_running_sums_are_those_before_the_row(spark):
    df = spark.range(0, 1000, 1, 5).select("id", (F.col("id") % 10 + 1).alias("size"), F.lit("x").alias("_part"))
    got = ordering.running_sums(df, [F.col("id").desc()], {"below": F.col("size"), "n": F.lit(1)}).orderBy(F.desc("id")).collect()
    sizes = [r["size"] for r in got]
    assert [r["below"] for r in got] == np.cumsum([0, *sizes[:-1]]).tolist() and [r["n"] for r in got] == list(range(1000))
    assert ordering.running_sums(df.limit(0), ["id"], {"below": F.col("size")}).count() == 0


@pytest.mark.parametrize("cells", [4096, 32])
def test_percentiles_are_those_of_sorted_values(spark, monkeypatch, cells):
    monkeypatch.setattr(ordering, "CELLS", cells)
    rng = np.random.default_rng(2)
    columns = {"a": rng.normal(size=999), "b": np.repeat(7.0, 999), "c": np.round(rng.normal(size=999), 1), "d": rng.normal(size=999) * 1e300, "e": np.arange(999) * 5e-324}
    rows = [tuple(float(columns[k][i]) for k in columns) + (None if i % 3 else float(i), float("nan")) for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double").repartition(5)
    points = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = ordering.order_statistics(df, {k: F.col(k) for k in df.columns}, points)
    for k in columns:
        assert np.allclose(got[k], np.quantile(columns[k], points), rtol=1e-12, atol=1e-323), k  # denormals are rounded to their grid
    assert np.allclose(got["f"], np.quantile(np.arange(0, 999, 3), points)) and got["g"] == [None] * 6
    assert ordering.order_statistics(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}
    ends = spark.createDataFrame([(INF,), (-INF,), (1.0,), (2.0,), (3.0,)], "x double")
    assert ordering.order_statistics(ends, {"x": F.col("x")}, [0, 0.25, 0.5, 1]) == {"x": [-INF, 1.0, 2.0, INF]}


def test_most_frequent_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (1.0,), (1.0,), (None,), (2.0,)], "x double")
    assert ordering.most_frequent(df, F.col("x")).first()[0] == 1.0
