import datetime as dt

import numpy as np
import pytest

from marlstone.operators import metrics, outliers, privacy, quality, relational, selection, validation
from marlstone.operators import timeseries as ts
from marlstone.plans import explain
from pyspark.sql import functions as F


def test_quality_scores_of_a_clean_and_an_empty_set(spark):
    counts = spark.createDataFrame([(100, 5, 0, 0, 0, 0, 0, 0, 0.0), (0, 5, 0, 0, 0, 0, 0, 0, 0.0)], "records long, features int, nulls int, duplicates int, outliers int, schema_violations int, format_violations int, range_violations int, age_days double")
    for score in (quality.quality_score_v1, quality.quality_score_v3):
        assert [r["overall"] for r in score(counts).orderBy(F.col("records").desc()).collect()] == [100.0, 0.0]
    assert quality.quality_score_v2(counts).filter("records = 100").first()["overall"] == 100.0


def test_timeliness_follows_its_lines(spark):
    ages = spark.createDataFrame([(0.5,), (4.0,), (30.0,), (90.0,), (400.0,)], "a double")
    assert np.allclose([r[0] for r in ages.select(quality.timeliness(F.col("a"))).collect()], [100, 95, 70, 50, 0])


def test_z_threshold_of_two_or_less_means_three(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(200.0,)], "x double")
    assert quality.outlier_counts(df, ["x"], "zscore", 1.5).first()["n_outliers"] == 1


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a@b.co", " "), (2, "no", None)], "id int, mail string, name string")
    schema = validation.DataSchema([validation.ColumnSchema("mail", constraints=[validation.is_email()]), validation.ColumnSchema("name", constraints=[validation.not_null()]), validation.ColumnSchema("age")])
    found = {(r["id"], r["constraint"]) for r in schema.violations(df, ["id"]).collect()}
    assert found == {(2, "is_email"), (1, "not_null"), (2, "not_null")}
    assert ("age", "error", "missing column") in schema.structure(df)
    assert ("id", "warning", "unknown column") in schema.structure(df)


def test_in_range_passes_nulls_and_fails_text(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,), ("11",)], "v string")
    assert [r[0] for r in df.select(validation.in_range(0, 10).broken(F.col("v"))).collect()] == [False, True, False, True]


def test_masks_cancel_and_dropouts_are_corrected(spark):
    v = spark.createDataFrame([(1, [1, 2, -3]), (2, [10, 20, 30]), (5, [100, 200, 300])], "party int, vector array<long>")
    masks = privacy.pair_masks(v, "party", 3, "s")
    assert sorted(privacy.masked_sum(v, "party", "vector", masks).collect()) == [(0, 111), (1, 222), (2, 327)]
    rest = privacy.masked_sum(v, "party", "vector", masks, surviving=v.filter("party != 2"))
    assert sorted(rest.collect()) == [(0, 101), (1, 202), (2, 297)]


def test_noise_is_the_same_when_recomputed(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"))
    a = privacy.private_rows(df, "id", ["x"], 100.0, 1.0, seed=3).orderBy("id").collect()
    b = privacy.private_rows(df.repartition(7), "id", ["x"], 100.0, 1.0, seed=3).orderBy("id").collect()
    assert a == b and a != df.orderBy("id").collect()
    assert a != privacy.private_rows(df, "id", ["x"], 100.0, 1.0, seed=4).orderBy("id").collect()


def test_noise_needs_a_seed(spark):
    df = spark.range(20000).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    for call in (lambda: privacy.private_rows(df, "id", ["x"], 1.0, 1.0), lambda: privacy.private_mean(df, ["x"], 1.0, 1.0), lambda: privacy.private_labels(df, "id", "y", 1.0), lambda: privacy.private_training(df, ["x"], "y", 1, 1.0, 1.0, 0.1)):
        with pytest.raises(ValueError):
            call()
    noise = df.select(privacy.laplace_noise(F.col("id"), 2.0, "s").alias("l"), privacy.gaussian_noise(F.col("id"), 3.0, "s").alias("g"))
    r = noise.agg(F.avg("l").alias("ml"), F.stddev("l").alias("sl"), F.avg("g").alias("mg"), F.stddev("g").alias("sg"), F.corr("l", "g").alias("c")).first()
    assert abs(r["ml"]) < 0.1 and r["sl"] == pytest.approx(2 * 2**0.5, rel=0.05) and abs(r["mg"]) < 0.1 and r["sg"] == pytest.approx(3, rel=0.05) and abs(r["c"]) < 0.05
    assert privacy.private_training(df, ["x"], "y", 2, 1.0, 1.0, 0.1, "s") == pytest.approx(privacy.private_training(df.repartition(3), ["x"], "y", 2, 1.0, 1.0, 0.1, "s"))


def test_clipping_keeps_the_norm(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 0.0)], "id int, a double, b double")
    assert [tuple(r)[1:] for r in privacy.clip_rows(df, ["a", "b"], 1.0).orderBy("id").collect()] == [(0.6000000000000001, 0.8), (0.0, 0.0)]


def test_folds_have_the_sizes_of_contiguous_folds(spark):
    df = spark.range(13)
    sizes = sorted(r["n"] for r in selection.k_fold(df, ["id"], 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes == [2, 2, 3, 3, 3]
    assert selection.train_test_split(df, "id", 0.25).filter("is_test").count() == 3


def test_auc_merges_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == 0.625


def test_percentiles_fall_to_the_maximum_below_their_counts(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double")
    assert metrics.latency_percentiles(df, "k", "v").first()[:] == ("a", 10, 5.0, 9.0, 9.0)


def test_isolation_forest_ranks_the_far_point_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))] + [(999, 9.0, 9.0)]
    scores = outliers.isolation_forest(spark.createDataFrame(rows, "id int, a double, b double"), "id", ["a", "b"], trees=30)
    assert scores.orderBy(F.col("score").desc()).first()["id"] == 999


def test_autoregression_recovers_its_coefficient(spark):
    y, rows = 1.0, []
    for t in range(60):
        rows.append(("s", t, y))
        y *= 0.9
    got = ts.autoregression(spark.createDataFrame(rows, "k string, t int, y double"), ["k"], "t", "y").first()
    assert abs(got["coefficients"][0] - 0.9) < 1e-4


def test_filters_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = relational.apply_filters(orders, {"o_orderstatus": "F"}).select("o_orderkey")
    assert "EqualTo(o_orderstatus,F)" in explain.pushed_filters(plan)[0]
    assert "o_totalprice" not in explain.scanned_columns(plan)[0] and not explain.has_python(plan)


def test_chain_breaks(spark):
    rows = [(1, 1, "", "a"), (1, 2, "a", "b"), (1, 3, "x", "c"), (2, 1, "", "d")]
    out = relational.chain_breaks(spark.createDataFrame(rows, "k int, t int, prev string, hash string"), "k", ["t"], "prev", "hash")
    assert sorted(out.collect()) == [(1, 3, 1, False), (2, 1, 0, True)]


def test_rate_limiter_counts_from_the_first_hit(spark, tmp_path):
    from marlstone.streaming import counters

    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s)) for s in (50, 70, 100, 115, 200)] + [("z", start + dt.timedelta(hours=9))]
    spark.createDataFrame(rows, "u string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = counters.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    got = counters.drain(counters.rate_limiter(stream, "u", 2), str(tmp_path / "out")).filter("u = 'a'").orderBy("started").collect()
    assert [(r["hits"], r["rejected"]) for r in got][:2] == [(3, 1), (1, 0)]
