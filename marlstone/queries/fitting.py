"""Kernel machines, descent, networks, mini-batches and their interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitting as L
from ..operators import interpretation as I
from .registry import query, table


def scaled(spark, sf_dir):
    """Customers with a balance in thousands and a nation in tenths."""
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_nationkey") / 10).alias("b"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("double").alias("y"))


_CUSTOMERS = "p AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 10 AS b, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::DOUBLE AS y FROM customer)"


@query(f"""WITH {_CUSTOMERS}, c AS (SELECT avg(a) AS ca, avg(b) AS cb, count(*) AS n FROM p), s AS (SELECT *, a * ca + b * cb AS s FROM p, c),
held AS (SELECT avg(a) AS ha, avg(b) AS hb FROM (SELECT *, row_number() OVER (ORDER BY s DESC) AS r FROM s) WHERE r <= floor(n * 0.9)), raw AS (SELECT c_custkey, a * ha + b * hb AS raw FROM p, held)
SELECT c_custkey, round(raw - (SELECT quantile_cont(raw, 0.1) FROM raw), 6) AS decision FROM raw""")
def one_class_svm(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return L.one_class_svm(df, ["a", "b"], 0.1, "linear").predict(df, "decision").select("c_custkey", F.round("decision", 6).alias("decision"))


@query()
def one_class_svm_rbf(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return L.one_class_svm(df, ["a", "b"], 0.1, "rbf").predict(df, "decision").select("c_custkey", "decision")


@query(f"""WITH {_CUSTOMERS}, s AS (SELECT sum(a * a) + 0.5 AS aa, sum(a * b) AS ab, sum(b * b) + 0.5 AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM p)
SELECT c_custkey, round(a * (ay * bb - by_ * ab) / (aa * bb - ab * ab) + b * (by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) AS predicted FROM p, s""")
def svm_regressor(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return L.svm_regressor(df, ["a", "b"], "y", 1.0, "linear").predict(df).select("c_custkey", F.round("predicted", 6).alias("predicted"))


@query()
def svm_regressor_polynomial(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return L.svm_regressor(df, ["a", "b"], "y", 1.0, "polynomial", 2).predict(df).select("c_custkey", F.round("predicted", 6).alias("predicted"))


@query()
def sgd_regressor(spark, sf_dir):
    df = scaled(spark, sf_dir)
    w = L.sgd_regressor(df, "c_custkey", ["a", "b"], "y", max_iter=3, shards=4)
    return spark.createDataFrame(list(w.items()), "term string, weight double")


@query()
def mlp_classifier(spark, sf_dir):
    df = scaled(spark, sf_dir)
    net = L.Network(["a", "b"], [2, 4, 1], output="sigmoid", rate=0.5).fit(df, ["y"], 10)
    return net.predict(df, "probability").select("c_custkey", "probability")


@query()
def mlp_regressor(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return L.Network(["a"], [1, 4, 1], rate=0.1).fit(df, ["b"], 10).predict(df).select("c_custkey", "predicted")


@query()
def autoencoder_error(spark, sf_dir):
    df = scaled(spark, sf_dir)
    return L.Network(["a", "b"], [2, 1, 2], rate=0.05).fit(df, ["a", "b"], 10).reconstruction_error(df).select("c_custkey", "error")


@query()
def mini_batch_kmeans(spark, sf_dir):
    df = scaled(spark, sf_dir)
    centres = L.mini_batch_kmeans(df, "c_custkey", ["a", "b"], 4, batches=4, epochs=1)
    return L.assign_nearest(df, ["a", "b"], centres).select("c_custkey", "cluster")


def _score(x):
    return 0.2 + 0.3 * x["a"] - 0.5 * x["b"] * x["a"]


@query(f"""WITH {_CUSTOMERS} SELECT v AS value, round(avg(0.2 + 0.3 * a - 0.5 * v * a), 6) AS mean FROM p, (SELECT unnest([0.0, 0.5, 1.0, 2.0]::DOUBLE[]) AS v) GROUP BY 1""")
def partial_dependence(spark, sf_dir):
    return I.partial_dependence(scaled(spark, sf_dir), ["a", "b"], "b", _score, [0.0, 0.5, 1.0, 2.0]).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_CUSTOMERS}, o AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS place FROM p), f AS (SELECT unnest(['a', 'b']) AS feature), r AS (SELECT unnest(range(3)) AS r),
m AS (SELECT feature, r, CASE feature WHEN 'a' THEN a ELSE b END AS v, row_number() OVER (PARTITION BY feature, r ORDER BY md5(concat_ws(':', 0, feature, r, c_custkey)), c_custkey) AS dealt FROM p, f, r),
l AS (SELECT feature, r, avg(pow(y - (0.2 + 0.3 * x - 0.5 * z * x), 2)) AS loss FROM (SELECT feature, r, y, CASE feature WHEN 'a' THEN v ELSE a END AS x, CASE feature WHEN 'b' THEN v ELSE b END AS z FROM o JOIN m ON place = dealt) GROUP BY 1, 2),
base AS (SELECT avg(pow(y - (0.2 + 0.3 * a - 0.5 * b * a), 2)) AS base FROM p)
SELECT feature, round(avg(loss - base), 6) AS importance, round(stddev_pop(loss - base), 6) AS deviation FROM l, base GROUP BY 1""")
def permutation_importance(spark, sf_dir):
    out = I.permutation_importance(scaled(spark, sf_dir), "c_custkey", ["a", "b"], "y", _score, 3)
    return out.withColumns({c: F.round(c, 6) for c in ("importance", "deviation")})
