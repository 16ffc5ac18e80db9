"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip, dot
from ..sources.shared import materialize
from .neighbors import BLOCK, Cells, Kernel
from .ordering import running_sums


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """mse, rmse, mae, mape (y != 0 only), r2 and explained variance in one aggregation."""
    e = F.col(y) - F.col(yhat)
    row = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (100 * F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0)))))).alias("mape"), F.var_pop(y).alias("_v"), F.var_pop(e).alias("_e"))
    score = lambda part: F.when(F.col("_v") == 0, 0.0).otherwise(1 - F.col(part) / F.col("_v"))
    return row.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.coalesce("mape", F.lit(float("inf"))).alias("mape"), score("mse").alias("r2"), score("_e").alias("explained_variance"))


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """accuracy and support-weighted precision, recall and F1, from the confusion counts."""
    cells = confusion_matrix(df, y, yhat)
    actual = cells.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("named"))
    per = actual.join(predicted, "class", "left")
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("named")), F.lit(0.0))
    recall = F.col("tp") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    weighted = lambda m: F.sum(m * F.col("support")) / F.sum("support")
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), weighted(precision).alias("precision"), weighted(recall).alias("recall"), weighted(f1).alias("f1"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties merged; rows without a score are left out.

    Scores are counted first, and running sums go over range partitions of the distinct
    ones, so neither ties nor crowded scores meet in one task.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    ranked = running_sums(counts, ["s"], {"below": F.col("n")})
    area = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return ranked.agg(F.try_divide(area.cast("double"), F.sum("p") * F.sum("n")).alias("auc"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = clip(F.col(p), eps, 1 - eps)
    return df.agg(F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))


def log_loss_multiclass(df: DataFrame, label: str, probabilities: str, eps: float = 1e-15) -> DataFrame:
    """label: 0-based position in the array of probabilities."""
    return df.agg(F.avg(-F.log(clip(F.element_at(probabilities, F.col(label) + 1), eps, 1 - eps))).alias("log_loss"))


def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, mean_predicted, mean_actual, n of right-closed equal bins; empty bins are left out."""
    b = clip(F.ceil(F.col(p) * bins) - 1, 0, bins - 1).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(y).alias("mean_actual"), F.count(F.lit(1)).alias("n"))


def demographic_parity(df: DataFrame, group: str, predicted: Column) -> DataFrame:
    """group, rate, disparity (largest minus smallest rate), fair (below 0.1)."""
    rates = df.groupBy(group).agg(F.avg((predicted > 0).cast("double")).alias("rate"))
    spread = rates.agg((F.max("rate") - F.min("rate")).alias("disparity"))
    return rates.crossJoin(F.broadcast(spread)).withColumn("fair", F.col("disparity") < 0.1)


def equalized_odds(df: DataFrame, group: str, y: str, yhat: str) -> DataFrame:
    """group, tpr, fpr and their disparities."""
    rate = lambda label: F.coalesce(F.avg(F.when(F.col(y) == label, (F.col(yhat) > 0).cast("double"))), F.lit(0.0))
    rates = df.groupBy(group).agg(rate(1).alias("tpr"), rate(0).alias("fpr"))
    spread = rates.agg((F.max("tpr") - F.min("tpr")).alias("tpr_disparity"), (F.max("fpr") - F.min("fpr")).alias("fpr_disparity"))
    return rates.crossJoin(F.broadcast(spread))


def centroids(df: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """label, n, centroid of each cluster."""
    means = F.array(*[F.avg(F.element_at(vector, k + 1).cast("double")) for k in range(dim)])
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), means.alias("centroid"))


def _distance2(a: str, b: str) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return dot(diff, diff)


def calinski_harabasz(df: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """(between / (k - 1)) / (within / (n - k))."""
    centres = centroids(df, label, vector, dim)
    overall = df.agg(F.array(*[F.avg(F.element_at(vector, k + 1).cast("double")) for k in range(dim)]).alias("overall"))
    between = centres.crossJoin(F.broadcast(overall)).agg(F.sum(F.col("n") * _distance2("centroid", "overall")).alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    within = df.join(centres, label).agg(F.sum(_distance2(vector, "centroid")).alias("w"))
    return between.crossJoin(within).select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("total") - F.col("k")))).alias("score"))


def davies_bouldin(df: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """Mean over clusters of the largest (si + sj) / dij."""
    centres = centroids(df, label, vector, dim)
    spread = df.join(centres, label).groupBy(label).agg(F.avg(F.sqrt(_distance2(vector, "centroid"))).alias("_s"), F.first("centroid").alias("_c"))
    a, b = spread.select(F.col(label).alias("i"), F.col("_s").alias("si"), F.col("_c").alias("ci")), spread.select(F.col(label).alias("j"), F.col("_s").alias("sj"), F.col("_c").alias("cj"))
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.sqrt(_distance2("ci", "cj"))).alias("r"))
    return worst.agg(F.avg("r").alias("score"))


#: Numbers that a block of silhouette() holds: distance sums of its sites to each cluster.
SUMS_AT_ONCE = 1 << 22
#: Clusters whose sums are one product of matrices.
FEW_CLUSTERS = 64


class _ClusterMeans(Kernel):
    """own, other: mean distances of the held sites to their own cluster and to the nearest other one."""

    def start(self, site, v, label, n):
        self.sums, self.rows = {}, {}

    def meet(self, d, site, label, n):
        finite = np.isfinite(d).all()
        if not finite:  # a row does not meet itself, though inf - inf is no number
            d = np.where((self.held[0][:, None] == site) & (n == 1), 0.0, d)
        order = np.argsort(label, kind="stable")
        names, first, of = np.unique(label[order], return_index=True, return_inverse=True)
        rows = np.add.reduceat(n[order], first)
        if finite and len(names) <= FEW_CLUSTERS:
            weights = np.zeros((len(n), len(names)))
            weights[order, of] = n[order]
            sums = d @ weights
        else:
            sums = np.add.reduceat((d * n)[:, order], first, axis=1)
        for k, name in enumerate(names.tolist()):
            self.sums[name] = self.sums.get(name, 0.0) + sums[:, k]
            self.rows[name] = self.rows.get(name, 0) + int(rows[k])

    def result(self):
        import pyarrow as pa

        site, _, label, _ = self.held
        own, other = np.full(len(site), np.nan), np.full(len(site), np.nan)
        alone, near = np.ones(len(site), bool), np.zeros(len(site), bool)
        for name, total in self.sums.items():
            mine, rows = label == name, self.rows[name]
            if rows > 1:
                own[mine], alone[mine] = total[mine] / (rows - 1), False
            other[~mine], near[~mine] = np.fmin(other, total / rows)[~mine], True
        return {"site": site, "own": pa.array(own, mask=alone), "other": pa.array(other, mask=~near)}

    def nothing(self):
        import pyarrow as pa

        return {"site": pa.array([], pa.int64()), "own": pa.array([], pa.float64()), "other": pa.array([], pa.float64())}


def _cluster_means(rows: DataFrame) -> DataFrame:
    """label, v, own, other of the distinct sites of rows (label, v), of which no label, vector or component is null."""
    spark = rows.sparkSession
    labels = materialize(rows.select("label").distinct().withColumn("code", F.monotonically_increasing_id()), "labels")
    table = rows.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n")).join(labels, "label").withColumn("site", F.monotonically_increasing_id())
    table, clusters = materialize(table, "sites"), labels.count()
    found = spark.createDataFrame([], "site long, own double, other double")
    for width in sorted(r["w"] for r in table.select(F.size("v").alias("w")).distinct().collect()):  # usually one; vectors of different lengths have no distance
        padded = F.col("v") if width else F.array(F.lit(0.0))
        some = table.filter(F.size("v") == width).select("site", padded.alias("v"), F.col("code").alias("label"), "n")
        cells = Cells(some, block=max(1, min(BLOCK, SUMS_AT_ONCE // clusters)))
        found = found.unionByName(cells.sweep(cells.housed(some), some, "double('infinity')", _ClusterMeans, "site long, own double, other double"))
    return table.select("site", "label", "v").join(found, "site").drop("site")


def silhouette(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Mean silhouette by exact pairwise distances; a cluster of one scores 0.

    Equal points of a cluster are one site with a weight, and blocks of sites meet all
    sites: time grows with the square of the number of distinct points. Rows that share
    a key do not meet; they are joined with all rows.
    """
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 counts as 0.0
    rows = materialize(df.select(F.col(key).alias("i"), F.col(label).alias("label"), v.alias("v")).filter("i is not null"), "rows")
    keys = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    repeated = materialize(keys.filter("n > 1").select("i"), "repeated")
    means = _cluster_means(placed)
    per = placed.join(repeated, "i", "left_anti").groupBy("label", "v").agg(F.count(F.lit(1)).alias("n")).join(means, ["label", "v"]).select("n", "own", "other")
    if not repeated.isEmpty():
        a, b = placed.join(repeated, "i", "left_semi"), placed.select(F.col("i").alias("j"), F.col("label").alias("lj"), F.col("v").alias("vj"))
        d = a.join(b, F.col("i") != F.col("j")).groupBy("i", "label", "lj").agg(F.avg(F.sqrt(_distance2("v", "vj"))).alias("d"))
        per = per.unionByName(d.groupBy("i").agg(F.min(F.when(F.col("label") == F.col("lj"), F.col("d"))).alias("own"), F.min(F.when(F.col("label") != F.col("lj"), F.col("d"))).alias("other")).select(F.lit(1).cast("long").alias("n"), "own", "other"))
    s = F.when(F.col("own").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0)))
    every = keys.agg(F.count(F.lit(1)).alias("rows"))  # rows without a label or point score 0
    return per.agg(F.sum(F.col("n") * s).alias("total")).crossJoin(F.broadcast(every)).select(F.when(F.col("rows") > 1, F.coalesce("total", F.lit(0.0)) / F.col("rows")).alias("silhouette"))


def latency_percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95, p99 = sorted[int(n q)]; p95 is the maximum below 20 values, p99 below 100.

    Values are counted per key before the window, so a hot key costs its distinct values.
    """
    counted = df.groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v")))
    n = F.max("n")
    return ranked.groupBy(by).agg(n.alias("n"), at(0.5).alias("p50"), F.when(n < 20, F.max("v")).otherwise(at(0.95)).alias("p95"), F.when(n < 100, F.max("v")).otherwise(at(0.99)).alias("p99"))


def membership_gap(df: DataFrame, loss: str, is_train: Column) -> DataFrame:
    """Mean loss of members and others and the relative gap between them."""
    train, test = F.avg(F.when(is_train, F.col(loss))), F.avg(F.when(~is_train, F.col(loss)))
    return df.agg(train.alias("train_loss"), test.alias("test_loss"), F.try_divide(F.abs(train - test), F.greatest(F.abs(train), F.abs(test))).alias("gap"))


def counters_and_gauges(df: DataFrame, name: str, value: str, at: Sequence[str]) -> DataFrame:
    """Running metrics by name: count, sum, last value, extremes."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max_by(value, F.struct(*at)).alias("last"), F.min(value).alias("least"), F.max(value).alias("most"))
