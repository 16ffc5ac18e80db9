"""Metrics over labelled documents, lines, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query, table


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def judged(spark, sf_dir):
    """y: quality; score from the text's length; yhat: the score above one half."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    p = F.col("n_chars") / (F.col("n_chars") + 1500.0)
    return rows.select("doc_id", "lang", F.col("quality").alias("y"), p.alias("p"), (p > 0.5).cast("int").alias("yhat"))


JUDGED = "j AS (SELECT doc_id, lang, quality AS y, n_chars / (n_chars + 1500.0::DOUBLE) AS p, (n_chars / (n_chars + 1500.0::DOUBLE) > 0.5)::INT AS yhat FROM documents JOIN labels USING (doc_id))"


@query("""WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS h FROM lineitem)
SELECT round(avg(pow(y - h, 2)), 4) AS mse, round(sqrt(avg(pow(y - h, 2))), 6) AS rmse, round(avg(abs(y - h)), 6) AS mae, round(100 * avg(abs((y - h) / y)) FILTER (WHERE y != 0), 6) AS mape,
 round(1 - avg(pow(y - h, 2)) / var_pop(y), 6) AS r2, round(1 - var_pop(y - h) / var_pop(y), 6) AS explained_variance FROM e""")
def regression_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("h"))
    out = M.regression_metrics(rows, "y", "h")
    return rounded(out, *[c for c in out.columns if c != "mse"]).withColumn("mse", F.round("mse", 4))


@query(f"WITH {JUDGED} SELECT y AS actual, yhat AS predicted, count(*) AS n FROM j GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(judged(spark, sf_dir), "y", "yhat")


@query(f"""WITH {JUDGED}, c AS (SELECT k, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE yhat = k) AS h, count(*) FILTER (WHERE y = k AND yhat = k) AS tp FROM j, (SELECT unnest([0, 1]) AS k) GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(h, 0), 0) AS p, tp / s AS r FROM c WHERE s > 0)
SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * s) / sum(s), 6) AS f1 FROM m""")
def classification_report(spark, sf_dir):
    return rounded(M.classification_report(judged(spark, sf_dir), "y", "yhat"), "accuracy", "precision", "recall", "f1")


@query(f"""WITH {JUDGED} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc FROM j a JOIN j b ON a.y = 1 AND b.y = 0""")
def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(judged(spark, sf_dir), "y", "p"), "auc")


@query(f"WITH {JUDGED} SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM (SELECT y, least(greatest(p, 1e-15), 1 - 1e-15) AS p FROM j)")
def log_loss(spark, sf_dir):
    return rounded(M.log_loss(judged(spark, sf_dir), "y", "p"), "log_loss")


@query(f"WITH {JUDGED} SELECT round(avg(-ln(greatest(CASE y WHEN 0 THEN 1 - p ELSE p END, 1e-15))), 6) AS log_loss FROM j")
def log_loss_multiclass(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("probs", F.array(1 - F.col("p"), F.col("p")))
    return rounded(M.log_loss_multiclass(rows, "y", "probs"), "log_loss")


@query(f"""WITH {JUDGED} SELECT least(9, greatest(0, ceil(p * 10) - 1))::INT AS bin, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS mean_actual, count(*) AS n FROM j GROUP BY 1""")
def calibration_curve(spark, sf_dir):
    return rounded(M.calibration_curve(judged(spark, sf_dir), "y", "p"), "mean_predicted", "mean_actual")


@query(f"""WITH {JUDGED}, r AS (SELECT lang, avg(yhat) AS rate FROM j GROUP BY 1) SELECT lang, round(rate, 6) AS rate, round(max(rate) OVER () - min(rate) OVER (), 6) AS disparity,
 max(rate) OVER () - min(rate) OVER () < 0.1 AS fair FROM r""")
def demographic_parity(spark, sf_dir):
    return rounded(M.demographic_parity(judged(spark, sf_dir), "lang", F.col("yhat")), "rate", "disparity")


@query(f"""WITH {JUDGED}, r AS (SELECT lang, coalesce(avg(yhat) FILTER (WHERE y = 1), 0) AS tpr, coalesce(avg(yhat) FILTER (WHERE y = 0), 0) AS fpr FROM j GROUP BY 1)
SELECT lang, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(max(tpr) OVER () - min(tpr) OVER (), 6) AS tpr_disparity, round(max(fpr) OVER () - min(fpr) OVER (), 6) AS fpr_disparity FROM r""")
def equalized_odds(spark, sf_dir):
    return rounded(M.equalized_odds(judged(spark, sf_dir), "lang", "y", "yhat"), "tpr", "fpr", "tpr_disparity", "fpr_disparity")


def clustered(spark, sf_dir):
    """Suppliers as points in the plane, clustered by a third of the balance."""
    v = F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("c"), v.alias("v"))


_POINTS = "p AS (SELECT s_suppkey AS k, (s_nationkey % 3)::INT AS c, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier)"


@query(f"""WITH {_POINTS}, d AS (SELECT x.k, x.c, y.c AS o, avg(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) AS d FROM p x JOIN p y ON x.k != y.k GROUP BY 1, 2, 3),
s AS (SELECT k, min(d) FILTER (WHERE c = o) AS own, min(d) FILTER (WHERE c != o) AS other FROM d GROUP BY 1)
SELECT round(avg(coalesce((other - own) / greatest(own, other), 0)), 6) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    return rounded(M.silhouette(clustered(spark, sf_dir), "s_suppkey", "c", "v"), "silhouette")


@query(f"""WITH {_POINTS}, g AS (SELECT c, count(*) AS n, avg(a) AS a, avg(b) AS b FROM p GROUP BY 1), o AS (SELECT avg(a) AS a, avg(b) AS b, count(*) AS t FROM p),
bt AS (SELECT sum(n * (pow(g.a - o.a, 2) + pow(g.b - o.b, 2))) AS v, count(*) AS k, max(t) AS t FROM g, o), w AS (SELECT sum(pow(p.a - g.a, 2) + pow(p.b - g.b, 2)) AS w FROM p JOIN g USING (c))
SELECT round((v / (k - 1)) / (w / (t - k)), 6) AS score FROM bt, w""")
def calinski_harabasz(spark, sf_dir):
    return rounded(M.calinski_harabasz(clustered(spark, sf_dir), "c", "v", 2), "score")


@query(f"""WITH {_POINTS}, g AS (SELECT c, avg(a) AS a, avg(b) AS b FROM p GROUP BY 1), s AS (SELECT g.c, g.a, g.b, avg(sqrt(pow(p.a - g.a, 2) + pow(p.b - g.b, 2))) AS s FROM p JOIN g USING (c) GROUP BY 1, 2, 3),
r AS (SELECT x.c, max((x.s + y.s) / sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) AS r FROM s x JOIN s y ON x.c != y.c GROUP BY 1) SELECT round(avg(r), 6) AS score FROM r""")
def davies_bouldin(spark, sf_dir):
    return rounded(M.davies_bouldin(clustered(spark, sf_dir), "c", "v", 2), "score")


@query("""WITH s AS (SELECT user_id, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n, v[floor(n * 0.5)::INT + 1] AS p50, CASE WHEN n < 20 THEN v[-1] ELSE v[floor(n * 0.95)::INT + 1] END AS p95, CASE WHEN n < 100 THEN v[-1] ELSE v[floor(n * 0.99)::INT + 1] END AS p99 FROM s""")
def latency_percentiles(spark, sf_dir):
    return M.latency_percentiles(table(spark, sf_dir, "events"), "user_id", "value")


@query("""WITH l AS (SELECT l_linenumber % 2 = 0 AS t, abs(l_quantity - 25) AS loss FROM lineitem), m AS (SELECT avg(loss) FILTER (WHERE t) AS a, avg(loss) FILTER (WHERE NOT t) AS b FROM l)
SELECT round(a, 6) AS train_loss, round(b, 6) AS test_loss, round(abs(a - b) / greatest(a, b), 6) AS gap FROM m""")
def membership_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.abs(F.col("l_quantity") - 25).alias("loss"))
    return rounded(M.membership_gap(rows, "loss", F.col("l_linenumber") % 2 == 0), "train_loss", "test_loss", "gap")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS last, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def counters_and_gauges(spark, sf_dir):
    return M.counters_and_gauges(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"]).withColumn("total", F.round("total", 4))
