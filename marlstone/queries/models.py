"""Estimators on customers, lines and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from .registry import query, table


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def linear_regression_closed_form(spark, sf_dir):
    b = M.linear_regression(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(b["intercept"], 4), round(b["l_quantity"], 4))], "intercept double, slope double")


@query("""WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) + 1000 AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem)
SELECT round((n * xy - x * y) / (n * xx - x * x), 4) AS slope FROM s""")
def ridge_regression(spark, sf_dir):
    b = M.linear_regression(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", 1000.0)
    return spark.createDataFrame([(round(b["l_quantity"], 4),)], "slope double")


@query("""WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v FROM lineitem)
SELECT round(sign(c) * greatest(abs(c) - 100, 0) / v, 4) AS slope FROM s""")
def lasso_regression(spark, sf_dir):
    b = M.lasso(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", 100.0, passes=2000)
    return spark.createDataFrame([(round(b["l_quantity"], 4),)], "slope double")


def _descent_sql(rate: float, steps: int) -> str:
    parts = ["r AS (SELECT l_quantity / 50 AS q, l_discount AS d, (l_returnflag = 'R')::DOUBLE AS y FROM lineitem)", "w0 AS (SELECT 0.0::DOUBLE AS wi, 0.0::DOUBLE AS wq, 0.0::DOUBLE AS wd)"]
    for k in range(steps):
        parts.append(f"w{k + 1} AS (SELECT any_value(wi) - {rate}::DOUBLE * avg(e) AS wi, any_value(wq) - {rate}::DOUBLE * avg(e * q) AS wq, any_value(wd) - {rate}::DOUBLE * avg(e * d) AS wd FROM (SELECT *, 1 / (1 + exp(-(wi + wq * q + wd * d))) - y AS e FROM r, w{k}))")
    return f"WITH {', '.join(parts)} SELECT unnest(['intercept', 'q', 'l_discount']) AS term, unnest([round(wi, 8), round(wq, 8), round(wd, 8)]) AS weight FROM w{steps}"


@query(_descent_sql(0.5, 5))
def logistic_gradient_descent(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), F.col("l_discount"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    w = M.logistic_gradient_descent(rows, ["q", "l_discount"], "y", 0.5, 5)
    return spark.createDataFrame([(k, round(v, 8)) for k, v in w.items()], "term string, weight double")


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity_mean, round(var_pop(l_quantity), 6) AS l_quantity_var, round(avg(l_discount), 6) AS l_discount_mean, round(var_pop(l_discount), 6) AS l_discount_var,
 round(count(*) / (SELECT count(*) FROM lineitem), 6) AS prior FROM lineitem GROUP BY 1""")
def gaussian_nb_fit(spark, sf_dir):
    out = M.gaussian_nb_fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return rounded(out, "prior", *[f"{c}_{k}" for c in ("l_quantity", "l_discount") for k in ("mean", "var")])


@query("""WITH m AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer) AS p, avg(c_acctbal) AS a, var_pop(c_acctbal) + 1e-9 AS v FROM customer GROUP BY 1)
SELECT c_custkey, arg_max(m.c_mktsegment, (ln(p) - 0.5 * ln(2 * pi() * v) - pow(c_acctbal - a, 2) / (2 * v), m.c_mktsegment)) AS predicted FROM customer, m GROUP BY 1""")
def gaussian_nb_predict(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return M.gaussian_nb_predict(rows, "c_custkey", ["c_acctbal"], M.gaussian_nb_fit(rows, ["c_acctbal"], "c_mktsegment"), "c_mktsegment")


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity) AS q, sum(l_linenumber) AS k FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(ln((q + 1) / (q + k + 2)), 6) AS l_quantity_logp, round(ln((k + 1) / (q + k + 2)), 6) AS l_linenumber_logp FROM s""")
def multinomial_nb_fit(spark, sf_dir):
    return rounded(M.multinomial_nb_fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"], "l_returnflag"), "l_quantity_logp", "l_linenumber_logp")


@query("SELECT l_returnflag, round((count(*) FILTER (WHERE l_discount > 0.05) + 1.0::DOUBLE) / (count(*) + 2), 6) AS l_discount_p FROM lineitem GROUP BY 1")
def bernoulli_nb_fit(spark, sf_dir):
    return rounded(M.bernoulli_nb_fit(table(spark, sf_dir, "lineitem"), ["l_discount"], "l_returnflag", binarize=0.05), "l_discount_p")


@query("""WITH x AS (SELECT s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier), c AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE), (1, 5.0::DOUBLE, 12.0::DOUBLE), (2, 9.0::DOUBLE, 20.0::DOUBLE)) t(cluster, ca, cb)),
w AS (SELECT a, b, cluster, exp(-(pow(a - ca, 2) + pow(b - cb, 2)) / 10) AS w FROM x, c), n AS (SELECT *, w / sum(w) OVER (PARTITION BY a, b) AS p FROM w)
SELECT cluster, round(sum(p * a) / sum(p), 6) AS a, round(sum(p * b) / sum(p), 6) AS b FROM n GROUP BY 1""")
def kmeans_one_step(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return rounded(M.soft_kmeans_step(rows, ["a", "b"], [(0, 5), (5, 12), (9, 20)], 10.0), "a", "b")


_COV = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS cov FROM lineitem" for i, a in enumerate(_COV) for b in _COV[i:]))
def pca_covariance(spark, sf_dir):
    return rounded(M.pca_covariance(table(spark, sf_dir, "lineitem"), _COV), "cov")


def _eigenvalues_sql() -> str:
    """The greatest root of the characteristic polynomial by Newton steps from above, then those of the quadratic that is left."""
    a = [f"covar_samp({x}, {y}) AS c{i}{j}" for i, x in enumerate(_COV) for j, y in enumerate(_COV) if i <= j]
    parts = [f"c AS (SELECT {', '.join(a)} FROM lineitem)"]
    parts.append("p AS (SELECT c00 + c11 + c22 AS t, c00 * c11 + c00 * c22 + c11 * c22 - c01 * c01 - c02 * c02 - c12 * c12 AS m, c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02) AS d FROM c)")
    parts.append("x0 AS (SELECT *, t AS x FROM p)")
    for k in range(8):
        parts.append(f"x{k + 1} AS (SELECT t, m, d, x - (((x - t) * x + m) * x - d) / ((3 * x - 2 * t) * x + m) AS x FROM x{k})")
    parts.append("e AS (SELECT x, ((t - x) + sqrt(greatest(0, pow(t - x, 2) - 4 * d / x))) / 2 AS y FROM x8)")
    return f"WITH {', '.join(parts)} SELECT unnest([0, 1])::INT AS component, unnest([round(x, 6), round(y, 6)]) AS variance FROM e"


@query(_eigenvalues_sql())
def pca_explained(spark, sf_dir):
    values, _ = M.pca(table(spark, sf_dir, "lineitem"), _COV, 2)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "component int, variance double")


@query("SELECT p_partkey, (CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END)::INT AS vote, round((a + 2 * b + c) / 4, 6) AS soft FROM (SELECT p_partkey, p_size % 3 AS a, p_partkey % 3 AS b, p_size % 2 AS c FROM part)")
def vote_ensemble(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).cast("int").alias("a"), (F.col("p_partkey") % 3).cast("int").alias("b"), (F.col("p_size") % 2).cast("int").alias("c"))
    soft = rows.select("p_partkey", F.round(M.weighted_vote(rows, {"a": 1, "b": 2, "c": 1}), 6).alias("soft"))
    return M.hard_vote(rows, "p_partkey", ["a", "b", "c"]).join(soft, "p_partkey")


@query("SELECT p_partkey, list_contains(string_split(p_type, ' '), 'BRASS')::INT AS tags_BRASS, list_contains(string_split(p_type, ' '), 'STEEL')::INT AS tags_STEEL FROM part")
def multi_label_indicators(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("tags"))
    return M.multi_label_indicators(rows, "tags", ["BRASS", "STEEL"]).drop("tags")


@query()
def decision_stump(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "N").cast("int"))
    return M.decision_stump(rows, ["l_quantity", "l_extendedprice"], "y", F.lit(1.0))


def _ml(kind: str, **params):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("y"))
        supervised = kind not in ("kmeans", "gaussian_mixture")
        return M.fit_ml(rows, kind, ["c_acctbal", "nation"], "y" if supervised else None, **params).transform(rows).select("c_custkey", "prediction")

    return run


for _kind, _params in {"decision_tree": {"maxDepth": 3}, "random_forest": {"numTrees": 5, "maxDepth": 3, "seed": 1}, "gradient_boosting": {"maxIter": 3, "maxDepth": 2, "seed": 1}, "logistic": {"maxIter": 5}, "linear_svm": {"maxIter": 5}, "kmeans": {"k": 3, "seed": 1}, "gaussian_mixture": {"k": 2, "seed": 1, "maxIter": 5}}.items():
    query(name=f"ml_{_kind}")(_ml(_kind, **_params))


@query("""WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v FROM lineitem)
SELECT round(sign(c) * greatest(abs(c) - 50, 0) / (v + 50), 4) AS slope FROM s""")
def elastic_net_regression(spark, sf_dir):
    b = M.lasso(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", 100.0, 0.5, 2000)
    return spark.createDataFrame([(round(b["l_quantity"], 4),)], "slope double")


@query("""WITH g AS (SELECT p_size AS x, sum(p_retailprice) AS y, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT a.x AS lo, b.x AS hi, sum(c.y) / sum(c.n) AS mean FROM g a JOIN g b ON a.x <= b.x JOIN g c ON c.x BETWEEN a.x AND b.x GROUP BY 1, 2),
m AS (SELECT g.x, r.lo, min(r.mean) AS least FROM g JOIN r ON r.lo <= g.x AND r.hi >= g.x GROUP BY 1, 2), f AS (SELECT x, max(least) AS fitted FROM m GROUP BY 1)
SELECT p_partkey, round(fitted, 4) AS fitted FROM part JOIN f ON p_size = x""")
def isotonic_regression(spark, sf_dir):
    """The SQL is the max-min formula: of the blocks that begin at or before a size, the greatest of their least means."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    return M.isotonic(rows, "size", "p_retailprice").select("p_partkey", F.round("fitted", 4).alias("fitted"))
