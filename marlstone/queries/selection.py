"""Outliers, feature selection and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as O
from ..operators import selection as S
from .registry import query, table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("""SELECT o_orderkey, abs(o_totalprice - m) > 1.5 * s AS is_outlier FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)""")
def outliers_zscore(spark, sf_dir):
    return O.flag_zscore(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1.5).select("o_orderkey", "is_outlier")


@query("""SELECT c_custkey, c_acctbal < q[1] - 0.3 * (q[2] - q[1]) OR c_acctbal > q[2] + 0.3 * (q[2] - q[1]) AS is_outlier FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.75]) AS q FROM customer)""")
def outliers_any_iqr(spark, sf_dir):
    return O.flag_iqr(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 0.3).select("c_custkey", "is_outlier")


@query("""WITH m AS (SELECT median(c_acctbal) AS m FROM customer), d AS (SELECT median(abs(c_acctbal - m)) AS mad FROM customer, m)
SELECT c_custkey, 0.6745 * abs(c_acctbal - m) / mad > 1.2 AS is_outlier FROM customer, m, d""")
def outliers_mad(spark, sf_dir):
    return O.flag_mad(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 1.2).select("c_custkey", "is_outlier")


def points(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("v"))


_POINTS = "p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier), d AS (SELECT x.k AS i, y.k AS j, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d FROM p x JOIN p y ON x.k != y.k)"


@query(f"""WITH {_POINTS}, c AS (SELECT i FROM d WHERE d <= 0.6 GROUP BY i HAVING count(*) + 1 >= 3)
SELECT k AS s_suppkey, NOT (k IN (SELECT i FROM c) OR k IN (SELECT i FROM d WHERE d <= 0.6 AND j IN (SELECT i FROM c))) AS is_noise FROM p""")
def dbscan_noise(spark, sf_dir):
    return O.dbscan_noise(points(spark, sf_dir), "s_suppkey", "v", 0.6, 3)


@query(f"""WITH {_POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d QUALIFY k <= 10), kd AS (SELECT i, max(d) AS kd FROM n GROUP BY 1),
r AS (SELECT n.i, n.j, greatest(kd.kd, n.d) AS reach FROM n JOIN kd ON kd.i = n.j), l AS (SELECT i, 1 / (avg(reach) + 1e-10) AS lrd FROM r GROUP BY 1)
SELECT r.i AS s_suppkey, round(avg(b.lrd) / first(a.lrd), 6) AS lof FROM r JOIN l a ON a.i = r.i JOIN l b ON b.i = r.j GROUP BY 1""")
def lof(spark, sf_dir):
    return rounded(O.local_outlier_factor(points(spark, sf_dir), "s_suppkey", "v", 10), "lof")


@query("""WITH m AS (SELECT avg(s_acctbal) AS a, avg(s_nationkey) AS b, var_samp(s_acctbal) AS x, var_samp(s_nationkey) AS z, covar_samp(s_acctbal, s_nationkey) AS y FROM supplier)
SELECT s_suppkey, round((pow(s_acctbal - a, 2) * z - 2 * (s_acctbal - a) * (s_nationkey - b) * y + pow(s_nationkey - b, 2) * x) / (x * z - y * y), 6) AS distance2 FROM supplier, m""")
def mahalanobis(spark, sf_dir):
    return rounded(O.mahalanobis(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]), "distance2")


@query()
def elliptic_envelope(spark, sf_dir):
    return O.mahalanobis(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"], refinements=10)


@query()
def isolation_forest(spark, sf_dir):
    return O.isolation_forest(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


def _each(expression: str, source: str = "lineitem") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, round({expression.format(c=c)}, 6) AS score FROM {source}" for c in COLUMNS)


@query(f"SELECT * FROM ({_each('var_pop({c})')}) WHERE score > 0.001")
def variance_threshold(spark, sf_dir):
    return rounded(S.variance_threshold(lines(spark, sf_dir), COLUMNS, 0.001), "score")


def _anova(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum(n * pow(m - g, 2)) / (count(*) - 1) / (sum(n * v) / (max(t) - count(*)) + 1e-10) AS f
FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) AS g, count(*) AS t FROM lineitem)"""


@query(f"SELECT feature, round(f, 6) AS score, round(1 / (1 + f), 6) AS p FROM ({' UNION ALL '.join(map(_anova, COLUMNS))})")
def anova_f(spark, sf_dir):
    return rounded(S.anova_f(lines(spark, sf_dir), COLUMNS, "l_returnflag"), "score", "p")


_R2 = "SELECT '{c}' AS feature, round(pow(corr({c}, l_linenumber), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_linenumber), 2) + 1e-10), 6) AS score FROM lineitem"


@query(" UNION ALL ".join(_R2.format(c=c) for c in COLUMNS))
def f_regression(spark, sf_dir):
    return rounded(S.f_regression(lines(spark, sf_dir), COLUMNS, "l_linenumber"), "score")


@query(f"""WITH g AS (SELECT l_returnflag, {', '.join(f'sum(greatest({c}, 0)) AS {c}' for c in COLUMNS)} FROM lineitem GROUP BY 1),
h AS (SELECT *, {' + '.join(COLUMNS)} AS cls FROM g), t AS (SELECT {', '.join(f'sum({c}) AS {c}_t' for c in COLUMNS)}, sum(cls) AS tot FROM h)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(sum(pow({c} - cls * {c}_t / tot, 2) / (cls * {c}_t / tot + 1e-10)), 4) AS score FROM h, t" for c in COLUMNS)}""")
def chi2_scores(spark, sf_dir):
    return S.chi2_scores(lines(spark, sf_dir), COLUMNS, "l_returnflag").withColumn("score", F.round("score", 4))


@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem), b AS (SELECT l_returnflag AS y, least(9, floor((l_quantity - lo) / ((hi - lo) / 10))) AS b, n FROM lineitem, e),
j AS (SELECT y, b, count(*) AS c, first(n) AS n FROM b GROUP BY 1, 2), k AS (SELECT *, sum(c) OVER (PARTITION BY b) AS cb, sum(c) OVER (PARTITION BY y) AS cl FROM j)
SELECT 'l_quantity' AS feature, round(greatest(0, sum(c / n * ln(c / n / (cb / n * cl / n) + 1e-10))), 6)::DOUBLE AS score FROM k""")
def mutual_info_hist(spark, sf_dir):
    return rounded(S.mutual_information(lines(spark, sf_dir), "l_quantity", "l_returnflag"), "score")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS feature, round(greatest(0, (v - w) / (v + 1e-10)), 6) AS score FROM (SELECT var_pop({c}) AS v FROM lineitem),
 (SELECT sum(n * v) / sum(n) AS w FROM (SELECT count(*) AS n, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag))""" for c in COLUMNS))
def variance_ratio(spark, sf_dir):
    return rounded(S.variance_ratio(lines(spark, sf_dir), COLUMNS, "l_returnflag"), "score")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS feature, round(0.5 * (r + r * r / 2 + r * r * r / 3), 6) AS score FROM (SELECT least(pow(corr({c}, l_linenumber), 2), 0.999) AS r FROM lineitem)""" for c in COLUMNS))
def mutual_info_regression(spark, sf_dir):
    return rounded(S.mutual_information_regression(lines(spark, sf_dir), COLUMNS, "l_linenumber"), "score")


@query(f"SELECT feature FROM ({_each('var_pop({c})')}) ORDER BY score DESC LIMIT 2")
def kbest(spark, sf_dir):
    return S.k_best(S.variances(lines(spark, sf_dir), COLUMNS), 2).select("feature")


@query("SELECT o_orderkey, (ntile(5) OVER (ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def kfold(spark, sf_dir):
    return S.k_fold(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey, (ntile(5) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def stratified_kfold(spark, sf_dir):
    return S.stratified_k_fold(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "fold")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', 0, o_orderkey)), o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.25) AS is_test FROM orders")
def train_test_split(spark, sf_dir):
    return S.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query()
def shuffle_split(spark, sf_dir):
    return S.shuffle_split(table(spark, sf_dir, "supplier"), "s_suppkey", 3, 0.2)


@query("SELECT a AS alpha, d AS depth FROM (SELECT unnest([0.1, 1.0]::DOUBLE[]) AS a), (SELECT unnest([2, 3, 4])::BIGINT AS d)")
def parameter_grid(spark, sf_dir):
    return S.parameter_grid(spark, {"alpha": [0.1, 1.0], "depth": [2, 3, 4]})
