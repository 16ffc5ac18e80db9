"""Feature preprocessing queries, over customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import features as X
from .registry import query, table


def supplier_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")


def gaps(spark, sf_dir):
    """Customers with every seventh balance missing."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), "c_mktsegment", "c_nationkey")


GAPS = "(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, c_mktsegment, c_nationkey FROM customer)"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def scaled(sql: str) -> str:
    return f"SELECT c_custkey, round({sql}, 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, max(abs(c_acctbal)) AS ma, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)"


def scale(spark, sf_dir, make):
    rows = supplier_customers(spark, sf_dir).select("c_custkey", "c_acctbal")
    return rounded(make(["c_acctbal"]).fit_transform(rows), "c_acctbal")


@query(scaled("(c_acctbal - m) / s"))
def standard_scale(spark, sf_dir):
    return scale(spark, sf_dir, X.StandardScaler)


@query(scaled("(c_acctbal - lo) / (hi - lo)"))
def minmax_scale(spark, sf_dir):
    return scale(spark, sf_dir, X.MinMaxScaler)


@query(scaled("(c_acctbal - lo) / (hi - lo) * 2 - 1"))
def minmax_scale_symmetric(spark, sf_dir):
    return scale(spark, sf_dir, lambda c: X.MinMaxScaler(c, (-1.0, 1.0)))


@query(scaled("(c_acctbal - q[2]) / (q[3] - q[1])"))
def robust_scale(spark, sf_dir):
    return scale(spark, sf_dir, X.RobustScaler)


@query(scaled("c_acctbal / ma"))
def maxabs_scale(spark, sf_dir):
    return scale(spark, sf_dir, X.MaxAbsScaler)


@query(scaled("least(greatest(c_acctbal, q[1] - 0.2 * (q[3] - q[1])), q[3] + 0.2 * (q[3] - q[1]))"))
def clip_outliers(spark, sf_dir):
    return scale(spark, sf_dir, lambda c: X.OutlierHandler(c, threshold=0.2))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / n, 6) AS l_quantity, round(l_extendedprice / n, 6) AS l_extendedprice FROM (SELECT *, sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice) AS n FROM lineitem)")
def normalize_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rounded(X.normalize_rows(rows, ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


@query("""SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::DOUBLE AS c_mktsegment_AUTOMOBILE, (c_mktsegment = 'BUILDING')::DOUBLE AS c_mktsegment_BUILDING, (c_mktsegment = 'FURNITURE')::DOUBLE AS c_mktsegment_FURNITURE,
 (c_mktsegment = 'HOUSEHOLD')::DOUBLE AS c_mktsegment_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::DOUBLE AS c_mktsegment_MACHINERY FROM customer""")
def onehot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return X.one_hot(rows, "c_mktsegment", X.categories(rows, "c_mktsegment")).drop("c_mktsegment")


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")
def ordinal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", X.ordinal(rows, "o_orderpriority", X.categories(rows, "o_orderpriority")).alias("code"))


_GROUPS = "(SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, (SELECT avg(c_acctbal) FROM customer) AS g FROM customer GROUP BY 1)"


@query(f"SELECT c_mktsegment, round((n * mean + 10 * g) / (n + 10), 6) AS encoding FROM {_GROUPS}")
def target_encode_m(spark, sf_dir):
    return rounded(X.target_encoding(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", smoothing=10.0), "encoding")


@query(f"SELECT c_mktsegment, round(mean / (1 + exp(-(n - 5) / 200.0::DOUBLE)) + g * (1 - 1 / (1 + exp(-(n - 5) / 200.0::DOUBLE))), 6) AS encoding FROM {_GROUPS}")
def target_encode_sigmoid(spark, sf_dir):
    return rounded(X.target_encoding(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "sigmoid", 200.0, 5), "encoding")


@query(f"""SELECT c_custkey, round(CASE WHEN c_nationkey < 20 THEN e.encoding ELSE g END, 6) AS encoding FROM customer LEFT JOIN
 (SELECT c_nationkey, (count(*) * avg(c_acctbal) + max(g)) / (count(*) + 1) AS encoding FROM customer, (SELECT avg(c_acctbal) AS g FROM customer WHERE c_nationkey < 20) WHERE c_nationkey < 20 GROUP BY 1) e USING (c_nationkey),
 (SELECT avg(c_acctbal) AS g FROM customer WHERE c_nationkey < 20)""")
def target_encode_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    seen = rows.filter("c_nationkey < 20")
    encoding = X.target_encoding(seen, "c_nationkey", "c_acctbal")
    joined = rows.crossJoin(F.broadcast(seen.agg(F.avg("c_acctbal").alias("overall"))))
    return rounded(X.encode_target(joined, encoding, "c_nationkey", F.col("overall")).select("c_custkey", "encoding"), "encoding")


@query("SELECT c_custkey, least(4, floor((c_acctbal - lo) / ((hi - lo) / 5)))::DOUBLE AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def kbins_uniform(spark, sf_dir):
    return X.KBinsDiscretizer(["c_acctbal"], 5, "uniform").fit_transform(supplier_customers(spark, sf_dir).select("c_custkey", "c_acctbal"))


@query("SELECT c_custkey, greatest(0, least(3, len(list_filter(q, lambda x: x <= c_acctbal)) - 1))::DOUBLE AS c_acctbal FROM customer, (SELECT quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS q FROM customer)")
def kbins_quantile(spark, sf_dir):
    return X.KBinsDiscretizer(["c_acctbal"], 4).fit_transform(supplier_customers(spark, sf_dir).select("c_custkey", "c_acctbal"))


@query("SELECT c_custkey, (c_acctbal > 5000)::DOUBLE AS c_acctbal FROM customer")
def binarize(spark, sf_dir):
    return X.binarize(supplier_customers(spark, sf_dir).select("c_custkey", "c_acctbal"), ["c_acctbal"], 5000)


@query('SELECT p_partkey, 1.0::DOUBLE AS bias, p_size::DOUBLE AS p_size, p_retailprice, p_size::DOUBLE * p_size AS "p_size^2", p_size::DOUBLE * p_retailprice AS "p_size*p_retailprice", p_retailprice * p_retailprice AS "p_retailprice^2" FROM part')
def poly_features(spark, sf_dir):
    return X.polynomial_features(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query('SELECT s_suppkey, s_nationkey, s_acctbal, s_nationkey * s_acctbal AS "s_nationkey*s_acctbal" FROM supplier')
def interaction(spark, sf_dir):
    return X.interaction_features(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey", "s_acctbal"])


def _power_sql(transform: str) -> str:
    return f"""WITH x AS (SELECT p_partkey, p_retailprice / 1000 AS v FROM part), g AS (SELECT k, k / 10.0::DOUBLE - 2 AS lam FROM (SELECT unnest(range(41)) AS k)),
t AS (SELECT k, lam, var_pop({transform}) AS var, avg({transform}) AS m FROM x, g GROUP BY 1, 2),
b AS (SELECT lam, m, sqrt(var) AS s FROM t WHERE var > 0 ORDER BY var, k LIMIT 1)
SELECT p_partkey, round(({transform} - m) / s, 6) AS v FROM x, b"""


@query(_power_sql("CASE WHEN abs(lam) < 1e-12 THEN ln(1 + v) ELSE (pow(v + 1, lam) - 1) / lam END"))
def yeo_johnson(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("v"))
    return rounded(X.PowerTransformer(["v"]).fit_transform(rows), "v")


@query(_power_sql("CASE WHEN abs(lam) < 1e-12 THEN ln(v) ELSE (pow(v, lam) - 1) / lam END"))
def box_cox(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("v"))
    return rounded(X.PowerTransformer(["v"], "box-cox").fit_transform(rows), "v")


@query("""WITH q AS (SELECT quantile_cont(s_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS q FROM supplier), k AS (SELECT s_suppkey, s_acctbal, q, len(list_filter(q, lambda x: x <= s_acctbal)) AS k FROM supplier, q)
SELECT s_suppkey, round(CASE WHEN k >= 5 THEN 1 ELSE (k - 1) * 0.25 + (s_acctbal - q[k]) * 0.25 / (q[k + 1] - q[k]) END, 6)::DOUBLE AS s_acctbal FROM k""")
def quantile_transform(spark, sf_dir):
    return rounded(X.QuantileTransformer(["s_acctbal"], 5).fit_transform(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")), "s_acctbal")


def _polynomial_sql(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _normal_sql(p: str) -> str:
    tail = lambda q: f"({_polynomial_sql(q, E.PPF_C)} / {_polynomial_sql(q, [*E.PPF_D, 1.0])})"
    middle = f"({_polynomial_sql('r', E.PPF_A)} * ({p} - 0.5) / {_polynomial_sql('r', [*E.PPF_B, 1.0])})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail('lo')} WHEN {p} > 1 - 0.02425 THEN -{tail('hi')} ELSE {middle} END"


@query(f"""WITH q AS (SELECT quantile_cont(s_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS q FROM supplier), k AS (SELECT s_suppkey, s_acctbal, q, len(list_filter(q, lambda x: x <= s_acctbal)) AS k FROM supplier, q),
u AS (SELECT s_suppkey, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, CASE WHEN k >= 5 THEN 1 ELSE (k - 1) * 0.25 + (s_acctbal - q[k]) * 0.25 / (q[k + 1] - q[k]) END::DOUBLE)) AS p FROM k),
v AS (SELECT *, pow(p - 0.5, 2) AS r, sqrt(-2 * ln(p)) AS lo, sqrt(-2 * ln(1 - p)) AS hi FROM u) SELECT s_suppkey, round({_normal_sql('p')}, 6) AS s_acctbal FROM v""")
def quantile_transform_normal(spark, sf_dir):
    return rounded(X.QuantileTransformer(["s_acctbal"], 5, "normal").fit_transform(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")), "s_acctbal")


def _imputed(fill: str) -> str:
    return f"SELECT c_custkey, round(coalesce(bal, {fill}), 6) AS bal FROM {GAPS}"


def impute(spark, sf_dir, strategy, value=None):
    return rounded(X.SimpleImputer(["bal"], strategy, value).fit_transform(gaps(spark, sf_dir).select("c_custkey", "bal")), "bal")


@query(_imputed(f"(SELECT avg(bal) FROM {GAPS})"))
def impute_mean(spark, sf_dir):
    return impute(spark, sf_dir, "mean")


@query(_imputed(f"(SELECT median(bal) FROM {GAPS})"))
def impute_median(spark, sf_dir):
    return impute(spark, sf_dir, "median")


@query(_imputed(f"(SELECT bal FROM {GAPS} WHERE bal IS NOT NULL GROUP BY bal ORDER BY count(*) DESC, bal LIMIT 1)"))
def impute_mode(spark, sf_dir):
    return impute(spark, sf_dir, "most_frequent")


@query(_imputed("-1"))
def impute_constant(spark, sf_dir):
    return impute(spark, sf_dir, "constant", -1)


@query(f"SELECT c_custkey, bal, (bal IS NULL)::INT AS bal_missing FROM {GAPS}")
def missing_indicator(spark, sf_dir):
    return X.missing_indicator(gaps(spark, sf_dir).select("c_custkey", "bal"), ["bal"])


_KNN = "(SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS a, s_nationkey::DOUBLE AS b FROM supplier)"


@query(f"""WITH p AS (SELECT i.s_suppkey, j.a, j.s_suppkey AS jk, abs(i.b - j.b) AS d FROM {_KNN} i, {_KNN} j WHERE i.a IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, jk) AS k FROM p), m AS (SELECT s_suppkey, avg(a) AS v FROM r WHERE k <= 5 GROUP BY 1)
SELECT x.s_suppkey, round(coalesce(x.a, m.v, (SELECT avg(a) FROM {_KNN})), 6) AS a, x.b FROM {_KNN} x LEFT JOIN m USING (s_suppkey)""")
def knn_impute(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return rounded(X.knn_impute(rows, "s_suppkey", ["a", "b"]), "a")


@query(f"""WITH f AS (SELECT c_custkey, coalesce(bal, (SELECT avg(bal) FROM {GAPS})) AS v FROM {GAPS})
SELECT c_custkey, round((v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f), 6) AS bal FROM f""")
def preprocessing_pipeline(spark, sf_dir):
    return rounded(X.standard_pipeline(["bal"]).fit_transform(gaps(spark, sf_dir).select("c_custkey", "bal")), "bal")
