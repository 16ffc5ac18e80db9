"""Bagging, stacking, boosting, calibration and many-target models on order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensembles as E
from ..operators import features as X
from ..operators import privacy as P
from .privacy import SEED, laplace_sql
from .registry import query, table


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def lines(spark, sf_dir):
    """Order lines with a fold, the square of the quantity and a label of dear lines."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", (F.col("l_orderkey") % 3).cast("int").alias("fold"), (F.col("l_quantity") * F.col("l_quantity")).alias("square"), (F.col("l_extendedprice") > 40000).cast("int").alias("dear"))


LINES = "(SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice, (l_orderkey % 3)::INT AS fold, l_quantity * l_quantity AS square, (l_extendedprice > 40000)::INT AS dear FROM lineitem)"


def _uniform(bag):
    """A number in [0, 1) from MD5, which SQL has too."""
    digest = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", F.lit(bag)).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(1 << 28)


_DRAWN = " + ".join(f"(u > exp(-1) * ({' + '.join(f'1.0::DOUBLE / factorial({i})' for i in range(k + 1))}))::INT" for k in range(12))


@query(f"""WITH u AS (SELECT bag, l_quantity AS x, l_extendedprice AS y, ('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || bag), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM {LINES}, (SELECT unnest([0, 1, 2])::INT AS bag)),
w AS (SELECT bag, x, y, ({_DRAWN})::DOUBLE AS w FROM u),
s AS (SELECT bag, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM w GROUP BY 1),
b AS (SELECT *, (n * xy - x * y) / (n * xx - x * x) AS slope FROM s)
SELECT bag, round((y - slope * x) / n, 4) AS intercept, round(slope, 4) AS slope FROM b""")
def bagging_regressor(spark, sf_dir):
    found = E.bagged_linear(lines(spark, sf_dir), "l_orderkey", ["l_quantity"], "l_extendedprice", 3, uniform=_uniform)
    return found.select("bag", F.round("intercept", 4).alias("intercept"), F.round("l_quantity", 4).alias("slope"))


@query(f"""WITH r AS (SELECT fold, l_quantity AS x, square AS z, l_extendedprice AS y FROM {LINES}),
b AS (SELECT k.fold, regr_slope(y, x) AS bx, regr_intercept(y, x) AS ax, regr_slope(y, z) AS bz, regr_intercept(y, z) AS az FROM r, (SELECT unnest([0, 1, 2])::INT AS fold) k WHERE r.fold <> k.fold GROUP BY 1),
o AS (SELECT y, ax + bx * x AS p, az + bz * z AS q FROM r JOIN b ON r.fold = b.fold),
c AS (SELECT avg(y) AS my, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy FROM o),
w AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS wp, (qy * pp - py * pq) / (pp * qq - pq * pq) AS wq FROM c)
SELECT round(wp, 4) AS on_quantity, round(wq, 4) AS on_square, round((my - wp * mp - wq * mq) / 100, 2) AS intercept_hundreds FROM w""")
def stacking_regressor(spark, sf_dir):
    w, _ = E.stacked_linear(lines(spark, sf_dir), {"a": ["l_quantity"], "b": ["square"]}, "l_extendedprice", "fold")
    return spark.createDataFrame([(round(w["a"], 4), round(w["b"], 4), round(w["intercept"] / 100, 2))], "on_quantity double, on_square double, intercept_hundreds double")


CUTS = {"l_quantity": [10.0, 20.0, 25.0, 30.0, 40.0], "l_discount": [0.025, 0.055]}


def _boosted_sql(rounds: int) -> str:
    """Each round: errors of all stumps under the weights, the best one, and the next weights."""
    cuts = ", ".join(f"('{c}', {t}::DOUBLE)" for c, at in CUTS.items() for t in at)
    parts = [f"t(feature, threshold) AS (VALUES {cuts})", f"w1 AS (SELECT l_quantity, l_discount, dear, 1.0::DOUBLE AS w FROM {LINES})"]
    says = "CASE WHEN feature = 'l_quantity' THEN l_quantity ELSE l_discount END > threshold"
    for k in range(1, rounds + 1):
        parts.append(f"e{k} AS (SELECT feature, threshold, sum(CASE WHEN ({says})::INT <> dear THEN w ELSE 0 END) / sum(w) AS e FROM w{k}, t GROUP BY 1, 2)")
        parts.append(f"b{k} AS (SELECT feature, threshold, CASE WHEN e <= 0.5 THEN 1 ELSE -1 END AS polarity, least(e, 1 - e) AS error FROM e{k} ORDER BY error, feature, threshold LIMIT 1)")
        parts.append(f"w{k + 1} AS (SELECT l_quantity, l_discount, dear, w * exp(0.5 * ln((1 - error) / error) * CASE WHEN (({says}) = (polarity > 0))::INT <> dear THEN 1 ELSE -1 END) AS w FROM w{k}, b{k})")
    rows = " UNION ALL ".join(f"SELECT {k}::INT AS round, feature, threshold, polarity::INT AS polarity, round(0.5 * ln((1 - error) / error), 6) AS alpha FROM b{k}" for k in range(1, rounds + 1))
    return f"WITH {', '.join(parts)} {rows}"


@query(_boosted_sql(3))
def adaboost_classifier(spark, sf_dir):
    found = E.adaboost(lines(spark, sf_dir), list(CUTS), "dear", 3, cuts=CUTS)
    return spark.createDataFrame([(k, s["feature"], s["threshold"], s["polarity"], round(s["alpha"], 6)) for k, s in enumerate(found, 1)], "round int, feature string, threshold double, polarity int, alpha double")


def _newton_sql(steps: int) -> str:
    parts = [f"r AS (SELECT l_quantity / 50 AS x, dear AS y FROM {LINES})", "n AS (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS m FROM r)", "d AS (SELECT x, CASE WHEN y = 1 THEN (p + 1.0::DOUBLE) / (p + 2) ELSE 1.0::DOUBLE / (m + 2) END AS t FROM r, n)", "a0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(f"q{k} AS (SELECT x, t, a, b, 1 / (1 + exp(-(a * x + b))) AS p FROM d, a{k})")
        parts.append(f"g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((p - t) * x) AS gx, sum(p - t) AS g, sum(p * (1 - p) * x * x) AS xx, sum(p * (1 - p) * x) AS x, sum(p * (1 - p)) AS w FROM q{k})")
        parts.append(f"a{k + 1} AS (SELECT a - (gx * w - g * x) / (xx * w - x * x) AS a, b - (g * xx - gx * x) / (xx * w - x * x) AS b FROM g{k})")
    return f"WITH {', '.join(parts)} SELECT round(a, 4) AS a, round(b, 4) AS b FROM a{steps}"


@query(_newton_sql(4))
def sigmoid_calibration(spark, sf_dir):
    a, b = E.sigmoid_calibration(lines(spark, sf_dir).select((F.col("l_quantity") / 50).alias("x"), "dear"), "x", "dear", 4)
    return spark.createDataFrame([(round(a, 4), round(b, 4))], "a double, b double")


def _temperature_sql(steps: int) -> str:
    parts = [f"r AS (SELECT 1.5 - l_quantity / 25 AS z0, l_quantity / 25 - 1.5 AS z1, dear FROM {LINES})", "t0 AS (SELECT 1.0::DOUBLE AS t)"]
    for k in range(steps):
        parts.append(f"t{k + 1} AS (SELECT greatest(0.01, any_value(t) - 0.5 * avg(CASE WHEN dear = 1 THEN z1 ELSE z0 END - (z0 * exp(z0 / t) + z1 * exp(z1 / t)) / (exp(z0 / t) + exp(z1 / t))) / any_value(t * t)) AS t FROM r, t{k})")
    return f"WITH {', '.join(parts)} SELECT round(t, 6) AS temperature FROM t{steps}"


@query(_temperature_sql(4))
def temperature_scaling(spark, sf_dir):
    rows = lines(spark, sf_dir).select((1.5 - F.col("l_quantity") / 25).alias("z0"), (F.col("l_quantity") / 25 - 1.5).alias("z1"), "dear")
    return spark.createDataFrame([(round(E.temperature(rows, ["z0", "z1"], "dear", 4, 0.5), 6),)], "temperature double")


@query(f"""SELECT 'l_extendedprice' AS target, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM {LINES}
UNION ALL SELECT 'dear', round(regr_slope(dear, l_quantity), 4), round(regr_intercept(dear, l_quantity), 4) FROM {LINES}""")
def multi_output_regressor(spark, sf_dir):
    found = E.multi_output_linear(lines(spark, sf_dir), ["l_quantity"], ["l_extendedprice", "dear"])
    return spark.createDataFrame([(t, round(b["l_quantity"], 4), round(b["intercept"], 4)) for t, b in found.items()], "target string, slope double, intercept double")


@query(f"""WITH c AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS mp, avg(dear) AS md, var_pop(l_quantity) AS xx, var_pop(l_extendedprice) AS pp, covar_pop(l_quantity, l_extendedprice) AS xp, covar_pop(l_quantity, dear) AS xd, covar_pop(l_extendedprice, dear) AS pd FROM {LINES}),
b AS (SELECT *, xp / xx AS slope, (xd * pp - pd * xp) / (xx * pp - xp * xp) AS wx, (pd * xx - xd * xp) / (xx * pp - xp * xp) AS wp FROM c)
SELECT l_orderkey, l_linenumber, round(mp + slope * (l_quantity - mx), 3) AS price, round(md + wx * (l_quantity - mx) + wp * slope * (l_quantity - mx), 5) AS dear FROM {LINES}, b""")
def regressor_chain(spark, sf_dir):
    rows = lines(spark, sf_dir)
    out = E.chain_predictions(rows, E.regressor_chain(rows, ["l_quantity"], ["l_extendedprice", "dear"]))
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_pred", 3).alias("price"), F.round("dear_pred", 5).alias("dear"))


@query(f"""WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(2 * dear - 1) AS y, sum(square) + 10 AS xx, sum(l_quantity * (2 * dear - 1)) AS xy FROM {LINES}),
b AS (SELECT (n * xy - x * y) / (n * xx - x * x) AS slope, x / n AS mx, y / n AS my FROM s)
SELECT l_orderkey, l_linenumber, (my + slope * (l_quantity - mx) > 0)::INT AS predicted FROM {LINES}, b""")
def ridge_classifier(spark, sf_dir):
    from ..operators.models import predict_linear

    rows = lines(spark, sf_dir)
    b = E.ridge_classifier(rows, ["l_quantity"], "dear", 10.0)
    return rows.select("l_orderkey", "l_linenumber", (predict_linear(b) > 0).cast("int").alias("predicted"))


@query(f"""WITH b AS (SELECT regr_slope(ln(l_extendedprice), l_quantity) AS slope, regr_intercept(ln(l_extendedprice), l_quantity) AS icept FROM {LINES})
SELECT l_orderkey, l_linenumber, round(exp(icept + slope * l_quantity), 3) AS predicted FROM {LINES}, b""")
def transformed_target_regressor(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", F.round(E.transformed_target(rows, ["l_quantity"], "l_extendedprice", F.log, F.exp), 3).alias("predicted"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def incremental_linear(spark, sf_dir):
    """Three batches, one after the other."""
    model, rows = E.IncrementalLinear(["l_quantity"], "l_extendedprice"), lines(spark, sf_dir)
    for k in range(3):
        model.partial_fit(rows.filter(F.col("fold") == k))
    b = model.coefficients()
    return spark.createDataFrame([(round(b["intercept"], 4), round(b["l_quantity"], 4))], "intercept double, slope double")


_LOSSES = {
    "squared": ("0.5 * (y - p) * (y - p)", "y - p"),
    "absolute": ("abs(y - p)", "sign(y - p)"),
    "huber": ("CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) * (y - p) ELSE abs(y - p) - 0.5 END", "CASE WHEN abs(y - p) <= 1 THEN y - p ELSE sign(y - p) END"),
    "log": ("ln(1 + exp(p)) - y * p", "y - 1 / (1 + exp(-p))"),
    "exponential": ("exp(-(2 * y - 1) * p)", "(2 * y - 1) * exp(-(2 * y - 1) * p)"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS loss, round(avg({a}), 6) AS value, round(avg({g}), 6) AS gradient FROM (SELECT dear AS y, l_quantity / 10 - 3 AS p FROM {LINES})" for k, (a, g) in _LOSSES.items()))
def boosting_losses(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("dear").cast("double").alias("y"), (F.col("l_quantity") / 10 - 3).alias("p"))
    made = {k: E.loss(k, 2 * F.col("y") - 1 if k == "exponential" else F.col("y"), F.col("p")) for k in _LOSSES}
    row = rows.agg(*[F.struct(F.lit(k).alias("loss"), F.round(F.avg(a), 6).alias("value"), F.round(F.avg(g), 6).alias("gradient")).alias(k) for k, (a, g) in made.items()])
    return row.select(F.explode(F.array(*made)).alias("s")).select("s.*")


_GAPPY = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * 0.5 + c_nationkey * 10.0 END AS b FROM customer)"


@query(f"""WITH r AS {_GAPPY}, m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM r),
f AS (SELECT c_custkey, a, b, coalesce(b, mb) AS fb FROM r, m), ka AS (SELECT regr_slope(a, fb) AS s, regr_intercept(a, fb) AS i FROM f),
g AS (SELECT c_custkey, b, coalesce(a, i + s * fb) AS a FROM f, ka), kb AS (SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS i FROM g)
SELECT c_custkey, round(a, 4) AS a, round(coalesce(b, i + s * a), 4) AS b FROM g, kb""")
def iterative_impute(spark, sf_dir):
    """One round over two columns with gaps."""
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 7 != 0, bal).alias("a"), F.when(key % 5 != 0, bal * 0.5 + F.col("c_nationkey") * 10.0).alias("b"))
    out = X.iterative_impute(rows, ["a", "b"], 1)
    return out.withColumns({c: F.round(c, 4) for c in "ab"})


@query("""SELECT c_custkey, round((c_acctbal - m) / s, 6) AS std__c_acctbal, round((c_nationkey - lo) / (hi - lo), 6) AS unit__c_nationkey
FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_nationkey)::DOUBLE AS lo, max(c_nationkey)::DOUBLE AS hi FROM customer)""")
def column_transformer(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = X.column_transform(rows, [("std", X.StandardScaler, ["c_acctbal"]), ("unit", X.MinMaxScaler, ["c_nationkey"])], "passthrough")
    return rounded(out, "std__c_acctbal", "unit__c_nationkey")


@query("""SELECT c_custkey, round(2 * (c_acctbal - m) / s, 6) AS std__c_acctbal, round((c_acctbal - lo) / (hi - lo), 6) AS unit__c_acctbal
FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def feature_union(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = X.feature_union(rows, ["c_acctbal"], {"std": X.StandardScaler, "unit": X.MinMaxScaler}, {"std": 2.0})
    return rounded(out, "std__c_acctbal", "unit__c_acctbal")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS a, (l_returnflag = 'N')::INT AS n, (l_returnflag = 'R')::INT AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round((a - ma) / sa, 6) AS "l_returnflag_A", round((n - mn) / sn, 6) AS "l_returnflag_N", round((r - mr) / sr, 6) AS "l_returnflag_R"
FROM f, (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(n) AS mn, stddev_pop(n) AS sn, avg(r) AS mr, stddev_pop(r) AS sr FROM f)""")
def categorical_pipeline(spark, sf_dir):
    out = X.categorical_pipeline(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_returnflag"])
    return rounded(out, *[c for c in out.columns if c.startswith("l_returnflag_")])


def _private_sql(steps: int) -> str:
    """Logistic steps on gradients clipped to 0.5."""
    parts = [f"r AS (SELECT l_quantity / 50 AS x, dear AS y FROM {LINES})", "s0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(f"e{k} AS (SELECT a, b, x, 1 / (1 + exp(-(a + b * x))) - y AS e FROM r, s{k})")
        parts.append(f"c{k} AS (SELECT a, b, x, e * least(1.0::DOUBLE, coalesce(0.5 / nullif(abs(e) * sqrt(1 + x * x), 0), 1.0)) AS e FROM e{k})")
        parts.append(f"s{k + 1} AS (SELECT any_value(a) - 0.5 * avg(e) AS a, any_value(b) - 0.5 * avg(e * x) AS b FROM c{k})")
    return f"WITH {', '.join(parts)} SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM s{steps}"


@query(_private_sql(3))
def dp_training_clipped(spark, sf_dir):
    """Without noise, so that SQL can compare."""
    rows = lines(spark, sf_dir).select((F.col("l_quantity") / 50).alias("x"), "dear")
    w = P.private_training(rows, ["x"], "dear", 3, 0.5, 1.0, 0.5, noise=False)
    return spark.createDataFrame([(round(w[0], 6), round(w[1], 6))], "intercept double, slope double")


@query(f"""SELECT s_suppkey, round(s_acctbal * least(1.0::DOUBLE, coalesce(5000.0::DOUBLE / nullif(abs(s_acctbal), 0), 1.0)) + {laplace_sql("'rows|s_acctbal|' || s_suppkey", '10000.0::DOUBLE')}, 4) AS s_acctbal, round(s_nationkey + {laplace_sql("'labels|y|' || s_suppkey", '2.0::DOUBLE')}, 6) AS y FROM supplier""")
def dp_noisy_dataset(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("y"))
    out = P.private_dataset(rows, "s_suppkey", ["s_acctbal"], "y", 5000.0, 1.0, seed=SEED)
    return out.withColumns({"s_acctbal": F.round("s_acctbal", 4), "y": F.round("y", 6)})
