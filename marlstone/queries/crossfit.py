"""Estimators in folds, bags, stacks and chains, on customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossfit as C
from ..operators.model_selection import parameter_samples
from .registry import query, table

FOLDS = 3


def customers(spark, sf_dir):
    """Balance in thousands, nation in tenths, two labels from the segment, and a fold."""
    df = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    return df.select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_nationkey") / 10).alias("b"), segment.isin("BUILDING", "MACHINERY").cast("double").alias("y"), segment.isin("BUILDING", "AUTOMOBILE").cast("double").alias("z"), (F.col("c_custkey") % FOLDS).cast("int").alias("fold"))


_CUSTOMERS = f"p AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 10 AS b, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::DOUBLE AS y, (c_mktsegment IN ('BUILDING', 'AUTOMOBILE'))::DOUBLE AS z, (c_custkey % {FOLDS})::INT AS fold FROM customer)"
_OUT = f"k AS (SELECT unnest(range({FOLDS}))::INT AS k), t AS (SELECT k, p.* FROM p, k WHERE fold <> k)"


def _bayes(n: str, label: str, columns: str = "ab", weight: str = "1.0::DOUBLE") -> str:
    """Counts, means and variances of both classes, as aggregates named with n0, ma0, va0 and so on."""
    parts = []
    for c in (0, 1):
        w = f"CASE WHEN {label} = {c} THEN {weight} ELSE 0 END"
        parts.append(f"sum({w}) AS {n}{c}")
        for x in columns:
            parts += [f"sum({w} * {x}) / sum({w}) AS m{x}{c}", f"sum({w} * {x} * {x}) / sum({w}) - pow(sum({w} * {x}) / sum({w}), 2) + 1e-9 AS v{x}{c}"]
    return ", ".join(parts)


def _probability(n: str, columns: str = "ab") -> str:
    fit = [f"ln({n}{c}) - 0.5 * ({' + '.join(f'ln(v{x}{c}) + pow({x} - m{x}{c}, 2) / v{x}{c}' for x in columns)})" for c in (0, 1)]
    return f"1 / (1 + exp(({fit[0]}) - ({fit[1]})))"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {_CUSTOMERS}, {_OUT}, m AS (SELECT k, {_bayes('n', 'y')} FROM t GROUP BY 1), o AS (SELECT fold, y, {_probability('n')} AS q FROM p JOIN m ON fold = k)
SELECT fold, count(*) AS n, round(avg(((q > 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS loss FROM o GROUP BY 1""")
def bayes_cross_validation(spark, sf_dir):
    found = C.cross_validate(customers(spark, sf_dir), C.Bayes(), ["a", "b"], "y", "fold", FOLDS, {"accuracy": C.accuracy, "loss": C.log_loss})
    return _rounded(found, "accuracy", "loss")


_RIDGES = [0.0, 10.0, 1000.0, 100000.0]


@query(f"""WITH {_CUSTOMERS}, {_OUT}, r AS (SELECT unnest({_RIDGES}::DOUBLE[]) AS ridge),
m AS (SELECT k, ridge, regr_sxy(y, a) / (regr_sxx(y, a) + ridge) AS slope, avg(a) AS ma, avg(y) AS my FROM t, r GROUP BY k, ridge),
o AS (SELECT ridge, fold, avg(pow(y - my - slope * (a - ma), 2)) AS mse, avg(abs(y - my - slope * (a - ma))) AS absolute FROM p JOIN m ON fold = k GROUP BY 1, 2)
SELECT ridge::VARCHAR AS candidate, fold, round(mse, 7) AS mse, round(absolute, 6) AS absolute FROM o""")
def randomized_search(spark, sf_dir):
    """Four draws from four penalties (so all of them, in a drawn order), by a given score and one of the caller's own."""
    drawn = parameter_samples(spark, {"ridge": _RIDGES}, 4, 1)
    found = C.search(customers(spark, sf_dir), {str(d["ridge"]): C.Linear(**d) for d in drawn}, ["a"], "y", "fold", FOLDS, {"mse": C.mean_squared_error, "absolute": lambda y, p: F.avg(F.abs(y - p))})
    return _rounded(_rounded(found, "mse", digits=7), "absolute").drop("n")


def _uniform(bag):
    """A number in [0, 1) from MD5, which SQL has too."""
    digest = F.md5(F.concat_ws("|", "c_custkey", F.lit(bag)).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(1 << 28)


_DRAWN = " + ".join(f"(u > exp(-1) * ({' + '.join(f'1.0::DOUBLE / factorial({i})' for i in range(k + 1))}))::INT" for k in range(12))


@query(f"""WITH {_CUSTOMERS}, u AS (SELECT bag, p.*, ('0x' || substr(md5(c_custkey || '|' || bag), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM p, (SELECT unnest([0, 1, 2])::INT AS bag)),
w AS (SELECT *, ({_DRAWN})::DOUBLE AS w FROM u), m AS (SELECT bag, {_bayes('n', 'y', weight='w')} FROM w GROUP BY 1)
SELECT c_custkey, round(avg({_probability('n')}), 6) AS probability FROM p, m GROUP BY 1""")
def bagging_classifier(spark, sf_dir):
    df = customers(spark, sf_dir)
    model = C.bagging(df, "c_custkey", C.Bayes(), ["a", "b"], "y", 3, uniform=_uniform)
    return _rounded(model.predict(df, "probability"), "probability").select("c_custkey", "probability")


@query(f"""WITH {_CUSTOMERS}, {_OUT}, m AS (SELECT k, {_bayes('n', 'y', 'a')}, regr_slope(y, b) AS slope, regr_intercept(y, b) AS icept FROM t GROUP BY 1),
o AS (SELECT y, {_probability('n', 'a')} AS f, icept + slope * b AS g FROM p JOIN m ON fold = k),
c AS (SELECT avg(y) AS my, avg(f) AS mf, avg(g) AS mg, var_pop(f) AS ff, var_pop(g) AS gg, covar_pop(f, g) AS fg, covar_pop(f, y) AS fy, covar_pop(g, y) AS gy FROM o),
w AS (SELECT *, (fy * gg - gy * fg) / (ff * gg - fg * fg) AS wf, (gy * ff - fy * fg) / (ff * gg - fg * fg) AS wg FROM c),
h AS (SELECT {_bayes('n', 'y', 'a')}, regr_slope(y, b) AS slope, regr_intercept(y, b) AS icept FROM p)
SELECT c_custkey, round(my + wf * ({_probability('n', 'a')} - mf) + wg * (icept + slope * b - mg), 5) AS predicted FROM p, h, w""")
def stacking_classifier(spark, sf_dir):
    df = customers(spark, sf_dir)
    model = C.stacking(df, {"bayes": (C.Bayes(), ["a"]), "line": (C.Linear(), ["b"])}, C.Linear(), "y", "fold", FOLDS)
    return _rounded(model.predict(df), "predicted", digits=5).select("c_custkey", "predicted")


@query(f"""WITH {_CUSTOMERS}, m AS (SELECT {_bayes('n', 'y')} FROM p), d AS (SELECT c_custkey, a, b, {_probability('n')} AS q FROM p, m),
e AS (SELECT {_bayes('n', 'z', 'aby')} FROM p)
SELECT c_custkey, round(q, 6) AS y_predicted, round({_probability('n', 'aby')}, 6) AS z_predicted FROM (SELECT c_custkey, a, b, q, (q > 0.5)::INT::DOUBLE AS y FROM d), e""")
def classifier_chain(spark, sf_dir):
    df = customers(spark, sf_dir)
    out = C.chain(df, C.Bayes(), ["a", "b"], ["y", "z"]).predict(df)
    return _rounded(out, "y_predicted", "z_predicted").select("c_custkey", "y_predicted", "z_predicted")


@query(f"""WITH {_CUSTOMERS}, m AS (SELECT {_bayes('n', 'y')} FROM p), e AS (SELECT {_bayes('n', 'z')} FROM p)
SELECT f.c_custkey, y_predicted, z_predicted FROM (SELECT c_custkey, round({_probability('n')}, 6) AS y_predicted FROM p, m) f JOIN (SELECT c_custkey, round({_probability('n')}, 6) AS z_predicted FROM p, e) g ON f.c_custkey = g.c_custkey""")
def multi_output_classifier(spark, sf_dir):
    df = customers(spark, sf_dir)
    out = C.multi_output(df, C.Bayes(), ["a", "b"], ["y", "z"]).predict(df)
    return _rounded(out, "y_predicted", "z_predicted").select("c_custkey", "y_predicted", "z_predicted")


@query()
def calibrated_classifier(spark, sf_dir):
    df = customers(spark, sf_dir)
    return C.calibrated(df, C.Bayes(), ["a", "b"], "y", "fold", FOLDS).predict(df, "probability").select("c_custkey", "probability")


@query()
def cross_validated_elimination(spark, sf_dir):
    """rank of each column, with the number of columns chosen by the squared error out of fold."""
    lines = table(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_orderkey") % FOLDS).cast("int"))
    return C.eliminate(lines, C.Linear(), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "fold", FOLDS, C.mean_squared_error, greater=False)[1]


def _tree(seed):
    return C.SoftTree(depth=2, rounds=10, seed=seed)


@query()
def soft_tree(spark, sf_dir):
    df = customers(spark, sf_dir)
    return C.fit(df, {"tree": C.Member(_tree(0), ["a", "b"], "y")})["tree"].predict(df).select("c_custkey", "predicted")


@query()
def soft_forest(spark, sf_dir):
    df = customers(spark, sf_dir)
    return C.bagging(df, "c_custkey", _tree, ["a", "b"], "y", 5).predict(df).select("c_custkey", "predicted")
