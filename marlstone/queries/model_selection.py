"""Cross-validation, search and elimination on order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model_selection as S
from .registry import query, table
from .timeseries import cramer

COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))


_FITTED = """s AS (SELECT (l_orderkey % 3)::INT AS fold, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM s),
r AS (SELECT s.*, t.n - s.n AS m, t.x - s.x AS tx, t.y - s.y AS ty, t.xx - s.xx AS txx, t.xy - s.xy AS txy FROM s, t),
b AS (SELECT r.*, ridge, (m * txy - tx * ty) / (m * (txx + ridge) - tx * tx) AS slope FROM r, g),
e AS (SELECT *, (ty - slope * tx) / m AS icept FROM b),
f AS (SELECT *, (yy - 2 * (icept * y + slope * xy) + icept * icept * n + 2 * icept * slope * x + slope * slope * xx) AS sse FROM e)"""


@query(f"""WITH g AS (SELECT 0.0::DOUBLE AS ridge), {_FITTED}
SELECT fold, n::BIGINT AS n, round(sse / n / 1e6, 4) AS mse_millions, round(1 - sse / (yy - y * y / n), 6) AS r2 FROM f""")
def cross_validation(spark, sf_dir):
    found = S.cross_validate(lines(spark, sf_dir), ["l_quantity"], "l_extendedprice", "fold")
    return found.select("fold", "n", F.round(F.col("mse") / 1e6, 4).alias("mse_millions"), F.round("r2", 6).alias("r2"))


@query(f"""WITH g AS (SELECT unnest([0.0, 1e5, 1e8]::DOUBLE[]) AS ridge), {_FITTED}
SELECT ridge, round(avg(sse / n) / 1e6, 4) AS mse_millions FROM f GROUP BY 1""")
def ridge_grid_search(spark, sf_dir):
    found = S.grid_search(lines(spark, sf_dir), ["l_quantity"], "l_extendedprice", "fold", [0.0, 1e5, 1e8])
    return found.groupBy("ridge").agg(F.round(F.avg("mse") / 1e6, 4).alias("mse_millions"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS fold FROM supplier")
def leave_one_out(spark, sf_dir):
    return S.leave_one_out(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])


_MOMENTS = "m AS (SELECT " + ", ".join([f"covar_pop({x}, {y}) AS x{i}{j}" for i, x in enumerate(COLUMNS, 1) for j, y in enumerate(COLUMNS, 1) if i <= j] + [f"covar_pop({x}, l_extendedprice) AS y{i}" for i, x in enumerate(COLUMNS, 1)]) + " FROM lineitem)"
_ALL = "a AS (" + " UNION ALL ".join(f"SELECT {k} AS k, abs({b}) * sqrt(x{k}{k}) AS v FROM m" for k, b in enumerate(cramer({ij: f"x{ij}" for ij in ("11", "12", "13", "22", "23", "33")}, ("y1", "y2", "y3")), 1)) + ")"
_PAIRS = "p AS (" + " UNION ALL ".join(f"SELECT {6 - i - j} AS without, {i} AS k, abs((y{i} * x{j}{j} - y{j} * x{min(i, j)}{max(i, j)}) / (x{i}{i} * x{j}{j} - pow(x{min(i, j)}{max(i, j)}, 2))) * sqrt(x{i}{i}) AS v FROM m" for i in (1, 2, 3) for j in (1, 2, 3) if i != j) + ")"
_NAMED = f"(SELECT unnest({COLUMNS}) AS feature, unnest([1, 2, 3]) AS k)"


@query(f"""WITH {_MOMENTS}, {_ALL}, {_PAIRS}, w AS (SELECT arg_min(k, v) AS k FROM a), s AS (SELECT arg_min(p.k, v) AS k FROM p, w WHERE without = w.k)
SELECT feature, (CASE WHEN n.k = w.k THEN 3 WHEN n.k = s.k THEN 2 ELSE 1 END)::INT AS rank FROM {_NAMED} n, w, s""")
def linear_feature_elimination(spark, sf_dir):
    return S.recursive_elimination(lines(spark, sf_dir), COLUMNS, "l_extendedprice", 1)


@query(f"WITH {_MOMENTS}, {_ALL} SELECT feature, round(v, 4) AS importance FROM a JOIN {_NAMED} n ON a.k = n.k WHERE v >= (SELECT avg(v) FROM a)")
def select_from_linear_model(spark, sf_dir):
    return S.select_from_model(lines(spark, sf_dir), COLUMNS, "l_extendedprice").withColumn("importance", F.round("importance", 4))


@query("SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS p_retailprice, p_size * 2 AS p_size FROM part")
def function_transform(spark, sf_dir):
    out = S.function_transform(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), {"p_retailprice": F.log1p, "p_size": lambda c: c * 2})
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS uploads, greatest(0, 20 - count(*) FILTER (WHERE event_type = 'view')) AS uploads_left, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 4) AS volume FROM events GROUP BY 1")
def upload_quota(spark, sf_dir):
    """Uploads of each user against a quota of 20."""
    is_upload = F.col("event_type") == "view"
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(is_upload).alias("uploads"), F.round(F.sum(F.when(is_upload, F.col("value")).otherwise(0.0)), 4).alias("volume"))
    return used.withColumn("uploads_left", F.greatest(F.lit(0), 20 - F.col("uploads")))
