"""Time-series queries over daily event values of each type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasting as P
from ..operators import timeseries as T
from .registry import query, table


def daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).alias("t")).agg(F.sum("value").alias("y"))


DAILY = "s AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, sum(value) AS y FROM events GROUP BY 1, 2)"


def cramer(a: dict[str, str], y: tuple[str, str, str]) -> list[str]:
    """SQL of the solution of three symmetric equations; a names the entries 11, 12, 13, 22, 23, 33."""
    m = [[a[f"{min(i, j)}{max(i, j)}"] for j in (1, 2, 3)] for i in (1, 2, 3)]
    put = lambda k: [[y[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    det = lambda b: "(" + " + ".join(f"({b[0][i]}) * (({b[1][j]}) * ({b[2][k]}) - ({b[1][k]}) * ({b[2][j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))) + ")"
    return [f"{det(put(k))} / {det(m)}" for k in range(3)]


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {DAILY} SELECT event_type, t, CASE WHEN row_number() OVER w >= 5 THEN round(avg(y) OVER (w ROWS 4 PRECEDING), 6) END AS moving_average FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t)")
def moving_average(spark, sf_dir):
    return rounded(T.moving_average(daily(spark, sf_dir), ["event_type"], "t", "y"), "moving_average").drop("y")


@query(f"WITH {DAILY}, d AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type ORDER BY t) AS d FROM s) SELECT event_type, t, round(d - lag(d) OVER (PARTITION BY event_type ORDER BY t), 6) AS difference FROM d")
def differencing(spark, sf_dir):
    return rounded(T.difference(daily(spark, sf_dir), ["event_type"], "t", "y", times=2), "difference").drop("y")


@query(f"WITH {DAILY} SELECT event_type, t, round(y - lag(y, 7) OVER (PARTITION BY event_type ORDER BY t), 6) AS difference FROM s")
def seasonal_difference(spark, sf_dir):
    return rounded(T.difference(daily(spark, sf_dir), ["event_type"], "t", "y", 7), "difference").drop("y")


@query(f"""WITH {DAILY}, l AS (SELECT event_type, y, lag(y) OVER (PARTITION BY event_type ORDER BY t) AS x FROM s), f AS (SELECT * FROM l WHERE x IS NOT NULL)
SELECT event_type, round(sum(x * y) / (sum(x * x) + 1e-6), 6) AS coefficient, round(avg(y) - sum(x * y) / (sum(x * x) + 1e-6) * avg(x), 4) AS intercept FROM f GROUP BY 1""")
def ar1_fit(spark, sf_dir):
    out = T.autoregression(daily(spark, sf_dir), ["event_type"], "t", "y")
    return out.select("event_type", F.round(F.col("coefficients")[0], 6).alias("coefficient"), F.round("intercept", 4).alias("intercept"))


_AR3 = cramer({"11": "x11", "12": "x12", "13": "x13", "22": "x22", "23": "x23", "33": "x33"}, ("y1", "y2", "y3"))


@query(f"""WITH {DAILY}, l AS (SELECT event_type, y, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b, lag(y, 3) OVER w AS c FROM s WINDOW w AS (PARTITION BY event_type ORDER BY t)),
m AS (SELECT event_type, sum(a * a) + 1e-6 AS x11, sum(a * b) AS x12, sum(a * c) AS x13, sum(b * b) + 1e-6 AS x22, sum(b * c) AS x23, sum(c * c) + 1e-6 AS x33, sum(a * y) AS y1, sum(b * y) AS y2, sum(c * y) AS y3, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM l WHERE c IS NOT NULL GROUP BY 1),
f AS (SELECT *, {', '.join(f'{x} AS c{k}' for k, x in enumerate(_AR3, 1))} FROM m)
SELECT event_type, round(c1, 6) AS lag1, round(c2, 6) AS lag2, round(c3, 6) AS lag3, round(my - c1 * ma - c2 * mb - c3 * mc, 4) AS intercept FROM f""")
def ar3_fit(spark, sf_dir):
    out = T.autoregression(daily(spark, sf_dir), ["event_type"], "t", "y", 3)
    return out.select("event_type", *[F.round(F.col("coefficients")[k], 6).alias(f"lag{k + 1}") for k in range(3)], F.round("intercept", 4).alias("intercept"))


@query(f"""WITH RECURSIVE {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM s),
r AS (SELECT event_type, k, c, y AS level FROM n WHERE k = 1 UNION ALL SELECT n.event_type, n.k, n.c, 0.3 * n.y + 0.7 * r.level FROM r JOIN n ON n.event_type = r.event_type AND n.k = r.k + 1 WHERE n.k < n.c)
SELECT event_type, round(arg_max(level, k), 6) AS level FROM r GROUP BY 1""")
def exp_smoothing(spark, sf_dir):
    return T.series(daily(spark, sf_dir), ["event_type"], "t", "y").select("event_type", F.round(T.simple_smoothing(F.col("ys"), 0.3), 6).alias("level"))


@query(f"""WITH RECURSIVE {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS k, count(*) OVER (PARTITION BY event_type) AS c, lead(y) OVER (PARTITION BY event_type ORDER BY t) - y AS rise FROM s),
r AS (SELECT event_type, k, y AS level, rise AS trend FROM n WHERE k = 1 UNION ALL SELECT event_type, k, fresh, 0.1 * (fresh - level) + 0.9 * trend FROM (SELECT n.event_type, n.k, r.level, r.trend, 0.3 * n.y + 0.7 * (r.level + r.trend) AS fresh FROM r JOIN n ON n.event_type = r.event_type AND n.k = r.k + 1 WHERE n.k < n.c)),
e AS (SELECT event_type, arg_max(level, k) AS level, arg_max(trend, k) AS trend FROM r GROUP BY 1)
SELECT event_type, h, round(level + h * trend, 4) AS forecast FROM e, (SELECT unnest([1, 2, 3, 4, 5, 6, 7])::INT AS h)""")
def holt_forecast(spark, sf_dir):
    found = T.series(daily(spark, sf_dir), ["event_type"], "t", "y").select("event_type", F.posexplode(T.holt_forecast(F.col("ys"), 0.3, 0.1, 7)).alias("h", "forecast"))
    return found.withColumns({"h": F.col("h") + 1, "forecast": F.round("forecast", 4)})


@query(f"WITH {DAILY} SELECT event_type, round(regr_slope(y, t), 6) AS slope, round(regr_intercept(y, t), 6) AS intercept FROM s GROUP BY 1")
def linear_trend(spark, sf_dir):
    return rounded(T.linear_trend(daily(spark, sf_dir), ["event_type"], "t", "y"), "slope", "intercept")


@query(f"WITH {DAILY} SELECT DISTINCT t, round(sin(2 * pi() * t / 7), 6) AS sin1, round(cos(2 * pi() * t / 7), 6) AS cos1, round(sin(4 * pi() * t / 7), 6) AS sin2, round(cos(4 * pi() * t / 7), 6) AS cos2 FROM s")
def fourier_features(spark, sf_dir):
    return rounded(T.fourier_features(daily(spark, sf_dir).select("t").distinct(), "t", 7.0, 2), "sin1", "cos1", "sin2", "cos2")


_SETTINGS = "g AS (SELECT a.v AS alpha, b.v AS beta, c.v AS gamma FROM (SELECT unnest([0.2, 0.5]::DOUBLE[]) AS v) a, (SELECT unnest([0.1, 0.3]::DOUBLE[]) AS v) b, (SELECT unnest([0.1, 0.3]::DOUBLE[]) AS v) c)"


@query(f"""WITH RECURSIVE {DAILY}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS c FROM s), {_SETTINGS},
f AS (SELECT event_type, avg(y) FILTER (WHERE k < 7) AS m, list(y ORDER BY k) FILTER (WHERE k < 7) AS head, max(y) FILTER (WHERE k = 7) - max(y) FILTER (WHERE k = 0) AS rise FROM o GROUP BY 1),
r AS (SELECT event_type, alpha, beta, gamma, 0::BIGINT AS k, m AS level, rise / 7 AS trend, list_transform(head, lambda h: h - m) AS season, 0.0::DOUBLE AS sse FROM f, g
UNION ALL SELECT event_type, alpha, beta, gamma, k + 1, CASE WHEN k + 1 = c THEN level ELSE fresh END, CASE WHEN k + 1 = c THEN trend ELSE beta * (fresh - level) + (1 - beta) * trend END,
CASE WHEN k + 1 = c THEN season ELSE list_transform(season, lambda v, i: CASE WHEN i = k % 7 + 1 THEN gamma * (y - fresh) + (1 - gamma) * v ELSE v END) END, sse + pow(y - level - trend - season[k % 7 + 1], 2)
FROM (SELECT r.*, o.y, o.c, alpha * (o.y - season[r.k % 7 + 1]) + (1 - alpha) * (level + trend) AS fresh FROM r JOIN o ON o.event_type = r.event_type AND o.k = r.k)),
e AS (SELECT r.*, row_number() OVER (PARTITION BY r.event_type ORDER BY sse, alpha, beta, gamma) AS place FROM r JOIN (SELECT event_type, max(c) AS c FROM o GROUP BY 1) l ON l.event_type = r.event_type AND l.c = r.k)
SELECT event_type, alpha, beta, gamma, round(sse / k, 4) AS mse, h, round(level + h * trend + season[(k + h - 1) % 7 + 1], 4) AS forecast FROM e, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9])::INT AS h) WHERE place = 1""")
def seasonal_forecast(spark, sf_dir):
    """Nine days ahead, weeks as seasons, with the settings that fit best."""
    found = P.holt_winters(daily(spark, sf_dir), ["event_type"], "t", "y", 9, 7, (0.2, 0.5), (0.1, 0.3), (0.1, 0.3))
    ahead = found.select("event_type", "alpha", "beta", "gamma", F.round("mse", 4).alias("mse"), F.posexplode("forecast").alias("h", "forecast"))
    return ahead.withColumns({"h": F.col("h") + 1, "forecast": F.round("forecast", 4)})


@query(f"""WITH {DAILY}, z AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type ORDER BY t) AS z FROM s), x AS (SELECT *, lag(z) OVER (PARTITION BY event_type ORDER BY t) AS x FROM z),
f AS (SELECT event_type, sum(x * z) / (sum(x * x) + 1e-6) AS a, avg(z) - sum(x * z) / (sum(x * x) + 1e-6) * avg(x) AS c FROM x WHERE x IS NOT NULL GROUP BY 1),
r AS (SELECT x.event_type, t, y, z, a, c, z - c - a * x AS r, lag(z - c - a * x) OVER (PARTITION BY x.event_type ORDER BY t) AS before FROM x JOIN f ON x.event_type = f.event_type WHERE x IS NOT NULL),
e AS (SELECT event_type, any_value(a) AS a, any_value(c) AS c, var_pop(r) AS s, greatest(-0.99, least(0.99, avg(r * before) / (var_pop(r) + 1e-10))) AS m, arg_max(y, t) AS y0, arg_max(z, t) AS z0, arg_max(r, t) AS r0 FROM r GROUP BY 1),
h AS (SELECT *, c + a * z0 + m * r0 AS z1 FROM e), i AS (SELECT *, c + a * z1 AS z2, c + a * (c + a * z1) AS z3 FROM h),
o AS (SELECT event_type, a, m, s, unnest([1, 2, 3])::INT AS h, unnest([y0 + z1, y0 + z1 + z2, y0 + z1 + z2 + z3]) AS forecast FROM i)
SELECT event_type, round(a, 6) AS coefficient, round(m, 6) AS moving, h, round(forecast, 4) AS forecast, round(forecast - 1.96::DOUBLE * sqrt(s * h), 4) AS lower, round(forecast + 1.96::DOUBLE * sqrt(s * h), 4) AS upper FROM o""")
def arima_forecast(spark, sf_dir):
    found = P.arima(daily(spark, sf_dir), ["event_type"], "t", "y", 3)
    each = F.posexplode(F.arrays_zip("forecast", "lower", "upper")).alias("h", "v")
    ahead = found.select("event_type", F.round(F.col("coefficients")[0], 6).alias("coefficient"), F.round(F.col("moving")[0], 6).alias("moving"), each)
    return ahead.select("event_type", "coefficient", "moving", (F.col("h") + 1).alias("h"), *[F.round(F.col("v")[c], 4).alias(c) for c in ("forecast", "lower", "upper")])


@query()
def seasonal_arima(spark, sf_dir):
    """Two lags after weekly differences, nine days ahead."""
    return P.arima(daily(spark, sf_dir), ["event_type"], "t", "y", 9, 2, 0, 1, 1, 7)
