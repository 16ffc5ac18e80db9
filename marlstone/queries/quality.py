"""Data-quality and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import validation as V
from .registry import query, table

#: Every third line's quantity is missing; SQL and Spark inject the same nulls.
LINES = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem)"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


def lines(spark, sf_dir):
    quantity = F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quantity, "l_extendedprice", "l_discount", "l_returnflag")


@query(f"""SELECT sum(n)::BIGINT AS n_rows, 6::INT AS n_columns, 5::INT AS n_numeric, 1::INT AS n_other, sum(n - 1)::BIGINT AS n_duplicates
FROM (SELECT count(*) AS n FROM {LINES} GROUP BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag)""")
def profile(spark, sf_dir):
    return Q.profile(lines(spark, sf_dir))


@query(" UNION ALL ".join(f'SELECT \'{c}\' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_missing, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS pct_missing FROM {LINES}' for c in ["l_orderkey", "l_linenumber", *NUMERIC, "l_returnflag"]))
def missing_analysis(spark, sf_dir):
    return Q.missing_analysis(lines(spark, sf_dir))


def _bounded(low: str, high: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", (SELECT count(*) FROM {LINES} WHERE {c} < lo OR {c} > hi) AS n_outliers, round(lo, 6) AS low, round(hi, 6) AS high
FROM (SELECT {low.format(c=c)} AS lo, {high.format(c=c)} AS hi FROM {LINES})""" for c in NUMERIC)


@query(_bounded("quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def outlier_iqr_counts(spark, sf_dir):
    return Q.outlier_counts(lines(spark, sf_dir), NUMERIC)


@query(_bounded("avg({c}) - 3 * stddev_pop({c})", "avg({c}) + 3 * stddev_pop({c})"))
def outlier_zscore_counts(spark, sf_dir):
    return Q.outlier_counts(lines(spark, sf_dir), NUMERIC, "zscore", 1.5)


@query("""WITH b AS (SELECT quantile_cont(o_totalprice, 0.75) + 0.3 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS hi,
 quantile_cont(o_totalprice, 0.25) - 0.3 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS lo FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, b WHERE o_totalprice < lo OR o_totalprice > hi ORDER BY o_orderkey LIMIT 100""")
def outlier_first_rows(spark, sf_dir):
    return Q.outlier_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_totalprice", "iqr", 0.3)


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {LINES}" for a, b in _PAIRS))
def correlation_matrix(spark, sf_dir):
    return Q.correlations(lines(spark, sf_dir), NUMERIC)


@query(f"SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {LINES}''' for a, b in _PAIRS)}) WHERE abs(r) > 0.3")
def correlation_pairs(spark, sf_dir):
    return Q.strong_correlations(lines(spark, sf_dir), NUMERIC, 0.3)


_MISSING = f"(SELECT count(*) FILTER (WHERE l_quantity IS NULL) / (count(*) * 6)::DOUBLE AS m FROM {LINES})"


@query(f"SELECT round(1 - m, 4) AS completeness FROM {_MISSING}")
def completeness(spark, sf_dir):
    return Q.completeness(lines(spark, sf_dir))


_MIXED_EVENTS = "(SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_id::VARCHAR END AS tag FROM events)"


@query(f"""WITH g AS (SELECT count(*) AS n FROM {_MIXED_EVENTS} GROUP BY ALL HAVING true),
d AS (SELECT sum(n - 1) / sum(n)::DOUBLE AS dup FROM (SELECT count(*) AS n FROM {_MIXED_EVENTS} GROUP BY user_id, event_type, tag))
SELECT round(greatest(0, least(1, 1 - (0.5 * dup + 0.5 * 1 / 3::DOUBLE))), 6) AS consistency FROM d""")
def consistency(spark, sf_dir):
    tag = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return Q.consistency(table(spark, sf_dir, "events").select("user_id", "event_type", tag.alias("tag")))


@query(f"""WITH b AS ({_bounded("quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")}),
o AS (SELECT sum(n_outliers)::BIGINT AS n_outliers FROM b), k AS (SELECT round(1 - m, 4) AS completeness FROM {_MISSING}),
d AS (SELECT round(1 - 0.5 * sum(n - 1) / sum(n)::DOUBLE, 6) AS consistency, sum(n) * 3 AS cells FROM (SELECT count(*) AS n FROM {LINES} GROUP BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag))
SELECT completeness, consistency, n_outliers, round(0.4 * completeness + 0.3 * consistency + 0.3 * greatest(0, 1 - 5 * n_outliers / cells::DOUBLE), 6) AS score FROM o, k, d""")
def quality_report(spark, sf_dir):
    return Q.quality_report(lines(spark, sf_dir), NUMERIC)


@query(f"SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag)")
def duplicate_rows(spark, sf_dir):
    return Q.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"))


_COUNTS = """c AS (SELECT l_suppkey, count(*) AS records, 6 AS features, count(*) FILTER (WHERE l_linenumber = 3) AS nulls, count(*) FILTER (WHERE l_quantity > 49) AS duplicates,
 count(*) FILTER (WHERE l_extendedprice > 90000) AS outliers, count(*) FILTER (WHERE l_discount = 0) AS schema_violations, count(*) FILTER (WHERE l_tax = 0) AS format_violations,
 count(*) FILTER (WHERE l_quantity < 2) AS range_violations, date_diff('day', max(l_shipdate), TIMESTAMP '1999-01-10')::DOUBLE AS age_days FROM lineitem GROUP BY 1)"""


def counts(spark, sf_dir):
    n = lambda test: F.count_if(F.expr(test))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("records"), F.lit(6).alias("features"), n("l_linenumber = 3").alias("nulls"), n("l_quantity > 49").alias("duplicates"), n("l_extendedprice > 90000").alias("outliers"), n("l_discount = 0").alias("schema_violations"), n("l_tax = 0").alias("format_violations"), n("l_quantity < 2").alias("range_violations"), F.datediff(F.lit("1999-01-10"), F.max("l_shipdate")).cast("double").alias("age_days"))


def _score_sql(parts: dict[str, str], weights: dict[str, float]) -> str:
    cols = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in parts.items())
    overall = " + ".join(f"{w} * {k}" for k, w in weights.items())
    return f"WITH {_COUNTS}, s AS (SELECT l_suppkey, {cols} FROM c) SELECT l_suppkey, {', '.join(f'round({k}, 6) AS {k}' for k in parts)}, round(({overall})::DOUBLE, 6) AS overall FROM s"


_pct = "greatest(0, 100 * (1 - ({0}) / ({1})::DOUBLE))".format
_AGE = "CASE WHEN age_days < 1 THEN 100 WHEN age_days < 7 THEN 100 - (age_days - 1) * 10 / 6 WHEN age_days < 30 THEN 90 - (age_days - 7) * 20 / 23 WHEN age_days < 90 THEN 70 - (age_days - 30) / 3 ELSE greatest(0, 50 - (age_days - 90) * 5 / 9) END"


@query(_score_sql({"completeness": _pct("nulls", "records"), "consistency": _pct("schema_violations + format_violations", "records"), "accuracy": _pct("range_violations + outliers", "records"), "timeliness": _pct("duplicates", "records")}, dict.fromkeys(["completeness", "consistency", "accuracy", "timeliness"], 0.25)))
def quality_score_v1(spark, sf_dir):
    return Q.quality_score_v1(counts(spark, sf_dir)).select("l_suppkey", "completeness", "consistency", "accuracy", "timeliness", "overall")


@query(_score_sql({"completeness": _pct("nulls", "records * 6"), "consistency": _pct("duplicates + format_violations", "2 * records"), "accuracy": _pct("outliers + schema_violations + range_violations", "records"), "timeliness": _AGE}, {"completeness": 0.30, "consistency": 0.25, "accuracy": 0.25, "timeliness": 0.20}))
def quality_score_v2(spark, sf_dir):
    return Q.quality_score_v2(counts(spark, sf_dir)).select("l_suppkey", "completeness", "consistency", "accuracy", "timeliness", "overall")


@query(_score_sql({"completeness": _pct("nulls", "records * 6"), "consistency": _pct("schema_violations + format_violations + range_violations", "3 * records"), "uniqueness": _pct("duplicates", "records"), "validity": _pct("outliers", "records"), "freshness": "greatest(0, 100 * (1 - age_days / 30))"}, {"completeness": 0.25, "consistency": 0.20, "uniqueness": 0.20, "validity": 0.20, "freshness": 0.15}))
def quality_score_v3(spark, sf_dir):
    return Q.quality_score_v3(counts(spark, sf_dir)).select("l_suppkey", "completeness", "consistency", "uniqueness", "validity", "freshness", "overall")


@query("""SELECT l_orderkey, l_linenumber, 'l_quantity' AS "column", 'in_range' AS "constraint", l_quantity::VARCHAR AS value FROM lineitem WHERE l_quantity > 45
UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag', 'in_set', l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT l_orderkey, l_linenumber, 'l_linestatus', 'max_length', l_linestatus FROM lineitem WHERE length(l_linestatus) > 1""")
def constraint_violations(spark, sf_dir):
    schema = V.DataSchema([V.ColumnSchema("l_quantity", nullable=False, constraints=[V.in_range(1, 45), V.is_positive()]), V.ColumnSchema("l_returnflag", constraints=[V.in_set(["A", "N"]), V.min_length(1)]), V.ColumnSchema("l_linestatus", constraints=[V.max_length(1), V.not_empty()])])
    return schema.violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(r"""SELECT page_id, NOT regexp_matches(url, '(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$') AS broken FROM pages""")
def url_constraint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.is_url().broken(F.col("url")).alias("broken"))


@query(r"""SELECT doc_id, regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS has_email, length(text) < 20 AS too_short FROM documents""")
def text_constraints(spark, sf_dir):
    text = F.col("text")
    email = V.EMAIL.removeprefix("^").removesuffix("$")
    return table(spark, sf_dir, "documents").select("doc_id", text.rlike(email).alias("has_email"), V.min_length(20).broken(text).alias("too_short"))


_SUPPLIER = [("s_suppkey", "bigint", True), ("s_name", "string", False), ("s_nationkey", "int", True), ("s_acctbal", "double", True)]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype, bool_or({c} IS NULL) AS nullable, {f"min({c})::DOUBLE" if n else "NULL::DOUBLE"} AS low, {f"max({c})::DOUBLE" if n else "NULL::DOUBLE"} AS high FROM supplier""" for c, t, n in _SUPPLIER))
def schema_infer(spark, sf_dir):
    return V.infer_schema(table(spark, sf_dir, "supplier"))


def _dataset_sql(rows: str, value: str, key: str) -> str:
    return f"""SELECT 'no_missing' AS "check", count(*) FILTER (WHERE {key} IS NULL OR {value} IS NULL) = 0 AS passed FROM {rows} UNION ALL SELECT 'finite', count(*) FILTER (WHERE isnan({value}) OR isinf({value})) = 0 FROM {rows}
UNION ALL SELECT 'positive_mean', avg({value}) > 0 FROM {rows} UNION ALL SELECT 'no_duplicates', (SELECT count(*) FROM {rows}) = (SELECT count(*) FROM (SELECT DISTINCT * FROM {rows}))"""


@query(_dataset_sql("(SELECT * FROM customer)", "c_acctbal", "c_name"))
def dataset_checks(spark, sf_dir):
    return V.dataset_checks(table(spark, sf_dir, "customer"), custom_checks={"positive_mean": F.avg("c_acctbal") > 0})


def spoilt(column: str, spoiler: str):
    """A column with NaN where another is 3, plus infinity where it is 4, minus infinity where it is 5; _spoilt_sql is the same."""
    at = F.col(spoiler)
    return F.when(at == 3, float("nan")).when(at == 4, float("inf")).when(at == 5, float("-inf")).otherwise(F.col(column)).alias(column)


def _spoilt_sql(column: str, spoiler: str) -> str:
    return f"CASE {spoiler} WHEN 3 THEN 'nan'::DOUBLE WHEN 4 THEN 'inf'::DOUBLE WHEN 5 THEN '-inf'::DOUBLE ELSE {column} END AS {column}"


@query(_dataset_sql(f"(SELECT c_mktsegment, {_spoilt_sql('c_nationkey', 'c_nationkey')} FROM customer WHERE c_nationkey <> 3 AND c_nationkey <> 5)", "c_nationkey", "c_mktsegment"))
def dataset_checks_broken(spark, sf_dir):
    """Segments and nations, with repeats and infinities."""
    rows = table(spark, sf_dir, "customer").filter("c_nationkey <> 3 AND c_nationkey <> 5").select("c_mktsegment", spoilt("c_nationkey", "c_nationkey"))
    return V.dataset_checks(rows, custom_checks={"positive_mean": F.avg("c_nationkey") > 0})


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE isnan({c})) AS n_nan, count(*) FILTER (WHERE isinf({c})) AS n_inf, min({c}) = max({c}) AS is_constant FROM (SELECT {_spoilt_sql('l_quantity', 'l_linenumber')}, l_discount, l_tax * 0 AS l_tax FROM lineitem)""" for c in ("l_quantity", "l_discount", "l_tax")))
def feature_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(spoilt("l_quantity", "l_linenumber"), "l_discount", (F.col("l_tax") * 0).alias("l_tax"))
    return V.feature_checks(rows, ["l_quantity", "l_discount", "l_tax"])


@query("SELECT count(quality) AS n, count(DISTINCT quality) AS n_classes, count(*) FILTER (WHERE quality NOT IN (0)) AS n_outside FROM labels")
def label_check(spark, sf_dir):
    return V.label_check(table(spark, sf_dir, "labels"), "quality", [0])


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative, count(*) FILTER (WHERE c_acctbal IS NULL OR isnan(c_acctbal) OR isinf(c_acctbal)) AS n_not_finite FROM (SELECT {_spoilt_sql('c_acctbal', 'c_nationkey')} FROM customer)")
def weight_check(spark, sf_dir):
    return V.weight_check(table(spark, sf_dir, "customer").select(spoilt("c_acctbal", "c_nationkey")), "c_acctbal")


@query("SELECT count(*) AS n_samples, 2::INT AS n_features, count(*) >= 10 AS valid FROM lineitem")
def shape_check(spark, sf_dir):
    return V.shape_check(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 10)


@query("SELECT least(min(l_quantity), min(l_discount)) + 0.0 AS lowest, greatest(max(l_quantity), max(l_discount)) + 0.0 AS highest, least(min(l_quantity), min(l_discount)) >= 0 AND greatest(max(l_quantity), max(l_discount)) <= 40 AS valid FROM lineitem")
def range_check(spark, sf_dir):
    return V.range_check(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 0, 40)


@query("""SELECT count(*) AS n, count(DISTINCT quality) AS n_classes, count(quality) = count(*) AND count(*) = (SELECT count(*) FROM labels) AND count(DISTINCT quality) >= 2 AND coalesce(bool_and(quality = floor(quality)), true) AS valid FROM labels""")
def target_check(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return V.target_check(rows, "quality", rows.count(), "classification")


@query(r"""SELECT doc_id, text IS NULL OR trim(text) = '' AS missing, coalesce(length(trim(text)) = 0, false) AS blank, coalesce(NOT regexp_matches(text, '^[a-z ]+'), false) AS unlike, coalesce(TRY_CAST(source AS BIGINT) IS NULL AND source IS NOT NULL, false) AS no_number, coalesce(NOT length(text) % 2 = 0, false) AS odd FROM documents""")
def value_constraints(spark, sf_dir):
    """Constraints on missing, blank, unlike and ill-typed values, and one of the user's own."""
    tests = {"missing": (V.not_null(), "text"), "blank": (V.not_empty(), "text"), "unlike": (V.matches("[a-z ]+"), "text"), "no_number": (V.is_type("int"), "source"), "odd": (V.custom("even", lambda c: F.length(c) % 2 == 0), "text")}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(k.broken(F.col(c)), F.lit(False)).alias(n) for n, (k, c) in tests.items()])
