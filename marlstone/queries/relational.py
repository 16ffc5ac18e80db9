"""Relational queries of the back end, bound to the driver's tables.

Orders stand for contributions (verified: status F), their lines for records,
customers for companies, nations for consortiums, parts for listed models, events
for usage and predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query, table

VERIFIED = "o_orderstatus = 'F'"


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: company, number of lines, distinct parts, verified flag, time."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("records"), F.sum("l_quantity").alias("quantity"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


CONTRIBUTIONS = """c AS (SELECT o.*, l.records, l.quantity FROM orders o JOIN
 (SELECT l_orderkey, count(*) AS records, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""


@query(f"""WITH {CONTRIBUTIONS}, s AS (SELECT c_custkey, c_name, sum(records)::BIGINT AS total_records, sum(quantity) AS total_features, count(*) AS n_contributions
 FROM c JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT *, round(total_records / sum(total_records) OVER (), 6) AS share FROM s""")
def contribution_summary(spark, sf_dir):
    rows = contributions(spark, sf_dir).filter(VERIFIED).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.contribution_summary(rows, ["c_custkey", "c_name"], "records", "quantity").orderBy(F.col("total_records").desc(), "c_custkey")


@query(f"WITH {CONTRIBUTIONS} SELECT o_custkey, round(sum(records) / sum(sum(records)) OVER (), 9) AS weight FROM c WHERE o_orderstatus = 'F' GROUP BY 1")
def contribution_weights(spark, sf_dir):
    return R.contribution_weights(contributions(spark, sf_dir).filter(VERIFIED), "o_custkey", "records")


@query(f"""WITH {CONTRIBUTIONS} SELECT count(*) AS total_contributions, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified_contributions,
 count(*) FILTER (WHERE o_orderstatus != 'F') AS pending_contributions, sum(records)::BIGINT AS total_records,
 coalesce(sum(records) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT AS verified_records, count(DISTINCT o_custkey) AS contributors,
 count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 30 DAY) AS recent_contributions FROM c""")
def contribution_stats(spark, sf_dir):
    return R.contribution_stats(contributions(spark, sf_dir), "o_custkey", "records", F.expr(VERIFIED), "o_orderdate", F.lit("1998-08-01"))


@query(f"""WITH {CONTRIBUTIONS}, s AS (SELECT o_custkey, sum(records)::BIGINT AS records FROM c WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, records, row_number() OVER (ORDER BY records DESC, o_custkey)::INT AS rank FROM s ORDER BY rank LIMIT 10""")
def leaderboard_topk(spark, sf_dir):
    sums = contributions(spark, sf_dir).filter(VERIFIED).groupBy("o_custkey").agg(F.sum("records").alias("records"))
    return R.top_k(sums, [F.col("records").desc(), F.col("o_custkey")], 10)


@query("""SELECT c_custkey, coalesce(n, 0) AS contributions, coalesce(v, 0) AS volume FROM customer LEFT JOIN
 (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 4) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def member_rankings(spark, sf_dir):
    members, facts = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").filter(VERIFIED)
    return R.zero_filled_ranking(members, "c_custkey", facts, "o_custkey", {"contributions": F.count(F.lit(1)), "volume": F.round(F.sum("o_totalprice"), 4)})


@query("""SELECT n_name, count(DISTINCT c_custkey) AS members, count(DISTINCT c_custkey) FILTER (WHERE c_acctbal >= 0) AS active_members,
 count(o_orderkey) AS contributions, round(avg(o_totalprice), 6) AS avg_value
FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def consortium_stats(spark, sf_dir):
    per_member = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("value"))
    members = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = members.join(per_member, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("members"), F.count_distinct(F.when(F.col("c_acctbal") >= 0, F.col("c_custkey"))).alias("active_members"), F.coalesce(F.sum("n"), F.lit(0)).alias("contributions"), F.round(F.sum("value") / F.sum("n"), 6).alias("avg_value"))


@query("""SELECT CASE WHEN c_acctbal >= 9000 THEN 'excellent' WHEN c_acctbal >= 7000 THEN 'good' WHEN c_acctbal >= 5000 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n
FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1""")
def score_distribution(spark, sf_dir):
    return R.bands(table(spark, sf_dir, "customer"), F.col("c_acctbal") / 100, [("excellent", 90), ("good", 70), ("fair", 50)], "poor")


@query("""SELECT count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_discount,
 round(avg(l_tax), 6) AS avg_tax, round(avg(l_linenumber), 6) AS avg_line FROM lineitem""")
def quality_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.round(F.avg("l_linenumber"), 6).alias("avg_line"))


@query("""SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE event_type = 'purchase') AS predictions, round(avg(value), 6) AS avg_latency,
 round(max(value), 6) AS max_latency FROM events GROUP BY 1""")
def prediction_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "purchase").alias("predictions"), F.round(F.avg("value"), 6).alias("avg_latency"), F.round(F.max("value"), 6).alias("max_latency"))


@query("SELECT user_id, ts::DATE AS day, count(*) AS requests, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2")
def usage_daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("volume"))


@query("""SELECT user_id, year(ts)::INT AS year, month(ts)::INT AS month, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors
FROM events GROUP BY 1, 2, 3""")
def usage_monthly(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed,
 round(coalesce(count(*) FILTER (WHERE event_type = 'purchase') * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 100.0::DOUBLE), 6) AS success_rate
FROM events GROUP BY 1""")
def endpoint_success_rate(spark, sf_dir):
    return R.success_rate(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("""WITH r AS (SELECT least(5, ceil(l_quantity / 10))::INT AS rating FROM lineitem)
SELECT s.rating, count(r.rating) AS n FROM (SELECT unnest([1, 2, 3, 4, 5])::INT AS rating) s LEFT JOIN r ON r.rating = s.rating GROUP BY 1""")
def rating_distribution(spark, sf_dir):
    reviews = table(spark, sf_dir, "lineitem").select(F.least(F.lit(5), F.ceil(F.col("l_quantity") / 10)).alias("rating"))
    return R.spine_counts(reviews, "rating", range(1, 6))


@query("""WITH r AS (SELECT l_partkey, avg(least(5, ceil(l_quantity / 10))) AS avg_rating, count(*) AS n_reviews FROM lineitem GROUP BY 1)
SELECT p_partkey, p_name, round(avg_rating, 6) AS avg_rating, n_reviews, row_number() OVER (ORDER BY round(avg_rating, 6) DESC, p_partkey)::INT AS rank
FROM part JOIN r ON p_partkey = l_partkey ORDER BY rank LIMIT 10""")
def top_rated(spark, sf_dir):
    reviews = table(spark, sf_dir, "lineitem").select("l_partkey", F.least(F.lit(5), F.ceil(F.col("l_quantity") / 10)).alias("rating"))
    return R.top_rated(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", reviews, "l_partkey", "rating")


@query("SELECT p_partkey, coalesce(round(avg(l_quantity), 2), 0) AS rating, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_discount > 0.09 GROUP BY 1")
def average_rating_or_zero(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").filter("l_discount > 0.09")
    return R.zero_filled_ranking(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", facts, "l_partkey", {"rating": F.round(F.avg("l_quantity"), 2), "n": F.count(F.lit(1))})


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_metrics(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, greatest(1, floor(sum(o_totalprice) / 100000))::BIGINT AS weight FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def vote_weight(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(VERIFIED).groupBy("o_custkey").agg(R.vote_weight(F.sum("o_totalprice"), 100_000).alias("weight"))


@query("""WITH v AS (SELECT c_nationkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS support, greatest(1, floor(o_totalprice / 100))::BIGINT AS w
 FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, coalesce(sum(w) FILTER (WHERE support), 0)::BIGINT AS yes, coalesce(sum(w) FILTER (WHERE NOT support), 0)::BIGINT AS no,
 count(*) FILTER (WHERE support IS NULL) AS abstained,
 round(coalesce(sum(w) FILTER (WHERE support) / nullif(sum(w) FILTER (WHERE support IS NOT NULL), 0), 0), 6) AS approval,
 CASE WHEN coalesce(sum(w) FILTER (WHERE support) / nullif(sum(w) FILTER (WHERE support IS NOT NULL), 0), 0) >= 0.5 THEN 'passed' ELSE 'rejected' END AS outcome
FROM v GROUP BY 1""")
def vote_tally(spark, sf_dir):
    votes = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    support = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return R.vote_tally(votes, "c_nationkey", support, R.vote_weight(F.col("o_totalprice")), 0.5)


@query(f"""WITH {CONTRIBUTIONS}, s AS (SELECT o_custkey, sum(records)::DOUBLE AS r FROM c WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, round(r / sum(r) OVER () * 100000, 6) AS reward, round(r / sum(r) OVER () * 100, 4) AS weight_pct FROM s""")
def reward_distribution(spark, sf_dir):
    return R.reward_shares(contributions(spark, sf_dir).filter(VERIFIED), "o_custkey", "records", 100_000.0)


@query("""WITH g AS (SELECT s_nationkey, count(*) AS total, count(*) FILTER (WHERE s_acctbal >= 2000) AS passed, count(*) FILTER (WHERE s_acctbal < 0) AS failed FROM supplier GROUP BY 1)
SELECT *, total - passed - failed AS pending, round(passed * 100.0::DOUBLE / total, 6) AS score,
 CASE WHEN passed * 100.0 / total >= 90 THEN 'compliant' WHEN passed * 100.0 / total >= 70 THEN 'partial' ELSE 'non_compliant' END AS status FROM g""")
def compliance_score(spark, sf_dir):
    return R.compliance_score(table(spark, sf_dir, "supplier"), "s_nationkey", F.col("s_acctbal") >= 2000, F.col("s_acctbal") < 0)


def _benchmarks(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    points = F.percentile("p_retailprice", F.array(*[F.lit(p / 100) for p in (10, 25, 50, 75, 90)]))
    return parts.join(parts.groupBy("p_brand").agg(points.alias("points")), "p_brand")


_BENCH = """b AS (SELECT p_brand, quantile_cont(p_retailprice, 0.1) AS p10, quantile_cont(p_retailprice, 0.25) AS p25, quantile_cont(p_retailprice, 0.5) AS p50,
 quantile_cont(p_retailprice, 0.75) AS p75, quantile_cont(p_retailprice, 0.9) AS p90 FROM part GROUP BY 1)"""


def _thresholds():
    return {p: F.col("points")[k] for k, p in enumerate((10, 25, 50, 75, 90))}


@query(f"""WITH {_BENCH} SELECT p_partkey, (CASE WHEN p_retailprice >= p90 THEN 95 WHEN p_retailprice >= p75 THEN 75 WHEN p_retailprice >= p50 THEN 50
 WHEN p_retailprice >= p25 THEN 25 ELSE 10 END)::INT AS rank FROM part JOIN b USING (p_brand)""")
def percentile_rank_v1(spark, sf_dir):
    return _benchmarks(spark, sf_dir).select("p_partkey", R.percentile_rank(F.col("p_retailprice"), _thresholds(), "v1").alias("rank"))


@query(f"""WITH {_BENCH} SELECT p_partkey, (CASE WHEN p_retailprice >= p90 THEN 90 WHEN p_retailprice >= p75 THEN 75 WHEN p_retailprice >= p50 THEN 50
 WHEN p_retailprice >= p25 THEN 25 WHEN p_retailprice >= p10 THEN 10 ELSE 0 END)::INT AS rank FROM part JOIN b USING (p_brand)""")
def percentile_rank_v2(spark, sf_dir):
    return _benchmarks(spark, sf_dir).select("p_partkey", R.percentile_rank(F.col("p_retailprice"), _thresholds(), "v2").alias("rank"))


@query(f"""WITH {_BENCH}, r AS (SELECT p_brand, CASE WHEN p_retailprice >= p90 THEN 90 WHEN p_retailprice >= p75 THEN 75 WHEN p_retailprice >= p50 THEN 50
 WHEN p_retailprice >= p25 THEN 25 WHEN p_retailprice >= p10 THEN 10 ELSE 0 END AS rank FROM part JOIN b USING (p_brand))
SELECT p_brand, count(*) FILTER (WHERE rank >= 75) AS strengths, count(*) FILTER (WHERE rank < 25) AS weaknesses, round(coalesce(avg(rank), 50), 6) AS avg_percentile FROM r GROUP BY 1""")
def strengths_weaknesses(spark, sf_dir):
    rank = R.percentile_rank(F.col("p_retailprice"), _thresholds(), "v2")
    ranked = _benchmarks(spark, sf_dir).select("p_brand", rank.alias("rank"))
    return ranked.groupBy("p_brand").agg(F.count_if(F.col("rank") >= 75).alias("strengths"), F.count_if(F.col("rank") < 25).alias("weaknesses"), F.round(F.coalesce(F.avg("rank"), F.lit(50.0)), 6).alias("avg_percentile"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%GREEN%' OR p_type ILIKE '%brass%'")
def search_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%GREEN%") | F.col("p_type").ilike("%brass%")).select("p_partkey", "p_name")


@query("SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT >= 50")
def json_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k >= 50")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND year(o_orderdate) = 1995 AND o_totalprice >= 1000 AND lower(o_orderstatus) = 'f'")
def declarative_filters(spark, sf_dir):
    spec = {"o_orderpriority__in": ["1-URGENT", "2-HIGH"], "o_orderdate__year": 1995, "o_totalprice__gte": 1000, "o_orderstatus__iexact": "f"}
    return R.apply_filters(table(spark, sf_dir, "orders"), spec).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'BRASS') AND list_contains(string_split(p_type, ' '), 'STANDARD')")
def tags_containment(spark, sf_dir):
    tagged = table(spark, sf_dir, "part").withColumn("tags", F.split("p_type", " "))
    return R.apply_filters(tagged, {"tags__contains": ["BRASS", "STANDARD"]}).select("p_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS expires FROM orders
WHERE CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate >= TIMESTAMP '1997-01-01'""")
def valid_attestations(spark, sf_dir):
    expires = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", expires.alias("expires")).filter("expires is null or expires >= timestamp_ntz'1997-01-01'")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def member_semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH m AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM m) OR l_linenumber IN (SELECT s_suppkey FROM m)""")
def source_or_target_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return R.two_sided_semi(lines, "l_suppkey", "l_linenumber", table(spark, sf_dir, "supplier").filter("s_nationkey < 5"), "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def non_member_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey AS key FROM customer WHERE c_nationkey = 3 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def invitations_union_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey", "c_mktsegment")
    return rows.filter("c_nationkey = 3").unionByName(rows.filter("c_mktsegment = 'BUILDING'")).select("key").distinct()


@query("""SELECT 'customer' AS kind, c_nationkey AS nation, round(c_acctbal, 2) AS balance FROM customer UNION ALL
SELECT 'supplier', s_nationkey, round(s_acctbal, 2) FROM supplier""")
def member_union_all(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal", 2).alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal", 2).alias("balance"))
    return a.unionByName(b)


@query("""SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def prefetch_nested(spark, sf_dir):
    out = R.nested(table(spark, sf_dir, "region"), "r_regionkey", table(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey", "n_name"], "nations")
    return out.select("r_regionkey", "r_name", F.array_join(F.transform("nations", lambda n: n["n_name"]), ",").alias("nations"))


@query("""WITH m AS (SELECT user_id, avg(value) AS avg_value, count(*)::DOUBLE AS requests FROM events GROUP BY 1),
l AS (SELECT user_id, 'avg_value' AS metric, avg_value AS value FROM m UNION ALL SELECT user_id, 'requests', requests FROM m),
r AS (SELECT * FROM (VALUES ('avg_value', '<=', 50.0::DOUBLE, 'high'), ('requests', '>=', 60.0::DOUBLE, 'low')) t(metric, op, bound, severity))
SELECT user_id, metric, op, bound, severity, round(value, 6) AS value FROM l JOIN r USING (metric)
WHERE NOT CASE op WHEN '<=' THEN value <= bound ELSE value >= bound END""")
def rule_alerts(spark, sf_dir):
    rules = spark.createDataFrame([("avg_value", "<=", 50.0, "high"), ("requests", ">=", 60.0, "low")], "metric string, op string, bound double, severity string")
    metrics = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).cast("double").alias("requests"))
    return R.rule_alerts(metrics, "user_id", ["avg_value", "requests"], rules).withColumn("value", F.round("value", 6))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_count FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return R.page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def recent_top5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(5)


@query("""SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER w AS previous_quantity, round(l_quantity - lag(l_quantity) OVER w, 6) AS change
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def version_previous(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    previous = R.previous_value(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", previous.alias("previous_quantity"), F.col("l_quantity").alias("q")).select("l_orderkey", "l_linenumber", "previous_quantity", F.round(F.col("q") - F.col("previous_quantity"), 6).alias("change"))


@query("SELECT a.p_partkey, a.p_size FROM part a WHERE row(a.p_size, a.p_brand, a.p_partkey) < row(10, 'Brand#30', 500)")
def version_before(spark, sf_dir):
    key = F.struct("p_size", "p_brand", F.col("p_partkey"))
    return table(spark, sf_dir, "part").filter(key < F.struct(F.lit(10), F.lit("Brand#30"), F.lit(500).cast("long"))).select("p_partkey", "p_size")


_CHAIN_SQL = """h AS (SELECT user_id, event_id, ts, sha256(concat_ws('|', event_id, event_type)) AS hash FROM events),
p AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'tampered' ELSE lag(hash, 1, '') OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS previous FROM h)"""


@query(f"""WITH {_CHAIN_SQL}, v AS (SELECT user_id, previous = lag(hash, 1, '') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS linked FROM p)
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE NOT linked) AS breaks, bool_and(linked) AS valid FROM v GROUP BY 1""")
def audit_chain_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("hash", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256))
    before = R.previous_value(rows, ["user_id"], ["ts", "event_id"], "hash", "")
    rows = rows.withColumn("previous", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(before))
    return R.chain_breaks(rows, "user_id", ["ts", "event_id"], "previous", "hash")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) FILTER (WHERE true) AS most_id FROM events GROUP BY 1""")
def latest_event(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    last = R.latest(rows, "user_id", ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "last_type")
    return last.join(rows.groupBy("user_id").agg(F.max("event_id").alias("most_id")), "user_id")


@query("""WITH f AS (SELECT o_custkey, count(*) AS frequency, sum(o_totalprice) AS monetary, date_diff('day', max(o_orderdate), TIMESTAMP '1999-01-01')::INT AS recency FROM orders GROUP BY 1),
e AS (SELECT quantile_cont(recency::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS r, quantile_cont(frequency::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS q, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS m FROM f)
SELECT o_custkey, (5 - len(list_filter(r, lambda x: x < recency)))::INT AS recency_bin, (1 + len(list_filter(q, lambda x: x < frequency)))::INT AS frequency_bin,
 (1 + len(list_filter(m, lambda x: x < monetary)))::INT AS monetary_bin FROM f, e""")
def rfm_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("frequency"), F.sum("o_totalprice").alias("monetary"), F.datediff(F.lit("1999-01-01"), F.max("o_orderdate")).alias("recency"))
    out = R.segments_by_quintile(rows, "o_custkey", "recency", descending=True)
    for column in ("frequency", "monetary"):
        out = out.join(R.segments_by_quintile(rows, "o_custkey", column), "o_custkey")
    return out


@query("""SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean_balance, round(100 * (avg(c_acctbal) / (SELECT avg(c_acctbal) FROM customer) - 1), 4) AS pct_difference FROM customer GROUP BY 1""")
def group_means_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    overall = rows.agg(F.avg("c_acctbal").alias("overall"))
    means = rows.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean")).crossJoin(F.broadcast(overall))
    return means.select("c_mktsegment", F.round("mean", 4).alias("mean_balance"), F.round(100 * (F.col("mean") / F.col("overall") - 1), 4).alias("pct_difference"))


@query("SELECT sum(CASE WHEN d <= 0.02 THEN 1 ELSE 0 END)::BIGINT AS low, sum(CASE WHEN d > 0.02 AND d <= 0.06 THEN 1 ELSE 0 END)::BIGINT AS mid, sum(CASE WHEN d > 0.06 THEN 1 ELSE 0 END)::BIGINT AS high FROM (SELECT l_discount AS d FROM lineitem)")
def probability_bins(spark, sf_dir):
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").agg(F.count_if(d <= 0.02).alias("low"), F.count_if((d > 0.02) & (d <= 0.06)).alias("mid"), F.count_if(d > 0.06).alias("high"))


@query("SELECT event_type, EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.value > 99) AS has_large FROM (SELECT DISTINCT event_type FROM events) e")
def existence_test(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.coalesce(F.bool_or(F.col("value") > 99), F.lit(False)).alias("has_large"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS companies FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'EUROPE' GROUP BY 1")
def path_join_distinct(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    active = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return active.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count_distinct("c_custkey").alias("companies"))


@query("""SELECT event_id, attempts, due FROM (SELECT event_id, (event_id % 6)::INT AS attempts, ts + INTERVAL 1 HOUR AS due FROM events WHERE event_type = 'error')
WHERE due <= TIMESTAMP '2024-01-15 00:00:00' AND attempts < 5 ORDER BY due, event_id LIMIT 100""")
def retry_queue(spark, sf_dir):
    """Failed events that are due again an hour later; the batch of 100 is the feature."""
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", (F.col("event_id") % 6).cast("int").alias("attempts"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("due"))
    return R.due_retries(failed, "attempts", "due", "event_id", F.lit("2024-01-15 00:00:00").cast("timestamp"), 5, 100)
