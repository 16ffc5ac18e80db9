"""Privacy ledgers, clipped statistics and secure sums; noise is off where SQL compares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy as P
from .registry import query, table


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


#: The seed of registered queries is public, so that SQL can follow; a release takes a secret one.
SEED = "published"


def laplace_sql(key: str, scale: str) -> str:
    u = f"((('0x' || substr(sha256('{SEED}|' || {key}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE - 0.5)"
    return f"(-({scale}) * sign({u}) * ln(1 - 2 * abs({u})))"


@query("""WITH f AS (SELECT l_quantity, l_discount, least(1, 30 / sqrt(l_quantity * l_quantity + l_discount * l_discount)) AS k FROM lineitem)
SELECT round(avg(l_quantity * k), 6) AS l_quantity, round(avg(l_discount * k), 6) AS l_discount FROM f""")
def dp_clip_mean(spark, sf_dir):
    return rounded(P.private_mean(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 30.0, 1.0, noise=False), "l_quantity", "l_discount")


@query(f"""WITH f AS (SELECT l_quantity, l_discount, least(1, 30 / sqrt(l_quantity * l_quantity + l_discount * l_discount)) AS k FROM lineitem), m AS (SELECT count(*) AS n, avg(l_quantity * k) AS q, avg(l_discount * k) AS d FROM f)
SELECT round(q + {laplace_sql("'mean|l_quantity'", '30.0::DOUBLE / n')}, 6) AS l_quantity, round(d + {laplace_sql("'mean|l_discount'", '30.0::DOUBLE / n')}, 6) AS l_discount FROM m""")
def dp_noisy_mean(spark, sf_dir):
    return rounded(P.private_mean(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 30.0, 1.0, SEED), "l_quantity", "l_discount")


@query("""WITH h AS (SELECT least(11, floor((value + 20) / 15))::INT AS bin FROM events WHERE value BETWEEN -20 AND 160)
SELECT s.bin, count(h.bin)::DOUBLE AS n FROM (SELECT unnest(range(12))::INT AS bin) s LEFT JOIN h ON h.bin = s.bin GROUP BY 1""")
def dp_histogram(spark, sf_dir):
    return P.private_histogram(table(spark, sf_dir, "events"), "value", -20.0, 160.0, 12, 1.0, noise=False)


@query(f"""WITH h AS (SELECT least(11, floor((value + 20) / 15))::INT AS bin FROM events WHERE value BETWEEN -20 AND 160), n AS (SELECT s.bin, count(h.bin)::DOUBLE AS n FROM (SELECT unnest(range(12))::INT AS bin) s LEFT JOIN h ON h.bin = s.bin GROUP BY 1)
SELECT bin, round(greatest(0.0::DOUBLE, n + {laplace_sql("'histogram|' || bin", '2.0::DOUBLE')}), 6) AS n FROM n""")
def dp_noisy_histogram(spark, sf_dir):
    return rounded(P.private_histogram(table(spark, sf_dir, "events"), "value", -20.0, 160.0, 12, 0.5, SEED), "n")


@query(f"""SELECT s_suppkey, round(s_acctbal * least(1.0::DOUBLE, coalesce(5000.0::DOUBLE / nullif(abs(s_acctbal), 0), 1.0)) + {laplace_sql("'rows|s_acctbal|' || s_suppkey", '5000.0::DOUBLE')}, 4) AS s_acctbal FROM supplier""")
def dp_noisy_rows(spark, sf_dir):
    out = P.private_rows(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", ["s_acctbal"], 5000.0, 1.0, SEED)
    return out.withColumn("s_acctbal", F.round("s_acctbal", 4))


@query("SELECT p_brand FROM (SELECT p_brand, count(*)::DOUBLE AS u FROM part GROUP BY 1) ORDER BY u DESC, p_brand DESC LIMIT 1")
def dp_exponential(spark, sf_dir):
    return P.exponential_choice(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).cast("double").alias("u")), "p_brand", "u", 1.0, 1.0, noise=False)


def ledger(spark, sf_dir):
    """One query per urgent order of a customer; epsilon by the order's priority."""
    e = F.col("o_orderkey") % 5 + 1
    return table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", (e / 1000).alias("epsilon"), F.lit(1e-7).alias("delta"), (5.0 + e).alias("sigma"))


LEDGER = "l AS (SELECT o_custkey, o_orderkey, (o_orderkey % 5 + 1) / 1000 AS epsilon, 1e-7 AS delta, 5.0::DOUBLE + o_orderkey % 5 + 1 AS sigma FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(f"WITH {LEDGER} SELECT count(*) AS queries, round(sum(epsilon), 6) AS epsilon, round(sum(delta), 9) AS delta, round(greatest(0, 100 - sum(epsilon)), 6) AS epsilon_left, sum(epsilon) <= 100 AND sum(delta) <= 1e-3 AS affordable FROM l")
def privacy_ledger_basic(spark, sf_dir):
    return rounded(P.ledger_basic(ledger(spark, sf_dir), 100.0, 1e-3), "epsilon", "epsilon_left").withColumn("delta", F.round("delta", 9))


@query(f"WITH {LEDGER} SELECT count(*) AS queries, round(sqrt(2 * count(*) * ln(1e5)) * max(epsilon) + count(*) * max(epsilon) * (exp(max(epsilon)) - 1), 6) AS epsilon, round(sum(delta) + 1e-5, 9) AS delta FROM l")
def privacy_ledger_advanced(spark, sf_dir):
    return rounded(P.ledger_advanced(ledger(spark, sf_dir), 1e-5), "epsilon").withColumn("delta", F.round("delta", 9))


@query(f"""WITH {LEDGER}, s AS (SELECT sum(1 / (2 * sigma * sigma)) AS s FROM l), a AS (SELECT unnest([1.5, 2.0, 3.0, 4.0, 5.0, 8.0, 16.0, 32.0, 64.0]::DOUBLE[]) AS a)
SELECT round(min(a * s + ln(1e5) / (a - 1)), 6) AS epsilon, arg_min(a, a * s + ln(1e5) / (a - 1)) AS "order" FROM s, a""")
def privacy_ledger_rdp(spark, sf_dir):
    return rounded(P.ledger_renyi(ledger(spark, sf_dir), 1e-5), "epsilon")


@query(f"""WITH {LEDGER} SELECT o_custkey, o_orderkey, round(sum(epsilon) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS used,
 round(sum(epsilon) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 9) <= 0.0105 AS accepted FROM l""")
def privacy_budget_gate(spark, sf_dir):
    out = P.affordable_prefix(ledger(spark, sf_dir), "o_orderkey", "o_custkey", 0.0105)
    return rounded(out.select("o_custkey", "o_orderkey", "used", "accepted"), "used")


def parties(spark, sf_dir):
    """Each nation's integer vector of counts and rounded balances."""
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("party"))
    return rows.agg(F.array(F.count(F.lit(1)), F.sum(F.floor("s_acctbal").cast("long"))).alias("vector"))


@query("SELECT 0::INT AS pos, count(*) AS total FROM supplier UNION ALL SELECT 1, sum(floor(s_acctbal))::BIGINT FROM supplier")
def secure_sum(spark, sf_dir):
    v = parties(spark, sf_dir)
    return P.masked_sum(v, "party", "vector", P.pair_masks(v, "party", 2, "round-1"))


@query("SELECT 0::INT AS pos, count(*) AS total FROM supplier WHERE s_nationkey % 4 != 0 UNION ALL SELECT 1, sum(floor(s_acctbal))::BIGINT FROM supplier WHERE s_nationkey % 4 != 0")
def secure_sum_dropout(spark, sf_dir):
    v = parties(spark, sf_dir)
    return P.masked_sum(v, "party", "vector", P.pair_masks(v, "party", 2, "round-1"), surviving=v.filter("party % 4 != 0"))


@query("""WITH p AS (SELECT s_nationkey, count(*)::DOUBLE AS w, avg(s_acctbal) AS a, min(s_acctbal) AS b FROM supplier GROUP BY 1)
SELECT 0::INT AS pos, round(sum(w * a) / sum(w), 6) AS value FROM p UNION ALL SELECT 1, round(sum(w * b) / sum(w), 6) FROM p""")
def weighted_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("w"), F.array(F.avg("s_acctbal"), F.min("s_acctbal")).alias("v"))
    return rounded(P.weighted_aggregate(rows, "w", "v"), "value")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), k AS (SELECT vec_id, e, least(1, 0.5 / sqrt(list_sum(list_transform(e, lambda x: x * x)))) AS f FROM n)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * f)), 6) AS total FROM k""")
def gradient_clip(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("g"))
    return P.clip_gradients(rows, "g", 0.5).select("vec_id", F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
