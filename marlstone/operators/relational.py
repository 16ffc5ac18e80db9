"""Filters, joins, aggregations, rankings and set operations of the consortium back end.

Group sums are combined before their shuffle; shares of a total join a one-row
aggregate instead of using a window without partitions, which would move all rows
to one task. Rankings over a whole table only number the rows of a top-k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import percentile_row


def with_total(df: DataFrame, column: str, alias: str = "total") -> DataFrame:
    """df with the sum of a column on every row, from a one-row aggregate."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(column).alias(alias))))


def share(part: Column, total: Column) -> Column:
    """part / total, 0 where the total is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def contribution_summary(contributions: DataFrame, by: Sequence[str], records: str, features: str) -> DataFrame:
    """Sums of records and features, number of contributions and share of all records by company."""
    sums = contributions.groupBy(*by).agg(F.sum(records).alias("total_records"), F.sum(features).alias("total_features"), F.count(F.lit(1)).alias("n_contributions"))
    return with_total(sums, "total_records", "all_records").withColumn("share", F.round(share(F.col("total_records"), F.col("all_records")), 6)).drop("all_records")


def contribution_weights(contributions: DataFrame, by: str, records: str) -> DataFrame:
    sums = contributions.groupBy(by).agg(F.sum(records).alias("records"))
    return with_total(sums, "records").select(by, F.round(share(F.col("records"), F.col("total")), 9).alias("weight"))


def contribution_stats(contributions: DataFrame, company: str, records: str, verified: Column, at: str, asof: Column, days: int = 30) -> DataFrame:
    """One row of counts, sums, distinct contributors and a recent window that ends at asof."""
    recent = F.col(at) >= F.date_sub(asof.cast("date"), days)
    return contributions.agg(
        F.count(F.lit(1)).alias("total_contributions"),
        F.count_if(verified).alias("verified_contributions"),
        F.count_if(~verified).alias("pending_contributions"),
        F.sum(records).alias("total_records"),
        F.sum(F.when(verified, F.col(records)).otherwise(0)).alias("verified_records"),
        F.count_distinct(company).alias("contributors"),
        F.count_if(recent).alias("recent_contributions"),
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows in order, numbered; only k rows reach the window."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 50, most: int = 200) -> DataFrame:
    """A page of rows (from page 1) with the count of all rows."""
    size = min(size, most)
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def zero_filled_ranking(members: DataFrame, key: str, facts: DataFrame, fact_key: str, aggregates: Mapping[str, Column]) -> DataFrame:
    """Every member with aggregates of its facts, zero where there are none."""
    sums = facts.groupBy(F.col(fact_key).alias(key)).agg(*[c.alias(n) for n, c in aggregates.items()])
    return members.join(sums, key, "left").fillna(0, list(aggregates))


def bands(df: DataFrame, value: Column, edges: Sequence[tuple[str, float]], rest: str) -> DataFrame:
    """Counts by band: the first edge that the value reaches; a null value is in no band."""
    band = F.when(value.isNull(), None)
    for name, least in edges:
        band = band.when(value >= least, name)
    return df.select(band.otherwise(rest).alias("band")).filter("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def spine_counts(df: DataFrame, value: str, spine: Sequence[int]) -> DataFrame:
    """Counts of each value of the spine, zero where there is none."""
    values = df.sparkSession.createDataFrame([(v,) for v in spine], f"{value} int")
    counts = df.groupBy(F.col(value).cast("int").alias(value)).agg(F.count(F.lit(1)).alias("n"))
    return values.join(counts, value, "left").select(value, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def top_rated(items: DataFrame, key: str, reviews: DataFrame, review_key: str, rating: str, k: int = 10) -> DataFrame:
    """The k items with the best average rating among those that have one."""
    rated = reviews.groupBy(F.col(review_key).alias(key)).agg(F.avg(rating).alias("avg_rating"), F.count(F.lit(1)).alias("n_reviews"))
    joined = items.join(rated.filter("avg_rating is not null"), key).withColumn("avg_rating", F.round("avg_rating", 6))
    return top_k(joined, [F.col("avg_rating").desc(), F.col(key)], k)


def success_rate(df: DataFrame, by: str, done: Column, failed: Column) -> DataFrame:
    """100 * completed / (completed + failed) by key, 100 where there are neither."""
    out = df.groupBy(by).agg(F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"))
    return out.withColumn("success_rate", F.round(F.coalesce(F.try_divide(F.col("completed") * 100.0, F.col("completed") + F.col("failed")), F.lit(100.0)), 6))


def vote_tally(votes: DataFrame, by: str, support: Column, weight: Column, threshold: float) -> DataFrame:
    """yes and no weight, approval and outcome; abstentions (null support) are ignored, no votes reject."""
    sums = votes.groupBy(by).agg(F.sum(F.when(support, weight).otherwise(0)).alias("yes"), F.sum(F.when(~support, weight).otherwise(0)).alias("no"), F.count_if(support.isNull()).alias("abstained"))
    approval = F.coalesce(F.try_divide(F.col("yes").cast("double"), F.col("yes") + F.col("no")), F.lit(0.0))
    return sums.withColumn("approval", F.round(approval, 6)).withColumn("outcome", F.when((F.col("yes") + F.col("no") > 0) & (approval >= threshold), "passed").otherwise("rejected"))


def vote_weight(records: Column, unit: int = 100) -> Column:
    """One vote for each unit of records, at least one."""
    return F.greatest(F.lit(1), F.floor(records / unit)).cast("long")


def reward_shares(df: DataFrame, by: str, records: str, amount: float) -> DataFrame:
    sums = df.groupBy(by).agg(F.sum(records).alias("records"))
    weight = share(F.col("records"), F.col("total"))
    return with_total(sums, "records").select(by, F.round(weight * amount, 6).alias("reward"), F.round(weight * 100, 4).alias("weight_pct"))


def compliance_score(checks: DataFrame, by: str, passed: Column, failed: Column) -> DataFrame:
    """passed / all checks in percent, with status bands 90 and 70; checks that neither passed nor failed are pending."""
    out = checks.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"), F.count_if(failed).alias("failed"))
    score = F.col("passed") * 100.0 / F.col("total")
    status = F.when(score >= 90, "compliant").when(score >= 70, "partial").otherwise("non_compliant")
    return out.withColumn("pending", F.col("total") - F.col("passed") - F.col("failed")).withColumn("score", F.round(score, 6)).withColumn("status", status)


#: Percentile ranks by the highest threshold reached, and the rank below all of them, in the two forms in use.
PERCENTILE_RANKS = {"v1": ((90, 95), (75, 75), (50, 50), (25, 25)), "v2": ((90, 90), (75, 75), (50, 50), (25, 25), (10, 10))}
PERCENTILE_FLOOR = {"v1": 10, "v2": 0}


def percentile_rank(value: Column, thresholds: Mapping[int, Column], form: str) -> Column:
    """Rank of a value against a benchmark's thresholds p10 to p90."""
    out = F.when(value.isNull(), None)
    for p, rank in PERCENTILE_RANKS[form]:
        out = out.when(value >= thresholds[p], rank)
    return out.otherwise(PERCENTILE_FLOOR[form]).cast("int")


def rule_alerts(metrics: DataFrame, key: str, names: Sequence[str], rules: DataFrame) -> DataFrame:
    """Rules broken by each row's metrics: metrics are unpivoted and meet the rules by name."""
    long = metrics.unpivot([key], list(names), "metric", "value")
    holds = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).when(F.col("op") == "<=", F.col("value") <= F.col("bound")).when(F.col("op") == ">", F.col("value") > F.col("bound")).when(F.col("op") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") == F.col("bound"))
    return long.join(rules, "metric").filter(~holds).select(key, "metric", "op", "bound", "severity", "value")


def two_sided_semi(df: DataFrame, left: str, right: str, members: DataFrame, member: str) -> DataFrame:
    """Rows of which either side is a member."""
    keys = members.select(F.col(member).alias("_m")).distinct()
    flagged = df.join(keys.withColumn("_l", F.lit(True)), df[left] == F.col("_m"), "left").drop("_m")
    flagged = flagged.join(keys.withColumn("_r", F.lit(True)), flagged[right] == F.col("_m"), "left").drop("_m")
    return flagged.filter("_l or _r").drop("_l", "_r")


def nested(parents: DataFrame, key: str, children: DataFrame, child_key: str, fields: Sequence[str], alias: str) -> DataFrame:
    """Parents with a sorted array of their children, empty where there are none."""
    grouped = children.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(alias))
    return parents.join(grouped, key, "left").withColumn(alias, F.coalesce(alias, F.array().cast(grouped.schema[alias].dataType)))


def previous_value(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, default: object = None) -> Column:
    return F.lag(column, 1, default).over(Window.partitionBy(*by).orderBy(*order))


def chain_breaks(df: DataFrame, by: str, order: Sequence[str], previous: str, current: str) -> DataFrame:
    """Validity of each hash chain: every event must name its predecessor's hash, the first one an empty string."""
    linked = F.col(previous) == F.lag(current, 1, "").over(Window.partitionBy(by).orderBy(*order))
    return df.select(by, linked.alias("linked")).groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("linked")).alias("breaks"), F.bool_and("linked").alias("valid"))


def latest(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row of each key, without sorting groups."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(by).agg(last.alias("_last")).select(by, "_last.*")


def apply_filters(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Conjunction of declarative filters: name, name__gte, __lte, __gt, __lt, __in, __icontains, __iexact, __isnull, __year, __month, __contains."""
    for key, wanted in spec.items():
        name, _, how = key.partition("__")
        c = F.col(name)
        tests = {
            "": lambda: c == wanted, "gte": lambda: c >= wanted, "lte": lambda: c <= wanted, "gt": lambda: c > wanted, "lt": lambda: c < wanted,
            "in": lambda: c.isin(*wanted), "icontains": lambda: F.contains(F.lower(c), F.lit(str(wanted).lower())), "iexact": lambda: F.lower(c) == str(wanted).lower(),
            "isnull": lambda: c.isNull() if wanted else c.isNotNull(), "year": lambda: F.year(c) == wanted, "month": lambda: F.month(c) == wanted, "contains": lambda: F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(c, w)),
        }
        df = df.filter(tests[how]())
    return df


def segments_by_quintile(df: DataFrame, key: str, column: str, bins: int = 5, descending: bool = False) -> DataFrame:
    """1-based quantile bin of each row by linear percentile edges, right-closed; edges are one broadcast row."""
    edges = percentile_row(df, {"edges": F.col(column)}, [k / bins for k in range(1, bins)])
    n = F.size(F.filter("edges", lambda e: e < F.col(column)))
    bin_ = (F.lit(bins) - n) if descending else (n + 1)
    return df.crossJoin(F.broadcast(edges)).select(key, bin_.cast("int").alias(f"{column}_bin"))


def due_retries(deliveries: DataFrame, attempts: str, due: str, key: str, now: Column, most_attempts: int, batch: int) -> DataFrame:
    """The next batch of a retry queue: deliveries that are due and have attempts left, those due longest first."""
    return deliveries.filter((F.col(due) <= now) & (F.col(attempts) < most_attempts)).orderBy(due, key).limit(batch)
