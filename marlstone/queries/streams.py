"""Streams drained over the event table, and generated sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..sources import tables
from ..sources.shared import new_path
from ..streaming import counters
from .registry import query, table


_folder = new_path
#: User of the far-off row.
NOBODY = -1


def _events(spark, sf_dir):
    """The event table as a stream, with a far-off row that lets every real window close."""
    schema = table(spark, sf_dir, "events").schema
    far = {"event_id": -1, "ts": dt.datetime(2200, 1, 1), "user_id": NOBODY}
    path = _folder(spark, "far")
    spark.createDataFrame([tuple(far.get(f.name) for f in schema)], schema).write.parquet(path)
    return counters.event_stream(spark, f"{sf_dir}/events.parquet*", schema).unionByName(counters.event_stream(spark, path, schema))


def _of_users(df):
    return df.filter(F.col("user_id") != NOBODY)


@query("SELECT user_id, event_type, count(*) AS n, floor(value / 25)::BIGINT AS bin FROM events GROUP BY ALL", name="stream_histogram")
def stream_histogram(spark, sf_dir):
    rows = _events(spark, sf_dir)
    running = rows.groupBy("user_id", "event_type", F.floor(F.col("value") / 25).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _of_users(counters.drain(running, _folder(spark, "histogram"), "complete"))


@query("""SELECT user_id, ts::DATE AS day, count(*) AS requests, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2""")
def stream_daily_usage(spark, sf_dir):
    out = counters.drain(counters.daily_usage(_events(spark, sf_dir), "user_id", "value"), _folder(spark, "daily"))
    return _of_users(out).withColumn("volume", F.round("volume", 4))


@query("""SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_minute_counts(spark, sf_dir):
    out = counters.drain(counters.minute_counts(_events(spark, sf_dir), "user_id"), _folder(spark, "minutes"))
    return _of_users(out).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT user_id, k, min(ts) AS online_from, max(ts) + INTERVAL 6 HOUR AS offline_at, count(*) AS beats FROM s GROUP BY 1, 2)
SELECT user_id, online_from, offline_at, beats FROM w""")
def stream_heartbeat_sessions(spark, sf_dir):
    out = counters.drain(counters.heartbeat_sessions(_events(spark, sf_dir), "user_id", gap="6 hours"), _folder(spark, "sessions"))
    return _of_users(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("online_from", "offline_at")})


@query()
def stream_rate_limit(spark, sf_dir):
    return _of_users(counters.drain(counters.rate_limiter(_events(spark, sf_dir), "user_id", 2, ttl_seconds=3600), _folder(spark, "limits")))


@query()
def generated_transactions(spark, sf_dir):
    features = [{"name": "amount", "kind": "float", "low": 10, "high": 10_000}, {"name": "hour", "kind": "int", "low": 0, "high": 23}, {"name": "merchant", "kind": "category", "values": ["retail", "food", "travel", "online", "atm"]}, {"name": "is_fraud", "kind": "bool", "rate": 0.02}]
    return tables.generate(spark, 10_000, features)


@query("SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}' AS json FROM supplier")
def json_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return rows.select("s_suppkey", F.to_json(F.struct("s_suppkey", "s_name")).alias("json"))


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = _folder(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return tables.read_csv(spark, path, "c_custkey long, c_acctbal double")
