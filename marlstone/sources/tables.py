"""Scans and sinks: CSV, JSON, Parquet, ORC, JDBC, in-memory rows and generated rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hash_uniform


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; types are inferred only when no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, partitions: int) -> DataFrame:
    """A table read in ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions).load()


def as_json_rows(df: DataFrame, alias: str = "json") -> DataFrame:
    """One JSON document per row, for REST sinks."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(alias))


def write_params(params: Mapping[str, object], spark: SparkSession, path: str) -> None:
    """Fitted parameters or weights as JSON."""
    import json

    spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in params.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str) -> dict:
    import json

    return {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(path).collect()}


def generate(spark: SparkSession, n: int, features: Sequence[Mapping], seed: int = 42) -> DataFrame:
    """n rows of uniform features by kind: float and int in [low, high], bool by rate, category from values.

    Values follow from row number and seed, so partitions can be recomputed.
    """
    rows = spark.range(n)

    def made(k: int, f: Mapping) -> Column:
        u = hash_uniform(F.col("id"), seed * 1000 + k)
        if f["kind"] == "bool":
            return u < f.get("rate", 0.5)
        if f["kind"] == "category":
            return F.element_at(F.array(*map(F.lit, f["values"])), (F.floor(u * len(f["values"])) + 1).cast("int"))
        low, high = f.get("low", 0), f.get("high", 1)
        return F.floor(low + u * (high - low + 1)).cast("int") if f["kind"] == "int" else low + u * (high - low)

    record = F.concat(F.lit("REC-"), F.upper(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), 1, 8)))
    return rows.select(record.alias("record_id"), *[made(k, f).alias(f["name"]) for k, f in enumerate(features)])


def split_members(df: DataFrame, key: str, members: int, seed: int = 0) -> DataFrame:
    """Rows dealt to members by a hash of their key."""
    return df.withColumn("member", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(members)).cast("int"))
