"""Extendible hashing of documents into shards below a byte limit.

A document's hash is the first 60 bits of MD5 of its identifier. The directory is
indexed by hash-prefix bits: a bucket of local depth d holds the documents whose
first d bits agree, and only a bucket above the limit splits on bit d + 1. The
directory is computed from byte sums of hash prefixes, a few bits at a time, so
nothing but sums is shuffled and no level needs more than the oversized buckets.

Defined cases: a null text has 0 bytes; a null identifier hashes like the empty
string; rows that repeat an identifier share a bucket. A bucket that cannot fall
below the limit (one long document, one identifier on many rows, or many rows
without one) splits
until its rows are told apart as far as the bits go; it is then returned with
oversized = true at depth MAX_BITS. An empty table gives an empty result. Extra
columns are ignored by assign_shards and kept by write_shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

MAX_BITS = 60
#: Bits by which one pass over the sums of oversized buckets deepens the directory.
STEP = 10


def hash_bits(key: Column) -> Column:
    """60 bits of MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(MAX_BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, shard_bytes, shard_docs, oversized of every bucket; rows has h and n_bytes.

    Each pass sums bytes at the prefixes of the next STEP depths within the
    buckets still above the limit. Byte sums fall with depth, so a bucket's depth
    is the first at which its sum fits.
    """
    total = rows.agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    fits = F.col("shard_bytes") <= limit
    done = [total.filter(fits & (F.col("shard_docs") > 0)).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "shard_bytes", "shard_docs")]
    over = total.filter(~fits).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    for top in range(0, MAX_BITS, STEP):
        deep = min(MAX_BITS, top + STEP)
        over = materialize(over, "oversized")
        if over.isEmpty():
            return _union(done, limit)
        inside = rows.join(over.select(F.col("prefix").alias("over_prefix")), prefix(F.col("h"), top) == F.col("over_prefix"), "left_semi")
        leaves = inside.groupBy(prefix(F.col("h"), deep).alias("leaf")).agg(F.sum("n_bytes").alias("leaf_bytes"), F.count(F.lit(1)).alias("leaf_docs"))
        path = leaves.select("leaf_bytes", "leaf_docs", "leaf", F.explode(F.sequence(F.lit(top + 1), F.lit(deep))).alias("depth"))
        sums = path.groupBy("depth", F.call_function("shiftright", F.col("leaf"), (F.lit(deep) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("leaf_bytes").alias("shard_bytes"), F.sum("leaf_docs").alias("shard_docs"))
        sums = materialize(sums, "sums")
        large = sums.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        roots = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fitting = sums.filter(fits).withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        done.append(fitting.join(large.unionByName(roots), ["depth", "parent"], "left_semi").select("depth", "prefix", "shard_bytes", "shard_docs"))
        over = sums.filter(~fits & (F.col("depth") == deep)).select("depth", "prefix")
        last = sums
    done.append(last.filter(~fits & (F.col("depth") == MAX_BITS)).select("depth", "prefix", "shard_bytes", "shard_docs"))
    return _union(done, limit)


def _union(parts: list[DataFrame], limit: int) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("oversized", F.col("shard_bytes") > limit)


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, depth, prefix, shard (the prefix's bits), shard_bytes, shard_docs, oversized.

    A row finds its bucket by probing the directory at the depths that occur.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col)).alias("h"), text_bytes(F.col(text_col)).alias("n_bytes")), "hashed")
    buckets = materialize(directory(rows, limit), "directory")
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]  # at most MAX_BITS + 1 rows
    probes = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>"))).withColumn("prefix", prefix(F.col("h"), F.col("depth")))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return probes.join(buckets, ["depth", "prefix"]).select("doc_id", "n_bytes", "depth", "prefix", bits.alias("shard"), "shard_bytes", "shard_docs", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet with one folder per shard."""
    shards = assign_shards(docs, limit, id_col, text_col).select(F.col("doc_id").alias(id_col), F.concat(F.lit("s"), F.col("shard")).alias("shard")).dropDuplicates([id_col])
    docs.join(shards, docs[id_col].eqNullSafe(shards[id_col])).drop(shards[id_col]).repartition("shard").write.partitionBy("shard").parquet(path)
