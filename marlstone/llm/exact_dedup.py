"""Exact deduplication through a log-structured merge index of text digests.

Adding documents flushes memtables: Spark's sorter orders each task's digests and
writes them as sorted runs of at most RUN_ROWS rows. Compaction takes one flush
of runs after the other. It keeps one entry for each digest, the row that stays
(most code points, then smallest identifier) with the number of rows. A flush
first probes the Bloom filters of the generations that were merged before: only
digests that a filter may hold are looked up there, all others are new. Merged
entries form the next generation, sorted and with filters of its own; a newer
entry of a digest replaces an older one, and above MOST_GENERATIONS all are
merged into one. Hits (digests with more than one row) are verified byte by byte
against the row that stays; texts that merely share a digest are regrouped by
the text itself, so that results are exact for any digest.

Defined cases: a null text counts as empty; all texts that are empty after
normalisation form one group; rows that repeat an identifier are separate rows
of the group and all are returned; a row without an identifier stays only where
no row of its group has one and as many code points (its keep_id is then null);
extra columns are ignored; empty tables give empty results. Exactly one row of
each group has kept = true.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_groups import groups
from .ship import ship
from .storage import keep_keyed, materialize, maybe_among, new_path, same_key, text_mark

#: The characters that normalisation deletes, [\x20\x09-\x0D].
BLANKS = ["\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d"]
#: Rows of a sorted run, flushes of one batch, and generations that are kept side by side.
RUN_ROWS, FLUSHES, MOST_GENERATIONS = 1 << 20, 2, 4
#: Entries for each filter, bits for each entry, and bits that an entry sets.
ROWS_OF_FILTER, BITS_PER_ROW, PROBES = 1 << 16, 10, 5
#: Rows of a group of copies that share one copy of the kept text during verification.
ROWS_PER_COPY = 512


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def bit_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places for each key in a filter of so many bits."""
    h = keys.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class DigestIndex:
    """LSM index in a shared folder: flushed runs at level 0, generations of merged entries with filters at level 1."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest_hex: int = 64):
        """digest_hex: leading hex digits of SHA-256 used as the key; fewer than 64 only to test collisions."""
        ship(spark)
        self.spark, self.path, self.digest_hex = spark, path or new_path(spark, "digests"), digest_hex
        self.batches = 0
        self.pending: list[str] = []
        self.generations: list[tuple[DataFrame, DataFrame, int]] = []  # entries, filters, number of filters

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flushes: int = FLUSHES) -> None:
        """Flush the digests of docs as sorted runs; the text itself is not copied."""
        text = F.col(text_col)
        rows = docs.select(
            F.col(id_col).alias("doc_id"),
            text_mark(text).alias("mark"),
            F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_points"),
            F.sha2(normalised(text), 256).alias("sha"),
        ).withColumns({"digest": F.substring("sha", 1, self.digest_hex), "row": F.monotonically_increasing_id(), "batch": F.lit(self.batches), "flush": F.spark_partition_id() % flushes})
        path = f"{self.path}/level0/{self.batches}"
        rows.sortWithinPartitions("flush", "digest").write.partitionBy("flush").option("maxRecordsPerFile", RUN_ROWS).parquet(path)
        self.schema = rows.schema
        self.batches += 1
        self.pending.append(path)

    def runs(self) -> DataFrame:
        paths = [f"{self.path}/level0/{b}" for b in range(self.batches)]
        out = self.spark.read.schema(self.schema).parquet(paths[0])
        for path in paths[1:]:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(path))
        return out

    def compact(self) -> DataFrame:
        """Merge the pending flushes into generations, one after the other, and give the entries."""
        for path in self.pending:
            flushed = self.spark.read.schema(self.schema).parquet(path)
            for r in flushed.select("flush").distinct().orderBy("flush").collect():  # a few numbers
                self._merge(flushed.filter(F.col("flush") == r["flush"]))
            if not self.generations:
                self._merge(flushed)  # an empty table is an empty generation
        self.pending = []
        return self.entries()

    def _merge(self, rows: DataFrame) -> None:
        """Partial aggregation runs before the shuffle."""
        best = F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), "mark", (-F.col("batch")).alias("neg_batch"), (-F.col("row")).alias("neg_row"))
        fresh = rows.groupBy("digest").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        if self.generations:
            fresh = materialize(fresh, "fresh")
            maybe = materialize(self._probe(fresh), "maybe")
            old = self._newest(maybe).withColumnsRenamed({"best": "old_best", "group_size": "old_size"})
            fresh = fresh.join(old, "digest", "left").select("digest", F.greatest("best", "old_best").alias("best"), (F.col("group_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"))
        self._append(fresh)
        if len(self.generations) > MOST_GENERATIONS:
            whole, self.generations = self._newest(), []
            self._append(whole)

    def _append(self, entries: DataFrame) -> None:
        written = materialize(entries.repartition("digest").sortWithinPartitions("digest"), "generation")
        n = max(1, -(-written.count() // ROWS_OF_FILTER))
        self.generations.append((written, materialize(self._filters(written, n), "filters"), n))

    def _filters(self, entries: DataFrame, n: int) -> DataFrame:
        """bucket, bits: the Bloom filter of the entries of each of n hash buckets."""
        key = F.xxhash64("digest")

        def build(batches):
            import pyarrow as pa

            for g in groups(batches, 1):
                bits = np.zeros(-(-g.num_rows * BITS_PER_ROW // 8) * 8, np.uint8)
                bits[bit_places(np.asarray(g.column(1)), len(bits)).ravel()] = 1
                yield pa.RecordBatch.from_arrays([g.column(0).slice(0, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "bits"])

        keyed = entries.select(F.pmod(key, F.lit(n)).alias("bucket"), key.alias("key"))
        return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(build, "bucket long, bits binary")

    def _probe(self, fresh: DataFrame) -> DataFrame:
        """The digests of fresh that the filter of some generation may hold."""

        def test(batches):
            import pyarrow as pa

            for g in groups(batches, 1):
                bits = g.column(3).to_pylist()[0]
                digests = g.slice(1 if bits is not None else 0)
                if bits is None or not digests.num_rows:
                    continue
                held = np.unpackbits(np.frombuffer(bits, np.uint8))
                yes = held[bit_places(np.asarray(digests.column(2)), len(held))].all(axis=1)
                yield digests.select(["digest"]).filter(pa.array(yes))

        key, none = F.xxhash64("digest"), F.lit(None).cast("binary").alias("bits")
        found = None
        for _, filters, n in self.generations:
            rows = fresh.select(F.pmod(key, F.lit(n)).alias("bucket"), "digest", key.alias("key"), none)
            rows = rows.unionByName(filters.select("bucket", F.lit("").alias("digest"), F.lit(0).cast("long").alias("key"), "bits"))
            near = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull()).mapInArrow(test, "digest string")
            found = near if found is None else found.unionByName(near)
        return found.distinct()

    def _newest(self, among: DataFrame | None = None) -> DataFrame:
        """digest, best, group_size: the newest entry of each digest."""
        every = None
        for turn, (entries, _, _) in enumerate(self.generations):
            part = (entries if among is None else entries.join(among, "digest", "left_semi")).withColumn("turn", F.lit(turn))
            every = part if every is None else every.unionByName(part)
        if len(self.generations) == 1:
            return every.drop("turn")
        newest = every.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "turn").alias("x"))
        return newest.select("digest", "x.best", "x.group_size")

    def entries(self) -> DataFrame:
        """digest, keep_id, keep_mark, keep_batch, keep_row, group_size."""
        return self._newest().select("digest", (-F.col("best.neg_id")).alias("keep_id"), F.col("best.mark").alias("keep_mark"), (-F.col("best.neg_batch")).alias("keep_batch"), (-F.col("best.neg_row")).alias("keep_row"), "group_size")

    def lookup(self) -> DataFrame:
        """Every indexed row with its group's entry; only rows of hits meet one, the others stand for themselves."""
        hits = materialize(self.entries().filter("group_size > 1"), "hits")
        rows = self.runs().join(hits, "digest", "left")
        alone = F.col("group_size").isNull()
        mine = {"keep_id": "doc_id", "keep_mark": "mark", "keep_batch": "batch", "keep_row": "row"}
        return rows.withColumns({k: F.when(alone, F.col(v)).otherwise(F.col(k)) for k, v in mine.items()}).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))


def _unequal_hits(groups_: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests of hits whose normalised text differs from the kept row's; docs has doc_id, mark, text.

    A bitmap of fixed size spares most texts without a hit the shuffle in which
    texts meet their hits. A group of copies is then dealt over salts, each of
    which gets one copy of the kept text.
    """
    salts = F.ceil(F.col("group_size") / ROWS_PER_COPY).cast("int")
    keeps = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    hits = groups_.filter("group_size > 1").select(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"), "digest", salts.alias("salts"), keeps.alias("keeps")).distinct()
    hits = materialize(hits, "hits")
    some = maybe_among(docs, hits.select(F.col("id_").alias("doc_id"), F.col("mark_").alias("mark")))
    met = some.join(hits, same_key(some, "doc_id", "mark", hits, "id_", "mark_")).select("digest", "salts", "keeps", "doc_id", "mark", normalised(F.col("text")).alias("normal"))
    met = materialize(met, "verified")
    members = met.filter(~F.col("keeps")).select("digest", "normal", F.pmod(F.xxhash64("doc_id", "mark"), F.col("salts")).cast("int").alias("salt"))
    keepers = met.filter("keeps").groupBy("digest").agg(F.first("normal").alias("kept_normal"), F.first("salts").alias("salts"))
    keepers = keepers.select("digest", "kept_normal", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return members.join(keepers, ["digest", "salt"]).filter("normal != kept_normal").select("digest")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, mark, keep_id, keep_mark, group_size, kept, text_sha256."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    index = DigestIndex(docs.sparkSession, digest_hex=digest_hex)
    index.add(docs)
    index.compact()
    found = index.lookup()
    unequal = materialize(_unequal_hits(found, docs).distinct(), "collisions")
    clean = found.join(unequal, "digest", "left_anti") if (collided := not unequal.isEmpty()) else found
    result = clean.select("doc_id", "mark", "keep_id", "keep_mark", "group_size", ((F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch"))).alias("kept"), F.col("sha").alias("text_sha256"))
    return result.unionByName(_regrouped(docs, found, unequal)) if collided else result


def _regrouped(docs: DataFrame, found: DataFrame, unequal: DataFrame) -> DataFrame:
    """Groups of the digests on which verification failed, by the whole text."""
    rows = found.join(unequal, "digest", "left_semi").select(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"), "n_points", "row", "sha")
    rows = docs.join(rows, same_key(docs, "doc_id", "mark", rows, "id_", "mark_")).select("doc_id", "mark", normalised(F.col("text")).alias("normal"), "n_points", "row", "sha").dropDuplicates(["row"])
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), "mark", (-F.col("row")).alias("neg_row"))).alias("best")
    groups_ = rows.groupBy("normal").agg(best, F.count(F.lit(1)).alias("group_size"))
    joined = rows.join(groups_, "normal")
    return joined.select("doc_id", "mark", (-F.col("best.neg_id")).alias("keep_id"), F.col("best.mark").alias("keep_mark"), "group_size", (-F.col("best.neg_row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return verdicts(docs, id_col, text_col, digest_hex).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; one row of each group of equal texts."""
    return keep_keyed(docs, materialize(verdicts(docs, id_col, text_col), "verdict"), id_col, text_col)
