"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize, new_path, shared_folder

__all__ = ["discard", "free_names", "keep_keyed", "materialize", "maybe_among", "new_path", "same_key", "shared_folder", "text_mark", "written"]


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Whether Spark removes an execution's shuffles when it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """materialize(), and the shuffles that made the table are removed."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_KEY, None)
    conf.set(CLEANUP_KEY, "true")
    try:
        return materialize(df, label)
    finally:
        conf.unset(CLEANUP_KEY) if before is None else conf.set(CLEANUP_KEY, before)


def text_mark(text: Column) -> Column:
    """A 64-bit hash that, with the identifier, leads back to a row's text; a null text has one too."""
    return F.xxhash64(text)


#: Longs of the bitmap that spares most texts a shuffle (1 MB, whatever the number of keys).
BITMAP = 1 << 17


def key_bitmap(keys: DataFrame) -> DataFrame:
    """One row, bitmap: an array of BITMAP longs with a bit for each key (doc_id, mark)."""
    place = _place()
    words = keys.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(BITMAP).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).cast("long").alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bitmap"))


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id", "mark"), F.lit(BITMAP * 64))


def maybe_among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, mark, ...) whose key is among keys, and some others.

    A bitmap of fixed size is broadcast: with many keys it lets more rows through, and no row of keys is lost.
    """
    bitmap = materialize(key_bitmap(keys), "bitmap")
    place, (name,) = _place(), free_names(docs, "bitmap")
    held = F.call_function("shiftright", F.element_at(name, (F.shiftright(place, 6) + 1).cast("int")), (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.crossJoin(F.broadcast(bitmap.withColumnRenamed("bitmap", name))).filter(held).select(docs.columns)


def same_key(df: DataFrame, id_col: str, mark_col: str, other: DataFrame, other_id: str, other_mark: str) -> Column:
    return df[id_col].eqNullSafe(other[other_id]) & (df[mark_col] == other[other_mark])


def keep_keyed(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that stand in classes under another key (doc_id, mark) than their class's (keep_id, keep_mark).

    Of rows that repeat both identifier and text of a class's keeper one stays.
    """
    mark, its_id, its_mark = free_names(docs, "mark", "its_id", "its_mark")
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    key = lambda df: df.select(F.col("doc_id").alias(its_id), F.col("mark").alias(its_mark))
    gone = key(classes.filter(~keeper).select("doc_id", "mark").distinct())
    twice = materialize(key(classes.filter(keeper).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), "repeated")
    marked = docs.withColumn(mark, text_mark(F.col(text_col)))
    rest = marked.join(gone, same_key(marked, id_col, mark, gone, its_id, its_mark), "left_anti")
    if twice.isEmpty():
        return rest.select(docs.columns)
    once = rest.join(twice, same_key(rest, id_col, mark, twice, its_id, its_mark), "left_semi").dropDuplicates([id_col, mark])
    return rest.join(twice, same_key(rest, id_col, mark, twice, its_id, its_mark), "left_anti").unionByName(once).select(docs.columns)
