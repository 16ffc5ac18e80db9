"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in an order shuffled by hash. A copy of
a document gets the virtual finish time (words of its queue up to and including
it) / (target of its source). All copies are sorted by finish time and taken
until the total budget is used up. A source whose target exceeds its size is
queued again, up to three times, so no document is taken more than three times.

Running sums do not need one task per source or one global sort: a queue is cut
into SLICES hash ranges and virtual time into bins of equal width; sums per
slice or bin are small tables, and rows only meet within a slice or bin. Sources
are ranked and filled by running sums over range partitions, so they may be many.
Queues are only drawn up to the virtual time by which the budget is sure to be
used up, a little above 1.

Defined cases: a null text has size 0; sources sort by code point, null last, and
are one source each (null included); sources without words have target 0;
documents without words are never taken but keep their row with taken = 0;
rows that repeat an identifier, or have none, are separate rows, ordered by a hash
of their texts; rows that also repeat the text are alike, and which of them is
taken more often is left open; extra columns are ignored by fair_mix() and kept
by mixed(), under any names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers, running_sums
from .storage import free_names, materialize, text_mark

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order, repeating.
WEIGHTS = [5.0, 2.0, 1.0]
MAX_COPIES = 3
#: Hash ranges of a queue, and bins of a unit of virtual time.
SLICES = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Water filling: sources stop at most * size; the level at which the others
    stand is found from running sums over sources ordered by size / weight, the
    order in which they reach their stop.
    """
    placed = row_numbers(sizes, [F.col("source").isNull(), "source"], "place")
    weighted = placed.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    stops = weighted.withColumn("level", F.lit(most) * F.col("source_size") / F.col("w"))
    stops = running_sums(stops, ["level", "place"], {"full": F.lit(most) * F.col("source_size"), "before": F.col("w")})
    totals = stops.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all"))
    # the level if the sources before this one are full and no other is
    filled = stops.crossJoin(F.broadcast(totals)).withColumn("fill", (F.col("total") - F.col("full")) / (F.col("all") - F.col("before")))
    level = filled.filter("fill <= level").agg(F.min_by("fill", F.struct("level", "place")).alias("at"))
    found = stops.crossJoin(F.broadcast(level))
    return found.select("source", "source_size", F.least(F.col("w") * F.coalesce("at", "level"), most * F.col("source_size")).cast("double").alias("target"))


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, mark, size, source_size, target, copies, taken, first_finish.

    first_finish is the virtual time at which the first copy leaves its queue:
    the order of the mix; mark is a hash of the text.
    """
    return _mix(docs.withColumn(free_names(docs, "row")[0], F.monotonically_increasing_id()), free_names(docs, "row")[0], id_col, text_col, source_col, seed).drop("row")


def _mix(docs: DataFrame, row_col: str, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """fair_mix() with row, the value of row_col."""
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_mark(F.col(text_col)).alias("mark"), word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows, "sizes")
    goals = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    queued = materialize(_queued(rows, goals, seed), "queued")
    return _taken(_drawn(queued, rows, goals), rows, goals)


def _queued(rows: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """A row for each document with words: its end in its queue (words), and how often the queue may be drawn."""
    shuffled = rows.filter("size > 0").withColumn("turn", F.xxhash64("doc_id", F.lit(seed))).withColumn("slice", F.pmod(F.call_function("shiftright", F.col("turn"), F.lit(44)), F.lit(SLICES)).cast("int"))
    sums = shuffled.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("q"), F.col("slice").alias("at"), F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = shuffled.withColumn("within", within)
    queued = queued.join(offsets, queued["source"].eqNullSafe(offsets["q"]) & (queued["slice"] == offsets["at"])).drop("q", "at")
    goal = goals.select(F.col("source").alias("q"), "source_size", "target")
    queued = queued.join(F.broadcast(goal) if _few(goals) else goal, queued["source"].eqNullSafe(goal["q"])).drop("q")
    draws = F.least(F.lit(MAX_COPIES), F.ceil(F.col("target") / F.col("source_size")) + 1).cast("int")
    return queued.select("row", "source", "turn", "doc_id", "mark", "size", "source_size", "target", (F.col("offset") + F.col("within")).alias("end"), draws.alias("draws"))


def _drawn(queued: DataFrame, rows: DataFrame, goals: DataFrame) -> DataFrame:
    """A row for each copy that may be taken: row, size, finish (virtual time), copy.

    By time 1 every source has given its target but for one document; the largest
    documents of the sources that do not stop at their copies bound the time by
    which the rest of the budget is given. The bound is checked and doubled where
    queues end before it.
    """
    largest = rows.groupBy("source").agg(F.max("size").alias("largest")).withColumnRenamed("source", "s")
    open_ = goals.join(largest, goals["source"].eqNullSafe(largest["s"])).filter(F.col("target") < MAX_COPIES * F.col("source_size"))
    late = open_.agg((F.sum("largest") / F.sum("target")).alias("late")).first()["late"] or 0.0
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).first()["budget"]
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("draws"))))
    finish = ((F.col("copy") - 1) * F.col("source_size") + F.col("end")) / F.col("target")
    copies = copies.select("row", "source", "turn", "doc_id", "mark", "size", "copy", finish.alias("finish"))
    until = 1 + late + 1e-9
    while True:
        drawn = materialize(copies.filter(F.col("finish") <= until).withColumn("bin", F.floor(F.col("finish") * SLICES)), "finish")
        if (drawn.agg(F.sum("size")).first()[0] or 0) >= budget or copies.filter(F.col("finish") > until).isEmpty():
            return drawn
        until *= 2


def _few(goals: DataFrame, most: int = 10_000) -> bool:
    return goals.limit(most + 1).count() <= most


def _taken(copies: DataFrame, rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Sort by finish time and truncate at the budget, the sum of all sizes."""
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    bins = copies.groupBy("bin").agg(F.sum("size").alias("bin_size"))
    bins = running_sums(bins, ["bin"], {"offset": F.col("bin_size")}).crossJoin(F.broadcast(budget))
    bins = materialize(bins, "bins")  # at most SLICES rows for each unit of virtual time
    whole = copies.join(bins.filter("offset + bin_size <= budget").select("bin"), "bin")
    edge = copies.join(bins.filter("offset < budget and offset + bin_size > budget").select("bin", "offset", "budget"), "bin")
    order = Window.partitionBy("bin", "cell").orderBy("finish", "source", "turn", "doc_id", "mark", "row", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the one bin that holds the budget's end is cut once more into cells of virtual time
    edge = edge.withColumn("cell", F.floor((F.col("finish") * SLICES - F.col("bin")) * SLICES))
    cells = edge.groupBy("bin", "cell").agg(F.sum("size").alias("cell_size"))
    cells = cells.select("bin", "cell", F.coalesce(F.sum("cell_size").over(Window.partitionBy("bin").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cell_offset"))
    edge = edge.withColumn("run", F.sum("size").over(order)).join(cells, ["bin", "cell"]).filter("offset + cell_offset + run <= budget")
    cols = ["row", "size", "finish"]
    took = whole.select(cols).unionByName(edge.select(cols)).groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("taken"), F.min("finish").alias("first_finish"))
    out = rows.join(took, "row", "left")
    goal = goals.select(F.col("source").alias("q"), "source_size", "target")
    out = out.join(F.broadcast(goal) if _few(goals) else goal, out["source"].eqNullSafe(goal["q"]))
    zero = F.lit(0).cast("long")
    return out.select("row", "doc_id", "source", "mark", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("copies", zero).alias("copies"), F.coalesce("taken", zero).cast("long").alias("taken"), "first_finish")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all columns of docs.

    Rows are numbered in a written table, so that rows which agree in identifier,
    source and text keep their own columns.
    """
    row, its_row, copies, copy = free_names(docs, "row", "its_row", "copies", "copy")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    took = _mix(numbered, row, id_col, text_col, source_col, seed).filter("copies > 0").select(F.col("row").alias(its_row), F.col("copies").cast("int").alias(copies))
    rows = numbered.join(took, numbered[row] == took[its_row])
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
