"""Positions, running sums and order statistics over whole tables, without moving a table to one task.

A table is dealt to range partitions once and written, so that every later step
sees the same partitions; sums of partitions are a small table of offsets, and
rows only meet within their partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """df with, for each name, the sum of an expression over the rows before this one in order (0 at the first).

    Rows that tie in every expression of order are numbered in an arbitrary but
    fixed order. One window goes over partitions, whose number is a setting.
    """
    part, at, n = free_name(df, "_part"), free_name(df, "_at"), 0
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ranged")
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offset = {name: free_name(df, f"_offset{n + k}") for k, name in enumerate(sums)}
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(offset[name]) for name, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(part), *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(o) for o in offset.values()])
    numbered = ranged.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(offsets), part)
    return numbered.select(*df.columns, *[(F.col(name) + F.col(o)).alias(name) for name, o in offset.items()])


def row_numbers(df: DataFrame, order: Sequence[str | Column], alias: str = "_row") -> DataFrame:
    """df with each row's position in order, from 0."""
    return running_sums(df, order, {alias: F.lit(1).cast("long")})


#: Cells into which one pass cuts the range of a column.
CELLS = 4096


def order_statistics(df: DataFrame, columns: Mapping[str, Column], fractions: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linear percentiles of each column; null and NaN are left out, a column without values gives nulls.

    Ranks are found by refining a histogram: every pass counts CELLS equal cells of
    the intervals that still hold a wanted rank, for all columns at once. Cells are
    counted before the shuffle, so a task sends at most CELLS rows per interval.
    An interval is done when its values are all equal.
    """
    names = list(columns)
    values = df.select(*[columns[c].cast("double").alias(f"v{k}") for k, c in enumerate(names)])
    values = values.select(*[F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)).alias(c) for c in values.columns])
    first = values.agg(*[x for k in range(len(names)) for x in (F.count(f"v{k}").alias(f"n{k}"), F.min(f"v{k}").alias(f"lo{k}"), F.max(f"v{k}").alias(f"hi{k}"))]).first()
    found: dict[tuple[int, int], float] = {}
    wanted: dict[tuple[int, float, float], tuple[int, set[int]]] = {}  # interval -> (rows below it, ranks inside)
    for k in range(len(names)):
        if n := first[f"n{k}"]:
            ranks = {r for q in fractions for r in (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1))}
            wanted[k, first[f"lo{k}"], first[f"hi{k}"]] = (0, ranks)
    while wanted:
        for (k, lo, hi), (_, ranks) in list(wanted.items()):
            if lo == hi:
                found |= {(k, r): lo for r in ranks}
                del wanted[k, lo, hi]
        if not wanted:
            break
        listed = list(wanted)
        tests = []
        for i, (k, lo, hi) in enumerate(listed):
            v, half = F.col(f"v{k}"), hi / 2 - lo / 2
            inner = F.least(F.lit(CELLS - 1), F.floor((v / 2 - lo / 2) / half * CELLS)).cast("int") if 0 < half < float("inf") else F.lit(1)
            cell = F.when(v == lo, 0).when(v == hi, CELLS - 1).otherwise(inner)  # so that every pass cuts the interval
            tests.append(F.when((v >= lo) & (v <= hi), F.struct(F.lit(i).alias("i"), cell.alias("cell"), v.alias("v"))))
        hits = values.select(F.explode(F.array_compact(F.array(*tests))).alias("h")).select("h.*")
        counts = hits.groupBy("i", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most CELLS rows for each wanted interval
        following: dict[tuple[int, float, float], tuple[int, set[int]]] = {}
        for i, key in enumerate(listed):
            below, ranks = wanted[key]
            for r in sorted((r for r in counts if r["i"] == i), key=lambda r: r["lo"]):
                inside = {x for x in ranks if below <= x < below + r["n"]}
                if inside:
                    following[key[0], r["lo"], r["hi"]] = (below, inside)
                below += r["n"]
        wanted = following
    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(names):
        n = first[f"n{k}"]
        out[c] = [_between(found, k, q * (n - 1), n) for q in fractions] if n else [None] * len(fractions)
    return out


def _between(found: Mapping[tuple[int, int], float], k: int, at: float, n: int) -> float:
    low, share = found[k, int(at)], at - int(at)
    return low + (found[k, min(n - 1, int(at) + 1)] - low) * share if share else low


def percentile_row(df: DataFrame, columns: Mapping[str, Column], fractions: Sequence[float]) -> DataFrame:
    """One row with an array of exact percentiles for each name."""
    found = order_statistics(df, columns, fractions)
    kind = "array<double>"
    return df.sparkSession.range(1).select(*[F.array(*[F.lit(v) for v in found[c]]).cast(kind).alias(c) for c in columns])


def most_frequent(df: DataFrame, column: Column) -> DataFrame:
    """One row, mode: the most frequent value, the smallest on ties; none without values. Values are counted in parallel."""
    counts = df.select(column.alias("mode")).filter("mode is not null").groupBy("mode").agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.col("_n").desc(), "mode").limit(1).select("mode")
