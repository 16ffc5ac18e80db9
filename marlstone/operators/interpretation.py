"""What a fitted model makes of its columns: permutation importance and partial dependence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .ordering import row_numbers

Predict = Callable[[Mapping[str, Column]], Column]


def squared_error(y: Column, predicted: Column) -> Column:
    return F.avg(F.pow(y - predicted, 2))


def permutation_importance(df: DataFrame, key: str, columns: Sequence[str], target: str, predict: Predict, repeats: int = 5, seed: int = 0, loss: Callable[[Column, Column], Column] = squared_error) -> DataFrame:
    """feature, importance, deviation: how much the loss grows, on average over repeats, when a column's values are dealt anew among the rows.

    Rows are numbered once by key and, for every column and repeat, by the MD5 of
    seed, column, repeat and key; a row takes the value of the row whose second
    number is its first. All columns and repeats are numbered and joined together.
    The deviation is that of the repeats (population). Keys are unique and not null.
    """
    rows = materialize(df.select(F.col(key).alias("_key"), F.col(target).alias("_y"), *columns), "rows")
    n = rows.count()
    own = materialize(row_numbers(rows, ["_key"], "_at"), "own")
    values = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    dealt = rows.select("_key", F.explode(values).alias("_x")).select("_key", "_x._f", "_x._v", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_f") + 1)
    turn = F.md5(F.concat_ws(":", F.lit(seed), names, F.col("_r"), F.col("_key")))
    numbered = row_numbers(dealt, ["_f", "_r", turn, "_key"], "_to")
    group = F.col("_f") * repeats + F.col("_r")
    mixed = own.join(numbered.select("_f", "_r", "_v", (F.col("_to") - group * n).alias("_to")), F.col("_at") == F.col("_to"))
    inputs = {c: F.when(F.col("_f") == i, F.col("_v")).otherwise(F.col(c)) for i, c in enumerate(columns)}
    base = rows.agg(loss(F.col("_y"), predict({c: F.col(c) for c in columns})).alias("_base"))
    each = mixed.groupBy("_f", "_r").agg(loss(F.col("_y"), predict(inputs)).alias("_loss")).crossJoin(F.broadcast(base))  # base is one row
    return each.groupBy("_f").agg(F.avg(F.col("_loss") - F.col("_base")).alias("importance"), F.stddev_pop(F.col("_loss") - F.col("_base")).alias("deviation")).select(names.alias("feature"), "importance", "deviation")


def partial_dependence(df: DataFrame, columns: Sequence[str], feature: str, predict: Predict, grid: Sequence[float]) -> DataFrame:
    """value, mean: the average prediction over all rows with feature set to each value of the grid, in one aggregation."""
    means = [F.avg(predict({c: F.lit(float(v)) if c == feature else F.col(c) for c in columns})) for v in grid]
    row = df.agg(F.array(*[F.struct(F.lit(float(v)).alias("value"), m.alias("mean")) for v, m in zip(grid, means)]).alias("p"))
    return row.select(F.explode("p").alias("p")).select("p.*")
