"""Questions about a physical plan, for tests and reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> int:
    """Shuffles of the plan, broadcasts not counted."""
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|round|Single)", physical_plan(df)))


def has_python(df: DataFrame) -> bool:
    return bool(re.search(r"Python|Pandas|Arrow", physical_plan(df)))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def scanned_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", physical_plan(df))
