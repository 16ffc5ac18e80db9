"""Registered queries over the driver's tables, each with the SQL it is compared with."""

from . import clustering, crossfit, ensembles, features, fitting, metrics, model_selection, models, privacy, quality, relational, selection, streams, timeseries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
