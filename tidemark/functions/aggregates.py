"""Aggregates over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_null(value: Column, order: Column) -> Column:
    """The value that is not null with the lowest order; null if there is none. An aggregate that combines map-side."""
    return F.min_by(value, F.when(value.isNotNull(), order))
