"""Selecting and filtering in one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, condition: Column, *columns: str | Column) -> DataFrame:
    """The columns of the rows that meet a condition on computed columns.

    Spark moves a filter below the projections it depends on and so computes those twice, or
    many times over where they build on each other. Written as zero or one row per input row,
    everything is computed once. Use plain `where` for conditions on stored columns.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))
