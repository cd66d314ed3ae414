"""Rank columns; the tie rule is part of the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _part(by: list[str]):
    return Window.partitionBy(*[F.col(b) for b in by]) if by else Window.partitionBy(F.lit(0))


def average_rank(value: str, by: list[str], descending: bool = True) -> Column:
    """Ties share the mean of their places; nulls come last."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    tied = F.count("*").over(Window.partitionBy(*by, value) if by else Window.partitionBy(value))
    return F.rank().over(_part(by).orderBy(order)) + (tied - 1) / F.lit(2.0)


def min_rank(value: str, by: list[str]) -> Column:
    """Ties share the first of their places."""
    return F.rank().over(_part(by).orderBy(F.col(value).desc_nulls_last()))


def place(value: str, by: list[str], *tiebreak: Column) -> Column:
    """Every row has a place of its own: falling value, then the tie-break."""
    return F.row_number().over(_part(by).orderBy(F.col(value).desc_nulls_last(), *tiebreak))
