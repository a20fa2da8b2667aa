"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A side of so many rows at most is broadcast; a longer one is shuffled.
ROWS = 2_000_000


def sized(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` for a join: broadcast if it is counted to have at most ``rows`` rows, so that the other side's texts need not move; else dealt by key."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")
