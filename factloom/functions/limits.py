"""Limits that may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first(df: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows of an ordered answer; None: all of them."""
    return df if limit is None else df.limit(limit)
