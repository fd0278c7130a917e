"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot when it holds at least one row in so many; so there are at most this many hot keys.
HOT_KEYS = 1000


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, n_rows: int, count: str) -> DataFrame:
    """Inner join of ``rows`` with a ``lookup`` unique on ``key``, where ``lookup[count]`` is the
    number of rows with that key and ``n_rows`` the number of all rows.

    Keys with at least ``n_rows / HOT_KEYS`` rows are at most HOT_KEYS many, whatever the data; only
    that slice is broadcast, so rows of a hot key are matched where they lie. All other keys hold
    under a thousandth of the rows each and go through a shuffle join. Every row takes exactly one
    of the two ways. Null keys match nothing. ``count`` is dropped from the result.
    """
    least = max(2, -(-n_rows // HOT_KEYS))
    hot = lookup.where(F.col(count) >= least).drop(count)
    cold = lookup.where(F.col(count) < least).drop(count)
    hot_rows = rows.join(F.broadcast(hot), key)
    return hot_rows.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key))
