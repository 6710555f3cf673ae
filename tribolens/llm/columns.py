"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, also where it is used inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def small_side(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_ROWS rows; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def join_rows(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, tag), where a null id equals a null id; the keys of `left` stay."""
    right = right.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    met = left["doc_id"].eqNullSafe(right["_id"]) & (left["tag"] == right["_tag"])
    return left.join(right, met, how).drop("_id", "_tag")
