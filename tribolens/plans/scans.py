"""Ordered computations that no single task has to do for a whole key.

A plain `Window.partitionBy(key)` sends every row of a key to one task. Three shapes avoid that here:

* `running_totals`: totals are first aggregated per (key, segment), the few segment rows are accumulated, and
  rows are only ordered inside their segment.
* `ranged_totals`: the same where no column gives segments of even size; they are cut by number of rows.
* `split_series`: rows of a key are cut at hash-chosen rows, so a key of n rows is cut about
  n / rows_per_segment times and a small key not at all. Neighbouring rows needed by `lag` and rolling frames
  are copied over the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribolens.plans.storage import materialise

ROWS_PER_SEGMENT = 1_000_000
FIRST = -(1 << 62)  # sorts ahead of every real position


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the left key columns."""
    renamed = right.select(*[F.col(k).alias("_r_" + k) for k in keys],
                           *[k for k in right.columns if k not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col("_r_" + key))
    return left.join(renamed, condition, how).drop(*["_r_" + k for k in keys])


def running_totals(
    rows: DataFrame,
    keys: list[str],
    segment: Column,
    order: str,
    totals: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running totals over `order`, including rows with an equal value or (long columns only) excluding them.

    `totals` maps an output name to ("sum" | "max", value). `segment` must not decrease as `order` grows.
    """
    fold = {"sum": F.sum, "max": F.max}
    names = list(totals)
    base = rows.select("*", segment.alias("_seg"), F.col(order).alias("_at"), F.lit(False).alias("_carry"),
                       *[value.alias("_v_" + name) for name, (_, value) in totals.items()])
    whole = base.groupBy(*keys, "_seg").agg(*[fold[totals[n][0]]("_v_" + n).alias("_v_" + n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # What earlier segments add up to enters each segment as one row ahead of all others.
    carried = whole.select(*keys, "_seg", F.lit(FIRST if not inclusive else None).alias("_at"), F.lit(True).alias("_carry"),
                           *[fold[totals[n][0]]("_v_" + n).over(earlier).alias("_v_" + n) for n in names])
    by_segment = Window.partitionBy(*keys, "_seg")
    if inclusive:
        inside = by_segment.orderBy(F.col("_carry").desc(), "_at").rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
    else:
        inside = by_segment.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    return (
        base.unionByName(carried, allowMissingColumns=True)
        .select(*rows.columns, "_carry", *[fold[totals[n][0]]("_v_" + n).over(inside).alias(n) for n in names])
        .filter(~F.col("_carry")).drop("_carry")
    )


def ranged_totals(
    rows: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """`running_totals` over segments of about `rows_per_segment` rows, whatever their values.

    A distributed prefix scan: range partitions on (keys, order), totals per partition, and what earlier partitions add up to carried
    into each. Rows with equal keys and order share a segment, so callers aggregate frequent values first. The segments are
    written once, which fixes their numbers.
    """
    rows = materialise(rows)
    segments = max(1, -(-rows.count() // rows_per_segment))
    cut = materialise(rows.repartitionByRange(segments, *keys, order).withColumn("_range", F.spark_partition_id()))
    return running_totals(cut, keys, F.col("_range"), order, totals, inclusive).drop("_range")


def position(time: str, row_key: str) -> Column:
    """Sort struct of a row: undated rows last, then by time, then by the unique row key."""
    return F.struct(F.col(time).isNull().alias("undated"), F.col(time).alias("at"), F.col(row_key).alias("row"))


def split_series(
    rows: DataFrame, keys: list[str], time: str, row_key: str, depth: int, carried: list[str],
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Rows with `_seg`, within which a window over (keys, `_seg`) sees everything it needs.

    `_seg` is NULL for a key that is not cut, otherwise a struct that orders the segments of the key. Ahead of every
    segment stand copies (`_copy` true) of the `depth` rows before it, with `_before`: how many rows of the key
    precede the segment. Besides keys, time and row key only the `carried` columns are filled on copies.

    A row is a cut when the hash of its unique key is a multiple of `rows_per_segment`. The cuts are therefore the
    same on every evaluation and number about 1 / rows_per_segment of the table (one in a million); whether their
    two tables are broadcast is left to the optimizer, which knows their written size. They are found first, in one pass over the key columns; without any the rows stay as they
    are. A cut key is divided by day, and inside a day by the cuts lying in it.
    """
    day = F.to_date(time)
    cuts = materialise(
        rows.filter(F.pmod(F.xxhash64(row_key), F.lit(rows_per_segment)) == 0)
        .select(*keys, day.alias("_day"), position(time, row_key).alias("_at")))
    part_type = "struct<undated:boolean,day:date,part:int>"
    if cuts.isEmpty():
        return rows.withColumns({"_seg": F.lit(None).cast(part_type), "_copy": F.lit(False),
                                 "_before": F.lit(None).cast("long")})
    cut_keys = cuts.select(*keys).distinct().withColumn("_hot", F.lit(True))
    cut_days = cuts.groupBy(*keys, "_day").agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
    marked = join_on(rows.withColumn("_day", day), cut_keys, keys)
    marked = join_on(marked, cut_days, [*keys, "_day"])
    part = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("_cuts", lambda cut: cut <= position(time, row_key))))
    segment = F.struct(F.col("_day").isNull().alias("undated"), F.col("_day").alias("day"), part.alias("part"))
    split = marked.withColumn("_seg", F.when(F.col("_hot"), segment)).drop("_hot", "_cuts", "_day")
    copies = _rows_before_segments(split, keys, time, row_key, depth, carried)
    return split.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)


def _rows_before_segments(
    split: DataFrame, keys: list[str], time: str, row_key: str, depth: int, carried: list[str]
) -> DataFrame:
    """Copies of the last rows before every segment of the cut keys."""
    hot = split.filter(F.col("_seg").isNotNull()).select(*keys, "_seg", time, row_key, *carried)
    newest = Window.partitionBy(*keys, "_seg").orderBy(F.col(time).desc_nulls_first(), F.col(row_key).desc())
    tail_rows = hot.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= depth)
    row = F.struct(position(time, row_key).alias("_at"), *carried)
    tails = tail_rows.groupBy(*keys, "_seg").agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    sizes = hot.groupBy(*keys, "_seg").agg(F.count("*").alias("_size"))
    segments = join_on(sizes, tails, [*keys, "_seg"])
    by_segment = Window.partitionBy(*keys).orderBy("_seg")
    none = F.slice("_tail", 1, 0)
    history = F.concat(*[F.coalesce(F.lag("_tail", n).over(by_segment), none) for n in range(depth, 0, -1)])
    earlier = F.sum("_size").over(by_segment.rowsBetween(Window.unboundedPreceding, -1))
    last_rows = F.slice("_history", F.greatest(F.size("_history") - depth + 1, F.lit(1)), depth)
    return (
        segments.select(*keys, "_seg", history.alias("_history"), earlier.alias("_before"))
        .select(*keys, "_seg", "_before", F.explode(last_rows).alias("_r"))
        .select(*keys, "_seg", "_before", F.col("_r._at.at").alias(time), F.col("_r._at.row").alias(row_key),
                *[F.col("_r." + name).alias(name) for name in carried], F.lit(True).alias("_copy"))
    )
