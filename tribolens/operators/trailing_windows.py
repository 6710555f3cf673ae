"""Latest reading, trailing sums and trailing median of an asset up to a moment, exact, with no task above a set number of rows.

Equal questions are asked once: the work is done for distinct (asset, moment) points. An asset with at most `rows_per_task` readings and
points is worked off in one task over its sorted rows, many assets one after the other: one exchange gives every value. The others
are cut into segments of about that many rows, whatever their days, by a range partitioning on (asset, time):

* Sums: a segment tree. A window is the end of its first segment, the start of its last one, and in between a few dyadic nodes, whose
  states are joined on (asset, level, node). Nothing is subtracted, so sums of whole windows stay as exact as plain ones.
* Median: readings are also range-partitioned by (asset, value) into buckets. Each segment counts, for the start and the end of a window,
  its earlier rows per bucket; differences of these counts name the bucket that holds a middle rank, and the rank in it. The
  bucket answers from rank counts by value bits (a wavelet matrix over its rows in order of time). A bucket that many
  windows ask is copied, one copy for each `rows_per_task` questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.plans import scans
from tribolens.plans.storage import materialise

DAY = c.MICROS_PER_DAY
SUM_DAYS, DISTANCE_DAYS, MEDIAN_DAYS = (7, 30, 90), 30, 30
CHUNK_ROWS = 200_000
LEVELS = 40
NO_TIME = -(1 << 62)


class SumTree:
    """Sums over `begin:end` of an array, each from about two nodes a level. NaN counts as missing, a window of none is missing."""

    def __init__(self, values: np.ndarray):
        known = ~np.isnan(values)
        self.known = np.concatenate([[0], np.cumsum(known)])
        self.levels = [np.where(known, values, 0.0)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            even = below if len(below) % 2 == 0 else np.append(below, 0.0)
            self.levels.append(even[::2] + even[1::2])

    def sums(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, left, right = np.zeros(len(begin)), begin.copy(), end.copy()
        for nodes in self.levels:
            open_ = left < right
            take = open_ & (left & 1 == 1)
            total[take] += nodes[left[take]]
            last = open_ & (right & 1 == 1)
            total[last] += nodes[right[last] - 1]
            left, right = (left + 1) >> 1, right >> 1
        return np.where(self.known[end] > self.known[begin], total, np.nan)


class RankCounts:
    """k-th smallest of `begin:end` of an array: zero bits of the value ranks are counted level by level, from the top bit."""

    def __init__(self, values: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in reversed(range(max(len(self.values) - 1, 0).bit_length())):
            zero = (rank >> bit) & 1 == 0
            self.levels.append(np.concatenate([[0], np.cumsum(zero)]))
            rank = np.concatenate([rank[zero], rank[~zero]])

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(begin), np.int64)
        for zeros in self.levels:
            a, b = zeros[begin], zeros[end]
            low = k < b - a
            begin = np.where(low, a, zeros[-1] + begin - a)
            end = np.where(low, b, zeros[-1] + end - b)
            k = np.where(low, k, k - (b - a))
            rank = rank * 2 + ~low
        return self.values[rank]


def first_at(times: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, after: bool = False) -> np.ndarray:
    """First place in the ascending `times[begin:end]` that is at least `wanted` (`after`: above it)."""
    low, high = begin.copy(), end.copy()
    while (low < high).any():
        middle = (low + high) >> 1
        value = times[np.minimum(middle, len(times) - 1)]
        smaller = (low < high) & ((value <= wanted) if after else (value < wanted))
        high = np.where((low < high) & ~smaller, middle, high)
        low = np.where(smaller, middle + 1, low)
    return low


def run_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def column(rows: pa.Table | pa.RecordBatch, name: str, missing: float | int | None = None) -> np.ndarray:
    found = rows.column(name)
    if missing is not None and found.null_count:
        found = found.fill_null(missing)
    return found.to_numpy(zero_copy_only=False) if isinstance(found, pa.Array) else found.to_numpy()


def nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """Apply `work` to runs of sorted rows that end where the key changes, of CHUNK_ROWS at least."""
    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        waiting.append(batch)
        size += batch.num_rows
        if size >= CHUNK_ROWS:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cut = int(run_starts(keys)[-1])
            if cut == 0 and waiting[0].column(key)[0] == batch.column(key)[0]:
                continue
            yield from work(pa.Table.from_batches([*waiting[:-1], batch.slice(0, cut)])).to_batches()
            waiting = [batch.slice(cut)]
            size = waiting[0].num_rows
    if waiting:
        yield from work(pa.Table.from_batches(waiting)).to_batches()


WINDOWS = ("asset_id string, at long, latest_reading long, "
           + "".join(f"operating_hours_{n}d double, " for n in SUM_DAYS) + "distance_30d double, mean_utilization_30d double")


def medians(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Median of the known values of each window."""
    known = ~np.isnan(values)
    place = np.concatenate([[0], np.cumsum(known)])
    begin, end = place[begin], place[end]
    result, some = np.full(len(begin), np.nan), end > begin
    counts, a, b = RankCounts(values[known]), begin[some], end[some]
    if len(a):
        result[some] = (counts.kth(a, b, (b - a - 1) // 2) + counts.kth(a, b, (b - a) // 2)) / 2
    return result


def windows_of(rows: pa.Table) -> pa.Table:
    """All values of the points among rows sorted by asset and time."""
    asset, at, is_point = column(rows, "asset_id"), column(rows, "at"), column(rows, "is_point")
    starts = run_starts(asset)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(asset))))
    readings, points = np.flatnonzero(~is_point), np.flatnonzero(is_point)
    times, own = at[readings], np.searchsorted(run[readings], np.arange(len(starts) + 1))
    begin, limit, moment = own[run[points]], own[run[points] + 1], at[points]
    end = first_at(times, begin, limit, moment, after=True)
    first = {n: first_at(times, begin, end, moment - n * DAY) for n in {*SUM_DAYS, DISTANCE_DAYS, MEDIAN_DAYS}}
    hours, distance = SumTree(column(rows, "hours")[readings]), SumTree(column(rows, "distance")[readings])
    seen = end > begin
    latest = times[np.maximum(end - 1, 0)] if len(times) else np.zeros(len(points), np.int64)
    result = {"asset_id": pa.array(asset[points], pa.string()), "at": moment, "latest_reading": pa.array(latest, pa.int64(), mask=~seen)}
    for n in SUM_DAYS:
        result[f"operating_hours_{n}d"] = nullable(hours.sums(first[n], end))
    result["distance_30d"] = nullable(distance.sums(first[DISTANCE_DAYS], end))
    result["mean_utilization_30d"] = nullable(medians(column(rows, "utilization")[readings], first[MEDIAN_DAYS], end))
    return pa.table(result)


def small_assets(points: DataFrame, readings: DataFrame) -> DataFrame:
    rows = readings.withColumn("is_point", F.lit(False)).unionByName(
        points.withColumn("is_point", F.lit(True)), allowMissingColumns=True)
    rows = rows.select("asset_id", "at", "is_point", "hours", "distance", "utilization")
    return rows.repartition("asset_id").sortWithinPartitions("asset_id", "at").mapInArrow(
        lambda batches: whole_keys(batches, "asset_id", windows_of), WINDOWS)


# Assets cut into segments ---------------------------------------------------------------------------------------------

EDGES = ("asset_id string, segment long, point long, days int, inside boolean, hours double, distance double, seen long")


def segment_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of one segment: per window edge the rows before its end or from its start on, per asset all rows (no point).

    A window whose start lies in the segment of its end is summed whole (`inside`); its start gives no row.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows, segment = pa.Table.from_batches(parts), TaskContext.get().partitionId()
    asset, at, days = column(rows, "asset_id"), column(rows, "at"), column(rows, "days", -1)
    point = column(rows, "point", NO_TIME)
    starts = run_starts(asset)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(asset))))
    readings, edges = np.flatnonzero(days < 0), np.flatnonzero(days >= 0)
    times, own = at[readings], np.searchsorted(run[readings], np.arange(len(starts) + 1))
    trees = [SumTree(column(rows, name)[readings]) for name in ("hours", "distance")]
    begin, limit = own[run[edges]], own[run[edges] + 1]
    is_end = days[edges] == 0
    first = np.where(is_end, begin, first_at(times, begin, limit, at[edges]))
    last = np.where(is_end, first_at(times, begin, limit, at[edges], after=True), limit)
    # An end in this segment, by (run, point).
    ends = edges[is_end]
    order = np.lexsort((point[ends], run[ends]))
    ends = ends[order]
    end_place = last[is_end][order]
    bounds = np.searchsorted(run[ends], np.arange(len(starts) + 1))
    mine = first_at(point[ends], bounds[run[edges]], bounds[run[edges] + 1], point[edges])
    inside = ~is_end & (mine < bounds[run[edges] + 1])
    if len(ends):
        safe = np.minimum(mine, len(ends) - 1)
        inside &= point[ends][safe] == point[edges]
        last = np.where(inside, end_place[safe], last)
    seen = np.where(is_end & (last > first), times[np.maximum(last - 1, 0)] if len(times) else NO_TIME, NO_TIME)
    whole_first, whole_last = own[:-1], own[1:]
    whole_seen = np.where(whole_last > whole_first, times[np.maximum(whole_last - 1, 0)] if len(times) else NO_TIME, NO_TIME)
    a, b = np.concatenate([first, whole_first]), np.concatenate([last, whole_last])
    seen = np.concatenate([seen, whole_seen])
    none = np.arange(len(a)) >= len(edges)
    table = {
        "asset_id": pa.array(np.concatenate([asset[edges], asset[starts]]), pa.string()),
        "segment": np.full(len(a), segment, np.int64),
        "point": pa.array(np.concatenate([point[edges], starts]), pa.int64(), mask=none),
        "days": pa.array(np.concatenate([days[edges], starts]).astype(np.int32), pa.int32(), mask=none),
        "inside": np.concatenate([inside, np.zeros(len(starts), bool)]),
        "hours": nullable(trees[0].sums(a, b)), "distance": nullable(trees[1].sums(a, b)),
        "seen": pa.array(seen, pa.int64(), mask=seen == NO_TIME)}
    yield from pa.table(table).to_batches(CHUNK_ROWS)


def nodes_between(first: Column, last: Column) -> Column:
    """Dyadic nodes (level, node) that cover the segments `first` to `last`, both included."""
    def at_level(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        left = F.ceil(first / size).cast("long")
        right = F.floor((last + 1) / size).cast("long")
        odd = [F.when((left < right) & (F.pmod(side, F.lit(2)) == 1), F.struct(level.alias("level"), node.alias("node")))
               for side, node in ((left, left), (right, right - 1))]
        return F.array_compact(F.array(*odd))

    levels = F.sequence(F.lit(0), F.ceil(F.log2((last - first + 2).cast("double"))).cast("int"))
    return F.flatten(F.transform(levels, at_level))


def segments_needed(rows: DataFrame, rows_per_task: int) -> int:
    return max(1, -(-rows.count() // rows_per_task))


def large_sums(points: DataFrame, readings: DataFrame, rows_per_task: int) -> DataFrame:
    """Sums and latest reading of the points of cut assets."""
    marks = F.array(*[F.struct(F.lit(n).alias("days"), (F.col("at") - n * DAY).alias("place")) for n in (0, *SUM_DAYS)])
    edges = points.select("asset_id", F.col("at").alias("point"), F.explode(marks).alias("e")).select(
        "asset_id", F.col("e.place").alias("at"), "point", "e.days")
    rows = readings.select("asset_id", "at", "hours", "distance").unionByName(edges, allowMissingColumns=True).select(
        "asset_id", "at", "point", "days", "hours", "distance")
    states = materialise(rows.repartitionByRange(segments_needed(rows, rows_per_task), "asset_id", "at")
                         .sortWithinPartitions("asset_id", "at").mapInArrow(segment_states, EDGES))
    segments = states.filter("point is null")
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    top = F.ceil(F.log2((segments.agg(F.max("segment")).first()[0] or 0) + F.lit(2.0))).cast("int")
    nodes = materialise(segments.select("asset_id", "segment", "hours", "distance", levels).filter(F.col("level") <= top).groupBy(
        "asset_id", "level", F.floor(F.col("segment") / F.pow(F.lit(2.0), "level")).cast("long").alias("node")).agg(
            F.sum("hours").alias("node_hours"), F.sum("distance").alias("node_distance")))
    earlier = Window.partitionBy("asset_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = segments.select("asset_id", "segment", F.max("seen").over(earlier).alias("seen_before"))
    ends = states.filter("days = 0").join(before, ["asset_id", "segment"]).select(
        "asset_id", "point", F.col("segment").alias("last"), F.col("hours").alias("end_hours"), F.col("distance").alias("end_distance"),
        F.coalesce("seen", "seen_before").alias("latest_reading"))
    begun = states.filter("days > 0").select("asset_id", "point", "days", "segment", "inside", "hours", "distance")
    windows = materialise(begun.join(ends, ["asset_id", "point"]))
    between = windows.filter("not inside and last > segment + 1").select(
        "asset_id", "point", "days", F.explode(nodes_between(F.col("segment") + 1, F.col("last") - 1)).alias("n"))
    middle = between.select("asset_id", "point", "days", "n.level", "n.node").join(nodes, ["asset_id", "level", "node"]).groupBy(
        "asset_id", "point", "days").agg(F.sum("node_hours").alias("middle_hours"), F.sum("node_distance").alias("middle_distance"))
    summed = windows.join(middle, ["asset_id", "point", "days"], "left")

    def total(name: str) -> Column:
        return F.when(F.col("inside"), F.col(name)).otherwise(
            c.null_skipping_sum(F.col(name), F.col(f"middle_{name}"), F.col(f"end_{name}")))

    return summed.groupBy("asset_id", F.col("point").alias("at")).agg(
        F.max("latest_reading").alias("latest_reading"),
        *[F.max(F.when(F.col("days") == n, total("hours"))).alias(f"operating_hours_{n}d") for n in SUM_DAYS],
        F.max(F.when(F.col("days") == DISTANCE_DAYS, total("distance"))).alias("distance_30d"))


COUNTS = "asset_id string, segment long, point long, is_end boolean, counts array<bigint>"


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per window edge, how many earlier rows of its asset in this segment lie in each bucket of the asset; per asset, all rows."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows, segment = pa.Table.from_batches(parts), TaskContext.get().partitionId()
    asset, at, bucket = column(rows, "asset_id"), column(rows, "at"), column(rows, "bucket", -1)
    point, is_end, buckets = column(rows, "point", NO_TIME), column(rows, "is_end", False), column(rows, "buckets", 0)
    starts = run_starts(asset)
    for begin, end in zip(starts, np.append(starts[1:], len(asset))):
        own = np.arange(begin, end)
        reading, edge = own[bucket[own] >= 0], own[bucket[own] < 0]
        wide = int(buckets[own].max())
        place = np.where(is_end[edge], np.searchsorted(at[reading], at[edge], side="right"), np.searchsorted(at[reading], at[edge]))
        order = np.argsort(place, kind="stable")
        edge, place = edge[order], place[order]
        upto, total = 0, np.zeros(wide, np.int64)
        step = max(1, CHUNK_ROWS // max(wide, 1))
        for first in range(0, len(edge), step):
            stop = place[first : first + step]
            seen = bucket[reading[upto : stop[-1]]]
            cell = np.searchsorted(stop, np.arange(upto, stop[-1]), side="right")
            found = np.bincount(cell * wide + seen, minlength=len(stop) * wide).reshape(len(stop), wide)
            # A row counts for the first edge behind it and all later ones.
            sums = total + np.cumsum(found, axis=0)
            upto, total = int(stop[-1]), sums[-1]
            part = edge[first : first + step]
            yield pa.RecordBatch.from_pydict({
                "asset_id": pa.array([asset[begin]] * len(part), pa.string()), "segment": np.full(len(part), segment, np.int64),
                "point": point[part], "is_end": is_end[part], "counts": pa.array(list(sums), pa.list_(pa.int64()))})
        total = total + np.bincount(bucket[reading[upto:]], minlength=wide)
        yield pa.RecordBatch.from_pydict({
            "asset_id": pa.array([asset[begin]], pa.string()), "segment": np.full(1, segment, np.int64), "point": pa.nulls(1, pa.int64()),
            "is_end": pa.nulls(1, pa.bool_()), "counts": pa.array([total], pa.list_(pa.int64()))})


RANKS = "asset_id string, point long, bucket long, rank long"


def middle_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket and rank inside it of both middle rows of each window, from its counts per bucket."""
    for batch in batches:
        asset, point, lowest, bucket, rank = [], [], [], [], []
        for a, p, low, counts in zip(*(batch.column(n).to_pylist() for n in ("asset_id", "point", "lowest", "counts"))):
            upto = np.cumsum(counts)
            total = int(upto[-1])
            for k in ((total - 1) // 2, total // 2) if total else ():
                own = int(np.searchsorted(upto, k, side="right"))
                asset.append(a)
                point.append(p)
                bucket.append(low + own)
                rank.append(k - int(upto[own] - counts[own]))
        yield pa.RecordBatch.from_pydict({"asset_id": pa.array(asset, pa.string()), "point": pa.array(point, pa.int64()),
                                          "bucket": pa.array(bucket, pa.int64()), "rank": pa.array(rank, pa.int64())})


def bucket_answers(questions: pa.Table, values: pa.Table) -> pa.Table:
    """The reading of the asked rank among the readings of a bucket in a window."""
    values = values.sort_by([("asset_id", "ascending"), ("at", "ascending")])
    asset, at = column(values, "asset_id"), column(values, "at")
    starts = run_starts(asset)
    run_of = dict(zip(asset[starts].tolist(), range(len(starts))))
    run = np.array([run_of[a] for a in questions.column("asset_id").to_pylist()], np.int64)
    bounds, point = np.append(starts, len(asset)), column(questions, "point")
    begin = first_at(at, bounds[run], bounds[run + 1], point - MEDIAN_DAYS * DAY)
    end = first_at(at, bounds[run], bounds[run + 1], point, after=True)
    found = RankCounts(column(values, "utilization")).kth(begin, end, column(questions, "rank"))
    return pa.table({"asset_id": questions.column("asset_id"), "point": questions.column("point"), "value": found})


def large_medians(points: DataFrame, readings: DataFrame, rows_per_task: int) -> DataFrame:
    """Median utilisation of the points of cut assets."""
    known = readings.filter(F.col("utilization").isNotNull()).select("asset_id", "at", "utilization")
    values = materialise(known.repartitionByRange(segments_needed(known, rows_per_task), "asset_id", "utilization", "at")
                         .withColumn("bucket", F.spark_partition_id().cast("long")))
    spans = materialise(values.groupBy("asset_id").agg(
        F.min("bucket").alias("lowest"), (F.max("bucket") - F.min("bucket") + 1).alias("buckets")))
    marks = F.array(*[F.struct(F.lit(end).alias("is_end"), (F.col("at") - days * DAY).alias("place"))
                      for end, days in ((True, 0), (False, MEDIAN_DAYS))])
    edges = points.join(spans, "asset_id").select("asset_id", F.col("at").alias("point"), "buckets", F.explode(marks).alias("e")).select(
        "asset_id", F.col("e.place").alias("at"), "point", "e.is_end", "buckets")
    rows = values.join(spans, "asset_id").select(
        "asset_id", "at", (F.col("bucket") - F.col("lowest")).alias("bucket"), "buckets").unionByName(edges, allowMissingColumns=True)
    rows = rows.select("asset_id", "at", "bucket", "point", "is_end", "buckets")
    counted = materialise(rows.repartitionByRange(segments_needed(rows, rows_per_task), "asset_id", "at")
                          .sortWithinPartitions("asset_id", "at").mapInArrow(bucket_counts, COUNTS))
    earlier = Window.partitionBy("asset_id", "place").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = counted.filter("point is null").select("asset_id", "segment", F.posexplode("counts").alias("place", "n"))
    before = whole.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy("asset_id", "segment").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("before"))
    upto = counted.filter("point is not null").join(before, ["asset_id", "segment"]).select(
        "asset_id", "point", "is_end", F.zip_with("counts", "before", lambda x, y: x + y).alias("upto"))
    both = upto.groupBy("asset_id", "point").agg(F.max(F.when(F.col("is_end"), F.col("upto"))).alias("end"),
                                                 F.max(F.when(~F.col("is_end"), F.col("upto"))).alias("start"))
    ranks = both.join(spans, "asset_id").select("asset_id", "point", "lowest", F.zip_with("end", "start", lambda x, y: x - y).alias("counts"))
    asked = materialise(ranks.mapInArrow(middle_ranks, RANKS))
    copies = materialise(asked.groupBy(F.col("bucket").alias("_bucket")).agg(
        F.ceil(F.count("*") / F.lit(rows_per_task)).cast("int").alias("copies")))
    salt = F.pmod(F.xxhash64("asset_id", "point"), F.col("copies"))
    questions = asked.join(copies, F.col("bucket") == F.col("_bucket")).select(*asked.columns, salt.cast("int").alias("salt"))
    copied = values.join(copies, F.col("bucket") == F.col("_bucket")).select(
        *values.columns, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))

    def answer(asking: pa.Table, held: pa.Table) -> pa.Table:
        return bucket_answers(asking, held)

    answers = questions.groupBy("bucket", "salt").cogroup(copied.groupBy("bucket", "salt")).applyInArrow(
        answer, "asset_id string, point long, value double")
    return answers.groupBy("asset_id", F.col("point").alias("at")).agg(F.avg("value").alias("mean_utilization_30d"))


def trailing_windows(points: DataFrame, readings: DataFrame, rows_per_task: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Per `source_row` of `points(source_row, asset_id, at)`: the values of WINDOWS from `readings(asset_id, at, hours, distance, utilization)`.

    `at` counts microseconds; readings are unique per (asset, at). Windows include both ends.
    """
    moments = points.select("asset_id", "at").distinct()
    sizes = readings.select("asset_id").unionByName(points.select("asset_id")).groupBy("asset_id").agg(F.count("*").alias("n"))
    large = materialise(sizes.filter(F.col("n") > rows_per_task).select("asset_id"))
    if large.isEmpty():
        found = small_assets(moments, readings)
    else:
        small = [df.join(large, "asset_id", "left_anti") for df in (moments, readings)]
        big_points, big_readings = (df.join(large, "asset_id", "left_semi") for df in (moments, readings))
        big = large_sums(big_points, big_readings, rows_per_task).join(
            large_medians(big_points, big_readings, rows_per_task), ["asset_id", "at"], "left")
        found = small_assets(*small).unionByName(big)
    return points.join(found, ["asset_id", "at"]).drop("asset_id", "at")
