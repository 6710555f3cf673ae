"""Hot keys and ordered scans: cut series and segment totals equal the plain window results."""

import datetime as dt
import random

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tribolens.operators import evaluation as ev, point_in_time as pit, samples as sm, telemetry as tele, trailing_windows as tw
from tribolens.operators import trends
from tribolens.plans import scans, selection


def hot_samples(spark, n=600):
    """Two thirds of the rows belong to one series, a part of them on one day or undated."""
    rnd = random.Random(5)
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(90))) for _ in range(n)]
    days = ["2024-02-02" if i % 5 == 0 else "00:00:00" if i % 11 == 0 else d for i, d in enumerate(days)]
    return sm.prepare_samples(frame(
        spark, SampleNum=[f"S{i:04d}" for i in range(n)], EquipNum=["HOT" if i % 3 else f"EQ-{i % 7}" for i in range(n)],
        Compartment=["ENG" if i % 3 else None for i in range(n)], DateSampled=days,
        OilHours=[float(rnd.randrange(500)) for _ in range(n)],
        Fe=[rnd.randrange(100) if rnd.random() > 0.3 else None for _ in range(n)]), "SampleNum")


def test_cut_series_give_the_same_trends(spark):
    rows = hot_samples(spark).cache()
    whole = trends.add_trends(rows).orderBy("source_row").collect()
    for size in (3, 20, 150):
        assert trends.add_trends(rows, size).orderBy("source_row").collect() == whole


def test_trends_against_brute_force(spark):
    rows = hot_samples(spark)
    got = {r.source_row: r for r in trends.add_trends(rows, 20).collect()}
    series = {}
    for r in rows.collect():
        series.setdefault((r.asset_id, r.component), []).append(r)
    for group in series.values():
        group.sort(key=lambda r: (r.sample_date is None, r.sample_date or dt.datetime.max, r.source_row))
        for i, r in enumerate(group):
            out = got[r.source_row]
            assert out.lab_history_samples == i + 1
            seen = [x.iron_ppm for x in group[max(0, i - 2):i + 1] if x.iron_ppm is not None]
            if seen:
                assert abs(out.iron_ppm_mean_3 - sum(seen) / len(seen)) < 1e-9
            else:
                assert out.iron_ppm_mean_3 is None
            before = group[i - 1].iron_ppm if i else None
            change = None if before is None or r.iron_ppm is None else r.iron_ppm - before
            assert out.iron_ppm_delta == change


def hot_telemetry(spark, n=800):
    rnd = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    return frame(
        spark, TMSAssetID=["HOT" if i % 3 else None if i % 7 == 0 else f"EQ-{i % 5}" for i in range(n)],
        Timestamp=[start + dt.timedelta(hours=rnd.randrange(2400)) for _ in range(n)],
        ModifiedOn=[start + dt.timedelta(hours=i) for i in range(n)],
        OperatingHours=[rnd.random() * 100 if rnd.random() > 0.1 else None for _ in range(n)],
        Odometer=[float(rnd.randrange(1000)) for _ in range(n)])


def test_cut_telemetry_gives_the_same_deltas(spark):
    latest = tele.latest_readings(tele.read_telemetry(hot_telemetry(spark), "source_row")).cache()
    whole = tele.with_deltas(latest).orderBy("reading_key").collect()
    for size in (4, 40):
        assert tele.with_deltas(latest, size).orderBy("reading_key").collect() == whole


@pytest.mark.parametrize("rows_per_task", [1_000_000, 150, 20])
def test_trailing_windows_against_brute_force(spark, rows_per_task):
    """Uncut assets, one cut asset, and all assets cut into many segments and buckets."""
    telemetry = tele.prepare_telemetry(hot_telemetry(spark), "source_row").cache()
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    moments = [start + dt.timedelta(hours=rnd.randrange(2500)) for _ in range(60)]
    rows = sm.prepare_samples(frame(
        spark, SampleNum=[f"S{i}" for i in range(60)], EquipNum=["HOT" if i % 2 else f"EQ-{i % 6}" for i in range(60)],
        DateSampled=moments), "SampleNum")
    readings = [r for r in telemetry.collect() if r.asset_id is not None and r.event_time is not None]
    for out in rows.join(pit.telemetry_features(rows, telemetry, rows_per_task), "source_row").collect():
        past = [r for r in readings if r.asset_id == out.asset_id and r.event_time <= out.sample_date]
        assert out.telemetry_available == float(bool(past))
        if past:
            newest = max(r.event_time for r in past)
            assert abs(out.telemetry_age_days - (out.sample_date - newest).total_seconds() / 86400) < 1e-9
        for days in (7, 30, 90):
            window = [r.operating_hours_delta for r in past
                      if r.event_time >= out.sample_date - dt.timedelta(days=days) and r.operating_hours_delta is not None]
            value = out[f"operating_hours_{days}d"]
            assert (value is None) == (not window)
            if window:
                assert abs(value - sum(max(v, 0) for v in window)) < 1e-6
        rates = sorted(r.utilization_rate for r in past if r.event_time >= out.sample_date - dt.timedelta(days=30)
                       and r.utilization_rate is not None)
        if rates:
            middle = (rates[(len(rates) - 1) // 2] + rates[len(rates) // 2]) / 2
            assert abs(out.mean_utilization_30d - middle) < 1e-9
        else:
            assert out.mean_utilization_30d is None


def test_running_totals_against_one_window(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(rnd.choice(["a", "b", None]), rnd.randrange(300), rnd.random()) for _ in range(2000)],
                                 "k string, at long, v double")
    segment = F.floor(F.col("at") / 25)
    for inclusive in (True, False):
        frame_ = Window.partitionBy("k").orderBy("at").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = rows.withColumn("t", F.sum("v").over(frame_)).withColumn("m", F.max("v").over(frame_))
        got = scans.running_totals(rows, ["k"], segment, "at", {"t": ("sum", F.col("v")), "m": ("max", F.col("v"))},
                                   inclusive)
        key = lambda r: (r.k or "", r.at, r.v)
        for a, b in zip(sorted(want.collect(), key=key), sorted(got.collect(), key=key)):
            assert (a.t is None) == (b.t is None)
            assert a.t is None or abs(a.t - b.t) < 1e-9 and a.m == b.m


def test_split_choice_against_all_pairs(spark):
    rnd = random.Random(8)
    for horizon, days in ((0, 40), (3, 60), (7, 90), (30, 60)):
        start = dt.datetime(2025, 1, 1)
        cells = [(start + dt.timedelta(days=rnd.randrange(days)), rnd.randrange(2)) for _ in range(150)]
        df = spark.createDataFrame(cells, "sample_date timestamp_ntz, corrective_wo_within_horizon int")
        got = ev.choose_split(df, horizon, rows_per_segment=25).collect()
        assert got == ev.choose_split(df, horizon).collect()
        dates = sorted({t for t, _ in cells})
        gap, n, options = dt.timedelta(days=horizon), len(dates), []
        for i in range(max(1, int(n * 0.50)), max(2, int(n * 0.72))):
            for j in range(max(2, int(n * 0.72)), max(3, int(n * 0.90))):
                if j <= i or j >= n or i >= n:
                    continue
                parts = [[y for t, y in cells if t + gap < dates[i]],
                         [y for t, y in cells if t >= dates[i] and t + gap < dates[j]],
                         [y for t, y in cells if t >= dates[j]]]
                if all(len(p) >= 8 and len(set(p)) == 2 for p in parts):
                    options.append((dates[i], dates[j]))
        want = [options[len(options) // 2]] if options else []
        assert [(r.calibration_start, r.test_start) for r in got] == want


def test_top_rank_filters_are_limited_before_the_shuffle(spark):
    plan = tele.latest_readings(tele.read_telemetry(hot_telemetry(spark), "source_row"))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("WindowGroupLimit") >= 2


def test_one_asset_and_day_is_cut_into_many_tasks(spark):
    """A day of one asset: no task gets more than about twice its share, and repeated moments are asked once."""
    day, n = 1_700_000_000_000_000, 6000
    rnd = np.random.default_rng(4)
    seconds = rnd.permutation(80_000)[:n]
    readings = spark.createDataFrame(
        [("HOT", day + int(s) * 1_000_000, float(s % 13), 1.0, float(rnd.integers(40))) for s in seconds],
        "asset_id string, at long, hours double, distance double, utilization double").cache()
    points = spark.createDataFrame([(i, "HOT", day + (i % 50) * 1_700_000_000) for i in range(400)],
                                   "source_row long, asset_id string, at long")
    got = tw.trailing_windows(points, readings, 500).collect()
    rows = sorted((r.at, r.hours, r.utilization) for r in readings.collect())
    assert len(got) == 400
    for r in got:
        past = [x for x in rows if x[0] <= day + (r.source_row % 50) * 1_700_000_000]
        assert r.distance_30d == (len(past) or None) and r.operating_hours_7d == (sum(x[1] for x in past) if past else None)
        assert r.latest_reading == (past[-1][0] if past else None)
        assert r.mean_utilization_30d == (np.median([x[2] for x in past]) if past else None)
    cut = readings.repartitionByRange(tw.segments_needed(readings, 500), "asset_id", "at")
    sizes = [r[0] for r in cut.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 12 and max(sizes) <= 1000


def test_sum_tree_and_rank_counts():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 501):
        values = np.where(rnd.random(n) < 0.2, np.nan, rnd.integers(0, 9, n) / 4)
        begin = rnd.integers(0, n + 1, 200)
        end = np.maximum(begin, rnd.integers(0, n + 1, 200))
        sums, middle = tw.SumTree(values).sums(begin, end), tw.medians(values, begin, end)
        for a, b, s, m in zip(begin, end, sums, middle):
            known = values[a:b][~np.isnan(values[a:b])]
            assert (np.isnan(s) and np.isnan(m)) if not len(known) else (s == known.sum() and m == np.median(known))


def test_crowded_scores_are_ranked_in_even_segments(spark):
    """All scores lie within a thousandth: no segment above twice its share, metrics as from all pairs."""
    rnd = np.random.default_rng(6)
    cells = [(float(p), int(y)) for p, y in zip(0.5 + rnd.integers(0, 900, 2000) * 1e-6, rnd.integers(0, 2, 2000))]
    scored = spark.createDataFrame(cells, "probability double, label int")
    got = ev.binary_metrics(scored, 0.5, rows_per_segment=100).first()
    assert got == ev.binary_metrics(scored, 0.5).first()
    pos, neg = ([p for p, y in cells if y == want] for want in (1, 0))
    pairs = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert abs(got.roc_auc - pairs / len(pos) / len(neg)) < 1e-12
    precision = {p: sum(x >= p for x in pos) / sum(x >= p for x, _ in cells) for p in set(pos)}
    assert abs(got.average_precision - sum(precision[p] for p in pos) / len(pos)) < 1e-12
    cut = scored.select("probability").distinct().repartitionByRange(8, "probability")
    sizes = [r[0] for r in cut.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) <= 2 * sum(sizes) / 8


def test_split_with_one_positive_date(spark):
    start = dt.datetime(2025, 1, 1)
    cells = [(start + dt.timedelta(hours=i), int(i in (70, 200, 350))) for i in range(400)]
    df = spark.createDataFrame(cells, "sample_date timestamp_ntz, corrective_wo_within_horizon int")
    assert ev.choose_split(df, 0, rows_per_segment=20).collect() == ev.choose_split(df, 0).collect() != []


def test_median_gap_of_one_hot_asset(spark):
    """All gaps are below a day and most belong to one asset."""
    rnd = random.Random(7)
    cells = [("HOT" if i % 4 else f"EQ-{i % 3}" if i % 8 else None, rnd.randrange(1, 86_400_000) / 3_600_000) for i in range(1500)]
    df = spark.createDataFrame(cells, "asset_id string, gap_hours double")
    got = {r[0]: r[1] for r in tele.gap_medians(df, rows_per_segment=50).collect()}
    for asset in {a for a, _ in cells}:
        assert abs(got[asset] - float(np.median([g for a, g in cells if a == asset]))) < 1e-9


def test_exact_order_statistics(spark):
    rnd = np.random.default_rng(11)
    columns = {"even": rnd.random(3000), "ties": rnd.integers(0, 3, 3000).astype(float), "one": np.full(3000, 2.5),
               "wide": 10.0 ** rnd.integers(-200, 200, 3000) * rnd.choice([-1, 1], 3000), "huge": rnd.choice([-1.7e308, 1.7e308, 3.0], 3000),
               "close": np.nextafter(1.0, 2.0) ** rnd.integers(0, 4, 3000), "gaps": np.where(rnd.random(3000) < 0.4, np.nan, rnd.normal(size=3000))}
    rows = [tuple(None if i % 50 == 7 else float(v[i]) for v in columns.values()) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in columns)).cache()
    for q in (0.0, 0.5, 0.95, 1.0):
        got = selection.quantiles(df, dict.fromkeys(columns, q), bins=64)
        for n, name in enumerate(columns):
            known = sorted(r[n] for r in rows if r[n] is not None and not np.isnan(r[n]))
            place = (len(known) - 1) * q
            low, high = known[int(np.floor(place))], known[int(np.ceil(place))]
            assert got[name] == (low if low == high else low + (high - low) * (place - np.floor(place)))
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert selection.quantiles(none, {"x": 0.5}) == {"x": None}
