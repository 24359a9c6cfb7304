import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import clock
from tapeworks.operators import features
from tapeworks.operators.features import Coverage, Settings
from tapeworks.schemas import BARS

UTC = timezone.utc
COVERAGE = Coverage("2025-10-07 00:00:00", "2026-09-11 00:00:00")


def minutes(spark, start, prices, ids=None, skip=(), volumes=None):
    """One-minute bars from ``start`` on: all prices of a bar equal, volume 10, two trades."""
    names, rows = [c.split()[0] for c in BARS.split(", ")], []
    start = start.astimezone(UTC)
    for i, p in enumerate(prices):
        if i in skip:
            continue
        begin, v = start + timedelta(minutes=i), 10 if volumes is None else volumes[i]
        row = dict.fromkeys(names, 0) | {
            "decision_timestamp": begin + timedelta(minutes=1), "minute_start": begin, "session_date": None, "instrument_id": ids[i] if ids else 1, "contract": "C",
            "open": p, "high": p, "low": p, "close": p, "price_volume_sum": p * v, "price_squared_volume_sum": p * p * v, "total_volume": v, "trade_count": 2, "max_trade_size": 5,
            "size_squared_sum": 50, "active_second_count": 1, "first_trade_timestamp": begin, "last_trade_timestamp": begin + timedelta(seconds=59), "contract_change": False,
        }
        rows.append(tuple(row[n] for n in names))
    df = spark.createDataFrame(rows, BARS)
    return df.withColumn("session_date", clock.session_date(F.col("minute_start")))


def run(df, *steps, **options):
    s = Settings(options.pop("coverage", COVERAGE), **options)
    df = features.prepare(df, s)
    for step in steps:
        df = step(df) if step is features.session_clock else step(df, s)
    return df.orderBy("decision_timestamp").collect()


START = datetime(2026, 3, 10, 15, 0, tzinfo=UTC)  # 10:00 Chicago


def test_paths_need_every_bar_and_one_contract(spark):
    prices = [100 + 0.25 * i for i in range(70)]
    rows = run(minutes(spark, START, prices), features.paths)
    assert rows[60].return_60m == pytest.approx(math.log(115 / 100)) and rows[59].return_60m is None
    assert rows[5].trend_efficiency_5m == pytest.approx(1.0)
    gap = run(minutes(spark, START, prices, skip={10}), features.paths)
    assert gap[10].return_1m is None and gap[11].return_1m is not None and gap[14].return_5m is None and gap[15].return_5m is not None
    roll = run(minutes(spark, START, prices, ids=[1] * 20 + [2] * 50), features.paths)
    assert roll[20].return_1m is None and roll[21].return_1m is not None


def test_flat_prices_have_defined_denominators(spark):
    rows = run(minutes(spark, START, [100.0] * 70), features.paths, features.session_state)
    last = rows[-1]
    assert last.trend_efficiency_5m == 0 and last.realized_volatility_60m == 0 and last.volatility_ratio_15m_60m is None
    assert last.session_range_position == 0.5 and last.session_vwap_distance is None


def test_sparse_minutes_are_allowed_and_unavailable_ones_are_not(spark):
    prices = [100.0 + i for i in range(20)]
    sparse = run(minutes(spark, START, prices, skip={12, 13}), features.elapsed_ranges, features.acceleration)
    assert sparse[-1].range_5m == pytest.approx(math.log(119 / 115)) and sparse[-1].activity_acceleration_5m == pytest.approx(0.0)
    gap = Coverage(COVERAGE.start, COVERAGE.end, (("2026-03-10", "2026-03-10 15:12:00", "2026-03-10 15:14:00"),))
    rows = run(minutes(spark, START, prices, skip={12, 13}), features.paths, features.elapsed_ranges, features.session_state, features.acceleration, coverage=gap)
    at = {r.decision_timestamp.minute: r for r in rows}
    assert at[12].range_5m is not None and at[15].range_5m is None and at[18].range_5m is None and at[19].range_5m is not None
    assert at[12].session_range_position is not None and at[15].session_range_position is None


def test_an_empty_recent_window_counts_as_no_volume(spark):
    rows = run(minutes(spark, START, [100.0] * 20, skip=set(range(1, 19))), features.acceleration)
    assert rows[-1].activity_acceleration_5m == pytest.approx(math.log1p(10))


def test_windows_do_not_leave_the_session(spark):
    open_ = datetime(2026, 3, 9, 22, 0, tzinfo=UTC)  # 17:00 Chicago
    rows = run(minutes(spark, open_, [100.0] * 20), features.elapsed_ranges, features.acceleration, features.session_clock)
    assert [r.range_5m is not None for r in rows[:6]] == [False] * 4 + [True] * 2
    assert [r.activity_acceleration_5m is not None for r in rows[4:7]] == [False, True, True]
    assert rows[0].minutes_since_cme_open == 1 and rows[0].asia_flag == 1
    close = datetime(2026, 3, 10, 20, 50, tzinfo=UTC)  # 15:50 Chicago
    late = run(minutes(spark, close, [100.0] * 20), features.elapsed_ranges, features.session_clock)
    assert late[9].range_5m is not None and late[10].range_5m is None
    assert [late[9].us_flag, late[8].us_flag, late[9].asia_flag] == [0, 1, 0]


def test_roll_rules_of_ranges_and_acceleration(spark):
    rows = run(minutes(spark, START, [100.0] * 40, ids=[1] * 20 + [2] * 20), features.elapsed_ranges, features.acceleration)
    assert [i for i in range(18, 30) if rows[i].range_5m is None] == [20, 21, 22, 23]
    assert [i for i in range(18, 30) if rows[i].activity_acceleration_5m is None] == [20, 21, 22, 23, 24]


def test_opening_range_is_released_whole_and_unclipped(spark):
    start = datetime(2026, 3, 10, 13, 30, tzinfo=UTC)  # 08:30 Chicago
    rows = run(minutes(spark, start, [100.0] + [101.0] * 30 + [102.0]), features.opening_range)
    assert [r.us_opening_range_position for r in rows[27:]] == [None, None, 1.0, 1.0, 2.0]
    missing = run(minutes(spark, start, [100.0] + [101.0] * 31, skip={7}), features.opening_range)
    assert all(r.us_opening_range_position is None for r in missing)


def test_prior_session_is_the_one_just_before_and_comparable(spark):
    days = [datetime(2026, 3, d, 15, 0, tzinfo=UTC) for d in (9, 10, 11, 12)]
    wave = [100.0 + (i % 3) for i in range(70)]
    df = minutes(spark, days[0], wave)
    for d, ids in ((days[1], [1] * 70), (days[2], [1] * 35 + [2] * 35), (days[3], [2] * 70)):
        df = df.union(minutes(spark, d, wave, ids=ids))
    rows = run(df, features.paths, features.prior_session)
    by_day = {str(r.session_date): r for r in rows}  # the last row of each
    assert by_day["2026-03-10"].prior_session_high_distance is not None
    assert by_day["2026-03-11"].prior_session_high_distance is None  # another instrument
    assert by_day["2026-03-12"].prior_session_high_distance is None  # two instruments in the session before
    assert by_day["2026-03-09"].prior_session_high_distance is None


def test_baseline_needs_exactly_enough_earlier_sessions(spark):
    df, volumes = None, []
    for i in range(23):
        day = datetime(2026, 1, 5, 15, 0, tzinfo=UTC) + timedelta(days=i)
        volumes.append(10 + (7 * i) % 13)
        one = minutes(spark, day, [100.0], volumes=[volumes[-1]])
        df = one if df is None else df.union(one)
    rows = run(df, features.activity_baseline)
    assert [r.relative_volume_q is None for r in rows] == [True] * 20 + [False] * 3
    logs = sorted(math.log1p(v) for v in volumes[2:22])
    assert rows[22].relative_volume_q == pytest.approx(math.log1p(volumes[22]) - (logs[9] + logs[10]) / 2)
    gap = Coverage(COVERAGE.start, COVERAGE.end, (("2026-01-07", "2026-01-07 15:00:00", "2026-01-07 15:01:00"),))
    late = run(df, features.activity_baseline, coverage=gap)
    assert [r.relative_volume_q is None for r in late] == [True] * 21 + [False] * 2


def test_all_features_together(spark):
    s = Settings(COVERAGE)
    df = features.all_features(minutes(spark, START, [100.0 + (i % 5) for i in range(80)]), s)
    rows = df.orderBy("decision_timestamp").collect()
    assert rows[70].price_movement_per_volume is None and rows[70].delta_price_alignment == pytest.approx(0.0)
    assert rows[70].divergence_5m == pytest.approx(0.0) and rows[70].trade_count_imbalance is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(session_date") <= 4
