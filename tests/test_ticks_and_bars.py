import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import clock
from tapeworks.operators import audits, bars, ticks
from tapeworks.plans import fixture
from tapeworks.schemas import BARS, SECOND_BARS
from tapeworks.sources import layers, tape

UTC = timezone.utc


def tape_of(spark, rows):
    """rows: (ts, seq, instrument, price, size, side)."""
    return spark.createDataFrame(rows, tape.RAW_SCHEMA)


def loop(rows):
    """The tick rule, trade by trade."""
    out, last, direction, previous = {}, None, 0, None
    for ts, seq, instrument, price, _, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        change = None if previous != instrument else (price > last) - (price < last)
        if previous != instrument:
            direction = 0
        elif change:
            direction = change
        out[seq] = change, direction
        last, previous = price, instrument
    return out


def random_tape(seed, n=400, spread=9000):
    rng = random.Random(seed)
    rows, ts, instrument = [], datetime(2024, 3, 4, 20, tzinfo=UTC), 1
    for i in range(n):
        ts += timedelta(seconds=rng.choice([0, 0, 1, 5, spread]))
        if rng.random() < 0.04:
            instrument = rng.choice([1, 2, 3])
        rows.append((ts, i, instrument, 100.0 + rng.choice([0, 0, 0.25, -0.25]), rng.randrange(1, 9), rng.choice("ABN")))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", ["minute", "day"])
def test_tick_rule_equals_the_loop_over_any_chunks(spark, seed, chunk):
    rows = random_tape(seed, spread=random.Random(seed).choice([3, 700, 9000]))
    got = ticks.tick_rule(tape_of(spark, rows).repartition(5), chunk).collect()
    assert {r.seq: (r.change, r.direction) for r in got} == loop(rows)


def test_tick_rule_by_hand(spark):
    t = datetime(2024, 1, 2, 10, tzinfo=UTC)
    rows = [(t, i, ins, p, 1, "N") for i, (p, ins) in enumerate([(100.0, 1), (100.25, 1), (101.0, 2), (100.75, 2)])]
    assert [r.direction for r in ticks.tick_rule(tape_of(spark, rows)).orderBy("seq").collect()] == [0, 1, 0, -1]


def test_session_dates_and_boundaries_follow_daylight_saving(spark):
    df = spark.sql("SELECT timestamp'2026-03-08 21:59:00' AS a, timestamp'2026-03-08 22:00:00' AS b, date'2026-03-09' AS d, date'2026-03-06' AS e")
    row = df.select(clock.session_date(F.col("a")).cast("string"), clock.session_date(F.col("b")).cast("string"), clock.session_open(F.col("d")).cast("string"), clock.session_open(F.col("e")).cast("string")).first()
    assert tuple(row) == ("2026-03-08", "2026-03-09", "2026-03-08 22:00:00", "2026-03-05 23:00:00")


def make_seconds(spark, seed=7):
    df = tape.with_context(tape_of(spark, random_tape(seed, 600, 1200)))
    return bars.second_bars(ticks.with_flow(ticks.tick_rule(df)))


def test_second_bars_hold_their_invariants_and_schema(spark):
    seconds = make_seconds(spark).cache()
    assert layers.same_types(seconds, SECOND_BARS)
    assert {r.check: r.violations for r in audits.second_bar_checks(seconds).collect() if r.violations} == {}
    assert seconds.agg(F.sum("trade_count")).first()[0] == 600
    first = seconds.orderBy("timestamp_second", "instrument_id").first()
    assert first.contract_change is False


def test_bars_do_not_depend_on_the_chunk(spark):
    df = tape.with_context(tape_of(spark, random_tape(3, 500, 900)))
    a, b = (bars.second_bars(ticks.with_flow(ticks.tick_rule(df, c))) for c in ("minute", "day"))
    assert layers.differing_rows(a, b) == 0


def test_rollup_refuses_bars_that_mix_instruments(spark):
    t = datetime(2024, 1, 2, 10, tzinfo=UTC)
    rows = [(t, 0, 1, 100.0, 1, "N"), (t + timedelta(seconds=2), 1, 2, 100.0, 1, "N")]
    seconds = bars.second_bars(ticks.with_flow(ticks.tick_rule(tape.with_context(tape_of(spark, rows)))))
    with pytest.raises(Exception, match="mixes instruments"):
        bars.roll_up(seconds, 60).collect()


def test_unknown_instruments_fail(spark):
    rows = [(datetime(2024, 1, 2, tzinfo=UTC), 0, 99, 1.0, 1, "N")]
    with pytest.raises(Exception, match="unknown instrument"):
        tape.with_context(tape_of(spark, rows)).collect()


def test_layers_are_written_once_and_read_back_equal(spark, tmp_path):
    seconds = make_seconds(spark)
    path = str(tmp_path / "seconds")
    back = layers.write_layer(seconds, SECOND_BARS, path, ["timestamp_second", "instrument_id"])
    assert layers.differing_rows(back, seconds) == 0
    with pytest.raises(Exception, match="already exists"):
        layers.write_layer(seconds, SECOND_BARS, path, [])
    one = layers.read_layer(spark, SECOND_BARS, path, "2024-03-05")
    assert "PartitionFilters: [isnotnull(session_date" in one._jdf.queryExecution().toString() and one.select("session_date").distinct().count() == 1
    with pytest.raises(layers.SchemaMismatch):
        layers.enforce(seconds.drop("open"), SECOND_BARS)
    with pytest.raises(layers.SchemaMismatch):
        layers.enforce(seconds.withColumn("more", F.lit(1)), BARS)


def test_trade_files_of_every_form(spark, tmp_path):
    df = tape_of(spark, random_tape(1, 20)).coalesce(1)
    for form in ("parquet", "orc", "json"):
        df.write.format(form).save(f"{tmp_path}/{form}")
        assert layers.differing_rows(tape.read_trades(spark, f"{tmp_path}/{form}", form), df) == 0
    df.write.option("header", True).csv(f"{tmp_path}/csv")
    assert layers.differing_rows(tape.read_trades(spark, f"{tmp_path}/csv", "csv"), df) == 0


def test_artifacts(tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"abc")
    good = {"path": "a", "bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}
    assert layers.verify_artifacts(str(tmp_path), [good]) == []
    wrong = layers.verify_artifacts(str(tmp_path), [good | {"bytes": 4}, good | {"sha256": "0"}, {"path": "../a", "bytes": 1, "sha256": ""}, {"path": "b", "bytes": 1, "sha256": ""}])
    assert wrong == ["a: size", "a: digest", "../a: unsafe path", "b: missing"]
    with pytest.raises(ValueError):
        layers.write_json({"x": float("nan")}, str(tmp_path / "m.json"))


def test_plans_have_no_global_window_over_trades(spark):
    df = ticks.tick_rule(tape_of(spark, random_tape(1, 50)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    singles = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(singles) <= 2  # over one row a chunk
    assert all("seq" not in line for line in singles)


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).head()[0]


def events_of(spark, folder, n):
    rows = spark.range(n).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id * 2592000000000 DIV %d) AS ts" % n, "id % 7 AS user_id",
        "'view' AS event_type", "double(id % 50) AS value", "'{\"k\": 3}' AS props",
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_tick_rule_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Adaptive execution would make 8 tasks of 12,500 of these narrow trades."""
    monkeypatch.setattr(fixture, "TASK", 4096, raising=False)
    folder = events_of(spark, tmp_path, 100_000)
    assert largest_task(fixture.classified(spark, folder)) < 2 * 4096


def test_dense_tape_is_dealt_by_minutes(spark, tmp_path, monkeypatch):
    """Its 50 hours hold all trades: a task of one of them would grow with the table."""
    monkeypatch.setattr(fixture, "TASK", 1024, raising=False)
    folder = events_of(spark, tmp_path, 200_000)
    assert largest_task(fixture.classified(spark, folder, True)) < 2 * 1024
