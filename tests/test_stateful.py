import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bars, features, ticks
from tapeworks.operators.features import Coverage, Settings
from tapeworks.sources import layers, tape
from tapeworks.streaming import stateful

from .test_streaming import drain
from .test_ticks_and_bars import random_tape, tape_of

UTC = timezone.utc


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    stateful.use_rocksdb(spark)
    yield
    spark.conf.unset(stateful.STORE)


def stored(df, folder, batches, order):
    """A table in files that a stream takes one a batch, in order."""
    rows = df.orderBy(*order).collect()
    cut = -(-len(rows) // batches)
    for i in range(batches):
        df.sparkSession.createDataFrame(rows[i * cut : (i + 1) * cut], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def in_context(spark, rows):
    return tape.with_context(tape_of(spark, rows)).withColumn("tape", F.lit("t"))


def with_heartbeat(trades, at):
    last = trades.limit(1).withColumns({"ts_event": F.lit(at).cast("timestamp"), "price": F.lit(None).cast("double"), "seq": F.lit(10**9).cast("bigint")})
    return trades.unionByName(last)


def whole(spark, rows):
    return bars.second_bars(ticks.with_flow(ticks.tick_rule(tape.with_context(tape_of(spark, rows)))))


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_of_second_bars_equals_the_layer(spark, tmp_path, batches):
    rows = random_tape(11, 160, 40)
    trades = with_heartbeat(in_context(spark, rows), rows[-1][0] + timedelta(seconds=3))
    got = drain(stateful.second_bars(stored(trades, f"{tmp_path}/in", batches, ["ts_event", "seq"])), f"seconds{batches}")
    want = whole(spark, rows)
    assert got.count() == want.count() and layers.differing_rows(got.select(*want.columns), want) == 0


def test_the_watermark_frees_the_last_second_of_a_quiet_tape(spark, tmp_path):
    t = datetime(2024, 1, 2, 10, tzinfo=UTC)
    rows = [(t + timedelta(seconds=s), i, 1, 100.0 + i, 1, "B") for i, s in enumerate([0, 0, 1, 60, 120])]
    other = F.when(F.col("seq") < 3, "quiet").otherwise("busy")
    trades = tape.with_context(tape_of(spark, rows)).withColumn("tape", other)
    got = drain(stateful.second_bars(stored(trades, f"{tmp_path}/in", 5, ["ts_event"])), "quiet").collect()
    assert sorted((r.tape, r.timestamp_second.second, r.trade_count, r.close) for r in got if r.tape == "quiet") == [("quiet", 0, 2, 101.0), ("quiet", 1, 1, 102.0)]


def test_a_backward_trade_ends_the_stream(spark, tmp_path):
    t = datetime(2024, 1, 2, 10, tzinfo=UTC)
    rows = [(t + timedelta(seconds=s), i, 1, 100.0, 1, "B") for i, s in enumerate([0, 5, 3])]
    with pytest.raises(Exception, match="BackwardTrade|comes behind"):
        drain(stateful.second_bars(stored(in_context(spark, rows), f"{tmp_path}/in", 3, ["seq"]), delay="1 hour"), "backward")


@pytest.mark.parametrize("batches", [2, 6])
def test_bars_over_bars_in_one_stream_equal_the_roll_up(spark, tmp_path, batches):
    rows = [r for r in random_tape(12, 220, 30) if r[2] == 1]
    trades = with_heartbeat(with_heartbeat(in_context(spark, rows), rows[-1][0] + timedelta(seconds=3)), rows[-1][0] + timedelta(minutes=5))
    seconds = stateful.second_bars(stored(trades, f"{tmp_path}/in", batches, ["ts_event", "seq"]), timers=False)
    got = drain(stateful.bars_over_bars(seconds), f"minutes{batches}")
    want = bars.roll_up(whole(spark, rows))
    closed = got.agg(F.max("decision_timestamp")).first()[0]
    assert got.count() >= want.count() - 1
    assert layers.differing_rows(got.select(*want.columns), want.where(F.col("decision_timestamp") <= F.lit(closed))) == 0


def minute_tape(spark, days=9, seed=4):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        for m in range(4):
            if rng.random() < 0.9:
                rows.append((datetime(2024, 1, 8, 15, 0, 10, tzinfo=UTC) + timedelta(days=d, minutes=m), len(rows), 1, 100.0, rng.randrange(1, 50), "B"))
    return bars.roll_up(whole(spark, rows))


@pytest.mark.parametrize("batches", [1, 7])
def test_streamed_baseline_equals_the_batch(spark, tmp_path, batches):
    s = Settings(Coverage("2024-01-08 15:01:00", "2024-01-31 00:00:00", (("2024-01-11", "2024-01-11 15:00:00", "2024-01-11 15:02:00"),)), baseline_depth=4)
    minutes = minute_tape(spark)
    got = drain(stateful.activity_baseline(stored(minutes, f"{tmp_path}/in", batches, ["decision_timestamp"]), s), f"baseline{batches}").collect()
    want = features.activity_baseline(features.prepare(minutes, s), s).collect()
    of = lambda rows: {r.decision_timestamp: tuple(None if x is None or x != x else round(x, 9) for x in (r.relative_volume_q, r.relative_trade_count_q)) for r in rows}
    assert of(got) == of(want) and sum(v[0] is not None for v in of(got).values()) >= 8


def test_sessions_are_flushed_once_and_replays_are_harmless(spark, tmp_path):
    minutes = minute_tape(spark, 4)
    stream = stored(minutes, f"{tmp_path}/in", 5, ["decision_timestamp"])
    flush, writes = stateful.SessionFlush(f"{tmp_path}/staging", f"{tmp_path}/out", "minute_start"), []

    def twice(batch, number):
        flush(batch, number)
        writes.append({r.session_date for r in spark.read.parquet(f"{tmp_path}/out").select("session_date").distinct().collect()} if (tmp_path / "out").exists() else set())
        flush(batch, number)

    stream.writeStream.foreachBatch(twice).trigger(availableNow=True).start().awaitTermination(180)
    days = sorted(r.session_date for r in minutes.select("session_date").distinct().collect())
    assert writes[0] == set() and writes[-1] == set(days[:-1])
    flush.finish(spark)
    flush.finish(spark)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert layers.differing_rows(got.select(*minutes.columns), minutes) == 0
    assert all(len(list((tmp_path / "out" / f"session_date={d}").glob("*.parquet"))) == 1 for d in days)
