from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tapeworks.operators import ticks
from tapeworks.streaming import live

from .test_ticks_and_bars import loop, random_tape, tape_of

SCHEMA = "tape string, ts_event timestamp, seq bigint, instrument_id bigint, price double, size bigint, side string"


def stored(spark, tmp_path, rows, batches):
    """The tape in files that a stream takes one a batch."""
    cut = -(-len(rows) // batches)
    for i in range(batches):
        part = tape_of(spark, rows[i * cut : (i + 1) * cut]).withColumn("tape", F.lit("t"))
        part.select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_classification_does_not_depend_on_batches(spark, tmp_path):
    rows = random_tape(5, 120, 40)
    for batches in (1, 4):
        got = drain(live.classified_trades(stored(spark, tmp_path / str(batches), rows, batches)), f"classified{batches}").collect()
        assert {r.seq: (r.change, r.direction) for r in got} == loop(rows) and not any(r.late for r in got)
    batch = ticks.tick_rule(tape_of(spark, rows)).collect()
    assert {r.seq: (r.change, r.direction) for r in batch} == loop(rows)


def test_late_trades_change_nothing(spark, tmp_path):
    t = datetime(2024, 1, 2, 10, tzinfo=timezone.utc)
    rows = [(t + timedelta(seconds=s), i, 1, p, 1, "N") for i, (s, p) in enumerate([(0, 100.0), (5, 101.0), (2, 50.0), (6, 101.0)])]
    got = drain(live.classified_trades(stored(spark, tmp_path, rows, 2)), "late").collect()
    assert {r.seq: (r.direction, r.late) for r in got} == {0: (0, False), 1: (1, False), 2: (0, True), 3: (1, False)}


def test_stream_bars_and_flush_equal_batch_bars(spark, tmp_path):
    rows = random_tape(6, 150, 3)
    emitted = drain(live.streaming_bars(stored(spark, tmp_path, rows, 5), "10 seconds"), "bars")
    whole = live.streaming_bars(tape_of(spark, rows), "10 seconds")
    rest = live.flush(tape_of(spark, rows), emitted, "10 seconds")
    assert 0 < emitted.count() < whole.count()
    assert emitted.select(*whole.columns).unionByName(rest.select(*whole.columns)).exceptAll(whole).count() == 0
    assert emitted.count() + rest.count() == whole.count()
