from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bars, models, ticks
from tapeworks.sources import layers, tape

from .test_ticks_and_bars import random_tape, tape_of

UTC = timezone.utc
DDL = "session_date DATE, id BIGINT, x DOUBLE"


def unchecked(path):
    """The local file system keeps checksums of its own beside files."""
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    return path


def layer(spark, days=3):
    return spark.createDataFrame([(date(2024, 1, 1 + i % days), i, i / 3 if i % 5 else float("nan")) for i in range(40)], DDL)


def test_layer_is_worked_out_once_and_named_when_it_reads_back(spark, tmp_path, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        runs.add(1)
        yield from batches

    df = layer(spark).coalesce(1).mapInArrow(count, DDL)
    back = layers.write_layer(df, DDL, f"{tmp_path}/layer", ["id"])
    assert runs.value == 1 and layers.differing_rows(back, layer(spark)) == 0
    with pytest.raises(FileExistsError, match="already exists"):
        layers.write_layer(layer(spark), DDL, f"{tmp_path}/layer", ["id"])
    read = layers.read_layer
    monkeypatch.setattr(layers, "read_layer", lambda spark, ddl, path, session=None: read(spark, ddl, path).withColumn("x", F.col("x") + 1e-9))
    with pytest.raises(layers.ReadBackError):
        layers.write_layer(layer(spark), DDL, f"{tmp_path}/other", ["id"])
    assert not (tmp_path / "other").exists()


def test_files_of_a_layer_against_their_manifest(spark, tmp_path):
    root = f"{tmp_path}/layer"
    layers.write_layer(layer(spark), DDL, root, ["id"])
    manifest = spark.createDataFrame(layers.file_digests(spark, root).collect(), "path string, session date, bytes long, sha256 string")
    days = layer(spark).select("session_date").distinct()
    problems = lambda: sorted((r.path, r.problem) for r in layers.differing_files(manifest, layers.file_digests(spark, root)).collect())
    sessions = lambda: sorted((str(r.session_date), r.problem) for r in layers.session_files(layers.file_digests(spark, root), days).collect())
    assert problems() == [] and sessions() == []
    paths = sorted(r.path for r in manifest.collect())
    assert {str(r.session) for r in manifest.collect()} == {"2024-01-01", "2024-01-02", "2024-01-03"}
    first, second, third = ((tmp_path / "layer" / p) for p in paths)
    data = bytearray(first.read_bytes())
    data[len(data) // 2] ^= 1
    unchecked(first).write_bytes(bytes(data))
    second.unlink()
    third.with_name("part-copy.parquet").write_bytes(third.read_bytes())
    extra = tmp_path / "layer" / "session_date=2024-02-01" / "part-x.parquet"
    extra.parent.mkdir()
    extra.write_bytes(b"more")
    assert problems() == sorted([(paths[0], "digest"), (paths[1], "missing"), (str(third.relative_to(tmp_path / "layer").with_name("part-copy.parquet")), "extra"), (str(extra.relative_to(tmp_path / "layer")), "extra")])
    assert sessions() == [("2024-01-02", "missing"), ("2024-01-03", "duplicate"), ("2024-02-01", "extra")]
    twice = manifest.unionByName(manifest.where(F.col("path") == paths[2]))
    assert ("listed twice",) in {(r.problem,) for r in layers.differing_files(twice, layers.file_digests(spark, root)).collect()}


def test_a_tampered_model_is_not_loaded(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), i % 2) for i in range(60)], "a double, b double, target_up_15m int")
    z = models.standardized(df, df, ["a", "b"])
    fitted, path = models.fit_logistic(z, ["a", "b"]), str(tmp_path / "model")
    fitted.write().save(path)
    digest = layers.folder_digest(spark, path)
    assert models.replay(path, z, "p", digest).count() == 60
    part = next(p for p in (tmp_path / "model").rglob("*.parquet"))
    unchecked(part).write_bytes(part.read_bytes() + b"\0")
    with pytest.raises(layers.DigestError):
        models.replay(path, z, "p", digest)


def test_nanoseconds_order_trades_against_their_numbers(spark, tmp_path):
    start = 1_704_204_000_000_000_000
    rows = [(start + 100, 5, 1, 100.0), (start + 400, 4, 1, 101.0), (start + 800, 3, 1, 100.5), (start + 1_000_000_700, 6, 1, 100.5)]
    columns = list(zip(*rows))
    table = pa.table({"ts_event": pa.array(columns[0], pa.timestamp("ns", "UTC")), "seq": pa.array(columns[1], pa.uint32()), "instrument_id": columns[2], "price": columns[3], "size": [1] * 4, "side": ["N"] * 4})
    pq.write_table(table, f"{tmp_path}/tape.parquet", version="2.6")
    trades = tape.read_trades(spark, f"{tmp_path}/tape.parquet", nanoseconds=True)
    assert [(r.ts_ns, r.seq) for r in trades.orderBy(*tape.order_of(trades)).collect()] == [(r[0], r[1]) for r in rows]
    assert trades.select(F.unix_micros("ts_event").alias("us")).orderBy("us").first().us == start // 1000
    ruled = ticks.tick_rule(tape.with_context(trades))
    assert {r.seq: r.direction for r in ruled.collect()} == {5: 0, 4: 1, 3: -1, 6: -1}
    seconds = bars.second_bars(ticks.with_flow(ruled)).orderBy("timestamp_second").collect()
    assert [(r.open, r.close, r.trade_count) for r in seconds] == [(100.0, 100.5, 3), (100.5, 100.5, 1)]


def test_strict_tick_rule_fails_on_a_backward_trade(spark):
    rows = random_tape(3, 60, 4000)
    fine = ticks.tick_rule(tape_of(spark, rows).repartition(4), strict=True).collect()
    plain = ticks.tick_rule(tape_of(spark, rows)).collect()
    assert sorted(map(tuple, fine)) == sorted(map(tuple, plain))
    for at, back in ((30, timedelta(seconds=1)), (30, timedelta(days=1))):
        moved = [(ts - back if i == at else ts, *rest) for i, (ts, *rest) in enumerate(rows)]
        moved[at - 1] = (moved[at][0] + timedelta(milliseconds=1), *moved[at - 1][1:])
        with pytest.raises(Exception, match="backward trade"):
            ticks.tick_rule(tape_of(spark, moved), strict=True).collect()


def test_scan_reads_only_wanted_columns_and_sessions(spark, tmp_path):
    layers.write_layer(layer(spark), DDL, f"{tmp_path}/layer", ["id"])
    plan = layers.read_layer(spark, DDL, f"{tmp_path}/layer", "2024-01-02").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "PartitionFilters: [isnotnull(session_date" in plan
