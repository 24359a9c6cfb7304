"""Each check of the audits finds nothing on sound layers, and finds what is planted for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import audits, bars, evaluation, recount, targets
from tapeworks.operators.features import Settings, all_features
from tapeworks.plans import fixture as fx
from tapeworks.schemas import SECOND_BARS
from tapeworks.sources import layers, scratch
from tapeworks.streaming import live

from .test_streaming import drain, stored
from .test_ticks_and_bars import random_tape, tape_of

SF = "/root/testdata/sf0.001"


def broken(df):
    return {r.check for r in df.collect() if r.violations}


@pytest.fixture(scope="module")
def small(spark):
    seconds = fx.seconds(spark, SF, True).cache()
    minute = bars.roll_up(seconds, 60).cache()
    labels = targets.forward_targets(minute, seconds, 60, 3, 30).cache()
    return seconds, minute, labels


def first_rows(df, order, n=3):
    """The layer with one of its rows marked in ``hit``."""
    top = {tuple(r) for r in df.orderBy(*order).select(*order).limit(n).collect()[n - 1 :]}
    match = F.lit(False)
    for row in top:
        one = F.lit(True)
        for c, v in zip(order, row, strict=True):
            one &= F.col(c) == F.lit(v)
        match |= one
    return df.withColumn("hit", match)


#: What makes a row break a rule: the column and an SQL expression.
PLANTED_SECONDS = {
    "seconds_prices": ("high", "low - 1"), "seconds_positive": ("low", "-1.0D"), "seconds_inferred_volume": ("inferred_unknown_volume", "inferred_unknown_volume + 1"),
    "seconds_native_volume": ("native_unknown_volume", "native_unknown_volume + 1"), "seconds_inferred_delta": ("inferred_delta", "inferred_delta + 1"),
    "seconds_native_delta": ("native_delta", "native_delta + 1"), "seconds_counts": ("inferred_buy_trade_count", "inferred_buy_trade_count + 1"),
    "seconds_moves": ("uptick_count", "trade_count + 1"), "seconds_level_volume": ("max_volume_at_price", "total_volume + 1"),
    "seconds_times": ("last_trade_timestamp", "first_trade_timestamp - INTERVAL 1 SECOND"), "seconds_session": ("session_date", "date_add(session_date, 1)"),
    "seconds_order": ("last_trade_timestamp", "last_trade_timestamp + INTERVAL 1 DAY"), "seconds_contract": ("contract", "'OTHER'"),
}


def test_second_bar_checks_find_what_is_planted(spark, small):
    seconds = small[0]
    assert broken(audits.second_bar_checks(seconds)) == set()
    marked = first_rows(seconds, ["timestamp_second", "instrument_id"])
    for name, (column, value) in PLANTED_SECONDS.items():
        bad = marked.withColumn(column, F.when(F.col("hit"), F.expr(value)).otherwise(F.col(column))).drop("hit")
        assert name in broken(audits.second_bar_checks(bad)), name
    twice = seconds.union(seconds.limit(1))
    assert "seconds_key" in broken(audits.second_bar_checks(twice))
    other = seconds.limit(1).withColumns({"session_date": F.date_add("session_date", 1), "instrument_id": F.lit(9).cast("bigint")})
    assert "seconds_single_session" in broken(audits.second_bar_checks(seconds.union(other)))


def test_bar_checks_find_what_is_planted(spark, small):
    seconds, minute, _ = small
    assert broken(audits.bar_checks(minute, seconds)) == set()
    marked = first_rows(minute, ["decision_timestamp"])
    planted = {
        "bars_time": ("last_trade_timestamp", F.col("decision_timestamp")), "bars_start": ("first_trade_timestamp", F.col("minute_start") - F.expr("INTERVAL 1 SECOND")),
        "bars_positive": ("trade_count", F.lit(0).cast("bigint")), "bars_prices": ("high", F.col("low") - 1), "bars_totals": ("total_volume", F.col("total_volume") + 1),
    }
    for name, (column, value) in planted.items():
        bad = marked.withColumn(column, F.when(F.col("hit"), value).otherwise(F.col(column))).drop("hit")
        assert name in broken(audits.bar_checks(bad, seconds)), name
    assert "bars_key" in broken(audits.bar_checks(minute.union(minute.limit(1)), seconds))


def test_target_checks_find_what_is_planted(spark, small):
    labels = small[2].where("target_eligible OR eligibility_reason = 'EQUAL_REFERENCE_PRICE'").cache()
    assert broken(audits.target_checks(labels, 30)) == set() and labels.where("target_eligible").count() > 3
    marked = first_rows(labels.where("target_eligible"), ["decision_timestamp"])
    planted = {
        "targets_reason": ("eligibility_reason", F.lit("ODD")), "targets_eligible": ("target_eligible", F.lit(False)), "targets_label": ("target_up_15m", F.lit(None).cast("tinyint")),
        "targets_sign": ("target_up_15m", (1 - F.col("target_up_15m")).cast("tinyint")), "targets_delay": ("start_reference_delay_seconds", F.lit(30.0)),
        "targets_contract": ("future_reference_instrument_id", F.lit(9).cast("bigint")), "targets_equal": ("forward_price_change", F.lit(0.0)),
    }
    for name, (column, value) in planted.items():
        bad = marked.withColumn(column, F.when(F.col("hit"), value).otherwise(F.col(column))).drop("hit")
        assert name in broken(audits.target_checks(bad, 30)), name
    assert "targets_key" in broken(audits.target_checks(labels.union(labels.limit(1)), 30))


def test_feature_checks_find_what_is_planted(spark, small):
    s = Settings(fx.COVERAGE)
    full = all_features(small[1], s).cache()
    check = lambda df: broken(audits.feature_checks(df, tuple(s.efficiencies), tuple(s.volatilities)))
    assert check(full) == set()
    marked = first_rows(full, ["decision_timestamp"])
    planted = {
        "features_flags": ("us_flag", F.lit(2).cast("smallint")), "features_fraction": ("active_second_fraction_1m", F.lit(1.5)), "features_position": ("session_range_position", F.lit(-0.1)),
        "features_efficiency": ("trend_efficiency_5m", F.lit(1.1)), "features_volatility": ("realized_volatility_15m", F.lit(-0.1)), "features_not_finite": ("range_5m", F.lit(float("inf"))),
    }
    for name, (column, value) in planted.items():
        assert name in check(marked.withColumn(column, F.when(F.col("hit"), value).otherwise(F.col(column))).drop("hit")), name


def changed(df, order, column, value):
    return first_rows(df, order).withColumn(column, F.when(F.col("hit"), value).otherwise(F.col(column))).drop("hit")


def test_recounts_find_a_changed_value(spark, small):
    seconds, minute, labels = small
    trades = fx.classified(spark, SF, True)
    assert broken(recount.bars_recount(minute, trades, 60)) == set()
    assert broken(recount.bars_recount(changed(minute, ["decision_timestamp"], "close", F.col("close") + 0.25), trades, 60)) == {"close"}
    assert "trade_count" in broken(recount.bars_recount(minute.limit(3), trades, 60))  # missing rows are found in every column
    again = lambda df: broken(recount.targets_recount(df, minute, seconds, 60, 3, 30))
    assert again(labels) == set()
    assert again(changed(labels, ["decision_timestamp"], "eligibility_reason", F.lit("CROSSES_CONTRACT_ROLL"))) == {"eligibility_reason"}
    s = Settings(fx.COVERAGE)
    full = all_features(minute, s).cache()
    assert broken(recount.features_recount(full, minute, s)) == set()
    assert broken(recount.features_recount(changed(full, ["decision_timestamp"], "range_5m", F.lit(7.0)), minute, s)) == {"range_5m"}
    assert broken(recount.features_recount(changed(full, ["decision_timestamp"], "delta_acceleration", F.lit(None).cast("double")), minute, s)) <= {"delta_acceleration"}


def test_session_and_dataset_audits(spark, small):
    seconds, minute, labels = small
    found = recount.dataset_audit(fx.trades(spark, SF, True), seconds)
    assert found.where("NOT agrees").count() == 0 and recount.dataset_audit(fx.trades(spark, SF, True).limit(900), seconds).where("NOT agrees").count() > 0
    names = {"seconds": seconds, "bars": minute, "targets": labels}
    assert broken(recount.same_sessions(names)) == set()
    assert broken(recount.same_sessions(names | {"bars": minute.where("session_date > '2024-01-03'")})) == {"bars_sessions"}
    assert broken(recount.session_order(minute, "bars", "decision_timestamp", "decision_timestamp")) == set()
    late = minute.withColumn("session_date", F.when(F.col("session_date") == "2024-01-03", F.lit("2024-01-20").cast("date")).otherwise(F.col("session_date")))
    assert broken(recount.session_order(late, "bars", "decision_timestamp", "decision_timestamp")) == {"bars_session_order"}
    tape = tape_of(spark, random_tape(3, 50))
    assert broken(audits.tape_order(tape, 7)) == set()
    assert broken(audits.tape_order(changed(tape, ["seq"], "ts_event", F.col("ts_event") + F.expr("INTERVAL 9 DAY")), 7)) == {"tape_order"}


def test_sample_checks_and_firewall(spark):
    sample, features, labels = fx.sample(spark, SF), fx.rolled(spark, SF, fx.HOUR), fx.labels(spark, SF)
    check = lambda df: broken(recount.sample_reconciliation(df, features, labels, fx.HOLDOUT))
    key = ["decision_timestamp"]
    assert check(sample) == set() and recount.assert_firewall(sample, fx.HOLDOUT).count() == sample.count() > 5
    assert check(sample.union(sample.limit(1))) >= {"sample_keys", "sample_unique"}
    assert check(sample.limit(4)) == {"labels_met", *[c for c in check(sample.limit(4)) if c.startswith("label_")]}
    assert check(changed(sample, key, "target_up_15m", F.lit(3).cast("tinyint"))) == {"label_target_up_15m", "sample_label"}
    assert "sample_holdout" in check(changed(sample, key, "session_date", F.lit(fx.HOLDOUT).cast("date")))
    assert {"rows_with_features", "rows_with_label"} <= check(changed(sample, key, "decision_timestamp", F.lit("2020-01-01").cast("timestamp")))
    for bad in (sample.union(sample.limit(1)), changed(sample, key, "target_up_15m", F.lit(3).cast("tinyint"))):
        with pytest.raises(recount.FirewallError):
            recount.assert_firewall(bad, fx.HOLDOUT)


def test_quantiles_scale_and_ranks_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(500) * 10.0 ** rng.integers(-9, 9, 500), np.zeros(40), -np.zeros(3), np.full(30, -2.5)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 3.0), ("b", None)], "g string, x double")
    got = {r.g: r for r in evaluation.exact_quantiles(df, ["g"], "x", {"low": 0.0, "q": 0.37, "half": 0.5, "high": 1.0}).collect()}
    assert [got["a"].low, got["a"].q, got["a"].half, got["a"].high] == pytest.approx(np.quantile(x, [0, 0.37, 0.5, 1]).tolist(), rel=1e-12)
    assert got["b"].half == 3.0
    y = 1e6 + rng.standard_normal(300) * 1e-3  # a difference of squares would lose this
    scaled = evaluation.preprocessing(spark.createDataFrame([(1, float(v)) for v in y], "fold int, c double"), ["c"], ["fold"]).first()
    assert scaled.scale == pytest.approx(y.std(), rel=1e-6) and scaled.mean == pytest.approx(y.mean())
    gains = evaluation.metric_deltas(spark.createDataFrame([("r", 0.7, 0.25, 0.5, 0.5), ("m", 0.6, 0.2, 0.6, 0.7)], "model string, log_loss double, brier_score double, roc_auc double, accuracy double").withColumn("fold", F.lit(1)), "r", ["fold"]).first()
    assert [round(v, 6) for v in gains[2:]] == [0.1, 0.05, 0.1, 0.2]


def test_written_layer_must_read_back_equal(spark, small, tmp_path, monkeypatch):
    seconds = small[0]
    real = layers.read_layer
    monkeypatch.setattr(layers, "read_layer", lambda *a: real(*a).limit(5))
    with pytest.raises(layers.ReadBackError):
        layers.write_layer(seconds, SECOND_BARS, str(tmp_path / "s"), ["timestamp_second"])


def test_strict_stream_stops_at_a_backward_trade_and_rolls_are_marked(spark, tmp_path):
    rows = random_tape(5, 60, 40)
    got = {r.seq: r.rolled for r in drain(live.classified_trades(stored(spark, tmp_path / "a", rows, 3)), "rolled").collect()}
    assert got == {b[1]: a is not None and a[2] != b[2] for a, b in zip([None, *rows[:-1]], rows, strict=True)}
    with pytest.raises(Exception, match="BackwardTrade|behind"):
        drain(live.classified_trades(stored(spark, tmp_path / "b", rows[30:] + rows[:30], 2), strict=True), "backward")


def test_stream_writes_sessions(spark, tmp_path):
    rows = random_tape(6, 150, 30_000)
    bars_ = live.streaming_bars(stored(spark, tmp_path / "in", rows, 5), "10 seconds")
    out = str(tmp_path / "out")
    q = bars_.writeStream.outputMode("append").foreachBatch(live.session_writer(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    written = spark.read.parquet(out)
    whole = live.streaming_bars(tape_of(spark, rows), "10 seconds")
    rest = live.flush(tape_of(spark, rows), written, "10 seconds")
    assert written.count() + rest.count() == whole.count() and written.select("session_date").distinct().count() > 3
    n = written.count()
    one = spark.createDataFrame(written.where("batch = 1").select(*whole.columns).collect(), whole.schema)
    live.session_writer(out)(one, 1)  # a batch that runs again
    assert spark.read.parquet(out).count() == n


def test_context_recount_finds_a_changed_value(spark):
    s, sf = fx.MINUTE, "/root/testdata/sf0.01"
    minute = fx.rolled(spark, sf, s)
    full = scratch.written(all_features(minute, s), "all-features")
    found = {r.check: r for r in recount.context_recount(full, minute, s).collect()}
    assert len(found) == 19 and {r.violations for r in found.values()} == {0} and all(r.rows > 0 for r in found.values())
    other = {c: F.when(F.col(c).isNull(), 0).otherwise(F.col(c) + 1).cast(dict(full.dtypes)[c]) for c in found}
    planted = first_rows(full, ["decision_timestamp"])
    planted = planted.withColumns({c: F.when(F.col("hit"), x).otherwise(F.col(c)) for c, x in other.items()}).drop("hit")
    assert {r.check: r.violations for r in recount.context_recount(planted, minute, s).collect()} == dict.fromkeys(found, 1)


def test_version_report_tells_expected_changes_from_others(spark, small):
    seconds, minute, labels = small
    wrong = lambda df: {r.field for r in targets.version_report(labels, df).collect() if r.unexpected}
    assert wrong(labels) == set()
    rolled = changed(labels, ["decision_timestamp"], "eligibility_reason", F.lit(targets.NEW_REASONS[0]))
    assert wrong(rolled) == set() and {r.field for r in targets.version_report(labels, rolled).collect() if r.changed} == {"eligibility_reason"}
    assert wrong(changed(rolled, ["decision_timestamp"], "contract", F.lit("other"))) == {"contract"}
    assert wrong(changed(labels, ["decision_timestamp"], "target_up_15m", F.lit(5).cast("tinyint"))) == {"target_up_15m"}
    assert wrong(labels.limit(3)) == {"row"}


def test_development_recount_finds_medians_and_areas(spark):
    rows = [(i, i // 12, (i * 7 % 5) - 2.0, None if i % 11 == 0 else float(i * i % 13), i * 5 % 3 % 2) for i in range(48)]
    sample = spark.createDataFrame(rows, "i int, day int, momentum double, x double, target_up_15m int").select(
        F.expr("timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, day, 0, i)").alias("decision_timestamp"), F.expr("date_add(date'2024-01-01', day)").alias("session_date"),
        F.expr("timestamp'2024-01-01 10:05:00' + make_interval(0, 0, 0, day, 0, i)").alias("future_reference_timestamp"), "target_up_15m", "momentum", "x",
    )
    plan = [("2024-01-03", "2024-01-03"), ("2024-01-04", "2024-01-04")]
    folded = evaluation.folds(sample, plan)
    base = evaluation.baseline_probabilities(folded, "momentum")
    found = evaluation.metrics(evaluation.long_probabilities(base, {"baseline_0": "p_base", "baseline_1": "p_momentum"}), ["fold", "model"])
    medians = evaluation.preprocessing(folded.where("part = 'train'"), ["momentum", "x"], ["fold"])
    wrong = lambda m, f: {r.check: r.violations for r in recount.development_recount(sample, folded, base, m, f, plan, "momentum", ["momentum", "x"]).collect() if r.violations}
    assert wrong(medians, found) == {}
    off = lambda df, c, key: df.withColumn(c, F.col(c) + F.when(key, 1e-6).otherwise(0.0))
    assert wrong(off(medians, "median", F.col("feature") == "x"), off(found, "roc_auc", F.col("model") == "baseline_1")) == {"median": 2, "roc_auc": 2}
