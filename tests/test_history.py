import pytest
from pyspark.sql import functions as F

from tapeworks.operators.features import Settings
from tapeworks.operators.recount import FirewallError, assert_firewall
from tapeworks.plans import fixture as fx
from tapeworks.plans import history
from tapeworks.sources import layers, tape

SF = "/root/testdata/sf0.001"


def test_all_layers_of_a_tape_are_built_once(spark, tmp_path):
    root = str(tmp_path / "history")
    trades = tape.dense_trades_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    history.build_layers(trades, root, Settings(fx.COVERAGE), horizon=3, tolerance=30)
    for name, (ddl, _) in history.LAYERS.items():
        if name not in ("sample", "predictions"):
            assert layers.same_types(history.read(spark, root, name), ddl)
    n = history.read(spark, root, "bars").count()
    assert n == history.read(spark, root, "targets").count() == history.read(spark, root, "features").count() > 250
    assert layers.differing_rows(history.read(spark, root, "seconds"), fx.seconds(spark, SF, True)) == 0
    assert sum(r.trades for r in spark.read.json(f"{root}/manifest").collect()) == trades.count()
    with pytest.raises(Exception, match="already exists"):
        history.build_layers(trades, root, Settings(fx.COVERAGE))
    sample = history.build_sample(spark, root, "2024-01-20")
    assert 0 < sample.count() < n and sample.agg(F.max("session_date").cast("string")).first()[0] < "2024-01-20"
    with pytest.raises(FirewallError):
        assert_firewall(sample, "2024-01-10")
    plan = [("2024-01-10", "2024-01-14"), ("2024-01-15", "2024-01-19")]
    made = history.build_predictions(spark, root, plan, "return_1m")
    assert made.select("fold", "model").distinct().count() == 4
    again = history.read(spark, root, "predictions")
    assert {r.violations for r in history.compare_predictions(made, again).collect()} == {0}
    moved = again.withColumn("p", F.col("p") + 1e-9)
    assert {r.check for r in history.compare_predictions(made, moved).collect() if r.violations} == {"p"}
