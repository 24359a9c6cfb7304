import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import audits, evaluation, models, targets
from tapeworks.operators.targets import REASONS

UTC = timezone.utc
START = datetime(2026, 3, 10, 15, 0, tzinfo=UTC)


def grid(spark, n=40, ids=None, skip=(), sessions=None):
    rows = []
    for i in range(n):
        if i not in skip:
            t = START + timedelta(minutes=i)
            rows.append((t, (sessions or {}).get(i, datetime(2026, 3, 10).date()), (ids or {}).get(i, 1), "C", "tape"))
    return spark.createDataFrame(rows, "decision_timestamp timestamp, session_date date, instrument_id long, contract string, tape string")


def second_rows(spark, trades):
    """trades: (seconds after START, price[, instrument])."""
    rows = []
    for at, price, *ids in trades:
        ts = START + timedelta(seconds=at)
        rows.append((ts.replace(microsecond=0), ts, price, ids[0] if ids else 1, datetime(2026, 3, 10).date()))
    return spark.createDataFrame(rows, "timestamp_second timestamp, first_trade_timestamp timestamp, open double, instrument_id long, session_date date")


def reason(spark, trades, grid_=None, **options):
    rows = targets.forward_targets(grid_ or grid(spark), second_rows(spark, trades), **options).orderBy("decision_timestamp").collect()
    return rows[0]


UP = [(1.5, 100.0), (901.5, 101.0)]


def test_outcomes_and_reference_reasons(spark):
    up = reason(spark, UP)
    assert (up.eligibility_reason, up.target_up_15m, up.target_eligible) == ("ELIGIBLE", 1, True)
    assert up.forward_log_return == pytest.approx(math.log(1.01)) and up.start_reference_delay_seconds == 1.5
    assert reason(spark, [(0, 100.0), (900, 99.0)]).target_up_15m == 0
    equal = reason(spark, [(0, 100.0), (900, 100.0)])
    assert equal.eligibility_reason == "EQUAL_REFERENCE_PRICE" and equal.target_up_15m is None and equal.forward_price_change == 0
    assert reason(spark, [(9.999999, 100.0), (909.999999, 101.0)]).eligibility_reason == "ELIGIBLE"
    assert reason(spark, [(10, 100.0), (900, 101.0)]).eligibility_reason == "NO_START_REFERENCE_WITHIN_10S"
    late = reason(spark, [(0, 100.0), (910, 101.0)])
    assert late.eligibility_reason == "NO_FUTURE_REFERENCE_WITHIN_10S" and late.start_reference_price == 100.0
    assert reason(spark, [(0, 100.0, 2), (900, 101.0)]).eligibility_reason == "START_REFERENCE_CONTRACT_MISMATCH"
    mismatch = [(0, 100.0), (900, 101.0, 2)]
    assert reason(spark, mismatch).eligibility_reason == "FUTURE_REFERENCE_CONTRACT_MISMATCH"
    assert reason(spark, mismatch, contract_safe=False).eligibility_reason == "ELIGIBLE"
    assert reason(spark, [(0, 100.0), (0.5, 50.0), (900, 101.0)]).start_reference_price == 100.0


def test_structural_reasons_in_order_of_priority(spark):
    other = datetime(2026, 3, 11).date()
    assert reason(spark, UP, grid(spark, skip={15}, ids={3: 2})).eligibility_reason == "NO_FUTURE_BOUNDARY"
    gap = reason(spark, UP, grid(spark, skip={7}))
    assert gap.eligibility_reason == "CROSSES_INTERNAL_GAP" and gap.start_reference_price is None
    assert reason(spark, UP, grid(spark, skip={7}, ids={15: 2})).eligibility_reason == "CROSSES_CONTRACT_ROLL"
    crossing = grid(spark, sessions={15: other}, ids={15: 2})
    assert reason(spark, UP, crossing, path_keys=("tape",)).eligibility_reason == "CROSSES_SESSION_BOUNDARY"
    assert reason(spark, UP, crossing).eligibility_reason == "NO_FUTURE_BOUNDARY"
    with pytest.raises(ValueError):
        targets.first_references(second_rows(spark, UP), 5, 10)


def test_funnel_and_checks(spark):
    rng = random.Random(1)
    rows = second_rows(spark, [(i * 7, 100.0 + rng.choice([0, 0.25, 0.5])) for i in range(400)])
    out = targets.forward_targets(grid(spark), rows).cache()
    f = targets.funnel(out).first()
    assert f.candidates == 40 == sum(r.rows for r in targets.reason_counts(out).collect())
    assert f.eligible == f.up + f.down and f.reference_pairs == f.eligible + f.equal_price
    assert sum(r.violations for r in audits.target_checks(out, 10).collect()) == 0
    assert targets.version_diff(out, out).count() == 0
    broken = out.withColumn("target_up_15m", F.lit(1).cast("tinyint"))
    assert sum(r.violations for r in audits.target_checks(broken, 10).collect()) > 0
    assert REASONS[-1] == "ELIGIBLE"


def sample(spark, days=12):
    rows = []
    for i in range(days):
        t = datetime(2026, 3, 1 + i, 15, tzinfo=UTC)
        rows.append((t, t.date(), i % 2, t + timedelta(minutes=15), 0.1 * (-1) ** i))
    return spark.createDataFrame(rows, "decision_timestamp timestamp, session_date date, target_up_15m int, future_reference_timestamp timestamp, return_15m double")


def test_training_labels_that_reach_validation_are_purged(spark):
    edge = datetime(2026, 3, 6, 15, tzinfo=UTC)
    at = lambda *rows: sample(spark).withColumn("future_reference_timestamp", F.when(F.dayofmonth("session_date") == 5, F.lit(rows[0])).otherwise(F.col("future_reference_timestamp")))
    for reach, purged in ((edge, 1), (edge - timedelta(microseconds=1), 0), (edge + timedelta(seconds=1), 1)):
        report = evaluation.fold_report(evaluation.folds(at(reach), [("2026-03-06", "2026-03-08")])).first()
        assert (report.purged_rows, report.final_training_rows, report.validation_rows, report.validation_sessions) == (purged, 5 - purged, 3, 3)


def test_momentum_rates(spark):
    returns, labels = [0.01, 0.02, -0.01, -0.02, 0.0, None], [1, 0, 0, 0, 1, 1]
    rows = [(1, "train", r, y) for r, y in zip(returns, labels, strict=True)] + [(1, "validation", r, 1) for r in (0.5, -0.5, 0.0, None)]
    df = spark.createDataFrame(rows, "fold int, part string, return_15m double, target_up_15m int")
    got = evaluation.baseline_probabilities(df).orderBy(F.col("return_15m").desc_nulls_last()).collect()
    assert [r.p_momentum for r in got] == [2 / 4, 4 / 8, 1 / 4, 4 / 8] and {r.p_base for r in got} == {4 / 8}


def test_metrics_calibration_and_quantiles(spark):
    rng = np.random.default_rng(1)
    p, y = np.round(rng.uniform(0.05, 0.95, 300), 1), rng.integers(0, 2, 300)
    df = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y, strict=True)], "model string, p double, y int")
    m = evaluation.metrics(df, ["model"]).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert m.roc_auc == pytest.approx(np.mean(pairs)) and m.brier_score == pytest.approx(np.mean((p - y) ** 2))
    assert m.log_loss == pytest.approx(np.mean(-np.log(np.where(y == 1, p, 1 - p)))) and m.accuracy == pytest.approx(np.mean((p >= 0.5) == y))
    one = spark.createDataFrame([("m", 0.5, 1)], "model string, p double, y int")
    assert evaluation.metrics(one, ["model"]).first().roc_auc is None
    bins = {r.bin: r for r in evaluation.calibration(one.union(spark.createDataFrame([("m", 1.0, 1)], "model string, p double, y int")), ["model"]).collect()}
    assert len(bins) == 10 and bins[5].rows == bins[9].rows == 1 and bins[0].rows == 0 and bins[0].observed_up_rate is None
    q = evaluation.quantiles(spark.createDataFrame([("m", x, 0) for x in (0.1, 0.2, 0.4, 0.8)], "model string, p double, y int"), ["model"]).first()
    assert q.q50 == pytest.approx(0.3) and (q.q0, q.q100) == (0.1, 0.8) and q.q25 == pytest.approx(np.quantile([0.1, 0.2, 0.4, 0.8], 0.25))


def test_preprocessing_uses_training_rows_alone(spark):
    x = [1.0, None, 3.0, 10.0, None]
    train = spark.createDataFrame([(1, v, 2.0) for v in x], "fold int, a double, b double")
    got = {r.feature: r for r in evaluation.preprocessing(train, ["a", "b"], ["fold"]).collect()}
    filled = np.array([1, 3, 3, 10, 3.0])
    assert (got["a"].median, got["a"].nulls) == (3.0, 2) and got["a"].mean == pytest.approx(filled.mean()) and got["a"].scale == pytest.approx(filled.std())
    assert got["b"].scale == 1.0
    other = models.standardized(spark.createDataFrame([(None, 5.0)], "a double, b double"), train, ["a", "b"]).first()
    assert other.z_a == pytest.approx((3 - filled.mean()) / filled.std()) and other.z_b == 3.0


def test_logistic_regression_matches_newton(spark, tmp_path):
    rng = np.random.default_rng(2)
    X = rng.standard_normal((400, 2))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.8 * X[:, 0] - 0.3)))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(X, y, strict=True)], "a double, b double, target_up_15m int")
    z = models.standardized(df, df, ["a", "b"]).cache()
    fitted = models.fit_logistic(z, ["a", "b"])
    Z = np.column_stack([np.ones(400), (X - X.mean(0)) / X.std(0)])
    w, penalty = np.zeros(3), np.diag([0, 1, 1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-Z @ w))
        w -= np.linalg.solve(Z.T @ (Z * (p * (1 - p))[:, None]) + penalty, Z.T @ (p - y) + penalty @ w)
    assert [v for _, v in models.coefficients(fitted, ["a", "b"])] == pytest.approx(w.tolist(), abs=1e-5)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    first, again = models.probabilities(fitted, z, "p"), models.replay(str(tmp_path / "m"), z, "p")
    assert [r.p for r in first.collect()] == pytest.approx([r.p for r in again.collect()], abs=1e-14)
    assert sum(r.violations for r in audits.disagreements(first.select("a", "b", "p"), again.select("a", "b", "p"), ["a", "b"], ["p"]).collect()) == 0


def test_registered_boosted_model_takes_all_rounds(monkeypatch):
    from tapeworks.operators import boosting
    from tapeworks.plans import fixture, registry

    seen = []
    monkeypatch.setattr(registry, "_standardized", lambda spark, sf_dir: fixture.F.lit(1))
    monkeypatch.setattr(boosting, "_sums", None)
    monkeypatch.setattr(boosting, "fit", lambda t, c, by, **options: seen.append((len(c), by, options)))
    monkeypatch.setattr(registry, "_standardized", lambda spark, sf_dir: type("Rows", (), {"where": lambda self, x: self})())
    monkeypatch.setattr(fixture.scratch, "state_of", lambda spark, path: 0)
    registry._boosted(type("S", (), {"sparkContext": type("C", (), {"applicationId": "none"})()})(), "")
    assert seen == [(36, "fold", {"leaf": 10})]  # all else, 200 rounds too, is the operator's default
