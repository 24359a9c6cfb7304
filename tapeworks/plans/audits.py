"""Queries of the audits: what must hold in each layer, and layers worked out again by other algorithms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, bars, evaluation, features, recount, targets
from . import fixture as fx


def layer_checks(spark, sf_dir) -> DataFrame:
    second, s = fx.seconds(spark, sf_dir), fx.HOUR
    hour = bars.roll_up(second, s.width)
    parts = [
        audits.second_bar_checks(second), audits.bar_checks(hour, second), audits.target_checks(fx.labels(spark, sf_dir), fx.TOLERANCE),
        audits.feature_checks(features.all_features(hour, s), tuple(s.efficiencies), tuple(s.volatilities)),
    ]
    return reduce(DataFrame.union, parts)


def tape_order(spark, sf_dir) -> DataFrame:
    """Of the tape, and of a copy whose sequence numbers run backwards: every row of that breaks the order."""
    trades = fx.trades(spark, sf_dir)
    back = audits.tape_order(trades.withColumn("seq", -F.col("seq"))).withColumn("check", F.lit("reversed_order"))
    return audits.tape_order(trades).union(back)


def sample_reconciliation(spark, sf_dir) -> DataFrame:
    return recount.sample_reconciliation(fx.sample(spark, sf_dir), fx.rolled(spark, sf_dir, fx.HOUR), fx.labels(spark, sf_dir), fx.HOLDOUT)


def dataset_audit(spark, sf_dir) -> DataFrame:
    df = recount.dataset_audit(fx.trades(spark, sf_dir), fx.seconds(spark, sf_dir))
    return fx.plain(df, *df.columns)


def session_breakdown(spark, sf_dir) -> DataFrame:
    df = recount.session_breakdown(fx.seconds(spark, sf_dir))
    return fx.plain(df, *df.columns)


def run_totals(spark, sf_dir) -> DataFrame:
    df = recount.run_totals(fx.seconds(spark, sf_dir))
    return fx.plain(df, *df.columns)


def layer_sessions(spark, sf_dir) -> DataFrame:
    second = fx.seconds(spark, sf_dir)
    hour = bars.roll_up(second, fx.HOUR.width)
    layers = {"seconds": second, "bars": hour, "targets": fx.labels(spark, sf_dir)}
    parts = [
        recount.same_sessions(layers), recount.session_order(second, "seconds", "first_trade_timestamp", "last_trade_timestamp"),
        recount.session_order(hour, "bars", "decision_timestamp", "decision_timestamp"),
    ]
    return reduce(DataFrame.union, parts)


def bars_recount(spark, sf_dir) -> DataFrame:
    return recount.bars_recount(fx.rolled(spark, sf_dir, fx.TEN), fx.classified(spark, sf_dir), fx.TEN.width)


def targets_recount(spark, sf_dir) -> DataFrame:
    second, w = fx.seconds(spark, sf_dir), fx.HOUR.width
    return recount.targets_recount(fx.labels(spark, sf_dir), bars.roll_up(second, w), second, w, fx.HORIZON, fx.TOLERANCE)


def minute_targets_recount(spark, sf_dir) -> DataFrame:
    second, w = fx.seconds(spark, sf_dir, True), fx.MINUTE.width
    return recount.targets_recount(fx.minute_labels(spark, sf_dir), bars.roll_up(second, w), second, w, 15, 10)


def minute_features_recount(spark, sf_dir) -> DataFrame:
    s = fx.MINUTE
    minute = fx.rolled(spark, sf_dir, s)
    return recount.features_recount(features.all_features(minute, s), minute, s)


def minute_context_recount(spark, sf_dir) -> DataFrame:
    s = fx.MINUTE
    minute = fx.rolled(spark, sf_dir, s)
    return recount.context_recount(features.all_features(minute, s), minute, s)


def target_version_report(spark, sf_dir) -> DataFrame:
    return targets.version_report(fx.labels(spark, sf_dir, False), fx.labels(spark, sf_dir))


def dev_firewall(spark, sf_dir) -> DataFrame:
    return recount.firewall(fx.sample(spark, sf_dir), fx.HOLDOUT)


def dev_recount(spark, sf_dir) -> DataFrame:
    sample, folded = fx.sample(spark, sf_dir), fx.folded(spark, sf_dir)
    baselines = evaluation.baseline_probabilities(folded, fx.MOMENTUM)
    scored = evaluation.long_probabilities(baselines, {"baseline_0": "p_base", "baseline_1": "p_momentum"})
    medians = evaluation.preprocessing(folded.where("part = 'train'"), fx.MODEL_FEATURES, ["fold"])
    return recount.development_recount(sample, folded, baselines, medians, evaluation.metrics(scored, ["fold", "model"]), fx.FOLDS, fx.MOMENTUM, fx.MODEL_FEATURES)


def metric_deltas(spark, sf_dir) -> DataFrame:
    scored = evaluation.long_probabilities(evaluation.baseline_probabilities(fx.folded(spark, sf_dir), fx.MOMENTUM), {"baseline_0": "p_base", "baseline_1": "p_momentum"})
    df = evaluation.metric_deltas(evaluation.metrics(scored, ["fold", "model"]), "baseline_0", ["fold"])
    return fx.plain(df, *df.columns)


def flow_correlation(spark, sf_dir) -> DataFrame:
    df = audits.flow_correlation(fx.seconds(spark, sf_dir))
    return fx.plain(df, *df.columns)


def first_second_by_regime(spark, sf_dir) -> DataFrame:
    second = fx.seconds(spark, sf_dir)
    return audits.first_second_by_regime(bars.roll_up(second, fx.HOUR.width), second, fx.HOUR.width, fx.TOLERANCE)


QUERIES = {f.__name__: f for f in (
    layer_checks, tape_order, sample_reconciliation, dataset_audit, session_breakdown, run_totals, layer_sessions, bars_recount, targets_recount, minute_targets_recount,
    minute_features_recount, minute_context_recount, target_version_report, dev_firewall, dev_recount, metric_deltas, flow_correlation, first_second_by_regime,
)}
