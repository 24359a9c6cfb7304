"""Named queries over the driver's tables; the SQL that checks them is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, bars, boosting, evaluation, features, model_audit, models, targets
from ..schemas import BARS, PREDICTORS, SECOND_BARS, TARGETS
from . import audit_oracle, oracle
from . import audits as audit_plans
from . import fixture as fx

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


@query
def trade_context(spark, sf_dir):
    names = ["seq", "ts_event", "timestamp_second", "session_date", "contract", "instrument_id", "price", "size", "native_buy_volume", "native_sell_volume", "native_unknown_volume", "native_delta"]
    return fx.plain(fx.trades(spark, sf_dir).withColumns(fx.tape.native_side(F.col("side"))), *names)


@query
def tick_rule(spark, sf_dir):
    names = ["seq", "change", "direction", "uptick", "downtick", "same_price", "inferred_buy_volume", "inferred_sell_volume", "inferred_unknown_volume", "inferred_delta"]
    return fx.plain(fx.classified(spark, sf_dir), *names)


@query
def bars_1s(spark, sf_dir):
    return fx.plain(fx.seconds(spark, sf_dir), *_names(SECOND_BARS))


@query
def bars_rollup(spark, sf_dir):
    return fx.plain(fx.rolled(spark, sf_dir, fx.TEN), *_names(BARS))


@query
def session_manifest(spark, sf_dir):
    seconds = fx.seconds(spark, sf_dir)
    whole = audits.completeness(seconds, fx.COVERAGE.start, fx.COVERAGE.end, ("2024-01-05", "2024-01-20"))
    df = bars.session_manifest(seconds).join(whole, "session_date")
    return fx.plain(df, "session_date", "bar_rows", "trades", "volume", "first_trade", "last_trade", "instruments", "contract_changes", "complete", "degraded")


def _features(step, s, *names: str) -> Query:
    def run(spark, sf_dir):
        return fx.plain(step(fx.prepared(spark, sf_dir, s), s), "decision_timestamp", *names)

    return run


FEATURE_QUERIES = {
    "session_clock": _features(lambda df, s: features.session_clock(df), fx.TEN, "minutes_since_cme_open", "time_of_day_sin", "time_of_day_cos", "asia_flag", "europe_flag", "us_flag", "us_rth_flag"),
    "path_returns": _features(features.paths, fx.HALF, "return_1m", "return_5m", "return_15m"),
    "path_volatility": _features(features.paths, fx.HALF, "trend_efficiency_5m", "trend_efficiency_15m", "realized_volatility_5m", "realized_volatility_15m", "volatility_ratio_5m_15m"),
    "elapsed_ranges": _features(features.elapsed_ranges, fx.TEN, "range_5m", "range_15m"),
    "activity_acceleration": _features(features.acceleration, fx.TEN, "activity_acceleration_5m"),
    "participation": _features(features.participation, fx.TEN, "log_volume_1m", "log_trade_count_1m", "log_average_trade_size_1m", "trade_size_dispersion_1m", "log_max_trade_size_1m", "active_second_fraction_1m"),
    "activity_baseline": _features(features.activity_baseline, fx.HOUR, "relative_volume_q", "relative_trade_count_q"),
    "session_state": _features(lambda df, s: features.session_state(features.paths(df, s), s), fx.HALF, "session_vwap_distance", "session_range_position", "session_high_distance", "session_low_distance"),
    "prior_session_levels": _features(lambda df, s: features.prior_session(features.paths(df, s), s), fx.HALF, "prior_session_high_distance", "prior_session_low_distance", "prior_session_close_distance"),
    "opening_range": _features(features.opening_range, fx.HALF, "us_opening_range_position"),
    "order_flow_features": _features(
        lambda df, s: features.order_flow(features.activity_baseline(features.acceleration(features.paths(df, s), s), s), s), fx.HOUR,
        "delta_1m", "delta_3m", "delta_5m", "trade_count_imbalance", "tick_imbalance", "delta_acceleration", "divergence_3m", "divergence_5m",
        "price_movement_per_volume", "price_movement_per_absolute_inferred_delta", "delta_price_alignment",
    ),
}
MINUTE_QUERIES = {
    "minute_bars": lambda spark, sf_dir: fx.plain(fx.rolled(spark, sf_dir, fx.MINUTE), *_names(BARS)),
    "minute_paths": _features(features.paths, fx.MINUTE, "return_1m", "return_5m", "return_15m", "return_30m", "return_60m", "trend_efficiency_5m", "trend_efficiency_15m", "realized_volatility_15m", "realized_volatility_60m", "volatility_ratio_15m_60m"),
    "minute_activity": _features(
        lambda df, s: features.session_clock(features.participation(features.acceleration(features.elapsed_ranges(df, s), s), s)), fx.MINUTE,
        "range_5m", "range_15m", "activity_acceleration_5m", "log_volume_1m", "log_trade_count_1m", "log_average_trade_size_1m", "trade_size_dispersion_1m",
        "log_max_trade_size_1m", "active_second_fraction_1m", "minutes_since_cme_open", "time_of_day_sin", "time_of_day_cos", "asia_flag", "europe_flag", "us_flag", "us_rth_flag",
    ),
    "minute_session": _features(lambda df, s: features.session_state(features.paths(df, s), s), fx.MINUTE, "session_vwap_distance", "session_range_position", "session_high_distance", "session_low_distance"),
    "minute_prior": _features(lambda df, s: features.prior_session(features.paths(df, s), s), fx.MINUTE, "prior_session_high_distance", "prior_session_low_distance", "prior_session_close_distance"),
    "minute_opening": _features(features.opening_range, fx.MINUTE, "us_opening_range_position"),
    "minute_baseline": _features(features.activity_baseline, fx.MINUTE, "relative_volume_q", "relative_trade_count_q"),
    "minute_flow": _features(
        lambda df, s: features.order_flow(features.activity_baseline(features.acceleration(features.paths(df, s), s), s), s), fx.MINUTE,
        "delta_1m", "delta_5m", "delta_15m", "trade_count_imbalance", "tick_imbalance", "delta_acceleration", "divergence_5m", "divergence_15m",
        "price_movement_per_volume", "price_movement_per_absolute_inferred_delta", "delta_price_alignment",
    ),
    "minute_targets": lambda spark, sf_dir: fx.plain(fx.minute_labels(spark, sf_dir), *_names(TARGETS)),
    "minute_reasons": lambda spark, sf_dir: targets.reason_counts(fx.minute_labels(spark, sf_dir)),
}
_QUERIES |= FEATURE_QUERIES | MINUTE_QUERIES


@query
def asof_reference(spark, sf_dir):
    found = targets.first_references(fx.seconds(spark, sf_dir), fx.HOUR.width, fx.TOLERANCE)
    df = found.select("session_date", "boundary", F.col("reference.ts").alias("ts"), F.col("reference.price").alias("price"), F.col("reference.id").alias("id"))
    return fx.plain(df, "session_date", "boundary", "ts", "price", "id")


@query
def forward_targets_v1(spark, sf_dir):
    names = [c for c in _names(TARGETS) if not c.endswith("reference_instrument_id")]
    return fx.plain(fx.labels(spark, sf_dir, False), *names)


@query
def forward_targets_v2(spark, sf_dir):
    return fx.plain(fx.labels(spark, sf_dir), *_names(TARGETS))


@query
def target_funnel(spark, sf_dir):
    df = targets.funnel(fx.labels(spark, sf_dir))
    return fx.plain(df, *df.columns)


@query
def target_reasons(spark, sf_dir):
    return targets.reason_counts(fx.labels(spark, sf_dir))


@query
def target_version_diff(spark, sf_dir):
    df = targets.version_diff(fx.labels(spark, sf_dir, False), fx.labels(spark, sf_dir))
    return fx.plain(df, *df.columns)


def _development(spark, sf_dir) -> DataFrame:
    return fx.folded(spark, sf_dir)


def _baselines(spark, sf_dir) -> DataFrame:
    return evaluation.baseline_probabilities(_development(spark, sf_dir), fx.MOMENTUM)


def _scored(spark, sf_dir) -> DataFrame:
    return evaluation.long_probabilities(_baselines(spark, sf_dir), {"baseline_0": "p_base", "baseline_1": "p_momentum"})


@query
def dev_sample(spark, sf_dir):
    return fx.plain(_development(spark, sf_dir), "fold", "part", "decision_timestamp", "return_1m", "target_up_15m", "future_reference_timestamp")


@query
def dev_folds(spark, sf_dir):
    df = evaluation.fold_report(_development(spark, sf_dir))
    return fx.plain(df, *df.columns)


@query
def midday_folds(spark, sf_dir):
    """Folds of days that change at noon (UTC), in mid-session: labels look across that edge, so the last ones before a fold are
    purged."""
    by_day = fx.sample(spark, sf_dir).withColumn("session_date", F.to_date(F.col("decision_timestamp") + F.expr("INTERVAL 12 HOURS")))
    df = evaluation.fold_report(evaluation.folds(by_day, fx.FOLDS))
    return fx.plain(df, *df.columns)


@query
def baseline_probabilities(spark, sf_dir):
    return fx.plain(_baselines(spark, sf_dir), "fold", "decision_timestamp", "target_up_15m", "p_base", "p_momentum")


@query
def probability_metrics(spark, sf_dir):
    df = evaluation.metrics(_scored(spark, sf_dir), ["fold", "model"])
    return fx.plain(df, *df.columns)


@query
def calibration(spark, sf_dir):
    df = evaluation.calibration(_scored(spark, sf_dir), ["fold", "model"])
    return fx.plain(df, *df.columns)


@query
def stability(spark, sf_dir):
    df = evaluation.metrics(evaluation.stability_groups(_scored(spark, sf_dir)), ["grp", "model"])
    return fx.plain(df, *df.columns)


@query
def probability_quantiles(spark, sf_dir):
    df = evaluation.quantiles(_scored(spark, sf_dir), ["fold", "model"])
    return fx.plain(df, *df.columns)


@query
def training_medians(spark, sf_dir):
    train = _development(spark, sf_dir).where("part = 'train'")
    return fx.plain(evaluation.preprocessing(train, fx.MODEL_FEATURES, ["fold"]), "fold", "feature", "rows", "nulls", "median")


@query
def training_scaler(spark, sf_dir):
    train = _development(spark, sf_dir).where("part = 'train'")
    df = evaluation.preprocessing(train, fx.MODEL_FEATURES, ["fold"])
    return fx.plain(df, "fold", "feature", "mean", "scale")


@query
def feature_distribution(spark, sf_dir):
    s = fx.TEN
    df = features.participation(features.elapsed_ranges(fx.prepared(spark, sf_dir, s), s), s)
    df = evaluation.distribution(df, ["range_5m", "range_15m", "log_volume_1m", "trade_size_dispersion_1m"])
    return fx.plain(df, *df.columns)


@query
def direction_agreement(spark, sf_dir):
    return audits.direction_agreement(fx.classified(spark, sf_dir))


@query
def first_second_coverage(spark, sf_dir):
    second = fx.seconds(spark, sf_dir)
    return audits.first_second_coverage(bars.roll_up(second, fx.HOUR.width), second, fx.HOUR.width, fx.HORIZON, fx.TOLERANCE)


def _standardized(spark, sf_dir) -> DataFrame:
    """Every fold's rows with predictors imputed and scaled by its own training rows."""

    def make() -> DataFrame:
        rows = evaluation.folds(fx.minute_sample(spark, sf_dir), fx.MINUTE_FOLDS)
        folds = [rows.where(F.col("fold") == n) for n in range(1, len(fx.MINUTE_FOLDS) + 1)]
        return reduce(DataFrame.unionByName, [models.standardized(own, own.where("part = 'train'"), PREDICTORS) for own in folds])

    return fx.kept(spark, sf_dir, "standardized", make)


@query
def logistic_model(spark, sf_dir):
    z, out = _standardized(spark, sf_dir), []
    for fold in range(1, len(fx.MINUTE_FOLDS) + 1):
        own = z.where(F.col("fold") == fold)
        model = models.fit_logistic(own.where("part = 'train'"), PREDICTORS)
        out.append(models.probabilities(model, own.where("part = 'validation'"), "p_logistic"))
    return fx.plain(reduce(DataFrame.unionByName, out), "fold", "decision_timestamp", "target_up_15m", "p_logistic")


Z = [f"z_{c}" for c in PREDICTORS]


def _boosted(spark, sf_dir) -> dict:
    """The folds' ensembles, grown side by side; leaves of 10 rows suit the fixture's few thousand rows."""
    key = spark.sparkContext.applicationId, sf_dir, fx.scratch.state_of(spark, f"{sf_dir}/events.parquet")
    if key not in _ENSEMBLES:
        _ENSEMBLES[key] = boosting.fit(_standardized(spark, sf_dir).where("part = 'train'"), Z, "fold", leaf=10)
    return _ENSEMBLES[key]


_ENSEMBLES: dict[tuple, dict] = {}


@query
def boosted_model(spark, sf_dir):
    rows = _standardized(spark, sf_dir).where("part = 'validation'")
    return fx.plain(boosting.probabilities(_boosted(spark, sf_dir), rows, "fold", "p_boosted"), "fold", "decision_timestamp", "target_up_15m", "p_boosted")


@query
def boosted_audit(spark, sf_dir):
    """The fitted ensembles against their specification, their saved form and their own predictions."""
    ensembles = _boosted(spark, sf_dir)
    z = _standardized(spark, sf_dir)
    return model_audit.boosted_checks(ensembles, z.where("part = 'train'"), z.where("part = 'validation'"), "fold", Z, rounds=200, leaves=7, leaf=10, rate=0.05, l2=1.0)


@query
def logistic_coefficients(spark, sf_dir):
    rows = evaluation.folds(fx.minute_sample(spark, sf_dir), fx.MINUTE_FOLDS).where("fold = 1 AND part = 'train'")
    z = models.standardized(rows, rows, PREDICTORS)
    found = models.coefficients(models.fit_logistic(fx.scratch.written(z, "standardized"), PREDICTORS), PREDICTORS)
    return fx.plain(spark.createDataFrame(found, "feature string, coefficient double"), "feature", "coefficient")


_QUERIES |= audit_plans.QUERIES


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (oracle.SQL | audit_oracle.SQL).items() if k in _QUERIES}
