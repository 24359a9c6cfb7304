"""The driver's events table as a tape, and the parameters that its density calls for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, evaluation, features, targets, ticks
from ..operators.features import Coverage, Settings
from ..schemas import IDENTITY, PREDICTORS
from ..sources import scratch, tape

COVERAGE = Coverage(
    "2024-01-01 00:00:00", "2024-01-31 00:00:00",
    (("2024-01-10", "2024-01-10 15:00:00", "2024-01-10 16:00:00"), ("2024-01-18", "2024-01-18 05:00:00", "2024-01-18 05:20:00")),
)
TEN = Settings(COVERAGE, 600, (1, 5, 15), (5, 15), (5, 15), (5, 15), 5, 20, (510, 570), 15)
HALF = Settings(COVERAGE, 1800, (1, 5, 15), (5, 15), (5, 15), (5, 15), 5, 10, (510, 570), 15)
HOUR = Settings(COVERAGE, 3600, (1, 3, 5), (3, 5), (3, 5), (3, 5), 3, 10, (510, 630), 5)
HORIZON, TOLERANCE = 3, 900
#: Bars of a minute with the defaults of the operators, over the dense tape.
MINUTE = Settings(COVERAGE)
FOLDS = [("2024-01-13", "2024-01-17"), ("2024-01-18", "2024-01-22"), ("2024-01-23", "2024-01-27")]
HOLDOUT, MINUTE_HOLDOUT = "2024-01-29", "2024-01-26"
MINUTE_FOLDS = [("2024-01-14", "2024-01-17"), ("2024-01-18", "2024-01-21"), ("2024-01-22", "2024-01-25")]
MOMENTUM = "return_1m"
#: Trades in a task of the tick rule, about.
TASK = 1 << 16
MODEL_FEATURES = ["return_1m", "return_3m", "log_volume_1m", "log_trade_count_1m", "trade_size_dispersion_1m", "delta_1m", "activity_acceleration_3m"]


def trades(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    make = tape.dense_trades_from_events if dense else tape.trades_from_events
    return tape.with_context(make(spark.read.parquet(f"{sf_dir}/events.parquet")))


def classified(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """The sparse tape's trades come in order, and it fails where they do not; the dense one deals them out anew, over 50 hours
    however many there are, so its chunks are minutes."""
    tasks = -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // TASK)
    return ticks.with_flow(ticks.tick_rule(trades(spark, sf_dir, dense), "minute" if dense else "hour", strict=not dense, tasks=tasks))


_KEPT: dict[tuple, DataFrame] = {}


def seconds(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """The layer that bars, labels and features start from."""
    return kept(spark, sf_dir, f"seconds-{dense}", lambda: bars.second_bars(classified(spark, sf_dir, dense)))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A layer that several queries start from: written once an application and state of the events table into the shared folder,
    so that no query carries its lineage along and a lost executor costs none of it. A table whose files have changed since is
    worked out anew; ``forget`` drops all."""
    key = spark.sparkContext.applicationId, sf_dir, scratch.state_of(spark, f"{sf_dir}/events.parquet"), name
    if key not in _KEPT:
        _KEPT[key] = scratch.written(make(), name)
    return _KEPT[key]


def forget() -> None:
    """The next query that needs a layer makes it from the table again."""
    _KEPT.clear()


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels of the hour bars before the holdout."""

    def make() -> DataFrame:
        df = prepared(spark, sf_dir, HOUR)
        df = features.session_clock(features.participation(features.acceleration(features.paths(df, HOUR), HOUR), HOUR))
        df = df.withColumn("delta_1m", F.col("inferred_delta") / F.col("total_volume"))
        return evaluation.development_sample(df, labels(spark, sf_dir), HOLDOUT)

    return kept(spark, sf_dir, "sample", make)


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.folds(sample(spark, sf_dir), FOLDS)


def minute_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predictors and labels of the minute bars before the holdout of the dense tape."""

    def make() -> DataFrame:
        df = features.all_features(rolled(spark, sf_dir, MINUTE), MINUTE)
        return evaluation.development_sample(df, minute_labels(spark, sf_dir), MINUTE_HOLDOUT).select(*IDENTITY, *PREDICTORS, "target_up_15m", "future_reference_timestamp")

    return kept(spark, sf_dir, "minute-sample", make)


def rolled(spark: SparkSession, sf_dir: str, s: Settings) -> DataFrame:
    return bars.roll_up(seconds(spark, sf_dir, s is MINUTE), s.width)


def prepared(spark: SparkSession, sf_dir: str, s: Settings) -> DataFrame:
    return features.prepare(rolled(spark, sf_dir, s), s)


def minute_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operators' defaults: a quarter of an hour ahead, references within ten seconds."""
    second = seconds(spark, sf_dir, True)
    return targets.forward_targets(bars.roll_up(second, MINUTE.width), second)


def labels(spark: SparkSession, sf_dir: str, contract_safe: bool = True) -> DataFrame:
    second = seconds(spark, sf_dir)
    return targets.forward_targets(bars.roll_up(second, HOUR.width), second, HOUR.width, HORIZON, TOLERANCE, contract_safe)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Columns for comparison across engines: instants as microseconds, dates as text, doubles at nine decimals."""
    types, out = dict(df.dtypes), []
    for n in names:
        kind = types[n]
        if kind == "timestamp":
            out.append(F.unix_micros(n).alias(f"{n}_us"))
        elif kind == "date":
            out.append(F.col(n).cast("string").alias(n))
        elif kind == "double":
            out.append((F.round(n, 9) + F.lit(0.0)).alias(n))
        elif kind in ("smallint", "tinyint"):
            out.append(F.col(n).cast("int").alias(n))
        else:
            out.append(F.col(n))
    return df.select(*out)
