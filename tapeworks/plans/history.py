"""All layers of a whole tape, written one after another: each starts from the one before as it was read back, holds every
session in its own folder, and is refused where it is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, evaluation, features, recount, targets, ticks
from ..operators.features import Settings
from ..schemas import BARS, FEATURES, IDENTITY, PREDICTIONS, PREDICTORS, SAMPLE, SECOND_BARS, TARGETS
from ..sources import layers, tape

#: Each layer's schema and order within a session.
LAYERS = {
    "seconds": (SECOND_BARS, ["timestamp_second", "instrument_id"]), "bars": (BARS, ["decision_timestamp"]), "targets": (TARGETS, ["decision_timestamp"]),
    "features": (FEATURES, ["decision_timestamp"]), "sample": (SAMPLE, ["decision_timestamp"]), "predictions": (PREDICTIONS, ["fold", "model", "decision_timestamp"]),
}


def write(df: DataFrame, root: str, name: str) -> DataFrame:
    ddl, order = LAYERS[name]
    return layers.write_layer(df, ddl, f"{root}/{name}", order)


def read(spark: SparkSession, root: str, name: str, session: str | None = None) -> DataFrame:
    return layers.read_layer(spark, LAYERS[name][0], f"{root}/{name}", session)


def build_layers(trades: DataFrame, root: str, s: Settings, horizon: int = 15, tolerance: int = 10) -> None:
    """Second bars, bars, labels and features of a tape, and a manifest with a row for each session."""
    seconds = write(bars.second_bars(ticks.with_flow(ticks.tick_rule(tape.with_context(trades)))), root, "seconds")
    minute = write(bars.roll_up(seconds, s.width), root, "bars")
    write(targets.forward_targets(minute, seconds, s.width, horizon, tolerance), root, "targets")
    write(features.all_features(minute, s).select(*IDENTITY, *PREDICTORS), root, "features")
    layers.write_manifest(bars.session_manifest(seconds), f"{root}/manifest")


def build_sample(spark: SparkSession, root: str, holdout: str) -> DataFrame:
    """The development sample of the written features and labels; sessions of the holdout are not read, and a sample that breaks
    the firewall is not written."""
    day = F.col("session_date") < F.lit(holdout).cast("date")
    sample = evaluation.development_sample(read(spark, root, "features").where(day), read(spark, root, "targets").where(day), holdout)
    return write(recount.assert_firewall(sample, holdout), root, "sample")


def build_predictions(spark: SparkSession, root: str, plan: list[tuple[str, str]], momentum: str = "return_15m") -> DataFrame:
    """The two baselines' probabilities on the validation rows of each fold."""
    scored = evaluation.baseline_probabilities(evaluation.folds(read(spark, root, "sample"), plan), momentum)
    long = evaluation.long_probabilities(scored, {"baseline_0": "p_base", "baseline_1": "p_momentum"})
    return write(long.select(*IDENTITY, "fold", "model", "p", "target_up_15m"), root, "predictions")


def compare_predictions(a: DataFrame, b: DataFrame, tolerance: float = 1e-14) -> DataFrame:
    """(check, rows, violations): two sets of predictions on the same rows, folds and models."""
    from ..operators.audits import disagreements

    return disagreements(a, b, ["fold", "model", *IDENTITY], ["p", "target_up_15m"], tolerance)
