"""Chronological folds with purged training labels, baselines, probability metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import IDENTITY


def development_sample(features: DataFrame, targets: DataFrame, before: str | None = None) -> DataFrame:
    """Features joined one to one with eligible labels; rows from session ``before`` on (a holdout) are never read."""
    labels = targets.where(F.col("target_eligible") & F.col("target_up_15m").isNotNull())
    if before:
        first = F.lit(before).cast("date")
        labels, features = labels.where(F.col("session_date") < first), features.where(F.col("session_date") < first)
    labels = labels.select(*IDENTITY, "target_up_15m", "future_boundary_timestamp", "future_reference_timestamp")
    return features.join(labels, IDENTITY)


def folds(sample: DataFrame, plan: list[tuple[str, str]]) -> DataFrame:
    """The sample once for each fold it belongs to, with fold and part: ``train`` before the first validation session,
    ``purged`` where a training label's actual future trade comes at or after the first validation decision,
    ``validation`` from the first to the last session of the fold. Folds are numbered from 1; one without validation rows purges
    nothing."""
    spans = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, (a, b) in enumerate(plan, 1)])
    rows = sample.withColumn("_f", F.explode(spans)).where(F.col("session_date") <= F.col("_f.b"))
    rows = rows.withColumn("fold", F.col("_f.fold")).withColumn("_v", F.col("session_date") >= F.col("_f.a"))
    edges = rows.where("_v").groupBy("fold").agg(F.min("decision_timestamp").alias("_edge"))  # a row a fold
    rows = rows.join(F.broadcast(edges), "fold", "left")
    part = F.when(F.col("_v"), "validation").when(F.col("future_reference_timestamp") >= F.col("_edge"), "purged").otherwise("train")
    return rows.withColumn("part", part).drop("_f", "_v", "_edge")


def fold_report(rows: DataFrame) -> DataFrame:
    of = lambda p: F.col("part") == p
    return rows.groupBy("fold").agg(
        F.count_if(~of("validation")).alias("raw_training_rows"), F.count_if(of("purged")).alias("purged_rows"),
        F.count_if(of("train")).alias("final_training_rows"), F.count_if(of("validation")).alias("validation_rows"),
        F.count_distinct(F.when(of("validation"), F.col("session_date"))).alias("validation_sessions"),
        F.max(F.when(of("train"), F.col("future_reference_timestamp"))).alias("latest_training_reference"),
        F.min(F.when(of("validation"), F.col("decision_timestamp"))).alias("earliest_validation_decision"),
    )


def baseline_probabilities(rows: DataFrame, momentum: str = "return_15m") -> DataFrame:
    """The validation rows with p_base, the smoothed training rate of the fold, and p_momentum, that of the rows whose
    momentum has the same sign; neutral or missing momentum gets the overall rate."""
    state = F.when(F.col(momentum) > 0, "up").when(F.col(momentum) < 0, "down")
    train = rows.where("part = 'train'")
    rate = lambda where: (F.sum(F.when(where, F.col("target_up_15m"))) + 1) / (F.count_if(where) + 2)
    fitted = train.groupBy("fold").agg(
        rate(F.lit(True)).alias("p_base"),
        F.coalesce(rate(state == "up"), F.lit(0.5)).alias("_up"), F.coalesce(rate(state == "down"), F.lit(0.5)).alias("_down"),
    )
    out = rows.where("part = 'validation'").join(F.broadcast(fitted), "fold")  # a row a fold
    choice = F.when(state == "up", F.col("_up")).when(state == "down", F.col("_down")).otherwise(F.col("p_base"))
    return out.withColumn("p_momentum", choice).drop("_up", "_down")


def long_probabilities(predictions: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row for each prediction and model: (keys, model, p, y)."""
    pairs = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p")) for name, c in models.items()])
    return predictions.withColumn("_m", F.explode(pairs)).select("*", F.col("_m.model").alias("model"), F.col("_m.p").alias("p"), F.col("target_up_15m").cast("int").alias("y")).drop("_m")


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Log loss, Brier score, accuracy at one half and the exact area under the ROC curve, ties counted half.

    Rows are first added up by probability. The ranks are prefix sums in two steps, over slots of probability and within a
    slot, so no window spans a group. The columns ``by`` must not be null."""
    p, y = F.col("p"), F.col("y")
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    tied = rows.groupBy(*by, "p").agg(
        F.count("*").alias("n"), F.sum("y").alias("ups"), F.sum(loss).alias("loss"), F.sum((p - y) * (p - y)).alias("square"),
        F.count_if((p >= 0.5) == (y == 1)).alias("right"),
    )
    downs = F.col("n") - F.col("ups")
    tied = _before(tied.withColumn("_downs", downs), by, p, "_downs", F.floor(p * 4096).cast("int"))
    tied = tied.withColumn("won", F.col("ups") * (F.col("before") + downs / 2.0))
    n, ups = F.sum("n"), F.sum("ups")
    pairs = ups * (n - ups)
    return tied.groupBy(*by).agg(
        n.alias("rows"), ups.alias("up"), (n - ups).alias("down"), (ups / n).alias("up_rate"), (F.sum("loss") / n).alias("log_loss"),
        (F.sum("square") / n).alias("brier_score"), F.when(pairs > 0, F.sum("won") / pairs).alias("roc_auc"), (F.sum("right") / n).alias("accuracy"),
    )


def _before(rows: DataFrame, by: list[str], value: Column, count: str, slot: Column) -> DataFrame:
    """Adds before, the sum of ``count`` over the rows of the group with a smaller value, and total, that over all of it. Values are
    distinct in a group; slot must not descend with the value, and takes a few thousand values, over which one window runs."""
    rows = rows.withColumn("_slot", slot)
    slots = rows.groupBy(*by, "_slot").agg(F.sum(count).alias("_n"))
    group = Window.partitionBy(*by)
    below = F.coalesce(F.sum("_n").over(group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.select(*by, "_slot", below.alias("_below"), F.sum("_n").over(group).alias("total"))
    inside = Window.partitionBy(*by, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(slots, [*by, "_slot"]).withColumn("before", F.col("_below") + F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return rows.drop("_slot", "_below")


def exact_quantiles(rows: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles, interpolated linearly, of the values that are not null: a column for each of ``shares``.

    Values are first counted; ranks are prefix sums over slots of the value's sign and magnitude, then within a slot."""
    value = F.col(x)
    counted = rows.where(value.isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_count"))
    magnitude = F.when(value == 0, 0).otherwise(F.signum(value) * (F.floor(F.log2(F.abs(value)) * 8) + 10_000)).cast("int")
    placed = _before(counted, by, value, "_count", magnitude)
    out = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("total") - 1)
        low, high = (F.max(F.when(F.col("before") <= f(at), value)) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*by).agg(*out)


def metric_deltas(rows: DataFrame, reference: str, by: list[str]) -> DataFrame:
    """By how much each other model improves on the reference model: losses less, area and accuracy more."""
    less, more = ("log_loss", "brier_score"), ("roc_auc", "accuracy")
    base = rows.where(F.col("model") == reference).select(*by, *[F.col(c).alias(f"_{c}") for c in less + more])
    out = rows.where(F.col("model") != reference).join(base, by)
    gains = [(F.col(f"_{c}") - F.col(c)).alias(f"{c}_improvement") for c in less] + [(F.col(c) - F.col(f"_{c}")).alias(f"{c}_improvement") for c in more]
    return out.select(*by, "model", *gains)


def calibration(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins of probability, empty ones too."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("rows"), F.avg("p").alias("mean_predicted_up"), F.avg("y").alias("observed_up_rate"))
    every = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*by, "bin"], "left").fillna(0, ["rows"])


def stability_groups(rows: DataFrame) -> DataFrame:
    """Each row once for its month and once for each regime it lies in (regimes overlap)."""
    regimes = {"regime:Asia": "asia_flag", "regime:Europe": "europe_flag", "regime:U.S.": "us_flag", "regime:U.S. RTH": "us_rth_flag"}
    names = [F.concat(F.lit("month:"), F.date_format("session_date", "yyyy-MM"))]
    names += [F.when(F.col(c) == 1, F.lit(n)) for n, c in regimes.items()]
    return rows.withColumn("grp", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))


def quantiles(rows: DataFrame, by: list[str], shares: tuple[float, ...] = (0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1)) -> DataFrame:
    """Exact quantiles of probability, interpolated linearly."""
    return exact_quantiles(rows, by, "p", {f"q{round(q * 100)}": float(q) for q in shares})


def preprocessing(train: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """For each column, in long form: nulls, the exact training median, and the mean and population scale after the median has
    filled the nulls (a scale of 0 becomes 1). The columns ``by`` must not be null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = train.withColumn("_x", F.explode(pairs)).select(*by, "_x.feature", "_x.x")
    keys = [*by, "feature"]
    known = long.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("x").isNull()).alias("nulls"), F.sum("x").alias("_s"), F.min("x").alias("_a"), F.max("x").alias("_b"))
    known = known.join(exact_quantiles(long, keys, "x", {"median": 0.5}), keys, "left")
    m = F.coalesce("median", F.lit(0.0))
    known = known.withColumn("mean", (F.coalesce("_s", F.lit(0.0)) + F.col("nulls") * m) / F.col("rows"))
    away = F.coalesce(F.col("x"), m) - F.col("mean")  # centred first: no difference of large squares
    spread = long.join(F.broadcast(known.select(*keys, "median", "mean")), keys).groupBy(*keys).agg(F.avg(away * away).alias("_v"))  # a row a feature and group
    scale = F.when(F.coalesce(F.col("_a") == F.col("_b"), F.lit(True)), 1.0).otherwise(F.sqrt("_v"))
    return known.join(spread, keys).withColumn("scale", scale).drop("_s", "_a", "_b", "_v")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: how many values are there, finite ones and the share of nulls, least, median and greatest."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(pairs).alias("_x")).select("_x.feature", "_x.x")
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    found = long.groupBy("feature").agg(
        F.count("x").alias("present"), F.count_if(F.col("x").isNull()).alias("absent"), F.count_if(finite).alias("finite"),
        (F.count_if(F.col("x").isNull()) / F.count("*")).alias("null_share"), F.min("x").alias("least"), F.max("x").alias("greatest"),
    )
    return found.join(exact_quantiles(long, ["feature"], "x", {"median": 0.5}), "feature", "left")


def share(where: Column) -> Column:
    return F.count_if(where) / F.count("*")
