"""Invariants of each layer as one aggregate row, and checks against independent re-computation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.carry import lag_across
from .targets import REASONS


def checks(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """(check, rows, violations): how many rows there are, and how many break each rule; one pass over the table."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in broken.items()])
    return _long(counts, {n: ("_rows", n) for n in broken})


def _long(counts: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row of counts as (check, rows, violations); names: which columns a check has."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(a).alias("rows"), F.col(b).alias("violations")) for n, (a, b) in names.items()])
    return counts.select(F.explode(rows).alias("_c")).select("_c.*")


def duplicate_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return checks(df.groupBy(*keys).count(), {name: F.col("count") > 1})


def tape_order(trades: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """Whether event times never go back in the order of ``seq``. The tape is cut into chunks of ``rows`` sequence numbers; the
    last time of a chunk is carried to the next over one row a chunk."""
    df = trades.select("seq", "ts_event", F.floor(F.col("seq") / rows).alias("chunk"))
    df = lag_across(df, "chunk", ["seq"], {"_before": "ts_event"})
    return checks(df, {"tape_order": F.coalesce(F.col("ts_event") < F.col("_before"), F.lit(False))})


def second_bar_checks(seconds: DataFrame) -> DataFrame:
    c = F.col
    inside = (c("open") <= c("high")) & (c("open") >= c("low")) & (c("close") <= c("high")) & (c("close") >= c("low")) & (c("low") <= c("high"))
    second = lambda x: F.date_trunc("second", c(x)) == c("timestamp_second")
    rules = checks(seconds, {
        "seconds_prices": ~inside, "seconds_positive": ~((c("low") > 0) & (c("total_volume") > 0) & (c("trade_count") > 0)),
        "seconds_inferred_volume": c("inferred_buy_volume") + c("inferred_sell_volume") + c("inferred_unknown_volume") != c("total_volume"),
        "seconds_native_volume": c("native_buy_volume") + c("native_sell_volume") + c("native_unknown_volume") != c("total_volume"),
        "seconds_inferred_delta": c("inferred_buy_volume") - c("inferred_sell_volume") != c("inferred_delta"),
        "seconds_native_delta": c("native_buy_volume") - c("native_sell_volume") != c("native_delta"),
        "seconds_counts": c("inferred_buy_trade_count") + c("inferred_sell_trade_count") + c("inferred_unknown_trade_count") != c("trade_count"),
        "seconds_moves": c("uptick_count") + c("downtick_count") + c("same_price_count") > c("trade_count"),
        "seconds_level_volume": ~((c("max_volume_at_price") <= c("total_volume")) & (c("unique_price_levels") <= c("trade_count"))),
        "seconds_times": ~((c("first_trade_timestamp") <= c("last_trade_timestamp")) & second("first_trade_timestamp") & second("last_trade_timestamp")),
        "seconds_session": clock.session_date(c("timestamp_second")) != c("session_date"),
    })
    before = F.lag("last_trade_timestamp").over(Window.partitionBy("session_date").orderBy("timestamp_second", "instrument_id"))
    ordered = checks(seconds.select("first_trade_timestamp", before.alias("_before")), {"seconds_order": F.coalesce(c("first_trade_timestamp") < c("_before"), F.lit(False))})
    names = seconds.groupBy("instrument_id").agg(F.count_distinct("contract").alias("contracts"))
    single = seconds.groupBy("timestamp_second").agg(F.count_distinct("session_date").alias("sessions"))
    rules = rules.union(ordered).union(checks(names, {"seconds_contract": c("contracts") != 1})).union(checks(single, {"seconds_single_session": c("sessions") != 1}))
    return rules.union(duplicate_keys(seconds, "seconds_key", ["timestamp_second", "instrument_id"]))


def bar_checks(bars: DataFrame, seconds: DataFrame) -> DataFrame:
    c = F.col
    rules = checks(bars, {
        "bars_time": c("last_trade_timestamp") >= c("decision_timestamp"),
        "bars_start": c("first_trade_timestamp") < c("minute_start"),
        "bars_positive": ~((c("total_volume") > 0) & (c("trade_count") > 0) & (c("low") > 0)),
        "bars_prices": ~((c("low") <= c("open")) & (c("open") <= c("high")) & (c("low") <= c("close")) & (c("close") <= c("high"))),
    })
    totals = lambda df, p: df.groupBy("session_date").agg(F.sum("total_volume").alias(f"{p}v"), F.sum("trade_count").alias(f"{p}n"), F.sum("price_volume_sum").alias(f"{p}p"))
    both = totals(bars, "a").join(totals(seconds, "b"), "session_date", "full")
    rules = rules.union(checks(both, {"bars_totals": (c("av") != c("bv")) | (c("an") != c("bn")) | (F.abs(c("ap") - c("bp")) > 1e-9 * F.abs(c("bp")))}))
    return rules.union(duplicate_keys(bars, "bars_key", ["decision_timestamp"]))


def target_checks(targets: DataFrame, tolerance: int) -> DataFrame:
    c, reason = F.col, F.col("eligibility_reason")
    late = lambda x: c(x).isNotNull() & ((c(x) < 0) | (c(x) >= tolerance))
    rules = checks(targets, {
        "targets_reason": ~reason.isin(REASONS),
        "targets_eligible": c("target_eligible") != (reason == REASONS[9]),
        "targets_label": c("target_up_15m").isNotNull() != c("target_eligible"),
        "targets_sign": F.coalesce(c("target_up_15m") != (c("forward_price_change") > 0).cast("int"), F.lit(False)),
        "targets_delay": late("start_reference_delay_seconds") | late("future_reference_delay_seconds"),
        "targets_contract": F.coalesce(
            c("target_eligible") & ((c("start_reference_instrument_id") != c("instrument_id")) | (c("future_reference_instrument_id") != c("instrument_id"))), F.lit(False)
        ),
        "targets_equal": (reason == REASONS[8]) != F.coalesce(c("forward_price_change") == 0, F.lit(False)),
    })
    return rules.union(duplicate_keys(targets, "targets_key", ["decision_timestamp"]))


def feature_checks(df: DataFrame, h: tuple[int, ...], vols: tuple[int, ...]) -> DataFrame:
    """Plausible ranges; null is always allowed."""
    c, eps = F.col, 1e-12
    out = lambda x, a, b: c(x).isNotNull() & ~c(x).between(a - eps, b + eps)
    bad = lambda xs: reduce(lambda a, b: a | b, xs)
    return checks(df, {
        "features_flags": bad([~c(x).isin(0, 1) for x in ("asia_flag", "europe_flag", "us_flag", "us_rth_flag")]),
        "features_fraction": out("active_second_fraction_1m", 0, 1),
        "features_position": out("session_range_position", 0, 1),
        "features_efficiency": bad([out(f"trend_efficiency_{x}m", -1, 1) for x in h]),
        "features_volatility": bad([F.coalesce(c(f"realized_volatility_{x}m") < -eps, F.lit(False)) for x in vols]),
        "features_not_finite": bad([F.coalesce(F.isnan(c(x)) | (F.abs(c(x)) == float("inf")), F.lit(False)) for x, t in df.dtypes if t == "double"]),
    })


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """(check, rows, violations) for each column: how many values the first has, and how many rows differ by more than the
    tolerance, relative or absolute, or in nullness, or are there on one side only."""
    kinds = dict(a.dtypes)
    b = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.select(*keys, *columns, F.lit(1).alias("_left")).join(b.withColumn("_right", F.lit(1)), keys, "full")
    one_sided = F.col("_left").isNull() | F.col("_right").isNull()

    def differs(c: str) -> Column:
        x, y = F.col(c), F.col(f"_b_{c}")
        number = kinds[c] in ("double", "float", "bigint", "int", "smallint", "tinyint")
        far = F.abs(x - y) > F.greatest(F.lit(1.0), F.abs(x), F.abs(y)) * tolerance if number else x != y
        return one_sided | (x.isNull() != y.isNull()) | F.coalesce(far, F.lit(False))

    counts = both.agg(*[F.count(c).alias(f"_n_{c}") for c in columns], *[F.count_if(differs(c)).alias(f"_v_{c}") for c in columns])
    return _long(counts, {c: (f"_n_{c}", f"_v_{c}") for c in columns})


def completeness(seconds: DataFrame, start: str, end: str, degraded: tuple[str, ...] = ()) -> DataFrame:
    """One row a session: whether the source covers it from open to close, and whether a degraded day touches it."""
    day = F.col("session_date")
    sessions = seconds.select("session_date").distinct()
    whole = (F.lit(start).cast("timestamp") <= clock.session_open(day)) & (clock.session_close(day) <= F.lit(end).cast("timestamp"))
    days = [F.lit(x).cast("date") for x in degraded]
    touched = (day.isin(*days) | F.date_sub(day, 1).isin(*days)) if days else F.lit(False)
    return sessions.select("session_date", whole.alias("complete"), touched.alias("degraded"))


def direction_agreement(rows: DataFrame) -> DataFrame:
    """How often the tick rule agrees with the venue's own side where both know one, by trades and by volume, split by
    whether the price changed; rows are classified trades with flow columns."""
    native = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1)
    known = rows.withColumn("_native", native).where(F.col("_native").isNotNull() & (F.col("direction") != 0))
    moved = F.coalesce(F.col("change") != 0, F.lit(False)).alias("moved")
    agree = F.col("_native") == F.col("direction")
    return known.groupBy(moved).agg(
        F.count("*").alias("trades"), F.count_if(agree).alias("agreeing_trades"), F.sum("size").alias("volume"),
        F.coalesce(F.sum(F.when(agree, F.col("size"))), F.lit(0)).alias("agreeing_volume"),
    )


def flow_correlation(seconds: DataFrame) -> DataFrame:
    """One row a session: the correlation of inferred and native net volume over the seconds, and how often their signs agree where
    neither is zero."""
    a, b = F.col("inferred_delta"), F.col("native_delta")
    both = (a != 0) & (b != 0)
    return seconds.groupBy("session_date").agg(
        F.count("*").alias("seconds"), F.count_if(both).alias("both_known"), F.count_if(both & (F.signum(a) == F.signum(b))).alias("same_sign"),
        F.corr(a.cast("double"), b.cast("double")).alias("correlation"),
    )


def first_second_by_regime(bars: DataFrame, seconds: DataFrame, width: int, tolerance: int) -> DataFrame:
    """By regime of the decision: how many bars have a trade in the first second after it, and within the tolerance."""
    from .targets import first_references

    found = first_references(seconds, width, tolerance).select("session_date", F.col("boundary").alias("decision_timestamp"), F.col("reference.ts").alias("_at"))
    rows = bars.select("session_date", "decision_timestamp").join(found, ["session_date", "decision_timestamp"], "left")
    flags = clock.regimes(F.col("decision_timestamp"))
    names = F.array(*[F.when(flag == 1, F.lit(name.removesuffix("_flag"))) for name, flag in flags.items()])
    rows = rows.withColumn("regime", F.explode(F.filter(names, lambda x: x.isNotNull())))
    early = F.unix_micros("_at") < F.unix_micros("decision_timestamp") + 1_000_000
    return rows.groupBy("regime").agg(F.count("*").alias("bars"), F.count_if(early).alias("exact"), F.count("_at").alias("within"))


def first_second_coverage(bars: DataFrame, seconds: DataFrame, width: int, horizon: int, tolerance: int) -> DataFrame:
    """How many bars have a trade in the first second after their decision, or within the tolerance, at the decision alone and
    at both ends of the horizon."""
    from .targets import first_references

    found = first_references(seconds, width, tolerance)
    seen = found.select(F.unix_seconds("boundary").alias("_b"), (F.unix_micros("reference.ts") < F.unix_micros("boundary") + 1_000_000).alias("exact"))
    seen = seen.groupBy("_b").agg(F.max("exact").alias("exact"))
    t = F.unix_seconds("decision_timestamp")
    rows = bars.select(t.alias("_t"), (t + horizon * width).alias("_u"))
    rows = rows.join(seen.select(F.col("_b").alias("_t"), F.col("exact").alias("e1")), "_t", "left")
    rows = rows.join(seen.select(F.col("_b").alias("_u"), F.col("exact").alias("e2")), "_u", "left")
    return rows.agg(
        F.count("*").alias("bars"), F.count_if("e1").alias("exact_start"), F.count_if(F.col("e1") & F.col("e2")).alias("exact_pair"),
        F.count_if(F.col("e1").isNotNull()).alias("within_start"), F.count_if(F.col("e1").isNotNull() & F.col("e2").isNotNull()).alias("within_pair"),
    )
