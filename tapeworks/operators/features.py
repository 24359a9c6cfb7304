"""Causal features of bars. Every window lies inside one session, so all of them share one shuffle by session.

A *path* of h bars needs h bars in a row (exact elapsed time, one instrument); an *elapsed window* of h bars takes whatever
bars lie in the last h bar widths and is valid only where nothing was unavailable and no contract changed inside."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock

TINY = 1e-12


@dataclass(frozen=True)
class Coverage:
    """Where the source is complete: [start, end) and unavailable [from, to) intervals of sessions, all in UTC."""

    start: str
    end: str
    gaps: tuple[tuple[str, str, str], ...] = ()

    def starts_by(self, at: Column) -> Column:
        return F.lit(self.start).cast("timestamp") <= at

    def ends_after(self, at: Column) -> Column:
        return at <= F.lit(self.end).cast("timestamp")

    def overlaps(self, start: Column, end: Column, session: Column) -> Column:
        hit = F.lit(False)
        for day, a, b in self.gaps:
            hit |= (session == F.lit(day).cast("date")) & (start < F.lit(b).cast("timestamp")) & (F.lit(a).cast("timestamp") < end)
        return hit

    def first_gap(self, session: Column) -> Column:
        first = {}
        for day, a, _ in sorted(self.gaps, key=lambda g: g[1]):
            first.setdefault(day, a)
        case = F.lit(None).cast("timestamp")
        for day, a in first.items():
            case = F.when(session == F.lit(day).cast("date"), F.lit(a).cast("timestamp")).otherwise(case)
        return case


@dataclass(frozen=True)
class Settings:
    """Bar width in seconds and what the features look back on; the defaults are those of one-minute bars."""

    coverage: Coverage
    width: int = 60
    returns: Sequence[int] = (1, 5, 15, 30, 60)
    efficiencies: Sequence[int] = (5, 15)
    volatilities: Sequence[int] = (15, 60)
    ranges: Sequence[int] = (5, 15)
    recent: int = 5
    baseline_depth: int = 20
    opening: tuple[int, int] = (8 * 60 + 30, 9 * 60)
    scale: int = field(default=60)


def _shift(ts: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds * 1_000_000)


def _decision() -> Column:
    return F.col("decision_timestamp")


def _day() -> Column:
    return F.col("session_date")


def prepare(bars: DataFrame, s: Settings) -> DataFrame:
    """Adds the columns that the features share: seconds, runs of bars in a row, segments of one instrument, rolls, returns."""
    session = Window.partitionBy("session_date").orderBy("_t")
    df = bars.withColumn("_t", F.unix_seconds("decision_timestamp"))
    df = df.withColumns({"_pt": F.lag("_t").over(session), "_pi": F.lag("instrument_id").over(session), "_pc": F.lag("close").over(session)})
    roll = F.coalesce(F.col("_pi") != F.col("instrument_id"), F.lit(False))
    breaks = F.col("_pt").isNull() | (F.col("_t") - F.col("_pt") != s.width) | roll
    df = df.withColumns({"_roll": roll.cast("int"), "_break": breaks.cast("int")})
    df = df.withColumns({"_segment": F.sum("_roll").over(session), "_run": F.sum("_break").over(session)})
    run = Window.partitionBy("session_date", "_run").orderBy("_t")
    df = df.withColumn("_at", F.row_number().over(run) - 1)
    return df.withColumn("_r", F.when(F.col("_at") > 0, F.ln(F.col("close") / F.col("_pc"))))


def paths(df: DataFrame, s: Settings) -> DataFrame:
    """Returns, trend efficiency and realised volatility over exact paths; and the scale, the root of summed squares."""
    run = Window.partitionBy("session_date", "_run").orderBy("_t")
    over = lambda h: run.rowsBetween(-(h - 1), 0)
    when = lambda h, x: F.when(F.col("_at") >= h, x)
    new = {f"return_{h}m": when(h, F.ln(F.col("close") / F.lag("close", h).over(run))) for h in s.returns}
    for h in s.efficiencies:
        travel = F.sum(F.abs("_r")).over(over(h))
        new[f"trend_efficiency_{h}m"] = when(h, F.when(travel == 0, 0.0).otherwise(F.sum("_r").over(over(h)) / travel))
    square = F.col("_r") * F.col("_r")
    for h in s.volatilities:
        new[f"realized_volatility_{h}m"] = when(h, F.sqrt(F.sum(square).over(over(h)) / h))
    new["_scale"] = when(s.scale, F.sqrt(F.sum(square).over(over(s.scale))))
    df = df.withColumns(new)
    if len(s.volatilities) == 2:
        a, b = (F.col(f"realized_volatility_{h}m") for h in s.volatilities)
        df = df.withColumn("volatility_ratio_{}m_{}m".format(*s.volatilities), F.when(b > TINY, a / b))
    return df


def _interval_valid(s: Settings, start: Column, end: Column) -> Column:
    """All but the test for contract changes inside."""
    return (
        s.coverage.starts_by(start) & s.coverage.ends_after(end) & (start >= clock.session_open(_day())) & (end <= clock.session_close(_day()))
        & ~s.coverage.overlaps(start, end, _day())
    )


def _window(s: Settings, first: int, last: int):
    """Bars whose decision lies ``first`` to ``last`` bar widths from this one's."""
    return Window.partitionBy("session_date").orderBy("_t").rangeBetween(first * s.width, last * s.width)


def _one_contract(over) -> Column:
    """Holds where the window is empty, too."""
    own = F.col("instrument_id")
    return F.coalesce((F.min("instrument_id").over(over) == own) & (F.max("instrument_id").over(over) == own), F.lit(True))


def _no_roll(s: Settings, first: int) -> Column:
    """No contract change among the bars from ``first`` widths back to this one."""
    return F.sum("_roll").over(_window(s, first, 0)) == 0 if first <= 0 else F.lit(True)


def elapsed_ranges(df: DataFrame, s: Settings) -> DataFrame:
    new = {}
    for h in s.ranges:
        over = _window(s, -(h - 1), 0)
        valid = _interval_valid(s, _shift(_decision(), -h * s.width), _decision()) & _one_contract(over) & _no_roll(s, -(h - 2))
        new[f"range_{h}m"] = F.when(valid, F.ln(F.max("high").over(over) / F.min("low").over(over)))
    return df.withColumns(new)


def acceleration(df: DataFrame, s: Settings) -> DataFrame:
    """Volume against the mean of the ``recent`` bar widths before this bar; a window without bars has volume 0."""
    k = s.recent
    over = _window(s, -k, -1)
    valid = _interval_valid(s, _shift(_decision(), -(k + 1) * s.width), _shift(_decision(), -s.width)) & _one_contract(over) & _no_roll(s, -(k - 1))
    before = F.coalesce(F.sum("total_volume").over(over), F.lit(0)) / F.lit(float(k))
    return df.withColumns({"_recent_valid": valid, f"activity_acceleration_{k}m": F.when(valid, F.log1p("total_volume") - F.log1p(before))})


def participation(df: DataFrame, s: Settings) -> DataFrame:
    v, n = F.col("total_volume"), F.col("trade_count")
    mean = v / n
    return df.withColumns({
        "log_volume_1m": F.log1p(v),
        "log_trade_count_1m": F.log1p(n),
        "log_average_trade_size_1m": F.ln(mean),
        "trade_size_dispersion_1m": F.sqrt(F.greatest(F.col("size_squared_sum") / n - mean * mean, F.lit(0.0))) / mean,
        "log_max_trade_size_1m": F.log1p("max_trade_size"),
        "active_second_fraction_1m": F.col("active_second_count") / F.lit(float(s.width)),
    })


def session_clock(df: DataFrame) -> DataFrame:
    slot = clock.minutes_since_open(_decision(), _day())
    return df.withColumns({"minutes_since_cme_open": slot} | clock.time_of_day(slot) | clock.regimes(_decision()))


def activity_baseline(df: DataFrame, s: Settings) -> DataFrame:
    """Log volume and trade count against the medians of the last ``baseline_depth`` admitted bars of the same slot, from
    earlier sessions only. Bars outside the coverage or in a gap are not admitted, but are compared.

    The median behind each admitted bar has a bounded frame; the last one before a bar is carried to it."""
    start = F.col("minute_start")
    admitted = s.coverage.starts_by(start) & s.coverage.ends_after(_decision()) & ~s.coverage.overlaps(start, _decision(), _day())
    df = df.withColumns({"_slot": clock.minutes_since_open(_decision(), _day()), "_admitted": admitted})
    slot = Window.partitionBy("_slot").orderBy("session_date")
    df = df.withColumn("_bars_before", F.count("*").over(slot.rowsBetween(Window.unboundedPreceding, -1)))  # shuffles by slot
    depth, last = s.baseline_depth, Window.partitionBy("_slot", "_admitted").orderBy("session_date").rowsBetween(-(s.baseline_depth - 1), 0)

    def median(x: Column) -> Column:
        values = F.array_sort(F.collect_list(x).over(last))
        middle = (F.get(values, F.lit((depth - 1) // 2)) + F.get(values, F.lit(depth // 2))) / 2
        return F.when(F.col("_admitted") & (F.size(values) == depth), middle)

    df = df.withColumns({"_mv": median(F.log1p("total_volume")), "_mn": median(F.log1p("trade_count"))})
    before = slot.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_bv": F.last("_mv", ignorenulls=True).over(before), "_bn": F.last("_mn", ignorenulls=True).over(before)})
    return df.withColumns({
        "relative_volume_q": F.log1p("total_volume") - F.col("_bv"),
        "relative_trade_count_q": F.log1p("trade_count") - F.col("_bn"),
    })


def _distance(level: Column) -> Column:
    return F.when(F.col("_scale") > TINY, F.ln(F.col("close") / level) / F.col("_scale"))


def session_state(df: DataFrame, s: Settings) -> DataFrame:
    """Where the close stands in the session so far, since the last change of contract."""
    so_far = Window.partitionBy("session_date", "_segment").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    gap = s.coverage.first_gap(_day())
    valid = s.coverage.starts_by(clock.session_open(_day())) & (gap.isNull() | (_decision() <= gap))
    vwap = F.sum("price_volume_sum").over(so_far) / F.sum("total_volume").over(so_far)
    df = df.withColumns({"_vwap": vwap, "_high": F.max("high").over(so_far), "_low": F.min("low").over(so_far)})
    span = F.col("_high") - F.col("_low")
    return df.withColumns({
        "session_vwap_distance": F.when(valid, _distance(F.col("_vwap"))),
        "session_range_position": F.when(valid, F.when(span == 0, 0.5).otherwise((F.col("close") - F.col("_low")) / span)),
        "session_high_distance": F.when(valid, _distance(F.col("_high"))),
        "session_low_distance": F.when(valid, _distance(F.col("_low"))),
    })


def session_levels(bars: DataFrame, s: Settings) -> DataFrame:
    """One row a session: its levels, and whether later sessions may be compared with it."""
    levels = bars.groupBy("session_date").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "decision_timestamp").alias("close"),
        F.max("decision_timestamp").alias("last_decision"), F.min("instrument_id").alias("id"),
        (F.min("instrument_id") == F.max("instrument_id")).alias("single"),
    )
    start, end = clock.session_open(_day()), clock.session_close(_day())
    gap_free = s.coverage.first_gap(_day()).isNull()
    return levels.withColumn("comparable", F.col("single") & s.coverage.starts_by(start) & s.coverage.ends_after(end) & gap_free)


def prior_session(df: DataFrame, s: Settings) -> DataFrame:
    """Distances from the levels of the session observed just before, if that one may be compared; never one further back."""
    levels = session_levels(df, s)
    kept = F.struct("high", "low", "close", "last_decision", "id", "comparable")
    prior = levels.select("session_date", F.lag(kept).over(Window.orderBy("session_date")).alias("_prior"))  # a row a session
    df = df.join(prior, "session_date")
    usable = F.col("_prior.comparable") & (F.col("_prior.last_decision") < _decision()) & (F.col("_prior.id") == F.col("instrument_id"))
    return df.withColumns({f"prior_session_{x}_distance": F.when(usable, _distance(F.col(f"_prior.{x}"))) for x in ("high", "low", "close")})


def opening_range(df: DataFrame, s: Settings) -> DataFrame:
    """Where the close stands in the opening range, unclipped, once that is complete: every bar of it, one contract."""
    first, last = s.opening
    start, end = clock.session_time(_day(), first), clock.session_time(_day(), last)
    inside = (F.col("minute_start") >= start) & (F.col("minute_start") < end)
    pick = lambda x: F.when(inside, F.col(x))
    bars, session = (last - first) * 60 // s.width, Window.partitionBy("session_date")
    df = df.withColumns({
        "_or_high": F.max(pick("high")).over(session), "_or_low": F.min(pick("low")).over(session), "_or_id": F.min(pick("instrument_id")).over(session),
        "_or_id2": F.max(pick("instrument_id")).over(session), "_or_bars": F.count(pick("minute_start")).over(session),
    })
    whole = (F.col("_or_bars") == bars) & (F.col("_or_id") == F.col("_or_id2")) & (F.col("_or_id") == F.col("instrument_id"))
    valid = (_decision() >= end) & whole & _interval_valid(s, start, end)
    span = F.col("_or_high") - F.col("_or_low")
    return df.withColumn("us_opening_range_position", F.when(valid, F.when(span == 0, 0.5).otherwise((F.col("close") - F.col("_or_low")) / span)))


def order_flow(df: DataFrame, s: Settings) -> DataFrame:
    """Features of inferred order flow; needs paths, acceleration and activity_baseline before it."""
    return flow_scores(flow_windows(df, s), s)


def flow_windows(df: DataFrame, s: Settings) -> DataFrame:
    """Those that look back in the session."""
    d, v = F.col("inferred_delta"), F.col("total_volume")
    buys, sells = F.col("inferred_buy_trade_count"), F.col("inferred_sell_trade_count")
    ups, downs = F.col("uptick_count"), F.col("downtick_count")
    share = lambda a, b: F.when(b > 0, a / b)
    new = {
        "delta_1m": share(d, v),
        "trade_count_imbalance": share(buys - sells, buys + sells),
        "tick_imbalance": share(ups - downs, ups + downs),
    }
    for h in s.ranges:
        over = _window(s, -(h - 1), 0)
        valid = _interval_valid(s, _shift(_decision(), -h * s.width), _decision()) & _one_contract(over) & _no_roll(s, -(h - 2))
        new[f"delta_{h}m"] = F.when(valid, share(F.sum(d).over(over), F.sum(v).over(over)))
    over = _window(s, -s.recent, -1)
    recent = F.when(F.col("_recent_valid"), share(F.sum(d).over(over), F.sum(v).over(over)))
    new["delta_acceleration"] = new["delta_1m"] - recent
    return df.withColumns(new)


def flow_scores(df: DataFrame, s: Settings) -> DataFrame:
    """Those that combine others on the same row."""
    d, v = F.col("inferred_delta"), F.col("total_volume")
    z = F.when(F.col("_scale") > TINY, F.abs("_r") / F.col("_scale"))
    usual = F.exp("_bv")
    return df.withColumns({
        **{f"divergence_{h}m": -F.col(f"trend_efficiency_{h}m") * F.col(f"delta_{h}m") for h in s.ranges if h in s.efficiencies},
        "price_movement_per_volume": z / (1 + (1 + v) / usual),
        "price_movement_per_absolute_inferred_delta": z / (1 + F.abs(d) / usual),
        "delta_price_alignment": F.col("delta_1m") * F.when(F.col("_scale") > TINY, F.col("_r") / F.col("_scale")),
    })


def all_features(bars: DataFrame, s: Settings) -> DataFrame:
    """Bars with every feature. Columns that start with an underscore are working columns. What looks back in a session comes
    first and shares its shuffle; the baseline, which looks across sessions, comes after."""
    df = session_clock(participation(acceleration(elapsed_ranges(paths(prepare(bars, s), s), s), s), s))
    df = flow_windows(opening_range(session_state(df, s), s), s)
    return flow_scores(activity_baseline(prior_session(df, s), s), s)
