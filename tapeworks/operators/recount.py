"""Layers worked out a second time by other algorithms, and compared: where a layer comes from windows, its recount comes from
joins and grouped sums, and the other way round. Each comparison gives (check, rows, violations): for each column, how many rows
have a value and how many differ."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..schemas import SUMS
from .audits import checks, disagreements
from .bars import _TRADE_SUMS, floor_to
from .features import TINY, Settings, _interval_valid, _shift
from .targets import REASONS


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- bars, straight from trades


def bars_from_trades(rows: DataFrame, width: int) -> DataFrame:
    """Bars by one aggregation of classified trades with flow columns, without second bars between."""
    order = F.struct("ts_event", "seq", "price")
    start = floor_to(F.col("ts_event"), width)
    out = rows.groupBy(start.alias("minute_start"), "session_date").agg(
        F.min("instrument_id").alias("instrument_id"), F.max("contract").alias("contract"), F.min(order)["price"].alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max(order)["price"].alias("close"), *[F.sum(_TRADE_SUMS.get(c, c)).alias(c) for c in SUMS if c in _TRADE_SUMS],
        F.count("*").alias("trade_count"), F.max("size").alias("max_trade_size"), F.count_distinct("timestamp_second").alias("active_second_count"),
        F.min("ts_event").alias("first_trade_timestamp"), F.max("ts_event").alias("last_trade_timestamp"),
    )
    return out.withColumn("decision_timestamp", _shift(F.col("minute_start"), width))


def bars_recount(bars: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Every column of the bars against an aggregation of the trades."""
    columns = ["instrument_id", "contract", "open", "high", "low", "close", *SUMS, "max_trade_size", "active_second_count", "first_trade_timestamp", "last_trade_timestamp"]
    return disagreements(bars, bars_from_trades(rows, width), ["decision_timestamp", "session_date"], columns)


# --- the dataset against a scan of the raw trades


def dataset_audit(trades: DataFrame, seconds: DataFrame) -> DataFrame:
    """One row a session: rows, trades, volume and contract changes of the second bars against a scan of the trades alone."""
    per_second = trades.groupBy("session_date", "timestamp_second", "instrument_id").agg(F.count("*").alias("n"), F.sum("size").alias("v"))
    raw = per_second.groupBy("session_date").agg(
        F.count("*").alias("raw_seconds"), F.sum("n").alias("raw_trades"), F.sum("v").alias("raw_volume"), F.count_distinct("instrument_id").alias("raw_instruments"),
        F.min("timestamp_second").alias("raw_first_second"), F.max("timestamp_second").alias("raw_last_second"),
    )
    layer = seconds.groupBy("session_date").agg(
        F.count("*").alias("bar_rows"), F.sum("trade_count").alias("bar_trades"), F.sum("total_volume").alias("bar_volume"),
        F.count_distinct("instrument_id").alias("bar_instruments"), F.min("timestamp_second").alias("bar_first_second"), F.max("timestamp_second").alias("bar_last_second"),
    )
    pairs = [("seconds", "rows"), ("trades", "trades"), ("volume", "volume"), ("instruments", "instruments"), ("first_second", "first_second"), ("last_second", "last_second")]
    agrees = reduce(lambda a, b: a & b, [F.col(f"raw_{a}").eqNullSafe(F.col(f"bar_{b}")) for a, b in pairs])
    return raw.join(layer, "session_date", "full").withColumn("agrees", agrees)


def session_breakdown(seconds: DataFrame) -> DataFrame:
    """One row for each session and instrument: bars, trades, volume, first and last trade, and when the tape changed to it."""
    changed = F.when(F.col("contract_change"), F.col("first_trade_timestamp"))
    return seconds.groupBy("session_date", "instrument_id", "contract").agg(
        F.count("*").alias("bar_rows"), F.sum("trade_count").alias("trades"), F.sum("total_volume").alias("volume"),
        F.min("first_trade_timestamp").alias("first_trade"), F.max("last_trade_timestamp").alias("last_trade"), F.min(changed).alias("changed_at"),
    )


def run_totals(seconds: DataFrame) -> DataFrame:
    """One row: sums over all sessions."""
    return seconds.agg(
        F.count_distinct("session_date").alias("sessions"), F.count("*").alias("bar_rows"), F.sum("trade_count").alias("trades"), F.sum("total_volume").alias("volume"),
        F.count_if("contract_change").alias("contract_changes"), F.min("first_trade_timestamp").alias("first_trade"), F.max("last_trade_timestamp").alias("last_trade"),
    )


def session_order(df: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """Whether each session begins after the one before has ended; one row a session is ordered."""
    ends = df.groupBy("session_date").agg(F.min(start).alias("a"), F.max(end).alias("b"))
    ends = ends.withColumn("before", F.lag("b").over(Window.orderBy("session_date")))
    return checks(ends, {f"{name}_session_order": F.coalesce(F.col("a") <= F.col("before"), F.lit(False))})


def same_sessions(layers: dict[str, DataFrame]) -> DataFrame:
    """Whether all layers have the same sessions: for each, the sessions that it alone has or lacks."""
    found = _union([df.select("session_date").distinct().withColumn("layer", F.lit(name)) for name, df in layers.items()])
    whole = found.groupBy("session_date").agg(F.collect_set("layer").alias("layers"))
    return checks(whole, {f"{name}_sessions": ~F.array_contains("layers", name) for name in layers})


# --- forward labels


def recounted_targets(bars: DataFrame, seconds: DataFrame, width: int, horizon: int, tolerance: int) -> DataFrame:
    """Labels without windows over bars and without boundary buckets: a path is the join of a bar with the bars that must follow
    it; a reference is the next trade in a merged order of boundaries and trades."""
    t = F.unix_seconds("decision_timestamp")
    own = bars.select("decision_timestamp", "session_date", "instrument_id", t.alias("t"))
    ahead = own.withColumn("at", F.explode(F.sequence(F.col("t"), F.col("t") + horizon * width, F.lit(width))))
    there = own.select("session_date", F.col("t").alias("at"), F.col("instrument_id").alias("there"))
    path = ahead.join(there, ["session_date", "at"], "left").groupBy("session_date", "t", "decision_timestamp", "instrument_id").agg(
        F.count("there").alias("n"), F.count_if((F.col("at") == F.col("t") + horizon * width) & F.col("there").isNotNull()).alias("ends"),
        F.count_if(F.col("there") != F.col("instrument_id")).alias("others"),
    )
    micros = lambda c: F.unix_micros(c)
    trade = F.struct(micros("first_trade_timestamp").alias("ts"), F.col("open").alias("price"), F.col("instrument_id").alias("id"))
    boundaries = own.select("session_date", F.col("t").alias("boundary")).union(own.select("session_date", (F.col("t") + horizon * width).alias("boundary"))).distinct()
    merged = boundaries.select("session_date", (F.col("boundary") * 1_000_000).alias("at"), F.lit(0).cast("bigint").alias("kind"), "boundary", F.lit(None).cast("struct<ts:bigint,price:double,id:bigint>").alias("trade"))
    merged = merged.union(seconds.select("session_date", micros("first_trade_timestamp"), F.col("instrument_id"), F.lit(None).cast("bigint"), trade))
    # from the end backwards, the latest trade seen is the next one; a frame that only grows is worked out once
    backwards = Window.partitionBy("session_date").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("next", F.last("trade", ignorenulls=True).over(backwards)).where("boundary IS NOT NULL")
    found = found.select("session_date", "boundary", F.when(F.col("next.ts") < (F.col("boundary") + tolerance) * 1_000_000, F.col("next")).alias("next"))
    out = path.join(found.select("session_date", F.col("boundary").alias("t"), F.col("next").alias("a")), ["session_date", "t"])
    out = out.join(found.select("session_date", (F.col("boundary") - horizon * width).alias("t"), F.col("next").alias("b")), ["session_date", "t"])
    a, b, me = F.col("a"), F.col("b"), F.col("instrument_id")
    # a path that holds another contract is a roll whether or not bars are missing too
    reason = (
        F.when(F.col("ends") == 0, REASONS[0]).when(F.col("others") > 0, REASONS[2]).when(F.col("n") < horizon + 1, REASONS[3]).when(a.isNull(), REASONS[4])
        .when(a.id != me, REASONS[5]).when(b.isNull(), REASONS[6]).when(b.id != me, REASONS[7]).when(a.price == b.price, REASONS[8]).otherwise(REASONS[9])
    )
    out = out.withColumn("eligibility_reason", reason)
    structural = F.col("eligibility_reason").isin(REASONS[:4])
    a, b = F.when(~structural, F.col("a")), F.when(~structural, F.col("b"))
    priced = F.col("eligibility_reason").isin(REASONS[8:])
    return out.select(
        "decision_timestamp", "session_date", "eligibility_reason", a.ts.alias("start_us"), b.ts.alias("future_us"), a.price.alias("start_reference_price"), b.price.alias("future_reference_price"),
        a.id.alias("start_reference_instrument_id"), b.id.alias("future_reference_instrument_id"), F.when(priced, b.price - a.price).alias("forward_price_change"),
        F.when(priced, F.ln(b.price) - F.ln(a.price)).alias("forward_log_return"), F.when(F.col("eligibility_reason") == REASONS[9], (b.price > a.price).cast("int")).alias("target_up_15m"),
    )


def targets_recount(targets: DataFrame, bars: DataFrame, seconds: DataFrame, width: int, horizon: int, tolerance: int) -> DataFrame:
    """Every reason, reference and outcome of the labels, worked out again."""
    again = recounted_targets(bars, seconds, width, horizon, tolerance)
    layer = targets.withColumns({"start_us": F.unix_micros("start_reference_timestamp"), "future_us": F.unix_micros("future_reference_timestamp"), "target_up_15m": F.col("target_up_15m").cast("int")})
    return disagreements(layer, again, ["decision_timestamp", "session_date"], [c for c in again.columns if c not in ("decision_timestamp", "session_date")])


# --- features


def recounted_features(bars: DataFrame, s: Settings) -> DataFrame:
    """Features that look back, by joins: each bar is dealt to the decisions whose look-back holds it, and summed up there."""
    t, w = F.unix_seconds("decision_timestamp"), s.width
    own = bars.select("decision_timestamp", "minute_start", "session_date", "instrument_id", "high", "low", "close", "total_volume", "inferred_delta", "price_volume_sum", t.alias("t"))
    before = own.select("session_date", (F.col("t") + w).alias("t"), F.col("instrument_id").alias("_i"), F.col("close").alias("_c"))
    steps = own.join(before, ["session_date", "t"], "left").withColumn("r", F.when(F.col("_i") == F.col("instrument_id"), F.ln("close") - F.ln("_c"))).drop("_i", "_c")
    # the latest bar before, however far back: there the contract may have changed
    latest = own.select("session_date", F.col("t").alias("t2"), F.col("instrument_id").alias("i2"))
    latest = own.select("session_date", "t").join(latest, "session_date").where("t2 < t").groupBy("session_date", "t").agg(F.max_by("i2", "t2").alias("i2"))
    steps = steps.join(latest, ["session_date", "t"], "left").withColumn("roll", F.coalesce(F.col("i2") != F.col("instrument_id"), F.lit(False)))
    most = max(*s.returns, *s.efficiencies, *s.volatilities, *s.ranges, s.recent, s.scale)
    dealt = steps.select("session_date", "t", *[F.col(c).alias(f"b_{c}") for c in ("instrument_id", "high", "low", "close", "total_volume", "inferred_delta", "r", "roll")], F.explode(F.sequence(F.lit(0), F.lit(most))).alias("back"))
    dealt = dealt.withColumn("t", F.col("t") + F.col("back") * w)
    met = own.select("session_date", "t", "instrument_id").join(dealt, ["session_date", "t"])
    back, mine = F.col("back"), F.col("b_instrument_id") == F.col("instrument_id")
    sums: dict[str, Column] = {}
    for h in {*s.returns, *s.efficiencies, *s.volatilities, s.scale}:
        sums[f"path_{h}"] = F.count_if((back <= h) & mine)
    for h in s.returns:
        sums[f"close_{h}"] = F.max(F.when(back == h, F.col("b_close")))
    for h in {*s.efficiencies, *s.volatilities, s.scale}:
        within = back < h
        sums |= {f"sum_{h}": F.sum(F.when(within, F.col("b_r"))), f"travel_{h}": F.sum(F.when(within, F.abs("b_r"))), f"square_{h}": F.sum(F.when(within, F.col("b_r") * F.col("b_r")))}
    for h in s.ranges:
        within = back < h
        sums |= {f"high_{h}": F.max(F.when(within, F.col("b_high"))), f"low_{h}": F.min(F.when(within, F.col("b_low"))), f"others_{h}": F.count_if((within & ~mine) | (back.between(0, h - 2) & F.col("b_roll")))}
        sums |= {f"delta_{h}": F.sum(F.when(within, F.col("b_inferred_delta"))), f"volume_{h}": F.sum(F.when(within, F.col("b_total_volume")))}
    k = s.recent
    sums |= {"recent": F.sum(F.when(back.between(1, k), F.col("b_total_volume"))), "recent_delta": F.sum(F.when(back.between(1, k), F.col("b_inferred_delta"))), "recent_others": F.count_if((back.between(1, k) & ~mine) | (back.between(0, k - 1) & F.col("b_roll")))}
    sums = {name: c.alias(name) for name, c in sums.items()}
    df = own.join(met.groupBy("session_date", "t").agg(*sums.values()), ["session_date", "t"])

    whole = lambda h: F.col(f"path_{h}") == h + 1
    out = {f"return_{h}m": F.when(whole(h), F.ln("close") - F.ln(f"close_{h}")) for h in s.returns}
    for h in s.efficiencies:
        out[f"trend_efficiency_{h}m"] = F.when(whole(h), F.when(F.col(f"travel_{h}") == 0, 0.0).otherwise(F.col(f"sum_{h}") / F.col(f"travel_{h}")))
    for h in s.volatilities:
        out[f"realized_volatility_{h}m"] = F.when(whole(h), F.sqrt(F.col(f"square_{h}") / h))
    now = F.col("decision_timestamp")
    for h in s.ranges:
        fine = _interval_valid(s, _shift(now, -h * w), now) & (F.col(f"others_{h}") == 0)
        out[f"range_{h}m"] = F.when(fine, F.ln(f"high_{h}") - F.ln(f"low_{h}"))
        out[f"delta_{h}m"] = F.when(fine, F.col(f"delta_{h}") / F.col(f"volume_{h}"))
    fine = _interval_valid(s, _shift(now, -(k + 1) * w), _shift(now, -w)) & (F.col("recent_others") == 0)
    out[f"activity_acceleration_{k}m"] = F.when(fine, F.log1p("total_volume") - F.log1p(F.coalesce("recent", F.lit(0)) / k))
    one = F.col("inferred_delta") / F.col("total_volume")
    out["delta_acceleration"] = F.when(fine & (F.col("recent") > 0), one - F.col("recent_delta") / F.col("recent"))
    scale = F.when(whole(s.scale), F.sqrt(F.col(f"square_{s.scale}")))
    df = df.withColumns(out | {"_s": F.when(scale > TINY, scale)})

    # the session so far: a bar is joined with those up to it, back to the last change of contract
    earlier = own.select("session_date", *[F.col(c).alias(f"e_{c}") for c in ("t", "instrument_id", "high", "low", "total_volume", "price_volume_sum")])
    pairs = own.select("session_date", "t", "instrument_id").join(earlier, "session_date").where("e_t <= t")
    changed = pairs.where("e_instrument_id <> instrument_id").groupBy("session_date", "t").agg(F.max("e_t").alias("cut"))
    pairs = pairs.join(changed, ["session_date", "t"], "left").where("cut IS NULL OR e_t > cut")
    so_far = pairs.groupBy("session_date", "t").agg((F.sum("e_price_volume_sum") / F.sum("e_total_volume")).alias("vwap"), F.max("e_high").alias("hi"), F.min("e_low").alias("lo"))
    df, gap = df.join(so_far, ["session_date", "t"]), s.coverage.first_gap(F.col("session_date"))
    fine = s.coverage.starts_by(clock.session_open(F.col("session_date"))) & (gap.isNull() | (now <= gap))
    distance = lambda level: F.when(fine, (F.ln("close") - F.ln(level)) / F.col("_s"))
    place = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    more = {"session_vwap_distance": distance("vwap"), "session_high_distance": distance("hi"), "session_low_distance": distance("lo"), "session_range_position": F.when(fine, place)}
    return df.withColumns(more).select("decision_timestamp", "session_date", *out, *more)


def features_recount(features: DataFrame, bars: DataFrame, s: Settings) -> DataFrame:
    """Values and validity of the features that look back within a session, on every row."""
    again = recounted_features(bars, s)
    return disagreements(features, again, ["decision_timestamp", "session_date"], [c for c in again.columns if c not in ("decision_timestamp", "session_date")], 1e-9)


def _gaps(bars: DataFrame, s: Settings) -> DataFrame:
    """The coverage's unavailable intervals as rows (session_date, gap_from, gap_to)."""
    rows = bars.sparkSession.createDataFrame([tuple(g) for g in s.coverage.gaps], "day string, a string, b string")
    return rows.select(F.col("day").cast("date").alias("session_date"), F.col("a").cast("timestamp").alias("gap_from"), F.col("b").cast("timestamp").alias("gap_to"))


def recounted_context(bars: DataFrame, s: Settings) -> DataFrame:
    """What the other recount leaves out: values of a bar alone, its place on the clock, the baseline, the session before and the
    opening range. Validity comes from joins with the coverage's intervals, the baseline's last values from a join with all earlier
    admitted bars of the slot, ranked by recency; the clock from the wall clock instead of elapsed time."""
    now, day, key = F.col("decision_timestamp"), F.col("session_date"), ["decision_timestamp", "session_date"]
    local = F.from_utc_timestamp(now, clock.ZONE)
    slot = F.pmod(F.hour(local) * 60 + F.minute(local) - 17 * 60, F.lit(1440))
    df = bars.withColumns({"slot": slot, "lv": F.ln(1.0 + F.col("total_volume")), "ln": F.ln(1.0 + F.col("trade_count"))})
    angle = 2 * math.pi * F.col("slot") / clock.SESSION_MINUTES
    flags = {"asia_flag": (0, 540), "europe_flag": (540, 930), "us_flag": (930, 1380), "us_rth_flag": (930, 1320)}
    mean = F.col("total_volume") / F.col("trade_count")
    own = {
        "minutes_since_cme_open": F.col("slot"), "time_of_day_sin": F.sin(angle), "time_of_day_cos": F.cos(angle),
        **{name: ((F.col("slot") >= a) & (F.col("slot") < b)).cast("smallint") for name, (a, b) in flags.items()},
        "log_volume_1m": F.col("lv"), "log_trade_count_1m": F.col("ln"), "log_average_trade_size_1m": F.ln("total_volume") - F.ln("trade_count"),
        "trade_size_dispersion_1m": F.sqrt(F.greatest(F.lit(0.0), F.col("size_squared_sum") / F.col("trade_count") / (mean * mean) - 1)),
        "log_max_trade_size_1m": F.ln(1.0 + F.col("max_trade_size")), "active_second_fraction_1m": F.col("active_second_count") / F.lit(float(s.width)),
    }
    df = df.withColumns(own)

    gaps = _gaps(bars, s)
    first, last = (F.lit(x).cast("timestamp") for x in (s.coverage.start, s.coverage.end))
    hit = df.join(gaps, "session_date").where((F.col("minute_start") < F.col("gap_to")) & (F.col("gap_from") < now)).select(*key).distinct()
    admitted = df.where((F.col("minute_start") >= first) & (now <= last)).join(hit, key, "left_anti")
    earlier = admitted.select("slot", F.col("session_date").alias("then"), F.col("lv").alias("then_v"), F.col("ln").alias("then_n"))
    met = df.select(*key, "slot").join(earlier, "slot").where("then < session_date")
    recent = met.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("then")))).where(F.col("nth") <= s.baseline_depth)
    usual = recent.groupBy(*key).agg(F.count("*").alias("n"), F.percentile("then_v", 0.5).alias("mv"), F.percentile("then_n", 0.5).alias("mn")).where(F.col("n") == s.baseline_depth)
    df = df.join(usual.select(*key, "mv", "mn"), key, "left")
    df = df.withColumns({"relative_volume_q": F.col("lv") - F.col("mv"), "relative_trade_count_q": F.col("ln") - F.col("mn")})

    sessions = df.groupBy("session_date").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max(F.struct("decision_timestamp", "close")).alias("end"), F.collect_set("instrument_id").alias("ids")
    )
    holed = gaps.select("session_date").distinct().withColumn("holed", F.lit(True))
    sessions = sessions.join(holed, "session_date", "left").withColumn(
        "whole", F.col("holed").isNull() & (F.size("ids") == 1) & (clock.session_open(day) >= first) & (clock.session_close(day) <= last)
    )
    days = sessions.select("session_date")
    before = days.join(days.select(F.col("session_date").alias("then")), F.col("then") < day).groupBy("session_date").agg(F.max("then").alias("then"))
    levels = sessions.select(F.col("session_date").alias("then"), F.col("high").alias("p_high"), F.col("low").alias("p_low"), F.col("end.close").alias("p_close"), F.col("end.decision_timestamp").alias("p_end"), F.get("ids", F.lit(0)).alias("p_id"), "whole")
    df = df.join(before.join(levels, "then").drop("then"), "session_date", "left")

    # the scale, from the bars that a path needs: each bar is dealt to the decisions that look back on it
    t = F.unix_seconds(now)
    step = df.select("session_date", t.alias("t"), F.col("instrument_id").alias("i"), F.ln("close").alias("c"))
    ahead = step.select("session_date", (F.col("t") + s.width).alias("t"), F.col("i").alias("i0"), F.col("c").alias("c0"))
    moves = step.join(ahead, ["session_date", "t"]).where("i = i0").select("session_date", "t", ((F.col("c") - F.col("c0")) ** 2).alias("square"))
    dealt = moves.withColumn("t", F.explode(F.sequence(F.col("t"), F.col("t") + (s.scale - 1) * s.width, F.lit(s.width).cast("bigint"))))
    scale = dealt.groupBy("session_date", "t").agg(F.count("*").alias("moves"), F.sqrt(F.sum("square")).alias("scale")).where(F.col("moves") == s.scale)
    df = df.withColumn("t", t).join(scale.select("session_date", "t", "scale"), ["session_date", "t"], "left")
    usable = F.col("whole") & (F.col("p_end") < now) & (F.col("p_id") == F.col("instrument_id")) & (F.col("scale") > TINY)
    df = df.withColumns({f"prior_session_{x}_distance": F.when(usable, (F.ln("close") - F.ln(f"p_{x}")) / F.col("scale")) for x in ("high", "low", "close")})

    a, b = s.opening
    morning = F.hour(F.from_utc_timestamp(F.col("minute_start"), clock.ZONE)) * 60 + F.minute(F.from_utc_timestamp(F.col("minute_start"), clock.ZONE))
    opening = df.where((morning >= a) & (morning < b)).groupBy("session_date").agg(F.max("high").alias("o_high"), F.min("low").alias("o_low"), F.collect_set("instrument_id").alias("o_ids"), F.count("*").alias("o_bars"))
    start, end = clock.session_time(day, a), clock.session_time(day, b)
    covered = opening.where((F.col("o_bars") == (b - a) * 60 // s.width) & (F.size("o_ids") == 1) & (start >= first) & (end <= last))
    holes = gaps.where((start < F.col("gap_to")) & (F.col("gap_from") < end)).select("session_date").distinct()
    covered = covered.join(holes, "session_date", "left_anti").select("session_date", "o_high", "o_low", F.get("o_ids", F.lit(0)).alias("o_id"), end.alias("o_end"))
    df = df.join(covered, "session_date", "left")
    place = F.when(F.col("o_high") == F.col("o_low"), 0.5).otherwise((F.col("close") - F.col("o_low")) / (F.col("o_high") - F.col("o_low")))
    df = df.withColumn("us_opening_range_position", F.when((now >= F.col("o_end")) & (F.col("o_id") == F.col("instrument_id")), place))
    more = ["relative_volume_q", "relative_trade_count_q", *[f"prior_session_{x}_distance" for x in ("high", "low", "close")], "us_opening_range_position"]
    return df.select(*key, *own, *more)


def context_recount(features: DataFrame, bars: DataFrame, s: Settings) -> DataFrame:
    """Values and validity of the features that ``features_recount`` leaves out, on every row."""
    again = recounted_context(bars, s)
    return disagreements(features, again, ["decision_timestamp", "session_date"], [c for c in again.columns if c not in ("decision_timestamp", "session_date")], 1e-9)


# --- folds, baselines, medians and metrics


def sample_reconciliation(sample: DataFrame, features: DataFrame, targets: DataFrame, holdout: str) -> DataFrame:
    """(check, rows, violations): that a development sample is the one-to-one join of features and eligible labels before the
    holdout: keys once on each side, each label met by one row of the same session, instrument and contract, values taken over
    unchanged, and nothing from the holdout on."""
    day, key = F.col("session_date"), ["decision_timestamp"]
    first = F.lit(holdout).cast("date")
    labels = targets.where(F.col("target_eligible") & (day < first))
    once = lambda df, name: checks(df.groupBy(*key).count(), {name: F.col("count") > 1})
    taken = ["session_date", "instrument_id", "contract", "target_up_15m", "future_boundary_timestamp", "future_reference_timestamp"]
    own = sample.select(*key, *[F.col(c).alias(f"s_{c}") for c in taken], F.lit(1).alias("s"))
    both = labels.select(*key, *taken, F.lit(1).alias("l")).join(own, key, "full")
    same = {f"label_{c}": ~F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in taken}
    met = features.where(day < first).select(*key, F.lit(1).alias("f")).join(own.select(*key, "s"), key, "right")
    parts = [
        once(features, "feature_keys"), once(targets, "label_keys"), once(sample, "sample_keys"),
        checks(both, {"labels_met": F.col("s").isNull(), "rows_with_label": F.col("l").isNull()} | same),
        checks(met, {"rows_with_features": F.col("f").isNull()}), firewall(sample, holdout),
    ]
    return _union(parts)


def firewall(sample: DataFrame, holdout: str, label: str = "target_up_15m") -> DataFrame:
    """What must not be in a development sample: sessions of the holdout, repeated or missing decisions, labels other than 0 and 1."""
    day = F.col("session_date")
    rules = checks(sample, {
        "sample_holdout": F.coalesce(day >= F.lit(holdout).cast("date"), F.lit(True)), "sample_label": ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)),
        "sample_decision": F.col("decision_timestamp").isNull(),
    })
    repeated = sample.groupBy("decision_timestamp").count()
    return rules.unionByName(checks(repeated, {"sample_unique": F.col("count") > 1}))


class FirewallError(ValueError):
    """A development sample holds rows that it must not."""


def assert_firewall(sample: DataFrame, holdout: str, label: str = "target_up_15m") -> DataFrame:
    """The sample itself, if ``firewall`` finds nothing."""
    broken = {r.check: r.violations for r in firewall(sample, holdout, label).collect() if r.violations}
    if broken:
        raise FirewallError(str(broken))
    return sample


def development_recount(sample: DataFrame, folded: DataFrame, baselines: DataFrame, medians: DataFrame, metrics: DataFrame, plan: list[tuple[str, str]], momentum: str, columns: list[str]) -> DataFrame:
    """(check, rows, violations) of fold membership, purge, baseline rates, training medians and metrics.

    sample: rows before folds; folded, baselines, medians, metrics: what ``evaluation`` made of it; the momentum of the second
    baseline and the columns with medians."""
    parts = []
    for n, (a, b) in enumerate(plan, 1):
        first, last = (F.lit(x).cast("date") for x in (a, b))
        day, own = F.col("session_date"), folded.where(F.col("fold") == n)
        edge = sample.where(day.between(first, last)).agg(F.min("decision_timestamp").alias("edge"))
        want = sample.where(day <= last).join(F.broadcast(edge)).select(  # one row
            "decision_timestamp", F.when(day >= first, "validation").when(F.col("future_reference_timestamp") >= F.col("edge"), "purged").otherwise("train").alias("part")
        )
        parts.append(disagreements(own, want, ["decision_timestamp"], ["part"]).withColumn("check", F.lit(f"fold_{n}_parts")))

    state = F.when(F.col(momentum) > 0, 1).when(F.col(momentum) < 0, -1).otherwise(0)
    train, validation = folded.where("part = 'train'"), folded.where("part = 'validation'").withColumn("state", state)
    by_state = train.groupBy("fold", state.alias("state")).agg(F.sum("target_up_15m").alias("up"), F.count("*").alias("n"))
    whole = by_state.groupBy("fold").agg(((F.sum("up") + 1) / (F.sum("n") + 2)).alias("p_base"))
    rates = by_state.where("state <> 0").select("fold", "state", ((F.col("up") + 1) / (F.col("n") + 2)).alias("own"))
    again = validation.join(whole, "fold").join(rates, ["fold", "state"], "left")
    again = again.select("fold", "decision_timestamp", "p_base", F.when(F.col("state") == 0, F.col("p_base")).otherwise(F.coalesce("own", F.lit(0.5))).alias("p_momentum"))
    parts.append(disagreements(baselines, again, ["fold", "decision_timestamp"], ["p_base", "p_momentum"], 1e-14))

    # nothing is sorted: a median is held to its property, half of the values on either side, from counts on both sides of it
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = train.select("fold", F.explode(pairs).alias("p")).select("fold", "p.*").where("x IS NOT NULL")
    long = long.join(F.broadcast(medians.select("fold", "feature", F.col("median").alias("m"))), ["fold", "feature"], "left")  # a row a fold and feature
    x, m = F.col("x"), F.col("m")
    side = lambda inside: 2 * F.count_if(inside)
    between = lambda low, high: (F.max(F.when(low, x)) + F.min(F.when(high, x))) / 2
    middle = (
        F.when((side(x < m) < F.count("*")) & (side(x > m) < F.count("*")), F.max(m)).when(side(x <= m) == F.count("*"), between(x <= m, x > m))
        .when(side(x >= m) == F.count("*"), between(x < m, x >= m))
    )
    parts.append(disagreements(medians, long.groupBy("fold", "feature").agg(middle.alias("median")), ["fold", "feature"], ["median"], 1e-12))

    models = F.array(F.struct(F.lit("baseline_0").alias("model"), F.col("p_base").alias("p")), F.struct(F.lit("baseline_1").alias("model"), F.col("p_momentum").alias("p")))
    scored = again.join(validation.select("fold", "decision_timestamp", F.col("target_up_15m").cast("int").alias("y")), ["fold", "decision_timestamp"])
    scored = scored.select("fold", "y", F.explode(models).alias("m")).select("fold", "y", "m.*")
    # a baseline says at most three different things a fold, so its values meet each other, with their counts
    valued = scored.groupBy("fold", "model", "p").agg(F.count("*").alias("n"), F.sum("y").alias("up")).withColumn("down", F.col("n") - F.col("up"))
    other = valued.select("fold", "model", F.col("p").alias("p_down"), F.col("down").alias("downs"))
    won = F.col("up") * F.col("downs") * F.when(F.col("p") > F.col("p_down"), 1.0).when(F.col("p") == F.col("p_down"), 0.5).otherwise(0.0)
    area = valued.join(other, ["fold", "model"]).groupBy("fold", "model").agg(F.sum(won).alias("won"))
    n, of_pairs, p = F.sum("n"), F.sum("up") * F.sum("down"), F.col("p")
    loss = lambda count, chance: F.when(F.col(count) > 0, -F.col(count) * F.ln(chance)).otherwise(0.0)
    direct = valued.groupBy("fold", "model").agg(
        (F.sum(loss("up", p) + loss("down", 1 - p)) / n).alias("log_loss"), (F.sum(F.col("up") * F.pow(1 - p, 2) + F.col("down") * F.pow(p, 2)) / n).alias("brier_score"),
        of_pairs.alias("pairs"), (F.sum(F.when(p >= 0.5, F.col("up")).otherwise(F.col("down"))) / n).alias("accuracy"),
    ).join(area, ["fold", "model"]).withColumn("roc_auc", F.when(F.col("pairs") > 0, F.col("won") / F.col("pairs")))
    parts.append(disagreements(metrics, direct, ["fold", "model"], ["log_loss", "brier_score", "roc_auc", "accuracy"], 1e-12))
    return _union(parts)
