"""Second bars from classified trades, and bars of any width from second bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.carry import lag_across
from ..schemas import BARS, SECOND_BARS, SUMS
from ..sources.layers import enforce
from ..sources.tape import order_of

#: Column of a second bar: column of a trade that it sums up.
_TRADE_SUMS = {
    "price_volume_sum": "price_volume", "price_squared_volume_sum": "price_squared_volume", "total_volume": "size",
    "size_squared_sum": "size_squared", "uptick_count": "uptick", "downtick_count": "downtick", "same_price_count": "same_price",
    "inferred_buy_volume": "inferred_buy_volume", "inferred_sell_volume": "inferred_sell_volume",
    "inferred_unknown_volume": "inferred_unknown_volume", "inferred_buy_trade_count": "inferred_buy",
    "inferred_sell_trade_count": "inferred_sell", "inferred_unknown_trade_count": "inferred_unknown",
    "inferred_delta": "inferred_delta", "native_buy_volume": "native_buy_volume", "native_sell_volume": "native_sell_volume",
    "native_unknown_volume": "native_unknown_volume", "native_delta": "native_delta",
}


def second_bars(rows: DataFrame) -> DataFrame:
    """One row for each (second, session, instrument, contract) with a trade.

    Trades are summed by price level first: levels give the number of prices and the largest volume at one, and everything
    else adds up from them. Both steps group inside the tick rule's chunks, so no further shuffle is needed. The change
    flag compares with the bar before in (second, instrument) order, over chunk borders too."""
    keys, order = ["chunk", "timestamp_second", "session_date", "instrument_id", "contract"], F.struct(*order_of(rows))
    levels = rows.groupBy(*keys, "price").agg(
        F.count("*").alias("trade_count"), F.max("size").alias("max_trade_size"), F.min(order).alias("head"), F.max(order).alias("tail"),
        *[F.sum(c).alias(name) for name, c in _TRADE_SUMS.items()],
    )
    bars = levels.groupBy(*keys).agg(
        F.min_by("price", "head").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tail").alias("close"),
        *[F.sum(c).alias(c) for c in SUMS], F.max("max_trade_size").alias("max_trade_size"),
        F.count("*").alias("unique_price_levels"), F.max("total_volume").alias("max_volume_at_price"),
        F.min("head.ts_event").alias("first_trade_timestamp"), F.max("tail.ts_event").alias("last_trade_timestamp"),
    )
    bars = lag_across(bars, "chunk", ["timestamp_second", "instrument_id"], {"_before": "instrument_id"})
    bars = bars.withColumn("contract_change", F.coalesce(F.col("_before") != F.col("instrument_id"), F.lit(False)))
    return enforce(bars.drop("chunk", "_before"), SECOND_BARS)


def floor_to(ts: Column, seconds: int) -> Column:
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def roll_up(seconds: DataFrame, width: int = 60) -> DataFrame:
    """Bars of ``width`` seconds that describe [start, start + width) and are known at its end, ``decision_timestamp``. Bars of
    one session and one instrument only: a bar that mixes instruments fails the job."""
    order = F.struct("timestamp_second", "instrument_id")
    mixed = F.min("instrument_id") != F.max("instrument_id")
    bars = seconds.groupBy(floor_to(F.col("timestamp_second"), width).alias("minute_start"), "session_date").agg(
        F.when(mixed, F.raise_error(F.lit("a bar mixes instruments"))).otherwise(F.min("instrument_id")).cast("bigint").alias("instrument_id"),
        F.min("contract").alias("contract"), F.min_by("open", order).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", order).alias("close"), *[F.sum(c).alias(c) for c in SUMS],
        F.max("max_trade_size").alias("max_trade_size"), F.count("timestamp_second").alias("active_second_count"),
        F.min("first_trade_timestamp").alias("first_trade_timestamp"), F.max("last_trade_timestamp").alias("last_trade_timestamp"),
        F.bool_or("contract_change").alias("contract_change"),
    )
    end = F.timestamp_micros(F.unix_micros("minute_start") + width * 1_000_000)
    return enforce(bars.withColumn("decision_timestamp", end), BARS)


def session_manifest(seconds: DataFrame) -> DataFrame:
    """One row a session: rows, trades, volume, the first and last trade, instruments and changes of contract."""
    return seconds.groupBy("session_date").agg(
        F.count("*").alias("bar_rows"), F.sum("trade_count").alias("trades"), F.sum("total_volume").alias("volume"),
        F.min("first_trade_timestamp").alias("first_trade"), F.max("last_trade_timestamp").alias("last_trade"),
        F.count_distinct("instrument_id").alias("instruments"), F.count_if("contract_change").alias("contract_changes"),
    )
