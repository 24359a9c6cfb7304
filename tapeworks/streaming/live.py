"""The tape as a stream: classified trades with keyed state, and bars by event-time windows.

A tape is ordered: trades that come behind the watermark are not taken. The state of the tick rule (price, direction,
instrument of the last trade) is kept per key; within a micro-batch the trades of a key are sorted by (ts_event, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.clock import session_date

CLASSIFIED = "tape STRING, ts_event TIMESTAMP, seq BIGINT, instrument_id BIGINT, price DOUBLE, size BIGINT, side STRING, change INT, direction INT, rolled BOOLEAN, late BOOLEAN"
STATE = "price DOUBLE, direction INT, instrument_id BIGINT, ts_event TIMESTAMP, seq BIGINT"


def _classify(rows: pd.DataFrame, price, direction, instrument):
    """Directions of ordered trades, given what the last trade before them left."""
    prices, ids = rows["price"].to_numpy(), rows["instrument_id"].to_numpy()
    before = np.concatenate(([np.nan if price is None else price], prices[:-1]))
    previous = np.concatenate(([-1 if instrument is None else instrument], ids[:-1]))
    comparable = previous == ids
    sign = np.where(comparable, np.sign(prices - before), 0)
    marks = np.where(comparable & (sign == 0), -1, np.arange(len(rows)))  # rows that set the direction
    last = np.maximum.accumulate(marks)
    directions = np.where(last < 0, 0 if direction is None else direction, sign[np.maximum(last, 0)]).astype(int)
    return [int(s) if c else None for s, c in zip(sign, comparable, strict=True)], directions


class BackwardTrade(ValueError):
    """A trade came behind the newest one of an earlier batch."""


def classified_trades(trades: DataFrame, strict: bool = False) -> DataFrame:
    """A stream of (tape, ts_event, seq, ...) with change, direction, ``rolled`` (another instrument than the trade before, of
    an earlier batch too), and ``late`` for trades that come behind the newest one of an earlier batch: those are passed on
    unclassified and change no state, or, with ``strict``, end the stream with an error."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts_event", "seq"], kind="stable").reset_index(drop=True)
        price, direction, instrument, ts, seq = state.get if state.exists else (None,) * 5
        late = np.zeros(len(rows), bool)
        if ts is not None:
            ts = pd.Timestamp(ts)
            late = ((rows["ts_event"] < ts) | ((rows["ts_event"] == ts) & (rows["seq"] <= seq))).to_numpy()
        if strict and late.any():
            raise BackwardTrade(f"tape {key[0]}: {int(late.sum())} trades are behind {ts}, {seq}")
        fresh = rows[~late].reset_index(drop=True)
        out = rows.assign(change=pd.array([None] * len(rows), "Int32"), direction=0, rolled=False, late=late)
        if len(fresh):
            change, directions = _classify(fresh, price, direction, instrument)
            out.loc[~late, "change"] = pd.array(change, "Int32")
            out.loc[~late, "direction"] = directions
            before = np.concatenate(([fresh["instrument_id"].iloc[0] if instrument is None else instrument], fresh["instrument_id"].to_numpy()[:-1]))
            out.loc[~late, "rolled"] = before != fresh["instrument_id"].to_numpy()
            end = fresh.iloc[-1]
            state.update((float(end.price), int(directions[-1]), int(end.instrument_id), end.ts_event.to_pydatetime(), int(end.seq)))
        yield out[["tape", "ts_event", "seq", "instrument_id", "price", "size", "side", "change", "direction", "rolled", "late"]]

    return trades.groupBy("tape").applyInPandasWithState(step, CLASSIFIED, STATE, "append", GroupStateTimeout.NoTimeout)


def streaming_bars(trades: DataFrame, width: str = "1 second", delay: str = "0 seconds") -> DataFrame:
    """Bars of complete windows, in append mode. The last window of a stream that ends stays open: ``flush`` takes it from the
    stored trades."""
    window = F.window("ts_event", width)
    order = F.struct("ts_event", "seq")
    return trades.withWatermark("ts_event", delay).groupBy(window, "instrument_id").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("total_volume"), F.count("*").alias("trade_count"),
    ).select(F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"), "instrument_id", "open", "high", "low", "close", "total_volume", "trade_count")


def session_writer(path: str, time: str = "bar_start"):
    """For ``foreachBatch``: appends a batch's bars to their sessions' folders, each batch in files of its own name, so that a
    batch that runs again replaces what it has written before."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"session_date": session_date(F.col(time)), "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date", "batch").parquet(path)

    return write


def flush(trades: DataFrame, emitted: DataFrame, width: str = "1 second") -> DataFrame:
    """The bars of a finished tape that a stream has not emitted."""
    whole = streaming_bars(trades, width)
    return whole.join(emitted.select("bar_start", "instrument_id"), ["bar_start", "instrument_id"], "left_anti")
