"""Stateful operators of the live tape: whole second bars, bars over bars, the causal activity baseline, and a writer that
flushes a session once it is over.

They need the RocksDB state store (``use_rocksdb``). A tape is in order; a row without a price is a heartbeat that says how far
the tape has come, so the last second of a quiet or finished tape is not held back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import clock
from ..functions.clock import session_date
from ..operators.features import Settings
from ..schemas import BARS, SECOND_BARS, SUMS
from .live import BackwardTrade, _classify, session_writer

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BAR_COLUMNS = [c.split()[0] for c in SECOND_BARS.split(", ")]
_KEYS = ["second", "session_date", "instrument_id", "contract"]
_LEVEL = (
    "second BIGINT, session_date DATE, contract STRING, max_trade_size BIGINT, head BIGINT, head_seq BIGINT, tail BIGINT, tail_seq BIGINT, "
    + ", ".join(f"{c} {'DOUBLE' if c.startswith('price') else 'BIGINT'}" for c in SUMS)
)
_LEVEL_NAMES = [c.split()[0] for c in _LEVEL.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(STORE, ROCKSDB)


def _micros(x: pd.Series) -> np.ndarray:
    return x.to_numpy("datetime64[us]").astype(np.int64)


def _levels(rows: pd.DataFrame) -> pd.DataFrame:
    """Classified trades in order, summed up by second, instrument and price."""
    size, price, side = rows["size"].to_numpy(np.int64), rows["price"].to_numpy(float), rows["direction"].to_numpy()
    change = pd.to_numeric(rows["change"], errors="coerce").to_numpy(float, na_value=np.nan)
    native = rows["side"].to_numpy(object)
    at = lambda mask: np.where(mask, size, 0)
    bought, sold = native == "B", native == "A"
    flat = pd.DataFrame({
        "second": rows["us"] // 1_000_000, "session_date": rows["session_date"], "instrument_id": rows["instrument_id"], "contract": rows["contract"], "price": price,
        "max_trade_size": size, "us": rows["us"], "seq": rows["seq"], "price_volume_sum": price * size, "price_squared_volume_sum": price * price * size,
        "total_volume": size, "trade_count": 1, "size_squared_sum": size * size, "uptick_count": (change > 0).astype(np.int64),
        "downtick_count": (change < 0).astype(np.int64), "same_price_count": (change == 0).astype(np.int64), "inferred_buy_volume": at(side == 1),
        "inferred_sell_volume": at(side == -1), "inferred_unknown_volume": at(side == 0), "inferred_buy_trade_count": (side == 1).astype(np.int64),
        "inferred_sell_trade_count": (side == -1).astype(np.int64), "inferred_unknown_trade_count": (side == 0).astype(np.int64), "inferred_delta": side * size,
        "native_buy_volume": at(bought), "native_sell_volume": at(sold), "native_unknown_volume": at(~bought & ~sold), "native_delta": at(bought) - at(sold),
    })
    grouped = flat.groupby([*_KEYS, "price"], sort=False)
    own = {"max_trade_size": ("max_trade_size", "max"), "head": ("us", "first"), "head_seq": ("seq", "first"), "tail": ("us", "last"), "tail_seq": ("seq", "last")}
    return grouped.agg(**own, **{c: (c, "sum") for c in SUMS}).reset_index()


def _bars(levels: pd.DataFrame, before: int) -> tuple[pd.DataFrame, int]:
    """Second bars of price levels, in order of second and instrument, and the last one's instrument; before: that of the bar before
    them, -1 for none."""
    levels = levels.sort_values(["head", "head_seq"], kind="stable")
    grouped = levels.groupby(_KEYS, sort=True)
    bars = grouped.agg(
        open=("price", "first"), high=("price", "max"), low=("price", "min"), **{c: (c, "sum") for c in SUMS}, max_trade_size=("max_trade_size", "max"),
        unique_price_levels=("price", "size"), max_volume_at_price=("total_volume", "max"), first=("head", "min"), last=("tail", "max"),
    )
    ends = levels.sort_values(["tail", "tail_seq"], kind="stable").groupby(_KEYS, sort=True)["price"].last()
    bars = bars.assign(close=ends).reset_index().sort_values(["second", "instrument_id"], kind="stable").reset_index(drop=True)
    ids = bars["instrument_id"].to_numpy()
    previous = np.concatenate(([ids[0] if before < 0 else before], ids[:-1]))
    stamp = lambda us: pd.to_datetime(us, unit="us")
    bars = bars.assign(
        timestamp_second=stamp(bars["second"] * 1_000_000), first_trade_timestamp=stamp(bars["first"]), last_trade_timestamp=stamp(bars["last"]), contract_change=previous != ids
    )
    return bars[_BAR_COLUMNS], int(ids[-1])


class SecondBars(StatefulProcessor):
    """Per tape: what the tick rule carries, the instrument of the last bar, and the price levels of the second still open."""

    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", "price DOUBLE, direction INT, instrument_id BIGINT, us BIGINT, seq BIGINT, bar_instrument BIGINT")
        self.open = handle.getMapState("open", "instrument_id BIGINT, price DOUBLE", _LEVEL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        rows = rows.assign(us=_micros(rows["ts_event"])).sort_values(["us", "seq"], kind="stable").reset_index(drop=True)
        price, direction, instrument, us, seq, bar = self.carry.get() if self.carry.exists() else (None, None, None, None, None, -1)
        trades = rows[rows["price"].notna()].reset_index(drop=True)
        if us is not None and len(trades) and ((trades["us"] < us) | ((trades["us"] == us) & (trades["seq"] <= seq))).any():
            raise BackwardTrade(f"tape {key[0]}: a trade comes behind {us}, {seq}")
        parts = [self._held()]
        if len(trades):
            change, directions = _classify(trades, price, direction, instrument)
            parts.append(_levels(trades.assign(change=change, direction=directions)))
            end = trades.iloc[-1]
            price, direction, instrument, us, seq = float(end.price), int(directions[-1]), int(end.instrument_id), int(end.us), int(end.seq)
        levels, last = pd.concat([p for p in parts if len(p)]) if any(map(len, parts)) else parts[0], int(rows["us"].iloc[-1]) // 1_000_000
        self.open.clear()
        if len(levels):
            levels = _joined(levels)
            done, still = levels[levels["second"] < last], levels[levels["second"] >= last]
            for r in still.itertuples(index=False):
                own = r._asdict()
                self.open.updateValue((int(own["instrument_id"]), float(own["price"])), tuple(_plain(own[c]) for c in _LEVEL_NAMES))
            if len(done):
                bars, bar = _bars(done, bar)
                yield bars.assign(tape=key[0])
            if self.timers:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                if len(still):
                    self.handle.registerTimer((last + 1) * 1000)
        if us is not None:
            self.carry.update((price, direction, instrument, us, seq, bar))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        levels = self._held()
        if len(levels):
            *rest, bar = self.carry.get()
            bars, bar = _bars(levels, bar)
            self.carry.update((*rest, bar))
            self.open.clear()
            yield bars.assign(tape=key[0])

    def close(self) -> None:
        pass

    def _held(self) -> pd.DataFrame:
        found = [{"instrument_id": k[0], "price": k[1], **dict(zip(_LEVEL_NAMES, v, strict=True))} for k, v in self.open.iterator()]
        return pd.DataFrame(found, columns=["instrument_id", "price", *_LEVEL_NAMES])


def _plain(x):
    return x.item() if hasattr(x, "item") else x


def _joined(levels: pd.DataFrame) -> pd.DataFrame:
    """Levels of one second that came in two batches, the earlier first, as one."""
    own = {"max_trade_size": ("max_trade_size", "max"), "head": ("head", "first"), "head_seq": ("head_seq", "first"), "tail": ("tail", "last"), "tail_seq": ("tail_seq", "last")}
    return levels.groupby([*_KEYS, "price"], sort=False).agg(**own, **{c: (c, "sum") for c in SUMS}).reset_index()


def second_bars(trades: DataFrame, delay: str = "2 seconds", timers: bool = True) -> DataFrame:
    """A stream of whole second bars (all columns of the layer, and ``tape``) from one of trades in context (tape, ts_event, seq,
    instrument_id, price, size, side, session_date, contract). A second is emitted once its tape goes on behind it, or, with
    ``timers``, once the watermark has passed it. A trade behind an earlier one of its tape ends the stream.

    Without timers the bars carry their event time on, so that other stateful operators may follow."""
    own = trades.withWatermark("ts_event", delay).select("tape", "ts_event", "seq", "instrument_id", "price", "size", "side", "session_date", "contract")
    options = {} if timers else {"eventTimeColumnName": "timestamp_second"}
    return own.groupBy("tape").transformWithStateInPandas(SecondBars(timers), f"{SECOND_BARS}, tape STRING", "Append", "EventTime", **options)


def bars_over_bars(seconds: DataFrame, width: int = 60) -> DataFrame:
    """Bars of ``width`` seconds from a stream of second bars (``second_bars`` without timers), in append mode."""
    order = F.struct("timestamp_second", "instrument_id")
    mixed = F.min("instrument_id") != F.max("instrument_id")
    bars = seconds.groupBy(F.window("timestamp_second", f"{width} seconds"), "tape", "session_date").agg(
        F.when(mixed, F.raise_error(F.lit("a bar mixes instruments"))).otherwise(F.min("instrument_id")).cast("bigint").alias("instrument_id"),
        F.min("contract").alias("contract"), F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), *[F.sum(c).alias(c) for c in SUMS], F.max("max_trade_size").alias("max_trade_size"),
        F.count("timestamp_second").alias("active_second_count"), F.min("first_trade_timestamp").alias("first_trade_timestamp"),
        F.max("last_trade_timestamp").alias("last_trade_timestamp"), F.bool_or("contract_change").alias("contract_change"),
    )
    bars = bars.withColumns({"minute_start": F.col("window.start"), "decision_timestamp": F.col("window.end")})
    return bars.select("tape", *[c.split()[0] for c in BARS.split(", ")])


class Baseline(StatefulProcessor):
    """Per slot of the day: the last ``depth`` admitted values, and the newest session's, which joins them once a later session
    begins in this slot."""

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "volume DOUBLE, trades DOUBLE")
        self.newest = handle.getListState("newest", "session INT, volume DOUBLE, trades DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["session", "decision_timestamp"], kind="stable")
        ring = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        newest = [tuple(x) for x in self.newest.get()] if self.newest.exists() else []
        out = []
        for r in rows.itertuples(index=False):
            if newest and newest[0][0] < r.session:
                ring = [*ring, *[x[1:] for x in newest]][-self.depth :]
                newest = []
            middle = np.median(np.array(ring), axis=0) if len(ring) == self.depth else (None, None)
            out.append((r.decision_timestamp, *[None if m is None else x - m for x, m in zip((r.volume, r.trades), middle, strict=True)]))
            if r.admitted:
                newest.append((int(r.session), float(r.volume), float(r.trades)))
        for state, values in ((self.ring, ring), (self.newest, newest)):
            state.clear()
            if values:
                state.put(values)
        yield pd.DataFrame(out, columns=["decision_timestamp", "relative_volume_q", "relative_trade_count_q"]).astype({"relative_volume_q": float, "relative_trade_count_q": float})

    def close(self) -> None:
        pass


def activity_baseline(bars: DataFrame, s: Settings) -> DataFrame:
    """A stream of (decision_timestamp, relative_volume_q, relative_trade_count_q) from one of bars in order: log volume and trade
    count against the medians of the slot's last admitted bars of earlier sessions; NaN until there are enough."""
    start, end, day = F.col("minute_start"), F.col("decision_timestamp"), F.col("session_date")
    admitted = s.coverage.starts_by(start) & s.coverage.ends_after(end) & ~s.coverage.overlaps(start, end, day)
    own = bars.select(
        clock.minutes_since_open(end, day).alias("slot"), "decision_timestamp", F.unix_date(day).alias("session"), F.log1p("total_volume").alias("volume"),
        F.log1p("trade_count").alias("trades"), F.coalesce(admitted, F.lit(False)).alias("admitted"),
    )
    schema = "decision_timestamp TIMESTAMP, relative_volume_q DOUBLE, relative_trade_count_q DOUBLE"
    return own.groupBy("slot").transformWithStateInPandas(Baseline(s.baseline_depth), schema, "Append", "None")


class SessionFlush:
    """For ``foreachBatch`` on a stream of bars in order: batches gather in ``staging``; as soon as a later session has begun, a
    session goes to ``path`` in one write. A batch or a flush that runs again writes the same over itself. ``finish`` flushes
    what is left of a tape that has ended."""

    def __init__(self, staging: str, path: str, time: str = "timestamp_second"):
        self.staging, self.path, self.time = staging, path, time
        self.gather = session_writer(staging, time)

    def __call__(self, batch: DataFrame, number: int) -> None:
        days = sorted(r.day for r in batch.select(session_date(F.col(self.time)).alias("day")).distinct().collect())  # a batch's sessions
        if days:
            self.gather(batch, number)
            self._flush(batch.sparkSession, F.col("session_date") < F.lit(days[-1]))

    def finish(self, spark: SparkSession) -> None:
        self._flush(spark, F.lit(True))

    def _flush(self, spark: SparkSession, over) -> None:
        staged = spark.read.parquet(self.staging).where(over)
        if staged.limit(1).count():
            days = [r.session_date for r in staged.select("session_date").distinct().collect() if not self._written(spark, r.session_date)]
            for day in days:
                own = staged.where(F.col("session_date") == F.lit(day)).drop("batch").coalesce(1).sortWithinPartitions(self.time)
                own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(self.path)

    def _written(self, spark: SparkSession, day) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/session_date={day}")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
