"""The tick rule: trade direction from price changes, carried over equal prices, chunks and sessions.

A direction holds until the next price change or the next change of instrument; an instrument that comes back starts
anew. Runs of one instrument are contiguous segments of the tape, not groups by instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.carry import time_chunk
from ..sources.tape import native_side, order_of


def tick_rule(trades: DataFrame, chunk: str = "hour", strict: bool = False, tasks: int | None = None) -> DataFrame:
    """Adds ``chunk``, ``change`` (sign against the trade before, null where not comparable) and ``direction`` (-1, 0, 1).

    Order is (ts_event, seq), or (ts_ns, ts_event, seq) where the tape has nanoseconds. Each chunk leaves one summary row; the
    state behind each chunk is a window over those rows. With ``strict`` a tape whose times go back in the order of seq fails
    the job: within a chunk seq must ascend, and behind a chunk lie only greater numbers than any before. tasks: over how many
    the chunks are dealt, here and for second bars; adaptive execution decides by bytes of the narrow trades, which the windows
    and sums of these steps multiply."""
    by = order_of(trades)
    rows = trades.withColumn("chunk", time_chunk(F.col("ts_event"), chunk))
    if tasks:
        rows = rows.repartition(tasks, "chunk")
    order = Window.partitionBy("chunk").orderBy(*by)
    rows = rows.withColumns({"_p": F.lag("price").over(order), "_i": F.lag("instrument_id").over(order), "_s": F.lag("seq").over(order)})
    rows = rows.withColumn("_segment", F.sum(F.when(F.col("_i") != F.col("instrument_id"), 1).otherwise(0)).over(order))
    rows = rows.withColumn("_sign", F.when(F.col("_i") == F.col("instrument_id"), F.signum(F.col("price") - F.col("_p")).cast("int")))
    moved = F.when(F.col("_sign") != 0, F.col("_sign"))
    rows = rows.withColumn("_local", F.last(moved, ignorenulls=True).over(Window.partitionBy("chunk", "_segment").orderBy(*by)))

    key = F.struct(*by)
    ends = rows.groupBy("chunk").agg(
        F.min_by(F.struct("instrument_id", "price"), key).alias("head"),
        F.max_by(F.struct("instrument_id", "price", "_local", "_segment"), key).alias("tail"),
        F.max("seq").alias("_seq"),
    )
    along = Window.orderBy("chunk")
    ends = ends.withColumn("before", F.lag("tail").over(along))
    joins = F.col("before.instrument_id") == F.col("head.instrument_id")
    ends = ends.withColumn("edge", F.when(joins, F.signum(F.col("head.price") - F.col("before.price")).cast("int")))
    own = (
        F.when(F.col("tail._local").isNotNull(), F.col("tail._local"))
        .when(F.col("tail._segment") > 0, F.lit(0))
        .when(F.col("edge").isNull(), F.lit(0))
        .when(F.col("edge") != 0, F.col("edge"))
    )
    ends = ends.withColumn("state", F.coalesce(F.last(own, ignorenulls=True).over(along), F.lit(0)))
    highest = F.max("_seq").over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("chunk", "edge", F.coalesce(F.lag("state").over(along), F.lit(0)).alias("carried"), highest.alias("_before"))

    rows = rows.join(ends, "chunk")
    opening = F.when((F.col("_segment") == 0) & F.col("edge").isNotNull(), F.when(F.col("edge") != 0, F.col("edge")).otherwise(F.col("carried")))
    direction = F.coalesce("_local", opening, F.lit(0)).cast("int")
    if strict:
        backward = F.coalesce(F.greatest("_s", "_before") >= F.col("seq"), F.lit(False))
        message = F.concat(F.lit("backward trade: "), F.col("seq").cast("string"), F.lit(" at "), F.col("ts_event").cast("string"))
        direction = F.when(backward, F.raise_error(message).cast("int")).otherwise(direction)
    return rows.withColumns({
        "change": F.when(F.col("_i").isNull(), F.col("edge")).otherwise(F.col("_sign")),
        "direction": direction,
    }).drop("_p", "_i", "_s", "_before", "_segment", "_sign", "_local", "edge", "carried")


def with_flow(rows: DataFrame) -> DataFrame:
    """Adds per-trade moments, movement flags, inferred and native volumes."""
    size, side, change = F.col("size"), F.col("direction"), F.col("change")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    return rows.withColumns({
        "price_volume": F.col("price") * size,
        "price_squared_volume": F.col("price") * F.col("price") * size,
        "size_squared": size * size,
        "uptick": flag(change > 0),
        "downtick": flag(change < 0),
        "same_price": flag(change == 0),
        "inferred_buy_volume": F.when(side == 1, size).otherwise(0),
        "inferred_sell_volume": F.when(side == -1, size).otherwise(0),
        "inferred_unknown_volume": F.when(side == 0, size).otherwise(0),
        "inferred_buy": flag(side == 1),
        "inferred_sell": flag(side == -1),
        "inferred_unknown": flag(side == 0),
        "inferred_delta": side * size,
    } | native_side(F.col("side")))
