"""Trade tapes: the trades view over the driver's events table, and raw files of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import session_date

#: What the fixture tape's instruments are called.
CONTRACTS = {1: "TAPE1", 2: "TAPE2", 3: "TAPE3"}
#: 2024-01-02 14:00 UTC in microseconds.
DENSE_START = 1_704_204_000_000_000
RAW_SCHEMA = "ts_event TIMESTAMP, seq BIGINT, instrument_id BIGINT, price DOUBLE, size BIGINT, side STRING"


def trades_from_events(events: DataFrame) -> DataFrame:
    """The events table as a tape: quarter ticks, sizes from the properties, two contract rolls in mid-session."""
    ts = F.col("ts").cast("timestamp")
    roll = lambda at: ts < F.lit(at).cast("timestamp")
    return events.select(
        ts.alias("ts_event"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.when(roll("2024-01-11 18:00:00"), 1).when(roll("2024-01-21 18:00:00"), 2).otherwise(3).cast("bigint").alias("instrument_id"),
        F.greatest(F.round(F.col("value") * 4) / 4, F.lit(0.25)).alias("price"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("size"),
        F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "error", "A").otherwise("N").alias("side"),
    )


def dense_trades_from_events(events: DataFrame) -> DataFrame:
    """The events dealt over two hours a day on 25 days, a trade every 18 seconds or oftener, so that bars of a minute follow one
    another as they do on a busy tape. Two minutes are missing on every sixth day; the contract changes twice, in mid-session."""
    n, day = F.col("event_id").cast("bigint"), F.col("event_id").cast("bigint") % 25
    second = (F.floor(n / 25) * 18) % 7200
    micros = F.lit(DENSE_START) + day * 86_400_000_000 + second * 1_000_000 + n % 10 * 100_000
    ts = F.timestamp_micros(micros)
    roll = lambda at: ts < F.lit(at).cast("timestamp")
    return events.where(~((day % 6 == 5) & second.between(3600, 3719))).select(
        ts.alias("ts_event"), n.alias("seq"),
        F.when(roll("2024-01-11 15:00:00"), 1).when(roll("2024-01-19 14:40:00"), 2).otherwise(3).cast("bigint").alias("instrument_id"),
        F.greatest(F.round(F.col("value") * 4) / 4, F.lit(0.25)).alias("price"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("size"),
        F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "error", "A").otherwise("N").alias("side"),
    )


def read_trades(spark: SparkSession, path: str, form: str = "parquet", nanoseconds: bool = False) -> DataFrame:
    """Raw trades in Parquet, ORC, CSV (with header) or JSON lines. Unsigned columns are widened to the tape's types; ``ts_recv``
    and other columns are never used for order.

    Instants are cut to microseconds. With ``nanoseconds``, ``ts_event`` is taken as nanoseconds since 1970 (a Parquet timestamp of
    that unit, or a whole number) and kept beside it as ``ts_ns``, by which the tape is then ordered."""
    kind = RAW_SCHEMA.replace("ts_event TIMESTAMP", "ts_event BIGINT") if nanoseconds else RAW_SCHEMA
    if form == "parquet":
        if nanoseconds:  # for as long as the table is read; without it Spark refuses such columns anyway
            spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        raw = spark.read.parquet(path).select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in kind.split(", ")])
    else:
        reader = spark.read.schema(kind)
        raw = reader.option("header", True).format(form).load(path) if form == "csv" else reader.format(form).load(path)
    if not nanoseconds:
        return raw
    return raw.withColumn("ts_ns", F.col("ts_event")).withColumn("ts_event", F.timestamp_micros(F.expr("(ts_ns - pmod(ts_ns, 1000)) div 1000")))


def order_of(trades: DataFrame) -> list[str]:
    """The columns that put a tape in order: nanoseconds where it has them, the event time, the sequence number."""
    return [*(["ts_ns"] if "ts_ns" in trades.columns else []), "ts_event", "seq"]


def with_context(trades: DataFrame, contracts: dict[int, str] = CONTRACTS) -> DataFrame:
    """Adds second, session and contract; a trade of an unknown instrument fails the job."""
    names = F.create_map(*[F.lit(x) for k, v in contracts.items() for x in (k, v)])
    contract = names[F.col("instrument_id")]
    known = F.coalesce(contract, F.raise_error(F.concat(F.lit("unknown instrument "), F.col("instrument_id").cast("string"))))
    return trades.withColumns({
        "timestamp_second": F.date_trunc("second", F.col("ts_event")),
        "session_date": session_date(F.col("ts_event")),
        "contract": known,
    })


def native_side(side) -> dict:
    """Volumes by the venue's own side: a benchmark only, never a predictor."""
    size = F.col("size")
    return {
        "native_buy_volume": F.when(side == "B", size).otherwise(0),
        "native_sell_volume": F.when(side == "A", size).otherwise(0),
        "native_unknown_volume": F.when(side.isin("A", "B"), 0).otherwise(size),
        "native_delta": F.when(side == "B", size).when(side == "A", -size).otherwise(0),
    }
