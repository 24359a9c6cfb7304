"""Ordered state over a whole tape without a window over the whole tape.

A tape is cut into chunks of time. What a chunk leaves behind is one summary row; the rows of all chunks, one a chunk,
are few, and a window over those carries state from chunk to chunk. Inside a chunk ordinary windows do the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_chunk(ts: Column, chunk: str) -> Column:
    """chunk: a unit that date_trunc knows, such as hour."""
    return F.date_trunc(chunk, ts)


def lag_across(df: DataFrame, chunk: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each ``new: column`` in values, that column of the row before in (chunk, order) order, through any number of
    chunk borders; null for the first row of all. Chunks must ascend with the order."""
    inside = Window.partitionBy(chunk).orderBy(*order)
    df = df.withColumns({f"_in_{n}": F.lag(c).over(inside) for n, c in values.items()} | {"_first": F.row_number().over(inside) == 1})
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), F.struct(*order))
    ends = df.groupBy(chunk).agg(last.alias("_last"))
    before = ends.select(chunk, F.lag("_last").over(Window.orderBy(chunk)).alias("_chunk_before"))
    df = df.join(before, chunk, "left")
    df = df.withColumns({n: F.when(F.col("_first"), F.col(f"_chunk_before.{n}")).otherwise(F.col(f"_in_{n}")) for n in values})
    return df.drop("_first", "_chunk_before", *[f"_in_{n}" for n in values])
