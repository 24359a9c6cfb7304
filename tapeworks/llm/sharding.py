"""Contiguous shards of near-equal bytes from a global prefix sum, in DataFrame operations only.

Rows are range-partitioned by id; each partition's byte and row totals (one row a partition) are summed up over the
partitions before it, and a window inside each partition adds the rest. No window spans the table: what is ordered
globally is one row for each partition. Texts are read once, in the scan; only 28 bytes a row are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    Rows are ordered by doc_id (nulls first, ties by size and checksum) and cut at equal targets of the total size: the row
    whose middle byte lies in the k-th of ``shards`` equal parts goes to shard k, so no shard is off its target by more
    than one row at each end. Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one (size 1, checksum
    0). slot numbers a shard's rows from 0 without gaps. Repeated rows and ids keep a row each. A row larger than a
    part leaves shards empty. Groups of equal texts are not kept together: one may be larger than a shard. Other columns
    are ignored; an empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "shard-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumns({"inside": running, "nth": F.row_number().over(inside) - 1})
    placed = placed.join(F.broadcast(totals), "part").select(  # one row a partition
        "doc_id", "size", "text_crc32", (F.col("nth") + F.col("rows_before")).alias("nth"),
        F.expr(f"least({shards - 1}, (2 * (size_before + inside) + size) * {shards} div (2 * total))").cast("int").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row a shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
