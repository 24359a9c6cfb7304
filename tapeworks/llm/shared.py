"""What the corpus operators share: the cluster's shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark bounds an Arrow batch by bytes (64 MB unless set); Python objects are made of slices of about so much.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir. Where that is unset, a
    local master gets a temporary folder; on a cluster that would be lost work, so it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tapeworks-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/tapeworks-{sc.applicationId}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later plans start from those files, not from
    this lineage, so a lost executor costs no recomputation of earlier stages. options: the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Removes a table of ``materialize`` that no open result is read from any more."""
    _remove(table.sparkSession, table.written_to)


def remove_intermediates(spark: SparkSession) -> None:
    """Removes all that the operators of this application have written into the shared folder. For callers that have
    written their results elsewhere: results not yet read are read from there."""
    _remove(spark, shared_dir(spark))


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about SLICE_BYTES, so that the Python objects made of one batch
    stay small; a longer text is a batch of its own."""
    for batch in batches:
        at, starts = 0, _text_starts(batch)
        while at < batch.num_rows:
            end = min(batch.num_rows, at + rows)
            for ends in starts:
                while end > at + 1 and ends[end] - ends[at] > SLICE_BYTES:
                    end = at + (end - at + 1) // 2
            yield batch.slice(at, end - at)
            at = end


def _text_starts(batch: pa.RecordBatch | pa.StructArray) -> list:
    """Byte offsets of each row in the batch's text columns, in structs too."""
    found = []
    for column in batch.columns if isinstance(batch, pa.RecordBatch) else batch.flatten():
        kind = column.type
        if pa.types.is_struct(kind):
            found += _text_starts(column)
        elif pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
            width = pa.int64() if wide else pa.int32()
            offsets = pa.Array.from_buffers(width, len(column) + 1, [None, column.buffers()[1]], offset=column.offset)
            found.append(offsets.to_numpy(zero_copy_only=False))
    return found
