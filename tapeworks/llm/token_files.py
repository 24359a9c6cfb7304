"""Token ids of all documents in files of a compact binary format, and the way back.

Texts are range-partitioned by document id, so files are in ascending id order; each task encodes its texts and writes
files of bounded size into the shared folder. A file has a name of its own for each attempt, and only the files that
successful tasks report enter the manifest, so tasks may be lost or run twice. The first document's global offset in a
file is a prefix sum over the manifest, one row a file."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .elias_fano import IdFile
from .shared import materialize, row_slices, shared_dir
from .tokens import WordLevel, encoder, ids_of

MANIFEST = "part int, piece int, path string, n_docs bigint, n_ids bigint"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path) if ":" in path else f"file://{path}")


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, file_bytes: int = 32 << 20, file_docs: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Writes all documents' ids, ``end_id`` after each, into ``folder``; returns the manifest (part, piece, path, n_docs,
    n_ids, first: ids of all files before it). A file is closed at ``file_bytes`` of ids or ``file_docs`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(WordLevel, vocabulary), TaskContext.get().partitionId()
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        end, keys, held, size, piece = np.array([end_id], "<u2"), [], [], 0, 0

        def flush():
            nonlocal keys, held, size, piece
            name = f"part-{part:06d}-{piece:06d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(IdFile.build(keys, held, 2))
            row = [part], [piece], [f"{folder}/{name}"], [len(keys)], [sum(map(len, held))]
            keys, held, size, piece = [], [], 0, piece + 1
            types = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["part", "piece", "path", "n_docs", "n_ids"])

        for rows in row_slices(batches):
            texts = [x or "" for x in rows.column(1).to_pylist()]
            for key, packed in zip(rows.column(0).to_pylist(), coder.encode(texts), strict=True):
                keys.append(key)
                held.append(np.concatenate([ids_of(packed), end]))
                size += held[-1].nbytes
                if size >= file_bytes or len(keys) >= file_docs:
                    yield flush()
        if keys:
            yield flush()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    # two levels, so that the only global window has one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    return manifest.join(parts, "part").withColumn("first", F.col("base") + F.sum("n_ids").over(inside) - F.col("n_ids")).drop("base")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the manifest's files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    schema = ", ".join(f"{n} {'array<bigint>' if n == 'ids' else 'bigint'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = _store(path)
                with store.open_input_stream(place) as data:
                    file = IdFile(data.read())
                rows = []
                for i in range(len(file)):
                    a, b = file.bounds(i)
                    ids = file.ids[a:b]
                    rows.append([file.key(i), first + a, b - a, zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if with_ids else [])])
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    # a task a file: adaptive execution would put many of these tiny rows into one
    files = manifest.select("path", "first")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def token_file_rows(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of ``docs`` into a new folder of the shared one, reads them back, and returns (doc_id, start,
    n_tokens, ids_crc32), a row for each row of ``docs``. Null and empty texts have the end id alone. Null doc_ids come
    first; equal ones are ordered by text. Very long texts are taken whole, each in one file. Other columns are ignored; an
    empty table gives no file and no row."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id, id_col=id_col, text_col=text_col))
