"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Full windows of a document stand alone. What is left of each document is cut into equal pieces of at most ``max_piece``
tokens; batches of pieces are spread over k windows: every piece starts as a partition of its own (its size in one window,
nothing in the others), and the two partitions of the largest imbalance are merged again and again, the fullest windows
of one onto the emptiest of the other. The result's windows are nearly equal. k starts at the least number that could
hold the batch and rises whenever a window exceeds its capacity. Batches are made within a task from the scan's rows:
no shuffle, bounded memory, and the same result if a lost task runs again."""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_slices
from .tokens import ByteLevel, encoder, ids_of


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items of each of k windows of nearly equal sums.

    A partition is a sorted list of (load, number, items so far as nested pairs) of its windows in use; the others are
    empty. A window's load is not reduced by the least one's: only differences count."""
    heap = [(-size, i, [(size, i, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, turn, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        shared = max(0, len(a) + len(b) - k)  # windows used on both sides: the emptiest get the emptiest in reverse
        low, high = a[:shared], b[:shared]
        del a[:shared]
        new = b[shared:]
        for (x, _, left), (y, _, right) in zip(reversed(low), high, strict=True):
            new.append((x + y, serial, (left, right)))
            serial += 1
        if len(new) < 8:
            for entry in new:
                bisect.insort(a, entry)
        else:
            a = sorted(a + new)
        heapq.heappush(heap, ((a[0][0] if len(a) == k else 0) - a[-1][0], turn, a))
    found = []
    for _, _, tree in heap[0][2] if heap else []:
        stack, items = [tree], []
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                items.append(node)
            else:
                stack += node
        found.append(sorted(items))
    return found + [[] for _ in range(k - len(found))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items, each of at most ``capacity``, in as few near-equal windows as differencing needs."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, max_piece: int = 512, batch: int = 1024,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document's ids are its text's (null: none) and ``end_id``; so an empty text is one piece of one id. Every id lies in
    one piece. A sequence's pieces lie one after another from offset 0; the rest up to ``capacity`` is padding. Repeated
    rows and ids are packed apart; other columns are ignored; very long texts give full sequences; an empty table
    gives an empty result. sequence_id is unique but not gapless: the task's number times 2^40 and a count. ids are
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ByteLevel, vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        full, loose = [], []

        def row(doc, ids, start, length):
            cut = ids[start : start + length].tobytes()
            return [doc, start, length, zlib.crc32(cut), len(ids), 0, 0, *([cut] if with_ids else [])]

        def settle():
            nonlocal sequence, full, loose
            rows = []
            for x in full:
                x[5], sequence = sequence, sequence + 1
                rows.append(x)
            for window in windows([x[2] for x in loose], capacity) if loose else []:
                at = 0
                for i in window:
                    loose[i][5], loose[i][6], at = sequence, at, at + loose[i][2]
                    rows.append(loose[i])
                sequence += 1
            full, loose = [], []
            columns = list(zip(*rows, strict=True)) or [[] for _ in types]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for part in row_slices(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            for doc, packed in zip(part.column(0).to_pylist(), coder.encode(texts), strict=True):
                ids = np.concatenate([ids_of(packed).astype("<u4"), end])
                whole = len(ids) // capacity * capacity
                full += [row(doc, ids, at, capacity) for at in range(0, whole, capacity)]
                rest = len(ids) - whole
                pieces = -(-rest // max_piece)
                cuts = [whole + rest * i // pieces for i in range(pieces + 1)] if pieces else []
                loose += [row(doc, ids, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
                if len(loose) >= batch or len(full) >= batch:
                    yield settle()
        yield settle()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)
