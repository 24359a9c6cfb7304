"""Removal of byte strings that occur twice anywhere in a corpus, by difference-cover suffix sorting.

Sorting all suffixes of a corpus moves it many times over, so the sort is distributed by a property of the content:
every window of ``length`` bytes is filed under its *anchor*, the window's gram of least hash (leftmost among equals). Equal
windows have equal anchors at equal places, so windows of different anchors are never compared. Neighbouring windows of
a text share an anchor; they are one *context*: the bytes that these windows span.

1. Every text gives one row for each context: the anchor's hash, a 128-bit hash of the context, where it stands.
2. An anchor seen once holds no repeat. Equal contexts are one from here on: all their windows repeat. Where all
   contexts of an anchor are equal, nothing else is open.
3. Of the other anchors' contexts one representative of each distinct one is fetched from its text, and their suffixes are
   sorted by the difference cover and neighbours' prefixes compared: the contexts of an anchor in one task
   (``suffix_array``), or, where an anchor has over ``cap`` bytes of distinct contexts, over all tasks (``suffix_sort``).
4. Each text gets its repeated windows back, and loses the bytes that they cover.

Counting is pre-aggregated; what is grouped by a key is written before it is joined on that key, so that adaptive
execution can split a join with a hot anchor; texts travel compressed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import binaries, discard, materialize, row_slices
from .suffix_array import repeated_starts
from .suffix_sort import adjacent, suffix_ranks

FACTOR = 0x9E3779B97F4A7C15
CHUNK = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
CONTEXT = ["name", "c1", "c2"]


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2^64."""
    steps = np.full(size, FACTOR, np.uint64), np.full(size, pow(FACTOR, -1, 1 << 64), np.uint64)
    for x in steps:
        x[:1] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    power, inverse = _powers(1 << max(12, len(text).bit_length()))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(text) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def contexts(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each context of a text."""
    text, span = np.frombuffer(data, np.uint8), length - gram + 1
    names, firsts, counts = [], [], []
    for at in range(0, len(text) - length + 1, CHUNK):
        h = _gram_hashes(text[at : at + CHUNK + length - 1], gram)
        keys = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - span + 1
        padded = np.full(-(-len(h) // span) * span, ~np.uint64(0))
        padded[: len(h)] = keys
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchors = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        names.append(h[anchors[first]])
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, n)))
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(firsts), np.concatenate(counts)


def _ranges(marks: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true, alternating."""
    return np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))).tolist()


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Rows of equal id and text are one key; k1 and k2 stand for them."""
    id_, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(id_, F.lit(0)).alias("k1"), F.xxhash64(id_.isNull(), text).alias("k2")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*_keys(id_col, text_col), F.col(id_col).cast("bigint").alias("id"), text.alias("text"))


def _compressed(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for rows in row_slices(batches):
            packed = pa.array([squeeze.compress(x) for x in binaries(rows.column(3))], pa.binary())
            yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), packed], ["k1", "k2", "id", "packed"])

    return keyed.mapInArrow(run, "k1 bigint, k2 bigint, id bigint, packed binary")


def repeated_windows(keyed: DataFrame, length: int, gram: int, batch: int, cap: int) -> DataFrame:
    """(k1, k2, ranges): for each text with repeats, starts and ends of runs of window starts, alternating, unordered."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for rows in row_slices(batches):
            columns = [[] for _ in range(7)]
            for k1, k2, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), binaries(rows.column(2)), strict=True):
                names, firsts, counts = contexts(data, length, gram)
                ends = (firsts + counts + (length - 1)).tolist()
                hashes = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(firsts.tolist(), ends, strict=True)]), np.int64).reshape(-1, 2)
                both = np.full(len(names), k1), np.full(len(names), k2)
                for c, x in zip(columns, (names.view(np.int64), hashes[:, 0], hashes[:, 1], *both, firsts, counts), strict=True):
                    c.append(x)
            types = [np.int64] * 5 + [np.int32] * 2
            arrays = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch(arrays, [*CONTEXT, "k1", "k2", "first", "n"])

    filed = keyed.select("k1", "k2", "text").mapInArrow(file, "name bigint, c1 bigint, c2 bigint, k1 bigint, k2 bigint, first int, n int")
    filed = materialize(filed, "suffix-contexts")
    edges = [f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]
    names = filed.groupBy("name").agg(F.count("*").alias("seen"), *edges).where("seen > 1")
    names = materialize(names.select("name", F.expr("min_c1 <> max_c1 OR min_c2 <> max_c2").alias("mixed")), "suffix-names")
    found = materialize(filed.join(names, "name"), "suffix-found")
    discard(filed)

    mixed = found.where("mixed").groupBy(*CONTEXT).agg(
        F.count("*").alias("seen"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("first").alias("first"), F.first("n").alias("n")
    )
    mixed = materialize(mixed, "suffix-mixed")
    # nothing is open where every distinct context was seen twice
    sizes = mixed.groupBy("name").agg(F.min("seen").alias("least"), F.sum(F.col("n") + (length - 1)).alias("bytes"))
    sizes = materialize(sizes.where("least = 1").select("name", (F.col("bytes") > cap).alias("large")), "suffix-sizes")
    wanted = mixed.join(sizes, "name").select("k1", "k2", F.struct(*CONTEXT, "first", "n", "large").alias("x"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted"))  # bounded by one text's contexts
    wanted = materialize(wanted, "suffix-wanted")
    meeting = _compressed(keyed).join(wanted, ["k1", "k2"]).select("k1", "k2", "packed", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, last = zstandard.ZstdDecompressor(), None
        for rows in row_slices(batches, 64):
            out = [[] for _ in range(5)]
            keys = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)
            for key, packed, wanted in zip(keys, rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if key == last:
                    continue  # a row that is there again
                data, last = expand.decompress(packed), key
                for x in wanted:
                    row = x["name"], x["c1"], x["c2"], data[x["first"] : x["first"] + x["n"] + length - 1], x["large"]
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            types = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], [*CONTEXT, "data", "large"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by name; whole names are gathered up to about ``batch`` bytes."""
        held, size, last = {}, 0, None

        def close():
            text = np.frombuffer(b"".join(held.values()), np.uint8)
            lengths = np.array([len(d) for d in held.values()])
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            counts = lengths - (length - 1)
            starts = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            again = np.split(repeated_starts(text, starts, length), np.cumsum(counts)[:-1])
            rows = [(*key, r) for key, m in zip(held, again, strict=True) if (r := _ranges(m))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*CONTEXT, "ranges"])

        for rows in batches:
            for *key, data in zip(*[rows.column(i).to_pylist() for i in range(4)], strict=True):
                if size > batch and key[0] != last:
                    yield close()
                    held, size = {}, 0
                last = key[0]
                if tuple(key) not in held:  # a text that is there twice may give its contexts twice
                    held[tuple(key)] = data
                    size += len(data)
        if held:
            yield close()

    met = materialize(meeting.mapInArrow(fetch, "name bigint, c1 bigint, c2 bigint, data binary, large boolean"), "suffix-met")
    dealt = met.where("NOT large").select(*CONTEXT, "data").repartition("name").sortWithinPartitions("name")
    partly = dealt.mapInArrow(sort, "name bigint, c1 bigint, c2 bigint, ranges array<int>")
    if met.where("large").limit(1).count():
        partly = partly.union(_sorted_over_tasks(met.where("large").drop("large"), length))

    whole = F.array(F.lit(0), F.col("n"))
    known = mixed.where("seen > 1").select(*CONTEXT, whole.alias("ranges"))
    partly = partly.join(mixed.where("seen = 1").select(*CONTEXT), CONTEXT)
    known = materialize(known.unionByName(partly), "suffix-known")
    hits = found.where("mixed").drop("mixed").join(known, CONTEXT)
    hits = hits.unionByName(found.where("NOT mixed").drop("mixed").withColumn("ranges", whole))
    hits = hits.select("k1", "k2", F.transform("ranges", lambda x: x + F.col("first")).alias("ranges")).distinct()
    hits = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # bounded by one text
    return materialize(hits, "suffix-ranges")


def _sorted_over_tasks(met: DataFrame, length: int) -> DataFrame:
    """(name, c1, c2, ranges) of the contexts (name, c1, c2, data) with repeated windows, by a suffix sort of them all over all
    tasks. Neighbours are compared by a 64-bit hash of their windows first, and those of equal hash byte by byte."""
    met = met.groupBy(*CONTEXT).agg(F.first("data").alias("data"))
    met = materialize(met.withColumn("id", F.monotonically_increasing_id()), "suffix-large")

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, 256):
            texts = rows.column(1).to_pylist()
            lengths = np.array([len(x) for x in texts])
            ids = np.repeat(rows.column(0).to_numpy(), lengths)
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            s = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
            yield pa.record_batch([pa.array(ids), pa.array(at.astype(np.int32)), pa.array(s)], ["id", "at", "s"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for rows in row_slices(batches, 256):
            found = [(i, at, digest(x[at : at + length])) for i, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for at in range(len(x) - length + 1)]
            ids, at, h = zip(*found, strict=True) if found else ([],) * 3
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], ["id", "at", "h"])

    source = met.select("id", "data")
    ranks = suffix_ranks(source.mapInArrow(symbols, "id bigint, at int, s bigint"), length)
    pairs = adjacent(ranks.join(source.mapInArrow(windows, "id bigint, at int, h bigint"), ["id", "at"]))
    one, other = source, source.select(F.col("id").alias("next_id"), F.col("data").alias("next_data"))
    pairs = materialize(pairs, "suffix-pairs").join(one, "id").join(other, "next_id")
    same = F.expr(f"substring(data, at + 1, {length}) = substring(next_data, next_at + 1, {length})")
    pairs = materialize(pairs.where(same).select("id", "at", "next_id", "next_at"), "suffix-same")
    starts = pairs.select("id", "at").union(pairs.select("next_id", "next_at")).distinct()
    ranges = starts.groupBy("id").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("ranges"))  # bounded by one context
    return met.join(ranges, "id").select(*CONTEXT, "ranges")


def merged(ranges: list[int] | None, length: int) -> list[tuple[int, int]]:
    """The byte runs that windows starting in the ranges cover, in order, touching ones joined."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip((ranges or [])[::2], (ranges or [])[1::2], strict=True)):
        b += length - 1
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(b, runs[-1][1])
        else:
            runs.append((a, b))
    return runs


def remove_repeats(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False,
    gram: int = 32, batch: int = 1 << 20, cap: int = 8 << 20,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) for each row of ``docs``.

    Texts are UTF-8 bytes (null: empty); texts shorter than ``length`` keep all. All occurrences of a repeated string go,
    the first one too; rows repeated with the same id are occurrences of their own. spans holds starts and ends of the
    removed runs, kept the remaining bytes. Very long texts are taken whole, in chunks of a few megabytes. Other columns are
    ignored, whatever their names; an empty table gives an empty result."""
    gram = min(gram, max(1, length // 2))
    keyed = _keyed(docs, id_col, text_col)
    ranges = repeated_windows(keyed, length, gram, batch, cap)
    joined = _compressed(keyed).join(ranges, ["k1", "k2"], "left").select("id", "packed", "ranges")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_kept
    types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64()), pa.binary()] * with_kept
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<bigint>, kept binary" * with_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for rows in row_slices(batches, 256):
            columns = [[] for _ in names]
            for doc, packed, found in zip(*[rows.column(i).to_pylist() for i in range(3)], strict=True):
                data = expand.decompress(packed)
                runs = merged(found, length)
                kept = b"".join([data[a:b] for a, b in zip([0, *[b for _, b in runs]], [*[a for a, _ in runs], len(data)], strict=True)])
                row = [doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()]
                for c, v in zip(columns, row + [[x for r in runs for x in r], kept] * with_kept, strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return joined.mapInArrow(run, schema)


def strip_repeats(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars",
    gram: int = 32, batch: int = 1 << 20, cap: int = 8 << 20,
) -> DataFrame:
    """The rows with all their columns, without the repeated bytes in their texts (and without the rest of a character that
    a cut divides); ``size_col``, if there, is the new length in characters. Rows stay even where nothing is left.

    Null texts stay null, empty ones empty; rows repeated with the same id are occurrences of their own, so both lose the
    text; very long texts are taken whole; other columns pass through, whatever their names; an empty table gives an
    empty result."""
    columns, keyed = docs.columns, _keyed(docs, id_col, text_col)
    ranges = repeated_windows(keyed, length, min(gram, max(1, length // 2)), batch, cap)
    rows = docs.select(*_keys(id_col, text_col), F.struct(*[F.col(c) for c in columns]).alias("row"))
    rows = rows.join(ranges, ["k1", "k2"], "left").select("row", "ranges")
    place, size = columns.index(text_col), columns.index(size_col) if size_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 256):
            fields = part.column(0).flatten()
            texts = []
            for data, found in zip(binaries(fields[place]), part.column(1).to_pylist(), strict=True):
                if runs := merged(found, length):
                    edges = zip([0, *[b for _, b in runs]], [*[a for a, _ in runs], len(data)], strict=True)
                    data = b"".join([data[a:b] for a, b in edges])
                texts.append(None if data is None else data.decode(errors="ignore"))
            fields[place] = pa.array(texts, fields[place].type)
            if size is not None:
                fields[size] = pa.array([None if x is None else len(x) for x in texts], fields[size].type)
            yield pa.record_batch(fields, columns)

    return rows.mapInArrow(run, docs.schema)
