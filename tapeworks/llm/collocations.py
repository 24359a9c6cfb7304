"""Phrase collocations, counted in counting quotient filters of packed word-id n-grams.

Texts are tokenised once into shards of local word ids. The shards' vocabularies, dealt out by ranges of a hash of the word, are
merged into global ids of the words frequent enough to stand in a phrase; each shard gets back the ids of its own words and is
renumbered, so nothing is broadcast. Then n-grams of 2, 3, ... words are
counted a length at a time. Each shard sorts its own n-grams into a filter and deals it out by ranges of the quotient; a
task merges the sorted slices of a range, keeps what is frequent, and answers each shard with a bit for each of its entries. From
those bits the shard keeps only runs in which every n-gram is frequent, so the next length has only windows whose parts are
frequent, which loses no frequent phrase. An n-gram is one entry a shard however often it occurs, so no key is hot."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quotient_filter import Layout, decode, encode, sort_unique
from .shared import binaries, discard, materialize, row_slices

UND = "und"
#: Entries that a task merges at once, about.
RANGE = 1 << 20
_TABLE = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words, with ``.`` (which no word holds) wherever pieces end."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def _pressed(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes(), 1)


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _places(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def token_shards(docs: DataFrame, shard_bytes: int, text_col: str, lang_col: str) -> DataFrame:
    """(shard, size, ids, langs, words, local, counts): local word ids from 1 in the texts' order, 0 between pieces; for each
    language its words in the order of their hashes, their ids and how often they occur; size: how many words those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        vocabularies, held, size, new = {}, [], 0, count(1)

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            often, own = np.bincount(ids), []
            for lang, table in vocabularies.items():
                del table[b"."]
                words, local = list(table), np.fromiter(table.values(), np.int64, len(table))
                order = np.argsort(_places(words), kind="stable")
                local = local[order]
                own.append((lang, _pressed(b" ".join([words[i] for i in order])), _pressed(local.astype("<i4")), _pressed(often[local].astype("<i8"))))
            langs, words, local, counts = zip(*own, strict=True)
            columns = [pa.array([number], pa.int64()), pa.array([len(often) - 1], pa.int64()), pa.array([_pressed(ids.astype("<i4"))], pa.binary())]
            columns += [pa.array([langs], pa.list_(pa.string())), *[pa.array([x], pa.list_(pa.binary())) for x in (words, local, counts)]]
            return pa.record_batch(columns, ["shard", "size", "ids", "langs", "words", "local", "counts"])

        for batch in row_slices(batches):
            for text, lang in zip(binaries(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                if (own := vocabularies.get(lang)) is None:
                    own = vocabularies[lang] = defaultdict(new.__next__)
                    own[b"."] = 0
                found = tokens(text)
                ids = np.zeros(len(found) + 1, np.int32)
                ids[:-1] = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
                held.append(ids)
                size += len(text)
                if size >= shard_bytes:
                    yield flush()
                    number += 1
                    vocabularies, held, size, new = {}, [], 0, count(1)
        if held:
            yield flush()

    source = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"))
    schema = "shard bigint, size bigint, ids binary, langs array<string>, words array<binary>, local array<binary>, counts array<binary>"
    return materialize(source.mapInArrow(run, schema), "phrase-shards", **_BLOBS)


#: A shard is one row, so Parquet has to look at the size of its row groups after each.
_BLOBS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _vocabulary(shards: DataFrame, least: int, ranges: int) -> DataFrame:
    """Rows (lang, range, word, total, place) of the words that occur ``least`` times in their language, their places in a range
    from 1; rows (lang, range, total) of all its words; and answers (shard, lang, range, answer): the places of a shard's words of
    that range, in its order, 0 for the others. ranges: bits of a word's hash that tell its range."""
    names = ["range", "lang", "shard", "words", "counts"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, langs, words, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for lang, blob, often in zip(langs, words, counts, strict=True):
                    own, often = zstandard.decompress(blob).split(), _array(often, "<i8")
                    place = (_places(own) >> np.uint64(64 - ranges) if ranges else np.zeros(len(own))).astype(np.int64)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(own)])).tolist() if own else [0]
                    at = [int(place[a]) for a in cuts[:-1]]
                    parts = [(_pressed(b" ".join(own[a:b])), _pressed(often[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.record_batch([
                        pa.array(at, pa.int64()), pa.array([lang] * len(at), pa.string()), pa.array([shard] * len(at), pa.int64()),
                        pa.array([w for w, _ in parts], pa.binary()), pa.array([n for _, n in parts], pa.binary()),
                    ], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, totals, used = None, [], defaultdict(int), 0

        def close() -> pa.RecordBatch:
            nonlocal used
            often = sorted(w for w, n in totals.items() if n >= least)
            place = {w: used + i + 1 for i, w in enumerate(often)}
            used += len(often)
            answers = [(shard, _pressed(np.array([place.get(w, 0) for w in zstandard.decompress(blob).split()], "<i4"))) for shard, blob in held]
            n, m = len(answers), len(often)
            return pa.record_batch([
                pa.array([s for s, _ in answers] + [None] * (m + 1), pa.int64()), pa.array([head[1]] * (n + m + 1), pa.string()),
                pa.array([head[0]] * (n + m + 1), pa.int64()), pa.array([x for _, x in answers] + [None] * (m + 1), pa.binary()),
                pa.array([None] * n + often + [None], pa.binary()).cast(pa.string()),
                pa.array([None] * n + [totals[w] for w in often] + [sum(totals.values())], pa.int64()),
                pa.array([None] * n + [place[w] for w in often] + [None], pa.int64()),
            ], ["shard", "lang", "range", "answer", "word", "total", "place"])

        for batch in batches:
            for r, lang, shard, blob, often in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (r, lang) != head:
                    if held:
                        yield close()
                    used = used if head and head[0] == r else 0
                    head, held, totals = (r, lang), [], defaultdict(int)
                held.append((shard, blob))
                for w, n in zip(zstandard.decompress(blob).split(), _array(often, "<i8").tolist(), strict=True):
                    totals[w] += n
        if held:
            yield close()

    slices = shards.select("shard", "langs", "words", "counts").mapInArrow(deal, "range bigint, lang string, shard bigint, words binary, counts binary")
    slices = slices.repartition("range").sortWithinPartitions("range", "lang", "shard")
    schema = "shard bigint, lang string, range bigint, answer binary, word string, total bigint, place bigint"
    return materialize(slices.mapInArrow(merge, schema), "phrase-words")


def _runs(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The stretches of ``ids`` in which windows of ``width`` begin at consecutive ``starts``, a zero after each."""
    if not len(starts):
        return ids[:0]
    first = np.flatnonzero(np.concatenate(([True], np.diff(starts) != 1)))
    sizes = np.diff(np.concatenate((first, [len(starts)]))) + width
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(starts[first], sizes)
    out = ids[np.minimum(at, len(ids) - 1)]
    out[ends - 1] = 0
    return out


def _renumbered(shards: DataFrame, vocabulary: DataFrame, shift: int, kind: str) -> DataFrame:
    """(shard, ids): runs of global ids, 0 where another word or a piece's end lies between. shift: bits of a word's place."""
    answers = vocabulary.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("lang", "range", "answer")).alias("answers"))  # a shard's ranges
    rows = shards.select("shard", "ids", "langs", "local").join(answers, "shard")
    rows = rows.select("shard", "ids", "langs", "local", *[F.col(f"answers.{c}").alias(f"a_{c}") for c in ("lang", "range", "answer")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, ids, langs, local, a_lang, a_range, a_answer = (c[i].as_py() for c in batch.columns)
                ids, got = _array(ids, "<i4"), defaultdict(list)
                table = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
                for r, lang, answer in sorted(zip(a_range, a_lang, a_answer, strict=True)):
                    place = _array(answer, "<i4").astype(np.int64)
                    got[lang].append(np.where(place > 0, place | (r << shift), 0))
                for lang, own in zip(langs, local, strict=True):
                    if lang in got:
                        table[_array(own, "<i4")] = np.concatenate(got[lang])
                found = table[ids]
                yield _blob(shard, _runs(found, np.flatnonzero(found), 1), kind)

    return materialize(rows.mapInArrow(run, "shard bigint, ids binary"), "phrase-ids", **_BLOBS)


def _blob(shard: int, ids: np.ndarray, kind: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array([shard], pa.int64()), pa.array([_pressed(ids.astype(kind))], pa.binary())], ["shard", "ids"])


def _windows(ids: np.ndarray, layout: Layout) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where windows without a zero begin, and their lanes."""
    n = len(ids) - layout.words + 1
    whole = np.ones(max(0, n), bool)
    for i in range(layout.words):
        whole &= ids[i : n + i] > 0
    starts = np.flatnonzero(whole)
    return starts, layout.pack([ids[starts + i] for i in range(layout.words)])


def _count(ids: DataFrame, layout: Layout, kind: str, least: int, ranges: int) -> DataFrame:
    """Frequent n-grams as rows (gram, n), and answers as rows (shard, range, frequent): a bit for each of a shard's distinct
    n-grams in that range of the quotient, in order. ranges: bits of the quotient that tell the range."""
    far = np.uint64(layout.lead - ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, lanes = _windows(_array(batch.column(1)[i].as_py(), kind), layout)
                if not len(lanes[0]):
                    continue
                order, first = sort_unique(lanes)
                counts = np.diff(np.concatenate((first, [len(order)])))
                lanes = [x[order[first]] for x in lanes]
                quotient = max(ranges, min(layout.lead, int(len(counts)).bit_length() - 1))
                place = (lanes[0] >> far).astype(np.int64)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)])).tolist()
                at = place[cuts[:-1]].tolist()
                data = [
                    encode(layout, [x[a:b] for x in lanes], counts[a:b], r << (quotient - ranges), quotient)
                    for r, a, b in zip(at, cuts, cuts[1:], strict=False)
                ]
                shard = pa.array([batch.column(0)[i].as_py()] * len(at), pa.int64())
                yield pa.record_batch([pa.array(at, pa.int64()), shard, pa.array(data, pa.binary())], ["range", "shard", "filter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, head, held = ["shard", "range", "frequent", "gram", "n"], None, []

        def close() -> Iterator[pa.RecordBatch]:
            found = [decode(layout, x) for _, x in held]
            lanes = [np.concatenate(x) for x in zip(*[own for own, _ in found], strict=True)]
            counts = np.concatenate([n for _, n in found])
            order, first = sort_unique(lanes)
            sums = np.add.reduceat(counts[order], first)
            often = sums >= least
            flags = np.zeros(len(order), bool)
            flags[order] = np.repeat(often, np.diff(np.concatenate((first, [len(order)]))))
            cuts = np.cumsum([len(n) for _, n in found])[:-1]
            bits = [(shard, np.packbits(x).tobytes()) for (shard, _), x in zip(held, np.split(flags, cuts), strict=True) if x.any()]
            if bits:
                grams = np.column_stack(layout.unpack([x[order[first[often]]] for x in lanes])).astype(np.int64)
                n = sums[often]
                yield pa.record_batch([
                    pa.array([s for s, _ in bits] + [None] * len(n), pa.int64()), pa.array([head] * (len(bits) + len(n)), pa.int64()),
                    pa.array([x for _, x in bits] + [None] * len(n), pa.binary()), pa.array([None] * len(bits) + grams.tolist(), pa.list_(pa.int64())),
                    pa.array([None] * len(bits) + n.tolist(), pa.int64()),
                ], names)

        for batch in batches:
            for place, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if place != head:
                    if held:
                        yield from close()
                    head, held = place, []
                held.append((shard, data))
        if held:
            yield from close()

    slices = ids.mapInArrow(deal, "range bigint, shard bigint, filter binary").repartition("range").sortWithinPartitions("range", "shard")
    return materialize(slices.mapInArrow(merge, "shard bigint, range bigint, frequent binary, gram array<bigint>, n bigint"), "phrase-counts")


def _kept(ids: DataFrame, counted: DataFrame, layout: Layout, kind: str, ranges: int) -> DataFrame:
    """(shard, ids): the runs in which every n-gram is frequent."""
    far = np.uint64(layout.lead - ranges)
    answers = counted.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("range", "frequent")).alias("answers"))  # a shard's ranges
    rows = ids.join(answers, "shard").select("shard", "ids", "answers.range", "answers.frequent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _array(batch.column(1)[i].as_py(), kind)
                starts, lanes = _windows(own, layout)
                order, first = sort_unique(lanes)
                place = (lanes[0][order[first]] >> far).astype(np.int64)
                often = np.zeros(len(first), bool)
                for r, bits in zip(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), strict=True):
                    a, b = np.searchsorted(place, [r, r + 1])
                    often[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
                flags = np.zeros(len(order), bool)
                flags[order] = np.repeat(often, np.diff(np.concatenate((first, [len(order)]))))
                yield _blob(batch.column(0)[i].as_py(), _runs(own, starts[flags], layout.words), kind)

    return materialize(rows.mapInArrow(run, "shard bigint, ids binary"), "phrase-ids", **_BLOBS)


def count_phrases(docs: DataFrame, longest: int, least: int, text_col: str, lang_col: str, shard_bytes: int, range_words: int, range_entries: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of 1 to ``longest`` words that occur ``least`` times in their language, overlaps
    included, and (lang, n) of all words."""
    shards = token_shards(docs, shard_bytes, text_col, lang_col)
    ranges = int((shards.agg(F.sum("size")).first()[0] or 0) // range_words).bit_length()
    vocabulary = _vocabulary(shards, least, ranges)
    totals = vocabulary.where("shard IS NULL AND word IS NULL").groupBy("lang").agg(F.sum("total").alias("n"))
    dictionary = vocabulary.where("word IS NOT NULL")
    last, left = dictionary.agg(F.max("place"), F.sum("total")).first()
    shift = int(last or 0).bit_length()
    bits = max(1, ranges + shift)
    dictionary = dictionary.select("lang", "word", "total", F.col("place").bitwiseOR(F.shiftleft("range", shift)).alias("id"))
    kind = "<i4" if bits < 32 else "<i8"
    ids = _renumbered(shards, vocabulary, shift, kind)
    discard(shards)
    grams = None
    for m in range(2, longest + 1):
        if not left:
            break
        layout = Layout(m, bits)
        ranges = min(layout.lead, max(0, int(left // range_entries).bit_length()))
        counted = _count(ids, layout, kind, least, ranges)
        own = counted.where("gram IS NOT NULL").select("gram", "n")
        grams = own if grams is None else grams.union(own)
        left = own.agg(F.sum("n")).first()[0]
        if left and m < longest:
            ids, done = _kept(ids, counted, layout, kind, ranges), ids
            discard(done)
    found = dictionary.select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), F.col("total").alias("n"))
    if grams is not None:
        spelled = grams.select("gram", "n", F.posexplode("gram").alias("at", "id")).join(dictionary.select("id", "lang", "word"), "id")
        spelled = spelled.groupBy("gram", "n", "lang").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
        found = found.union(spelled.select("lang", F.size("gram"), F.array_join("w.word", " "), "n"))
    return materialize(found, "phrases"), totals


def mine_collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, cover: int = 100, most: int = 2000, text_col: str = "text", lang_col: str = "lang",
    shard_bytes: int = 16 << 20, range_words: int = 1 << 18, range_entries: int = RANGE,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` strongest phrases of 2 to ``longest`` words.

    A-Z are lower-cased; pieces end at ``[.,;:!?]`` and line ends, words at blanks and tabs. Candidates occur a >= ``least`` times. A
    cut into a first part (l times) and a rest (r times) scores floor(1000 * a * n / (l * r)), n being the language's words; the
    lowest-scoring cut counts, of equal ones that after fewer words. Candidates go that lie within a longer one of at least
    ``cover`` percent of their occurrences. Order: score, then a, descending, then phrase by UTF-8 bytes, so no tie is left open.

    A null language is ``und``; null, empty and blank texts add nothing; very long texts are taken whole; every row counts,
    repeated ones too; other columns are ignored, whatever their names; an empty table gives an empty result."""
    phrases, totals = count_phrases(docs, longest, least, text_col, lang_col, shard_bytes, range_words, range_entries)
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    counts = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"top": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "bottom": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))))
    within = candidates.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
