"""SimHash near-duplicate components with pigeonring candidate filtering.

Fingerprints of 64 bits lie on a ring of ``m = max_distance + 1`` segments. If two of them differ in at most ``k`` bits,
some segment starts a chain in which the first l segments differ in at most floor(l * k / m) bits together, for every
l up to m. The first segment of such a chain is equal, the first two differ in at most one bit: so each fingerprint
is filed under (start, segment, next segment without one of its bits), and two fingerprints of such a chain share at
least one file. Within a file longer chains prune the candidates before the full Hamming distance is taken.

Texts of one fingerprint are one node. Within a file the links are walked breadth-first from unvisited fingerprints, so
a dense file of n fingerprints gives at most n - 1 links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_forest
from .shared import binaries, materialize, row_slices

BYTE_ONES = np.uint64(0x0101010101010101)
SMALL = 64
#: Least hashes: so many bands of so many each, and of the first SKETCH a low byte.
BANDS, BAND, SKETCH = 24, 5, 64
PREFIX = ["root", "part", "node", "comp", "small", "shingle", "n", "filed"]
_PREFIX_SCHEMA = "root bigint, part int, node bigint, comp bigint, small boolean, shingle bigint, n int, filed boolean"
MARKS = ["k", *[f"s{i}" for i in range(SKETCH // 8)]]


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The SimHash of a text's UTF-8 bytes: A-Z lower-cased, words between ASCII white space, XXH64 (seed 42) of
    space-joined shingles. Fewer words: one shingle of all; no word (or null): 0."""
    return _simhash(shingle_hashes(text, shingle))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def _simhash(h: np.ndarray) -> int:
    n, value = len(h), 0
    if not n:
        return 0
    cuts = np.arange(0, n, 255)
    for bit in range(8):  # eight counters a word, added without carries in blocks of 255
        sums = np.add.reduceat((h >> np.uint64(bit)) & BYTE_ONES, cuts)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            value |= int(2 * counts[byte] > n) << (8 * byte + bit)
    return value


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fp as signed long) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            values = np.array([fingerprint(x, shingle) for x in binaries(batch.column(1))], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, fp bigint")


class Ring:
    """The segments for one distance: masks of the chains by start and length, and the files' masks."""

    def __init__(self, distance: int):
        self.m = distance + 1
        cuts = [64 * i // self.m for i in range(self.m + 1)]
        segments = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        chain = lambda i, n: sum(segments[(i + j) % self.m] for j in range(n))
        self.files, self.starts = [], []
        for i in range(self.m):
            after = segments[(i + 1) % self.m] if self.m > 1 else 0
            free = [1 << b for b in range(64) if after >> b & 1 and distance > 0] or [0]
            self.files += [(chain(i, min(2, self.m)) & ~bit) for bit in free]
            self.starts += [i] * len(free)
        # chains of more than two segments with what they may differ in: masks by length and start, budgets by length
        longer = range(3, self.m)
        self.masks = np.array([[chain(i, n) for i in range(self.m)] for n in longer] + [[2**64 - 1] * self.m], np.uint64)
        self.budgets = [n * distance // self.m for n in longer] + [distance]

    def key(self, fp: Column, file: Column) -> Column:
        """What a file is sorted by: the fingerprint's bits in its mask."""
        signed = [x - (1 << 64) if x >> 63 else x for x in self.files]
        masks = F.array(*[F.lit(x).cast("bigint") for x in signed])
        return fp.bitwiseAND(F.get(masks, file))

    def viable(self, x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Which of the differences x are within every chain's budget, given where each one's chain starts: each longer chain
        is tried on what is left, the full distance last."""
        left = np.arange(len(x))
        for masks, most in zip(self.masks, self.budgets, strict=True):
            mask = masks[start] if np.ndim(start) == 0 else masks[start[left]]
            left = left[np.bitwise_count(x[left] & mask) <= most]
        ok = np.zeros(len(x), bool)
        ok[left] = True
        return ok

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Which rows of a and b (one column, the fingerprint) are linked."""
        return self.viable(a[:, 0] ^ b[:, 0], start)

    def small_groups(self, rows: np.ndarray, ends: np.ndarray, starts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of many groups of at most SMALL rows at once: every row is compared with the one so many places behind it,
        for all distances within a group. ends: where each row's group ends; active: the rows of such groups."""
        left, right = [], []
        for step in range(1, SMALL):
            active = active[active + step < ends[active]]
            if not len(active):
                break
            hit = active[self.linked(rows[active, 1:], rows[active + step, 1:], starts[active])]
            left.append(hit)
            right.append(hit + step)
        if not left:
            return rows[:0, 0], rows[:0, 0]
        parent = local_forest(len(rows), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(parent != np.arange(len(rows)))
        return rows[moved, 0], rows[parent[moved], 0]

    def forest(self, rows: np.ndarray, start: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Links that join the nodes of a file as all its links do; rows: a node, its fingerprint, the other words."""
        us, vs, rest = [], [], np.arange(len(rows))
        while rest.size > 1:
            front, rest = [int(rest[0])], rest[1:]
            while front and rest.size:
                p = front.pop()
                ok = self.linked(rows[p : p + 1, 1:], rows[rest, 1:], start)
                if ok.any():
                    hit, rest = rest[ok], rest[~ok]
                    us.append(np.full(len(hit), rows[p, 0]))
                    vs.append(rows[hit, 0])
                    front += hit.tolist()
        return us, vs


def _scan(ring: Ring, cap: int, again: bool = True):
    """Walks rows (file, part, key, fp[, other words]) sorted by the first three; gives links (u, v), or (file, key, n) of a group
    of n > ``cap`` fingerprints, of which no more than that are held; without ``again`` such a group is an error. With other
    words the first one is the node and only the others are compared; a fingerprint alone is its own node."""
    names = ["u", "v", "file", "key", "n"]

    def links(us, vs):
        u = np.concatenate(us).view(np.int64) if us else np.zeros(0, np.int64)
        v = np.concatenate(vs).view(np.int64) if vs else np.zeros(0, np.int64)
        none = pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64())
        return pa.record_batch([pa.array(u), pa.array(v), *none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, size, spilled, places = None, [], 0, [], np.array(ring.starts)

        def close():
            if head is not None and size > cap:
                spilled.append((head[0], head[2], size))
            elif size > 1:
                return ring.forest(np.concatenate(held), ring.starts[head[0]])
            return [], []

        for batch in batches:
            file, part, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(file):
                continue
            words = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3, batch.num_columns)]
            fp = np.column_stack(words)
            if fp.shape[1] == 1:
                fp = np.column_stack([fp, fp])
            new = np.flatnonzero((file[1:] != file[:-1]) | (part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = np.concatenate(([0], new, [len(fp)]))
            us, vs = [], []
            first = (int(file[0]), int(part[0]), int(key[0]))
            if first != head:
                for mine, more in zip((us, vs), close(), strict=True):
                    mine += more
                head, held, size = first, [], 0
            size += int(cuts[1])
            if size <= cap:
                held.append(fp[: cuts[1]].copy())
            else:
                held = []
            if len(cuts) > 2:
                for mine, more in zip((us, vs), close(), strict=True):
                    mine += more
                lengths = np.diff(cuts)
                inner = np.arange(1, len(lengths) - 1)
                few = np.repeat((lengths > 1) & (lengths <= SMALL), lengths)
                few[: cuts[1]] = few[cuts[-2] :] = False  # the first and the last group may go on in other batches
                u, v = ring.small_groups(fp, np.repeat(cuts[1:], lengths), places[file], np.flatnonzero(few))
                us, vs = [*us, u], [*vs, v]
                for i in inner[lengths[inner] > SMALL].tolist():
                    a, b = int(cuts[i]), int(cuts[i + 1])
                    if b - a > cap:
                        spilled.append((int(file[a]), int(key[a]), b - a))
                        continue
                    u, v = ring.forest(fp[a:b], ring.starts[int(file[a])])
                    us, vs = us + u, vs + v
                a = int(cuts[-2])
                head, held, size = (int(file[a]), int(part[a]), int(key[a])), [fp[a:].copy()], len(fp) - a
                if size > cap:
                    held = []
            if us:
                yield links(us, vs)
            if spilled and not again:
                raise ValueError(f"a part of a file holds over {cap} fingerprints: {spilled[0]}")
        yield links(*close())
        if spilled and not again:
            raise ValueError(f"a part of a file holds over {cap} fingerprints: {spilled[0]}")
        if spilled:
            none = pa.nulls(len(spilled), pa.int64())
            files, keys, sizes = zip(*spilled, strict=True)
            yield pa.record_batch([none, none, pa.array(files, pa.int32()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names)

    return run


def fingerprint_links(fps: DataFrame, distance: int, cap: int = 16384) -> DataFrame:
    """Links (u, v) among distinct fingerprints (column fp) that join exactly those within ``distance`` bits, directly or
    through others. A file of more than ``cap`` fingerprints is cut into parts of about cap / 2 by hash, and each pair of parts
    is walked on its own: a task holds about ``cap`` fingerprints of a file, and a pair of over 16 times that fails the job."""
    ring = Ring(distance)
    filed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(ring.files) - 1))).alias("file"))
    return _filed_links(filed, ring.key(F.col("fp"), F.col("file")), ["fp"], ring, cap)


def _filed_links(filed: DataFrame, key: Column, carried: list[str], ring: Ring, cap: int) -> DataFrame:
    """Links of rows (file, the columns ``carried``) of equal file and key."""
    schema = "u bigint, v bigint, file int, key bigint, n bigint"
    # keys follow from fingerprint and file, so they are not shuffled but worked out on both sides
    dealt = filed.repartition("file", key).select("file", F.lit(0).alias("part"), key.alias("key"), *carried)
    dealt = dealt.sortWithinPartitions("file", "part", "key")
    found = materialize(dealt.mapInArrow(_scan(ring, cap), schema), "simhash-links")
    links = found.where("u IS NOT NULL").select("u", "v")
    large = found.where("file IS NOT NULL").select("file", "key", F.ceil(F.col("n") * 2 / cap).cast("int").alias("parts"))
    if large.limit(1).count():
        cut = filed.withColumn("key", key).join(large, ["file", "key"])
        cut = cut.withColumn("own", F.pmod(F.xxhash64(carried[-1], carried[0], F.lit("part")), "parts").cast("int"))
        other = F.explode(F.expr("sequence(0, parts - 1)"))
        cut = cut.select("file", "key", *carried, "parts", "own", other.alias("other"))
        pair = F.least("own", "other").cast("bigint") * F.col("parts") + F.greatest("own", "other")
        cut = cut.select("file", pair.alias("part"), "key", *carried)
        dealt = cut.repartition("file", "part", "key").sortWithinPartitions("file", "part", "key")
        more = dealt.mapInArrow(_scan(ring, 16 * cap, again=False), schema)
        links = links.union(more.select("u", "v"))
    return links


def print_components(prints: DataFrame, distance: int, cap: int = 16384) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of rows (doc_id, fp): its component's least id.

    What is grouped by a key is written before it is joined on that key: a join of two plain shuffles is one that adaptive
    execution can split where a fingerprint or a component is hot."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp"), distance, cap))
    joined = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "simhash-roots")
    whole = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    linked = joined.join(whole, "root").select("fp", "component_id")
    known = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return materialize(known, "simhash-components")


def simhash_components(
    docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", cap: int = 16384
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null, empty and word-less texts have fingerprint zero and are linked like any other; very long texts are taken whole, one
    at a time. Repeated rows come out as often as they go in. component_id is the smallest doc_id of the component, so no
    tie is left to chance; it is null only where all its ids are null. Other columns are ignored, whatever their names. An
    empty table gives an empty result."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    return prints.join(print_components(prints, distance, cap), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def least_hashes(h: np.ndarray) -> np.ndarray:
    """For each of BANDS * BAND hash functions its least value over a set of shingles."""
    out = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 1024):
        x = (h[None, at : at + 1024] ^ _TURNS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        np.minimum(out, x.min(axis=1), out=out)
    return out


_TURNS = np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_TURNS = (_TURNS ^ (_TURNS >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
_TURNS ^= _TURNS >> np.uint64(27)


def marks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of shingles: its hash and its sketch as MARKS, and the keys of its bands."""
    low = least_hashes(h)
    keys = np.zeros(BANDS, np.uint64)
    for i in range(BAND):
        keys = (keys ^ (keys >> np.uint64(31)) ^ low[i::BAND]) * np.uint64(0x9E3779B97F4A7C15)
    sketch = (low[:SKETCH] >> np.uint64(24)).astype(np.uint8).view(np.uint64)
    return np.concatenate(([np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42))], sketch)), keys


class Bands(Ring):
    """The bands as files: two sets of one band are candidates if sketches say that they may reach the similarity."""

    def __init__(self, similarity: float):
        self.starts = [0] * BANDS
        spread = (similarity * (1 - similarity) / SKETCH) ** 0.5
        self.least = int(SKETCH * (similarity - 5 * spread))  # five standard errors below

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        same = (a[:, 1:] ^ b[:, 1:]).view(np.uint8) == 0
        return same.sum(axis=1) >= self.least


def similarities(mine: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of a set with others (sorted, none empty)."""
    other, whole = np.array([len(x) for x in sets]), np.concatenate(sets)
    found = mine[np.minimum(np.searchsorted(mine, whole), len(mine) - 1)] == whole
    both = np.add.reduceat(found, np.cumsum(other) - other, dtype=np.int64)
    return both / (len(mine) + other - both)


def similar_forest(nodes: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join sets (sorted, none empty) as all pairs do whose Jaccard similarity is at least ``similarity``."""
    bands, sizes = Bands(similarity), np.array([len(x) for x in sets])
    us, vs, rest = [], [], np.arange(len(sets))
    while rest.size > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and rest.size:
            p = front.pop()
            mine = sets[p]
            may = np.minimum(sizes[rest], len(mine)) / np.maximum(sizes[rest], len(mine)) >= similarity
            may &= bands.linked(sketches[p : p + 1], sketches[rest], 0)
            at = np.flatnonzero(may)
            if not at.size:
                continue
            at = at[similarities(mine, [sets[i] for i in rest[at]]) >= similarity]
            if at.size:
                hit, rest = rest[at], np.delete(rest, at)
                us.append(np.full(len(hit), nodes[p]))
                vs.append(nodes[hit])
                front += hit.tolist()
    return us, vs


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """How many of a set's n shingles, in an order common to all sets, must be looked up and how many filed, so that of two sets
    of the similarity the larger one looks a shingle up under which the smaller one is filed."""
    least = lambda share: int(np.ceil(share * n - 1e-9))
    return n - least(similarity) + 1, n - least(2 * similarity / (1 + similarity)) + 1


def common_shingles(sets: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """Shingles that a tenth of the sets have, the most frequent last (of equal ones, the larger); ``most`` bounds the list."""
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    often = np.flatnonzero(n >= max(2, len(sets) / 10))
    return found[often[np.argsort(n[often], kind="stable")][-most:]]


def keep_one_of_similar(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", cap: int = 16384, unit: int = 128,
    distance: int = 4,
) -> DataFrame:
    """One row, with all its columns, of each component of texts linked by a Jaccard similarity of at least ``similarity`` of
    their sets of shingles: that of the smallest id (of equal or null ids, any one, always the same); of equal rows, one.

    Texts are candidates whose fingerprints are joined by links of at most ``distance`` bits (``print_components``, as in
    ``simhash_components``). Fingerprints of similar texts may lie further apart, so texts are candidates, too, that share all
    BAND least hashes of one of BANDS bands: at a similarity of 0.8 all but 7 in 100,000 pairs do, above it more, and a sketch
    of SKETCH bytes drops those five standard errors below the similarity. Every link that counts is an exact one: texts that
    candidates join are a group, brought together and their sets compared.

    A group of over ``unit`` texts is dealt into parts. Each part is compared in itself and with one text of the group that goes
    to all parts, which joins most of a group of near copies. Texts outside the group's largest component so far then visit
    other parts, but only those where prefix filtering finds a partner: shingles are ordered by how common they are in the
    group, the rarest first, and two similar sets of other components must share one of their first few. Templated pages, alike
    in what all of them have, share none of those and visit nothing.

    Null, empty and word-less texts have no shingle and are equal; very long texts are taken whole. Other columns pass
    through, whatever their names. An empty table gives an empty result."""
    columns, none = docs.columns, F.lit(2**63 - 1)
    id_ = F.coalesce(F.col(id_col).cast("bigint"), none)
    mark = F.xxhash64(id_, F.col(text_col))
    bands = Bands(similarity)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            hashes = [shingle_hashes(x, shingle) for x in binaries(batch.column(2))]
            found = [marks(np.unique(h)) for h in hashes]
            fps = pa.array(np.array([_simhash(h) for h in hashes], np.uint64).view(np.int64))
            words = np.array([x for x, _ in found], np.uint64).reshape(-1, len(MARKS))
            keys = pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))
            longs = [pa.array(words[:, i].copy().view(np.int64)) for i in range(len(MARKS))]
            yield pa.record_batch([batch.column(0), batch.column(1), fps, *longs, keys], ["id", "mark", "fp", *MARKS, "bands"])

    def rows_of(batch: pa.RecordBatch, first: int):
        """Rows (..., text, words of the marks); first: the place of the first of those words."""
        words = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(first, first + len(MARKS))])
        return zip(*[batch.column(i).to_pylist() for i in range(first - 1)], binaries(batch.column(first - 1)), words, strict=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each part, and of each group's first part the common shingles."""
        head, held = None, {}

        def close():
            nodes, got = np.array(list(held), np.int64), list(held.values())
            sets = [h for _, h in got]
            us, vs = similar_forest(nodes, np.array([x for x, _ in got], np.uint64).reshape(-1, len(MARKS)), sets, similarity)
            u, v = (np.concatenate(x) if x else nodes[:0] for x in (us, vs))
            spare = 0 if head[1] else 1
            common = [common_shingles(sets).view(np.int64)] * spare
            columns = [pa.array([*x, *[None] * spare], pa.int64()) for x in (u.tolist(), v.tolist())]
            columns += [pa.array([None] * len(u) + [head[0]] * spare, pa.int64()), pa.array([None] * len(u) + common, pa.list_(pa.int64()))]
            return pa.record_batch(columns, ["u", "v", "root", "common"])

        for batch in row_slices(batches):
            for root, part, node, text, own in rows_of(batch, 4):
                if (root, part) != head:
                    if len(held) > 1:
                        yield close()
                    head, held = (root, part), {}
                if node not in held:  # equal rows give it again
                    held[node] = own.copy(), shingle_set(text, shingle)
        if len(held) > 1:
            yield close()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (root, part, node, comp, small, common, text) -> a row for each shingle looked up, and whether it is filed."""
        for batch in row_slices(batches):
            for i, text in enumerate(binaries(batch.column(6))):
                h, common = shingle_set(text, shingle), batch.column(5)[i].values
                rank = np.zeros(len(h), np.int64)
                if common is not None and len(common):
                    known = common.to_numpy(zero_copy_only=False).view(np.uint64)
                    order = np.argsort(known)
                    at = np.minimum(np.searchsorted(known[order], h), len(known) - 1)
                    rank = np.where(known[order][at] == h, order[at] + 1, 0)
                looked, filed = prefix_sizes(len(h), similarity)
                first = h[np.lexsort((h, rank))[:looked]]
                n = len(first)
                same = [pa.array([batch.column(k)[i].as_py()] * n, batch.column(k).type) for k in range(5)]
                yield pa.record_batch([*same, pa.array(first.view(np.int64)), pa.array([len(h)] * n, pa.int32()), pa.array(np.arange(n) < filed)], PREFIX)

    def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (root, part, guest, comp, node, text, marks): a part's own texts come first and are held, then its visitors come by,
        one at a time."""
        head, nodes, comps, sketches, sets, seen = None, [], [], [], [], set()
        for batch in row_slices(batches):
            us, vs = [], []
            for root, part, guest, comp, node, text, own in rows_of(batch, 6):
                if (root, part) != head:
                    head, nodes, comps, sketches, sets, seen = (root, part), [], [], [], [], set()
                if node in seen:
                    continue
                seen.add(node)
                mine = shingle_set(text, shingle)
                if not guest:
                    nodes.append(node), comps.append(comp), sketches.append(own.copy()), sets.append(mine)
                    continue
                at = np.flatnonzero(np.array(comps) != comp)
                if len(at):
                    at = at[bands.linked(own[None, :], np.array(sketches)[at], 0)]
                if len(at):
                    hit = at[similarities(mine, [sets[i] for i in at]) >= similarity]
                    us += [node] * len(hit)
                    vs += [nodes[i] for i in hit]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (us, vs)], ["u", "v"])

    source = docs.select(id_.alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    schema = "id bigint, mark bigint, fp bigint, " + ", ".join(f"{w} bigint" for w in MARKS) + ", bands array<bigint>"
    nodes = source.mapInArrow(prints, schema).groupBy(*MARKS).agg(F.min(F.struct("id", "mark", "fp")).alias("lead"), F.first("bands").alias("bands"))
    # a node is numbered as it is written: all its marks tell it from others, not one hash
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "lead.*", *MARKS, "bands"), "simhash-nodes")
    filed = nodes.select("node", *MARKS, F.posexplode("bands").alias("file", "key"))
    known = print_components(nodes.select(F.col("node").alias("doc_id"), "fp"), distance, cap).withColumnRenamed("component_id", "v")
    known = nodes.select(F.col("node").alias("u"), "fp").join(known, "fp").where("u <> v").select("u", "v")
    near = connected_components(known.union(_filed_links(filed, F.col("key"), ["node", *MARKS], bands, cap)))
    near = materialize(nodes.drop("bands", "fp").join(near, "node"), "simhash-candidates")
    large = near.groupBy("root").agg(F.ceil(F.count("*") / unit).cast("int").alias("parts"), F.min("node").alias("pivot"))
    large = materialize(large.where("parts > 1"), "simhash-large")
    near = near.join(large, "root", "left").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int"))
    place = ["root", "part"]
    texts = source.join(near, ["id", "mark"]).select(*place, "node", "text", *MARKS, "parts", "pivot")
    texts = materialize(texts, "simhash-texts")  # of equal rows, one text would do; the readers skip the others
    every = F.explode(F.expr("sequence(0, parts - 1)"))
    pivots = texts.where("node = pivot").withColumn("to", every).where("to <> part").drop("part").withColumnRenamed("to", "part")
    dealt = texts.unionByName(pivots).select(*place, "node", "text", *MARKS).repartition(*place).sortWithinPartitions(*place)
    compared = materialize(dealt.mapInArrow(compare, "u bigint, v bigint, root bigint, common array<bigint>"), "simhash-similar")
    links = compared.where("u IS NOT NULL").select("u", "v")
    if large.limit(1).count():
        found = connected_components(links).withColumnRenamed("root", "comp")
        members = texts.where("parts > 1").select(*place, "node").distinct().join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        members = materialize(members, "simhash-members")
        main = members.groupBy("root", "comp").count().groupBy("root").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        members = members.join(materialize(main, "simhash-main"), "root").withColumn("small", F.col("comp") != F.col("main")).drop("main")
        members = materialize(members, "simhash-members")
        open_ = materialize(members.where("small").select("root").distinct(), "simhash-open")
        known = compared.where("root IS NOT NULL").select("root", "common")
        wanted = members.join(open_, "root").join(known, "root", "left").join(texts.where("parts > 1").select("node", "text"), "node")
        rows = wanted.select(*place, "node", "comp", "small", "common", "text").mapInArrow(prefixes, _PREFIX_SCHEMA)
        rows = materialize(rows, "simhash-prefixes")
        guests = rows.where("small").select("root", "shingle", *[F.col(c).alias(f"g_{c}") for c in ("part", "node", "comp", "n", "filed")])
        # a part is one row for each of its shingles, however many of its texts have it: a visitor goes to parts, not to texts
        filed = F.when(F.col("filed"), F.col("n"))
        hosts = rows.groupBy("root", "shingle", "part").agg(
            F.min("comp").alias("first"), F.max("comp").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"), F.min(filed).alias("f_low"), F.max(filed).alias("f_high")
        )
        mine = F.col("g_n")
        below = F.coalesce((F.col("f_low") <= mine) & (F.col("f_high") + 1e-6 >= similarity * mine), F.lit(False))
        above = F.col("g_filed") & (F.col("high") >= mine) & (mine + 1e-6 >= similarity * F.col("low"))
        others = (F.col("first") != F.col("g_comp")) | (F.col("last") != F.col("g_comp"))
        visits = guests.join(hosts, ["root", "shingle"]).where((F.col("g_part") != F.col("part")) & others & (below | above))
        visits = visits.select("root", "part", F.col("g_node").alias("node"))
        visits = materialize(visits.distinct(), "simhash-visits")
        whole = texts.select("root", F.col("part").alias("home"), "node", "text", *MARKS).join(members.select("node", "comp"), "node")
        hosts = whole.withColumnRenamed("home", "part").join(visits.select(*place).distinct(), place).withColumn("guest", F.lit(False))
        come = whole.drop("root", "home").join(visits, "node").withColumn("guest", F.lit(True))
        met = hosts.unionByName(come).select(*place, "guest", "comp", "node", "text", *MARKS)
        met = met.repartition(*place).sortWithinPartitions(*place, "guest")
        links = links.union(met.mapInArrow(bridge, "u bigint, v bigint"))
    roots = nodes.select("node", "id", "mark").join(connected_components(links), "node", "left")
    leads = roots.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "mark")).alias("lead")).select("lead.*")
    copies = materialize(source.groupBy("id", "mark").agg(F.count("*").alias("copies")).where("copies > 1"), "simhash-copies")
    leads = materialize(leads.join(copies, ["id", "mark"], "left"), "simhash-leads")
    rows = docs.select(id_.alias("id"), mark.alias("mark"), F.struct(*[F.col(c) for c in columns]).alias("row"))
    one = rows.join(leads.where("copies IS NULL"), ["id", "mark"]).select("row")
    if copies.limit(1).count():  # rows of equal id and text are left to choose from; they are written first, then reduced in each task
        several = materialize(leads.where("copies IS NOT NULL").select("id", "mark"), "simhash-several")
        equal = materialize(rows.join(several, ["id", "mark"]), "simhash-equal").groupBy("id", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        one = one.union(equal.select("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in columns])
