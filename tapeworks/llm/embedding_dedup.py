"""Near-duplicate vectors by p-stable (Gaussian) hashing and exact cosines.

A unit vector x falls into bucket floor((a.x + b) / w) of each random projection; ``functions`` of them make one table's
key. The number of functions follows from the number of vectors, so that unrelated vectors fill a bucket with about FILL
whatever that number, and the number of tables from the wanted recall at the threshold. Equal vectors are one class with a
weight.

A row of a table is its key and a sketch: the signs of SKETCH further projections. Only rows that have another one in
their bucket whose sketch is near enough fetch their vectors; their cosines are taken block by block. A pair met in several
tables counts in the first only (the keys of earlier tables travel with a vector). Per vector and bucket one row comes
out: how much it is linked to, and a parent that keeps the bucket's links connected; never the pairs. Buckets of over
``cap`` vectors are cut into parts, and every pair of parts is one unit of work."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize

WIDTH = 2.0
BLOCK = 1024
FILL = 512
SKETCH = 128


def collision(distance: float, width: float = WIDTH) -> float:
    """The probability that one function puts two points of this distance into one bucket."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Functions a table, and tables: unrelated (orthogonal) vectors fill a bucket with about FILL of n, and a pair at the
    threshold shares some bucket with probability ``recall``."""
    functions = max(4, math.ceil(math.log(max(n, 1) / FILL) / -math.log(collision(math.sqrt(2)))))
    hit = collision(math.sqrt(2 - 2 * threshold)) ** functions
    return functions, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def sketches(units: np.ndarray, seed: int) -> np.ndarray:
    """Two 64-bit words of signs for each row."""
    a = np.random.default_rng([seed, units.shape[1], SKETCH]).standard_normal((units.shape[1], SKETCH))
    return np.packbits(units @ a > 0, axis=1).view(np.uint64)


def sketch_distance(threshold: float) -> int:
    """So many bits differ between the sketches of two vectors at the threshold, plus five and a half standard errors: one
    pair in 50 million is further apart."""
    share = math.acos(threshold) / math.pi
    return math.floor(SKETCH * share + 5.5 * math.sqrt(SKETCH * share * (1 - share)))


def table_keys(units: np.ndarray, functions: int, tables: int, seed: int) -> np.ndarray:
    """One 32-bit key a table for each row."""
    d = units.shape[1]
    rng = np.random.default_rng([seed, d])
    a, b = rng.standard_normal((d, functions * tables)), rng.uniform(0, WIDTH, functions * tables)
    mix = rng.integers(1, 2**63, functions, np.uint64) | np.uint64(1)
    slots = np.floor((units @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(units), tables, functions)
    h = (slots * mix).sum(axis=2, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose cosine, in double precision, is at least the threshold."""
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    cosines = (a / na[:, None]) @ (b / nb[:, None]).T
    i, j = np.nonzero(cosines >= threshold - 1e-9)
    edge = cosines[i, j] < threshold + 1e-9  # these are taken again from the vectors as given
    exact = np.einsum("ij,ij->i", a[i[edge]], b[j[edge]]) / (na[i[edge]] * nb[j[edge]])
    keep = np.ones(len(i), bool)
    keep[edge] = exact >= threshold
    return i[keep], j[keep]


def _near(words: np.ndarray, own: np.ndarray | None, distance: int) -> np.ndarray:
    """Which rows of a bucket have another one within so many bits; with ``own``, rows in it and rows out of it."""
    n, near = len(words), np.zeros(len(words), bool)
    left, right = (np.arange(n),) * 2 if own is None else (np.flatnonzero(own), np.flatnonzero(~own))
    for x in range(0, len(left), BLOCK):
        for y in range(x if own is None else 0, len(right), BLOCK):
            rows, columns = left[x : x + BLOCK], right[y : y + BLOCK]
            apart = np.bitwise_count(words[rows, None, 0] ^ words[None, columns, 0]) + np.bitwise_count(words[rows, None, 1] ^ words[None, columns, 1])
            hit = apart <= distance
            if own is None and x == y:
                np.fill_diagonal(hit, False)
            near[rows] |= hit.any(axis=1)
            near[columns] |= hit.any(axis=0)
    return near


def _bucket(vectors, keys, weights, own, table, threshold):
    """Linked weight and parent of each row of one bucket; with ``own``, of the pairs of rows in it and rows out of it."""
    n, across = len(vectors), own is not None
    linked, parent = np.zeros(n, np.int64), np.arange(n)
    left, right = (np.flatnonzero(own), np.flatnonzero(~own)) if across else (np.arange(n),) * 2
    for x in range(0, len(left), BLOCK):
        for y in range(0 if across else x, len(right), BLOCK):
            rows, columns = left[x : x + BLOCK], right[y : y + BLOCK]
            i, j = _links(vectors[rows], vectors[columns], threshold)
            i, j = rows[i], columns[j]
            if not across:
                i, j = i[i < j], j[i < j]
            if table:
                new = ~(keys[i] == keys[j]).any(axis=1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            linked += np.bincount(i, weights[j], n).astype(np.int64) + np.bincount(j, weights[i], n).astype(np.int64)
            while True:  # the smallest label goes along the links, then straight to the root
                before = parent.copy()
                low = np.minimum(parent[i], parent[j])
                np.minimum.at(parent, parent[i], low)
                np.minimum.at(parent, parent[j], low)
                parent = parent[parent]
                if (parent == before).all() and (parent[i] == parent[j]).all():
                    break
    return linked, parent


def _groups(batches: Iterator[pa.RecordBatch], tags: int, cap: int) -> Iterator[tuple[tuple[int, ...], int, pa.Table | None]]:
    """Runs of rows that are equal in the first columns, as (tag, rows, table); of a run of over ``cap`` rows, only how many."""
    head, held, size = None, [], 0
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(tags)]
        cuts = [0, *(np.flatnonzero(np.any([t[1:] != t[:-1] for t in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            tag = tuple(int(t[a]) for t in columns)
            if tag != head:
                if size > 1:
                    yield head, size, pa.Table.from_batches(held) if held else None
                head, held, size = tag, [], 0
            size += b - a
            held = [*held, batch.slice(a, b - a)] if size <= cap else []
    if size > 1:
        yield head, size, pa.Table.from_batches(held) if held else None


def link_vectors(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding",
    cap: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors of different
    lengths never link. Repeated rows are vectors of their own that link with one another (if valid). component_id is
    the smallest vec_id of the component; a null vec_id counts for nothing (alone: null, and kept is null). Labels and
    other columns are ignored; an empty table gives an empty result."""
    given = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    x = F.col("vector")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists(x, lambda v: v != 0)
    given = given.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # equal vectors have equal components, so -0.0 is taken as 0.0; 128 bits stand for a vector from here on
    same = F.transform(x, lambda v: v + F.lit(0.0))
    given = given.withColumns({"h1": F.xxhash64(same), "h2": F.xxhash64(F.lit(seed), same)})
    classes = given.where("fine").groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    functions, tables = plan(classes.count(), threshold, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == d))
                values = rows.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                # divided by a power of two (exactly), so that no square overflows or vanishes
                values = values / np.exp2(np.floor(np.log2(np.abs(values).max(axis=1, keepdims=True))))
                units = values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]
                keys = table_keys(units, functions, tables, seed)
                single = (values.astype(np.float32) == values).all(axis=1)  # half the bytes where nothing is lost
                packed = pa.array([(r.astype(np.float32) if f else r).tobytes() for r, f in zip(values, single, strict=True)], pa.binary())
                words = sketches(units, seed).view(np.int64)
                yield pa.record_batch(
                    [rows.column(1), rows.column(2), pa.array([int(d)] * len(keys), pa.int32()), packed, pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))],
                    ["class", "weight", "d", "packed", "s1", "s2", "keys", "tables"],
                )

    schema = "class bigint, weight bigint, d int, packed binary, s1 bigint, s2 bigint, keys binary, tables array<int>"
    files = materialize(classes.select("vector", "class", "weight").mapInArrow(keyed, schema), "vector-keys")
    filed = files.select("d", F.posexplode("tables").alias("table", "key"), "class", "s1", "s2")
    bucket, place, rest = ["d", "table", "key"], ["d", "table", "key", "part"], ["across", "own", "class"]
    near_bits = sketch_distance(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (d, table, key, part, across, own, class, s1, s2) sorted by the first four to those with a near one in their group."""
        for tag, _, group in _groups(batches, 4, 16 * cap):
            if group is None:
                raise ValueError(f"a part of a bucket holds over {16 * cap} vectors: {tag}")
            words = np.column_stack([group.column(x).to_numpy() for x in ("s1", "s2")]).view(np.uint64)
            own = group.column("own").to_numpy()
            near = group.filter(pa.array(_near(words, own == own[0] if group.column("across")[0].as_py() else None, near_bits)))
            yield from near.select([*place, *rest]).combine_chunks().to_batches()

    # counts are added up before the shuffle; few buckets are large
    large = filed.groupBy(*bucket).count().where(F.col("count") > cap)
    large = materialize(large.select(*bucket, F.ceil(F.col("count") * 2 / cap).cast("int").alias("parts")), "vector-large")
    rows = filed.join(large, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.withColumn("part", F.least("own", "other").cast("bigint") * F.col("parts") + F.greatest("own", "other"))
    rows = rows.select(*place, (F.col("own") != F.col("other")).alias("across"), "own", "class", "s1", "s2")
    dealt = rows.repartition(*place).sortWithinPartitions(*place)
    near = dealt.mapInArrow(compare, "d int, table int, key int, part bigint, across boolean, own int, class bigint")
    near = materialize(near, "vector-near")
    # keys of earlier tables: four bytes each
    rows = near.join(files.select("class", "weight", "packed", "keys"), "class")
    rows = rows.select(*place, *rest, "weight", "packed", F.expr("substring(keys, 1, 4 * table)").alias("earlier"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tag, n, group in _groups(batches, 4, 1 << 62):
            d, table = tag[:2]
            packed = group.column("packed").to_pylist()
            values = np.array([np.frombuffer(x, np.float32 if len(x) == 4 * d else np.float64) for x in packed], np.float64)
            keys = np.frombuffer(b"".join(group.column("earlier").to_pylist()), np.int32).reshape(n, -1) if table else None
            own = group.column("own").to_numpy()
            weights, ids = group.column("weight").to_numpy(), group.column("class").to_numpy()
            across = group.column("across")[0].as_py()
            linked, parent = _bucket(values, keys, weights.astype(np.float64), own == own[0] if across else None, table, threshold)
            some = np.flatnonzero(linked)
            if len(some):
                yield pa.record_batch([pa.array(ids[some]), pa.array(linked[some]), pa.array(ids[parent[some]])], ["class", "linked", "parent"])

    dealt = rows.repartition(*place).sortWithinPartitions(*place)
    links = materialize(dealt.mapInArrow(link, "class bigint, linked bigint, parent bigint"), "vector-links")
    counts = links.groupBy("class").agg(F.sum("linked").alias("linked"))
    roots = connected_components(links.select(F.col("class").alias("u"), F.col("parent").alias("v")))
    roots = materialize(roots, "vector-roots")
    joined = materialize(classes.select("class", "least").join(roots.withColumnRenamed("node", "class"), "class"), "vector-rooted")
    # written before it is joined on its own key, so that a join with a giant component can be split
    least = materialize(joined.groupBy("root").agg(F.min("least").alias("component")), "vector-least")
    linked = joined.join(least, "root").select("class", "component")
    known = classes.join(counts, "class", "left").join(linked, "class", "left")
    known = materialize(known.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "least").alias("component")), "vector-known")
    out = given.where("fine").select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n", "component")
    out = out.union(given.where("NOT fine").select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
