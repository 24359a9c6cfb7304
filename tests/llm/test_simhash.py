import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tapeworks.llm import simhash
from tapeworks.llm.components import connected_components


def slow_print(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def expected(rows, shingle=4, distance=4):
    prints = [(i, slow_print(t, shingle)) for i, t in rows]
    pairs = [(i, j) for i, f in prints for j, g in prints if i < j and (f ^ g).bit_count() <= distance]
    roots = union(pairs, [i for i, _ in prints])
    return {i: (f"{f:016x}", roots[i]) for i, f in prints}


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=4)) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 9, 60, 400]))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for _ in range(80):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((len(rows), rng.choice([" ", "\n", "\x0b\t"]).join(t)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE"), (905, "x" * 200_000), (906, "A b " * 30_000)]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == expected(rows)
    assert got[900] == got[901] == got[902] == ("0" * 16, 900)
    again = simhash.simhash_components(docs.repartition(5), cap=3).collect()  # every larger file goes through the parts
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in again} == got


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (None, "zz top of the morning to you")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_every_near_pair_shares_a_file_and_a_viable_chain():
    rng = np.random.default_rng(3)
    for distance in (0, 1, 3, 4, 7):
        ring = simhash.Ring(distance)
        for _ in range(400):
            a = int(rng.integers(0, 2**64, dtype=np.uint64))
            b = a
            for bit in rng.integers(0, 64, rng.integers(0, distance + 1)):
                b ^= 1 << int(bit)
            files = [f for f, mask in enumerate(ring.files) if a & mask == b & mask]
            x = np.array([a ^ b], np.uint64)
            assert any(ring.viable(x, ring.starts[f])[0] for f in files)


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7000, 7001), (7001, 7000)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)]
    table = spark.createDataFrame(edges, "u long, v long").repartition(7)
    for local in (0, 150, 1 << 16):  # by contraction alone, the last edges in one task, all of them
        check_components(edges, {r.node: r.root for r in connected_components(table, local).collect()})
    assert connected_components(table.limit(0)).count() == connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def check_components(edges, got):
    want = union([e for e in edges if e[0] != e[1]], {x for e in edges for x in e if e[0] != e[1]})
    assert set(got) == set(want)
    classes = {}
    for n, r in got.items():
        classes.setdefault(r, set()).add(want[n])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(want.values()))


def test_small_and_large_groups_give_the_same_components():
    rng = np.random.default_rng(6)
    for distance in (4, 8):
        ring = simhash.Ring(distance)
        centres = rng.integers(0, 2**64, (3, 1), np.uint64)
        rows = centres[rng.integers(0, 3, 60)]
        for r in rows:
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                r ^= np.uint64(1) << np.uint64(bit)
        rows = np.column_stack([np.arange(60, dtype=np.uint64), rows])
        for start in range(ring.m):
            us, vs = ring.forest(rows, start)
            slow = union([(int(a), int(b)) for u, v in zip(us, vs, strict=True) for a, b in zip(u, v, strict=True)], range(60))
            u, v = ring.small_groups(rows, np.full(60, 60), np.full(60, start), np.arange(60))
            assert len(u) < 60 and union(list(zip(u.tolist(), v.tolist(), strict=True)), range(60)) == slow
            pairs = [(i, j) for i in range(60) for j in range(i) if ring.linked(rows[i : i + 1, 1:], rows[j : j + 1, 1:], start)[0]]
            assert union(pairs, range(60)) == slow


def test_too_large_part_is_an_error_not_a_loss():
    rows = [pa.array([0] * 9, pa.int32()), pa.array([0] * 9, pa.int32()), pa.array([5] * 9), pa.array(range(9))]
    batches = [pa.record_batch(rows, ["file", "part", "key", "fp"])]
    out = list(simhash._scan(simhash.Ring(4), 8)(iter(batches)))
    assert out[-1].to_pylist() == [{"u": None, "v": None, "file": 0, "key": 5, "n": 9}]
    with pytest.raises(ValueError):
        list(simhash._scan(simhash.Ring(4), 8, again=False)(iter(batches)))


def skew_splits(df):
    """How many joins adaptive execution has split in the plan that has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


def test_joins_on_a_hot_fingerprint_are_split(spark):
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(30_000, numPartitions=12).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the same words' ELSE concat('word ', id) END AS text")
        assert skew_splits(simhash.simhash_components(docs)) >= 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
