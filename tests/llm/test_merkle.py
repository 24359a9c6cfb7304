import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hash int, steps int"


def bad():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    fields = [doc_id, source, lang, None if n is None else n + more, text]
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def way(levels, i, arity):
    for level in levels[:-1]:
        a = i - i % arity
        yield "".join(level[a:i]), "".join(level[i + 1 : a + arity])
        i //= arity


def expected(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], arity)
    top, out = tree([trees[g][-1][0] for g in names], arity), []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = [*way(trees[g], i, arity), *way(top, k, arity)]
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in steps:
                node = digest(before + node + after)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], digest("".join(b + a for b, a in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    langs = [None, "", "a", "é", "zz", "one"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "t", "é" * 9, "🙂"]), langs[i % 5], rng.choice([None, "s"]), rng.choice([None, 0, 5])) for i in range(300)]
    return [*rows, *[rows[3]] * 40, (7, "x", "one", "s", 1), (1000, "long " * 100_000, "a", "s", -3)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 3, 4) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("arity", "digits"), [(2, 8), (2, 2), (3, 2), (4, 1)])
def test_manifest_matches_brute_force(spark, arity, digits):
    rows = corpus()
    got = merkle.verified_documents(frame(spark, rows), bad(), arity=arity, digits=digits)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, arity)


def test_one_row_no_row_and_plain_manifest(spark):
    rows = [(5, None, None, None, None)]
    assert [tuple(r) for r in merkle.verified_documents(frame(spark, rows), bad()).collect()] == expected(rows)
    assert merkle.verified_documents(frame(spark, rows).limit(0), bad()).count() == 0
    rows = corpus(4)
    got = merkle.document_manifest(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "steps"]
    assert got.where(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    assert got.where(merkle.folded(F.lit("0" * 64), F.col("steps")) == F.col("root")).count() == 0


def test_no_join_carries_the_proofs(spark):
    plan = merkle.document_manifest(frame(spark, corpus()))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate explode" in plan
