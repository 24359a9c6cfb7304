"""Merkle manifest of a dataset: every row is a leaf, each group of rows a tree, and the groups' roots a tree of their own.

Leaves are ranked within their group, and a rank's digits say which run of each level a leaf belongs to. Within a block of
``arity`` ** ``digits`` ranks the digit columns are grouped away one after another: the nodes of a run become an array of
structs inside their parent, so one shuffle by block gives a row that nests the block's whole tree. The blocks' roots are the
leaves of the next tier, until a group is one block. Going down again, nested transforms carry the siblings on the way from a
block's root to its leaves and one explode gives a row a leaf; a block's tree and the path above it meet in a grouped union, so
no step is a join and no row holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

STEPS = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields one after another: ``-`` for a null, else UTF-8 byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """(key, n, nth and the rows' other columns): each row's place among the n rows of its key, from 0.

    Equal rows are counted before they are dealt out, and unrolled once their places are known. Ranges of (key, order) go to a
    partition each; what is ordered over partitions is one row for each partition and key."""
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    rows = rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "merkle-ranges")
    parts = materialize(rows.groupBy("key", "part").agg(F.sum("copies").alias("rows")), "merkle-parts")
    whole = Window.partitionBy("key")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    parts = parts.select("key", "part", F.sum("rows").over(whole).alias("n"), before.alias("rows_before"))
    # a part's totals and its rows meet in one grouping, the totals first
    names = [c for c in rows.columns if c not in ("key", "part")]
    totals = parts.select("key", "part", "n", "rows_before", *[F.lit(None).cast(t).alias(c) for c, t in rows.select(*names).dtypes], F.lit(0).alias("own"))
    both = totals.unionByName(rows.select("*", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("rows_before"), F.lit(1).alias("own")))
    inside = Window.partitionBy("key", "part").orderBy("own", *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumns({
        "first": F.sum("rows_before").over(inside) + F.coalesce(F.sum("copies").over(inside) - F.col("copies"), F.lit(0)),
        "total": F.sum("n").over(inside),
    }).where("own = 1")
    kept = [c for c in names if c != "copies"]
    return placed.select("key", F.col("total").alias("n"), F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("nth"), *kept)


def _block(nodes: DataFrame, tier: int, arity: int, digits: int) -> DataFrame:
    """(key, n, block, hash, kids): the trees over nodes (key, n, nth, hash, own) of one tier. A level at which one node is left of
    a key is passed through unhashed."""
    size = arity**digits
    df = nodes.select(
        "key", "n", F.expr(f"nth div {size}").alias("block"),
        *[F.expr(f"nth div {arity ** j} % {arity}").cast("int").alias(f"d{j}") for j in range(digits)],
        "hash", "own",
    ).repartition("key", "block")
    inner = "own"
    for j in range(digits):
        left = [f"d{i}" for i in range(j + 1, digits)]
        run = F.sort_array(F.collect_list(F.struct(f"d{j}", "hash", F.col(inner).alias("kids"))))
        df = df.groupBy("key", "n", "block", *left).agg(run.alias("kids"))
        several = F.col("n") > arity ** (tier * digits + j)
        hashes = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        df = df.withColumn("hash", F.when(several, digest(hashes)).otherwise(F.col("kids")[0]["hash"]))
        inner = "kids"
    return df.select("key", "n", "block", "hash", "kids")


def _tiers(nodes: DataFrame, most: int, arity: int, digits: int) -> list[DataFrame]:
    """The blocks of each tier over nodes (key, n, nth, hash, own), the last with one block a key; most: the largest n."""
    tiers = []
    while not tiers or arity ** (digits * len(tiers)) < most:
        if tiers:
            own = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in nodes.select("own.*").dtypes if c != "nth"], F.col("block").alias("nth"))
            below = tiers[-1].select("key", "n", F.col("block").alias("nth"), "hash", own.alias("own"))
        else:
            below = nodes
        tiers.append(materialize(_block(below, len(tiers), arity, digits), "merkle-blocks"))
    return tiers


def _leaves(kids: Column, path: Column, n: Column, level: int, low: int, arity: int) -> Column:
    """Of the nodes ``kids`` and all below them down to level ``low``, the leaves (hash, own, steps)."""

    def of(kid: Column, i: Column) -> Column:
        side = lambda xs: F.array_join(F.transform(xs, lambda x: x["hash"]), "")
        step = F.struct(side(F.slice(kids, F.lit(1), i)).alias("before"), side(F.slice(kids, i + 2, F.lit(arity))).alias("after"))
        steps = F.concat(F.when(n > arity**level, F.array(step)).otherwise(F.array().cast(STEPS)), path)
        if level == low:
            return F.array(F.struct(kid["hash"].alias("hash"), kid["kids"].alias("own"), steps.alias("steps")))
        return _leaves(kid["kids"], steps, n, level - 1, low, arity)

    return F.flatten(F.transform(kids, of))


def _descend(tiers: list[DataFrame], paths: DataFrame, arity: int, digits: int) -> DataFrame:
    """(key, top, hash, own, steps) for each leaf of the lowest tier; paths: (key, steps, top) above each key's tree."""
    paths = paths.withColumn("block", F.lit(0).cast("bigint"))
    for tier in reversed(range(len(tiers))):
        tree = F.struct("n", "hash", "kids").alias("tree")
        here = tiers[tier].select("key", "block", tree)
        way = F.struct("steps", "top").alias("way")
        both = here.withColumn("way", F.lit(None).cast(paths.select(way).schema[0].dataType)).unionByName(
            paths.select("key", "block", F.lit(None).cast(here.schema["tree"].dataType).alias("tree"), way)
        )
        met = both.groupBy("key", "block").agg(F.first("tree", ignorenulls=True).alias("tree"), F.first("way", ignorenulls=True).alias("way"))
        top = F.col("way.top")
        if tier == len(tiers) - 1:  # the only block of its key: its root is the subroot
            top = top.withField("subroot", F.col("tree.hash"))
        low = tier * digits
        leaves = _leaves(F.col("tree.kids"), F.col("way.steps"), F.col("tree.n"), low + digits - 1, low, arity)
        paths = met.select("key", top.alias("top"), F.explode(leaves).alias("leaf")).select("key", "top", "leaf.*", F.col("leaf.own.nth").alias("block"))
        if tier:
            paths = materialize(paths.select("key", "block", "steps", "top"), "merkle-paths")
    return paths


def build_manifest(
    rows: DataFrame, leaf: Column, group: Column, id_: Column, carried: dict[str, Column] | None = None, arity: int = 2, digits: int = 8
) -> DataFrame:
    """(id, leaf, subroot, root, steps and the columns ``carried``) for each row.

    Within a group (null is one, and the first) leaves ascend by id, null ids first; of equal ids by leaf, then by what is
    carried. While several nodes of a group are left, each ``arity`` consecutive ones (of the last run, what there is) become the
    digest of their hashes; a lone leaf is its group's subroot. Subroots by group, as UTF-8 bytes, become the root likewise. steps
    are the hashes before and after the row's own node in each run that was hashed, from the leaf's up to the root's. Repeated
    rows are leaves of their own; other columns are ignored, whatever their names; an empty table gives an empty result."""
    carried = carried or {}
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))  # sorts null before any name
    flat = rows.select(key.alias("key"), id_.alias("id"), leaf.alias("hash"), *[c.alias(f"c_{k}") for k, c in carried.items()])
    names = [c for c in flat.columns if c != "key"]
    ranked = _ranked(flat, names)
    own = F.struct(*[c for c in names if c != "hash"], "nth")
    nodes = materialize(ranked.select("key", "n", "nth", "hash", own.alias("own")), "merkle-leaves")
    most = nodes.agg(F.max("n")).first()[0]
    tiers = _tiers(nodes, most or 0, arity, digits)
    subroots = _ranked(tiers[-1].select(F.lit("").alias("key"), F.col("key").alias("id"), "hash"), ["id"])
    tops = materialize(subroots.select("key", "n", "nth", "hash", F.struct("id", "nth").alias("own")), "merkle-subroots")
    over = _tiers(tops, tops.count(), arity, digits)
    none = F.array().cast(STEPS)
    start = over[-1].select("key", none.alias("steps"), F.struct(F.col("hash").alias("root"), F.lit("").alias("subroot")).alias("top"))
    groups = _descend(over, start, arity, digits)
    paths = materialize(groups.select(F.col("own.id").alias("key"), "steps", "top"), "merkle-groups")
    found = _descend(tiers, paths, arity, digits)
    return found.select(F.col("own.id").alias("id"), F.col("hash").alias("leaf"), "top.subroot", "top.root", "steps", *[F.col(f"own.c_{k}").alias(k) for k in carried])


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(steps, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def document_manifest(docs: DataFrame, tampered: Column | None = None, **options) -> DataFrame:
    """The manifest of documents (doc_id, source, lang, n_chars, text), a tree for each language; with ``tampered``, an expression
    that says in which rows n_chars is off by one, also the column ``tampered``: the leaf as it would then be. Nulls in any
    column have a hash of their own; a null n_chars stays null."""
    doc_id, chars = F.col("doc_id").cast("bigint"), F.col("n_chars").cast("bigint")
    leaf = lambda n: leaf_hash(doc_id, F.col("source"), F.col("lang"), n, F.col("text"))
    carried = {} if tampered is None else {"tampered": F.when(tampered, leaf(chars + 1)).otherwise(F.lit(None))}
    found = build_manifest(docs, leaf(chars), F.col("lang"), doc_id, carried, **options)
    if tampered is not None:
        found = found.withColumn("tampered", F.coalesce("tampered", "leaf"))
    return found.withColumnRenamed("id", "doc_id")


def verified_documents(docs: DataFrame, tampered: Column, **options) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, and whether its leaf, tampered with
    where ``tampered`` holds, still leads to the root."""
    found = document_manifest(docs, tampered, **options)
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    found = found.withColumn("folded_root", folded(F.col("tampered"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
