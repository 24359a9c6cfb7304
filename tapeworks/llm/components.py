"""Connected components of a distributed edge list by randomised contraction.

Each round renumbers the nodes with a bijective mixing function, lets every node join the smallest neighbour (or itself),
and contracts the edges to the chosen labels. A constant share of the labels goes in each round in expectation, so the
number of rounds is logarithmic whatever the shape of the graph (long chains and stars alike). All work is grouped
minimum (pre-aggregated before the shuffle) and equi-joins. Once no more than LOCAL edges are left, whatever there were at
first, one task joins those: a megabyte, and the answer is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


LOCAL = 1 << 16


def _mix(node: Column, turn: int) -> Column:
    """A permutation of the 64-bit integers, another one for each turn (xor-shifts only, so nothing overflows)."""
    salt = (0x9E3779B97F4A7C15 * (2 * turn + 1)) % (1 << 64)
    node = node.bitwiseXOR(F.lit(salt - (1 << 64) if salt >> 63 else salt).cast("bigint"))
    node = node.bitwiseXOR(F.shiftleft(node, 13))
    node = node.bitwiseXOR(F.shiftrightunsigned(node, 7))
    return node.bitwiseXOR(F.shiftleft(node, 17))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> (node, label): the least node of each one's component."""
    parts = [np.column_stack([b.column(i).to_numpy() for i in range(2)]) for b in batches if b.num_rows]
    if parts:
        nodes, place = np.unique(np.concatenate(parts), return_inverse=True)
        place = place.reshape(-1, 2)
        least = local_forest(len(nodes), place[:, 0], place[:, 1])
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[least])], ["node", "label"])


def connected_components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(u, v) long edges -> (node, root): one row for each node with an edge to another node; nodes of one component,
    and only those, have equal roots. The root is a label, not a node. Self-loops, repeated edges, both directions and
    edges with a null end are allowed and add nothing; an empty edge list gives an empty result."""
    links = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links, turns = materialize(links, "links"), []
    while n := links.count():
        if n <= local:
            turns.append(materialize(links.coalesce(1).mapInArrow(_in_one_task, "node bigint, label bigint"), "labels"))
            break
        was, both = links, links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = _mix(F.col("v"), len(turns))
        chosen = both.groupBy(F.col("u").alias("node")).agg(F.min(to).alias("near"))
        chosen = chosen.select("node", F.least("near", _mix(F.col("node"), len(turns))).alias("label"))
        turns.append(materialize(chosen, "labels"))
        left = turns[-1].select(F.col("node").alias("u"), F.col("label").alias("a"))
        right = turns[-1].select(F.col("node").alias("v"), F.col("label").alias("b"))
        links = links.join(left, "u").join(right, "v").where("a <> b")
        links, done = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), was
        links = materialize(links, "links")
        discard(done)
    if not turns:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def back(later: DataFrame, earlier: DataFrame) -> DataFrame:
        known = later.select(F.col("node").alias("label"), "root")
        return earlier.join(known, "label", "left").select("node", F.coalesce("root", "label").alias("root"))

    return reduce(back, reversed(turns[:-1]), turns[-1].select("node", F.col("label").alias("root")))


def local_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows 0 to n - 1 linked by (i, j), the smallest row of each one's component: as links from each row to that one, at
    most n - 1, they connect what all links do."""
    parent = np.arange(n)
    while len(i):
        low = np.minimum(parent[i], parent[j])
        np.minimum.at(parent, parent[i], low)
        np.minimum.at(parent, parent[j], low)
        before = parent
        parent = parent[parent]
        open_ = parent[i] != parent[j]
        if not open_.any() and (parent == before).all():
            break
    return parent
