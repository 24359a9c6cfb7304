"""The difference-cover algorithm over tables: suffix ranks of a set of strings that is too large for one task.

A row is a position of a string: (id, at, s). Positions 1 and 2 modulo 3 are the sample. Triples of symbols are named by a
sort of the distinct triples (pre-aggregated, range-partitioned, prefix sums over one row a partition); where names do not
settle the order yet, the strings of names, two for each string, are ranked the same way. The remaining positions are merged
in: among those that are 1 modulo 3 by (symbol, rank behind it), among those that are 2 by two symbols and a rank.

Only the first ``length`` bytes must be told apart, so names stop when triples cover them: a fixed number of levels, whatever
the number of rows. Strings are of bounded size, so windows over one of them are; everything else is grouped counts and
equi-joins of written tables, which adaptive execution can split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


def ordered_keys(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """The distinct keys, and for each of ``counts`` (a grouped count) how much of it lies before the key in ascending order."""
    found = rows.groupBy(*keys).agg(*[c.alias(name) for name, c in counts.items()])
    found = materialize(found.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "suffix-keys")
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("part").agg(*[F.sum(c).alias(c) for c in counts])
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"_{c}") for c in counts])  # a row a partition
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})
    placed = placed.join(F.broadcast(totals), "part")
    return materialize(placed.select(*keys, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in counts]), "suffix-ordered")


def suffix_ranks(symbols: DataFrame, length: int, depth: int = 1) -> DataFrame:
    """(id, at, s) with s >= 1 and no gaps from at = 0 -> (id, at, rank): how many suffixes are less. Suffixes that agree in
    their first ``length`` bytes lie next to one another in order of rank, with equal ranks or not; others have different
    ones. A symbol stands for ``depth`` bytes."""
    along, third = Window.partitionBy("id").orderBy("at"), F.col("at") % 3
    ahead = {f"s{i}": F.coalesce(F.lead("s", i).over(along), F.lit(0)) for i in (1, 2)}
    rows = materialize(symbols.withColumns(ahead), "suffix-symbols")
    triple, sample = ["s", "s1", "s2"], rows.where(third != 0)
    names = ordered_keys(sample, triple, {"before": F.count("*")})
    named = sample.join(names, triple).select("id", "at", F.col("before").alias("rank"))
    if 3 * depth < length and names.count() < sample.count():
        second = (third == 2).cast("bigint")
        below = named.select((F.col("id") * 2 + second).alias("id"), F.floor(F.col("at") / 3).cast("int").alias("at"), (F.col("rank") + 1).alias("s"))
        deep = suffix_ranks(below, length, 3 * depth)
        named = deep.select(F.shiftright("id", 1).alias("id"), (F.col("at") * 3 + 1 + F.col("id") % 2).cast("int").alias("at"), "rank")
    rows = rows.drop("s2").join(named, ["id", "at"], "left")
    rows = rows.withColumns({f"r{i}": F.coalesce(F.lead("rank", i).over(along), F.lit(-1)) for i in (1, 2)})
    rows = materialize(rows, "suffix-named")
    of = lambda *classes: rows.where(third.isin(*classes))
    tally = lambda own: {"zeros": F.count_if(third == 0), "others": F.count_if(third == own)}
    ones = ordered_keys(of(0, 1), ["s", "r1"], tally(1))
    twos = ordered_keys(of(0, 2), ["s", "s1", "r2"], tally(2))
    merged = [
        of(0).join(ones.select("s", "r1", (F.col("zeros") + F.col("others")).alias("_a")), ["s", "r1"])
        .join(twos.select("s", "s1", "r2", F.col("others").alias("_b")), ["s", "s1", "r2"])
        .select("id", "at", (F.col("_a") + F.col("_b")).alias("rank")),
        of(1).join(ones.select("s", "r1", "zeros"), ["s", "r1"]).select("id", "at", (F.col("rank") + F.col("zeros")).alias("rank")),
        of(2).join(twos.select("s", "s1", "r2", "zeros"), ["s", "s1", "r2"]).select("id", "at", (F.col("rank") + F.col("zeros")).alias("rank")),
    ]
    return reduce(DataFrame.union, merged)


def adjacent(ranked: DataFrame) -> DataFrame:
    """(id, at, rank, h) -> (id, at, next_id, next_at) of neighbours in order of rank whose h is equal: one pair a row at most."""
    order = ["rank", "id", "at"]
    rows = materialize(ranked.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "suffix-in-order")
    heads = rows.groupBy("part").agg(F.min(F.struct(*order, "h")).alias("head"))  # a row a partition
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("head"))
    after = F.lead(F.struct(*order, "h")).over(Window.partitionBy("part").orderBy(*order))
    rows = rows.withColumn("after", after).join(F.broadcast(heads), "part").withColumn("after", F.coalesce("after", "head"))
    return rows.where(F.col("h") == F.col("after.h")).select("id", "at", F.col("after.id").alias("next_id"), F.col("after.at").alias("next_at"))
