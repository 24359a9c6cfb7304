"""Audits of fitted boosted ensembles: shape against the specification, leaves worked out again from the rows, replay of the
saved form through another evaluator. Each returns (check, rows, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Ensemble, Tree, probabilities

CHECKS = "check string, rows long, violations long"


def boosted_checks(
    models: dict, train: DataFrame, validation: DataFrame, by: str, columns: list[str], rounds: int, leaves: int, leaf: int, rate: float, l2: float,
    label: str = "target_up_15m", tolerance: float = 1e-14,
) -> DataFrame:
    """Parameters (columns, rounds, leaves a tree, bins), the first tree's leaves (rows and values, from the training rows by a
    grouped sum), and the probabilities of the validation rows (within 0 and 1, and equal to those of the saved and reloaded
    ensemble as one CASE expression a tree, to ``tolerance``)."""
    spark, shape = train.sparkSession, []
    for m in models.values():
        shape += [("columns", m.columns != columns), ("rounds", len(m.trees) != rounds)]
        shape += [("leaves_a_tree", sum(f < 0 for f in t.feature) > leaves) for t in m.trees]
        shape += [("bins", len(t) > 254 or any(a >= b for a, b in zip(t, t[1:], strict=False))) for t in m.thresholds]
    found = spark.createDataFrame([(name, int(wrong)) for name, wrong in shape], "check string, wrong int")
    parts = [found.groupBy("check").agg(F.count("*").alias("rows"), F.sum("wrong").alias("violations"))]
    for g, m in sorted(models.items()):
        parts.append(_first_leaves(m, train.where(F.col(by) == g), leaf, rate, l2, label))
    again = {g: Ensemble.from_json(m.to_json()) for g, m in models.items()}
    p = probabilities(models, validation, by, "_p")
    replayed = reduce(DataFrame.unionByName, [p.where(F.col(by) == g).withColumn("_q", m.expression()) for g, m in sorted(again.items())])
    same = F.coalesce(F.abs(F.col("_p") - F.col("_q")) <= tolerance, F.lit(False))
    rules = {"replay": same, "finite_probability": F.coalesce(F.col("_p").between(0, 1), F.lit(False))}
    flags = F.array(*[F.struct(F.lit(k).alias("check"), (~ok).cast("int").alias("wrong")) for k, ok in rules.items()])
    flat = replayed.select(F.explode(flags).alias("x")).select("x.*")
    parts.append(flat.groupBy("check").agg(F.count("*").alias("rows"), F.sum("wrong").alias("violations")))
    total = reduce(DataFrame.unionByName, parts).groupBy("check").agg(F.sum("rows").alias("rows"), F.sum("violations").alias("violations"))
    return total.select("check", "rows", "violations")


def _leaf(m: Ensemble, t: Tree, node: int = 0) -> Column:
    """The number of the leaf that a row falls into."""
    f = t.feature[node]
    if f < 0:
        return F.lit(node)
    x, cuts = F.col(m.columns[f]).cast("double"), m.thresholds[f]
    none = x.isNull() | F.isnan(x)
    below = x <= cuts[t.cut[node]] if t.cut[node] < len(cuts) else F.lit(True)
    return F.when((none & F.lit(t.missing_left[node])) | (~none & below), _leaf(m, t, t.left[node])).otherwise(_leaf(m, t, t.right[node]))


def _first_leaves(m: Ensemble, rows: DataFrame, leaf: int, rate: float, l2: float, label: str) -> DataFrame:
    t, p = m.trees[0], F.lit(m.start)
    p = 1 / (1 + F.exp(-p))
    sums = rows.select(_leaf(m, t).alias("leaf"), (p - F.col(label)).alias("g"), (p * (1 - p)).alias("h"))
    sums = sums.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    value = F.create_map(*[F.lit(x) for i, f in enumerate(t.feature) if f < 0 for x in (i, float(t.value[i]))])[F.col("leaf")]
    wrong = F.coalesce(F.abs(value + rate * F.col("g") / (F.col("h") + l2)) > 1e-9, F.lit(True))
    flags = F.array(*[F.struct(F.lit(k).alias("check"), x.cast("int").alias("wrong")) for k, x in {"leaf_rows": F.col("n") < leaf, "leaf_values": wrong}.items()])
    flat = sums.select(F.explode(flags).alias("x")).select("x.*")
    return flat.groupBy("check").agg(F.count("*").alias("rows"), F.sum("wrong").alias("violations"))
