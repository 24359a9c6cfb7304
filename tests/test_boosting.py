import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import boosting

COLUMNS = ["a", "b", "c"]


def table(n=400, seed=3):
    """a: continuous; b: few values; c: continuous with nulls that tell something."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(5)), None if rng.random() < 0.2 else rng.gauss(0, 2)
        odds = 1.2 * a - 0.5 * b + (1.5 if c is None else 0.4 * abs(c) - 1)
        out.append((i % 2, a, b, c, int(rng.random() < 1 / (1 + np.exp(-odds)))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, target_up_15m int").repartition(5)


def plain_thresholds(values, most):
    x = sorted(v for v in values if v is not None)
    distinct = sorted(set(x))
    if len(distinct) <= most:
        return [(p + q) / 2 for p, q in zip(distinct, distinct[1:])]
    cuts = []
    for k in range(1, most):
        low, high = k * (len(x) - 1) // most, -(-k * (len(x) - 1) // most)
        cuts.append((x[low] + x[high]) / 2)
    return sorted(set(cuts))


def row_loop(rows, rounds, leaves, leaf, l2, rate, most):
    """The same booster, a row at a time: scores of the rows."""
    xs, ys = [r[1:4] for r in rows], [r[4] for r in rows]
    cuts = [plain_thresholds([x[f] for x in xs], most) for f in range(3)]
    p = sum(ys) / len(ys)
    score = [np.log(p / (1 - p))] * len(rows)

    def sums(ids, g, h):
        return sum(g[i] for i in ids), sum(h[i] for i in ids)

    def split(ids, g, h):
        best = None
        G, H = sums(ids, g, h)
        for f in range(3):
            missing = [i for i in ids if xs[i][f] is None]
            for k in range(len(cuts[f]) + bool(missing)):
                for side in (False, True) if missing else (False,):
                    low = [i for i in ids if (side if xs[i][f] is None else (k == len(cuts[f]) or xs[i][f] <= cuts[f][k]))]
                    inside = set(low)
                    high = [i for i in ids if i not in inside]
                    a, b = sums(low, g, h), sums(high, g, h)
                    if len(low) < leaf or len(high) < leaf or a[1] < 1e-3 or b[1] < 1e-3:
                        continue
                    gain = a[0] ** 2 / (a[1] + l2) + b[0] ** 2 / (b[1] + l2) - G**2 / (H + l2)
                    if gain > 0 and (best is None or gain > best[0] + 1e-12):
                        best = gain, low, high
        return best

    for _ in range(rounds):
        q = [1 / (1 + np.exp(-s)) for s in score]
        g, h = [a - y for a, y in zip(q, ys)], [a * (1 - a) for a in q]
        nodes = [(list(range(len(rows))), split(range(len(rows)), g, h))]
        while len(nodes) < leaves and any(s for _, s in nodes):
            k = max((k for k in range(len(nodes)) if nodes[k][1]), key=lambda k: nodes[k][1][0])
            _, (_, low, high) = nodes.pop(k)
            nodes += [(x, split(x, g, h)) for x in (low, high)]
        for ids, _ in nodes:
            a, b = sums(ids, g, h)
            for i in ids:
                score[i] += -rate * a / (b + l2)
    return [1 / (1 + np.exp(-s)) for s in score]


@pytest.mark.parametrize(("most", "task"), [(255, 1 << 16), (20, 50)])
def test_boosting_equals_a_row_loop(spark, monkeypatch, most, task):
    monkeypatch.setattr(boosting, "TASK", task)  # one task, or several whose sums are added up
    rows = table()
    df = frame(spark, rows).withColumn("id", F.xxhash64("a", "b", "c"))
    models = boosting.fit(df, COLUMNS, "fold", rounds=5, leaves=5, leaf=12, l2=1.0, rate=0.3, bins=most, keep=2)
    got = {(r.a, r.b, r.c): r.p for r in boosting.probabilities(models, df, "fold", "p").collect()}
    for fold in (0, 1):
        own = [r for r in rows if r[0] == fold]
        want = row_loop(own, 5, 5, 12, 1.0, 0.3, most)
        assert [got[r[1:4]] for r in own] == pytest.approx(want, abs=1e-9)
        assert [x == pytest.approx(plain_thresholds([r[1 + f] for r in own], most), abs=1e-12) for f, x in enumerate(models[fold].thresholds)] == [True] * 3
        assert all(sum(f < 0 for f in t.feature) <= 5 for t in models[fold].trees) and any(sum(f < 0 for f in t.feature) == 5 for t in models[fold].trees)


def test_expression_and_saved_model_give_the_same(spark):
    df = frame(spark, table(300, 5)).withColumn("fold", F.lit(0))
    model = boosting.fit(df, COLUMNS, "fold", rounds=6, leaf=15)[0]
    again = boosting.Ensemble.from_json(model.to_json())
    found = boosting.probabilities({0: again}, df, "fold", "p").withColumn("q", model.expression())
    assert found.where(F.abs(F.col("p") - F.col("q")) > 1e-14).count() == 0 and found.where("p IS NULL OR q IS NULL").count() == 0


def test_odd_tables(spark):
    one = spark.createDataFrame([(0, 1.0, None, float("nan"), 1)] * 40, "fold int, a double, b double, c double, target_up_15m int")
    models = boosting.fit(one, COLUMNS, "fold", rounds=2, leaf=5)
    rows = boosting.probabilities(models, one.unionByName(one.limit(1).withColumn("fold", F.lit(7))), "fold", "p").collect()
    assert sum(r.p is None for r in rows) == 1 and all(0.9 < r.p < 1 for r in rows if r.fold == 0)
    assert boosting.fit(one.limit(0), COLUMNS, "fold") == {}


def test_more_rows_than_the_bin_sample(spark):
    """A fixed sample stands for the whole; the thresholds stay near those of all rows."""
    df = spark.range(20_000).select(F.lit(0).alias("fold"), (F.col("id") / 20_000.0).alias("a"))
    cuts = boosting.bin_thresholds(df, ["a"], "fold", most=10, sample=4000)[0][0]
    assert len(cuts) == 9 and cuts == pytest.approx([k / 10 for k in range(1, 10)], abs=0.03)
    assert boosting.bin_thresholds(df, ["a"], "fold", most=10, sample=4000)[0][0] == cuts


def test_audit_finds_planted_faults(spark):
    from tapeworks.operators import model_audit

    df = frame(spark, table(300, 8))
    fitted = lambda: boosting.fit(df, COLUMNS, "fold", rounds=3, leaves=4, leaf=15)
    wrong = lambda m, **k: {r.check for r in model_audit.boosted_checks(m, df, df, "fold", COLUMNS, **({"rounds": 3, "leaves": 4, "leaf": 15, "rate": 0.05, "l2": 1.0} | k)).collect() if r.violations}
    m = fitted()
    assert wrong(m) == set()
    assert wrong(m, rounds=4) == {"rounds"} and wrong(m, leaves=3) == {"leaves_a_tree"} and wrong(m, leaf=40) == {"leaf_rows"}
    assert wrong(m, rate=0.1) == {"leaf_values"}
    m[0].trees[0].value[-1] += 1e-6
    assert wrong(m) == {"leaf_values"}
    m = fitted()
    m[1].start = float("nan")
    assert {"finite_probability", "replay", "leaf_values"} <= wrong(m)
    m = fitted()
    m[0].thresholds[1] = m[0].thresholds[1][::-1]
    assert "bins" in wrong(m)


def test_a_small_table_takes_few_jobs(spark):
    """However many the rounds: its models are grown in a task each."""
    df = spark.range(300).selectExpr("double(id % 17) AS a", "double(id % 5) AS b", "int(id % 2) AS fold", "int(id % 3 = 0) AS target_up_15m")
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        models = boosting.fit(df, ["a", "b"], "fold", rounds=30, leaves=4, leaf=10)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(m.trees) for m in models.values()] == [30, 30]
    assert 0 < jobs < 30
