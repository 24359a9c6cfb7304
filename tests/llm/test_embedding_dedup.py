import numpy as np

from tapeworks.llm import embedding_dedup as E

from .test_simhash import union


def vectors(seed=1, n=300, d=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    near = base[rng.integers(0, 60, 200)] + rng.standard_normal((200, d)) * 0.12
    chain = [np.cos(a) * np.eye(d)[0] + np.sin(a) * np.eye(d)[1] for a in np.arange(0, 3, 0.3)]
    rows = [x.tolist() for x in [*base, *near, *(base[:20] * 7.5), *base[:40], *([base[0]] * 30), *chain]]
    rows += [None, [], [0.0] * d, [1.0, None] + [0.0] * (d - 2), [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [3.0, 4.0], [3.0, 4.1], [1e-300] * d, [1e300] * d]
    return list(enumerate(rows))


def brute(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in good.items()}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    return [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, class int").repartition(3)
    return {r.vec_id: r for r in E.link_vectors(frame, **options).collect()}


def test_links_match_brute_force(spark):
    rows = vectors()
    pairs = brute(rows)
    got = run(spark, rows, recall=0.999999)
    links = np.bincount([x for p in pairs for x in p], minlength=len(rows))
    roots = union(pairs, [i for i, _ in rows])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], roots[i], roots[i] == i) for i, _ in rows}
    again = run(spark, rows, recall=0.999999, cap=5)  # buckets of over five vectors are cut into parts
    assert again == got


def test_recall_and_no_false_links(spark):
    rows = vectors(seed=4, n=500)
    pairs = brute(rows)
    links = np.bincount([x for p in pairs for x in p], minlength=len(rows))
    got = run(spark, rows)
    found = np.array([got[i].n_links for i, _ in rows])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()


def test_repeated_rows_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, E.link_vectors(frame, recall=0.9999).collect()), key=str)
    assert got == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, None), (None, 0, None, None)], key=str)
    assert E.link_vectors(frame.limit(0)).count() == 0


def test_plan_and_collision():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(200_000), rng.uniform(0, E.WIDTH, 200_000)
    for distance in (0.3, 1.4):
        assert abs(np.mean(np.floor(b / E.WIDTH) == np.floor((a * distance + b) / E.WIDTH)) - E.collision(distance)) < 0.01
    assert E.plan(10_000, 0.9, 0.97)[0] < E.plan(10**9, 0.9, 0.97)[0]
