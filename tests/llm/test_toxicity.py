import random
import zlib

import numpy as np

from tapeworks.llm import toxicity

from .cases import frame, odd_documents

BAD = ["vulgo", "scumbe", "moronti", "trashy"]


def corpus(n=900, seed=6):
    """Toxic documents hold one to three offending words in one sentence or more; clean ones never do."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abdefghilmnorstu", k=rng.randrange(2, 8))) for _ in range(500)]
    docs, labels, offending = [], [], {}
    for i in range(n):
        parts = [[rng.choice(words) for _ in range(rng.randrange(3, 14))] for _ in range(rng.randrange(1, 12))]
        toxic = rng.random() < 0.2
        hit = set(rng.sample(range(len(parts)), rng.randrange(1, min(3, len(parts)) + 1))) if toxic else set()
        for k in hit:
            parts[k][rng.randrange(len(parts[k]))] = rng.choice(BAD).title()
        text, starts = "", []
        for p in parts:
            starts.append(len(text))
            text += " ".join(p) + rng.choice([".", "!", "\n"])
        docs.append((i, text))
        labels.append((i, int(toxic)))
        offending[i] = sorted(starts[k] for k in hit)
    return docs, labels, offending


def test_held_out_documents_and_their_sentences(spark):
    docs, labels, offending = corpus()
    got = {r.doc_id: r for r in toxicity.judge_toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert set(got) == set(dict(docs)) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [(got[i], y, offending[i]) for i, y in labels if got[i].held_out]
    assert np.mean([r.predicted == y for r, y, _ in held]) > 0.97
    right = [[s.start for s in r.offending] == at for r, _, at in held]
    assert np.mean(right) > 0.95
    spot = next(s for r, y, _ in held if y for s in r.offending)
    assert spot.length > 0 and 0.5 <= spot.score <= 1


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs, labels, _ = corpus(300)
    clean = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels] + [(None, 1), (3, None), (4, 9)]
    a = {r.doc_id: r.score for r in toxicity.judge_toxicity(frame(spark, docs), clean).collect()}
    b = {r.doc_id: r.score for r in toxicity.judge_toxicity(frame(spark, docs), spark.createDataFrame(turned, "doc_id long, toxic int")).collect()}
    assert a == b


def test_odd_texts_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.judge_toxicity(frame(spark), none).collect()
    assert len(rows) == len(odd_documents()) and all(r.score < 0.5 and not r.predicted for r in rows)
    odd = toxicity.judge_toxicity(frame(spark), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")).collect()
    assert len(odd) == len(odd_documents()) and all(np.isfinite(r.score) for r in odd)
    same = {}
    for r, t in zip(sorted(odd, key=lambda r: r.doc_id), [t for _, t in sorted(odd_documents(), key=lambda x: x[0])], strict=True):
        assert same.setdefault(t, r.score) == r.score and (t or r.score == 0)
    assert toxicity.judge_toxicity(frame(spark).limit(0), none).count() == 0
    only = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.judge_toxicity(frame(spark), only).collect()} == {0}


def test_gradient_is_that_of_the_noisy_or():
    """The fit stands where a plain loop over documents and sentences finds no better weights nearby."""
    rng = np.random.default_rng(3)
    bags = []
    for _ in range(400):
        held = [np.unique(rng.integers(0, 12, rng.integers(1, 5))) for _ in range(rng.integers(1, 5))]
        truth = 1 - np.prod([1 - 1 / (1 + np.exp(-(-2.5 + 3 * (0 in s) + 2 * (1 in s)))) for s in held])
        bags.append((int(rng.random() < truth), 1.0, held))
    model = toxicity.fit(bags, l1=0.0, l2=0.0, steps=3000)

    def loss(at, w, b):
        weight, total = dict(zip(at, w, strict=True)), 0.0
        for y, _, held in bags:
            p = 1 - np.prod([1 - 1 / (1 + np.exp(-(b + sum(weight.get(int(x), 0.0) for x in s)))) for s in held])
            total -= np.log(p if y else 1 - p)
        return total / len(bags)

    best = loss(model.at, model.weights, model.bias)
    for k in range(len(model.at)):
        for d in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += d
            assert loss(model.at, w, model.bias) > best - 1e-5
    assert loss(model.at, model.weights, model.bias + 0.05) > best - 1e-5 < loss(model.at, model.weights, model.bias - 0.05)
    weights = dict(zip(model.at.tolist(), model.weights.tolist(), strict=True))
    assert weights[0] > weights[1] > max(w for k, w in weights.items() if k > 1)


def test_scores_are_the_noisy_or_of_sentences():
    at = np.array(sorted(toxicity.word_features("bad")[:1]), np.int64)
    score = toxicity.Model(at, np.array([3.0]), -2.0).scorer()
    p, q = 1 / (1 + np.exp(2.0)), 1 / (1 + np.exp(-1.0))
    total, spots = score("Fine here. So BAD, bad! ... more")
    assert np.isclose(total, 1 - (1 - p) ** 2 * (1 - q))
    assert [(a, n) for a, n, _ in spots] == [(0, 9), (10, 12), (27, 5)] and np.allclose([x for *_, x in spots], [p, q, p])
    assert score(None) == score("") == score("12 .. 3") == (0.0, [])
