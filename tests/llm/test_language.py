import random
import zlib

import numpy as np
import pytest

from tapeworks.llm import language

WORDS = {"en": "the of and thing tion hen", "de": "der und schön über heit ung", "fr": "le été queue eau ment où"}


def corpus(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join("".join(rng.choices(WORDS[lang].split(), k=2)) for _ in range(rng.choice([2, 30]))), lang, "en", 1.0))
    odd = [None, "", "12 34 !!", "\n", "the " * 40_000]
    return rows + [(n + i, t, None, "x", 0.5) for i, t in enumerate(odd)] + [(n + 9, "thing of the", "en", "x", 0.5)] * 2


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"


def test_held_out_rows_are_identified_and_scores_are_calibrated(spark):
    rows = corpus()
    got = language.identify_languages(spark.createDataFrame(rows, SCHEMA).repartition(4), sample=300).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == truth[r.doc_id] for r in held])) < 0.05
    assert all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {600, 601, 602, 603}


def test_only_texts_decide_and_held_out_labels_are_not_read(spark):
    rows = corpus(200)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, a, b) for i, t, lang, a, b in rows]
    first, second = (sorted(map(tuple, language.identify_languages(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, swapped))
    assert first == second


def test_nothing_to_learn_from(spark):
    rows = [(1, "the thing", None, "x", 0.0), (None, "the", "en", "x", 0.0)]
    assert {(r.lang_pred, r.score) for r in language.identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}
    assert language.identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_penalty_leaves_weights_out():
    rng = np.random.default_rng(1)
    rows = [(i % 2, np.unique(rng.integers(0, 400, 20)).astype(np.int32) + 1000 * (i % 2), np.ones(0)) for i in range(60)]
    rows = [(label, at, np.ones(len(at), np.int64)) for label, at, _ in rows]
    loose, strict = (language.Model(["a", "b"], np.ones(language.BUCKETS), np.zeros((language.BUCKETS, 2))) for _ in range(2))
    language.fit_leader(loose, rows, 1.0, 1.0, 0.0, 0.01, 2)
    language.fit_leader(strict, rows, 1.0, 1.0, 0.3, 0.01, 2)
    assert 0 < np.count_nonzero(strict.weights) < np.count_nonzero(loose.weights)


def test_rows_are_fitted_in_an_order_that_mixes_the_languages(spark, monkeypatch):
    rows = [(i, f"{'the thing' if i % 11 else 'le été'} {i}", "en" if i % 11 else "fr") for i in range(3300)]
    fitted = []
    monkeypatch.setattr(language, "fit_leader", lambda model, rows, *_: fitted.extend(x[0] for x in rows))
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=300)
    places = np.flatnonzero(np.array(fitted) == 0) / len(fitted)  # en, of which a smaller share is chosen
    assert 60 < len(places) < len(fitted) - 60
    assert 0.4 < places.mean() < 0.6 and places.max() > 0.95


def test_weights_match_a_row_by_row_version():
    """TF-IDF, follow-the-regularised-leader and the penalties, written out one coordinate at a time."""
    rng = random.Random(3)
    texts = [("".join(rng.choices("abcde " if i % 2 else "cdefg ", k=30)), i % 2) for i in range(24)]
    idf = np.random.default_rng(1).uniform(1, 3, language.BUCKETS)
    alpha, beta, l1, l2 = 0.8, 1.2, 0.02, 0.05
    model = language.Model(["a", "b"], idf, np.zeros((language.BUCKETS, 2)))
    language.fit_leader(model, [(y, *language.gram_counts(t)) for t, y in texts], alpha, beta, l1, l2, 2)

    def grams(text):  # 1- to 3-grams by their own bucket function
        codes, counts = [ord(c) for c in text], {}
        for start in range(len(codes)):
            value = 0
            for order, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                if start + order >= len(codes):
                    break
                value = (value ^ codes[start + order]) * factor % 2**32
                value ^= value >> 15
                counts[value % language.BUCKETS] = counts.get(value % language.BUCKETS, 0) + 1
        return counts

    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return (np.sign(z[k]) * l1 - z[k]) / ((beta + np.sqrt(n[k])) / alpha + l2)

    for _ in range(2):
        for text, y in texts:
            x = {g: (1 + np.log(c)) * idf[g] for g, c in grams(text).items()}
            norm = np.sqrt(sum(v * v for v in x.values()))
            x = {g: v / norm for g, v in x.items()}
            w = {(g, c): weight((g, c)) for g in x for c in (0, 1)}
            e = [np.exp(sum(x[g] * w[g, c] for g in x)) for c in (0, 1)]
            for g in x:
                for c in (0, 1):
                    slope = x[g] * (e[c] / sum(e) - (c == y))
                    before = n.get((g, c), 0.0)
                    z[g, c] = z.get((g, c), 0.0) + slope - (np.sqrt(before + slope**2) - np.sqrt(before)) / alpha * w[g, c]
                    n[g, c] = before + slope**2
    slow = np.zeros((language.BUCKETS, 2))
    for k in z:
        slow[k] = weight(k)
    assert np.count_nonzero(slow) and np.allclose(model.weights, slow, atol=1e-9)


def test_temperature_is_the_best_and_inside_the_range():
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b"], np.ones(language.BUCKETS), rng.standard_normal((language.BUCKETS, 2)))
    rows = [(int(rng.integers(2)), np.unique(rng.integers(0, language.BUCKETS, 9)), np.ones(9, np.int64)) for _ in range(80)]
    rows = [(y, at, c[: len(at)]) for y, at, c in rows]
    apart = [(int(np.argmax(model.scores(at, c))), at, c) for _, at, c in rows]  # no error at all
    for data in (rows, apart):
        best, target = language.calibrate(model, data), (len(data) + 1) / (len(data) + 2)

        def loss(t, data=data, target=target):
            out = 0.0
            for y, at, c in data:
                p = language.softmax(model.scores(at, c) / t)
                out -= target * np.log(p[y]) + (1 - target) * np.log(p[1 - y])
            return out

        assert np.exp(-7.9) < best < np.exp(7.9)
        assert all(loss(best) <= loss(best * k) + 1e-9 for k in (0.9, 0.99, 1.01, 1.1))


def test_every_language_is_learned_or_none(spark):
    rows = [(i, "the thing of a tale", f"l{i % 3}") for i in range(60)] + [(99, "one text only", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    enough = len(languages) * language.BUCKETS * 8
    assert language.train(docs, model_bytes=enough).languages == sorted(languages)
    with pytest.raises(language.TooManyLanguages):
        language.train(docs, model_bytes=enough - 1)


def test_training_rows_are_bounded_in_bytes(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "fit_leader", lambda model, rows, *_: taken.append(rows))
    docs = spark.createDataFrame(corpus(300), SCHEMA)
    language.train(docs)
    size = lambda rows: sum(at.nbytes + n.nbytes for _, at, n in rows)
    bound = size(taken[0]) // 3
    language.train(docs, row_bytes=bound)
    assert 0 < size(taken[1]) <= bound and len({label for label, *_ in taken[1]}) == 3
    assert all(a[0] == b[0] and (a[1] == b[1]).all() for a, b in zip(*taken))  # the first rows of the same order
    language.train(docs, row_bytes=1)  # the row that every fit needs is kept back for the temperature
    assert taken[2] == []
