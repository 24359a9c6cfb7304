import random
import re

import corpus_pipeline
from tapeworks.llm import language, quality, simhash, suffix_dedup

from .test_simhash import union
from .test_suffix_dedup import corpus as repeats
from .test_suffix_dedup import expected as removed

SCHEMA = "text string, doc_id long, fp int, row string, n_chars long, k1 string"


def frame(spark, docs):
    return spark.createDataFrame([(t, i, 3, "r", None if t is None else len(t), "k") for i, t in docs], SCHEMA).repartition(3)


def test_language_stage_keeps_rows_whole(spark):
    model = language.Model(["en"], language.np.ones(language.BUCKETS), language.np.zeros((language.BUCKETS, 1)))
    docs = [(1, "words here"), (2, "12 34"), (3, None), (4, ""), (5, "é")]
    got = language.keep_identified(frame(spark, docs), model)
    assert got.schema == frame(spark, docs).schema
    assert sorted(map(tuple, got.collect())) == sorted((t, i, 3, "r", len(t), "k") for i, t in docs if i in (1, 5))


def test_quality_stage_keeps_rows_whole(spark):
    docs = [(1, "a b c d e f g h i j"), (2, "a b c"), (3, "w " * 50), (4, None)]
    got = quality.keep_good(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int"))
    assert [tuple(r) for r in got.collect()] == [("a b c d e f g h i j", 1, 3, "r", 19, "k")]


def near_copies():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(2, 7))) for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([2, 30, 300])))) for i in range(40)]
    for i in range(80):
        t = docs[i % 40][1].split()
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((100 + i, " ".join(t)))
    return docs


def similar_components(docs, least=0.8):
    """Component of each id by brute-force Jaccard similarity of the sets of five-word shingles."""
    words = {i: (t or "").lower().split() for i, t in docs}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    similar = lambda a, b: len(a & b) / len(a | b) >= least
    return union([(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j])], list(sets))


def copies_around_the_similarity():
    """Each text with one copy whose last words differ, at similarities from 0.7 to 0.95, and a pair at exactly 0.8."""
    rng = random.Random(9)
    docs = []
    for i in range(120):
        n = rng.choice([24, 60, 150, 400]) - 4
        t = [f"w{rng.randrange(5000)}" for _ in range(n + 4)]
        new = round(n * rng.uniform(0.03, 0.18)) if i % 6 else n // 10
        docs += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(t[: n + 4 - new] + [f"x{k}" for k in range(new)]))]
    docs += [(300, " ".join("abcdefghi")), (301, " ".join("abcdefgh"))]  # 5 and 4 shingles: exactly 0.8
    return docs


def test_simhash_stage_finds_every_pair_of_the_similarity(spark):
    docs = copies_around_the_similarity() + [(1000 + i, t) for i, t in near_copies()]
    want = sorted(set(similar_components([*docs, (9000, "")]).values()))
    assert 60 < len(want) < len(docs) - 60
    rows = frame(spark, [*docs, (0, docs[0][1]), (0, docs[0][1]), (None, None), (None, ""), (9000, "\t")])
    got = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert got.columns == rows.columns
    assert sorted(r.doc_id for r in got.collect()) == want
    cut = simhash.keep_one_of_similar(rows, cap=3, unit=4)  # every larger band and group goes through the parts
    assert sorted(r.doc_id for r in cut.collect()) == want
    nulls = frame(spark, [(None, "one two"), (None, "one two"), (None, "three")])
    assert sorted(r.text for r in simhash.keep_one_of_similar(nulls).collect()) == ["one two", "three"]
    assert simhash.keep_one_of_similar(rows.limit(0)).count() == 0


def test_near_fingerprints_are_candidates(spark):
    """Pairs of a similarity of 0.8 that share no band, but whose fingerprints lie within 4 bits."""
    docs = []
    for seed in (10038907, 20088965, 30045842):
        head = " ".join(f"w{seed}x{i}" for i in range(12))
        docs += [(len(docs), f"{head} one"), (len(docs) + 1, f"{head} two")]
    for (_, a), (_, b) in zip(docs[::2], docs[1::2], strict=True):
        keys = [simhash.marks(simhash.shingle_set(t.encode(), 5))[1] for t in (a, b)]
        assert not (keys[0] == keys[1]).any()
        assert (simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() <= 4
    want = sorted(set(similar_components(docs).values()))
    assert want == [0, 2, 4]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, docs), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def templated(n, shared=82, own=22, seed=12):
    """Pages alike in what all of them have: each two at a Jaccard similarity near 0.7; every 50th is a near copy of the one before."""
    rng = random.Random(seed)
    head = [f"b{k}" for k in range(shared)]
    docs = []
    for i in range(n):
        tail = docs[-1][1].split()[shared:-1] + ["end"] if i % 50 == 49 else [f"u{rng.randrange(10**9)}" for _ in range(own)]
        docs.append((i, " ".join(head + tail)))
    return docs


def test_templated_pages_stay_apart_and_their_copies_go(spark):
    docs = templated(300) + [(1000 + i, t) for i, t in near_copies()]
    want = sorted(set(similar_components(docs).values()))
    assert len([i for i in want if i < 1000]) == 294
    for unit in (128, 16):
        got = simhash.keep_one_of_similar(frame(spark, docs), unit=unit)
        assert sorted(r.doc_id for r in got.collect()) == want


def test_prefixes_meet_for_every_pair_of_the_similarity():
    rng = random.Random(5)
    for _ in range(3000):
        n, t = rng.randrange(1, 60), rng.choice([0.5, 0.8, 0.9])
        a = set(rng.sample(range(200), n))
        b = set(rng.sample(sorted(a), max(1, n - rng.randrange(0, 1 + n // 5)))) | {rng.randrange(200) for _ in range(rng.randrange(0, 1 + n // 8))}
        if len(a & b) / len(a | b) >= t:
            small, large = sorted((sorted(a), sorted(b)), key=len)
            assert set(small[: simhash.prefix_sizes(len(small), t)[1]]) & set(large[: simhash.prefix_sizes(len(large), t)[0]])


def test_suffix_stage_removes_what_the_operator_removes(spark):
    docs = repeats(4) + [(900, None)]
    got = suffix_dedup.strip_repeats(frame(spark, docs), 40)
    assert got.schema == frame(spark, docs).schema
    full = suffix_dedup.remove_repeats(frame(spark, docs), 40, with_kept=True)
    assert sorted(tuple(r)[:5] for r in full.collect()) == removed(docs, 40)
    kept = sorted((r.doc_id, r.kept.decode(errors="ignore")) for r in full.collect() if r.doc_id != 900)
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id != 900) == kept
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_stages_in_order_over_planted_documents(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["th", "en", "is", "or", "ea", "st"], k=rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    docs = [(i, text(rng.randrange(40, 200))) for i in range(60)]
    docs += [(60 + i, text(50) + " " + passage + " " + text(50)) for i in range(10)]
    docs += [(80 + i, docs[i][1]) for i in range(10)] + [(95, "1 2 3"), (96, "few words"), (97, "w " * 60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path)).cache()
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in step.collect()})
    assert set(seen[0]) == set(range(70)) | set(range(80, 90)) | {96, 97}
    assert set(seen[1]) == set(range(70)) | set(range(80, 90))
    assert set(seen[2]) == set(seen[3]) == set(range(70))
    for i, t in seen[3].items():
        assert (t == docs[i][1]) if i < 60 else passage[20:-20] not in t and len(re.findall(r"\S+", t)) >= 95
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(70))


def test_stages_on_empty_tables_long_texts_and_repeated_rows(spark):
    long_ = " ".join(f"the{i % 9973}x{i % 7919}" for i in range(60_000))
    docs = [(1, long_), (2, "of the thing and that is fine for all of us"), (2, "of the thing and that is fine for all of us"), (3, None), (4, "")]
    model = language.Model(["en"], language.np.ones(language.BUCKETS), language.np.zeros((language.BUCKETS, 1)))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows, whole = frame(spark, docs), sorted((t, i) for i, t in docs[:3])
    for stage in (lambda x: language.keep_identified(x, model), lambda x: quality.keep_good(x, none)):
        assert sorted((r.text, r.doc_id) for r in stage(rows).collect()) == whole
        assert stage(rows.limit(0)).count() == 0 and stage(rows).columns == rows.columns
    got = suffix_dedup.strip_repeats(rows, 40).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, long_), (2, ""), (2, ""), (3, None), (4, "")], key=str)
    assert suffix_dedup.strip_repeats(rows.limit(0), 40).count() == 0
