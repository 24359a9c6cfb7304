import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import suffix_array, suffix_dedup

from .cases import frame, odd_documents


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_order(s):
    assert suffix_array.suffix_order(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_order_of_large_symbols():
    s = np.random.default_rng(1).integers(1, 2**24, 300)
    s = np.concatenate([s, s[50:200], s])
    assert suffix_array.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def expected(docs, length):
    seen = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for n, (_, b) in enumerate(data):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((n, p))
    covered = [np.zeros(len(b), bool) for _, b in data]
    for at in seen.values():
        if len(at) > 1:
            for n, p in at:
                covered[n][p : p + length] = True
    out = []
    for (i, b), c in zip(data, covered, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], c.astype(int)))) == 1))
        out.append((i, len(b), int(c.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [make(n) for n in (20, 35, 41, 60, 200, 400)]
    docs = []
    for i in range(120):
        parts = [make(rng.choice([0, 5, 30, 90])) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(0, 3)):
            x = rng.choice(shared)
            a = rng.randrange(len(x))
            parts.insert(rng.randrange(len(parts) + 1), x[a:] if rng.random() < 0.5 else x)
        docs.append((i, "".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(8)] + [(200, docs[0][1]), (300, "ab" * 150), (301, "z" * 120)]
    near = make(700)
    for i in range(30):
        at = rng.randrange(700)
        docs.append((400 + i, near[:at] + rng.choice("xyz") + near[at + 1 :]))
    return docs


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_removed_bytes_match_brute_force(spark):
    docs = corpus()
    for options in ({}, {"cap": 1}, {"batch": 1}):
        assert rows(suffix_dedup.remove_repeats(frame(spark, docs), 40, **options)) == expected(docs, 40)


def test_full_length_and_odd_documents(spark):
    docs = [(i, t) for i, t in odd_documents() if not t or len(t) < 20_000] + [(5000, "q" * 3000), (5001, "x" + "q" * 199), (5002, "y" + "q" * 198)]
    got = suffix_dedup.remove_repeats(frame(spark, docs), 200, with_kept=True)
    assert rows(got.drop("spans", "kept")) == expected(docs, 200)
    for r in got.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == 2 * r.n_spans


def test_long_texts_are_taken_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    text = "".join(random.Random(3).choices("abc", k=700))
    data = text.encode() + text.encode()[100:400]
    whole = suffix_dedup.contexts(data, 40, 20)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 22)
    single = suffix_dedup.contexts(data, 40, 20)
    spread = lambda c: [(int(n), p) for n, f, k in zip(*c, strict=True) for p in range(f, f + k)]
    assert spread(whole) == spread(single)


def test_null_ids_and_empty_table(spark):
    docs = [(None, "k" * 10 + "abcdefghij" * 5), (None, "abcdefghij" * 5), (None, None)]
    got = sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, docs), 40).collect()), key=str)
    assert got == sorted(((None, *x[1:]) for x in expected([(1, docs[0][1]), (2, docs[1][1]), (3, None)], 40)), key=str)
    assert suffix_dedup.remove_repeats(frame(spark).limit(0)).count() == 0
