import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeworks.llm import collocations, quotient_filter
from tapeworks.llm.quotient_filter import Layout, decode, encode, sort_unique

from .cases import odd_documents


def expected(rows, longest, least, most, cover=100):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def corpus(seed=2, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "é", "ÉA", "x'y", "12", "\x1c", "\x85", "w", "Ww", "-", "中文"]
    phrases = [" ".join(rng.choices(words, k=rng.choice([2, 3, 5, 6]))) for _ in range(12)]
    ends = [".", ", ", "\n", "\x0b", "; ", "?!", " \t ", " ", "  "]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.choice([0, 2, 30]))]
        rows.append(("".join(x + rng.choice(ends) for x in parts), rng.choice(["en", "de", None, "en"])))
    return rows + [(None, "en"), ("", None), (" \t", "x"), ("a b " * 9000, "long"), ("same same same", "en")] + [rows[0]] * 40


def frame(spark, rows):
    """With columns whose names clash with the operator's own."""
    return spark.createDataFrame([(t, g, 1, "p", 2) for t, g in rows], "text string, lang string, n int, phrase string, shard int").repartition(4)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500}, {"shard_bytes": 3000, "range_words": 4, "range_entries": 8}])
def test_phrases_match_brute_force(spark, options):
    rows = corpus()
    got = collocations.mine_collocations(frame(spark, rows), longest=5, least=9, most=40, **options).collect()
    want = expected(rows, 5, 9, 40)
    assert len({x[0] for x in want}) >= 4 and len(want) > 60
    assert sorted(map(tuple, got)) == want


def test_odd_documents_and_no_rows(spark):
    rows = [(t, "en") for _, t in odd_documents()]
    got = collocations.mine_collocations(frame(spark, rows), longest=3, least=5, cover=80, most=100).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 5, 100, 80)
    assert collocations.mine_collocations(frame(spark, rows).limit(0)).count() == 0
    assert collocations.mine_collocations(frame(spark, [("only once", "en")])).count() == 0


def test_layouts_are_invertible():
    rng = np.random.default_rng(1)
    for bits in (1, 2, 7, 15, 21, 25, 32, 33, 40, 64):
        for words in range(1, 6):
            layout = Layout(words, bits)
            ids = [rng.integers(0, 2**bits, 200, dtype=np.uint64) for _ in range(words)]
            lanes = layout.pack(ids)
            assert all(int(x.max()) < 2**size for x, size in zip(lanes, layout.sizes, strict=True))
            assert all((a == b).all() for a, b in zip(layout.unpack(lanes), ids, strict=True))


def test_filters_are_lossless():
    rng = np.random.default_rng(2)
    for words, bits, quotient in ((2, 9, 6), (2, 15, 0), (5, 15, 10), (3, 40, 12), (2, 4, 8), (2, 32, 20)):
        layout = Layout(words, bits)
        lanes = layout.pack([rng.integers(0, 2 ** min(bits, 4), 900, dtype=np.uint64) for _ in range(words)])
        order, first = sort_unique(lanes)
        lanes, counts = [x[order[first]] for x in lanes], rng.integers(1, 600, len(first))
        for a, b in ((0, len(first)), (len(first) // 2, len(first)), (5, 5)):
            start = int(lanes[0][a] >> np.uint64(layout.lead - quotient)) if b > a else 0
            back, n = decode(layout, encode(layout, [x[a:b] for x in lanes], counts[a:b], start, quotient))
            assert (n == counts[a:b]).all() and all((x == y[a:b]).all() for x, y in zip(back, lanes, strict=True))


def test_first_lane_is_spread():
    """Neighbouring ids, as a dictionary gives them, fall evenly into ranges of the quotient."""
    layout = Layout(2, 16)
    a, b = np.meshgrid(np.arange(1, 300, dtype=np.uint64), np.arange(1, 300, dtype=np.uint64))
    place = layout.pack([a.ravel(), b.ravel()])[0] >> np.uint64(layout.lead - 6)
    share = np.bincount(place.astype(int), minlength=64) / place.size * 64
    assert 0.8 < share.min() and share.max() < 1.25 and quotient_filter is not None


def test_arithmetic_past_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_000,) * 4], "a long, n long, l long, r long")
    wide = rows.selectExpr("cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(n as decimal(18,0)) as top", "cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as bottom")
    assert wide.selectExpr("top div bottom").first()[0] == 1000
