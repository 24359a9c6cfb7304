import random
import re

import numpy as np

from tapeworks.llm import quality

from .cases import frame, odd_documents


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen, marked = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked.update(i + j for i in at for j in range(5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_statistics_match_brute_force(spark):
    docs = odd_documents() + [(3000, "a b c d e f a b c d e x a b c d e"), (3001, "w " * 3000), (3002, "l\nl\n \nl\n\n")]
    got = sorted(map(tuple, quality.text_statistics(frame(spark, docs)).collect()))
    assert got == sorted((i, *slow_statistics(t)) for i, t in docs)


def labelled(n=1500, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 200))]
        bad = rng.random() < 0.3
        if bad and rng.random() < 0.5:
            words = [w + "$$$" for w in words]
        elif bad:
            words = [w * 4 for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_learned_list_finds_the_bad_and_keeps_the_good(spark):
    docs, labels = labelled()
    frame_labels = spark.createDataFrame(labels[: len(labels) // 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(frame(spark, docs), frame_labels).collect()}
    held_out = labels[len(labels) // 2 :]
    assert np.mean([got[i].kept for i, good in held_out if good]) > 0.98
    assert np.mean([not got[i].kept for i, good in held_out if not good]) > 0.9


def test_no_labels_edges_and_order(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(frame(spark), none).collect()
    assert len(got) == len(odd_documents()) and all(r.kept != r.base_failed for r in got)
    odd = spark.createDataFrame([(None, 0), (3, None), (3, 5)], "doc_id long, quality int")
    assert quality.judge(frame(spark), odd).count() == len(odd_documents())
    assert quality.judge(frame(spark).limit(0), none).count() == 0
    rules = quality.DecisionList([[("n_words", True, 5.0)], [("n_words", True, 2.0), ("dup_lines", False, 0.0)]])
    rows = spark.createDataFrame([(9, 0, 0, 0, 0), (4, 0, 0, 0, 0), (4, 0, 0, 1, 0)], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    assert [r[0] for r in rows.select(rules.rule_number()).collect()] == [1, 2, None]


def covered(cells, counts, precision=0.9, support=8, most=8):
    cuts = [[float(k) for k in range(int(cells[:, f].max()))] for f in range(cells.shape[1])]
    return quality.cover(cells, counts.astype(float), cuts, precision, support, most).rules


def holds(rule, cell):
    names = list(quality.FEATURES)
    return all((cell[names.index(f)] > at) == above for f, above, at in rule)


def test_cover_learns_ordered_conjunctions():
    """Low rows lie in one corner of two features, and beyond a threshold of a third: two rules, one of them a conjunction."""
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 4, (4000, 5))
    low = ((cells[:, 0] > 1) & (cells[:, 2] > 2)) | ((cells[:, 4] > 2) & (cells[:, 3] <= 1))
    prune = rng.random(4000) < 1 / 3
    counts = np.column_stack([low & ~prune, ~low & ~prune, low & prune, ~low & prune])
    rules = covered(cells, counts)
    assert len(rules) >= 2 and sum(len(r) > 1 for r in rules) >= 2
    got = np.array([any(holds(r, c) for r in rules) for c in cells])
    assert (got == low).all()


def test_first_literal_has_the_most_information():
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 3, (600, 5))
    low = rng.random(600) < np.where(cells[:, 1] > 1, 0.97, 0.05)
    counts = np.column_stack([low, ~low, low, ~low])

    def gain(mask):
        p, q, p0, q0 = (low & mask).sum(), (~low & mask).sum(), low.sum(), (~low).sum()
        return p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + q0))) if p else -1

    best = max((gain((cells[:, f] > k) == above), f, above, k) for f in range(5) for k in range(2) for above in (True, False))
    name, above, at = covered(cells, counts)[0][0]
    assert (quality.FEATURES.index(name), above, at) == best[1:]


def test_imprecise_and_rare_rules_are_left_out():
    cells = np.array([[0] * 5, [1] * 5, [2] * 5])
    assert covered(cells, np.array([[50, 50, 25, 25], [0, 100, 0, 50], [40, 8, 20, 4]])) == []  # 0.83 at best
    assert covered(cells, np.array([[4, 0, 2, 0], [0, 100, 0, 50], [0, 100, 0, 50]])) == []  # six rows
    assert len(covered(cells, np.array([[6, 0, 2, 0], [0, 100, 0, 50], [0, 100, 0, 50]]))) == 1


def test_few_labels_are_enough(spark):
    """As few bad rows as a small labelled table has: a perfect rule is taken."""
    docs, labels = labelled(300, 7)
    got = {r.doc_id: r for r in quality.judge(frame(spark, docs), spark.createDataFrame(labels[:150], "doc_id long, quality int")).collect()}
    assert np.mean([got[i].kept for i, good in labels if good]) > 0.97
    assert np.mean([not got[i].kept for i, good in labels if not good]) > 0.8
    assert {r.rule_number for r in got.values()} - {None}


def plain_cover(rows, n_cuts, precision, support, most):
    """Sequential covering, a row at a time. rows: (bins, low, to prune on)."""
    literals = [(f, above, k) for f, n in enumerate(n_cuts) for k in range(n) for above in (True, False)]
    fits = lambda rule, r: all((r[0][f] > k) == above for f, above, k in rule)
    left, rules, closed = list(rows), [], set()
    while len(rules) < most:
        rule = []
        while len(rule) < 4:
            grow = [r for r in left if not r[2] and fits(rule, r)]
            p0, n0 = sum(r[1] for r in grow), sum(not r[1] for r in grow)
            if not p0 or not n0:
                break
            best = None
            for x in literals:
                p = sum(r[1] for r in grow if fits([x], r))
                n = sum(not r[1] for r in grow if fits([x], r))
                gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -1.0
                if not (not rule and x in closed) and (best is None or gain > best[0]):
                    best = gain, x
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break

        def counted(n, prune):
            held = [r[1] for r in left if fits(rule[:n], r) and r[2] == prune]
            return sum(held), len(held)

        def worth(n):
            p, of = counted(n, True)
            return (p + 1) / (of + 2)

        n = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        (low, of), (grown_low, grown_of) = counted(n, True), counted(n, False)
        if low < precision * of or grown_low + low < max(support, precision * (grown_of + of)):
            closed.add(rule[0])
            continue
        rules.append(rule[:n])
        left, closed = [r for r in left if not fits(rule[:n], r)], set()
    return rules


def test_cover_equals_a_row_by_row_version():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        bins = rng.integers(0, 4, (300, 5))
        odds = 0.05 + 0.9 * ((bins[:, seed % 5] > 1) & (bins[:, (seed + 2) % 5] <= 2)) + 0.4 * (bins[:, 4] == 3)
        rows = [(tuple(b), bool(rng.random() < o), bool(rng.random() < 1 / 3)) for b, o in zip(bins.tolist(), odds)]
        cells = sorted({r[0] for r in rows})
        counts = np.array([[sum(r[0] == c and r[1] == low and r[2] == prune for r in rows) for prune in (False, True) for low in (True, False)] for c in cells])
        got = covered(np.array(cells), counts, 0.8, 5)
        want = plain_cover(rows, [max(c[f] for c in cells) for f in range(5)], 0.8, 5, 8)
        assert got == [[(quality.FEATURES[f], above, float(k)) for f, above, k in rule] for rule in want]
    assert got  # rules are found


def test_memory_of_the_covering_is_linear_in_cells():
    """A full table of cells of 12 bins a feature."""
    import tracemalloc

    cells = np.indices((12,) * 5).reshape(5, -1).T
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 3, (len(cells), 4)).astype(float)
    counts[:, (0, 2)] *= cells[:, :1] > 8
    tracemalloc.start()
    rules = covered(cells, counts, most=2)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert isinstance(rules, list) and peak < 64 << 20
