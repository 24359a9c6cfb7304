"""Quality rules learned as a decision list over text statistics, in DataFrame operations only.

The statistics of all labelled rows are summed up in one grouped count over binned features (a table of bounded size,
whatever the input). On its cells sequential covering grows threshold conjunctions by information gain on two thirds of
the rows, prunes them on the rest, and takes them in order while they stay precise. The list is then one ordered Spark
CASE expression over the statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("n_words", "mean_chars", "symbols_a_word", "dup_lines", "repeat_share")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(grams: Column) -> Column:
    """How many words lie in windows that occur again: sorts (hash, position), keeps the positions whose hash has an
    equal neighbour, and adds up the union of their windows. O(n log n), and only where some window repeats."""
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        def again(x: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]).otherwise(F.lit(False))
            return before | F.when(j < F.size(s) - 1, F.get(s, j + 1)["h"] == x["h"]).otherwise(F.lit(False))

        return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

    def union(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return _let(_let(pairs, positions), union)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: Column) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long, and the columns ``others``, for each
    row. A null text counts as an empty one: all zero."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    chars = F.length(F.translate(text, BLANK, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    repeats = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def grams(w: Column) -> Column:
        window = lambda _, i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), window)

    def of_words(w: Column) -> Column:
        again = _let(grams(w), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _repeated(g)).otherwise(F.lit(0)))
        return F.struct(F.size(w).alias("n_words"), again.alias("n_repeat_words"))

    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        _let(words, of_words).alias("w"),
        chars.cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        repeats.cast("bigint").alias("n_dup_lines"),
        F.struct(F.lit(0).alias("_"), *others).alias("others"),
    )
    return base.select(
        "doc_id", F.col("w.n_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.n_repeat_words").cast("bigint").alias("n_repeat_words"), *(["others"] if others else []),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_chars": F.col("word_chars") / n,
        "symbols_a_word": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass
class DecisionList:
    """Ordered conjunctions of (feature, above, threshold); a row is rejected by the first rule that holds, else kept."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1-based number of the first rule that holds, null if none does: one ordered CASE expression."""
        values, case = features(), None
        for n, rule in enumerate(self.rules, 1):
            holds = F.lit(True)
            for name, above, at in rule:
                holds &= (values[name] > at) if above else (values[name] <= at)
            case = F.when(holds, F.lit(n)) if case is None else case.when(holds, F.lit(n))
        return F.lit(None).cast("int") if case is None else case.otherwise(F.lit(None).cast("int"))

    def keeps(self) -> Column:
        return self.rule_number().isNull()


def _gain(p0, n0, p1, n1):
    """Information gained about the rows to find when (p0, n0) shrinks to (p1, n1)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0)))
    return np.where(p1 > 0, gain, -1.0)


def cover(cells: np.ndarray, counts: np.ndarray, cuts: list[list[float]], precision: float, support: int, most: int) -> DecisionList:
    """Sequential covering. cells: bin of each feature; counts: low and high rows to grow on, low and high to prune on.

    A conjunction grows by the literal of most information gain until it holds no high row (of equal gains, the first). Of
    its beginnings the one stays that is most precise on the rows to prune on, by Laplace's estimate (of equal ones, the
    shortest). It enters the list if at least ``precision`` of the rows that it holds are low, both on the rows to prune on and
    on all, and at least ``support`` rows are; else its first literal begins no more conjunctions until a rule is taken."""
    literals = [(f, above, k) for f in range(cells.shape[1]) for k in range(len(cuts[f])) for above in (True, False)]

    def mask(i: int) -> np.ndarray:
        f, above, k = literals[i]
        return (cells[:, f] > k) if above else (cells[:, f] <= k)

    def inside_of_each(inside: np.ndarray, column: int) -> np.ndarray:
        """Rows of a column of counts that each literal leaves of ``inside``: prefix sums over the bins of its feature."""
        out = []
        for f, cut in enumerate(cuts):
            below = np.cumsum(np.bincount(cells[inside, f], counts[inside, column], len(cut) + 1))
            out.append(np.column_stack([below[-1] - below[: len(cut)], below[: len(cut)]]).ravel())
        return np.concatenate(out)

    left, rules, closed = np.ones(len(cells), bool), [], np.zeros(len(literals), bool)
    while len(rules) < most and len(literals):
        rule, inside = [], left
        while len(rule) < 4:
            p0, n0 = counts[inside, 0].sum(), counts[inside, 1].sum()
            if not p0 or not n0:
                break
            gains = _gain(p0, n0, inside_of_each(inside, 0), inside_of_each(inside, 1))
            if not rule:
                gains[closed] = -1.0
            best = int(np.argmax(gains))
            if gains[best] <= 1e-9:
                break
            rule, inside = [*rule, best], inside & mask(best)
        if not rule:
            break

        def held(n: int) -> np.ndarray:
            return left & np.logical_and.reduce([mask(i) for i in rule[:n]])

        def worth(n: int) -> float:
            p, q = counts[held(n), 2].sum(), counts[held(n), 3].sum()
            return (p + 1) / (p + q + 2)

        n = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        grown_low, grown_high, low, high = counts[held(n)].sum(axis=0)
        if low < precision * (low + high) or grown_low + low < max(support, precision * (grown_low + grown_high + low + high)):
            closed[rule[0]] = True
            continue
        rules.append([(FEATURES[f], above, cuts[f][k]) for f, above, k in (literals[i] for i in rule[:n])])
        left, closed = left & ~held(n), np.zeros(len(literals), bool)
    return DecisionList(rules)


def learn(
    statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    precision: float = 0.95, support: int = 8, most: int = 8,
) -> DecisionList:
    """A list that rejects rows like those labelled 0. Learns from all labelled rows that pass the base rules; labels other
    than 0 and 1 and null ids are left out, and an id labelled both ways counts as 1. No labels: an empty list. Two thirds of
    the rows, by a hash of the id, are grown on and the rest pruned on."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(label_col).alias("good"))
    rows = statistics.where(~base_failed()).join(known, "doc_id")
    rows = rows.select(*[c.alias(k) for k, c in features().items()], "good", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"))
    rows = materialize(rows, "quality-labelled")
    levels = {0: [0.02, 0.1, 0.25, 0.5, 0.75, 0.9], 1: [0.01, 0.1, 0.5, 0.9, 0.99, 1.0]}
    wanted = [F.percentile_approx(F.when(F.col("good") == g, F.col(f)), q, 1000).alias(f"{f}_{g}") for f in FEATURES for g, q in levels.items()]
    row = rows.agg(*wanted).first()
    seen = [sorted({float(x) for g in levels for x in row[f"{f}_{g}"] or []}) for f in FEATURES]
    cuts = [[(a + b) / 2 for a, b in zip(x, x[1:], strict=False)] for x in seen]  # midway between the classes' quantiles
    bins = [sum(((F.col(f) > x).cast("int") for x in c), F.lit(0)).alias(f"bin_{f}") for f, c in zip(FEATURES, cuts, strict=True)]
    grow = F.col("fold") != 0
    tally = [F.count_if(part & (F.col("good") == g)).alias(f"{name}{g}") for name, part in (("grow", grow), ("prune", ~grow)) for g in (0, 1)]
    # at most 13 bins a feature: the cells are bounded whatever the number of rows; each is nine numbers in one array here
    cells = rows.select(*bins, "good", "fold").groupBy(*[f"bin_{f}" for f in FEATURES]).agg(*tally)
    table = np.fromiter((tuple(x) for x in cells.toLocalIterator()), np.dtype((np.int64, len(FEATURES) + len(tally))))
    if not len(table):
        return DecisionList()
    table = table[np.lexsort(table.T[::-1])]
    return cover(table[:, : len(FEATURES)], table[:, len(FEATURES) :].astype(float), cuts, precision, support, most)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics, base_failed, kept and the number of the rule that rejects (null: none), for each row of ``docs``.

    Null and empty texts have no words and fail the base rules; very long texts are taken whole. Repeated rows keep a row
    each; where several rules hold, the first in the list counts; other columns are ignored, whatever their names; an
    empty table gives an empty result."""
    statistics = materialize(text_statistics(docs, id_col, text_col), "quality-statistics")
    rules = learn(statistics, labels)
    failed = base_failed()
    return statistics.select("*", failed.alias("base_failed"), (~failed & rules.keeps()).alias("kept"), rules.rule_number().alias("rule_number"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that pass the base rules and the learned list.

    Null and empty texts fail the base rules, so they go; very long texts are taken whole. Equal rows have one verdict and
    stay or go together; other columns pass through, whatever their names; an empty table gives an empty result."""
    columns = docs.columns
    rows = text_statistics(docs, id_col, text_col, F.struct(*[F.col(c) for c in columns]).alias("row"))
    rows = materialize(rows, "quality-rows")
    rules = learn(rows.select("doc_id", *STATISTICS), labels)
    return rows.where(~base_failed() & rules.keeps()).select("others.row.*")
