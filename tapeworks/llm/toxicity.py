"""Toxicity by multiple-instance learning: a document is toxic as soon as one of its sentences is.

A sentence's score is logistic in the words and word beginnings that it holds (each counted once); a document's is the
noisy-or of its sentences. Only documents carry labels: the gradient of the document's loss tells each sentence its share,
so the weights learn which sentences offend, and the same weights locate them. The weights are fitted on a bounded sample
of labelled rows, each class weighted back to its number of rows; scoring is a map over the table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, row_slices

BUCKETS = 1 << 20
BEGINNINGS = (4, 6)
_SENTENCE = re.compile(r"[^.!?\n。！？]+")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Buckets of a lower-cased word and of its beginnings."""
    names = [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) > n)]
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, length, words) of each sentence that holds a word, in characters."""
    for found in _SENTENCE.finditer(text or ""):
        if words := set(_WORD.findall(found[0].lower())):
            yield found.start(), found.end() - found.start(), words


@dataclass
class Model:
    """Weights of the features that tell something, in order of their buckets, and the bias of a sentence."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def scorer(self, words: int = 1 << 18):
        """A function from a text to (score, [(start, length, score) of its sentences]); it remembers up to so many words."""
        table, known = dict(zip(self.at.tolist(), self.weights.tolist(), strict=True)), {}

        def weight(word: str) -> float:
            if (w := known.get(word)) is None:
                if len(known) >= words:
                    known.clear()
                w = known[word] = sum(table.get(x, 0.0) for x in set(word_features(word)))
            return w

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            found = [(a, n, self.bias + sum(map(weight, sorted(ws)))) for a, n, ws in sentences(text)]
            if not found:
                return 0.0, []
            z = np.array([x for _, _, x in found])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return float(-np.expm1(-np.logaddexp(0, z).sum())), [(a, n, float(x)) for (a, n, _), x in zip(found, p, strict=True)]

        return score


def fit(bags: list[tuple[int, float, list[np.ndarray]]], most: int = 4096, steps: int = 300, rate: float = 0.5, l1: float = 0.2, l2: float = 0.001) -> Model:
    """Noisy-or of logistic sentence scores by gradient steps with per-coordinate rates and an elastic net, whose penalties are
    shared out over the documents: the more there are, the less it weighs.

    bags: (label, weight, buckets held by each sentence). The ``most`` features are taken whose presence in a document tells most
    of its label (of equal ones, the smaller bucket)."""
    label = np.array([y for y, _, _ in bags], np.float64)
    weight = np.array([w for _, w, _ in bags], np.float64)
    positive, total = (weight * label).sum(), weight.sum()
    if not 0 < positive < total:
        return Model(bias=20.0 if positive else -20.0)
    weight, share, l1, l2 = weight / total, positive / total, l1 / len(bags), l2 / len(bags)
    held = [np.unique(np.concatenate(s)) if s else np.zeros(0, np.int32) for _, _, s in bags]
    at, place = np.unique(np.concatenate(held), return_inverse=True)
    own = np.repeat(np.arange(len(bags)), [len(x) for x in held])
    seen, hit = np.bincount(place, weight[own], len(at)), np.bincount(place, (weight * label)[own], len(at))

    def entropy(p):
        return -(p * np.log(np.maximum(p, 1e-300)) + (1 - p) * np.log(np.maximum(1 - p, 1e-300)))

    with np.errstate(divide="ignore", invalid="ignore"):
        without = np.where(seen < 1, (share - hit) / (1 - seen), 0)
        gain = entropy(share) - seen * entropy(np.clip(hit / seen, 0, 1)) - (1 - seen) * entropy(np.clip(without, 0, 1))
    best = np.sort(np.argsort(-gain, kind="stable")[:most])
    at = at[best]
    feature, sentence, bag = [], [], []
    for i, (_, _, bag_sentences) in enumerate(bags):
        for s in bag_sentences:
            k = np.minimum(np.searchsorted(at, s), len(at) - 1)
            k = k[at[k] == s]
            feature.append(k)
            sentence.append(np.full(len(k), len(bag)))
            bag.append(i)
    feature, sentence, bag = np.concatenate(feature), np.concatenate(sentence), np.array(bag)
    w, b = np.zeros(len(at)), float(np.log(share) - np.log(max(1.0, len(bag) / len(bags))))
    seen_w, seen_b = np.zeros(len(at)), 0.0
    for _ in range(steps):
        z = np.bincount(sentence, w[feature], len(bag)) + b
        s = np.bincount(bag, np.logaddexp(0, z), len(bags))
        odds = 1 / np.expm1(np.clip(s, 1e-12, 500))  # (1 - p) / p
        g = weight[bag] * np.where(label[bag] > 0, -odds[bag], 1.0) / (1 + np.exp(-np.clip(z, -500, 500)))
        gw, gb = np.bincount(feature, g[sentence], len(at)) + l2 * w, g.sum()
        seen_w, seen_b = seen_w + gw * gw, seen_b + gb * gb
        pace = rate / (np.sqrt(seen_w) + 1e-8)
        w = w - pace * gw
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
        b -= rate * gb / (np.sqrt(seen_b) + 1e-8)
    return Model(at[w != 0], w[w != 0], float(b))


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 0 when divided by 5; and rows without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", **options,
) -> Model:
    """Learns from labelled rows that are not held out; labels other than 0 and 1 and null ids are left out, and an id labelled
    both ways counts as 1. Each class gives at most ``sample`` / 2 ids, chosen by a hash, and of rows at most ``sample``, none of
    over ``longest`` bytes: both bound what is fitted on, and nothing else. Only labels are shuffled, and the chosen ids sent out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).alias("label"))
    known = materialize(known, "toxicity-labels")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    half = sample // 2
    turn = F.xxhash64("id", F.lit("turn"))
    chosen = None
    for label, n in sorted(counts.items()):
        part = known.where(F.col("label") == label).orderBy(turn).limit(half).select("id", "label", F.lit(max(1.0, n / half)).alias("weight"))
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return Model()
    chosen = materialize(chosen, "toxicity-chosen")  # at most ``sample`` rows
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= longest)
    rows = source.join(F.broadcast(chosen), "id").select(F.xxhash64("id", "text").alias("turn"), "label", "weight", "text")
    schema = "turn bigint, label int, weight double, sizes binary, buckets binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for part in row_slices(batches):
            sizes, buckets = [], []
            for text in part.column(3).to_pylist():
                held = []
                for _, _, words in sentences(text):
                    own = set()
                    for w in words:
                        own.update(known.get(w) or known.setdefault(w, word_features(w)))
                    held.append(np.array(sorted(own), "<i4"))
                sizes.append(np.array([len(x) for x in held], "<i4").tobytes())
                buckets.append(b"".join(x.tobytes() for x in held))
                if len(known) > 1 << 18:
                    known.clear()
            yield pa.record_batch([part.column(0), part.column(1).cast(pa.int32()), part.column(2), pa.array(sizes, pa.binary()), pa.array(buckets, pa.binary())], ["turn", "label", "weight", "sizes", "buckets"])

    found = materialize(rows.mapInArrow(run, schema), "toxicity-training")
    bags = []
    for r in found.orderBy("turn", "label").limit(sample).toLocalIterator():
        ends = np.cumsum(np.frombuffer(r.sizes, "<i4"))
        bags.append((r.label, r.weight, np.split(np.frombuffer(r.buckets, "<i4"), ends[:-1]) if len(ends) else []))
    return fit(bags, **options) if bags else Model()


def score_toxicity(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_sentences, offending) for each row: the document's score, and (start, length, score) of the sentences
    whose own score is at least ``least``, in characters, in order.

    Only the text decides, and all of it however long. Null, empty and word-less texts have no sentence and score 0. Equal
    texts get equal scores; repeated rows keep a row each; other columns are ignored, whatever their names; an empty table
    gives an empty result. Without labels of both kinds every sentence gets the one label's score."""
    spot = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part in row_slices(batches):
            found = [score(x) for x in part.column(1).to_pylist()]
            spots = [[{"start": a, "length": n, "score": p} for a, n, p in own if p >= least] for _, own in found]
            yield pa.record_batch(
                [part.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array(spots, pa.list_(spot))],
                ["doc_id", "score", "n_sentences", "offending"],
            )

    schema = "doc_id bigint, score double, n_sentences bigint, offending array<struct<start: bigint, length: bigint, score: double>>"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Trains on ``docs`` and ``labels`` and returns (doc_id, held_out, score, predicted, n_sentences, offending) for each row
    of ``docs``; odd rows as in ``score_toxicity``."""
    found = score_toxicity(docs, train(docs, labels, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted, "n_sentences", "offending")
