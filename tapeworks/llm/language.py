"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from every row that may be learned from, in one pass that adds up one fixed-size vector a task.
The weights are fitted on a bounded sample of those rows (``sample`` in all, spread evenly over the languages) by
follow-the-regularised-leader with elastic-net penalties; a fifth of the sample is kept back to find the temperature that
calibrates the scores. The model is a matrix of fixed size; scoring is a map over the table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, row_slices

BUCKETS = 1 << 15
UNDETERMINED = "und"
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased text's 1- to 3-grams of characters, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    total, value = np.zeros(BUCKETS, np.int64), np.zeros(len(codes), np.uint32)
    for order, factor in enumerate(_FACTORS):
        value = (value[: len(codes) - order] ^ codes[order:]) * factor
        if not len(value):
            break
        value ^= value >> np.uint32(15)
        total += np.bincount(value & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


class TooManyLanguages(ValueError):
    """The table has more languages than the model may hold."""


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / np.sqrt(x @ x)

    def scores(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.scores(*gram_counts(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_leader(model: Model, rows: list, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> None:
    """Follow-the-regularised-leader: per-coordinate rates, weights that are exactly zero within the L1 penalty."""
    z = np.zeros((BUCKETS, len(model.languages)))
    n = np.zeros_like(z)

    def leader(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for label, at, counts in rows:
            x, w = model.vector(at, counts), leader(z[at], n[at])
            p = softmax(x @ w)
            p[label] -= 1
            g = np.outer(x, p)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    model.weights = leader(z, n)


def calibrate(model: Model, rows: list) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm. The label's target is (n + 1) / (n + 2) on
    n rows, and the others share the rest: languages that are told apart without an error have a finite best temperature."""
    if not rows:
        return 1.0
    rest = 1 / (len(rows) + 2) if len(model.languages) > 1 else 0.0
    scores, labels = np.array([model.scores(at, counts) for _, at, counts in rows]), np.array([x[0] for x in rows])

    def loss(log_t: float) -> float:
        x = scores / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        log_p = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
        own = log_p[np.arange(len(rows)), labels]
        others = (log_p.sum(axis=1) - own) / max(1, log_p.shape[1] - 1)
        return -((1 - rest) * own + rest * others).mean()

    low, high, ratio = -8.0, 8.0, (np.sqrt(5) - 1) / 2
    for _ in range(48):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3; and rows without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(True))


def train(
    docs: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, epochs: int = 3, model_bytes: int = 128 << 20, row_bytes: int = 256 << 20,
) -> Model:
    """Learns from rows with a language and a letter that are not held out. At most about ``sample`` rows are fitted on,
    chosen by a hash of the id, the same share of the bound for each language (and 50 rows of each at least). They are fitted,
    and cut at the bound or at ``row_bytes`` of packed counts, in the order of another hash, which mixes the languages whatever
    their shares. Every value of ``lang_col`` is learned; where the weights would exceed ``model_bytes`` (more than 512 languages
    with the default), ``TooManyLanguages`` is raised instead of leaving any out."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    most = model_bytes // (BUCKETS * 8)
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("rows")).limit(most + 1)
    counts = {r.lang: r.rows for r in counts.collect()}  # at most ``most`` rows and one
    if len(counts) > most:
        raise TooManyLanguages(f"{lang_col} has over {most} values, whose weights exceed model_bytes={model_bytes}")
    languages = sorted(counts)
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)))
    each = max(50, sample // len(languages))
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, each / counts[k]))])
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    rows = known.select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("turn")).alias("turn"),
        (place < rates[F.col(lang_col)] * F.lit(1 << 30)).alias("chosen"),
    )
    # as packed integers, a row is small on the driver too
    schema = "lang string, turn bigint, at binary, counts binary"
    types = [pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "turn", "at", "counts"])

        seen = np.zeros(BUCKETS + 1, np.int64)  # the last: documents
        for part in row_slices(batches):
            out = []
            for text, lang, turn, chosen in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                if has_letter(text):
                    at, n = gram_counts(text)
                    seen[at] += 1
                    seen[-1] += 1
                    if chosen:
                        out.append((lang, turn, at.astype("<i2").tobytes(), np.minimum(n, 2**31 - 1).astype("<i4").tobytes()))
            if out:
                yield batch(out)
        yield batch([(None, None, None, seen.astype("<i8").tobytes())])

    found = materialize(rows.mapInArrow(run, schema), "language-training")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for part in batches:
            for x in part.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.record_batch([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    tallies = found.where("lang IS NULL").select("counts")
    for parts in (64, 1):  # a vector for each task before, added up in two steps
        tallies = tallies.repartition(parts).mapInArrow(add, "counts binary")
    seen = np.frombuffer(tallies.first().counts, "<i8").astype(np.float64)
    model = Model(languages, np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1, np.zeros((BUCKETS, len(languages))))
    chosen = found.where("lang IS NOT NULL").orderBy("turn", "lang").limit(sample + 50 * len(languages))
    number, rows, size = {x: i for i, x in enumerate(languages)}, [], 0
    for r in chosen.select("lang", "at", "counts").toLocalIterator():
        size += len(r.at) + len(r.counts)
        if rows and size > row_bytes:
            break
        rows.append((number[r.lang], np.frombuffer(r.at, "<i2"), np.frombuffer(r.counts, "<i4")))
    fit_leader(model, [x for i, x in enumerate(rows) if i % 5], alpha, beta, l1, l2, epochs)
    model.temperature = calibrate(model, rows[::5])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row; ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Only the text decides, and all of it however long; of equal scores the first language by name wins. Repeated rows
    keep a row each; other columns are ignored, whatever their names; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            found = [model.predict(x) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Trains on ``docs`` and returns (doc_id, held_out, lang_pred, score) for each of its rows; odd rows as in ``identify``."""
    found = identify(docs, train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is determined with a score of at least ``least``.

    Null and letterless texts are undetermined, so they go; very long texts are taken whole; of equal scores the first language
    by name counts. Equal rows stay or go together; other columns pass through, whatever their names; an empty table gives
    an empty result."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            found = [model.predict(x) for x in part.column(place).to_pylist()]
            yield part.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
