"""Quality by a factorisation machine.

Features are hashed words, statistics of the text's structure, and metadata (hashed source and language). Besides a weight, each feature has ``FACTORS`` latent numbers
v; the interaction of all pairs, the sum of <v_i, v_j> x_i x_j, is half of (sum v x)^2 - sum (v x)^2 for each factor, so a document scores in time
linear in its words. Fitted by AdaGrad on the logistic loss over labelled documents, classes weighted alike.

Scale: the labelled sample is bounded by ``PER_CLASS``; scoring is map-only with a broadcast of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import bytes_of
from siteloom.llm.common import hashes, in_one_task, labelled_sample, map_slices, mixed, row_of, segment_sums, words
from siteloom.llm.stats import class_counts, distinct

#: Labelled documents of each class at most; one in five is held out for the threshold.
PER_CLASS = 2500
#: Hashed words, sources and languages; latent numbers of a feature.
WORDS, SOURCES, LANGUAGES, FACTORS = 1 << 16, 1 << 9, 1 << 6, 8
STRUCTURE = ["log_bytes", "log_words", "word_bytes", "distinct", "upper", "digit", "space", "sentence", "mark", "beyond", "lines", "words_a_line", "repeats", "bias"]
SIZE = WORDS + SOURCES + LANGUAGES + len(STRUCTURE)
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.15, 5e-4
#: Share of the held-out good documents that the threshold may lose.
LOST = 0.01


def hashed(values: pa.Array, salt: int, size: int) -> np.ndarray:
    coded = values.cast(pa.string()).fill_null("\x00").dictionary_encode()
    return (mixed(hashes(coded.dictionary), salt) % np.uint64(size)).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)


def structure(texts: pa.Array, offsets: np.ndarray, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    data, at = bytes_of(texts)
    size, count, n = np.diff(at), np.diff(offsets), len(texts)
    kinds = class_counts(data, at) / np.maximum(size, 1)[:, None]
    lines = kinds[:, 7] * size + 1
    again = np.zeros(len(ids), np.int64)
    again[1:] = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
    return np.stack([np.log1p(size) / 10, np.log1p(count) / 10, np.minimum(size / np.maximum(count, 1), 40) / 20, distinct(row, ids, n) / np.maximum(count, 1), kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 5], kinds[:, 6], np.log1p(lines) / 5, np.log1p(count / lines) / 5, segment_sums(again, offsets) / np.maximum(count, 1), np.ones(n)], 1)


def features(texts: pa.Array, sources: pa.Array, languages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n + 1 offsets, feature numbers, values): each distinct word once, its values of length 1 together."""
    offsets, ids, vocabulary = words(texts)
    row, n = row_of(offsets), len(texts)
    dense = structure(texts, offsets, row, ids)
    bucket = (mixed(hashes(vocabulary), 5) % np.uint64(WORDS)).astype(np.int64)
    key = np.unique(row * WORDS + bucket[ids]) if len(ids) else np.zeros(0, np.int64)
    row, ids = key // WORDS, key % WORDS
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
    rows = np.concatenate([row, np.arange(n), np.arange(n), np.repeat(np.arange(n), len(STRUCTURE))])
    numbers = np.concatenate([ids, WORDS + hashed(sources, 6, SOURCES), WORDS + SOURCES + hashed(languages, 7, LANGUAGES), np.tile(SIZE - len(STRUCTURE) + np.arange(len(STRUCTURE)), n)])
    values = np.concatenate([value, np.full(2 * n, 0.3), dense.ravel()])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), numbers[order], values[order].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    factors: np.ndarray
    threshold: float = 0.5

    def score(self, offsets: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Probability that a document is good."""
        terms = self.factors[numbers] * values[:, None]
        both = segment_sums(terms, offsets) ** 2 - segment_sums(terms * terms, offsets)
        raw = segment_sums(self.weights[numbers] * values, offsets) + 0.5 * both.sum(1)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def train(offsets: np.ndarray, numbers: np.ndarray, values: np.ndarray, y: np.ndarray, seed: int = 1) -> Model:
    random = np.random.default_rng(seed)
    model = Model(np.zeros(SIZE, np.float32), random.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32))
    squares = [np.full(SIZE, 1e-4, np.float32), np.full((SIZE, FACTORS), 1e-4, np.float32)]
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    sizes = np.diff(offsets)
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for own in np.array_split(order, max(1, len(y) // BATCH)):
            at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in own])
            ends = np.concatenate([[0], np.cumsum(sizes[own])])
            n, x = numbers[at], values[at]
            gradient = ((model.score(ends, n, x) - y[own]) * balance[own] / len(own)).astype(np.float32)
            terms = model.factors[n] * x[:, None]
            sums, row = segment_sums(terms, ends), row_of(ends)
            touched, where = np.unique(n, return_inverse=True)
            g = gradient[row] * x
            step = np.bincount(where, g, len(touched)) + DECAY * model.weights[touched]
            squares[0][touched] += step**2
            model.weights[touched] -= RATE * step / np.sqrt(squares[0][touched])
            inner = g[:, None] * (sums[row] - terms)
            step = np.stack([np.bincount(where, inner[:, f], len(touched)) for f in range(FACTORS)], 1) + DECAY * model.factors[touched]
            squares[1][touched] += step**2
            model.factors[touched] -= 0.3 * RATE * step / np.sqrt(squares[1][touched])
    return model


def fit_sample(texts: pa.Array, sources: pa.Array, languages: pa.Array, y: np.ndarray) -> Model | None:
    """None where a class is missing. The threshold is the score that all but ``LOST`` of the held-out good documents reach."""
    held = np.arange(len(y)) % 5 == 4
    if any(not (y[~held] == c).any() for c in (0, 1)):
        return None
    kept, probe = pa.array(~held), pa.array(held if all((y[held] == c).any() for c in (0, 1)) else ~held)
    model = train(*features(texts.filter(kept), sources.filter(kept), languages.filter(kept)), y[~held])
    score, truth = model.score(*features(texts.filter(probe), sources.filter(probe), languages.filter(probe))), y[np.array(probe)]
    model.threshold = float(np.quantile(score[truth == 1], LOST, method="lower"))
    return model


def _fit(rows: pa.Table) -> Model | None:
    rows = rows.sort_by([("y", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    return fit_sample(*(rows[c].combine_chunks() for c in ("text", "source", "lang")), rows["y"].to_numpy())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """On labelled documents with a text; repeated texts count once."""
    sample = labelled_sample(docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")), labels, "quality", per_class).where("text is not null")
    return in_one_task(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").cast("long").alias("y"), F.min("source").alias("source"), F.min("lang").alias("lang")), _fit)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, quality, keep) for every row; keep where quality reaches the threshold.

    A null or empty text has quality 0 and is not kept. Without a model (a class has no labels) quality is null and what has a text is kept. Null sources and
    languages are values of their own. Whole texts are scored; repeated rows alike; an equal score is kept. An empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, has = shared.value, np.diff(bytes_of(batch.column("text"))[1]) > 0
        q = np.where(has, m.score(*features(*(batch.column(c) for c in ("text", "source", "lang")))), 0.0) if m else None
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(q) if m else pa.nulls(len(has), pa.float64()), pa.array(has & (q >= m.threshold) if m else has)], ["doc_id", "quality", "keep"])

    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "lang": F.col("lang").cast("string")})
    return map_slices(rows, ["doc_id", "text", "source", "lang"], run, "doc_id long, quality double, keep boolean")
